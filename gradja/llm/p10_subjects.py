"""Problem 10: the subject areas of each document.

One-versus-rest linear classifiers on hashed word n-grams score the sentences of
a document; an area counts if its share of the document's own sentences reaches a
calibrated threshold. Three kinds of labels teach. Human labels are given by
document and are few, partly wrong or incomplete, so they are weak labels of its
sentences: a first fit takes a document's areas for each of its sentences, later
fits give each sentence the one of them that it scores best on, or none. Documents
without human labels get a weak one from the words of their address path, their
title and their section (source and genre), where those point to one area with
SURE posterior probability; they teach in the same way with less weight. The words
of the address are a further sentence of every document that teaches.

Thresholds are calibrated on human-labelled documents held out from the fit, one in
HELD_OUT. Only the fit uses samples: at most SAMPLE documents with human labels and
WEAK without, those with the smallest hash. Scoring covers every document and whole
texts, in one pass without a shuffle.

Defined cases: null, empty and blank texts have no row; a document without a
sentence of any area has none; without usable labels there is no row at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradja.llm.arrow import h64, read
from gradja.llm.lines import slug, url_slug
from gradja.llm.textform import consistent, to_latin

#: Bounds of the documents that the fit takes: with human labels, and with labels from addresses and sections.
SAMPLE, WEAK = 4000, 1500
#: One labelled document in so many is held out from the fit for the thresholds.
HELD_OUT = 4
#: Posterior probability from which an address and section give a weak label, and the weight of its sentences.
SURE, WEAK_WEIGHT = 0.9, 0.5
#: Hashed n-gram features.
FEATURES = 1 << 18
ROUNDS, EPOCHS = 3, 40
#: Share of own sentences around which thresholds are sought, per area.
SHARES = np.linspace(0.1, 0.3, 17)

_TOKEN = re.compile(r"[^\W\d_]+")
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿가-힯]")
_END = re.compile(r"[.!?…。！？।؟۔;]+[”\"“»)’]*(?:\s+|(?<=[。！？।])[”」]?)(?=[^a-zčćšžđа-яђјљњћџ\s])|\n+|(?<=[฀-໿])\s+(?=[฀-໿])")
_NO_END = re.compile(r"(?:\b(?:dr|prof|mr|ms|mrs|ul|br|odn|tzv|npr|inc|e\.g|др|проф|ул|бр|одн|тзв|нпр|v|d|в|д)|\b[A-ZČĆŠŽĐА-ЯЂЈЉЊЋЏ])\.\s*$", re.I)
_CLOSED = re.compile(r"[.!?…。！？।؟۔;][”\"“»)’\]]*\s*$|[฀-໿]\d*\s*$")


def sentences(text: str) -> list[str]:
    """Sentences of a text, near enough for counting; lines that end without an end mark (menus, headlines) fall out."""
    out: list[str] = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        at, part = 0, []
        for m in _END.finditer(line):
            if _NO_END.search(line, max(at, m.start() - 8), m.end()):
                continue
            part.append(line[at : m.end()])
            at = m.end()
        rest = line[at:]
        if rest.strip() and (part or _CLOSED.search(rest)):
            part.append(rest)
        out += part
    return out


class Features:
    """Hashed word unigrams and bigrams; names (capitalised words inside a sentence) are left out."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def of(self, sentence: str) -> list[int]:
        out = []
        memo = self.memo
        for i, w in enumerate(_TOKEN.findall(sentence)):
            h = memo.get(w)
            if h is None:
                if len(memo) > 500_000:
                    memo.clear()
                if _UNSPACED.search(w):
                    h = -2
                elif w[0].isupper() and w[1:].islower():
                    h = -1
                else:
                    h = h64(w.lower()) & 0x7FFFFFFF
                memo[w] = h
            if h >= 0:
                out.append(h)
            elif h == -2:
                out += [h64(w[k : k + 2]) & 0x7FFFFFFF for k in range(len(w) - 1)]
            elif i == 0:
                out.append(h64(w.lower()) & 0x7FFFFFFF)
        return out


def matrix(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(feature indexes, row starts) of the unigrams and bigrams of each row; every row has one constant feature."""
    lens = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(lens.sum()))
    uni = (flat * 2654435761 >> 8) % (FEATURES - 1) + 1
    owner = np.repeat(np.arange(len(rows)), lens)
    two = (flat[:-1] * 40503 + flat[1:] * 2654435761 >> 7) % (FEATURES - 1) + 1 if len(flat) > 1 else flat[:0]
    same = owner[:-1] == owner[1:] if len(flat) > 1 else np.zeros(0, bool)
    idx = np.concatenate([np.zeros(len(rows), np.int64), uni, two[same]])
    own = np.concatenate([np.arange(len(rows)), owner, owner[:-1][same] if len(flat) > 1 else owner[:0]])
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(rows))
    return idx[order], np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)


def scores(w: np.ndarray, idx: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean weight of each row's features, by area."""
    if not len(starts):
        return np.zeros((0, w.shape[1]), dtype=np.float32)
    n = np.diff(np.append(starts, len(idx)))[:, None]
    return np.add.reduceat(w[idx], starts, axis=0) / np.sqrt(n)


def fit_linear(idx: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """One-versus-rest logistic regression by full gradients with per-feature steps (Adagrad) and light shrinkage."""
    k = y.shape[1]
    w = np.zeros((FEATURES, k), dtype=np.float32)
    used, inv = np.unique(idx, return_inverse=True)
    wu, g2 = np.zeros((len(used), k), dtype=np.float32), np.full((len(used), k), 1e-6, dtype=np.float32)
    n = np.diff(np.append(starts, len(idx)))
    scale = (1 / np.sqrt(n)).astype(np.float32)
    pos = np.maximum(y.sum(0), 1)
    balance = np.where(y > 0.5, np.minimum(len(y) / (2 * pos), 8.0)[None, :], 1.0).astype(np.float32) * weight[:, None]
    for _ in range(epochs):
        z = np.add.reduceat(wu[inv], starts, axis=0) * scale[:, None]
        err = (1 / (1 + np.exp(-z)) - y) * balance * scale[:, None]
        for c in range(k):
            g = np.bincount(inv, weights=np.repeat(err[:, c], n), minlength=len(used)).astype(np.float32) + 0.02 * wu[:, c]
            g2[:, c] += g * g
            wu[:, c] -= 0.5 * g / np.sqrt(g2[:, c])
    w[used] = wu
    return w


class Model:
    """Weights by area, the score from which a sentence counts, and the share from which a document has the area."""

    def __init__(self, areas: list[str], w: np.ndarray, share: np.ndarray):
        self.areas, self.share = areas, share
        self.used = np.flatnonzero(np.abs(w).max(1) > 0)
        self.values = w[self.used].astype(np.float16)

    def weights(self) -> np.ndarray:
        w = np.zeros((FEATURES, len(self.areas)), dtype=np.float32)
        w[self.used] = self.values
        return w


def shares(w: np.ndarray, idx: np.ndarray, starts: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Share of each document's sentences by area; a sentence is about its best area if that scores above even odds."""
    out = np.zeros((n_docs, w.shape[1]))
    if not len(starts):
        return out
    z = scores(w, idx, starts)
    best = z.argmax(1)
    hit = z[np.arange(len(z)), best] > 0
    np.add.at(out, (doc[hit], best[hit]), 1)
    n = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    return out / n[:, None]


class Sections:
    """What the words of addresses and titles, and sections, tell of the area: naive Bayes over the labelled documents, each feature once a document."""

    def __init__(self, areas: list[str], labelled: list[tuple[set[str], list[str]]]):
        self.areas, self.seen, self.counts = areas, {}, np.full(len(areas), 0.5)
        index = {a: i for i, a in enumerate(areas)}
        for features, given in labelled:
            for a in given:
                self.counts[index[a]] += 1 / len(given)
                for f in features:
                    self.seen.setdefault(f, np.zeros(len(areas)))[index[a]] += 1 / len(given)

    def area(self, features: set[str]) -> str | None:
        """The area that the features point to with SURE probability, at least two of them known from several documents; else None."""
        known = [self.seen[f] for f in features if f in self.seen and self.seen[f].sum() >= 2]
        if len(known) < 2:
            return None
        score = np.log(self.counts) + sum(np.log((n + 0.1 * self.counts / self.counts.sum()) / (self.counts + 0.1)) for n in known)
        p = np.exp(score - score.max())
        return self.areas[int(p.argmax())] if p.max() / p.sum() >= SURE else None


def section_features(url: str | None, title: str | None, source: str | None, genre: str | None) -> set[str]:
    """Words of the address path and the title, and the section; names of places and people hardly come again and so tell nothing."""
    words = {w for w in url_slug(url).split("-") if len(w) > 2} | {w for w in slug(title or "").split("-") if len(w) > 2}
    return words | {f"source {(source or '').strip().lower()}", f"genre {(genre or '').strip().lower()}"}


def fit(rows: list[tuple], areas: list[str], unlabelled: list[tuple] = ()) -> Model | None:
    """Fit on labelled documents (doc_id, text, url, [areas], section) and what sections tell of others (doc_id, text, url, section); None without labels."""
    index = {a: i for i, a in enumerate(areas)}
    held = [h64(str(r[0])) % HELD_OUT == 0 for r in rows]
    sections = Sections(areas, [(r[4], [a for a in r[3] if a in index]) for r, out in zip(rows, held) if not out])
    weak = [(r[0], r[1], r[2], [a]) for r in unlabelled if (a := sections.area(r[3])) in index]
    f = Features()
    sents, doc, y0, slug_row = [], [], [], []
    for i, (_, text, url, labels) in enumerate([r[:4] for r in rows] + weak):
        y = np.zeros(len(areas), dtype=np.float32)
        y[[index[a] for a in labels if a in index]] = 1
        for s in sentences(consistent(text)):
            x = f.of(to_latin(s))
            if len(x) > 2:
                sents.append(x)
                doc.append(i)
                y0.append(y)
                slug_row.append(False)
        if words := f.of(url_slug(url).replace("-", " ")):
            sents.append(words)
            doc.append(i)
            y0.append(y)
            slug_row.append(True)
    doc, is_slug = np.array(doc, dtype=np.int64), np.array(slug_row, dtype=bool)
    teaches = ~np.array(held + [False] * len(weak), dtype=bool)[doc] if len(doc) else np.zeros(0, dtype=bool)
    if not teaches.any():
        return None
    idx, starts = matrix([s for s, ok in zip(sents, teaches) if ok])
    given = np.array(y0)[teaches]
    trust = np.where(doc[teaches] >= len(rows), WEAK_WEIGHT, 1.0).astype(np.float32)
    several = given.sum(1)
    y, weight = given / np.maximum(several, 1)[:, None], np.where(several > 1, 0.3, 1.0).astype(np.float32)
    for r in range(ROUNDS):
        w = fit_linear(idx, starts, y, weight * trust)
        if r + 1 == ROUNDS:
            break
        z = scores(w, idx, starts)
        allowed = np.where(given > 0, z, -1e9)
        top = allowed.argmax(1)
        value, other = allowed[np.arange(len(z)), top], z.max(1)
        y = np.zeros_like(given)
        sure = value > -0.5
        y[np.flatnonzero(sure), top[sure]] = 1
        # a sentence that clearly belongs to an area its document wasn't given doesn't teach; one of none teaches none
        weight = np.where((other > value + 1) & (other > 0.5), 0.0, 1.0).astype(np.float32)
    judged = ~teaches & ~is_slug
    own = shares(w, *matrix([s for s, ok in zip(sents, judged) if ok]), doc[judged], len(rows)) if judged.any() else np.zeros((len(rows), len(areas)))
    own, truth = own[held], np.zeros((len(rows), len(areas)), dtype=bool)
    for i, r in enumerate(rows):
        truth[i, [index[a] for a in r[3] if a in index]] = True
    truth = truth[held]

    def f1(t, c):
        got, want = own[:, c] >= t, truth[:, c]
        return 2 * (got & want).sum() / np.maximum(got.sum() + want.sum(), 1)

    everywhere = np.array([np.mean([f1(t, c) for c in range(len(areas))]) for t in SHARES])
    # each area leans on all areas together, the more so the fewer its labels
    lean = 60 / (60 + truth.sum(0))
    share = np.array([SHARES[int(np.argmax([lean[c] * e + (1 - lean[c]) * f1(t, c) - 0.02 * abs(t - 0.2) for t, e in zip(SHARES, everywhere)]))] for c in range(len(areas))])
    return Model(areas, w, share)


_META = ("doc_id", "text", "url", "title", "source", "genre")


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE, weak: int = WEAK) -> Model | None:
    """Fit on at most `sample` documents with human labels and `weak` without; nulls and labels outside the areas don't count."""
    areas = sorted(r.subject for r in subjects.filter("subject is not null").select("subject").distinct().collect())
    if not areas:
        return None
    given = labels.filter("doc_id is not null").select("doc_id", F.lower(F.trim("subject")).alias("subject")).filter(F.col("subject").isin(areas))
    by_doc = given.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("areas"))  # at most all areas
    chosen = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    full = documents.filter("trim(text) <> ''").select(*_META)
    meta = lambda r: section_features(r.url, r.title, r.source, r.genre)
    rows = full.join(chosen, "doc_id").collect()
    others = full.join(by_doc, "doc_id", "left_anti").filter("url is not null or title is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(weak).collect()
    if not rows:
        return None
    labelled = sorted(((r.doc_id, r.text, r.url, list(r.areas), meta(r)) for r in rows), key=lambda r: (r[0], r[1]))
    return fit(labelled, areas, sorted(((r.doc_id, r.text, r.url, meta(r)) for r in others), key=lambda r: (r[0], r[1])))


def subject_shares(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, subject, share) of the areas that reach their threshold."""
    schema = "doc_id long, subject string, share double"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES x areas at most, some megabytes

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        w, f = m.weights(), Features()
        for b in it:
            keys, rows, doc = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key is None or not text or not text.strip():
                    continue
                keys.append(key)
                for s in sentences(consistent(text)):
                    x = f.of(to_latin(s))
                    if len(x) > 2:
                        rows.append(x)
                        doc.append(len(keys) - 1)
            own = shares(w, *matrix(rows), np.array(doc, dtype=np.int64), len(keys)) if rows else np.zeros((len(keys), len(m.areas)))
            i, c = np.nonzero(own >= np.maximum(m.share, 1e-9)[None, :])
            yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x in i], pa.int64()), pa.array([m.areas[x] for x in c], pa.string()), pa.array(own[i, c], pa.float64())], ["doc_id", "subject", "share"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", *_META)
    return subject_shares(docs, train(docs, read(spark, d, "subject_labels", "doc_id", "subject"), read(spark, d, "subjects", "subject")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "subject").distinct()


def p10_mix(spark: SparkSession, d: str) -> DataFrame:
    """Of each subject: documents about it and their share of all non-blank documents."""
    n = read(spark, d, "documents", "text").filter("trim(text) <> ''").agg(F.count("*").alias("n"))
    by = _scored(spark, d).groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"))
    return by.crossJoin(F.broadcast(n)).select("subject", "documents", F.round(F.col("documents") / F.col("n"), 6).alias("share"))  # n is one row


QUERIES = {"p10_found": p10_found, "p10_mix": p10_mix}
SQL: dict[str, str] = {}
