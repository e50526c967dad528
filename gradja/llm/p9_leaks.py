"""Problem 9: test items that stand in training documents, wholly or in part.

A document holds a part of an item if WORDS consecutive words stand in both. The
MinHash sketch of a text is taken window by window: of the hashes of every SHINGLE
consecutive words, the smallest of each WORDS - SHINGLE + 1 neighbours is kept, which
are the shingles of WORDS words. A passage of WORDS words that two texts share is
such a window in both, so both sketches hold its smallest hash and the search misses
nothing, although it looks up two shingles of five only. Items are divided by size,
into classes of twice as many shingles each, with one table of sketches a class;
every hit is verified exactly, by how far the words agree on either side of it.

Up to ITEM_WORDS words of items travel in the task closure, and the documents are
read once without a shuffle. More items than that are joined by shuffle on the sketch
hashes, each with the words around it, which are all that the verification needs.

Defined cases: null and blank texts and items of under eight words match
nothing; an item that stands in a document twice gives one row; items given
again count once, and of one item_id with several texts each text counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradja.llm.arrow import h64, map_batches, read
from gradja.llm.textform import plain, to_latin

#: Consecutive words that make a leak, words of a hashed shingle, and shingles of a window.
WORDS, SHINGLE = 8, 5
WINDOW = WORDS - SHINGLE + 1
#: Words of all items together up to which they travel with the tasks.
ITEM_WORDS = 500_000
#: Words on either side of a shingle that a passage of WORDS words can reach.
_REACH = WORDS - SHINGLE

_FOLD = str.maketrans({"č": "c", "ć": "c", "š": "s", "ž": "z"})
_TOKEN = re.compile(r"[^\W_]+")
#: What is skipped inside words: invisible characters, and accents that are no part of a letter (as on ц́).
_ODD = re.compile("[­͏؜​-‏‪-‮⁠-⁯︀-️﻿̀-ͯ]")


def words(text: str | None) -> list[str]:
    """The words that are compared: Latin spelling, no case, no accents but for đ, invisible characters skipped."""
    return _TOKEN.findall(to_latin(_ODD.sub("", plain(text))).translate(_FOLD)) if text else []


def shingle_hashes(row: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every n consecutive word ids."""
    m = len(row) - n + 1
    h = np.zeros(max(m, 0), dtype=np.uint64)
    for j in range(n):
        h = (h ^ row[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def sketch(h: np.ndarray, windows: np.ndarray | None = None) -> np.ndarray:
    """Positions of the shingles that are the smallest of a window, the first of equals; windows: those that count."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    at = np.arange(n) if windows is None else windows
    least = np.argmin(np.stack([h[at + j] for j in range(WINDOW)]), axis=0)
    return np.unique(at + least)


def agree(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the words of a and b agree on the shingles at p and q and so far around them that they share WORDS words; ids of 0 agree with none."""

    def run(steps: range) -> np.ndarray:
        on, n = np.ones(len(p), dtype=bool), np.zeros(len(p), dtype=np.int64)
        for d in steps:
            x, y = p + d, q + d
            inside = (x >= 0) & (x < len(a)) & (y >= 0) & (y < len(b))
            w = a[np.where(inside, x, 0)]
            on &= inside & (w == b[np.where(inside, y, 0)]) & (w != 0)
            n += on
        return n

    return (run(range(SHINGLE)) == SHINGLE) & (run(range(-1, -_REACH - 1, -1)) + run(range(SHINGLE, SHINGLE + _REACH)) >= _REACH)


class Index:
    """Sketches of items by size class, over the ids of the words that items have."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        by_class: dict[int, list[tuple[int, list[int]]]] = {}
        for item, text in items:
            w = words(text)
            if len(w) >= WORDS:
                by_class.setdefault((len(w) - SHINGLE + 1).bit_length(), []).append((item, [self.ids.setdefault(x, len(self.ids) + 1) for x in w]))
        self.classes = []
        for members in by_class.values():
            row = np.array([x for _, w in members for x in [*w, *[0] * WORDS]], dtype=np.uint64)
            owner = np.repeat([item for item, _ in members], [len(w) + WORDS for _, w in members])
            h = shingle_hashes(row)
            at = sketch(h, windows_of(row))
            at = at[np.argsort(h[at], kind="stable")]
            self.classes.append((h[at], at, row, owner))

    def matches(self, docs: list[list[str]]) -> list[tuple[int, int]]:
        """(position of the document, item) of every document that holds a part of an item."""
        get, gap, flat, starts = self.ids.get, [0] * WORDS, [], []
        for w in docs:
            starts.append(len(flat))
            flat += [get(x, 0) for x in w]
            flat += gap
        row = np.array(flat, dtype=np.uint64)
        windows = windows_of(row)
        if not len(windows):
            return []
        h = shingle_hashes(row)
        at = sketch(h, windows)
        begins, found = np.array(starts), set()
        for keys, places, items, owner in self.classes:
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            n = hi - lo
            p = np.repeat(at, n)
            q = places[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            ok = agree(row, p, items, q)
            doc = np.searchsorted(begins, p[ok], "right") - 1
            found |= set(zip(doc.tolist(), owner[q[ok]].tolist()))
        return sorted(found)


def windows_of(row: np.ndarray) -> np.ndarray:
    """Where WORDS consecutive words with an id begin."""
    if len(row) < WORDS:
        return np.empty(0, dtype=np.int64)
    known = np.cumsum(np.concatenate([[0], row > 0]))
    return np.flatnonzero(known[WORDS:] - known[:-WORDS] == WORDS)


def sketched(texts: DataFrame, key: str) -> DataFrame:
    """(h, key, size, around): the sketch of every text, each hash with the hashed words around it (0 beyond the text's ends) and the text's size class."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, sizes, hashes, around = [], [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text)
                if len(w) < WORDS:
                    continue
                row = np.array([h64(x) or 1 for x in w], dtype=np.int64).view(np.uint64)
                h = shingle_hashes(row)
                at = sketch(h)
                padded = np.concatenate([np.zeros(_REACH, np.uint64), row, np.zeros(_REACH, np.uint64)])
                around.append(padded[at[:, None] + np.arange(WORDS + _REACH)[None]].view(np.int64))
                hashes.append(h[at].view(np.int64))
                keys += [k] * len(at)
                sizes += [len(h).bit_length()] * len(at)
            flat = np.concatenate(around).ravel() if around else np.empty(0, np.int64)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * (WORDS + _REACH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes) if hashes else [], pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))], ["h", key, "size", "around"]
            )

    return texts.mapInArrow(run, f"h long, {key} long, size int, around array<long>")


def joined(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same search by shuffle, for items of any number: sketches meet on their hash and are verified by the words around it."""
    met = sketched(items, "item_id").join(sketched(documents, "doc_id").select("h", "doc_id", F.col("around").alias("there")), "h")
    # how far two texts agree: from the shingle leftwards and rightwards
    same = lambda i: (F.col("around")[i] == F.col("there")[i]) & (F.col("around")[i] != 0)

    def run(places: range) -> list:
        out, on = [], None
        for i in places:
            on = same(i) if on is None else on & same(i)
            out.append(on.cast("int"))
        return out

    left, right = run(range(_REACH - 1, -1, -1)), run(range(_REACH + SHINGLE, 2 * _REACH + SHINGLE))
    middle = [same(i) for i in range(_REACH, _REACH + SHINGLE)]
    reach = sum((x for x in [*left, *right]), F.lit(0))
    shingle = middle[0]
    for m in middle[1:]:
        shingle = shingle & m
    return met.filter(shingle & (reach >= _REACH)).select("doc_id", "item_id")


def leaks(documents: DataFrame, items: DataFrame, most: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id) of every document and item with WORDS consecutive words in common, each once; most: words of items that may travel with the tasks."""
    items = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    if size > most:
        return joined(docs, items).distinct()
    index = Index([(r.item_id, r.text) for r in items.collect()])  # at most `most` words

    def search(b):
        keys = b.column(0).to_pylist()
        hits = index.matches([words(t) for t in b.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in hits], pa.int64()), pa.array([x for _, x in hits], pa.int64())], ["doc_id", "item_id"])

    return map_batches(docs, search, "doc_id long, item_id long").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(read(spark, d, "documents", "doc_id", "text"), read(spark, d, "eval_items", "item_id", "text"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents it leaked into, 0 included."""
    found = p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    items = read(spark, d, "eval_items", "item_id", "kind").filter("item_id is not null")
    return items.join(found, "item_id", "left").select("item_id", "kind", F.coalesce("n", F.lit(0)).alias("n_documents"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL: dict[str, str] = {}
