"""Pairs of rows that are alike by character 4-grams, without a shuffled row for every gram.

A row's vector is made from its text wherever it is needed; only the few rarest grams of
each row cross a shuffle, with a sketch by which nearly all pairs that they bring together
are ruled out at once. What is left is scored on whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradja.operators import features as V
from gradja.session import shared_path

#: Most grams whose counts travel with the tasks, 12 bytes each; of more, every gram joins its count by shuffle.
MOST_GRAMS = 2_000_000
#: Letters that are taken at a time, buckets of a sketch and bits of each, and rows of a gram compared at a time.
PIECE, BUCKETS, BITS, BLOCK = 400_000, 128, 5, 2048
WIDTH = BUCKETS * BITS // 8
#: By how much bounds are relaxed, more than rounding takes.
SLACK = 1e-4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def keys(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit key of every gram: four letters inside words padded by one space, or a padded word of three whole."""
    c = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    space = (c == 32) | ((c >= 9) & (c <= 13))
    c = np.append(np.where(space, 32, c), 0).astype(np.uint64)
    inner = ~space[1:-1]
    whole = space[:-2] & inner & space[2:]
    taken = np.flatnonzero(inner & ~space[2:] | whole)
    last = np.where(whole[taken], np.uint64(0), c[taken + 3])
    return row[taken], ((c[taken] * _ODD + c[taken + 1]) * _ODD + c[taken + 2]) * _ODD + last


def _pieces(texts: Sequence[str]) -> Iterator[slice]:
    """Runs of texts of some PIECE letters; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + 2
    if len(texts) > start:
        yield slice(start, len(texts))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(0).to_pylist()
        for piece in _pieces(texts):
            row, key = keys(texts[piece])
            term, at = np.unique(key, return_inverse=True)
            rows = len(texts[piece])
            once = np.unique(at * rows + row)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.bincount(once // rows, minlength=len(term)))], ["term", "df"])


class Vocabulary:
    """Grams of two rows or more, with the order from rare to common and the weight of one occurrence."""

    def __init__(self, term: np.ndarray, df: np.ndarray, n: int):
        order = np.lexsort((term, df))
        by_key = np.argsort(term[order])
        self.by_rank, self.idf = term[order], np.log((1 + n) / (1 + df[order])) + 1
        self.keys, self.rank = self.by_rank[by_key], by_key

    def vectors(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, rank, weight) of unit vectors, rows in order and grams from rare to common."""
        row, key = keys(texts)
        if not len(self.keys):
            return row[:0], row[:0], np.zeros(0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        cell, tf = np.unique(row[known] * len(self.keys) + self.rank[at[known]], return_counts=True)
        row, rank = cell // len(self.keys), cell % len(self.keys)
        raw = tf * self.idf[rank]
        return row, rank, raw / np.sqrt(np.bincount(row, raw * raw, minlength=len(texts)))[row]


def _sketch(row: np.ndarray, key: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scale and packed sketch of each row: the lengths of its parts by bucket of the grams, rounded up to a step of the longest."""
    cell = row * BUCKETS + ((key * _ODD) >> np.uint64(32)).astype(np.int64) % BUCKETS
    parts = np.sqrt(np.bincount(cell, w * w, minlength=n * BUCKETS)).reshape(n, BUCKETS)
    scale = np.maximum(parts.max(axis=1), 1e-9)
    steps = np.ceil(parts / scale[:, None] * (2**BITS - 1)).astype(np.uint8)
    return scale.astype(np.float32), np.packbits(np.unpackbits(steps[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(n, -1), axis=1)


def _dense(scale: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Sketches as rows of numbers; by Cauchy's inequality products are at least those of the vectors."""
    bits = np.unpackbits(raw, axis=1).reshape(len(raw), BUCKETS, BITS).astype(np.float32)
    return (bits @ (2.0 ** np.arange(BITS - 1, -1, -1)).astype(np.float32)) * (scale / (2**BITS - 1))[:, None]


def _heads(vocabulary, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            docs, texts = b.column(0), b.column(1).to_pylist()
            for piece in _pieces(texts):
                row, rank, w = v.vectors(texts[piece])
                n = len(texts[piece])
                start = np.searchsorted(row, np.arange(n + 1))
                upto = np.append(0, np.cumsum(w * w))
                left = 1 - (upto[:-1] - upto[start[row]])  # of the vector's square from this gram on
                head = np.flatnonzero(left >= least * least - SLACK)
                scale, sketch = _sketch(row, v.by_rank[rank], w, n)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(head), [None, pa.py_buffer(sketch[row[head]])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v.by_rank[rank[head]].view(np.int64)), docs.take(pa.array(row[head] + piece.start)), pa.array(left[head].astype(np.float32)), pa.array(scale[row[head]]), raw],
                    ["term", "doc", "left", "scale", "sketch"],
                )

    return run


def _meet(least: float):
    """Pairs of rows that hold a head gram in common and may reach `least`, from heads sorted by gram."""

    def group(left, scale, raw) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(-left, kind="stable")
        left = left[order]
        rows = lambda i: _dense(scale[order[i : i + BLOCK]], raw[order[i : i + BLOCK]])
        # at the first gram in common the product of what is left of both squares is at least that of `least`, so one of them is `least` itself
        for i in range(0, int((left >= least - SLACK).sum()), BLOCK):
            a, la = rows(i), left[i : i + BLOCK]
            for j in range(i, len(left), BLOCK):
                lb = left[j : j + BLOCK]
                if la[0] * lb[0] < least * least - SLACK:
                    break
                x, y = np.nonzero(a[la >= least - SLACK] @ (a if i == j else rows(j)).T >= least - SLACK)
                ok = (x + i < y + j) & (la[x] * lb[y] >= least * least - SLACK)
                yield order[x[ok] + i], order[y[ok] + j]

    def pairs(term, doc, left, scale, raw) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        end = np.append(begin[1:], len(term))
        more = np.flatnonzero(end - begin > 1)
        for s, e in zip(begin[more].tolist(), end[more].tolist()):
            for x, y in group(left[s:e], scale[s:e], raw[s:e]):
                if len(x):
                    p, q = doc.take(pa.array(x + s)).to_pylist(), doc.take(pa.array(y + s)).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array(list(map(min, p, q)), pa.string()), pa.array(list(map(max, p, q)), pa.string())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # rows of the last gram, which may go on in the next batch

        def joined(parts: list) -> tuple:
            term, left, scale, raw = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
            return term, pa.concat_arrays([p[1] for p in parts]), left, scale, raw

        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, WIDTH)
            part = (b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy(), b.column(3).to_numpy(), raw)
            cut = int(np.searchsorted(part[0], part[0][-1]))
            if cut or held and held[-1][0][-1] != part[0][0]:
                yield from pairs(*joined([*held, tuple(x[:cut] for x in part)]))
                held = []
            held.append(tuple(x[cut:] for x in part))
        if held:
            yield from pairs(*joined(held))

    return run


def _score(vocabulary, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            both = [t for pair in zip(b.column(2).to_pylist(), b.column(3).to_pylist()) for t in pair]
            cos = np.zeros(b.num_rows)
            for piece in _pieces(both):
                piece = slice(piece.start // 2 * 2, (piece.stop + 1) // 2 * 2)  # a pair on an edge is scored twice, whole both times
                row, rank, w = v.vectors(both[piece])
                cell = row // 2 * max(1, len(v.keys)) + rank
                order = np.argsort(cell, kind="stable")
                same = np.flatnonzero(cell[order][1:] == cell[order][:-1])
                first, second = order[same], order[same + 1]
                n = (piece.stop - piece.start) // 2
                cos[piece.start // 2 : piece.stop // 2] = np.bincount(row[first] // 2, w[first] * w[second], minlength=n)
            hit = pa.array(cos >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit), b.column(1).filter(hit), pa.array(cos).filter(hit)], ["a", "b", "cos"])

    return run


def near_pairs(df: DataFrame, doc: str, text: str, least: float = 0.9) -> DataFrame:
    """(a, b, cos), a < b, of the rows whose TF-IDF vectors of character 4-grams have a cosine of at least `least`; doc is a unique string.

    Exact by prefix filtering as :func:`features.similar_pairs`; a pair must besides reach
    `least` by the bound of their sketches: the grams of a whole vector fall into buckets,
    and within a bucket no product is larger than that of the lengths. Grams are known by
    64-bit hashes.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.select(F.col(doc).alias("doc"), F.lower(text).alias("text")).filter(r"text rlike '\\S'").write.parquet(path)
    rows = spark.read.schema("doc string, text string").parquet(path)
    counts = rows.select("text").mapInArrow(_document_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).filter("df >= 2")
    few = counts.limit(MOST_GRAMS + 1).toArrow()
    if few.num_rows > MOST_GRAMS:
        return V.similar_pairs(V.weights(V.char_grams(rows, "doc", "text"), "doc"), "doc", least)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(few["term"].to_numpy().view(np.uint64), few["df"].to_numpy(), rows.count()))
    heads = rows.mapInArrow(_heads(vocabulary, least), "term long, doc string, left float, scale float, sketch binary")
    meet = heads.repartition("term").sortWithinPartitions("term").mapInArrow(_meet(least), "a string, b string").distinct()
    side = lambda x: rows.select(F.col("doc").alias(x), F.col("text").alias(f"text_{x}"))
    found = meet.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return found.mapInArrow(_score(vocabulary, least), "a string, b string, cos double")
