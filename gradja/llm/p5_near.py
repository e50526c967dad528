"""Problem 5: rows that repeat another row's text with small edits.

HyperMinHash over the whole set of a row's words. Each of REGISTERS buckets keeps,
of the smallest hash of the words under its own hash function, the leading zeros (4
bits) and the MANTISSA bits that follow: one byte. Bands of BAND neighbouring
registers are the keys under which classes meet. In a bucket two classes are
compared by size and by a parity sketch of 64 bits, which differs in no more bits
than the sets differ in words: both are bounds, so nothing similar is lost there.
What meets is estimated from all registers, corrected for the collisions that
registers of such sizes have by chance; only what the estimate lets through is
verified on the sets of words.

A pair of similarity s meets with probability 1 - (1 - s^4)^16: 0.988 at 0.7, 0.9998
at 0.8; the estimate lies at most SPREAD standard deviations below. No bucket is
capped: one of more than HOT classes is cut into chunks that meet pairwise, each
pair a group of its own, so no task holds more than two chunks of it.

Rows whose words are the same set form one class; classes are compared, never
copies. Of a class of more than WHOLE rows the first stands for the others and is
paired with each of them; smaller classes are written out in full.

Defined cases: null texts, rows with under MIN_WORDS distinct words and rows
mainly in other scripts have no pairs; rows delivered again count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradja.llm.arrow import read, written
from gradja.llm.lines import Words, _TOKEN, cut_table
from gradja.llm.p1_furniture import corpus_cut, page_furniture
from gradja.llm.p3_repeated import bounded, repeated_lines
from gradja.llm.registers import REGISTERS, as_column, estimate, rows_of, shared_words, signatures
from gradja.llm.textform import plain

SIMILAR = 0.7
#: Registers of a band.
BAND = 4
BANDS = REGISTERS // BAND
#: Standard deviations that the estimate may lie below the threshold.
SPREAD = 4.0
#: Classes of one bucket that are compared in one task with those of another chunk. A bucket is cut if it holds more
#: than CHUNK classes and more than SHARE of all postings of a band, so the table of such buckets has at most BANDS / SHARE rows.
CHUNK, SHARE = 16_384, 1e-4
WHOLE = 50
#: Groups of postings up to this size are compared by shifting the whole batch, larger ones by blocks.
NARROW = 512
#: Pairs of sketches that are compared at once, and classes whose postings are packed at once.
AT_ONCE, PACKED = 4_000_000, 32_768

#: A blob is its number of postings, then their fields one after the other by byte, compressed.
_CODEC = pa.Codec("zstd", compression_level=1)
_POSTING = np.dtype([("key", "<u4"), ("cls", "<i8"), ("sketch", "<u8"), ("n", "<u2"), ("side", "u1")])


def word_set(text: str | None) -> list[int] | None:
    """Sorted 31-bit hashes of the distinct words in plain form; None if the row is no case."""
    return Words().of(_TOKEN.findall(plain(text))) if text else None


def near_rows(cut: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (sid, cls) of the rows that may have pairs, and (cls, words, n, rows, rep), words as bytes and rep the first of its rows; rows in skipped (sid) are left out.

    cut: the lines of :func:`gradja.llm.lines.cut_table`, with words.
    """
    rows = cut.filter("cls is not null")
    delivered = rows.select("sid", "cls", F.lit(0).alias("out")).union(skipped.select("sid", F.lit(None).cast("long"), F.lit(1)))
    members = written(delivered.groupBy("sid").agg(F.max("cls").alias("cls"), F.max("out").alias("out")).filter("out = 0").select("sid", "cls"))
    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: later joins find the classes in place
    held = members.groupBy("cls").agg(F.count("*").alias("rows"), F.min("sid").alias("rep"))
    classes = rows.select("cls", "words").repartition(n, "cls").groupBy("cls").agg(F.first("words").alias("words")).join(held, "cls")
    return members, classes.select("cls", "words", (F.length("words") / 4).cast("int").alias("n"), "rows", "rep").persist()


def signed(classes: DataFrame) -> DataFrame:
    """(cls, n, sig) of the classes, kept for the two passes over it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_column(signatures(b.column(2)))], ["cls", "n", "sig"])

    return classes.select("cls", "n", "words").mapInArrow(run, "cls long, n int, sig binary").persist()


def _keys(sig: np.ndarray) -> np.ndarray:
    """The key of each band: its registers as one number."""
    return np.ascontiguousarray(sig[:, :REGISTERS]).view("<u4")


def hot_buckets(sigs: DataFrame, chunk: int = CHUNK, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, chunks) of the buckets to be cut, sorted; a bucket is its band and key.

    Tasks report the keys they meet often, at the least a bucket's CHUNK divided by twice
    their number, so no bucket of that size is missed and few small ones are told.
    """
    n = sigs.count()
    large = max(chunk, int(share * n))
    often = max(2, large // (2 * max(1, sigs.rdd.getNumPartitions())))

    def tally(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [_keys(rows_of(b.column(0))) for b in it if b.num_rows]
        for band in range(BANDS if rows else 0):
            key, count = np.unique(np.concatenate([r[:, band] for r in rows]), return_counts=True)
            key, count = key[count >= often], count[count >= often]
            yield pa.RecordBatch.from_arrays([pa.array((key.astype(np.int64) << 4) | band), pa.array(count)], ["bucket", "n"])

    met = sigs.select("sig").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > large // 2)
    t = met.toArrow().sort_by("bucket")
    return t["bucket"].to_numpy(), np.maximum(2, -(-t["n"].to_numpy() // chunk))


def pack(rows: np.ndarray) -> bytes:
    """Postings as a blob: sorted by key, keys as differences, all bytes of one place together."""
    rows = rows[np.argsort(rows["key"])]
    rows["key"] = np.diff(rows["key"], prepend=np.uint32(0))
    planes = np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T)
    return len(rows).to_bytes(4, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(_CODEC.decompress(blob[4:], n * _POSTING.itemsize, asbytes=True), np.uint8)
    rows = planes.reshape(-1, n).T.copy().view(_POSTING)[:, 0]
    rows["key"] = np.cumsum(rows["key"], dtype=np.uint32)
    return rows


def postings(classes: DataFrame, parts: int, chunk: int = CHUNK) -> DataFrame:
    """(part, grp, blob): the postings of all bands, packed by the partition in which they meet; grp is 0, or one pair of chunks of a hot bucket."""
    sigs = signed(classes)
    hot, chunks = hot_buckets(sigs, chunk)
    per = -(-parts // BANDS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in it:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), rows_of(b.column(2))))
                size += b.num_rows
            if size >= PACKED:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        cls, n, sig = (np.concatenate(x) for x in zip(*held))
        keys, sketch = _keys(sig), np.ascontiguousarray(sig[:, REGISTERS:]).view("<u8")[:, 0]
        part, grp, blob = [], [], []
        for band in range(BANDS):
            rows = np.zeros(len(cls), _POSTING)
            rows["key"], rows["cls"], rows["sketch"], rows["n"] = keys[:, band], cls, sketch, np.minimum(n, 0xFFFF)
            if len(hot):
                bucket = (keys[:, band].astype(np.int64) << 4) | band
                at = np.searchsorted(hot, bucket).clip(0, len(hot) - 1)
                is_hot = hot[at] == bucket
                for h in np.unique(at[is_hot]):
                    mine, k = rows[is_hot & (at == h)], int(chunks[h])
                    own = (mine["cls"].view("<u8") % np.uint64(k)).astype(np.int64)
                    for x in range(k):
                        for y in range(k):
                            pair = mine[own == x]
                            if len(pair):
                                pair["side"] = x > y
                                name = 1 + int(h) * (1 << 24) + min(x, y) * k + max(x, y)
                                part.append(name % (per * BANDS)), grp.append(name), blob.append(pack(pair))
                rows = rows[~is_hot]
            to = (rows["key"].astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(per)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(per + 1))
            for i in range(per):
                if ends[i] < ends[i + 1]:
                    part.append(band * per + i), grp.append(0), blob.append(pack(rows[order[ends[i] : ends[i + 1]]]))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(grp, pa.int64()), pa.array(blob, pa.binary())], ["part", "grp", "blob"])

    return sigs.mapInArrow(run, "part int, grp long, blob binary").repartitionById(per * BANDS, "part")


def _fits(na: np.ndarray | int, nb: np.ndarray | int, a: np.ndarray, b: np.ndarray, s: int) -> np.ndarray:
    """Whether sets of na and nb words with these sketches may share s thousandths: by the words they must share, the rest may differ."""
    least = (s * (na + nb) + 999 + s) // (1000 + s)
    return np.bitwise_count(a ^ b) <= na + nb - 2 * least


def meeting(rows: np.ndarray, s: int, across: bool = False, narrow: int = NARROW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the postings, sorted by (key, n), of one bucket that may belong to similar sets; across: only of different sides."""
    key, n, sketch, side = rows["key"].astype(np.int64), rows["n"].astype(np.int64), rows["sketch"].copy(), rows["side"]
    bounds = np.flatnonzero(np.diff(key, prepend=key[:1] - 1, append=key[-1:] + 1))
    lo, hi = bounds[:-1], bounds[1:]
    size = hi - lo
    end = np.repeat(hi, size)
    a, d = np.flatnonzero(np.repeat(size <= narrow, size)), 0
    while len(a):
        d += 1
        a = a[a + d < end[a]]
        a = a[n[a + d] * s <= n[a] * 1000]  # sizes only grow from here on
        b = a + d
        ok = _fits(n[a], n[b], sketch[a], sketch[b], s) & (side[a] != side[b] if across else True)
        yield a[ok], b[ok]
    for g0, g1 in zip(lo[size > narrow].tolist(), hi[size > narrow].tolist()):
        sizes, first = np.unique(n[g0:g1], return_index=True)
        ends, sizes = np.append(first, g1 - g0) + g0, sizes.tolist()
        for x, na in enumerate(sizes):
            for y in range(x, len(sizes)):
                nb = sizes[y]
                if nb * s > na * 1000:
                    break
                a0, a1, b0, b1 = int(ends[x]), int(ends[x + 1]), int(ends[y]), int(ends[y + 1])
                step = max(1, AT_ONCE // max(1, b1 - b0))
                for c in range(a0, a1, step):
                    i, j = np.nonzero(_fits(na, nb, sketch[c : min(a1, c + step), None], sketch[None, b0:b1], s))
                    i, j = i + c, j + b0
                    ok = ((i < j) | (x != y)) & (side[i] != side[j] if across else True)
                    yield i[ok], j[ok]


def candidates(classes: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """(a, b), a < b, each once: every two classes that share a band and may be similar by size and sketch."""
    s = round(similar * 1000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in it:
            for grp, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(grp, []).append(unpack(blob))
        while held:
            grp, blobs = held.popitem()
            rows = np.concatenate(blobs)
            rows = rows[np.lexsort((rows["n"], rows["key"]))]
            cls, found, size = rows["cls"].copy(), [], 0
            for i, j in meeting(rows, s, bool(grp) and bool(rows["side"].any())):
                x, y = cls[i], cls[j]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
                size += len(i)
                if size >= AT_ONCE // 4:
                    yield told(found)
                    found, size = [], 0
            if size:
                yield told(found)

    def told(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings(classes, parts, chunk).select("grp", "blob").mapInArrow(run, "a long, b long").distinct()


def similar_classes(classes: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """(a, b) of the classes whose sets of words are at least so similar, a < b."""
    lowest = similar - SPREAD * (similar * (1 - similar) / REGISTERS) ** 0.5

    @F.arrow_udf("boolean")
    def verified(wa: pa.Array, wb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        size = na.to_numpy() + nb.to_numpy()
        ok = estimate(signatures(wa)[:, :REGISTERS], signatures(wb)[:, :REGISTERS], na.to_numpy(), nb.to_numpy()) >= lowest
        both = shared_words(wa.filter(pa.array(ok)), wb.filter(pa.array(ok)))  # only what the estimate lets through
        ok[ok] = both * 1000 >= (size[ok] - both) * int(round(similar * 1000))  # in whole numbers: shared / union >= similar
        return pa.array(ok)

    side = lambda x: classes.select(F.col("cls").alias(x), F.col("words").alias(f"w_{x}"), F.col("n").alias(f"n_{x}"))
    met = candidates(classes, similar, chunk).join(side("a"), "a").join(side("b"), "b")
    return met.filter(verified("w_a", "w_b", "n_a", "n_b")).select("a", "b")


def near_pairs(members: DataFrame, classes: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(sentence_id_a, sentence_id_b) of similar rows, a < b, classes written out as the module says."""
    links = written(similar_classes(classes, similar))
    size = classes.select("cls", F.col("rows").alias("n"), "rep")
    needed = links.select(F.col("a").alias("cls")).union(links.select("b")).union(size.filter("n > 1").select("cls")).distinct()
    several, few = bounded(size.join(needed, "cls", "left_semi"))
    sized = members.join(F.broadcast(several) if few else several, "cls").persist()
    shown = sized.filter((F.col("n") <= WHOLE) | (F.col("sid") == F.col("rep"))).select("cls", "sid")
    across = links.join(shown.select(F.col("cls").alias("a"), F.col("sid").alias("x")), "a").join(shown.select(F.col("cls").alias("b"), F.col("sid").alias("y")), "b").select("x", "y")
    small = sized.filter((F.col("n") > 1) & (F.col("n") <= WHOLE)).select("cls", "sid")
    within = small.select("cls", F.col("sid").alias("x")).join(small.select("cls", F.col("sid").alias("y")), "cls").filter("x < y").select("x", "y")
    star = sized.filter((F.col("n") > WHOLE) & (F.col("sid") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("sid").alias("y"))
    pairs = across.union(within).union(star)
    return pairs.select(F.least("x", "y").alias("sentence_id_a"), F.greatest("x", "y").alias("sentence_id_b"))


def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cut = corpus_cut(spark, d, keys=True, words=True).persist()
    return near_rows(cut, page_furniture(spark, d, cut).select("sid").union(repeated_lines(cut).select("sid")))


def near_rows_of(corpus: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for any table with sentence_id, url, genre, source and text."""
    return near_rows(cut_table(corpus, words=True), skipped)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(*_rows(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every row that has a similar one: its group (the smallest sentence_id of all it is linked to, through others too) and its number of links."""
    from gradja.llm.p6_splits import components

    members, classes = _rows(spark, d)
    size = classes.select("cls", F.col("rows").alias("n"), "rep")
    links = written(similar_classes(classes))
    ends = links.union(links.select("b", "a")).toDF("cls", "to")
    far = ends.join(size.select(F.col("cls").alias("to"), F.col("n").alias("m")), "to").groupBy("cls").agg(F.sum("m").alias("outside"))
    named = size.join(far, "cls", "left").join(components(links).select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = named.groupBy("root").agg(F.min("rep").alias("group_id"))
    full = named.join(first, "root").withColumn("n_links", F.col("n") - 1 + F.coalesce("outside", F.lit(0))).filter("n_links > 0")
    return members.join(full.select("cls", "group_id", "n_links"), "cls").select(F.col("sid").alias("sentence_id"), "group_id", "n_links")


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
SQL: dict[str, str] = {}
