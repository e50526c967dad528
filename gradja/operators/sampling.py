"""Quotas, stratified and seeded sampling, windows and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *keys: str) -> Column:
    """The order that stands in for a seeded shuffle: the same on every run and every cluster."""
    return F.md5(F.concat(F.lit(f"{seed}:"), *(F.col(k).cast("string") for k in keys)))


def largest_remainder(cells: DataFrame, size: str, n: int, ties: Sequence[str]) -> DataFrame:
    """Add quota: floor of the share, one more for the largest fractions until n is reached. cells is a small table of counts."""
    every = Window.partitionBy(F.lit(1))
    # whole numbers: floor and remainder of size * n / total
    q = cells.withColumn("_t", F.sum(size).over(every)).withColumn("_b", F.expr(f"({size} * {n}) div _t")).withColumn("_m", F.expr(f"({size} * {n}) % _t"))
    left = F.lit(n) - F.sum("_b").over(every)
    rank = F.row_number().over(every.orderBy(F.desc("_m"), *ties))
    return q.withColumn("quota", F.col("_b") + (rank <= left).cast("long")).drop("_t", "_b", "_m")


def rounded_quota(cells: DataFrame, size: str, n: int) -> DataFrame:
    """Add quota: max(1, share of n rounded half to even)."""
    every = Window.partitionBy(F.lit(1))
    return cells.withColumn("quota", F.greatest(F.lit(1), F.bround(F.col(size) * F.lit(float(n)) / F.sum(size).over(every)).cast("long")))


def halves(k: int) -> tuple[int, int]:
    """k in two, the first the larger."""
    return k // 2 + k % 2, k // 2


def chunks_over_time(df: DataFrame, order: Sequence[str], group: Sequence[str], n: int, parts: int = 4, seed: int = 42, key: str = "article_id") -> DataFrame:
    """n rows a group, spread over its time: as even as can be from each of the equal chunks of the ordered rows."""
    w = Window.partitionBy(*group)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    r = r.withColumn("chunk", F.expr(f"(({parts} * _r + {parts - 1}) div _n)").cast("int"))
    take = n // parts + F.when(F.col("chunk") < n % parts, 1).otherwise(0)
    pick = F.row_number().over(Window.partitionBy(*group, "chunk").orderBy(seeded(seed, key), key))
    return r.withColumn("_p", pick).filter(F.col("_p") <= take).drop("_r", "_n", "_p")


def sample_few_per(df: DataFrame, article: str, cell: Sequence[str], key: str, per_article: int, quota: Column, seed: int) -> DataFrame:
    """Seeded sample of each cell with at most so many rows an article.

    Cells are made of attributes of the article, so the first rows of each article by
    hash, and then of each cell, are what drawing one after the other would give.
    """
    h = df.withColumn("_h", seeded(seed, key))
    h = h.withColumn("_a", F.row_number().over(Window.partitionBy(article).orderBy("_h", key))).filter(F.col("_a") <= per_article)
    return h.withColumn("_c", F.row_number().over(Window.partitionBy(*cell).orderBy("_h", key))).filter(F.col("_c") <= quota).drop("_h", "_a", "_c")


def start_of(url: str, seed: int, room: Column) -> Column:
    """A start between 0 and room - 1 from the address alone: its hash with the seed."""
    h = F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long")
    return F.pmod(h.bitwiseXOR(F.lit(seed).cast("long")), F.greatest(room, F.lit(1)))


def window_of(sentences: Column, start: Column, size: int = 8) -> Column:
    """Up to size consecutive sentences from start (0-based)."""
    return F.slice(sentences, (start + 1).cast("int"), size)


def glue_attributions(df: DataFrame, group: str, idx: str, text: str, attribution: Column) -> DataFrame:
    """(group, unit, text): rows that are an attribution joined to the row before."""
    w = Window.partitionBy(group).orderBy(idx)
    first = F.row_number().over(w) == 1
    unit = F.sum(F.when(~attribution | first, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    parts = df.withColumn("_first", first).withColumn("unit", unit).groupBy(group, "unit").agg(F.sort_array(F.collect_list(F.struct(idx, text))).alias("_p"))
    return parts.select(group, "unit", F.array_join(F.transform("_p", lambda x: x[text]), " ").alias("text"))


def batches(df: DataFrame, order: Sequence[str], size: int, within: Sequence[str] = ()) -> DataFrame:
    """Add batch: consecutive rows in packs of size, by `within`; without it, ranks come from sorted partitions and their offsets, not from one task."""
    if within:
        w = Window.partitionBy(*within).orderBy(*order)
        return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).persist()  # rows and offsets must come of the same ranges
    inner = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return inner.join(F.broadcast(offsets.select("_p", "_o")), "_p").withColumn("batch", F.floor((F.col("_o") + F.col("_r") - 1) / size).cast("long")).drop("_p", "_r", "_o")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence, k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
