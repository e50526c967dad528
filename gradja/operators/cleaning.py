"""Repairs of fields and cleaning of sentence lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradja.functions import text as X


def repair_merged(df: DataFrame, first: str, second: str) -> DataFrame:
    """Part a field that holds two values since a tab was lost; rows that aren't merged stay as they are."""
    both = F.trim(first).contains(" ")
    parts = F.split(F.trim(first), " ")
    return df.withColumn(second, F.when(both, F.get(parts, F.lit(1))).otherwise(F.col(second))).withColumn(first, F.when(both, F.get(parts, F.lit(0))).otherwise(F.col(first)))


def in_domain(df: DataFrame, column: str, values: list[str], strict: bool = False) -> DataFrame:
    """Rows whose column has one of the values; strict: fail on the first that hasn't."""
    ok = F.col(column).isin(*values)
    if strict:
        return df.filter(F.when(ok, True).otherwise(F.assert_true(ok, F.concat(F.lit(f"{column}: "), F.coalesce(column, F.lit("null")))).isNull()))
    return df.filter(ok)


def cut_at_first(df: DataFrame, group: str, idx: str, size: str, hit: Column) -> DataFrame:
    """Rows before the first hit in the second half of their group; groups without one stay whole.

    One partial aggregation by group and a join.
    """
    first = df.groupBy(group).agg(F.min(F.when(hit & (F.col(idx) >= F.floor(F.col(size) / 2)), F.col(idx))).alias("_cut"))
    return df.join(first, group).filter(F.col("_cut").isNull() | (F.col(idx) < F.col("_cut"))).drop("_cut")


def block_list(df: DataFrame, group: str, text: str, groups: int = 3, letters: int = 30) -> DataFrame:
    """(_hash) of the texts of so many characters that stand in so many groups; the texts themselves don't move."""
    long = df.filter(F.length(text) >= letters).select(group, F.md5(text).alias("_hash")).distinct()
    return long.groupBy("_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") >= groups).select("_hash")


def clean_articles(df: DataFrame, group: str, idx: str, text: str) -> DataFrame:
    """The sentences of each article that belong to it, an orphaned quotation mark at their beginning cut away.

    The frame of the site (:func:`block_list` and CHROME) comes after the text: its first
    sentence in the second half ends the article. Frame sentences before that, embedded
    widgets and fragments fall out one by one, as do sentences of under 5 or over 50 words
    or without an end mark. Null texts fall out.
    """
    w = Window.partitionBy(group)
    rows = df.filter(F.col(text).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(idx)) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_hash", F.md5(text))
    rows = rows.join(block_list(df, group, text).withColumn("_listed", F.lit(True)), "_hash", "left")
    rows = rows.withColumn("_furniture", F.coalesce("_listed", F.lit(False)) | X.matches_any(text, X.CHROME))
    kept = cut_at_first(rows, group, "_i", "_n", F.col("_furniture")).filter("not _furniture")
    bare = F.regexp_replace(F.regexp_replace(text, "^[„“”\"' ]+", ""), " +$", "")
    kept = kept.withColumn(text, F.when(F.col(text).rlike("^\\s*[„“\"] "), bare).otherwise(F.col(text)))
    ok = ~X.matches_any(text, X.CHROME) & ~X.matches_any(text, X.EMBED) & ~X.is_fragment(text) & X.keeps(text)
    return kept.filter(ok).select(*df.columns)
