"""Joins, set operations, deduplication and validation over corpus tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code): one row for each rule that a row breaks. A rule that comes out null is not broken."""
    codes = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(codes).alias("code"))


def repeated_keys(df: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """Keys with at least so many rows, and how many; used for duplicate ids, clashes and row limits."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def has_prefix_columns(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether the first columns are exactly these, in order; further columns are allowed."""
    return df.columns[: len(names)] == list(names)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key, the first in order."""
    return _nth(df, keys, order)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the last in order."""
    return _nth(df, keys, [F.desc_nulls_last(o) for o in order])


def _nth(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def exact_duplicates(df: DataFrame, key: str, norm: str) -> DataFrame:
    """(kept, dropped): of rows with the same normalised text the smallest key is kept; others are dropped beside it.

    One partial aggregation and one join; a text that fills the table is folded map-side.
    """
    first = df.groupBy(norm).agg(F.min(key).alias("kept"))
    return df.join(first, norm).filter(F.col(key) > F.col("kept")).select("kept", F.col(key).alias("dropped"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and those rows of new whose key old lacks: existing rows win."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def upsert_backfill(old: DataFrame, new: DataFrame, keys: Sequence[str], fill: str) -> DataFrame:
    """As upsert, but an empty or null `fill` of an existing row is taken from new."""
    n = new.select(*keys, F.col(fill).alias("_fill")).groupBy(*keys).agg(F.max("_fill").alias("_fill"))
    kept = old.join(n, list(keys), "left").withColumn(fill, F.coalesce(F.expr(f"nullif({fill}, '')"), "_fill")).drop("_fill")
    return upsert(kept, new, keys)


def first_document_only(df: DataFrame, sentence: str, doc: str) -> DataFrame:
    """Rows of the first document (smallest doc) that has their sentence; repeats inside it stay."""
    first = df.groupBy(sentence).agg(F.min(doc).alias("_first"))
    return df.join(first, sentence).filter(F.col(doc) == F.col("_first")).drop("_first")


def with_neighbours(df: DataFrame, group: str, idx: str, text: str) -> DataFrame:
    """Add before and after: the text of the row whose index is one less or more in its group, '' where there is none.

    Equi-joins on (group, index), so gaps give '' and no group is one task.
    """
    side = df.select(F.col(group).alias("_g"), F.col(idx).alias("_i"), F.col(text).alias("_t"))
    for name, step in (("before", 1), ("after", -1)):
        near = side.select(F.col("_g").alias(group), (F.col("_i") + step).alias(idx), F.col("_t").alias(name))
        df = df.join(near, [group, idx], "left").withColumn(name, F.coalesce(name, F.lit("")))
    return df


def union_members(members: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tables with the member they come from; columns one lacks are null, in order of first sight."""
    out = None
    for name, df in members.items():
        df = df.withColumn("member", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only the left ('missing') or only the right ('excess') table has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("excess")))


def aligned(df: DataFrame, item: str, rater: str, label: str, raters: Sequence[str]) -> DataFrame:
    """One row an item that all raters labelled, a column for each rater."""
    wide = df.groupBy(item).pivot(rater, list(raters)).agg(F.max(label))
    return wide.filter(" and ".join(f"`{r}` is not null" for r in raters))


def equalize(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The first m rows of each group in order, m being the size of the smallest group."""
    least = df.groupBy(group).count().agg(F.min("count").alias("_least"))
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).crossJoin(F.broadcast(least)).filter("_r <= _least").drop("_r", "_least")  # least is one row


def resolve_labels(layers: Sequence[tuple[int, DataFrame]], key: str, label: str, order: str) -> DataFrame:
    """(key, label, prio): of all layers the label of the lowest priority number, in it the latest by order."""
    out = None
    for prio, df in layers:
        part = df.select(key, label, F.col(order).alias("_o"), F.lit(prio).alias("prio"))
        out = part if out is None else out.unionByName(part)
    pick = F.max_by(F.struct("prio", label), F.struct(-F.col("prio"), F.coalesce("_o", F.lit("1900-01-01").cast("timestamp")), label))
    return out.groupBy(key).agg(pick.alias("_p")).select(key, F.col(f"_p.{label}").alias(label), F.col("_p.prio").alias("prio"))


def contains_either_way(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of which one key contains the other: an inverted index, no cross join.

    The head of the shorter key, its first three characters or all if it has fewer, stands
    in the longer one, so joining heads on all pieces of one to three characters finds every
    pair. Null and empty keys are in no pair.
    """

    def pieces(df: DataFrame, c: str) -> DataFrame:
        of = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.col(c).substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return df.withColumn("g", F.explode(F.array_distinct(F.concat(of(1), of(2), of(3)))))

    heads = lambda df, c: df.withColumn("g", F.substring(c, 1, 3))
    l, r = left.select(a).filter(F.length(a) > 0).distinct(), right.select(b).filter(F.length(b) > 0).distinct()
    one = pieces(l, a).join(heads(r, b), "g").filter(F.col(a).contains(F.col(b)))
    two = heads(l, a).join(pieces(r, b), "g").filter(F.col(b).contains(F.col(a)))
    return one.select(a, b).union(two.select(a, b)).distinct()


def first_rows(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """The first n rows in a stated order, by partial top-n in each task; all of them if n is None."""
    return df if n is None else df.orderBy(*order).limit(n)


def no_clashes(df: DataFrame, key: str, value: str) -> DataFrame:
    """df, failing while it runs if a key stands for two values: ids of different things must differ."""
    w = df.groupBy(key).agg(F.min(value).alias("_least"), F.max(value).alias("_most"))
    ok = F.col("_least") == F.col("_most")
    checked = w.filter(F.when(ok, True).otherwise(F.assert_true(ok, F.concat(F.lit(f"{key} clashes: "), F.col(key).cast("string"))).isNull())).select(key)
    return df.join(checked, key, "left_semi")


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, metric, value): tables of (metric, value) under their section, values as text."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.col("metric").cast("string").alias("metric"), F.col("value").cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
