"""Agreement, association and paired tests, as aggregates over small tables of counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, o): counts of every combination, zeros included; nulls don't count."""
    n = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    every = n.select(a).distinct().crossJoin(n.select(b).distinct())  # of distinct values of two category columns
    return every.join(n, [a, b], "left").withColumn("o", F.coalesce("o", F.lit(0)))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, chi2, dof, v): chi-square and Cramer's V; 0 where a table has under two rows or columns."""
    t = contingency(df, a, b)
    rt, ct = F.sum("o").over(Window.partitionBy(a)), F.sum("o").over(Window.partitionBy(b))
    t = t.withColumn("e", rt * ct / F.sum("o").over(Window.partitionBy(F.lit(1))))
    s = t.agg(F.sum("o").alias("n"), F.sum(F.when(F.col("e") > 0, F.pow(F.col("o") - F.col("e"), 2) / F.col("e"))).alias("chi2"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    least = F.least("r", "c") - 1
    v = F.when((F.col("n") > 0) & (least > 0), F.sqrt(F.col("chi2") / (F.col("n") * least))).otherwise(0.0)
    return s.select("n", F.when(least > 0, F.col("chi2")).otherwise(0.0).alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), v.alias("v"))


def f1_table(df: DataFrame, gold: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Counts, precision, recall and F1 of both labels, macro F1 and accuracy by group; 0 where undefined."""
    hit = lambda g, p: F.count_if((F.col(gold) == g) & (F.col(pred) == p))
    t = df.groupBy(*by).agg(F.count("*").alias("n"), hit("SUBJ", "SUBJ").alias("tp"), hit("OBJ", "SUBJ").alias("fp"), hit("SUBJ", "OBJ").alias("fn"), hit("OBJ", "OBJ").alias("tn"))
    div = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    t = t.withColumn("p_subj", div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r_subj", div(F.col("tp"), F.col("tp") + F.col("fn")))
    t = t.withColumn("f_subj", div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("f_obj", div(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn")))
    return t.withColumn("macro", (F.col("f_subj") + F.col("f_obj")) / 2).withColumn("acc", div(F.col("tp") + F.col("tn"), F.col("n")))


def kappa_pairs(df: DataFrame, item: str, rater: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, n, po, kappa) of every two raters over the items both labelled; 1 if chance agreement is 1."""
    x, y = df.select(*by, item, F.col(rater).alias("a"), F.col(label).alias("la")), df.select(*by, item, F.col(rater).alias("b"), F.col(label).alias("lb"))
    pair = [*by, "a", "b"]
    c = x.join(y, [*by, item]).filter("a < b").groupBy(*pair, "la", "lb").agg(F.count("*").alias("o"))
    po = c.groupBy(*pair).agg(F.sum("o").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("o")).otherwise(0)).alias("same"))
    left = c.groupBy(*pair, F.col("la").alias("l")).agg(F.sum("o").alias("na"))
    right = c.groupBy(*pair, F.col("lb").alias("l")).agg(F.sum("o").alias("nb"))
    pe = left.join(right, [*pair, "l"]).groupBy(*pair).agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    t = po.join(pe, pair, "left").withColumn("po", F.col("same") / F.col("n")).withColumn("pe", F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n")))
    return t.select(*pair, "n", "po", F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def subset_kappa(df: DataFrame, item: str, rater: str, label: str, subset: str, least: int = 20) -> DataFrame:
    """(subset, n, kappa): mean kappa of every two raters over each subset's items, of subsets with so many items that every rater labelled."""
    raters = df.agg(F.count_distinct(rater).alias("_all"))  # one row
    whole = df.groupBy(item).agg(F.count_distinct(rater).alias("_n")).crossJoin(F.broadcast(raters)).filter("_n = _all").select(item)
    full = df.join(whole, item, "left_semi")
    n = full.groupBy(subset).agg(F.count_distinct(item).alias("n")).filter(F.col("n") >= least)
    return kappa_pairs(full, item, rater, label, [subset]).groupBy(subset).agg(F.avg("kappa").alias("kappa")).join(n, subset).select(subset, "n", "kappa")


def fleiss(df: DataFrame, item: str, label: str, raters: int) -> DataFrame:
    """(n, kappa) over items that all raters labelled; 1 if chance agreement is 1."""
    c = df.groupBy(item, label).agg(F.count("*").alias("k"))
    per = c.withColumn("m", F.sum("k").over(Window.partitionBy(item))).filter(F.col("m") == raters)
    items = per.groupBy(item).agg(((F.sum(F.col("k") * F.col("k")) - raters) / (raters * (raters - 1))).alias("p")).agg(F.count("*").alias("n"), F.avg("p").alias("po"))
    share = per.groupBy(label).agg(F.sum("k").alias("k")).agg((F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), 2)).alias("pe"))
    return items.crossJoin(share).select("n", F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))  # one row each


def alpha(df: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """Krippendorff's alpha, nominal, over items with two raters or more; 1 if no disagreement is to be expected."""
    d = df.select(item, rater, label).withColumn("m", F.count("*").over(Window.partitionBy(item))).filter("m > 1")
    o = d.alias("x").join(d.alias("y"), item).filter(F.col(f"x.{rater}") != F.col(f"y.{rater}"))
    o = o.groupBy(F.col(f"x.{label}").alias("c"), F.col(f"y.{label}").alias("k")).agg(F.sum(1 / (F.col("x.m") - 1)).alias("o"))
    n = o.groupBy("c").agg(F.sum("o").alias("nc"))
    total = n.agg(F.sum("nc").alias("n"), F.sum(F.col("nc") * F.col("nc")).alias("sq"))
    do = o.agg(F.coalesce(F.sum(F.when(F.col("c") != F.col("k"), F.col("o"))), F.lit(0.0)).alias("do"))
    de = (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)
    return do.crossJoin(total).select(F.when(de == 0, 1.0).otherwise(1 - F.col("do") / de).alias("alpha"))  # one row each


def mcnemar_p(b01: int, b10: int, exact: bool | None = None) -> float:
    """Exact binomial under 25 discordant pairs, chi-square with continuity correction from there; 1 without any."""
    n = b01 + b10
    if not n:
        return 1.0
    if exact is None:
        exact = n < 25
    if exact:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b01, b10) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(b01 - b10) - 1) ** 2 / n / 2))


def mcnemar(b01: str, b10: str) -> Column:
    """p of a row's discordant counts, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(i), int(j)) for i, j in zip(x, y)], dtype="float64")

    return run(F.col(b01), F.col(b10))


def wilcoxon_w(df: DataFrame, by: Sequence[str], diff: Column) -> DataFrame:
    """(by, n, w_plus): signed ranks with average ranks for ties; zero differences are dropped."""
    d = df.withColumn("_d", diff).filter("_d <> 0")
    w = Window.partitionBy(*by)
    a = F.abs("_d")
    r = d.withColumn("_r", F.rank().over(w.orderBy(a)) + (F.count("*").over(Window.partitionBy(*by, a)) - 1) / 2.0)
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"))


def wilcoxon_p(ranks: Sequence[float], w_plus: float) -> float:
    """Exact two-sided p by counting the sign patterns; 1 without any rank."""
    if not len(ranks):
        return 1.0
    two = [int(round(2 * r)) for r in ranks]
    ways = {0: 1}
    for r in two:
        nxt = dict(ways)
        for s, n in ways.items():
            nxt[s + r] = nxt.get(s + r, 0) + n
        ways = nxt
    low = min(int(round(2 * w_plus)), sum(two) - int(round(2 * w_plus)))
    return min(1.0, 2 * sum(n for s, n in ways.items() if s <= low) / 2 ** len(two))
