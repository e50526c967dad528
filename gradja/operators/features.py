"""Sparse text features in long form (doc, term, weight), similarity and near-duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradja.functions.text import word_tokens
from gradja.session import shared_folder


@dataclass(frozen=True)
class Config:
    """One feature configuration: longest n-gram, weighting, lower case, stems, fewest documents of a term."""

    name: str
    n: int = 1
    idf: bool = True
    lower: bool = True
    stem: bool = False
    min_df: int = 2


# The names of the configurations.
CONFIGS = [
    Config("w1-tfidf-lower"),
    Config("w12-tfidf-lower", n=2),
    Config("w13-tfidf-lower", n=3),
    Config("w1-tf-lower", idf=False),
    Config("w12-tf-lower", n=2, idf=False),
    Config("w13-tf-lower", n=3, idf=False),
    Config("w1-tfidf-nolower", lower=False),
    Config("w13-tfidf-nolower", n=3, lower=False),
    Config("w1-tfidf-lower-stem", stem=True),
    Config("w12-tfidf-lower-stem", n=2, stem=True),
    Config("w13-tfidf-lower-stem", n=3, stem=True),
    Config("w13-tf-lower-stem", n=3, idf=False, stem=True),
]


def config_counts(df: DataFrame, doc: str, text: str, config: Config, keep: Sequence[str] = ()) -> DataFrame:
    """(doc, keep..., term, tf) of a configuration: its n-grams, in lower case or not, of stems or not."""
    if config.stem:
        from gradja.functions.stemming import stemmed

        df = stemmed(df.select(doc, text, *keep), text, text)
    return term_counts(df, doc, text, config.n, config.lower, keep)


def upper_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, least, upper_median, most): the value at place n div 2 of the sorted rows, counted from 0.

    Counts by value come first, so a group of any size is a short table.
    """
    c = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    c = c.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_mid", F.floor(F.sum("_n").over(w) / 2))
    hit = (F.col("_mid") < F.col("_upto")) & (F.col("_mid") >= F.col("_upto") - F.col("_n"))
    return c.groupBy(*by).agg(F.min(value).alias("least"), F.max(F.when(hit, F.col(value))).alias("upper_median"), F.max(value).alias("most"))


def ngrams(tokens: Column, n: int) -> Column:
    """All word n-grams from one to n words, as one array."""

    def of(k: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))
        return F.when(F.size(tokens) >= k, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(tokens, *(of(k) for k in range(2, n + 1)))


def term_counts(df: DataFrame, doc: str, text: str, n: int = 1, lower: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(doc, keep..., term, tf)."""
    tokens = word_tokens(F.lower(text) if lower else F.col(text))
    return df.select(doc, *keep, F.explode(ngrams(tokens, n)).alias("term")).groupBy(doc, *keep, "term").agg(F.count("*").alias("tf"))


def char_grams(df: DataFrame, doc: str, text: str, n: int = 4) -> DataFrame:
    """(doc, term, tf): character n-grams inside words padded by one space; shorter padded words count whole."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    w = df.select(doc, F.explode(words).alias("w")).withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - (n - 1), F.lit(1))), lambda i: F.col("w").substr(i, F.lit(n)))
    return w.select(doc, F.explode(grams).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, min_df: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(by, term, df) of the terms in at least so many documents; by: folds, each with its own vocabulary."""
    return tf.groupBy(*by, "term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)


def weights(tf: DataFrame, doc: str, min_df: int = 2, idf: bool = True) -> DataFrame:
    """(doc, term, w): term frequency, by smooth inverse document frequency if asked, of unit length by document."""
    v = vocabulary(tf, min_df)
    n = tf.select(F.count_distinct(doc).alias("n"))
    t = tf.join(v, "term")
    if idf:
        t = t.crossJoin(F.broadcast(n)).withColumn("raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    else:
        t = t.withColumn("raw", F.col("tf").cast("double"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return t.select(doc, "term", (F.col("raw") / norm).alias("w"))


def similar_pairs(w: DataFrame, doc: str, least: float = 0.9) -> DataFrame:
    """(a, b, cos), a < b, of unit vectors with a cosine of at least `least`.

    Exact, by prefix filtering on an inverted index: terms are taken from rare to
    common, and once what is left of a vector can't reach `least` by itself, the rest
    of its terms needs no postings. Candidates are scored on their whole vectors.
    """
    df = w.groupBy("term").agg(F.count("*").alias("_df"))
    order = Window.partitionBy(doc).orderBy("_df", "term")
    p = w.join(df, "term").withColumn("_before", F.coalesce(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    heads = p.filter(F.sqrt(F.greatest(1 - F.col("_before"), F.lit(0.0))) >= least - 1e-9).select(doc, "term")
    cand = heads.select("term", F.col(doc).alias("a")).join(heads.select("term", F.col(doc).alias("b")), "term").filter("a < b").select("a", "b").distinct()
    x = w.select(F.col(doc).alias("a"), "term", F.col("w").alias("wa"))
    y = w.select(F.col(doc).alias("b"), "term", F.col("w").alias("wb"))
    scored = cand.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cos"))
    return scored.filter(F.col("cos") >= least)


def greedy_removal(pairs: DataFrame) -> DataFrame:
    """(doc, kept_by): rows dropped because a surviving earlier row is similar; pairs are (a, b) with a < b.

    Rounds settle every row whose earlier partners are all settled: it survives if none of
    them does. The pairs shrink each round and are cut loose by checkpoint(); the first open
    row is settled in every round, so the rounds end, with no pair left open.
    """
    shared_folder(pairs.sparkSession)
    open_pairs = pairs.select("a", "b").checkpoint()
    dropped, rounds = None, 0
    while not open_pairs.isEmpty():
        # rows without an open earlier partner survive; what is similar to them goes
        alive = open_pairs.select("a").distinct().join(open_pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = open_pairs.join(alive, "a").groupBy("b").agg(F.min("a").alias("kept_by")).withColumnRenamed("b", "doc").checkpoint()
        dropped = gone if dropped is None else dropped.union(gone)
        if (rounds := rounds + 1) % 20 == 0:
            dropped = dropped.checkpoint()  # else the plan grows with the rounds
        ids = gone.select("doc")
        open_pairs = open_pairs.join(alive, "a", "left_anti").join(ids, open_pairs["a"] == ids["doc"], "left_anti").join(ids, open_pairs["b"] == ids["doc"], "left_anti").checkpoint()
    return dropped if dropped is not None else pairs.select(F.col("a").alias("doc"), F.col("b").alias("kept_by")).limit(0)
