"""Problem 7: bring text that looks the same to one consistent form.

The bigram model is counted over the whole table (one pass, partial counts per
task); the table of counts is bounded by the square of the three alphabets, so
it may go to the driver and into the task closures.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradja.llm.arrow import map_batches, read
from gradja.llm.textform import PLAIN_BIGRAMS, Bigrams, consistent, is_clean, script


def fit_bigrams(df: DataFrame, text: str = "text") -> Bigrams:
    """Count character bigrams, word start and end included, over every text that is surely consistent."""

    def count(it):
        seen: Counter = Counter()
        for b in it:
            clean = " ".join(t for t in b.column(0).to_pylist() if t and is_clean(t)).lower()
            seen.update(zip(clean, clean[1:]))
        out: Counter = Counter()
        for (x, y), n in seen.items():
            sx, sy = script(x), script(y)
            if sx and sx == sy:
                out[x + y] += n
            elif sx or sy:
                if sy:
                    out["^" + y] += n
                if sx:
                    out[x + "$"] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["pair", "n"])

    rows = df.select(text).mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Bigrams({r.pair: r.n for r in rows})


def add_consistent(df: DataFrame, text: str = "text", out: str = "text_consistent", model: Bigrams = PLAIN_BIGRAMS) -> DataFrame:
    """Add the consistent form of a column; null stays null, other columns are left as they are."""

    @F.pandas_udf("string")
    def form(s):
        return s.map(lambda t: consistent(t, model), na_action="ignore")

    return df.withColumn(out, form(F.col(text).cast("string")))


def inconsistent_rows(df: DataFrame, key: str = "sentence_id", text: str = "text", model: Bigrams = PLAIN_BIGRAMS) -> DataFrame:
    """Keys of the rows whose text is not in the consistent form, each once; null texts and null keys are no case."""

    def pick(b):
        keep = [k for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if k is not None and t is not None and consistent(t, model) != t]
        return pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], [key])

    return map_batches(df.select(key, text), pick, f"`{key}` string").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    corpus = read(spark, d, "corpus", "sentence_id", "text")
    return inconsistent_rows(corpus, model=fit_bigrams(corpus))


def p7_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every row of corpus with its text in the consistent form, one row per sentence_id."""
    corpus = read(spark, d, "corpus", "sentence_id", "text").filter("sentence_id is not null").dropDuplicates(["sentence_id"])
    return add_consistent(corpus, "text", "consistent", fit_bigrams(corpus)).select("sentence_id", "consistent")


QUERIES = {"p7_found": p7_found, "p7_consistent": p7_consistent}
SQL: dict[str, str] = {}
