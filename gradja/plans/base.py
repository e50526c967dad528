"""Registration of queries, and the tidied tables they start from, in both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that gives the same rows."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def read(spark: SparkSession, d: str, table: str, *cols: str) -> DataFrame:
    """The named columns of a table (all if none is named); the scan reads no others."""
    df = spark.read.parquet(f"{d}/{table}.parquet")
    return df.select(*cols) if cols else df


#: The columns of `sentences`: expression in Spark, expression in SQL.
_TIDY = {
    "source": ("min(lower(trim(source)))",) * 2,
    "article_id": ("min(trim(article_id))",) * 2,
    "genre": ("min(nullif(split_part(lower(trim(genre)), ' ', 1), ''))",) * 2,
    "topic": ("min(coalesce(nullif(split_part(lower(trim(genre)), ' ', 2), ''), nullif(lower(trim(topic)), '')))",) * 2,
    "category": ("min(category)",) * 2,
    "sent_idx": ("min(sent_idx)",) * 2,
    "n_clean": ("min(n_clean)",) * 2,
    "url": ("min(url)",) * 2,
    "text": ("min(text)",) * 2,
    "in_quote": ("min(in_quote)",) * 2,
    "text_marked": ("min(text_marked)",) * 2,
    "member": ("min(member)",) * 2,
    "label": ("max(nullif(upper(trim(label)), ''))",) * 2,
    "at": ("min(collected_at)",) * 2,
}


def sentences(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """corpus with one row a sentence_id, fields tidied: case and outer spaces dropped, genre and topic parted, labels in upper case.

    Only the asked columns are read and aggregated; art is the article key.
    """
    need = [c for c in (cols or _TIDY) if c != "art"]
    read_cols = {"at": ["collected_at"], "topic": ["genre", "topic"]}
    raw = dict.fromkeys(x for c in need for x in read_cols.get(c, [c]))
    df = read(spark, d, "corpus", "sentence_id", *raw).groupBy("sentence_id").agg(F.count(F.lit(1)).alias("_n"), *(F.expr(_TIDY[c][0]).alias(c) for c in need)).drop("_n")
    return df.withColumn("art", F.substring_index("sentence_id", "-", 2)) if not cols or "art" in cols else df


SENTENCES = "s as (select sentence_id, split_part(sentence_id, '-', 1) || '-' || split_part(sentence_id, '-', 2) as art, " + ", ".join(f'{e} as "{c}"' for c, (_, e) in _TIDY.items()) + " from corpus group by sentence_id)"
WITH = "with " + SENTENCES

#: Labels of each annotator, one a sentence: the latest that is valid.
_ANN = "select sentence_id, upper(trim(annotator)) as annotator, upper(trim(label)) as label, nedoumica, napomena, submitted_at from annotation"
ANNOTATIONS = (
    "a as (select sentence_id, annotator, arg_max(label, (submitted_at, label)) as label, max(coalesce(nedoumica, '')) as nedoumica, max(coalesce(napomena, '')) as napomena "
    f"from ({_ANN}) where label in ('OBJ', 'SUBJ') and sentence_id is not null and annotator is not null group by sentence_id, annotator)"
)


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """annotation with one row a sentence and annotator: the latest valid label; empty and unknown labels fall out."""
    raw = read(spark, d, "annotation", "sentence_id", "label", "nedoumica", "napomena", "annotator", "submitted_at")
    tidy = raw.select("sentence_id", F.upper(F.trim("annotator")).alias("annotator"), F.upper(F.trim("label")).alias("label"), "nedoumica", "napomena", "submitted_at")
    valid = tidy.filter("label in ('OBJ', 'SUBJ') and sentence_id is not null and annotator is not null")
    latest = F.max_by("label", F.struct("submitted_at", "label"))
    return valid.groupBy("sentence_id", "annotator").agg(latest.alias("label"), F.max(F.coalesce("nedoumica", F.lit(""))).alias("nedoumica"), F.max(F.coalesce("napomena", F.lit(""))).alias("napomena"))


INVENTORY = (
    "i as (select lower(trim(source)) as source, trim(article_id) as article_id, url, nullif(split_part(lower(trim(genre)), ' ', 1), '') as genre, nullif(lower(trim(topic)), '') as topic, category, \"date\" as date, title, collected_at from inventory)"
)


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """inventory with tidied source, article_id, genre and topic; listings stay as often as they were made."""
    return read(spark, d, "inventory").select(
        F.lower(F.trim("source")).alias("source"), F.trim("article_id").alias("article_id"), "url", F.expr("nullif(split_part(lower(trim(genre)), ' ', 1), '')").alias("genre"), F.expr("nullif(lower(trim(topic)), '')").alias("topic"), "category", "date", "title", "collected_at"
    )


PREDS = "p as (select sentence_id, model, lang, shots, max(upper(trim(pred))) as pred from llm_preds group by all)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """llm_preds with one row a sentence and configuration; config names the configuration."""
    raw = read(spark, d, "llm_preds", "sentence_id", "pred", "model", "lang", "shots")
    return raw.groupBy("sentence_id", "model", "lang", "shots").agg(F.max(F.upper(F.trim("pred"))).alias("pred")).withColumn("config", F.concat_ws("-", "model", "lang", "shots"))
