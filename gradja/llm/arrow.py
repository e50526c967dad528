"""Arrow-batch plumbing that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradja.session import shared_folder, shared_path  # noqa: F401

Batch = pa.RecordBatch


def map_batches(df: DataFrame, fn: Callable[[Batch], Batch], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch; no shuffle, memory bounded by the batch."""

    def run(it: Iterator[Batch]) -> Iterator[Batch]:
        for b in it:
            yield fn(b)

    return df.mapInArrow(run, schema)


def read(spark: SparkSession, d: str, table: str, *cols: str) -> DataFrame:
    """The named columns of a table; the scan reads no others."""
    return spark.read.parquet(f"{d}/{table}.parquet").select(*cols)


_digest, _HALF = xxhash.xxh3_64_intdigest, 1 << 63


def h64(text: str) -> int:
    """A signed 64-bit hash that is the same on every executor."""
    return _digest(text.encode("utf-8", "surrogatepass")) - _HALF


def article_key(sentence_id: str = "sentence_id"):
    """The first two parts of a sentence_id."""
    return F.substring_index(F.col(sentence_id), "-", 2)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage and plan end here, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """The rows as a local table, for tables with a proven bound of rows only."""
    table = df.toArrow()
    return df.sparkSession.createDataFrame(table) if table.num_rows else df.sparkSession.createDataFrame([], df.schema)
