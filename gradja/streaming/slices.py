"""A small streaming extension: the same plans over batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """(hour, event_type, n, total); late: the watermark of a stream, beyond which rows are dropped."""
    if late and events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def first_deliveries(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once: later deliveries within the watermark are dropped, and state beyond it is let go."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upsert_into(path: str, keys: list[str]):
    """A foreachBatch function that adds the rows of a batch whose keys the table at path lacks: existing rows win."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
            new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(path)

    return add
