"""Cross products of small dimensions, and what is left to do of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most values a dimension may have before the product is refused.
MOST = 1000


def grid(df: DataFrame, *dims: str) -> DataFrame:
    """Every combination of the values of small dimensions: their sets in one aggregate, then exploded."""
    sets = df.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in dims))
    for c in dims:
        small = F.when(F.size(c) <= MOST, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is no small dimension")))
        sets = sets.withColumn(c, F.explode(small))
    return sets


def todo(items: DataFrame, configs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items by configuration that aren't done; the configurations travel as one array on each item."""
    cols = configs.columns
    every = configs.agg(F.collect_set(F.struct(*cols)).alias("_c"))
    wanted = items.crossJoin(F.broadcast(every)).withColumn("_c", F.explode("_c")).select(*items.columns, *(F.col(f"_c.{c}").alias(c) for c in cols))  # every is one row
    return wanted.join(done.select(*keys), list(keys), "left_anti").select(*keys)
