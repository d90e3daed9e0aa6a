"""First rows per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def first_per(df: DataFrame, key: str | list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key. Spark applies the rank limit before the shuffle too, so a group sends at most n rows per task."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") <= n).drop("_first")
