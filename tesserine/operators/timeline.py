"""Ordered per-key computations that survive a key holding a large share of all rows.

A plain window over such a key sorts it in one task. Here the key's rows are cut
into time slices; the window runs per (key, slice) and one summary row per slice
carries the value across slice borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

# A key that holds a third of 100 TB over a month still has slices below 1 GB; the summary of a key
# over ten years is some five million rows.
SLICE = "minute"


def _slice(ts: str) -> Column:
    return F.date_trunc(SLICE, F.col(ts))


def neighbour(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, ts: str, step: int = -1) -> DataFrame:
    """``lag`` (step -1) or ``lead`` (step 1) of ``value`` per key, sliced by time."""
    cut = df.withColumn("_slice", _slice(ts))
    asc = [F.col(c).asc() for c in order]
    desc = [F.col(c).desc() for c in order]
    inner = W.partitionBy(*keys, "_slice").orderBy(*(asc if step < 0 else desc))
    edge = F.max_by if step < 0 else F.min_by
    summary = cut.groupBy(*keys, "_slice").agg(edge(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_edge"))
    outer = W.partitionBy(*keys).orderBy(F.col("_slice").asc() if step < 0 else F.col("_slice").desc())
    carry = summary.select(*keys, "_slice", F.lag("_edge").over(outer).alias("_carry"))
    ranked = cut.withColumn("_first", F.row_number().over(inner) == 1).withColumn("_in", F.lag(value).over(inner))
    joined = ranked.join(carry, [*keys, "_slice"], "left")
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_carry.v")).otherwise(F.col("_in"))).drop(
        "_slice", "_first", "_in", "_carry"
    )


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, ts: str) -> DataFrame:
    """Prefix maximum per key, sliced by time."""
    cut = df.withColumn("_slice", _slice(ts))
    inner = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = (cut.groupBy(*keys, "_slice").agg(F.max(value).alias("_top"))
             .select(*keys, "_slice", F.max("_top").over(outer).alias("_carry")))
    joined = cut.withColumn("_in", F.max(value).over(inner)).join(carry, [*keys, "_slice"], "left")
    return joined.withColumn(out, F.greatest("_in", "_carry")).drop("_slice", "_in", "_carry")
