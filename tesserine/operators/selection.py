"""Exact order statistics per key by radix selection: counts only, no ordering of values.

A double becomes its 64 bits in an order-preserving form. Each pass counts the rows of the wanted prefixes by their next ``DIGIT`` bits, finds the digit that
holds the wanted rank, and goes on with the rows of that prefix only, so after 64 / DIGIT passes the value is exact. A window sees at most 2 ** DIGIT counts,
however the values lie: an outlier takes one prefix more, not the resolution of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, stored
from . import skew

DIGIT = 16


def ordered_bits(value: Column) -> Column:
    """A long in the order of the double: its bits, with negative numbers reversed. Both zeros are one, and NaN is above everything."""
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")  # off by one at most; powers of two are exact
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.when(power(guess) > size, guess - 1).when(power(guess + 1) <= size, guess + 1).otherwise(guess)
    normal = (exponent.cast("long") + 1023) * F.lit(1 << 52) + ((size / power(exponent) - 1) * F.lit(float(1 << 52))).cast("long")
    small = (size * power(F.lit(537)) * power(F.lit(537))).cast("long")  # subnormal: a whole number of the least step, in two exact factors
    infinite = F.lit(2047 << 52)
    bits = F.when(size < F.lit(2.2250738585072014e-308), small).when(size == F.lit(float("inf")), infinite).otherwise(normal)
    return F.when(F.isnan(value), infinite + 1).when(value < 0, -bits).otherwise(bits)


def at_ranks(rows: DataFrame, ranks: DataFrame, key: str, value: str) -> DataFrame:
    """(key, rank, value) for each wanted (key, rank); ranks count from 0 and are below the number of the key's values. ``rows`` is (key, value) without nulls."""
    rows = stored(rows.select(key, value, ordered_bits(F.col(value)).alias("_bits")), "ranked")
    wanted = ranks.select(key, "rank", F.col("rank").alias("_left"))
    for done in range(0, 64, DIGIT):
        prefix = lambda n: F.shiftright("_bits", 64 - n) if n else F.lit(0).cast("long")
        inside = rows
        if done:
            groups = wanted.groupBy(key, "_at").agg(F.max("_rows").alias("_rows"))
            inside = skew.join_groups(rows.withColumn("_at", prefix(done)), groups, [key, "_at"], value, "_rows")
        counts = inside.groupBy(key, prefix(done).alias("_at"), prefix(done + DIGIT).alias("_next")).agg(F.count("*").alias("_rows"), F.min(value).alias(value))
        upto = W.partitionBy(key, "_at").orderBy("_next")  # at most 2 ** DIGIT counts
        counts = counts.withColumn("_end", F.sum("_rows").over(upto))
        on = [key, "_at"] if done else [key]
        found = wanted.drop("_rows", value).join(counts if done else counts.drop("_at"), on).where((F.col("_left") < F.col("_end")) & (F.col("_left") >= F.col("_end") - F.col("_rows")))
        # a few rows for each key
        wanted = cut_lineage(found.select(key, "rank", (F.col("_left") - F.col("_end") + F.col("_rows")).alias("_left"), F.col("_next").alias("_at"), "_rows", value))
    return wanted.select(key, "rank", value)


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the middle value, or the mean of both."""
    rows = df.where(F.col(value).isNotNull()).select(key, value)
    n = F.count("*")
    both = F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
    ranks = rows.groupBy(key).agg(both.alias("_both")).select(key, F.explode("_both").alias("rank"))
    return at_ranks(rows, ranks, key, value).groupBy(key).agg(((F.min(value) + F.max(value)) / 2).alias("median"))
