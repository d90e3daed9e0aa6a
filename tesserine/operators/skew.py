"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 10_000_000  # a key above this is split
SALTS = 256


def join_groups(left: DataFrame, groups: DataFrame, key: str | list[str], spread: str, count: str, hot: int = HOT_ROWS,
                how: str = "inner") -> DataFrame:
    """Join rows to their one group row; ``count`` is the group's number of rows.

    Keys above ``hot`` rows are salted on both sides. At most rows/hot such keys exist,
    which bounds the list that is broadcast to flag them.
    """
    keys = [key] if isinstance(key, str) else key
    # Reading every column keeps this aggregation identical to the one joined below, so its shuffle is
    # done once and reused. A flag is only a hint: salt 0 of a hot group exists as well.
    whole = F.xxhash64(*groups.columns) != 0
    flags = groups.where((F.col(count) > hot) & whole).select(*keys, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0)
    lhs = left.join(F.broadcast(flags), keys, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    copies = F.when(F.col(count) > hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    rhs = groups.withColumn("_salt", F.explode(copies))
    return lhs.join(rhs, [*keys, "_salt"], how).drop("_salt")
