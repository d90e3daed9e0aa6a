"""Connected components of a link table, by alternating large and small stars. Only links move; lineage is cut by tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.tables import kept


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same ids, without those that each task sees to be redundant: at most one for each id that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            kept_a, kept_b = [], []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((find(a), find(b)))
                if low != high:
                    root[high] = low
                    kept_a.append(a)
                    kept_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], names=["a", "b"])

    return links.select("a", "b").repartition("a").mapInArrow(run, "a bigint, b bigint")  # the links of an id to all its pivots meet in one task


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); the component is its smallest id. Rounds grow with the logarithm of the longest chain.

    An id with very many links is one row of a sum and the large side of a join, which Spark may split.
    """
    links = kept(forest(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))), "links")
    state = None
    while True:
        # large star: every larger neighbour of a node to the least of its neighbourhood
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours to the least of them
        large = kept(large, "links")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        links = kept(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        state = now
