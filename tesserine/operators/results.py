"""Stored results of an analysis, keyed by what was analysed, and incremental runs over them.

A result depends on a file's text and extension and on the version of the analyser, so it is kept under the digest of the first two in the folder of the third. A run hashes
every file once, compares digests, and analyses one file for each digest that has no result. Only the texts of those files are shuffled: a bitmap of fixed size with
their paths sorts out the others where they are read. Results are appended once; a run that is repeated finds them there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stored

#: Bits of the bitmap, as a power of two. Where paths fill it, texts are shuffled that need not be, and nothing else changes.
BITMAP = 22


def digests(files: DataFrame) -> DataFrame:
    """(project, file_path, digest) of text and extension."""
    return files.select("project", "file_path", F.sha2(F.concat(F.lower(tx.extension("file_path")), F.lit("\n"), F.coalesce("content", F.lit(""))), 256).alias("digest"))


def create(spark: SparkSession, path: str, version: str, schema: str) -> None:
    """An empty store of results for a version of the analyser; one that is there stays."""
    spark.createDataFrame([], f"digest string, run string, {schema}").write.mode("ignore").parquet(f"{path}/{version}")


def read(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{version}")


def may_be_among(paths: DataFrame) -> Column:
    """A test whether a row's (project, file_path) may be among ``paths``, to be followed by a join: it sorts out texts where they are read."""
    place = F.pmod(F.xxhash64("project", "file_path"), F.lit(1 << BITMAP))
    cells = paths.select(place.alias("p")).groupBy(F.expr("p div 8").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1, int(p % 8))")).alias("bits")).toArrow()  # at most 2^(BITMAP - 3) rows
    bits = np.zeros(1 << BITMAP - 3, np.uint8)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    byte = F.conv(F.hex(F.substring(F.lit(bits.tobytes()), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (place % 8).cast("int")) == 1


def analyse_new(files: DataFrame, path: str, version: str, run: str, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add the results of all digests that have none, and return the digests of all files.

    ``analyse`` gets project, file_path, content and digest, and returns digest and the columns of the store.
    """
    spark = files.sparkSession
    hashed = stored(digests(files), "digests")
    known = read(spark, path, version)
    first = hashed.groupBy("digest").agg(F.min(F.struct("project", "file_path")).alias("f"))  # copies are analysed once
    missing = stored(first.join(known.select("digest"), "digest", "left_anti").select("f.project", "f.file_path", "digest"), "missing")
    texts = files.select("project", "file_path", "content").where(may_be_among(missing)).join(missing, ["project", "file_path"])
    analyse(texts).withColumn("run", F.lit(run)).select(*known.columns).write.mode("append").parquet(f"{path}/{version}")
    return hashed


def incremental(files: DataFrame, path: str, version: str, run: str, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every file with its result; ``origin`` is ``fresh`` for those whose digest this run met first, else ``cache``."""
    hashed = analyse_new(files, path, version, run, analyse)
    results = read(files.sparkSession, path, version).dropDuplicates(["digest"])
    return hashed.join(results, "digest").withColumn("origin", F.when(F.col("run") == run, "fresh").otherwise("cache")).drop("digest", "run")
