"""Reading the given tables and keeping intermediate results where every executor can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserine.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it back: later steps neither repeat its work nor lose it with an executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def need(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns. Others, whatever their names, are not touched; of exact duplicates of a name none could be chosen, so that is an error."""
    return df.select(*names)
