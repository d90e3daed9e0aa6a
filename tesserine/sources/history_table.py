"""The history as a table by days with a commit log.

``data/day=/batch=`` holds the rows, ``log/`` a record for each committed batch and each retention. A batch that is appended again is not written twice; one that was
written but not committed is not read, and is replaced when it is appended again. Retention drops whole days and records the moment before which rows are expired,
so that the first day left counts from there on. Everything goes through Spark's writers and its file system, whatever store the path names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "batch string, cutoff timestamp"


def _log(spark: SparkSession, path: str) -> DataFrame:
    where = f"{path}/log"
    return spark.read.schema(LOG).parquet(where) if _there(spark, where)[0] else spark.createDataFrame([], LOG)


def _there(spark: SparkSession, path: str):
    """(is there such a path, its file system, the path in it)"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at), fs, at


def _record(spark: SparkSession, path: str, batch: str | None, cutoff: str | None) -> None:
    row = spark.range(1).select(F.lit(batch).cast("string").alias("batch"), F.lit(cutoff).cast("timestamp").alias("cutoff"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/log")


def append(rows: DataFrame, path: str, batch: str) -> bool:
    """Write and commit a batch; False if it is committed already. The id of a row without one is derived from its content."""
    spark = rows.sparkSession
    if not _log(spark, path).where(F.col("batch") == batch).isEmpty():
        return False
    ident = F.sha2(F.concat_ws("|", "project_name", "analysis_type", F.col("timestamp").cast("string"), "result_json"), 256)
    out = rows.withColumn("id", F.coalesce("id", ident) if "id" in rows.columns else ident).withColumns({"day": F.to_date("timestamp"), "batch": F.lit(batch)})
    order = ["day", "analysis_type", "project_name", "timestamp"]  # ranges: few files a day, and a hot project spans many tasks
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/data")
    _record(spark, path, batch, None)
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of committed batches that are not expired."""
    log = _log(spark, path)
    last = log.agg(F.max("cutoff")).first()[0]
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    rows = rows.withColumn("batch", F.col("batch").cast("string")).join(log.where("batch IS NOT NULL").select("batch").distinct(), "batch", "left_semi")
    if last is not None:
        rows = rows.where((F.col("day") >= F.to_date(F.lit(last))) & (F.col("timestamp") >= F.lit(last)))
    return rows.drop("day", "batch")


def retain(spark: SparkSession, path: str, now: str, days: int = 90) -> list[str]:
    """Expire rows older than ``days`` before ``now``: the moment is recorded, then the days before it are dropped. Returns those days."""
    cutoff, day = spark.sql(f"SELECT cast(t AS string), cast(to_date(t) AS string) FROM (SELECT timestamp'{now}' - make_dt_interval({int(days)}) AS t)").first()
    _record(spark, path, None, cutoff)
    _, fs, at = _there(spark, f"{path}/data")
    gone = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().startswith("day=") and x.getPath().getName() < f"day={day}")
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, name), True)
    return [name.removeprefix("day=") for name in gone]
