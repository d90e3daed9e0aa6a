"""Snapshot comparison and reuse of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import skew

KEY = ["project", "file_path"]


def file_hash(files: DataFrame) -> DataFrame:
    return files.select(*KEY, F.sha2("content", 256).alias("sha256"))


def project_hash(path) -> Column:
    return F.substring(F.sha2(path, 256), 1, 12)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """new / modified / deleted paths; with no old rows every path is new.

    Hashes are taken before the join, so only paths and digests are shuffled.
    """
    a = file_hash(old).withColumnRenamed("sha256", "_old")
    b = file_hash(new).withColumnRenamed("sha256", "_new")
    status = (F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted")
              .when(F.col("_old") != F.col("_new"), "modified"))
    return a.join(b, KEY, "full").select(*KEY, status.alias("status")).where(F.col("status").isNotNull())


def change_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per project: counts, status, and changes as a share of the current files."""
    n_old = old.groupBy("project").agg(F.count("*").alias("cached_files"))
    n_new = new.groupBy("project").agg(F.count("*").alias("current_files"))
    ch = changed_files(old, new).groupBy("project").agg(*[
        F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("new", "modified", "deleted")])
    j = n_new.join(n_old, "project", "full").join(ch, "project", "left").na.fill(0)
    total = F.col("new_files") + F.col("modified_files") + F.col("deleted_files")
    return j.select(
        "project", F.when(F.col("cached_files") == 0, "no_cache").when(total == 0, "no_changes").otherwise("has_changes").alias("status"),
        "new_files", "modified_files", "deleted_files", total.alias("total_changes"),
        F.when(F.col("current_files") > 0, F.bround(total / F.col("current_files") * 100, 2)).otherwise(0.0).alias("change_percentage"),
        (total > 0).alias("should_reanalyze"))


def merge_incremental(cached: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """Cached rows of unchanged paths plus all fresh rows; one row per path, the fresh one wins."""
    gone = changes.where(F.col("status").isin("modified", "deleted")).select(*KEY).unionByName(fresh.select(*KEY))
    return (cached.join(gone, KEY, "left_anti").withColumn("origin", F.lit("cache"))
            .unionByName(fresh.withColumn("origin", F.lit("fresh"))))


def merge_summary(merged: DataFrame, smells: str = "smells") -> DataFrame:
    return merged.groupBy("project", "language").agg(
        F.count("*").alias("files"), F.sum("cyclomatic").alias("total_complexity"), F.sum(smells).alias("total_code_smells"),
        F.count_if(F.col("origin") == "cache").alias("from_cache"))


def reuse_flags(files: DataFrame, stored: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """(project, file_path, sha256, reused): whether a file's content has a live stored result.

    ``stored`` has sha256 and created_at; a ttl of 0 never expires.
    """
    live = stored if ttl_seconds == 0 else stored.where(
        F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) >= F.lit(now).cast("timestamp"))
    hashed, live = file_hash(files), live.select("sha256").distinct().withColumn("reused", F.lit(True))
    # Each digest is looked up once; copies of one content, however many, are split over tasks.
    groups = hashed.groupBy("sha256").agg(F.count("*").alias("_n")).join(live, "sha256", "left")
    return skew.join_groups(hashed, groups, "sha256", "file_path", "_n").select(*hashed.columns, F.coalesce("reused", F.lit(False)).alias("reused"))


def reuse_by_hash(files: DataFrame, stored: DataFrame, now: str, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(files whose content has a live stored result, files to analyse)."""
    flags = reuse_flags(files, stored, now, ttl_seconds)
    return flags.where("reused").drop("reused"), flags.where("NOT reused").drop("reused")
