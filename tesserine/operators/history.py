"""Stored analysis results: latest, trends, comparison, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from . import timeline

ORDER = ["timestamp", "event_id"]


def latest(hist: DataFrame, n: int = 10, keys: list[str] | None = None, analysis_type: str | None = None, order: list[str] = ORDER) -> DataFrame:
    """Last n rows per key. The rank filter runs before the shuffle too, so each task ships at most n rows per key."""
    if analysis_type:
        hist = hist.where(F.col("analysis_type") == analysis_type)
    w = W.partitionBy(*(keys or ["project_name"])).orderBy(*[F.col(c).desc() for c in order])
    return hist.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def by_id(hist: DataFrame, record_id: str) -> DataFrame:
    return hist.where(F.col("id") == record_id)


def list_projects(hist: DataFrame) -> DataFrame:
    return hist.groupBy("project_name", "project_path").agg(
        F.count("*").alias("total_analyses"), F.min("timestamp").alias("first_analysis"), F.max("timestamp").alias("last_analysis"))


def metric(json, path: str) -> Column:
    """Dotted path in a JSON text as a double, null when missing."""
    return F.get_json_object(json, f"$.{path}").try_cast("double")


def metric_trend(hist: DataFrame, path: str, limit: int = 10, analysis_type: str | None = None, order: list[str] = ORDER) -> DataFrame:
    """Up to ``limit`` last values per project and type; missing values are dropped after the limit."""
    keys = ["project_name", "analysis_type"]
    out = latest(hist, limit, keys, analysis_type, order).withColumn("value", metric("result_json", path))
    return out.where(F.col("value").isNotNull()).select(*keys, "timestamp", *[c for c in order if c != "timestamp"], "rank", "value")


def last_two(hist: DataFrame, path: str, order: list[str] = ORDER) -> DataFrame:
    """Latest and previous value per project and type, ordered by time."""
    keys = ["project_name", "analysis_type"]
    pts = hist.withColumn("value", metric("result_json", path)).where(F.col("value").isNotNull())
    pts = latest(pts, 2, keys, None, order)
    return pts.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("latest_value"),
                                  F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("previous_value"))


def trend_direction(pairs: DataFrame) -> DataFrame:
    d = F.col("latest_value") - F.col("previous_value")
    return pairs.withColumn("trend_direction", F.when(d.isNull() | (F.abs(d) < 0.5), "stable").when(d > 0, "improving").otherwise("declining"))


def trend_change_rate(pairs: DataFrame) -> DataFrame:
    prev, now = F.col("previous_value"), F.col("latest_value")
    rate = F.when(prev.isNull() | (prev == 0), 0.0).otherwise(F.bround((now - prev) / prev * 100, 1))
    return pairs.withColumn("change_rate", rate)


def report_compare(pairs: DataFrame, before: str, after: str, paths: list[str]) -> DataFrame:
    """Metric list unrolled per row of two JSON reports; a metric must be present in both."""
    rows = F.array(*[F.struct(F.lit(p).alias("metric_name"), metric(before, p).alias("before_value"), metric(after, p).alias("after_value")) for p in paths])
    keep = [c for c in pairs.columns if c not in (before, after)]
    m = pairs.select(*keep, F.explode(rows).alias("m")).select(*keep, "m.*")
    b, a = F.col("before_value"), F.col("after_value")
    return m.where(b.isNotNull() & a.isNotNull()).select(
        "*", F.bround(a - b, 2).alias("absolute_change"),
        F.when(b == 0, 0.0).otherwise(F.bround((a - b) / F.abs(b) * 100, 1)).alias("relative_change"), (a > b).alias("is_improved"))


def retain(hist: DataFrame, now: str, days: int = 90) -> DataFrame:
    return hist.where(F.col("timestamp") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def snapshot_deltas(hist: DataFrame, path: str) -> DataFrame:
    """Value, change against the previous one, running peak; time-sliced so that no project is one task."""
    pts = hist.select("project_name", "timestamp", "event_id", metric("result_json", path).alias("value")).where(F.col("value").isNotNull())
    prev = timeline.neighbour(pts, ["project_name"], ORDER, "value", "previous", "timestamp", step=-1)
    peak = timeline.running_max(prev, ["project_name"], ORDER, "value", "peak", "timestamp")
    return peak.withColumn("delta", F.coalesce(F.col("value") - F.col("previous"), F.lit(0.0)))
