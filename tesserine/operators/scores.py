"""Counts and scores per project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import SEVERITY_RANK
from . import files as fl
from . import selection, structure
from .tops import first_per


def projects(files: DataFrame) -> DataFrame:
    return files.select("project").distinct()


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITY_RANK])


def _weighted(all_projects: DataFrame, findings: DataFrame) -> DataFrame:
    w = findings.groupBy("project").agg(F.sum("weight").alias("w"), F.count("*").alias("findings"),
                                        F.count_if(F.col("severity").isin("critical", "high")).alias("severe"))
    return all_projects.join(w, "project", "left").na.fill(0)


def risk_score(all_projects: DataFrame, findings: DataFrame) -> DataFrame:
    return _weighted(all_projects, findings).select(
        "project", "findings", tx.round_even(F.least(F.lit(100.0), F.col("w") / 10 * 100), 1).alias("risk_score"),
        (F.col("severe") == 0).alias("is_safe"))


def performance_score(all_projects: DataFrame, findings: DataFrame) -> DataFrame:
    penalty = F.least(F.lit(100.0), F.col("w") / 8 * 100)
    return _weighted(all_projects, findings).select(
        "project", F.col("findings").alias("issues"), tx.round_even(F.greatest(F.lit(0.0), 100 - penalty), 1).alias("performance_score"))


def issues_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project", "category").agg(F.count("*").alias("issues"))


DEBT_COLUMNS = ["project", "category", "name", "file_path", "line_number", "description", "effort_hours", "priority"]


def debt_scan_items(findings: DataFrame) -> DataFrame:
    return findings.select("project", "category", F.col("rule_name").alias("name"), "file_path", "line_number", "description",
                           "effort_hours", F.col("severity").alias("priority"))


def debt_large_file(files: DataFrame, limit: int = 500) -> DataFrame:
    n = files.select("project", "file_path", tx.line_count("content").alias("n")).where(F.col("n") > limit)
    return n.select(
        "project", F.lit("maintainability").alias("category"), F.lit("Large File").alias("name"), "file_path",
        F.lit(1).alias("line_number"), F.format_string(f"File has %d lines (threshold: {limit})", "n").alias("description"),
        F.round((F.col("n") - limit) * 0.01, 2).alias("effort_hours"),
        F.when(F.col("n") < 1000, "medium").otherwise("high").alias("priority"))


def debt_complexity(metrics: DataFrame) -> DataFrame:
    """``metrics`` has project, file_path, cyclomatic."""
    cc = F.col("cyclomatic")
    return metrics.where(cc > 10).select(
        "project", F.lit("complexity").alias("category"), F.lit("High Cyclomatic Complexity").alias("name"), "file_path",
        F.lit(1).alias("line_number"), F.format_string("Cyclomatic complexity is %d (threshold: 10)", cc.cast("int")).alias("description"),
        ((cc - 10) * 0.5).alias("effort_hours"), F.when(cc > 20, "high").otherwise("medium").alias("priority"))


def debt_items(files: DataFrame, findings: DataFrame, metrics: DataFrame) -> DataFrame:
    return (debt_scan_items(findings).unionByName(debt_large_file(files)).unionByName(debt_complexity(metrics)))


def debt_score(files: DataFrame, items: DataFrame) -> DataFrame:
    """Hours per thousand lines, 40 being 100 points."""
    loc = files.groupBy("project").agg(F.sum(tx.line_count("content")).alias("total_lines"), F.count("*").alias("total_files"))
    hours = items.groupBy("project").agg(F.sum("effort_hours").alias("h"), F.count("*").alias("items"))
    j = loc.join(hours, "project", "left").na.fill(0)
    raw = F.least(F.lit(100.0), F.try_divide(F.col("h"), F.col("total_lines")) * 1000 / 40 * 100)
    return j.select("project", "total_files", "total_lines", "items", tx.round_even(F.round("h", 6), 1).alias("total_effort_hours"),
                    tx.round_even(F.round(F.coalesce(raw, F.lit(0.0)), 6), 1).alias("debt_score"))


def debt_by_category(items: DataFrame) -> DataFrame:
    s = F.round(F.sum("effort_hours"), 6)
    return items.groupBy("project", "category").agg(
        F.count("*").alias("items"), tx.round_even(s, 1).alias("total_effort_hours"),
        tx.round_even(F.round(s / F.count("*"), 6), 1).alias("average_effort"))


def debt_top(items: DataFrame, n: int) -> DataFrame:
    return first_per(items, "project", [F.col("effort_hours").desc(), "file_path", "line_number", "name", "description"], n)


def file_report(files: DataFrame, smells: DataFrame) -> DataFrame:
    """One row per known-language file: metrics, counts of functions, classes and smells.

    Everything but the smell count is computed in the file's own row.
    """
    known = files.where(fl.language("file_path").isNotNull()).select("project", "file_path", "content")
    levels = ("critical", "high", "medium", "low")
    n = smells.groupBy("project", "file_path").agg(
        F.count("*").alias("smells"), *[F.count_if(F.col("severity") == s).alias(f"{s}_smells") for s in levels],
        F.count_if(F.col("name") == "Deep Nesting").alias("deep_nesting_count"))
    return (structure.file_facts(known).join(n, ["project", "file_path"], "left")
            .na.fill(0, ["smells", "deep_nesting_count", *[f"{s}_smells" for s in levels]])
            .withColumn("language", fl.language("file_path")))


def project_summary(report: DataFrame) -> DataFrame:
    sums = [F.sum(f"{s}_smells").alias(f"{s}_smells") for s in ("critical", "high", "medium", "low")]
    return report.groupBy("project").agg(
        F.count("*").alias("total_files"), F.sum("functions").alias("total_functions"), F.sum("classes").alias("total_classes"),
        F.sum("smells").alias("total_code_smells"), tx.round_even(F.avg("cyclomatic"), 1).alias("average_cyclomatic"),
        *sums, F.sum("deep_nesting_count").alias("deep_nesting_count"))


def language_breakdown(report: DataFrame) -> DataFrame:
    return report.groupBy("language").agg(F.count("*").alias("files"), F.sum("functions").alias("functions"),
                                          F.sum("classes").alias("classes"))


def smell_types_top(smells: DataFrame, n: int) -> DataFrame:
    return first_per(smells.groupBy("project", "name").agg(F.count("*").alias("smells")), "project", [F.col("smells").desc(), "name"], n)


def top_files(report: DataFrame, by: str, n: int = 5) -> DataFrame:
    """First n files per project; the rank filter is pushed below the shuffle by the group-limit rule."""
    w = W.partitionBy("project").orderBy(F.col(by).desc(), "file_path")
    rel = F.regexp_replace("file_path", "^src/[^/]*/", "")
    return report.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("file", rel)


def complexity_hotspots(functions: DataFrame, classes: DataFrame, smells: DataFrame, n: int, n_nested: int) -> DataFrame:
    """Per project: the n most complex functions, the n longest classes, the first n_nested places of deep nesting."""
    cols = ["project", "kind", "file_path", "line_number", "name", "value"]
    f = (first_per(functions, "project", [F.col("cyclomatic").desc(), "file_path", "start_line"], n)
         .select("project", F.lit("function").alias("kind"), "file_path", F.col("start_line").alias("line_number"), "name", F.col("cyclomatic").alias("value")))
    c = (first_per(classes, "project", [F.col("loc").desc(), "file_path", "start_line"], n)
         .select("project", F.lit("class").alias("kind"), "file_path", F.col("start_line").alias("line_number"), "name", F.col("loc").alias("value")))
    s = (first_per(smells.where(F.col("name").contains("Deep Nesting")), "project", ["file_path", "line_number"], n_nested)
         .select("project", F.lit("deep_nesting").alias("kind"), "file_path", "line_number", F.col("owner").alias("name"), F.lit(None).cast("int").alias("value")))
    return f.unionByName(c).unionByName(s).select(*cols)


def smells_top(smells: DataFrame, n: int) -> DataFrame:
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    return first_per(smells.withColumn("rank", rank), "project", ["rank", "file_path", "line_number", "name", "description"], n)


def timing_stats(timings: DataFrame) -> DataFrame:
    s = F.col("seconds")
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    base = timings.groupBy("name").agg(F.count(s).alias("iterations"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.avg(s).alias("mean"),
                                       F.stddev_samp(s).alias("sd"), F.sum(s).alias("total"))
    return base.join(selection.medians(timings, "name", "seconds"), "name", "left").select(
        "name", "iterations", F.coalesce("lo", F.lit(0.0)).alias("min_time"), F.coalesce("hi", F.lit(0.0)).alias("max_time"), r(F.col("mean")).alias("mean_time"),
        r(F.col("median")).alias("median_time"), r(F.col("sd")).alias("stdev_time"), r(F.col("total")).alias("total_time"))


def timing_compare(timings: DataFrame, baseline: str | None = None) -> DataFrame:
    """Means of benchmarks against each other, on one aggregated row per name: all against ``baseline``, or, as a report of n names is meant to, every ordered pair."""
    m = timings.groupBy("name").agg(F.avg("seconds").alias("mean"))
    a, b = m.select(F.col("name").alias("name1"), F.col("mean").alias("t1")), m.select(F.col("name").alias("name2"), F.col("mean").alias("t2"))
    j = a.where(F.col("name1") == baseline).join(b, F.col("name1") != F.col("name2")) if baseline is not None else a.join(b, F.col("name1") < F.col("name2"))
    return j.select("name1", "name2", F.round("t1", 6).alias("time1"), F.round("t2", 6).alias("time2"),
                    F.round(F.try_divide(F.col("t1"), F.col("t2")), 6).alias("speedup"),
                    F.round((1 - F.try_divide(F.col("t2"), F.col("t1"))) * 100, 6).alias("improvement"))
