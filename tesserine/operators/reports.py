"""Report shaping: SARIF rows and documents, heat map rows, severities, nested trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.rules import SARIF_LEVEL, SEVERITY_RANK
from . import skew

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"


def level(severity) -> Column:
    pairs = [F.lit(x) for kv in SARIF_LEVEL.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), severity), F.lit("warning"))


def location_split(location) -> tuple[Column, Column]:
    """'path:line' at the last colon; line 1 when there is none."""
    loc = F.col(location) if isinstance(location, str) else location
    rx = r"(?s)^(.*):(\d+)$"
    n = F.regexp_extract(loc, rx, 2)
    return F.when(n != "", F.regexp_extract(loc, rx, 1)).otherwise(loc), F.when(n != "", n.try_cast("int")).otherwise(F.lit(1))


def issues(smells: DataFrame, findings: DataFrame) -> DataFrame:
    """Smells first, then security findings, in one shape."""
    a = smells.select("project", F.lit(0).alias("source"), "file_path", "line_number", F.col("name").alias("rule_id"),
                      F.lit(0).alias("pattern_idx"), "severity", F.col("suggestion").alias("rule_text"), F.col("description").alias("message"))
    b = findings.select("project", F.lit(1).alias("source"), "file_path", "line_number", "rule_id", "pattern_idx", "severity",
                        F.col("description").alias("rule_text"), F.col("description").alias("message"))
    return a.unionByName(b)


_SEEN = ["source", "file_path", "line_number", "rule_id", "pattern_idx", "message"]


def sarif_rules(items: DataFrame) -> DataFrame:
    """Distinct rules per project in first-seen order; the first text and severity win."""
    seen = F.struct(*_SEEN)
    r = items.groupBy("project", "rule_id").agg(F.min(seen).alias("_seen"), F.min_by(F.struct("rule_text", "severity"), seen).alias("_r"),
                                               F.count("*").alias("results"))
    w = W.partitionBy("project").orderBy("_seen")  # one row per rule by now
    return r.select("project", "rule_id", (F.row_number().over(w) - 1).alias("rule_index"), F.col("_r.rule_text").alias("description"),
                    level(F.col("_r.severity")).alias("level"), "results")


def sarif_results(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Results with their rule's index; a rule with very many results is split."""
    r = rules.select("project", "rule_id", "rule_index", "results")
    return skew.join_groups(items, r, ["project", "rule_id"], "file_path", "results").select(
        "project", "rule_id", "rule_index", level("severity").alias("level"), "message", F.col("file_path").alias("uri"),
        F.col("line_number").alias("start_line"))


def sarif_document(results: DataFrame, rules: DataFrame, document_rows: int, tool: str = "tesserine") -> DataFrame:
    """2.1.0 documents per project, as many parts as its results need; each part is complete in itself."""
    n = results.groupBy("project").agg(F.count("*").alias("_n"), F.ceil(F.count("*") / document_rows).cast("int").alias("parts"))
    row = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
                                  F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))
    part = F.pmod(F.xxhash64("uri", "start_line", "rule_id"), F.col("parts")).cast("int")
    body = (skew.join_groups(results, n, "project", "uri", "_n").withColumn("part", part).groupBy("project", "part", "parts")
            .agg(F.array_sort(F.collect_list(row)).alias("results")))
    rule = F.struct(F.col("rule_index").alias("index"), F.col("rule_id").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription"),
                    F.struct(F.col("level").alias("level")).alias("defaultConfiguration"),
                    F.struct(F.array(F.lit("maintainability")).alias("tags")).alias("properties"))
    head = rules.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(rule)), lambda r: r.dropFields("index")).alias("rules"))
    doc = F.struct(
        F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"),
        F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules").alias("rules")).alias("driver")).alias("tool"),
                         F.col("results").alias("results"),
                         F.array(F.struct(F.lit(True).alias("executionSuccessful"))).alias("invocations"))).alias("runs"))
    return body.join(head, "project").select("project", "part", "parts", F.size("results").alias("result_count"),
                                             F.size("rules").alias("rule_count"), F.to_json(doc).alias("document"))


def heatmap_rows(report: DataFrame, functions: DataFrame) -> DataFrame:
    """Per file: metrics, ratio of comments to code, and its functions as an array."""
    fn = functions.groupBy("project", "file_path").agg(
        F.array_sort(F.collect_list(F.struct("start_line", "name", "end_line", F.col("cyclomatic"), "nesting", "loc", F.size("parameters").alias("params")))).alias("function_rows"),
        F.max("nesting").alias("nesting_depth"))
    j = report.join(fn, ["project", "file_path"], "left")
    return j.select(
        "project", F.element_at(F.split("file_path", "/"), -1).alias("file"), "file_path", "total_lines", "cyclomatic", "cognitive",
        F.coalesce("nesting_depth", F.lit(0)).alias("nesting_depth"), F.col("lines_of_code").alias("loc"),
        F.round(F.col("comment_lines") / F.greatest(F.col("lines_of_code"), F.lit(1)), 6).alias("comment_ratio"),
        F.col("functions").alias("function_count"), F.col("classes").alias("class_count"), F.col("smells").alias("smell_count"),
        F.coalesce("function_rows", F.array()).alias("function_rows"))


def _steps(a: Column, b: Column, cuts: list[tuple[str, int, int]]) -> Column:
    out = None
    for name, x, y in cuts:
        hit = (a > x) | (b > y)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("info")


def severity_file(cyclomatic: Column, smells: Column) -> Column:
    return _steps(cyclomatic, smells, [("critical", 30, 10), ("high", 15, 5), ("medium", 8, 2)])


def severity_class(max_method: Column, smells: Column) -> Column:
    return _steps(max_method, smells, [("critical", 15, 5), ("high", 10, 2), ("medium", 5, 0)])


def severity_function(cyclomatic: Column) -> Column:
    return F.when(cyclomatic > 15, "critical").when(cyclomatic > 10, "high").when(cyclomatic > 5, "medium").otherwise("info")


def worst_severity(smells: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), F.col("severity")), F.lit(4))
    worst = F.min_by(F.when(rank < 4, F.col("severity")).otherwise("info"), rank)
    return smells.groupBy(*keys).agg(worst.alias("worst_severity"), F.count("*").alias("smells"))


def report_tree(report: DataFrame, imports: DataFrame, functions: DataFrame, classes: DataFrame, smells: DataFrame) -> DataFrame:
    """file -> imports, classes with methods, plain functions, smells, as one JSON per file."""
    key = ["project", "file_path"]
    node = F.struct("start_line", "name", "end_line", "cyclomatic", "nesting", "loc", "parameters", "return_type", "is_async", "is_static",
                    severity_function(F.col("cyclomatic")).alias("severity"))
    fn = functions.where(F.coalesce("parent_kind", F.lit("")) != "class").groupBy(*key).agg(F.array_sort(F.collect_list(node)).alias("functions"))
    methods = functions.where(F.col("parent_kind") == "class").groupBy(*key, F.col("parent_line").alias("class_line")).agg(
        F.array_sort(F.collect_list(node)).alias("methods"))
    cls = classes.withColumnRenamed("methods", "_names").withColumn("class_line", F.col("start_line")).join(methods, [*key, "class_line"], "left")
    cl = cls.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        "start_line", "name", "end_line", "inheritance_depth", F.coalesce("methods", F.array()).alias("methods")))).alias("classes"))
    im = imports.groupBy(*key).agg(F.array_sort(F.collect_list("module")).alias("imports"))
    sm = smells.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line_number", "name", "severity", "description", "suggestion"))).alias("smells"))
    j = report.withColumnRenamed("functions", "n_f").withColumnRenamed("classes", "n_c").withColumnRenamed("smells", "n_s")
    for part in (im, cl, fn, sm):
        j = j.join(part, key, "left")
    tree = F.struct(
        F.element_at(F.split("file_path", "/"), -1).alias("name"), F.lit("file").alias("type"),
        severity_file(F.col("cyclomatic"), F.col("n_s")).alias("severity"), "total_lines",
        F.struct("cyclomatic", "cognitive", F.col("lines_of_code").alias("loc"), F.col("comment_lines").alias("comments"),
                 F.col("blank_lines").alias("blank")).alias("metrics"),
        "imports", "classes", "functions", "smells")
    return j.select(*key, F.to_json(tree).alias("tree"))
