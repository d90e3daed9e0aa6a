"""Structure smells: threshold violations of functions and classes, plus two text rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ruleset, scan, structure

_OUT = ["project", "file_path", "line_number", "owner_kind", "owner", "name", "severity", "description", "suggestion"]


def _owners(files: DataFrame) -> DataFrame:
    """(owner, rule_id, value) of every function and class, from one fold of the file."""
    keep = ["project", "file_path"]
    base = structure.python_code(files).select(*keep, structure.outline_column(F.col("content")).alias("_o"))

    def row(h, kind, values):
        pairs = F.array(*[F.struct(F.lit(r).alias("rule_id"), v.cast("int").alias("value")) for r, v in values.items()])
        return F.struct(F.lit(kind).alias("owner_kind"), h["name"].alias("owner"), h["start_line"].alias("line_number"), pairs.alias("pairs"))

    loc = lambda h: h["end_line"] - h["start_line"] + 1
    of = lambda k: F.filter("_o", lambda h: h["kind"] == k)
    functions = F.transform(of("def"), lambda h: row(h, "function", {
        "COMPLEX001": loc(h), "COMPLEX005": F.size(structure.parameters(h["text"])), "COMPLEX002": h["cyclomatic"], "COMPLEX003": h["nesting"]}))
    classes = F.transform(of("class"), lambda h: row(h, "class", {
        "COMPLEX004": loc(h), "DESIGN001": F.size(structure.bases(h["text"])), "DESIGN002": F.size(structure.direct_methods(F.col("_o"), h))}))
    rows = base.select(*keep, F.explode(F.concat(functions, classes)).alias("r")).select(*keep, "r.*")
    return rows.select(*keep, "owner_kind", "owner", "line_number", F.explode("pairs").alias("m")).select("*", "m.*").drop("m")


def structure_smells(files: DataFrame, rules: DataFrame) -> DataFrame:
    v = ruleset.threshold_violations(_owners(files), rules)
    text = F.format_string("%s '%s': %s (current: %d, threshold: %d)", F.initcap("owner_kind"), "owner", "description", "value", "threshold")
    return v.select("project", "file_path", "line_number", "owner_kind", "owner", F.col("rule_name").alias("name"), "severity",
                    text.alias("description"), "suggestion")


def function_smells(files: DataFrame, rules: DataFrame) -> DataFrame:
    return structure_smells(files, rules).where(F.col("owner_kind") == "function")


def class_smells(files: DataFrame, rules: DataFrame) -> DataFrame:
    return structure_smells(files, rules).where(F.col("owner_kind") == "class")


def eval_smells(files: DataFrame, rules: DataFrame) -> DataFrame:
    r = rules.where("rule_id = 'SEC001' AND enabled").select("rule_id", "name", "severity", "description", "suggestion")
    hits = scan.eval_smell(structure.python_files(files)).select("project", "file_path", "line_number", F.lit("file").alias("owner_kind"), F.lit("").alias("owner"), F.lit("SEC001").alias("rule_id"))
    return hits.join(r, "rule_id").drop("rule_id")


def long_functions(files: DataFrame) -> DataFrame:
    return structure.long_function_js(files).select(
        "project", "file_path", "line_number", F.lit("file").alias("owner_kind"), F.lit("").alias("owner"),
        F.lit("Long Function").alias("name"), F.lit("medium").alias("severity"),
        F.format_string("Function has %d lines", "lines").alias("description"),
        F.lit("Consider breaking this function into smaller functions").alias("suggestion"))


def all_smells(files: DataFrame, rules: DataFrame) -> DataFrame:
    parts = [structure_smells(files, rules), eval_smells(files, rules), long_functions(files)]
    return reduce(DataFrame.unionByName, [p.select(*_OUT) for p in parts])
