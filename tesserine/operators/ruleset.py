"""The threshold rule table and its configuration, as DataFrames."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import STRUCTURE, STRUCTURE_SCHEMA


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in STRUCTURE], STRUCTURE_SCHEMA)


def custom_rules_add(rules: DataFrame, custom: DataFrame) -> DataFrame:
    """Upsert by id; the custom row wins."""
    return rules.join(custom.select("rule_id"), "rule_id", "left_anti").unionByName(custom)


def custom_rules_remove(rules: DataFrame, ids: list[str]) -> DataFrame:
    return rules.where(~F.col("rule_id").isin(ids)) if ids else rules


def _overlay(spark: SparkSession, config: dict) -> DataFrame:
    off, limit, sev = (config.get(k) or d for k, d in (("disabled_rules", []), ("thresholds", {}), ("severities", {})))
    ids = sorted({*off, *limit, *sev})
    return spark.createDataFrame([(i, i in off, limit.get(i), sev.get(i)) for i in ids],
                                 "rule_id string, _off boolean, _threshold int, _severity string")


def rules_config_apply(rules: DataFrame, config: dict) -> DataFrame:
    """Disable, re-threshold, re-rank, then upsert the custom rules (last one of an id wins)."""
    spark, cols = rules.sparkSession, rules.columns
    out = (rules.join(F.broadcast(_overlay(spark, config)), "rule_id", "left")
           .withColumn("enabled", F.col("enabled") & ~F.coalesce("_off", F.lit(False)))
           .withColumn("threshold", F.coalesce("_threshold", "threshold"))
           .withColumn("severity", F.coalesce("_severity", "severity")).select(*cols))
    last = {r["rule_id"]: r for r in config.get("custom_rules") or []}
    if not last:
        return out
    base = {"description": "", "category": "maintainability", "severity": "medium", "language": "all", "enabled": True,
            "threshold": None, "suggestion": "", "tags": []}
    rows = [tuple({**base, **r}.get(c) for c in cols) for r in last.values()]
    return custom_rules_add(out, spark.createDataFrame(rows, STRUCTURE_SCHEMA))


def rules_enabled(rules: DataFrame, category: str | None = None, language: str | None = None) -> DataFrame:
    out = rules.where("enabled")
    if category:
        out = out.where(F.col("category") == category)
    return out.where(F.col("language").isin("all", language)) if language else out


def rules_by_category(rules: DataFrame) -> DataFrame:
    return rules.where("enabled").groupBy("category").agg(F.array_sort(F.collect_list("rule_id")).alias("rule_ids"))


def rules_summary(rules: DataFrame) -> DataFrame:
    """(dimension, value, rules): totals and the enabled counts by category and severity."""
    total = rules.agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"))
    head = total.unpivot([], ["total", "enabled", "disabled"], "value", "rules").select(F.lit("rules").alias("dimension"), "value", "rules")
    on = rules.where("enabled")
    for dim in ("category", "severity"):
        head = head.unionByName(on.groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("rules"))
                                .select(F.lit(dim).alias("dimension"), "value", "rules"))
    return head


def rules_config_export(rules: DataFrame, builtins: DataFrame) -> DataFrame:
    """One row of JSON a later ``rules_config_apply`` accepts."""
    extra = builtins.select("rule_id", F.lit(True).alias("_builtin"))
    r = rules.join(extra, "rule_id", "left")
    pick = lambda cond, v: F.array_sort(F.collect_list(F.when(cond, v)))
    return r.agg(F.to_json(F.struct(
        pick(~F.col("enabled"), F.col("rule_id")).alias("disabled_rules"),
        F.map_from_entries(pick(F.col("threshold").isNotNull(), F.struct("rule_id", "threshold"))).alias("thresholds"),
        pick(F.col("_builtin").isNull(), F.struct(*builtins.columns)).alias("custom_rules"))).alias("config_json"))


def rules_config_save(exported: DataFrame, path: str) -> None:
    """Write an exported configuration as text, to whatever store the path names."""
    exported.select("config_json").coalesce(1).write.mode("overwrite").text(path)


def rules_config_load(spark: SparkSession, path: str) -> dict:
    """The configuration for ``rules_config_apply``; a path that is not there is an empty one."""
    try:
        found = spark.read.option("wholetext", True).text(path).collect()  # one row: a table of rules
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return json.loads("".join(r.value for r in found) or "{}")


def threshold_violations(values: DataFrame, rules: DataFrame) -> DataFrame:
    """``values`` has a ``rule_id`` and a ``value``; a null threshold never fires."""
    r = rules.where("enabled AND threshold IS NOT NULL").select(
        "rule_id", F.col("name").alias("rule_name"), "severity", "category", "threshold", "description", "suggestion")
    return values.join(r, "rule_id").where(F.col("value") > F.col("threshold"))
