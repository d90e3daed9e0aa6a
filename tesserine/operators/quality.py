"""Quality scores: plain column expressions over the eleven metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def _floor0(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def _band(x: Column, cuts: list[int], slope: int) -> Column:
    a, b, d = cuts
    return F.when(x <= a, 100.0).when(x <= b, 80.0).when(x <= d, 60.0).otherwise(_floor0(100.0 - (x - d) * slope))


def complexity() -> Column:
    return (_band(c("cyclomatic_complexity"), [5, 10, 15], 5) + _band(c("cognitive_complexity"), [10, 20, 30], 2)) / 2


def maintainability() -> Column:
    index = F.least(F.lit(100.0), _floor0(c("maintainability_index")))
    return (_floor0(100.0 - c("code_smells") * 5) * 0.3 + _floor0(100.0 - c("duplication_ratio") * 100) * 0.3
            + c("documentation_ratio") * 100 * 0.2 + index * 0.2)


def reliability() -> Column:
    cov = c("test_coverage")
    pct = F.when((cov <= 1.5) & (cov >= 0), cov * 100).otherwise(F.least(F.lit(100.0), _floor0(cov)))
    return pct * 0.6 + _floor0(100.0 - c("technical_debt") * 10) * 0.4


def security() -> Column:
    return _floor0(100.0 - F.floor(c("code_smells") / 2) * 10)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


# FIXED VALUES: thresholds and messages of the recommendations.
ADVICE = [
    ("cyclomatic_complexity > 10", "cyclomatic_complexity", 1, "圈复杂度过高 (%.1f)，建议重构函数，拆分为更小的函数"),
    ("cognitive_complexity > 20", "cognitive_complexity", 1, "认知复杂度过高 (%.1f)，建议简化逻辑，提高代码可读性"),
    ("code_smells > 5", "code_smells", 1, "发现 %d 个代码坏味道，建议进行代码审查和重构"),
    ("duplication_ratio > 0.1", "duplication_ratio", 100, "重复代码比例过高 (%.1f%%)，建议提取公共代码到共享模块"),
    ("test_coverage < 0.7", "test_coverage", 100, "测试覆盖率不足 (%.1f%%)，建议增加单元测试"),
    ("documentation_ratio < 0.5", "documentation_ratio", 100, "文档覆盖率不足 (%.1f%%)，建议添加更多代码注释和文档"),
    ("technical_debt > 0.5", "technical_debt", 1, "技术债务较高 (%.1f)，建议优先处理高优先级的技术债务"),
]


def recommendations() -> Column:
    items = [F.when(F.expr(cond), F.format_string(text, c(col) * scale if scale != 1 else c(col))) for cond, col, scale, text in ADVICE]
    return F.array_compact(F.array(*items))


def quality_score(metrics: DataFrame) -> DataFrame:
    cap = lambda x: F.least(F.lit(100.0), x)
    s = (metrics.withColumn("complexity_score", cap(complexity())).withColumn("maintainability_score", cap(maintainability()))
         .withColumn("reliability_score", cap(reliability())).withColumn("security_score", cap(security())))
    total = cap(c("complexity_score") * 0.25 + c("maintainability_score") * 0.35 + c("reliability_score") * 0.25 + c("security_score") * 0.15)
    return s.withColumn("overall_score", total).withColumn("grade", grade(F.round(c("overall_score"), 9)))


def metrics_extract(report: DataFrame, functions: DataFrame) -> DataFrame:
    """Per project: mean function complexity, smells and lines summed, defaults elsewhere."""
    f = functions.where(c("cyclomatic") > 0).groupBy("project").agg(F.avg("cyclomatic").alias("cc"))
    r = report.groupBy("project").agg(F.sum("smells").alias("code_smells"), F.sum("lines_of_code").alias("lines_of_code"))
    return r.join(f, "project", "left").select(
        "project", F.coalesce("cc", F.lit(0.0)).alias("cyclomatic_complexity"), F.lit(0.0).alias("cognitive_complexity"),
        "code_smells", F.lit(0.0).alias("duplication_ratio"), F.lit(0.0).alias("test_coverage"), F.lit(0.0).alias("documentation_ratio"),
        "lines_of_code", F.lit(75.0).alias("maintainability_index"), F.lit(0.0).alias("technical_debt"))


def symbol_quality(symbols: DataFrame, smells: DataFrame) -> DataFrame:
    """``symbols``: project, file_path, name, kind, line_start, cyclomatic (null for classes)."""
    off = F.when(c("severity") == "critical", 20).when(c("severity") == "high", 15).when(c("severity") == "medium", 10).when(c("severity") == "low", 5).otherwise(0)
    s = (smells.where(c("owner_kind").isin("function", "class"))
         .groupBy("project", "file_path", c("owner_kind").alias("kind"), c("line_number").alias("line_start")).agg(F.sum(off).alias("_smell")))
    cc = c("cyclomatic")
    loss = F.when(cc > 10, F.least(F.lit(20), (cc - 10) * 2)).when(cc > 5, (cc - 5) * 2).otherwise(0)
    q = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - loss - F.coalesce("_smell", F.lit(0))))
    return symbols.join(s, ["project", "file_path", "kind", "line_start"], "left").withColumn("quality_score", q).drop("_smell")
