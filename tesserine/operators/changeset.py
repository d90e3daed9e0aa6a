"""Unified diffs. A diff is one row; its file sections are cut inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import DIFF_EXTENSIONS


def _sections(diffs: DataFrame) -> DataFrame:
    """(change_id, file_no, lines) per file; text before the first header is dropped."""
    cut = F.split("diff_text", r"(?m)^(?=diff --git)", -1)
    parts = F.filter(cut, lambda s: s.startswith("diff --git"))
    keep = [c for c in ("project", "change_id") if c in diffs.columns]
    return diffs.select(*keep, F.posexplode(parts).alias("file_no", "_s")).select(
        *keep, (F.col("file_no") + 1).alias("file_no"), F.split("_s", "\n", -1).alias("_l"))


def _path() -> Column:
    head = F.element_at("_l", 1)
    return F.when(F.contains(head, F.lit(" b/")), tx.strip(F.substring_index(head, " b/", -1))).otherwise(
        F.regexp_extract(head, r"(\S+)\s*$", 1))


def diff_files(diffs: DataFrame) -> DataFrame:
    marks = {"new file": "added", "deleted file": "deleted", "rename from": "renamed"}

    def kind(x):
        out = F.lit(None).cast("string")
        for mark, name in marks.items():
            out = F.when(x.startswith(mark), name).otherwise(out)
        return out

    last = F.try_element_at(F.array_compact(F.transform("_l", kind)), F.lit(-1))
    count = lambda ch: F.size(F.filter("_l", lambda x: x.startswith(ch) & ~x.startswith(ch * 3)))
    sections = _sections(diffs)
    return sections.select(*[c for c in ("project",) if c in sections.columns], "change_id", "file_no", _path().alias("file_path"), F.coalesce(last, F.lit("modified")).alias("change_type"),
                                   count("+").alias("additions"), count("-").alias("deletions"))


HUNK = r"^@@ *-(\d+)(?:,(\d+))? *\+(\d+)(?:,(\d+))? *@@"


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """A missing count is 1; headers that do not parse are skipped."""
    g = lambda x, i: F.regexp_extract(x, HUNK, i)
    heads = F.filter("_l", lambda x: x.startswith("@@") & x.rlike(HUNK))
    rows = F.transform(heads, lambda x, i: F.struct(
        (i + 1).alias("hunk_no"), g(x, 1).cast("int").alias("old_start"), F.coalesce(F.nullif(g(x, 2), F.lit("")), F.lit("1")).cast("int").alias("old_lines"),
        g(x, 3).cast("int").alias("new_start"), F.coalesce(F.nullif(g(x, 4), F.lit("")), F.lit("1")).cast("int").alias("new_lines")))
    return _sections(diffs).select("change_id", "file_no", _path().alias("file_path"), F.explode(rows).alias("h")).select(
        "change_id", "file_no", "file_path", "h.*")


def changed_file_list(listing: DataFrame, text: str) -> DataFrame:
    names = F.filter(F.transform(F.split(text, "\n", -1), lambda x: tx.strip(x)), lambda x: x != "")
    return listing.select(*[c for c in listing.columns if c != text], F.explode(names).alias("file_path"))


def diff_join_metrics(diffs: DataFrame, report: DataFrame) -> DataFrame:
    """Changed code files that still exist, with their metrics. The diffs carry their project: a path alone is not a file."""
    d = diff_files(diffs).where((F.col("change_type") != "deleted") & tx.extension("file_path").isin(DIFF_EXTENSIONS))
    m = report.select("project", "file_path", "functions", "classes", F.col("smells").alias("code_smells"), F.col("cyclomatic").alias("complexity"))
    return d.join(m, ["project", "file_path"])


def risk(smells: Column, complexity: Column, additions: Column) -> Column:
    per50 = lambda x: F.try_divide(x, additions / 50)
    return (F.when(additions == 0, "low").when((per50(smells) > 3) | (per50(complexity) > 15), "high")
            .when((per50(smells) > 1.5) | (per50(complexity) > 8), "medium").otherwise("low"))


def recommendation(smells: Column, files_with: Column, additions: Column) -> Column:
    minor = F.format_string("Minor issues: %d code smell(s) in %d file(s). Consider quick review.", smells, files_with)
    major = F.format_string("Significant issues: %d code smell(s) in %d file(s). Thorough review recommended.", smells, files_with)
    text = F.concat_ws(" ", F.when(smells == 0, "No code smells detected in changed files.").when(smells <= 3, minor).otherwise(major),
                       F.when(additions > 500, "Large PR (>500 additions). Consider splitting into smaller PRs."))
    return F.when(additions == 0, "No code additions in this PR.").otherwise(text)


def diff_assessment(diffs: DataFrame, report: DataFrame) -> DataFrame:
    """Per change of a project; equal ids in two projects are two changes."""
    key = ["project", "change_id"]
    all_files = diff_files(diffs).groupBy(*key).agg(
        F.count("*").alias("total_files"), F.sum("additions").alias("total_additions"), F.sum("deletions").alias("total_deletions"))
    a = diff_join_metrics(diffs, report).groupBy(*key).agg(
        F.count("*").alias("files_analyzed"), F.sum("code_smells").alias("total_code_smells"), F.sum("complexity").alias("total_complexity"),
        F.count_if(F.col("code_smells") > 0).alias("files_with_smells"))
    j = all_files.join(a, key, "left").na.fill(0)
    s, x, n = F.col("total_code_smells"), F.col("total_complexity"), F.col("total_additions")
    return j.withColumn("risk_level", risk(s, x, n)).withColumn("recommendation", recommendation(s, F.col("files_with_smells"), n))
