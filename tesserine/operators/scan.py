"""Rule scans over source text.

A file is one row, so a scan needs no shuffle: the rule table is small and known when
the plan is built, every pattern becomes a literal, and only hits leave the file's row.
Before any regex runs, a byte search for the pattern's certain literal decides whether
the file (then the line) can match at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import Rule, SEVERITY_RANK, SEVERITY_WEIGHT
from .tops import first_per

SEPARATE = "\\n"


def is_multiline(pattern: str) -> bool:
    return SEPARATE in pattern


def language_match(languages: list[str], ext_no_dot: Column) -> Column:
    return F.lit(True) if "all" in languages else ext_no_dot.isin(languages)


def rule_language_match(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, rule) pairs where the rule applies; ``rules`` is the fixed small table."""
    ext = F.regexp_replace(tx.extension("file_path"), r"^\.", "")
    want = rules.select("rule_set", "rule_id", F.explode("languages").alias("_want"))
    keyed = files.withColumn("_want", F.explode(F.array(F.lit("all"), ext)))
    return keyed.join(want, "_want").drop("_want")


def rules_frame(spark, rules: list[Rule]) -> DataFrame:
    schema = ("rule_set string, rule_id string, name string, category string, severity string, languages array<string>, "
              "patterns array<string>, description string, suggestion string, effort_hours double, improvement string, "
              "enabled boolean")
    return spark.createDataFrame([tuple(r) for r in rules], schema)


def _hits(rule: Rule, pattern: str, tag: int) -> str:
    """array<struct<tag,n,line>> of one pattern, null when the file cannot match.

    Built as SQL text: a rule set is some hundred small expressions, and one parse in the
    JVM is far cheaper than as many calls into it.
    """
    lit, rx = tx.sql_text(tx.needle(pattern)), tx.sql_text(tx.regex(pattern))
    gates = [] if "all" in rule.languages else [f"_e IN ({', '.join(tx.sql_text(x) for x in rule.languages)})"]
    line = f"x.line RLIKE {rx}"
    if lit != "''":
        gates.append(f"contains(content, {lit})")
        line = f"contains(x.line, {lit}) AND {line}"
    found = f"transform(filter(_l, x -> {line}), x -> named_struct('tag', {tag}, 'n', x.n, 'line', x.line))"
    return f"CASE WHEN {' AND '.join(gates)} THEN {found} END" if gates else found


def scan_lines(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per (rule, pattern, line) that matches."""
    tags = [(r, i, p) for r in rules if r.enabled for i, p in enumerate(r.patterns) if not is_multiline(p)]
    spark = files.sparkSession
    keep = [c for c in files.columns if c not in ("content", "ext")]
    ext = F.regexp_replace(tx.extension("file_path"), r"^\.", "")
    base = files.select(*keep, "content", ext.alias("_e"), tx.numbered("content").alias("_l"))
    parts = ", ".join(_hits(r, p, k) for k, (r, _, p) in enumerate(tags))
    found = base.select(*keep, F.explode(F.expr(f"flatten(array_compact(array({parts})))")).alias("_h"))
    meta = [(k, r.rule_set, r.rule_id, i, r.name, r.category, r.severity, SEVERITY_WEIGHT[r.severity],
             SEVERITY_RANK[r.severity], r.description, r.suggestion, r.effort_hours, r.improvement)
            for k, (r, i, _) in enumerate(tags)]
    meta_df = spark.createDataFrame(
        meta, "_tag int, rule_set string, rule_id string, pattern_idx int, rule_name string, category string, "
              "severity string, weight double, rank int, description string, suggestion string, effort_hours double, "
              "improvement string")
    flat = found.select(*keep, F.col("_h.tag").alias("_tag"), F.col("_h.n").alias("line_number"),
                        tx.strip(F.col("_h.line")).alias("line_content"))
    return flat.join(F.broadcast(meta_df), "_tag").drop("_tag")


def scan_top(findings: DataFrame, n: int) -> DataFrame:
    """The n worst of each project, ties broken by place."""
    return first_per(findings, "project", ["rank", "file_path", "line_number", "rule_id", "pattern_idx"], n)


def scan_multiline(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Opt-in: patterns that span lines, searched in the whole text. The line is where the match starts."""
    keep = [c for c in files.columns if c not in ("content", "ext")]
    ext = F.regexp_replace(tx.extension("file_path"), r"^\.", "")
    c = F.col("content")
    parts = []
    for r in rules:
        for i, p in enumerate(r.patterns):
            if not is_multiline(p):
                continue
            rx, lit = tx.regex(p), tx.needle(p)
            # pieces between matches; the k-th match starts after pieces 0..k and matches 0..k-1
            pieces, hits = F.split(c, rx, -1), F.regexp_extract_all(c, F.lit(rx), F.lit(0))
            breaks = lambda a, k: F.aggregate(
                F.slice(a, 1, k), F.lit(0), lambda s, x: s + tx.line_count(x) - 1)
            rows = tx.let(F.struct(pieces.alias("p"), hits.alias("h")), lambda v: F.transform(v["h"], lambda h, k: F.struct(
                F.lit(r.rule_set).alias("rule_set"), F.lit(r.rule_id).alias("rule_id"), F.lit(i).alias("pattern_idx"),
                (breaks(v["p"], k + 1) + breaks(v["h"], k) + 1).alias("line_number"))))
            ok = language_match(r.languages, F.col("_e"))
            parts.append(F.when(ok & F.contains(c, F.lit(lit)) if lit else ok, rows))
    hits = F.flatten(F.filter(F.array(*parts), lambda a: a.isNotNull()))
    return files.withColumn("_e", ext).select(*keep, F.explode(hits).alias("h")).select(*keep, "h.*")


def eval_smell(files: DataFrame) -> DataFrame:
    """``eval(`` on a line that is not a comment."""
    hits = F.filter(tx.numbered("content"),
                    lambda x: F.contains(x["line"], F.lit("eval(")) & ~tx.strip(x["line"]).startswith("#"))
    keep = [c for c in files.columns if c not in ("content", "ext")]
    return (files.where(F.contains("content", F.lit("eval("))).select(*keep, F.explode(hits).alias("h"))
            .select(*keep, F.col("h.n").alias("line_number"), tx.strip(F.col("h.line")).alias("line_content")))


def pattern_search(files: DataFrame, pattern: str, before: int = 0, after: int = 0, include: str | None = None,
                   exclude: str | None = None, code_only: bool = False, code_extensions: list[str] | None = None) -> DataFrame:
    """Regex search with context lines, inside each file's row."""
    if include:
        files = files.where(F.col("file_path").rlike(tx.glob_regex(include)))
    if exclude:
        files = files.where(~F.col("file_path").rlike(tx.glob_regex(exclude)))
    if code_only:
        files = files.where(tx.extension("file_path").isin(code_extensions or []))
    rx, lit = tx.regex(pattern), tx.needle(pattern)
    if lit:
        files = files.where(F.contains("content", F.lit(lit)))
    keep = [c for c in files.columns if c not in ("content", "ext")]
    base = files.select(*keep, tx.numbered("content").alias("_l"))
    hits = F.filter("_l", lambda x: x["line"].rlike(rx))

    def context(h):
        first = F.greatest(h["n"] - before, F.lit(1))
        return F.transform(F.slice(F.col("_l"), first, h["n"] + after - first + 1), lambda x: x["line"])

    rows = F.transform(hits, lambda h: F.struct(h["n"].alias("line_number"), h["line"].alias("line"),
                                                context(h).alias("context")))
    return base.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def pattern_counts(files: DataFrame, language: Column, patterns: dict[str, dict[str, str]]) -> DataFrame:
    """Lines that match each language's patterns, all files."""
    flat = [(lang, kind, p) for lang, kinds in patterns.items() for kind, p in kinds.items()]
    base = files.select(language.alias("language"), F.split("content", "\n", -1).alias("_l"))
    base = base.where(F.col("language").isNotNull())
    counts = [F.when(F.col("language") == lang, F.size(F.filter("_l", lambda x: x.rlike(tx.regex(p))))) for lang, _, p in flat]
    kinds = sorted({k for _, k, _ in flat})
    per = base.select("language", *[
        F.coalesce(*[c for c, (_, k, _) in zip(counts, flat) if k == kind]).alias(kind) for kind in kinds])
    agg = per.groupBy("language").agg(*[F.sum(k).alias(k) for k in kinds], F.count("*").alias("files"))
    return agg.unpivot(["language", "files"], kinds, "kind", "match_count")


def hotspot_keywords(files: DataFrame, words: list[str]) -> DataFrame:
    rx = tx.regex(rf"\b({'|'.join(words)})\b")
    py = files.where(F.col("file_path").endswith(".py"))
    scored = py.select("project", "file_path", F.regexp_count("content", F.lit(rx)).alias("estimated_complexity"),
                       tx.line_count("content").alias("lines"))
    dens = F.col("estimated_complexity") / F.col("lines")
    return (scored.where((F.col("estimated_complexity") > 10) | (dens > 0.1))
            .withColumn("density", tx.round_even(dens, 3)))
