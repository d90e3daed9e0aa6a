"""Rule configuration and line-pattern scans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from ..functions import rules as rl
from ..operators import files as fl
from ..operators import ruleset, scan, scores, structure
from ..session import scratch_path
from .base import lang, q, query, re2, view

CONFIG = {
    "disabled_rules": ["COMPLEX005", "NAMING001"], "thresholds": {"COMPLEX001": 30, "COMPLEX002": 5}, "severities": {"COMPLEX003": "critical"},
    "custom_rules": [{"rule_id": "CUSTOM001", "name": "Many Comments", "description": "d", "category": "maintainability", "severity": "low",
                      "threshold": 8, "suggestion": "s", "tags": ["x"]}],
}
METRIC_RULES = {"COMPLEX001": "lines_of_code", "COMPLEX002": "cyclomatic_complexity", "COMPLEX003": "cognitive_complexity",
                "COMPLEX005": "comment_lines", "DESIGN002": "code_smells", "CUSTOM001": "comment_lines"}
view("v_values", " UNION ALL ".join(f"SELECT key, {q(r)} AS rule_id, ({m})::int AS value FROM v_metrics" for r, m in METRIC_RULES.items()))
view("v_rules_cfg", """SELECT rule_id, name, description, category, CASE WHEN rule_id = 'COMPLEX003' THEN 'critical' ELSE severity END AS severity, language,
  rule_id NOT IN ('COMPLEX005', 'NAMING001') AS enabled, CASE rule_id WHEN 'COMPLEX001' THEN 30 WHEN 'COMPLEX002' THEN 5 ELSE threshold END AS threshold, suggestion FROM v_rules
  UNION ALL SELECT 'CUSTOM001', 'Many Comments', 'd', 'maintainability', 'low', 'all', true, 8, 's'""")


def _values(t):
    pairs = F.array(*[F.struct(F.lit(r).alias("rule_id"), col(m).cast("int").alias("value")) for r, m in METRIC_RULES.items()])
    return t.metrics.select("key", F.explode(pairs).alias("p")).select("key", "p.*")


def _effective(t):
    return ruleset.rules_config_apply(ruleset.builtin(t.spark), CONFIG)


def _fired(t, rules):
    """Violations per rule over all metrics."""
    return ruleset.threshold_violations(_values(t), rules).groupBy("rule_id").agg(F.count("*").alias("violations"))


_FIRED = "(SELECT v.rule_id, count(*) AS violations FROM v_values v JOIN {r} r USING (rule_id) WHERE r.enabled AND v.value > r.threshold GROUP BY 1)"


@query("rules_config_apply", f"SELECT rule_id, r.enabled, r.threshold, r.severity, coalesce(violations, 0) AS violations FROM v_rules_cfg r LEFT JOIN {_FIRED.format(r='v_rules_cfg')} f USING (rule_id)")
def _(t):
    r = _effective(t)
    return r.select("rule_id", "enabled", "threshold", "severity").join(_fired(t, r), "rule_id", "left").na.fill(0, ["violations"])


@query("rules_enabled", f"""SELECT l.language, r.category, count(*) AS rules, max(l.files) AS files FROM (SELECT {lang('ext', 'analyzer')} AS language, count(*) AS files FROM v_corpus GROUP BY 1) l
  JOIN v_rules_cfg r ON r.enabled AND r.language IN ('all', l.language) GROUP BY 1, 2""")
def _(t):
    langs = t.corpus.select(fl.language("file_path").alias("language")).groupBy("language").agg(F.count("*").alias("files"))
    r = ruleset.rules_enabled(_effective(t)).select("category", "rule_id", col("language").alias("want"))
    keyed = langs.withColumn("want", F.explode(F.array(F.lit("all"), col("language"))))
    return keyed.join(F.broadcast(r), "want").groupBy("language", "category").agg(F.count("*").alias("rules"), F.max("files").alias("files"))


@query("rules_by_category", f"""SELECT category, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids, sum(coalesce(violations, 0))::bigint AS violations
  FROM v_rules_cfg r LEFT JOIN {_FIRED.format(r='v_rules_cfg')} f USING (rule_id) WHERE r.enabled GROUP BY 1""")
def _(t):
    r = _effective(t)
    n = r.join(_fired(t, r), "rule_id", "left").groupBy("category").agg(F.sum(F.coalesce("violations", F.lit(0))).alias("violations"))
    return ruleset.rules_by_category(r).join(n, "category").select("category", F.array_join("rule_ids", ",").alias("rule_ids"), "violations")


@query("rules_summary", f"""WITH r AS (SELECT r.*, coalesce(violations, 0) AS v FROM v_rules_cfg r LEFT JOIN {_FIRED.format(r='v_rules_cfg')} f USING (rule_id))
  SELECT 'rules' AS dimension, 'total' AS value, count(*) AS rules, sum(v)::bigint AS violations FROM r
  UNION ALL SELECT 'rules', 'enabled', count(*) FILTER (enabled), sum(v)::bigint FROM r UNION ALL SELECT 'rules', 'disabled', count(*) FILTER (NOT enabled), 0 FROM r
  UNION ALL SELECT 'category', category, count(*), sum(v)::bigint FROM r WHERE enabled GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*), sum(v)::bigint FROM r WHERE enabled GROUP BY 2""")
def _(t):
    r = _effective(t)
    f = ruleset.rules_enabled(r).join(_fired(t, r), "rule_id")
    keys = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (
        ("rules", F.lit("total")), ("rules", F.lit("enabled")), ("category", col("category")), ("severity", col("severity")))])
    n = f.select(F.explode(keys).alias("k"), "violations").groupBy("k.dimension", "k.value").agg(F.sum("violations").alias("violations"))
    return ruleset.rules_summary(r).join(n, ["dimension", "value"], "left").na.fill(0, ["violations"])


@query("rules_config_export", f"""SELECT '{{"disabled_rules":[' || (SELECT string_agg('"' || rule_id || '"', ',' ORDER BY rule_id) FROM v_rules_cfg WHERE NOT enabled) || '],"thresholds":{{' ||
  (SELECT string_agg('"' || rule_id || '":' || threshold, ',' ORDER BY rule_id) FROM v_rules_cfg WHERE threshold IS NOT NULL) ||
  '}},"custom_rules":[{{"rule_id":"CUSTOM001","name":"Many Comments","description":"d","category":"maintainability","severity":"low","language":"all","enabled":true,"threshold":8,"suggestion":"s","tags":["x"]}}]}}' AS config_json,
  (SELECT sum(violations)::bigint FROM {_FIRED.format(r='v_rules_cfg')}) AS violations""")
def _(t):
    """The export, and what the rules find that are made from it when it is read back."""
    builtin, path = ruleset.builtin(t.spark), scratch_path(t.spark, "rules")
    out = ruleset.rules_config_export(_effective(t), builtin)
    ruleset.rules_config_save(out, path)
    n = _fired(t, ruleset.rules_config_apply(builtin, ruleset.rules_config_load(t.spark, path))).agg(F.sum("violations").alias("violations"))
    return out.select("config_json", n.scalar().alias("violations"))


@query("rule_language_match", f"""SELECT file_path, rule_id FROM v_corpus, (VALUES {', '.join(f"({q(r.rule_id)}, [{', '.join(q('.' + x) for x in r.languages)}])" for r in rl.SECURITY)}) r(rule_id, exts)
  WHERE list_contains(exts, '.all') OR list_contains(exts, ext)""")
def _(t):
    return scan.rule_language_match(t.corpus.select("file_path"), scan.rules_frame(t.spark, rl.SECURITY)).select("file_path", "rule_id")


@query("threshold_violations", "SELECT v.key, v.rule_id, r.name AS rule_name, r.severity, v.value, r.threshold, r.description, r.suggestion FROM v_values v JOIN v_rules r USING (rule_id) WHERE v.value > r.threshold")
def _(t):
    v = ruleset.threshold_violations(_values(t), ruleset.builtin(t.spark))
    return v.select("key", "rule_id", "rule_name", "severity", "value", "threshold", "description", "suggestion")


def _src(t):
    return t.corpus.select("project", "file_path", "content")


CUSTOM = rl.Rule("security", "CUSTOM001", "Custom", "custom", "low", ["all"], [r"return\s+\d+", r"class \w+\("], "custom")


@query("custom_rules_add", f"""SELECT rule_id, pattern_idx, count(*) AS hits FROM (SELECT rule_id, pattern_idx FROM v_security UNION ALL SELECT 'CUSTOM001', 0 FROM v_lines WHERE regexp_matches(line, {re2(CUSTOM.patterns[0])})
  UNION ALL SELECT 'CUSTOM001', 1 FROM v_lines WHERE regexp_matches(line, {re2(CUSTOM.patterns[1])})) GROUP BY 1, 2""")
def _(t):
    return scan.scan_lines(_src(t), [*rl.SECURITY, CUSTOM]).groupBy("rule_id", "pattern_idx").agg(F.count("*").alias("hits"))


@query("custom_rules_remove", "SELECT rule_id, count(*) AS hits FROM v_security WHERE rule_id NOT IN ('SEC001', 'SEC010') GROUP BY 1")
def _(t):
    keep = [r for r in rl.SECURITY if r.rule_id not in ("SEC001", "SEC010")]
    return scan.scan_lines(_src(t), keep).groupBy("rule_id").agg(F.count("*").alias("hits"))


_F = ["project", "file_path", "line_number", "line_content", "rule_id", "pattern_idx", "rule_name", "category", "severity", "description", "suggestion"]


@query("security_scan", f"SELECT {', '.join(_F)} FROM v_security")
def _(t):
    return scan.scan_lines(_src(t), rl.SECURITY).select(*_F)


@query("security_scan_topn", f"SELECT {', '.join(_F)} FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY rank, file_path, line_number, rule_id, pattern_idx) AS r FROM v_security) WHERE r <= 500")
def _(t):
    return scan.scan_top(scan.scan_lines(_src(t), rl.SECURITY), 500).select(*_F)


@query("performance_scan", f"SELECT {', '.join(_F)}, improvement FROM v_performance")
def _(t):
    return scan.scan_lines(_src(t), rl.PERFORMANCE).select(*_F, "improvement")


_D = scores.DEBT_COLUMNS


def debt_findings(t):
    return scan.scan_lines(_src(t), rl.DEBT)


@query("debt_scan", "SELECT project, category, rule_name AS name, file_path, line_number, description, effort_hours, severity AS priority FROM v_debt")
def _(t):
    return scores.debt_scan_items(debt_findings(t))


_LINES = "length(content) - length(replace(content, chr(10), '')) + 1"


def _large(limit: int) -> str:
    return f"""SELECT project, 'maintainability' AS category, 'Large File' AS name, file_path, 1 AS line_number, 'File has ' || n || ' lines (threshold: {limit})' AS description,
  round((n - {limit}) * 0.01::double, 2) AS effort_hours, CASE WHEN n < 1000 THEN 'medium' ELSE 'high' END AS priority FROM (SELECT *, {_LINES} AS n FROM v_corpus) WHERE n > {limit}"""


# No file of the test data passes 500 lines, so the check runs with a lower limit.
@query("debt_large_file", _large(40))
def _(t):
    return scores.debt_large_file(t.corpus, 40)


def file_metrics(t):
    c = _src(t)
    return structure.file_metrics_py(c).unionByName(structure.file_metrics_js(c))


view("v_file_metrics", "SELECT * FROM v_metrics_py UNION ALL SELECT * FROM v_metrics_js")
_CC = """SELECT project, 'complexity' AS category, 'High Cyclomatic Complexity' AS name, file_path, 1 AS line_number, 'Cyclomatic complexity is ' || cyclomatic || ' (threshold: 10)' AS description,
  (cyclomatic - 10) * 0.5::double AS effort_hours, CASE WHEN cyclomatic > 20 THEN 'high' ELSE 'medium' END AS priority FROM v_file_metrics WHERE cyclomatic > 10"""


@query("debt_complexity", _CC)
def _(t):
    return scores.debt_complexity(file_metrics(t))


view("v_debt_items", f"""SELECT project, category, rule_name AS name, file_path, line_number, description, effort_hours, severity AS priority FROM v_debt
  UNION ALL {_large(500)} UNION ALL {_CC}""")


def debt_items(t):
    return scores.debt_items(t.corpus, debt_findings(t), file_metrics(t))


@query("eval_smell", "SELECT file_path, line_number, line_content FROM v_eval")
def _(t):
    return scan.eval_smell(_src(t)).select("file_path", "line_number", "line_content")


def _multi() -> str:
    parts = []
    for r in [*rl.SECURITY, *rl.PERFORMANCE, *rl.DEBT]:
        for i, p in enumerate(r.patterns):
            if "\\n" not in p:
                continue
            where = "true" if "all" in r.languages else f"ext IN ({', '.join(q('.' + x) for x in r.languages)})"
            parts.append(f"SELECT project, file_path, {q(r.rule_set)} AS rule_set, {q(r.rule_id)} AS rule_id, {i} AS pattern_idx, len(regexp_extract_all(content, {re2(p)})) AS matches FROM v_corpus WHERE {where} AND regexp_matches(content, {re2(p)})")
    return " UNION ALL ".join(parts)


@query("multiline_scan", _multi())
def _(t):
    m = scan.scan_multiline(_src(t), [*rl.SECURITY, *rl.PERFORMANCE, *rl.DEBT])
    return m.groupBy("project", "file_path", "rule_set", "rule_id", "pattern_idx").agg(F.count("*").alias("matches"))


@query("pattern_search_context", """SELECT a.file_path, a.line_number, a.line, string_agg(b.line, chr(10) ORDER BY b.line_number) AS context FROM v_lines a
  JOIN v_lines b ON a.file_path = b.file_path AND b.line_number BETWEEN a.line_number - 2 AND a.line_number + 1
  WHERE regexp_matches(a.line, 'return\\s') AND starts_with(a.file_path, 'src/') AND NOT contains(a.file_path, '/tests/') AND a.ext IN ('.py', '.js', '.ts') GROUP BY 1, 2, 3""")
def _(t):
    r = scan.pattern_search(_src(t), r"return\s", before=2, after=1, include="src/**", exclude="**/tests/*", code_only=True, code_extensions=[".py", ".js", ".ts"])
    return r.select("file_path", "line_number", "line", F.array_join("context", "\n").alias("context"))


def _pattern_counts() -> str:
    out = []
    for lang_name, kinds in rl.SYMBOL_PATTERNS.items():
        exts = ", ".join(q(e) for e, x in rl.LANGUAGE_MAPS["multi"].items() if x == lang_name)
        for k, p in kinds.items():
            out.append(f"SELECT {q(lang_name)} AS language, {q(k)} AS kind, count(DISTINCT file_path) AS files, count(*) FILTER (regexp_matches(line, {re2(p)})) AS match_count FROM v_lines WHERE lower(ext) IN ({exts})")
    return "SELECT * FROM (" + " UNION ALL ".join(out) + ") WHERE files > 0"


@query("pattern_counts_by_language", _pattern_counts())
def _(t):
    return scan.pattern_counts(_src(t), fl.language("file_path", "multi"), rl.SYMBOL_PATTERNS)


