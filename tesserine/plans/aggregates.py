"""Scores, quality and history."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from ..functions import rules as rl
from ..operators import analysis, history, quality, scan, scores
from ..session import scratch_path
from ..sources import history_table
from .base import half_even, query, view
from .scans import debt_items
from .structures import analysed, src


def _security(t):
    return scan.scan_lines(src(t), rl.SECURITY)


def _performance(t):
    return scan.scan_lines(src(t), rl.PERFORMANCE)


@query("severity_counts", "SELECT project, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_count" for s in rl.SEVERITY_RANK) + " FROM v_security GROUP BY 1")
def _(t):
    return scores.severity_counts(_security(t))


def _weighted(v: str) -> str:
    return f"""(SELECT p.project, coalesce(w, 0) AS w, coalesce(n, 0) AS n, coalesce(severe, 0) AS severe FROM (SELECT DISTINCT project FROM v_corpus) p LEFT JOIN (
      SELECT project, sum(weight) AS w, count(*) AS n, count(*) FILTER (severity IN ('critical', 'high')) AS severe FROM {v} GROUP BY 1) f USING (project))"""


def flagship(t):
    return scores.risk_score(scores.projects(t.corpus), _security(t))


@query("risk_score", f"SELECT project, n AS findings, {half_even('least(100.0, w / 10 * 100)', 1)} AS risk_score, severe = 0 AS is_safe FROM {_weighted('v_security')}")
def _(t):
    return flagship(t)


@query("performance_score", f"SELECT project, n AS issues, {half_even('greatest(0.0, 100 - least(100.0, w / 8 * 100))', 1)} AS performance_score FROM {_weighted('v_performance')}")
def _(t):
    return scores.performance_score(scores.projects(t.corpus), _performance(t))


@query("issues_by_category", "SELECT project, category, count(*) AS issues FROM v_performance GROUP BY 1, 2")
def _(t):
    return scores.issues_by_category(_performance(t))


@query("debt_score", f"""SELECT project, total_files, total_lines, coalesce(items, 0) AS items, {half_even('round(coalesce(h, 0), 6)', 1)} AS total_effort_hours,
  {half_even('round(least(100.0, coalesce(h, 0) / total_lines * 1000 / 40 * 100), 6)', 1)} AS debt_score FROM (
  SELECT project, count(*) AS total_files, sum(length(content) - length(replace(content, chr(10), '')) + 1)::bigint AS total_lines FROM v_corpus GROUP BY 1)
  LEFT JOIN (SELECT project, sum(effort_hours) AS h, count(*) AS items FROM v_debt_items GROUP BY 1) USING (project)""")
def _(t):
    return scores.debt_score(t.corpus, debt_items(t))


@query("debt_by_category", f"""SELECT project, category, count(*) AS items, {half_even('round(sum(effort_hours), 6)', 1)} AS total_effort_hours, {half_even('round(round(sum(effort_hours), 6) / count(*), 6)', 1)} AS average_effort
  FROM v_debt_items GROUP BY 1, 2""")
def _(t):
    return scores.debt_by_category(debt_items(t))


@query("debt_top10", "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY effort_hours DESC, file_path, line_number, name, description) AS r FROM v_debt_items) WHERE r <= 10")
def _(t):
    return scores.debt_top(debt_items(t), 10)


@query("timing_stats", """SELECT name, count(seconds) AS iterations, min(seconds) AS min_time, max(seconds) AS max_time, round(avg(seconds), 6) AS mean_time, round(quantile_cont(seconds, 0.5), 6) AS median_time,
  round(coalesce(stddev_samp(seconds), 0), 6) AS stdev_time, round(sum(seconds), 6) AS total_time FROM v_timings GROUP BY 1""")
def _(t):
    return scores.timing_stats(t.timings)


@query("timing_compare", """WITH m AS (SELECT name, avg(seconds) AS t FROM v_timings GROUP BY 1) SELECT a.name AS name1, b.name AS name2, round(a.t, 6) AS time1, round(b.t, 6) AS time2,
  round(a.t / b.t, 6) AS speedup, round((1 - b.t / a.t) * 100, 6) AS improvement FROM m a JOIN m b ON a.name < b.name""")
def _(t):
    return scores.timing_compare(t.timings)


# ---- quality ----------------------------------------------------------------

_CX = """((CASE WHEN cyclomatic_complexity <= 5 THEN 100 WHEN cyclomatic_complexity <= 10 THEN 80 WHEN cyclomatic_complexity <= 15 THEN 60 ELSE greatest(0, 100 - (cyclomatic_complexity - 15) * 5) END) +
  (CASE WHEN cognitive_complexity <= 10 THEN 100 WHEN cognitive_complexity <= 20 THEN 80 WHEN cognitive_complexity <= 30 THEN 60 ELSE greatest(0, 100 - (cognitive_complexity - 30) * 2) END)) / 2"""
_MT = """(greatest(0, 100 - code_smells * 5) * 0.3::double + greatest(0, 100 - duplication_ratio * 100) * 0.3::double + documentation_ratio * 100 * 0.2::double + least(100, greatest(0, maintainability_index)) * 0.2::double)"""
_RL = """((CASE WHEN test_coverage <= 1.5 AND test_coverage >= 0 THEN test_coverage * 100 ELSE least(100, greatest(0, test_coverage)) END) * 0.6::double + greatest(0, 100 - technical_debt * 10) * 0.4::double)"""
_SC = "greatest(0, 100 - (code_smells // 2) * 10)::double"
_R6 = lambda x: f"round(cast({x} AS double), 6)"


@query("quality_complexity", f"SELECT key, {_R6(_CX)} AS score FROM v_metrics")
def _(t):
    return t.metrics.select("key", F.round(quality.complexity(), 6).alias("score"))


@query("quality_maintainability", f"SELECT key, {_R6(_MT)} AS score FROM v_metrics")
def _(t):
    return t.metrics.select("key", F.round(quality.maintainability(), 6).alias("score"))


@query("quality_reliability", f"SELECT key, {_R6(_RL)} AS score FROM v_metrics")
def _(t):
    return t.metrics.select("key", F.round(quality.reliability(), 6).alias("score"))


@query("quality_security", f"SELECT key, {_R6(_SC)} AS score FROM v_metrics")
def _(t):
    return t.metrics.select("key", F.round(quality.security(), 6).alias("score"))


view("v_quality", f"""SELECT *, CASE WHEN round(o, 9) >= 90 THEN 'A' WHEN round(o, 9) >= 80 THEN 'B' WHEN round(o, 9) >= 70 THEN 'C' WHEN round(o, 9) >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT *, least(100, c * 0.25::double + m * 0.35::double + r * 0.25::double + s * 0.15::double) AS o FROM (
  SELECT *, least(100, {_CX})::double AS c, least(100, {_MT})::double AS m, least(100, {_RL})::double AS r, least(100, {_SC})::double AS s FROM v_metrics))""")


@query("quality_score", "SELECT project, key, round(c, 6) AS complexity_score, round(m, 6) AS maintainability_score, round(r, 6) AS reliability_score, round(s, 6) AS security_score, round(o, 6) AS overall_score, grade FROM v_quality")
def _(t):
    s = quality.quality_score(t.metrics)
    names = ["complexity_score", "maintainability_score", "reliability_score", "security_score", "overall_score"]
    return s.select("project", "key", *[F.round(n, 6).alias(n) for n in names], "grade")


def _advice() -> str:
    parts = []
    for cond, c, scale, text in quality.ADVICE:
        x = f"cast({c} * {scale} AS double)" if "%d" not in text else c
        parts.append(f"CASE WHEN {cond} THEN printf('{text}', {x}) END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), chr(10))"


@query("quality_recommendations", f"SELECT key, {_advice()} AS recommendations FROM v_metrics")
def _(t):
    return t.metrics.select("key", F.array_join(quality.recommendations(), "\n").alias("recommendations"))


@query("quality_metrics_extract", """SELECT r.project, coalesce(f.cc, 0) AS cyclomatic_complexity, r.code_smells, r.lines_of_code, 75.0::double AS maintainability_index FROM (
  SELECT project, sum(smells)::bigint AS code_smells, sum(lines_of_code)::bigint AS lines_of_code FROM v_report GROUP BY 1) r
  LEFT JOIN (SELECT project, round(avg(cyclomatic), 6) AS cc FROM v_functions_py WHERE cyclomatic > 0 GROUP BY 1) f USING (project)""")
def _(t):
    m = analysis.quality_metrics(analysed(t))
    return m.select("project", F.round("cyclomatic_complexity", 6).alias("cyclomatic_complexity"), "code_smells", "lines_of_code", "maintainability_index")


# ---- history ----------------------------------------------------------------

_TS = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
_ts = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"
_VAL = "try_cast(json_extract_string(result_json, '$.k') AS double)"


def _latest(n: int, keys: str, where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY timestamp DESC, event_id DESC) AS rank FROM v_hist WHERE {where}) WHERE rank <= {n})"


@query("history_latest", f"SELECT project_name, rank, id, analysis_type, {_ts('timestamp')}, duration, result_json FROM {_latest(10, 'project_name')}")
def _(t):
    return history.latest(t.hist, 10).select("project_name", "rank", "id", "analysis_type", _TS("timestamp"), "duration", "result_json")


@query("history_by_id", "SELECT id, project_name, analysis_type, duration FROM v_hist WHERE id = '77'")
def _(t):
    return history.by_id(t.hist, "77").select("id", "project_name", "analysis_type", "duration")


@query("history_projects", f"SELECT project_name, project_path, total_analyses, {_ts('first_analysis')}, {_ts('last_analysis')} FROM (SELECT project_name, project_path, count(*) AS total_analyses, min(timestamp) AS first_analysis, max(timestamp) AS last_analysis FROM v_hist GROUP BY 1, 2)")
def _(t):
    return history.list_projects(t.hist).select("project_name", "project_path", "total_analyses", _TS("first_analysis"), _TS("last_analysis"))


@query("metric_path", f"SELECT id, {_VAL} AS value, try_cast(json_extract_string(result_json, '$.missing.k') AS double) AS missing FROM v_hist")
def _(t):
    return t.hist.select("id", history.metric("result_json", "k").alias("value"), history.metric("result_json", "missing.k").alias("missing"))


@query("metric_trend", f"SELECT project_name, analysis_type, {_ts('timestamp')}, rank, {_VAL} AS value FROM {_latest(10, 'project_name, analysis_type')} WHERE {_VAL} IS NOT NULL")
def _(t):
    return history.metric_trend(t.hist, "k").select("project_name", "analysis_type", _TS("timestamp"), "rank", "value")


view("v_last_two", f"""SELECT project_name, analysis_type, max(CASE WHEN rank = 1 THEN value END) AS latest_value, max(CASE WHEN rank = 2 THEN value END) AS previous_value FROM (
  SELECT *, row_number() OVER (PARTITION BY project_name, analysis_type ORDER BY timestamp DESC, event_id DESC) AS rank FROM (SELECT *, {_VAL} AS value FROM v_hist) WHERE value IS NOT NULL) WHERE rank <= 2 GROUP BY 1, 2""")


@query("trend_direction", """SELECT *, CASE WHEN previous_value IS NULL OR abs(latest_value - previous_value) < 0.5 THEN 'stable' WHEN latest_value > previous_value THEN 'improving' ELSE 'declining' END AS trend_direction FROM v_last_two""")
def _(t):
    return history.trend_direction(history.last_two(t.hist, "k"))


@query("trend_change_rate", f"SELECT *, CASE WHEN previous_value IS NULL OR previous_value = 0 THEN 0.0 ELSE {half_even('(latest_value - previous_value) / previous_value * 100', 1)} END AS change_rate FROM v_last_two")
def _(t):
    return history.trend_change_rate(history.last_two(t.hist, "k"))


view("v_pairs", f"""SELECT a.project_name, a.analysis_type, b.result_json AS before, a.result_json AS after FROM {_latest(2, 'project_name, analysis_type')} a
  JOIN {_latest(2, 'project_name, analysis_type')} b USING (project_name, analysis_type) WHERE a.rank = 1 AND b.rank = 2""")


@query("report_compare", f"""SELECT *, {half_even('after_value - before_value', 2)} AS absolute_change, CASE WHEN before_value = 0 THEN 0.0 ELSE {half_even('(after_value - before_value) / abs(before_value) * 100', 1)} END AS relative_change,
  after_value > before_value AS is_improved FROM (SELECT project_name, analysis_type, 'k' AS metric_name, try_cast(json_extract_string(before, '$.k') AS double) AS before_value, try_cast(json_extract_string(after, '$.k') AS double) AS after_value FROM v_pairs)
  WHERE before_value IS NOT NULL AND after_value IS NOT NULL""")
def _(t):
    two = history.latest(t.hist, 2, ["project_name", "analysis_type"])
    pairs = two.groupBy("project_name", "analysis_type").agg(F.max(F.when(col("rank") == 2, col("result_json"))).alias("before"),
                                                             F.max(F.when(col("rank") == 1, col("result_json"))).alias("after"))
    return history.report_compare(pairs, "before", "after", ["k", "total_files"])


@query("history_retain", "SELECT id, analysis_type FROM v_hist WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAY")
def _(t):
    path = scratch_path(t.spark, "history")
    history_table.append(t.hist.drop("event_id"), path, "all")
    history_table.retain(t.spark, path, "2024-01-30 00:00:00", 10)
    return history_table.read(t.spark, path).select("id", "analysis_type")


@query("snapshot_deltas", f"""SELECT project_name, event_id, value, lag(value) OVER w AS previous, coalesce(value - lag(value) OVER w, 0.0) AS delta,
  max(value) OVER (PARTITION BY project_name ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, {_VAL} AS value FROM v_hist) WHERE value IS NOT NULL WINDOW w AS (PARTITION BY project_name ORDER BY timestamp, event_id)""")
def _(t):
    return history.snapshot_deltas(t.hist, "k").select("project_name", "event_id", "value", "previous", "delta", "peak")
