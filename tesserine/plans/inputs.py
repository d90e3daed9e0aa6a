"""Sources, sinks, file selection, plugins and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from ..functions import rules as rl
from ..functions import text as tx
from ..operators import files as fl
from ..operators import graph, plugins, scan, scores, smells, structure
from ..operators import ruleset
from ..session import scratch_path
from ..sources import history_table, io
from ..streaming import streams
from .base import half_even, lang, q, query, strip, view

_IN = lambda xs: "(" + ", ".join(q(x) for x in xs) + ")"
_SEG = lambda names: " AND ".join(f"NOT list_contains(string_split(file_path, '/'), {q(n)})" for n in names)


@query("load_tree", f"SELECT file_path, sha256(content) AS sha256, strlen(content) AS bytes FROM v_corpus WHERE ext IN {_IN(rl.SOURCE_EXTENSIONS)} AND {_SEG(rl.SKIPPED_DIRS)}")
def _(t):
    root = scratch_path(t.spark, "tree")
    io.write_tree(t.corpus, root)
    return io.load_tree(t.spark, root).select("file_path", F.sha2("content", 256).alias("sha256"), "bytes")


@query("exclude_dirs", f"SELECT project, file_path FROM v_corpus WHERE {_SEG(rl.EXCLUDED_DIRS)}")
def _(t):
    return fl.exclude_dirs(t.corpus).select("project", "file_path")


@query("cap_files", "SELECT project, file_path FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_path) AS r FROM v_corpus) WHERE r <= 500")
def _(t):
    return fl.cap_files(t.corpus.select("project", "file_path"), 500)


@query("find_file_glob", "SELECT file_path FROM v_corpus WHERE regexp_matches(file_path, '^src/[^/]*/m[^/]*\\.py$') OR regexp_matches(file_path, '(^|/)config_[^/]*\\.[jt]s$')")
def _(t):
    f = t.corpus.select("file_path")
    masks = ["src/*/m*.py", "config_*.js", "config_*.ts"]
    out = fl.find_file_glob(f, masks[0])
    for m in masks[1:]:
        out = out.unionByName(fl.find_file_glob(f, m))
    return out


@query("config_files", "SELECT file_path FROM v_corpus WHERE contains(regexp_extract(file_path, '([^/]*)$', 1), 'config')")
def _(t):
    return fl.config_files(t.corpus).select("file_path")


@query("dir_stats", "SELECT CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory, count(*) AS file_count FROM v_corpus GROUP BY 1")
def _(t):
    return fl.dir_stats(t.corpus)


@query("explode_lines", "SELECT project, file_path, line_number, line FROM v_lines")
def _(t):
    return t.lines.select("project", "file_path", "line_number", "line")


@query("detect_language", f"SELECT file_path, {lang('ext', 'analyzer')} AS language, {lang('ext', 'display')} AS display_language FROM v_corpus")
def _(t):
    return t.corpus.select("file_path", fl.language("file_path").alias("language"), fl.language("file_path", "display").alias("display_language"))


@query("module_role", "SELECT file_path, CASE WHEN contains(lower(file_path), 'test') THEN 'test' WHEN contains(lower(file_path), 'example') THEN 'example' WHEN starts_with(lower(file_path), 'src/') THEN 'core' WHEN NOT contains(file_path, '/') AND starts_with(lower(file_path), 'analyze_') THEN 'main' ELSE 'general' END AS role FROM v_corpus")
def _(t):
    return fl.module_role(t.corpus).select("file_path", "role")


_LINES = "length(content) - length(replace(content, chr(10), '')) + 1"


@query("file_stats_ext", f"SELECT ext AS extension, count(*) AS files, sum({_LINES})::bigint AS lines, sum(strlen(content))::bigint AS bytes FROM v_corpus GROUP BY ROLLUP (ext)")
def _(t):
    return fl.file_stats_ext(t.corpus)


@query("language_stats", f"""SELECT language, files, lines, {half_even('files / max(files) OVER () * 100', 1)} AS share_pct FROM (
  SELECT {lang('ext', 'display')} AS language, count(*) AS files, sum({_LINES} - CASE WHEN ends_with(content, chr(10)) OR content = '' THEN 1 ELSE 0 END)::bigint AS lines
  FROM v_corpus WHERE {lang('ext', 'display')} IS NOT NULL GROUP BY ROLLUP ({lang('ext', 'display')}))""")
def _(t):
    return fl.language_stats(t.corpus)


def _reports(t):
    c = t.corpus.select("project", "file_path", "content")
    sm = smells.all_smells(c, ruleset.builtin(t.spark))
    return io.report_rows(scores.file_report(c, sm), structure.functions_py(c), sm)


_FLAT_REPORT = """SELECT r.file_path, r.language, r.total_lines, coalesce(f.n, 0) AS functions, r.smells AS code_smells, r.cyclomatic, r.comment_lines
  FROM v_report r LEFT JOIN (SELECT file_path, count(*) AS n FROM v_functions_py GROUP BY 1) f USING (file_path)"""


def _flat(df):
    return df.select("file_path", "language", "total_lines", F.size("functions").alias("functions"), F.size("code_smells").alias("code_smells"),
                     col("overall_complexity.cyclomatic_complexity").alias("cyclomatic"), col("overall_complexity.comment_lines").alias("comment_lines"))


@query("write_report_json", "SELECT project, count(*) AS rows FROM v_report GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "report")
    io.write_report_json(_reports(t), path)
    return t.spark.read.schema("project string").json(path).groupBy("project").agg(F.count("*").alias("rows"))


@query("read_reports", _FLAT_REPORT)
def _(t):
    path = scratch_path(t.spark, "report")
    io.write_report_json(_reports(t), path)
    return _flat(io.read_reports(t.spark, path))


@query("history_append", "SELECT analysis_type, count(*) AS rows, count(DISTINCT id) AS ids, count(DISTINCT project_name) AS projects FROM v_hist GROUP BY 1")
def _(t):
    path, h = scratch_path(t.spark, "history"), t.hist.drop("event_id")
    for batch, rows in (("short", "duration < 10"), ("other", "NOT duration < 10 OR duration IS NULL"), ("short", "duration < 10")):  # the last one is there already
        history_table.append(h.where(rows), path, batch)
    back = history_table.read(t.spark, path)
    return back.groupBy("analysis_type").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.countDistinct("project_name").alias("projects"))


def _link_edges(t):
    host = F.regexp_extract("source", r"^https?://([^/?#]*)", 1)
    return t.links.select(host.alias("project"), "source", "target", F.lit(0).alias("line_number"), F.lit("href").alias("import_type"))


_HOST = "regexp_extract(source, '^https?://([^/?#]*)', 1)"


@query("graph_export_mermaid", f"""SELECT {_HOST} AS project, 0 AS part, 1 AS parts, 'graph LR' || chr(10) || string_agg('    ' || replace(source, '.', '_') || ' --> ' || replace(target, '.', '_'), chr(10)
  ORDER BY encode(source), encode(target)) AS text FROM v_links GROUP BY 1""")
def _(t):
    return graph.export_mermaid(_link_edges(t), 200_000)


@query("graph_export_dot", f"""SELECT {_HOST} AS project, 0 AS part, 1 AS parts, 'digraph dependencies {{' || chr(10) || '    rankdir=LR;' || chr(10) || string_agg('    "' || source || '" -> "' || target || '";', chr(10)
  ORDER BY encode(source), encode(target)) || chr(10) || '}}' AS text FROM v_links GROUP BY 1""")
def _(t):
    return graph.export_dot(_link_edges(t), 200_000)


@query("sample_files", """SELECT project, file_path FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY sha256(file_path || ':7'), file_path) AS r,
  count(*) OVER (PARTITION BY project) AS n FROM v_corpus) WHERE r <= greatest(1, floor(n * CASE WHEN n < 5000 THEN 1.0 WHEN n > 20000 THEN 0.05 ELSE 0.2 END))""")
def _(t):
    return fl.sample_files(t.corpus.select("project", "file_path"))


view("v_hot", f"""SELECT *, {half_even('estimated_complexity / lines', 3)} AS density FROM (SELECT project, file_path, len(list_filter(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+'),
  lambda w: w IN ('if', 'elif', 'for', 'while', 'except', 'with', 'and', 'or'))) AS estimated_complexity, {_LINES} AS lines FROM v_corpus WHERE ends_with(file_path, '.py'))
  WHERE estimated_complexity > 10 OR estimated_complexity / lines > 0.1""")
_PLUG_HOT = """SELECT 'total_hotspots' AS key, cast(count(*) AS varchar) AS value FROM v_hot
  UNION ALL SELECT 'top:' || project || ':' || file_path, cast(estimated_complexity AS varchar) FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY estimated_complexity DESC, file_path) AS r FROM v_hot) WHERE r <= 5"""
_PLUG_STATS = f"""SELECT CASE WHEN k = 'files' AND ext IS NOT NULL THEN 'ext:' || ext ELSE 'total_' || k END AS key, cast(v AS varchar) AS value FROM (
  UNPIVOT (SELECT ext, count(*)::bigint AS files, sum({_LINES})::bigint AS lines, sum(strlen(content))::bigint AS bytes FROM v_corpus GROUP BY ROLLUP (ext))
  ON files, lines, bytes INTO NAME k VALUE v) WHERE ext IS NULL OR k = 'files'"""


@query("hotspot_keywords", "SELECT project, file_path, estimated_complexity, lines, density FROM v_hot")
def _(t):
    return scan.hotspot_keywords(t.corpus, rl.HOTSPOT_WORDS)


@query("plugin_run", f"SELECT 'file_stats' AS plugin, true AS success, key, value, NULL::varchar AS error FROM ({_PLUG_STATS})")
def _(t):
    return plugins.default_registry().run("file_stats", t.corpus)


@query("plugin_run_all", f"""SELECT 'complexity_hotspot' AS plugin, true AS success, key, value, NULL::varchar AS error FROM ({_PLUG_HOT})
  UNION ALL SELECT 'file_stats', true, key, value, NULL FROM ({_PLUG_STATS})
  UNION ALL SELECT 'broken', false, NULL, NULL, 'ValueError: broken on purpose'""")
def _(t):
    r = plugins.default_registry()

    def broken(_):
        raise ValueError("broken on purpose")

    r.register("broken", broken)
    return r.run_all(t.corpus)


@query("language_udtf", f"""SELECT project, file_path, count(*) AS lines, max(length({strip('line')})) AS longest FROM v_lines WHERE ext = '.go' GROUP BY 1, 2""")
def _(t):
    return plugins_udtf(t)


def plugins_udtf(t):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.functions import arrow_udtf

    @arrow_udtf(returnType="project string, file_path string, lines bigint, longest int")
    class LineLengths:
        def eval(self, batch: pa.RecordBatch):
            lines = pc.split_pattern(batch.column("content"), "\n")
            sizes = pc.utf8_length(pc.utf8_trim(lines.flatten(), characters=tx.WS)).to_numpy(zero_copy_only=False)
            n = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
            longest = np.maximum.reduceat(sizes, np.append(0, np.cumsum(n)[:-1])) if len(n) else sizes
            yield pa.table({"project": batch.column("project"), "file_path": batch.column("file_path"), "lines": pa.array(n, pa.int64()), "longest": pa.array(longest, pa.int32())})

    reg = plugins.LanguageAnalyzers(t.spark)
    reg.register("go", LineLengths, batches=True)
    return reg.run(t.corpus, "go")


@query("stream_scan", "SELECT project, file_path, line_number, line_content, rule_id, pattern_idx, severity FROM v_security")
def _(t):
    docs = streams.read_stream(t.spark, t.sf_dir, "documents", t.table("documents").schema)
    files = t.with_snippet(docs).select("project", "file_path", "content")
    return streams.drain(streams.stream_scan(files, rl.SECURITY).select("project", "file_path", "line_number", "line_content", "rule_id", "pattern_idx", "severity"))


@query("stream_changes", """SELECT project, file_path, version, status FROM (
  SELECT coalesce(o.project, n.project) AS project, file_path, unnest([1, 2]) AS version,
   unnest([CASE WHEN o.content IS NOT NULL THEN 'new' END, CASE WHEN n.content IS NOT NULL AND o.content IS NULL THEN 'new' WHEN n.content <> o.content THEN 'modified' END]) AS status
  FROM v_snap_old o FULL JOIN v_snap_new n USING (file_path)) WHERE status IS NOT NULL""")
def _(t):
    docs = streams.read_stream(t.spark, t.sf_dir, "documents", t.table("documents").schema)
    c, d = t.with_snippet(docs), col("doc_id")
    old = F.when(d % 10 != 0, F.when(d % 7 == 0, F.concat("content", F.lit("\n# older"))).otherwise(col("content")))
    new = F.when(d % 11 != 0, col("content"))
    v = F.array(F.struct(F.lit(1).alias("version"), F.sha2(old, 256).alias("sha256")), F.struct(F.lit(2).alias("version"), F.sha2(new, 256).alias("sha256")))
    versions = c.select("project", "file_path", F.explode(v).alias("v")).select("project", "file_path", "v.*").where("sha256 IS NOT NULL")
    # Draining ends with the input, so nothing can expire; a state timeout would keep the query running.
    return streams.drain(streams.stream_changes(versions, ttl_seconds=0))


_WIN = "time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01')"


@query("stream_trend", f"""SELECT strftime({_WIN}, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS points, round(avg(value), 6) AS mean FROM events
  GROUP BY {_WIN}, event_type""")
def _(t):
    ev = streams.read_stream(t.spark, t.sf_dir, "events", t.table("events").schema)
    out = streams.drain_windows(ev.withColumn("ts", col("ts").cast("timestamp")), streams.trend_windows)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "points", "mean")
