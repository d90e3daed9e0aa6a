"""Structure metrics and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col


from ..session import stored
from ..operators import analysis, reports, ruleset, scores, smells, structure, symbols
from .base import query, re2, strip, view


def src(t):
    return t.corpus.select("project", "file_path", "content")


def analysed(t):
    """Every file of a known language, folded once."""
    return analysis.analysed(src(t))


def all_smells(t):
    return analysis.smell_rows(analysed(t))


def report(t):
    return analysis.report(analysed(t))


_M = "project, file_path, total_lines, blank_lines, comment_lines, lines_of_code, cyclomatic"


@query("file_metrics_py", f"SELECT {_M} FROM v_metrics_py")
def _(t):
    return structure.file_metrics_py(src(t))


@query("file_metrics_js", f"SELECT {_M} FROM v_metrics_js")
def _(t):
    return structure.file_metrics_js(src(t))


@query("cognitive_py", "SELECT project, file_path, control_weight, boolean_operators, cognitive FROM v_cognitive")
def _(t):
    return structure.cognitive_py(src(t))


@query("block_outline", "SELECT file_path, kind, name, start_line, end_line, indent, parent_line, depth, nest FROM v_outline")
def _(t):
    return structure.block_outline(src(t)).select("file_path", "kind", "name", "start_line", "end_line", "indent", "parent_line", "depth", "nest")


_FN = ["file_path", "name", "start_line", "end_line", "is_async", "is_static", "return_type", "cyclomatic", "nesting", "control_count", "loc", "parent_line"]


@query("functions_py", f"SELECT {', '.join(_FN)}, array_to_string(parameters, ',') AS parameters FROM v_functions_py")
def _(t):
    return structure.functions_py(src(t)).select(*_FN, F.array_join("parameters", ",").alias("parameters"))


@query("classes_py", "SELECT file_path, name, start_line, end_line, inheritance_depth, method_count, coalesce(methods, '') AS methods, max_method_cyclomatic, loc FROM v_classes_py")
def _(t):
    return structure.classes_py(src(t)).withColumn("methods", F.array_join("methods", ",")).drop("project")


@query("functions_js", "SELECT project, file_path, start_line, pattern_idx, name, is_async FROM v_functions_js")
def _(t):
    return structure.functions_js(src(t))


@query("classes_js", "SELECT project, file_path, start_line, name, inheritance_depth FROM v_classes_js")
def _(t):
    return structure.classes_js(src(t))


_CLEAN = lambda x: f"trim(regexp_extract(regexp_replace({x}, '[()]', '', 'g'), '^\\s*(\\S+)(?:\\s+as\\s+\\S+)?\\s*$', 1))"
_CODE = lambda x: strip(f"regexp_replace({x}, '#.*$', '')")
view("v_imports_py", f"""SELECT * FROM (
  SELECT project, file_path, line_number, unnest(list_transform(string_split({_CODE("regexp_extract(b, '^import\\s+(.+)$', 1)")}, ','), lambda s: {_CLEAN('s')})) AS module FROM (
    SELECT *, {strip('line')} AS b FROM v_lines WHERE ext = '.py') WHERE regexp_matches(b, '^import\\s+(.+)$')
  UNION ALL SELECT project, file_path, line_number, CASE WHEN m = '' OR pre = '' THEN m ELSE pre || '.' || m END FROM (
    SELECT *, regexp_replace(regexp_extract(b, '^from\\s+(\\S+)\\s+import\\s+(.+)$', 1), '^\\.+', '') AS pre,
      unnest(list_transform(string_split({_CODE("regexp_extract(b, '^from\\s+(\\S+)\\s+import\\s+(.+)$', 2)")}, ','), lambda s: {_CLEAN('s')})) AS m FROM (
    SELECT *, {strip('line')} AS b FROM v_lines WHERE ext = '.py') WHERE regexp_matches(b, '^from\\s+(\\S+)\\s+import\\s+(.+)$'))) WHERE module <> ''""")
_J1, _J2 = structure.JS_IMPORTS
view("v_imports_js", f"""SELECT project, file_path, unnest(list_concat(regexp_extract_all(content, {re2(_J1)}, 1), regexp_extract_all(content, {re2(_J2)}, 1))) AS module
  FROM v_corpus WHERE ext <> '.py'""")


@query("imports_py", "SELECT project, file_path, line_number, module FROM v_imports_py")
def _(t):
    return structure.imports_py(src(t))


@query("imports_js", "SELECT project, file_path, module FROM v_imports_js")
def _(t):
    return structure.imports_js(src(t))


def imports(t):
    return structure.imports_py(src(t)).drop("line_number").unionByName(structure.imports_js(src(t)))


@query("long_function_js", "SELECT project, file_path, line_number, lines FROM v_long_js")
def _(t):
    return structure.long_function_js(src(t))


_SM = ["project", "file_path", "line_number", "owner", "name", "severity", "description", "suggestion"]


@query("function_smells", f"SELECT {', '.join(_SM)} FROM v_smells_fn")
def _(t):
    return smells.function_smells(src(t), ruleset.builtin(t.spark)).select(*_SM)


@query("class_smells", f"SELECT {', '.join(_SM)} FROM v_smells_cl")
def _(t):
    return smells.class_smells(src(t), ruleset.builtin(t.spark)).select(*_SM)


@query("project_summary", """SELECT r.project, r.total_files, r.total_functions, r.total_classes, r.total_code_smells, r.average_cyclomatic,
  coalesce(s.c, 0) AS critical_smells, coalesce(s.h, 0) AS high_smells, coalesce(s.m, 0) AS medium_smells, coalesce(s.l, 0) AS low_smells, coalesce(s.d, 0) AS deep_nesting_count FROM (
  SELECT project, count(*) AS total_files, sum(functions)::bigint AS total_functions, sum(classes)::bigint AS total_classes, sum(smells)::bigint AS total_code_smells,
    cast(round_even(cast(avg(cyclomatic) AS double), 1) AS double) AS average_cyclomatic FROM v_report GROUP BY 1) r LEFT JOIN (
  SELECT project, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m,
    count(*) FILTER (severity = 'low') AS l, count(*) FILTER (name = 'Deep Nesting') AS d FROM v_smells GROUP BY 1) s USING (project)""")
def _(t):
    return scores.project_summary(report(t))


@query("language_breakdown", "SELECT language, count(*) AS files, sum(functions)::bigint AS functions, sum(classes)::bigint AS classes FROM v_report GROUP BY 1")
def _(t):
    return scores.language_breakdown(report(t))


@query("smell_types_top", """SELECT project, name, smells FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY smells DESC, name) AS r FROM (
  SELECT project, name, count(*) AS smells FROM v_smells GROUP BY 1, 2)) WHERE r <= 10""")
def _(t):
    return scores.smell_types_top(all_smells(t), 10)


_TOP = ["project", "rank", "file", "cyclomatic", "total_lines", "lines_of_code", "functions", "classes", "smells"]


def _top(by: str) -> str:
    return f"""SELECT project, rank, regexp_replace(file_path, '^src/[^/]*/', '') AS file, cyclomatic, total_lines, lines_of_code, functions, classes, smells FROM (
      SELECT *, row_number() OVER (PARTITION BY project ORDER BY {by} DESC, file_path) AS rank FROM v_report) WHERE rank <= 5"""


@query("most_complex_files", _top("cyclomatic"))
def _(t):
    return scores.top_files(report(t), "cyclomatic").select(*_TOP)


@query("largest_files", _top("total_lines"))
def _(t):
    return scores.top_files(report(t), "total_lines").select(*_TOP)


@query("complexity_hotspots", """SELECT project, kind, file_path, line_number, name, value FROM (
  SELECT project, 'function' AS kind, file_path, start_line AS line_number, name, cyclomatic::int AS value, row_number() OVER (PARTITION BY project ORDER BY cyclomatic DESC, file_path, start_line) <= 5 AS top FROM v_functions_py
  UNION ALL SELECT project, 'class', file_path, start_line, name, loc::int, row_number() OVER (PARTITION BY project ORDER BY loc DESC, file_path, start_line) <= 5 FROM v_classes_py
  UNION ALL SELECT project, 'deep_nesting', file_path, line_number, owner, NULL::int, row_number() OVER (PARTITION BY project ORDER BY file_path, line_number) <= 3 FROM v_smells WHERE name = 'Deep Nesting') WHERE top""")
def _(t):
    return analysis.hotspots(analysed(t), 5, 3)


@query("smells_top10", """SELECT project, name, severity, file_path, line_number, description FROM (SELECT *, row_number() OVER (PARTITION BY project
  ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, file_path, line_number, name, description) AS r FROM v_smells) WHERE r <= 10""")
def _(t):
    return scores.smells_top(all_smells(t), 10).select("project", "name", "severity", "file_path", "line_number", "description")


# ---- symbols ----------------------------------------------------------------


def symbol_table(t):
    return symbols.symbol_table(src(t))


# A symbol holds those that start after it and end within it.
view("v_found", f"""SELECT *, line_start AS found_line, 0 AS level FROM v_symbols WHERE regexp_matches(name, {re2('^(run|Digest|deep)')}) AND starts_with(file_path, 'src/')""")
view("v_held", """SELECT s.*, f.found_line, (SELECT count(*) FROM v_symbols o WHERE o.file_path = s.file_path AND o.line_start >= f.line_start AND o.line_start < s.line_start AND o.line_end >= s.line_end)::int AS level
  FROM (SELECT DISTINCT file_path, line_start, line_end, found_line FROM v_found) f JOIN v_symbols s ON s.file_path = f.file_path AND s.line_start > f.line_start AND s.line_end <= f.line_end""")


@query("find_symbol", """SELECT DISTINCT s.file_path, s.found_line, s.level, s.name, s.kind, s.line_start, s.line_end,
  coalesce((SELECT string_agg(o.name, '/' ORDER BY o.line_start) || '/' FROM v_symbols o WHERE o.file_path = s.file_path AND o.line_start < s.line_start AND o.line_end >= s.line_end), '') || s.name AS name_path,
  (SELECT string_agg(l.line, chr(10) ORDER BY l.line_number) FROM v_lines l WHERE l.file_path = s.file_path AND l.line_number BETWEEN s.line_start AND s.line_end) AS body
  FROM (SELECT * FROM v_found UNION ALL SELECT * FROM v_held WHERE level <= 1) s""")
def _(t):
    hit = symbols.find_symbol(src(t), "^(run|Digest|deep)", "src/", depth=1, with_body=True)
    return hit.select("file_path", "found_line", "level", "name", "kind", "line_start", "line_end", "name_path", "body").distinct()


@query("symbol_references", """SELECT project, file_path, line_number, name, coalesce(kind, 'file') AS kind FROM (
  SELECT m.*, (SELECT d.kind FROM v_symbols d WHERE d.file_path = m.file_path AND m.line_number BETWEEN d.line_start AND d.line_end ORDER BY d.line_start DESC, d.line_end, d.kind DESC LIMIT 1) AS kind FROM (
   SELECT DISTINCT project, file_path, line_number, name FROM (
    SELECT project, file_path, line_number, unnest(list_distinct(regexp_extract_all(line, '[\\p{L}\\p{N}_]+'))) AS name FROM v_lines)
   JOIN (SELECT DISTINCT project, name FROM v_symbols) s USING (project, name)) m
  WHERE NOT EXISTS (SELECT 1 FROM v_symbols d WHERE d.file_path = m.file_path AND d.name = m.name AND m.line_number BETWEEN d.line_start AND d.line_end))""")
def _(t):
    table = stored(symbol_table(t), "symbols")
    return symbols.symbol_references(symbols.scratch_index(src(t), table), table)


view("v_overview", """SELECT project, file_path, language, coalesce(string_agg(name, ',' ORDER BY line_start, name) FILTER (kind = 'class'), '') AS classes,
  coalesce(string_agg(name, ',' ORDER BY line_start, name) FILTER (kind = 'function'), '') AS functions FROM v_symbols GROUP BY 1, 2, 3""")


@query("symbols_overview", """SELECT file_path, language, classes, functions FROM v_overview UNION ALL SELECT NULL, language, cast(sum(c) AS varchar) || ' in ' || count(*) || ' files', cast(sum(f) AS varchar) FROM (
  SELECT file_path, language, count(*) FILTER (kind = 'class') AS c, count(*) FILTER (kind = 'function') AS f FROM v_symbols GROUP BY 1, 2) GROUP BY language""")
def _(t):
    s = symbol_table(t)
    per = symbols.symbols_overview(s).select("file_path", "language", F.array_join("classes", ",").alias("classes"), F.array_join("functions", ",").alias("functions"))
    total = symbols.language_totals(s).select(F.lit(None).cast("string").alias("file_path"), "language", F.format_string("%d in %d files", "classes", "files").alias("classes"),
                                              col("functions").cast("string").alias("functions"))
    return per.unionByName(total)


@query("methods_vs_functions", "SELECT file_path, name, start_line FROM v_functions_py WHERE parent_kind IS NULL OR parent_kind <> 'class'")
def _(t):
    return symbols.plain_functions(structure.functions_py(src(t))).select("file_path", "name", "start_line")


def _penalty(s: str) -> str:
    return f"CASE {s} WHEN 'critical' THEN 20 WHEN 'high' THEN 15 WHEN 'medium' THEN 10 WHEN 'low' THEN 5 ELSE 0 END"


view("v_symbol_quality", f"""SELECT s.*, greatest(0.0, least(100.0, 100.0 - CASE WHEN cyclomatic > 10 THEN least(20, (cyclomatic - 10) * 2) WHEN cyclomatic > 5 THEN (cyclomatic - 5) * 2 ELSE 0 END
   - coalesce(p.p, 0)))::double AS quality_score FROM v_symbols s LEFT JOIN (SELECT file_path, owner_kind AS kind, line_number AS line_start, sum({_penalty('severity')}) AS p FROM v_smells
   WHERE owner_kind IN ('function', 'class') GROUP BY 1, 2, 3) p USING (file_path, kind, line_start)""")
_SQ = ["file_path", "name", "kind", "line_start", "cyclomatic", "quality_score"]


@query("symbol_quality", f"SELECT {', '.join(_SQ)} FROM v_symbol_quality")
def _(t):
    return analysis.symbol_rows(analysed(t)).select(*_SQ)


# The second source: definitions named at a line start, in labelled documents only, seen once more further down.
_DEF = r"^\s*(def|class|func|function)\s+(\w+)"
view("v_semantic", f"""SELECT project, file_path, regexp_extract(line, {re2(_DEF)}, 2) AS name, CASE WHEN regexp_extract(line, {re2(_DEF)}, 1) = 'class' THEN 'Class' ELSE 'Function' END AS kind, line_number + k AS line
  FROM v_lines JOIN (SELECT file_path FROM v_corpus c JOIN labels l ON c.doc_id = l.doc_id) x USING (file_path), (VALUES (0), (1000)) r(k) WHERE regexp_matches(line, {re2(_DEF)})""")


def semantic(t):
    from ..functions import text as tx

    c = t.corpus.join(t.table("labels").select("doc_id"), "doc_id")
    rx = tx.regex(_DEF)
    hits = F.transform(F.filter(tx.numbered("content"), lambda x: x["line"].rlike(rx)), lambda x: F.struct(
        F.regexp_extract(x["line"], rx, 2).alias("name"), F.when(F.regexp_extract(x["line"], rx, 1) == "class", "Class").otherwise("Function").alias("kind"), x["n"].alias("n")))
    rows = c.select("project", "file_path", F.explode(hits).alias("h")).select("project", "file_path", "h.*")
    return rows.withColumn("line", F.explode(F.array(col("n"), col("n") + 1000))).drop("n")


view("v_unified", """SELECT q.*, s.semantic_line FROM v_symbol_quality q LEFT JOIN (SELECT file_path, name, lower(kind) AS kind, min(line) AS semantic_line FROM v_semantic GROUP BY 1, 2, 3) s USING (file_path, name, kind)""")


def unified(t):
    return symbols.with_semantic(analysis.symbol_rows(analysed(t)), semantic(t))


@query("unified_merge", f"SELECT {', '.join(_SQ)}, semantic_line FROM v_unified")
def _(t):
    return unified(t).select(*_SQ, "semantic_line")


@query("unified_summary", """SELECT r.project, language_stats, total_complexity, total_code_smells, round(coalesce(quality, 100.0), 6) AS quality_score FROM (
  SELECT project, string_agg(language || '=' || n, ',' ORDER BY language) AS language_stats, sum(cc)::bigint AS total_complexity, sum(s)::bigint AS total_code_smells FROM (
    SELECT project, language, count(*) AS n, sum(cyclomatic) AS cc, sum(smells) AS s FROM v_report GROUP BY 1, 2) GROUP BY 1) r
  LEFT JOIN (SELECT project, avg(quality_score) AS quality FROM v_unified GROUP BY 1) q USING (project)""")
def _(t):
    return symbols.unified_summary(report(t), unified(t))


# ---- report rows of structure ------------------------------------------------


@query("heatmap_rows", """SELECT r.project, regexp_extract(r.file_path, '([^/]*)$', 1) AS file, r.file_path, total_lines, cyclomatic, cognitive, coalesce(f.nest, 0) AS nesting_depth, lines_of_code AS loc,
  round(comment_lines / greatest(lines_of_code, 1), 6) AS comment_ratio, functions AS function_count, classes AS class_count, smells AS smell_count, coalesce(f.rows, '') AS function_rows
  FROM v_report r LEFT JOIN (SELECT file_path, max(nesting) AS nest, string_agg(name || ':' || start_line || '-' || end_line || ':' || cyclomatic || ':' || nesting || ':' || len(parameters), ';' ORDER BY start_line) AS rows
    FROM v_functions_py GROUP BY 1) f USING (file_path)""")
def _(t):
    h = analysis.heatmap_rows(analysed(t))
    s = lambda f, k: f[k].cast("string")
    text = F.transform("function_rows", lambda f: F.concat(f["name"], F.lit(":"), s(f, "start_line"), F.lit("-"), s(f, "end_line"), F.lit(":"), s(f, "cyclomatic"),
                                                           F.lit(":"), s(f, "nesting"), F.lit(":"), s(f, "params")))
    return h.withColumn("function_rows", F.array_join(text, ";"))


@query("severity_file", """SELECT file_path, CASE WHEN cyclomatic > 30 OR smells > 10 THEN 'critical' WHEN cyclomatic > 15 OR smells > 5 THEN 'high' WHEN cyclomatic > 8 OR smells > 2 THEN 'medium' ELSE 'info' END AS severity FROM v_report""")
def _(t):
    return report(t).select("file_path", reports.severity_file(col("cyclomatic"), col("smells")).alias("severity"))


@query("severity_class", """SELECT c.project, c.file_path, c.name, c.start_line, CASE WHEN c.max_method_cyclomatic > 15 OR n > 5 THEN 'critical' WHEN c.max_method_cyclomatic > 10 OR n > 2 THEN 'high'
  WHEN c.max_method_cyclomatic > 5 OR n > 0 THEN 'medium' ELSE 'info' END AS severity FROM (SELECT c.*, coalesce(s.n, 0) AS n FROM v_classes_py c LEFT JOIN (
  SELECT project, file_path, line_number AS start_line, count(*) AS n FROM v_smells_cl GROUP BY 1, 2, 3) s USING (project, file_path, start_line)) c""")
def _(t):
    return analysis.class_severities(analysed(t))


@query("severity_function", """SELECT file_path, name, start_line, CASE WHEN cyclomatic > 15 THEN 'critical' WHEN cyclomatic > 10 THEN 'high' WHEN cyclomatic > 5 THEN 'medium' ELSE 'info' END AS severity FROM v_functions_py""")
def _(t):
    return structure.functions_py(src(t)).select("file_path", "name", "start_line", reports.severity_function(col("cyclomatic")).alias("severity"))


@query("worst_severity", """SELECT project, file_path, arg_max(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS worst_severity, count(*) AS smells FROM v_smells GROUP BY 1, 2""")
def _(t):
    return reports.worst_severity(all_smells(t), ["project", "file_path"])


_PIPE = lambda *parts: "concat_ws('|', " + ", ".join(f"coalesce(({x})::varchar, '-')" for x in parts) + ")"
_NODE = _PIPE("name", "end_line", "cyclomatic", "nesting", "loc", "array_to_string(parameters, ',')", "return_type", "is_async", "is_static",
              "CASE WHEN cyclomatic > 15 THEN 'critical' WHEN cyclomatic > 10 THEN 'high' WHEN cyclomatic > 5 THEN 'medium' ELSE 'info' END")


@query("report_tree", f"""SELECT project, file_path, 'file' AS part, NULL::int AS line, {_PIPE("regexp_extract(file_path, '([^/]*)$', 1)",
    "CASE WHEN cyclomatic > 30 OR smells > 10 THEN 'critical' WHEN cyclomatic > 15 OR smells > 5 THEN 'high' WHEN cyclomatic > 8 OR smells > 2 THEN 'medium' ELSE 'info' END",
    'total_lines', 'cyclomatic', 'cognitive', 'lines_of_code', 'comment_lines', 'blank_lines')} AS item FROM v_report
  UNION ALL SELECT project, file_path, 'import', NULL, module FROM v_imports_py UNION ALL SELECT project, file_path, 'import', NULL, module FROM v_imports_js
  UNION ALL SELECT project, file_path, 'class', start_line, {_PIPE('name', 'end_line', 'inheritance_depth', 'method_count')} FROM v_classes_py
  UNION ALL SELECT project, file_path, CASE WHEN parent_kind = 'class' THEN 'method' ELSE 'function' END, start_line, {_NODE} FROM v_functions_py
  UNION ALL SELECT project, file_path, 'smell', line_number, {_PIPE('name', 'severity', 'description', 'suggestion')} FROM v_smells""")
def _(t):
    """The JSON trees, read back and compared node by node."""
    return analysis.flat_tree(analysis.report_tree(analysed(t)))
