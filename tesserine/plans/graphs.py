"""Import graph, page links and event flow."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from ..operators import graph
from .base import half_even, lang, q, query, re2, strip, view
from .structures import imports, src

_MOD = "replace(CASE WHEN ext = '' THEN file_path ELSE left(file_path, length(file_path) - length(ext)) END, '/', '.')"
view("v_modules", f"SELECT project, file_path, {_MOD} AS module_name, coalesce({lang('ext', 'dependency', fold=False)}, 'unknown') AS language FROM v_corpus")
_EXT = {"python": "'.py'", "javascript": "'.js', '.ts'", "go": "'.go'"}
view("v_edges", " UNION ALL ".join(
    f"""SELECT m.project, m.module_name AS source, regexp_extract({strip('line')}, {re2(p)}, 1) AS target, {q(kind)} AS import_type, line_number
     FROM v_lines l JOIN v_modules m USING (file_path) WHERE ext IN ({exts}) AND regexp_matches({strip('line')}, {re2(p)})"""
    for name, exts in _EXT.items() for p, kind in graph.IMPORTS[name]))
view("v_nodes", """SELECT m.project, m.module_name, m.file_path, m.language, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM v_modules m
  LEFT JOIN (SELECT project, source AS module_name, count(*) AS n FROM v_edges GROUP BY 1, 2) o USING (project, module_name)
  LEFT JOIN (SELECT project, target AS module_name, count(*) AS n FROM v_edges GROUP BY 1, 2) i USING (project, module_name)
  UNION ALL SELECT project, target, '(external)', 'unknown', 0, count(*) FROM v_edges e WHERE NOT EXISTS (SELECT 1 FROM v_modules m WHERE m.project = e.project AND m.module_name = e.target) GROUP BY 1, 2""")


def edges(t):
    return graph.dep_edges(src(t))


def nodes(t):
    return graph.dep_nodes(src(t), edges(t))


@query("dep_edges", "SELECT project, source, target, import_type, line_number FROM v_edges")
def _(t):
    return edges(t)


@query("module_name", "SELECT file_path, module_name FROM v_modules")
def _(t):
    return graph.modules(t.corpus).select("file_path", "module_name")


@query("dep_nodes", "SELECT project, module_name, file_path, language, out_degree, in_degree FROM v_nodes")
def _(t):
    return nodes(t)


@query("dep_hubs", """SELECT graph, target, in_count FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY in_count DESC, target) AS r FROM (
  SELECT project AS graph, target, count(*) AS in_count FROM v_edges GROUP BY 1, 2 UNION ALL SELECT 'pages', target, count(*) FROM v_links GROUP BY 1, 2)) WHERE r <= 10""")
def _(t):
    both = edges(t).select(col("project").alias("graph"), "target").unionByName(t.links.select(F.lit("pages").alias("graph"), "target"))
    return graph.dep_hubs(both, 10, "graph")


@query("dep_roots", "SELECT DISTINCT project, source AS module_name FROM v_edges e WHERE NOT EXISTS (SELECT 1 FROM v_edges x WHERE x.project = e.project AND x.target = e.source)")
def _(t):
    return graph.dep_roots(edges(t))


@query("dep_coupling", f"""SELECT e.project, e.source AS module_name, e.out_count, {half_even('e.out_count / n.total', 3)} AS coupling FROM (SELECT project, source, count(*) AS out_count FROM v_edges GROUP BY 1, 2) e
  JOIN (SELECT project, count(*) AS total FROM v_nodes GROUP BY 1) n USING (project)""")
def _(t):
    return graph.dep_coupling(edges(t), nodes(t))


view("v_links_of", """SELECT DISTINCT project, source, target FROM v_edges UNION ALL SELECT 'events', source, target FROM v_flow""")
view("v_reach", "SELECT project, source AS a, target AS b FROM v_links_of UNION SELECT r.project, r.a, f.target FROM v_reach r JOIN v_links_of f ON r.b = f.source AND r.project = f.project")
view("v_onward", "SELECT l.* FROM v_links_of l WHERE source <> target AND EXISTS (SELECT 1 FROM v_reach r WHERE r.project = l.project AND r.a = l.target AND r.b = l.source)")
view("v_ways", """SELECT project, source, target, target AS last, [target] AS path FROM v_onward
  UNION ALL SELECT w.project, w.source, w.target, o.target, list_append(w.path, o.target) FROM v_ways w JOIN v_onward o ON o.project = w.project AND o.source = w.last
  WHERE w.last <> w.source AND NOT list_contains(w.path, o.target)""")
view("v_back", """SELECT project, source, target, path FROM (SELECT *, row_number() OVER (PARTITION BY project, source, target ORDER BY len(path), list_reverse(path)) AS r
  FROM v_ways WHERE last = source) WHERE r = 1 UNION ALL SELECT project, source, target, [source] FROM v_links_of WHERE source = target""")


@query("dep_cycles", """SELECT DISTINCT 'node' AS kind, project, a AS item, 0 AS length FROM v_reach WHERE a = b
  UNION ALL SELECT DISTINCT 'edge', project, source || ' -> ' || target, len(path) FROM v_back
  UNION ALL SELECT DISTINCT 'cycle', project, array_to_string(path[p:] || path[:p], ' -> '), len(path) FROM (SELECT *, list_position(path, list_min(path)) AS p FROM v_back)""")
def _(t):
    """Of every project's imports and of the event flow."""
    both = edges(t).select("project", "source", "target").unionByName(t.flow.select(F.lit("events").alias("project"), "source", "target"))
    nodes, through, cycles = graph.project_cycles(both)
    return (nodes.select(F.lit("node").alias("kind"), "project", col("node").alias("item"), F.lit(0).cast("long").alias("length"))
            .unionByName(through.select(F.lit("edge").alias("kind"), "project", F.concat("source", F.lit(" -> "), "target").alias("item"), "length"))
            .unionByName(cycles.select(F.lit("cycle").alias("kind"), "project", col("cycle").alias("item"), "length")))


@query("page_links", "SELECT source, target FROM v_links")
def _(t):
    return t.links


@query("import_frequency", """WITH i AS (SELECT module, count(*) AS imports FROM (SELECT module FROM v_imports_py UNION ALL SELECT module FROM v_imports_js) GROUP BY 1)
  SELECT module, imports, 1 AS unique_modules FROM i UNION ALL SELECT NULL, sum(imports)::bigint, count(*) FROM i""")
def _(t):
    return graph.import_frequency(imports(t))
