"""SARIF shaping, project classification and review texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from ..functions import rules as rl
from ..operators import projects, reports, reviews, scan
from ..session import cut_lineage
from .base import q, query, strip, view
from .structures import all_smells, src

_LEVEL = lambda s: "CASE " + s + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rl.SARIF_LEVEL.items()) + " ELSE 'warning' END"
view("v_issues", """SELECT project, 0 AS source, file_path, line_number, name AS rule_id, 0 AS pattern_idx, severity, suggestion AS rule_text, description AS message FROM v_smells
  UNION ALL SELECT project, 1, file_path, line_number, rule_id, pattern_idx, severity, description, description FROM v_security""")
view("v_sarif_rules", f"""SELECT project, rule_id, row_number() OVER (PARTITION BY project ORDER BY source, file_path, line_number, rule_id, pattern_idx, message) - 1 AS rule_index, rule_text AS description, {_LEVEL('severity')} AS level FROM (
  SELECT *, row_number() OVER (PARTITION BY project, rule_id ORDER BY source, file_path, line_number, pattern_idx, message) AS r FROM v_issues) WHERE r = 1""")


def issues(t):
    """Read for the rules and again for the results, so the scans run once and are written."""
    return cut_lineage(reports.issues(all_smells(t), scan.scan_lines(src(t), rl.SECURITY)))


@query("sarif_rules", "SELECT project, rule_id, rule_index, description, level FROM v_sarif_rules")
def _(t):
    return reports.sarif_rules(issues(t)).drop("results")


@query("sarif_results", f"""SELECT i.project, i.rule_id, r.rule_index, {_LEVEL('i.severity')} AS level, i.message, i.file_path AS uri, i.line_number AS start_line FROM v_issues i JOIN v_sarif_rules r USING (project, rule_id)""")
def _(t):
    i = issues(t)
    return reports.sarif_results(i, reports.sarif_rules(i))


@query("location_split", "SELECT location, file_path AS uri, line_number AS start_line FROM (SELECT file_path || ':' || line_number AS location, file_path, line_number FROM v_security) UNION ALL SELECT file_path, file_path, 1 FROM v_corpus")
def _(t):
    hit = scan.scan_lines(src(t), rl.SECURITY).select(F.concat("file_path", F.lit(":"), col("line_number").cast("string")).alias("location"))
    both = hit.unionByName(t.corpus.select(col("file_path").alias("location")))
    uri, line = reports.location_split("location")
    return both.select("location", uri.alias("uri"), line.alias("start_line"))


@query("sarif_document", """SELECT project, 0 AS part, 1 AS parts, count(*) AS result_count, max(n) AS rule_count FROM v_issues JOIN (SELECT project, count(*) AS n FROM v_sarif_rules GROUP BY 1) USING (project) GROUP BY 1""")
def _(t):
    i = issues(t)
    rules = reports.sarif_rules(i)
    d = reports.sarif_document(reports.sarif_results(i, rules), rules, 50_000)
    # counted from the document text itself
    return d.select("project", "part", "parts", F.json_array_length(F.get_json_object("document", "$.runs[0].results")).alias("result_count"),
                    F.json_array_length(F.get_json_object("document", "$.runs[0].tool.driver.rules")).alias("rule_count"))


# ---- manifests --------------------------------------------------------------

_names = {"package.json": "pkg", "requirements.txt": "req", "pyproject.toml": "pyp", "go.mod": "gomod", "Cargo.toml": "cargo", "pom.xml": "pom", ".env": "env", "bun.lockb": "bunlock"}
view("v_wide", "SELECT project, " + ", ".join(f"arg_min(content, len(string_split(file_path, '/')) || ' ' || file_path || ' ' || content) FILTER (WHERE file_name = {q(k)}) AS {v}" for k, v in _names.items()) + ", bool_or(ends_with(file_name, '.html')) AS html FROM v_manifests GROUP BY 1")
view("v_types", """SELECT *, CASE WHEN pkg IS NOT NULL THEN CASE WHEN contains(deps, 'next') THEN 'nextjs' WHEN contains(deps || dev, 'nuxt') THEN 'nuxt' WHEN contains(deps, 'react') OR contains(deps || dev, 'vite') THEN 'react'
    WHEN contains(deps, 'vue') THEN 'vue' WHEN contains(deps, '@angular/core') THEN 'angular' WHEN contains(deps, 'express') THEN 'express' ELSE 'node' END
   WHEN req IS NOT NULL OR pyp IS NOT NULL THEN CASE WHEN contains(lower(coalesce(req, '')), 'fastapi') OR contains(lower(coalesce(pyp, '')), 'fastapi') THEN 'fastapi' ELSE 'python' END
   WHEN gomod IS NOT NULL THEN CASE WHEN contains(lower(gomod), 'gin') THEN 'gin' ELSE 'go' END WHEN cargo IS NOT NULL THEN 'rust' WHEN pom IS NOT NULL THEN 'java' WHEN html THEN 'static' ELSE 'unknown' END AS project_type
  FROM (SELECT *, coalesce(json_extract(pkg, '$.dependencies')::varchar, '{}') AS deps, coalesce(json_extract(pkg, '$.devDependencies')::varchar, '{}') AS dev FROM v_wide)""")


@query("project_type", """SELECT project, project_type, CASE WHEN pyp IS NOT NULL THEN 'python' WHEN pkg IS NOT NULL THEN 'node' WHEN gomod IS NOT NULL THEN 'go' WHEN pom IS NOT NULL THEN 'java-maven' WHEN cargo IS NOT NULL THEN 'rust' ELSE 'unknown' END AS build_type,
  req IS NOT NULL AS has_requirements FROM v_types""")
def _(t):
    return projects.project_type(t.manifests)


@query("manifest_dependencies", f"""SELECT project, 'python' AS ecosystem, d AS dependency FROM (SELECT project, {strip('d')} AS d FROM (SELECT project, unnest(string_split(content, chr(10))) AS d FROM v_manifests WHERE file_name = 'requirements.txt'))
  WHERE d <> '' AND NOT starts_with(d, '#') UNION ALL SELECT project, 'node', unnest(list_distinct(list_concat(coalesce(json_keys(content, '$.dependencies'), []), coalesce(json_keys(content, '$.devDependencies'), [])))) FROM v_manifests WHERE file_name = 'package.json'""")
def _(t):
    return projects.manifest_dependencies(t.manifests)


view("v_env", f"""SELECT project, file_name, key, arg_max(value, n) AS value FROM (SELECT project, file_name, n, {strip('left(b, position(chr(61) IN b) - 1)')} AS key,
   trim(trim({strip('substr(b, position(chr(61) IN b) + 1)')}, '"'), '''') AS value FROM (SELECT project, file_name, {strip('l')} AS b, n FROM (
   SELECT project, file_name, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM v_manifests WHERE starts_with(file_name, '.env')))
   WHERE contains(b, '=') AND NOT starts_with(b, '#')) GROUP BY 1, 2, 3""")


@query("env_pairs", "SELECT project, file_name, key, value FROM v_env")
def _(t):
    return projects.env_pairs(t.manifests)


def _values(d: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {v if isinstance(v, int) else q(v)}" for k, v in d.items()) + " END"


_SCRIPT = ", ".join(f"nullif(regexp_extract(coalesce(json_extract_string(pkg, '$.scripts.{s}'), ''), '{rx}', 1), '')" for s in ("dev", "start", "serve") for rx in (r"--port\s+([0-9]+)", r"-p\s+([0-9]+)"))


@query("detect_port", f"""SELECT t.project, t.project_type, coalesce(e.port, coalesce({_SCRIPT})::int, {_values(rl.DEFAULT_PORTS, 't.project_type')}, 3000) AS port FROM v_types t LEFT JOIN (
  SELECT project, arg_min(try_cast(value AS int), list_position(['.env', '.env.local', '.env.production', '.env.development'], file_name)) AS port FROM v_env WHERE key = 'PORT' AND try_cast(value AS int) IS NOT NULL GROUP BY 1) e USING (project)""")
def _(t):
    return projects.detect_port(t.manifests)


_PY = r"python\s*=\s*[\"'']>=?([0-9]+)\.([0-9]+)".replace('\\"', '"')


@query("base_image", f"""SELECT project, project_type, CASE WHEN contains(lower(coalesce(json_extract_string(pkg, '$.packageManager'), '')), 'bun') OR bunlock IS NOT NULL
   THEN coalesce({_values(rl.BASE_IMAGES, "project_type || '-bun'")}, {_values(rl.BASE_IMAGES, 'project_type')}, 'node:20-alpine')
   WHEN project_type IN ('fastapi', 'python') AND regexp_matches(coalesce(pyp, ''), '{_PY}') THEN 'python:' || regexp_extract(pyp, '{_PY}', 1) || '.' || regexp_extract(pyp, '{_PY}', 2) || '-slim'
   WHEN project_type IN ('nextjs', 'react', 'vue', 'angular', 'express', 'nuxt', 'node') AND regexp_extract(coalesce(json_extract_string(pkg, '$.engines.node'), ''), '([0-9]+)', 1) <> ''
   THEN 'node:' || regexp_extract(json_extract_string(pkg, '$.engines.node'), '([0-9]+)', 1) || '-alpine' ELSE coalesce({_values(rl.BASE_IMAGES, 'project_type')}, 'node:20-alpine') END AS base_image FROM v_types""")
def _(t):
    return projects.base_image(t.manifests)


_KD = ", ".join(f"'{d}=' || json_extract_string(pkg, '$.dependencies.{d}')" for d in projects.KEY_DEPENDENCIES)


@query("framework_versions", f"""SELECT project, CASE WHEN pyp IS NOT NULL THEN coalesce(nullif(regexp_extract(pyp, 'python\\s*=\\s*["'']([^"'']+)["'']', 1), ''), '{projects.UNSTATED}') END AS python_version,
  CASE WHEN pkg IS NOT NULL THEN coalesce(json_extract_string(pkg, '$.engines.node'), '{projects.UNSTATED}') END AS node_version,
  CASE WHEN pkg IS NOT NULL THEN coalesce(array_to_string(list_filter([{_KD}], lambda x: x IS NOT NULL), ','), '') END AS key_dependencies,
  CASE WHEN gomod IS NOT NULL THEN coalesce(nullif(regexp_extract(gomod, 'go\\s+([0-9.]+)', 1), ''), '{projects.UNSTATED}') END AS go_version FROM v_wide""")
def _(t):
    return projects.framework_versions(t.manifests)


@query("db_indicators", """SELECT project, n AS database FROM v_manifests, (VALUES ('postgres', 'PostgreSQL'), ('mysql', 'MySQL'), ('mongodb', 'MongoDB'), ('redis', 'Redis')) d(k, n) WHERE file_name = '.env' AND contains(lower(content), k)""")
def _(t):
    return projects.db_indicators(t.manifests)


# ---- reviews ----------------------------------------------------------------


@query("review_score", "SELECT conv_id, turn, try_cast(nullif(regexp_extract(text, '([0-9]+)[\\s/]*10', 1), '') AS int) AS score FROM v_reviews")
def _(t):
    return reviews.review_score(t.reviews)


view("v_rlines", f"""SELECT conv_id, turn, line, {strip('line')} AS b, n FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM v_reviews)""")


def _bullets(kind: str, heads, marks, lead, over, patient, fold) -> str:
    """First heading, then the first blank line after it (for a patient scan: after the first item)."""
    l = "lower(line)" if fold else "line"
    head = "(" + " OR ".join(f"contains({l}, {q(h)})" for h in heads) + ")"
    mark = "(" + " OR ".join(f"starts_with(b, {q(m)})" for m in marks) + ")"
    item = strip(f"ltrim(b, {q(lead)})") if lead else "b"
    gate = "coalesce(first_item, 999999999)" if patient else "h"
    return f"""SELECT conv_id, turn, '{kind}' AS section, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) AS item_no, item FROM (
      SELECT *, min(CASE WHEN b = '' AND n > {gate} THEN n END) OVER (PARTITION BY conv_id, turn) AS stop FROM (
      SELECT *, min(CASE WHEN ok THEN n END) OVER (PARTITION BY conv_id, turn) AS first_item FROM (
      SELECT *, n > h AND NOT {head} AND {mark} AND length(item) > {over} AS ok FROM (
      SELECT *, min(CASE WHEN {head} THEN n END) OVER (PARTITION BY conv_id, turn) AS h, {item} AS item FROM v_rlines)))) WHERE ok AND (stop IS NULL OR n < stop)"""


@query("review_bullets", " UNION ALL ".join(_bullets(k, **v) for k, v in reviews.BULLET_KINDS.items()))
def _(t):
    return reviews.review_bullets(t.reviews)


_UP = "(?i)([A-Za-z]+)\\s+([0-9]+[.0-9]*)\\s*(?:->|to|升级到)\\s*([0-9]+[.0-9]*)"


@query("upgrade_triples", f"""SELECT conv_id, turn, unnest(range(1, len(a) + 1)) AS match_no, unnest(a) AS name, unnest(b) AS current_version, unnest(c) AS recommended_version FROM (
  SELECT conv_id, turn, regexp_extract_all(text, '{_UP}', 1) AS a, regexp_extract_all(text, '{_UP}', 2) AS b, regexp_extract_all(text, '{_UP}', 3) AS c FROM v_reviews)""")
def _(t):
    return reviews.upgrade_triples(t.reviews)


@query("upgrade_steps", f"""SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS step_no, {strip('unnest(s)')} AS step FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?i)(?:步骤|step)\\s*[0-9]+[:：]?\\s*([^\\n]+)', 1) AS s FROM v_reviews)""")
def _(t):
    return reviews.upgrade_steps(t.reviews)


@query("risk_keywords", """SELECT conv_id, turn, CASE WHEN contains(text, '低风险') OR contains(lower(text), 'low risk') THEN '低' WHEN contains(text, '高风险') OR contains(lower(text), 'high risk') THEN '高'
  WHEN contains(text, '中风险') OR contains(lower(text), 'medium risk') THEN '中' END AS risk_level FROM v_reviews""")
def _(t):
    return reviews.risk_keywords(t.reviews)


def _first(*rxs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i){r}', 1), '')" for r in rxs) + ")"


@query("strategy_fields", f"""SELECT conv_id, turn, {_first('FROM[[:space:]]+([a-z0-9/_:.-]+)', '(?:基础镜像|推荐镜像)[:：[:space:]]*([a-z0-9/_:.-]+)')} AS base_image,
  try_cast({_first('EXPOSE[[:space:]]*([0-9]+)', '(?:端口|PORT)[:：[:space:]]*([0-9]+)')} AS int) AS port, regexp_matches(text, '(?i)(数据库|mysql|postgres|mongodb)') AS needs_database,
  regexp_matches(text, '(?i)(多阶段构建|multi-stage)') AS multi_stage, {_first('(?:镜像大小|目标)[:：[:space:]]*(?:<?[[:space:]]*)?([0-9]+(?:-[0-9]+)?[[:space:]]*MB)')} AS target_size FROM v_reviews""")
def _(t):
    return reviews.strategy_fields(t.reviews)
