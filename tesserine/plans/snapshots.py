"""Snapshots and change sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from ..operators import analysis, changeset, results, scores, snapshots, structure
from ..session import scratch_path, stored
from ..functions.rules import DIFF_EXTENSIONS
from .base import q, query, strip, view
from .structures import src


@query("file_hash", "SELECT project, file_path, sha256(content) AS sha256 FROM v_corpus")
def _(t):
    return snapshots.file_hash(t.corpus)


@query("project_hash", "SELECT DISTINCT project, left(sha256('/work/' || project), 12) AS project_hash FROM v_corpus")
def _(t):
    return scores.projects(t.corpus).select("project", snapshots.project_hash(F.concat(F.lit("/work/"), col("project"))).alias("project_hash"))


view("v_changes", """SELECT coalesce(o.project, n.project) AS project, coalesce(o.file_path, n.file_path) AS file_path,
  CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' WHEN o.content <> n.content THEN 'modified' END AS status FROM v_snap_old o FULL JOIN v_snap_new n ON o.file_path = n.file_path""")


@query("changed_files", "SELECT project, file_path, status FROM v_changes WHERE status IS NOT NULL")
def _(t):
    return snapshots.changed_files(t.snap_old, t.snap_new)


@query("change_status", """SELECT project, CASE WHEN old = 0 THEN 'no_cache' WHEN n + m + d = 0 THEN 'no_changes' ELSE 'has_changes' END AS status, n AS new_files, m AS modified_files, d AS deleted_files,
  n + m + d AS total_changes, CASE WHEN cur > 0 THEN cast(round_even(cast((n + m + d) / cur * 100 AS double), 2) AS double) ELSE 0.0 END AS change_percentage, n + m + d > 0 AS should_reanalyze FROM (
  SELECT project, count(*) FILTER (status = 'new') AS n, count(*) FILTER (status = 'modified') AS m, count(*) FILTER (status = 'deleted') AS d FROM v_changes GROUP BY 1)
  JOIN (SELECT project, count(*) FILTER (s = 'new') AS cur, count(*) FILTER (s = 'old') AS old FROM (SELECT project, 'new' AS s FROM v_snap_new UNION ALL SELECT project, 'old' FROM v_snap_old) GROUP BY 1) USING (project)""")
def _(t):
    return snapshots.change_status(t.snap_old, t.snap_new)


RESULT = "language string, cyclomatic int, smells int, total_lines int"


def _metrics(files):
    from ..operators import files as fl

    m = structure.file_metrics_py(files).unionByName(structure.file_metrics_js(files)).withColumn("smells", (col("cyclomatic") > 3).cast("int"))
    return m.select("digest", fl.language("file_path").alias("language"), "cyclomatic", "smells", "total_lines")


def merged(t):
    """The old snapshot is analysed into a store of results; the run over the new one takes from it what it can."""
    path = scratch_path(t.spark, "results")
    results.create(t.spark, path, "1", RESULT)
    results.analyse_new(t.snap_old, path, "1", "old", _metrics)
    return results.incremental(t.snap_new, path, "1", "new", _metrics)


# The merge must equal the metrics of the new snapshot, by whichever way each row came.
view("v_old_texts", "SELECT DISTINCT lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) AS ext, content FROM v_snap_old")
view("v_merged", """SELECT m.project, m.file_path, r.language, m.cyclomatic, (m.cyclomatic > 3)::int AS smells, m.total_lines, CASE WHEN o.content IS NULL THEN 'fresh' ELSE 'cache' END AS origin
  FROM v_file_metrics m JOIN v_snap_new n USING (file_path) JOIN v_report r USING (file_path)
  LEFT JOIN v_old_texts o ON o.content = n.content AND o.ext = lower(regexp_extract(n.file_path, '(\\.[^./]*)$', 1))""")


@query("merge_incremental", "SELECT project, file_path, language, cyclomatic, smells, total_lines, origin FROM v_merged")
def _(t):
    return merged(t)


@query("merge_summary", "SELECT project, language, count(*) AS files, sum(cyclomatic)::bigint AS total_complexity, sum(smells)::bigint AS total_code_smells, count(*) FILTER (origin = 'cache') AS from_cache FROM v_merged GROUP BY 1, 2")
def _(t):
    return snapshots.merge_summary(merged(t))


@query("reuse_by_hash", """SELECT n.file_path, EXISTS (SELECT 1 FROM v_snap_old o JOIN v_corpus c USING (file_path) WHERE o.content = n.content AND c.doc_id % 3 <> 0) AS reused FROM v_snap_new n""")
def _(t):
    """Stored results are an hour old, those of every third document a day; the TTL is two hours."""
    age = F.when(col("doc_id") % 3 == 0, F.expr("timestamp'2024-01-01 00:00:00'")).otherwise(F.expr("timestamp'2024-01-01 23:00:00'"))
    ids = t.corpus.select("file_path", "doc_id")
    known = t.snap_old.join(ids, "file_path").select(F.sha2("content", 256).alias("sha256"), age.alias("created_at"))
    return snapshots.reuse_flags(t.snap_new, known, "2024-01-02 00:00:00", 7200).select("file_path", "reused")


# ---- change sets ------------------------------------------------------------

view("v_dlines", f"""SELECT *, sum(CASE WHEN starts_with(line, 'diff --git') THEN 1 ELSE 0 END) OVER (PARTITION BY change_id ORDER BY n)::int AS file_no FROM (
  SELECT project, change_id, unnest(string_split(diff_text, chr(10))) AS line, unnest(range(1, len(string_split(diff_text, chr(10))) + 1)) AS n FROM v_difftext)""")
view("v_dfiles", f"""SELECT min(project) AS project, change_id, file_no, max(CASE WHEN starts_with(line, 'diff --git') THEN {strip("string_split(line, ' b/')[-1]")} END) AS file_path,
   coalesce(arg_max(CASE WHEN starts_with(line, 'new file') THEN 'added' WHEN starts_with(line, 'deleted file') THEN 'deleted' WHEN starts_with(line, 'rename from') THEN 'renamed' END, n)
     FILTER (starts_with(line, 'new file') OR starts_with(line, 'deleted file') OR starts_with(line, 'rename from')), 'modified') AS change_type,
   count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS additions, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS deletions
  FROM v_dlines WHERE file_no > 0 GROUP BY change_id, file_no""")
_H = "^@@ *-([0-9]+)(?:,([0-9]+))? *\\+([0-9]+)(?:,([0-9]+))? *@@"


@query("diff_files", "SELECT change_id, file_no, file_path, change_type, additions, deletions FROM v_dfiles")
def _(t):
    return changeset.diff_files(t.difftext).drop("project")


@query("diff_hunks", f"""SELECT h.change_id, h.file_no, f.file_path, hunk_no, regexp_extract(line, '{_H}', 1)::int AS old_start, coalesce(nullif(regexp_extract(line, '{_H}', 2), ''), '1')::int AS old_lines,
   regexp_extract(line, '{_H}', 3)::int AS new_start, coalesce(nullif(regexp_extract(line, '{_H}', 4), ''), '1')::int AS new_lines FROM (
   SELECT *, row_number() OVER (PARTITION BY change_id, file_no ORDER BY n) AS hunk_no FROM v_dlines WHERE file_no > 0 AND regexp_matches(line, '{_H}')) h JOIN v_dfiles f USING (change_id, file_no)""")
def _(t):
    return changeset.diff_hunks(t.difftext)


@query("changed_file_list", f"SELECT change_id, {strip('line')} AS file_path FROM v_dlines WHERE {strip('line')} <> ''")
def _(t):
    return changeset.changed_file_list(t.difftext.drop("project"), "diff_text")


view("v_djoin", f"""SELECT d.*, r.functions, r.classes, r.smells AS code_smells, r.cyclomatic AS complexity FROM v_dfiles d JOIN v_report r USING (project, file_path)
  WHERE change_type <> 'deleted' AND regexp_extract(d.file_path, '(\\.[^./]*)$', 1) IN ({', '.join(q(e) for e in DIFF_EXTENSIONS)})""")
view("v_assess", """SELECT a.project, a.change_id, total_files, total_additions, total_deletions, coalesce(n, 0) AS files_analyzed, coalesce(s, 0) AS total_code_smells, coalesce(c, 0) AS total_complexity, coalesce(w, 0) AS files_with_smells FROM (
   SELECT project, change_id, count(*) AS total_files, sum(additions)::bigint AS total_additions, sum(deletions)::bigint AS total_deletions FROM v_dfiles GROUP BY 1, 2) a LEFT JOIN (
   SELECT project, change_id, count(*) AS n, sum(code_smells)::bigint AS s, sum(complexity)::bigint AS c, count(*) FILTER (code_smells > 0) AS w FROM v_djoin GROUP BY 1, 2) b USING (project, change_id)""")
def changed_report(t):
    """The report of the files that the changes name; the others are sorted out where they are read."""
    named = stored(changeset.diff_files(t.difftext).select("project", "file_path").distinct(), "changed")
    return analysis.report(analysis.analysed(src(t).where(results.may_be_among(named))))


_A = ["project", "change_id", "total_files", "total_additions", "total_deletions", "files_analyzed", "total_code_smells", "total_complexity", "files_with_smells"]


@query("diff_join_metrics", "SELECT project, change_id, file_path, change_type, additions, deletions, functions, classes, code_smells, complexity FROM v_djoin")
def _(t):
    return changeset.diff_join_metrics(t.difftext, changed_report(t)).select("project", "change_id", "file_path", "change_type", "additions", "deletions", "functions", "classes", "code_smells", "complexity")


@query("diff_assessment", f"SELECT {', '.join(_A)} FROM v_assess")
def _(t):
    return changeset.diff_assessment(t.difftext, changed_report(t)).select(*_A)


@query("diff_risk", """SELECT project, change_id, CASE WHEN total_additions = 0 THEN 'low' WHEN total_code_smells / (total_additions / 50) > 3 OR total_complexity / (total_additions / 50) > 15 THEN 'high'
  WHEN total_code_smells / (total_additions / 50) > 1.5 OR total_complexity / (total_additions / 50) > 8 THEN 'medium' ELSE 'low' END AS risk_level FROM v_assess""")
def _(t):
    return changeset.diff_assessment(t.difftext, changed_report(t)).select("project", "change_id", "risk_level")


@query("diff_recommendation", """SELECT project, change_id, CASE WHEN total_additions = 0 THEN 'No code additions in this PR.' ELSE CASE WHEN total_code_smells = 0 THEN 'No code smells detected in changed files.'
  WHEN total_code_smells <= 3 THEN 'Minor issues: ' || total_code_smells || ' code smell(s) in ' || files_with_smells || ' file(s). Consider quick review.'
  ELSE 'Significant issues: ' || total_code_smells || ' code smell(s) in ' || files_with_smells || ' file(s). Thorough review recommended.' END ||
  CASE WHEN total_additions > 500 THEN ' Large PR (>500 additions). Consider splitting into smaller PRs.' ELSE '' END END AS recommendation FROM v_assess""")
def _(t):
    return changeset.diff_assessment(t.difftext, changed_report(t)).select("project", "change_id", "recommendation")
