"""Blocks, copies and similar pairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from ..functions import text as tx
from ..operators import clones
from .base import lang, query, strip, view

view("v_blocks", f"""SELECT project, project || ':' || file_path || ':' || (i + 1) AS block_id, file_path, i + 1 AS start_line, i + 6 AS end_line, array_to_string(l[i + 1:i + 6], chr(10)) AS content,
  coalesce({lang('ext', 'dependency', fold=False)}, 'unknown') AS language FROM (
  SELECT *, unnest(range(0, len(l) - 5, 3)) AS i FROM (SELECT *, string_split(content, chr(10)) AS l FROM v_corpus))
  WHERE {strip("array_to_string(l[i + 1:i + 6], chr(10))")} <> ''""")
_NORM = f"array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: {strip('string_split(x, chr(35))[1]')}), lambda x: x <> ''), chr(10))"
view("v_groups", """SELECT hash, copies, first_id, lines, (copies * (copies - 1) / 2)::bigint AS pairs FROM (SELECT sha256(content) AS hash, count(*) AS copies, min(block_id) AS first_id,
  sum(end_line - start_line + 1)::bigint AS lines FROM v_blocks GROUP BY 1)""")
view("v_contents", f"""SELECT min(block_id) AS block_id, count(*) AS copies, norm FROM (SELECT block_id, {_NORM} AS norm FROM v_blocks) GROUP BY norm""")
view("v_shingles", """SELECT block_id, copies, len(s) AS n, unnest(s) AS sh FROM (SELECT *, list_distinct(list_transform(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) WHEN len(w) > 0 THEN [1] ELSE [] END,
   lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM (SELECT *, regexp_extract_all(norm, '[\\p{L}\\p{N}_]+') AS w FROM v_contents))""")
view("v_similar", """SELECT block_id1, block_id2, copies1, copies2, round(shared / (n1 + n2 - shared), 6) AS similarity, copies1 * copies2 AS pairs FROM (
   SELECT a.block_id AS block_id1, b.block_id AS block_id2, max(a.copies) AS copies1, max(b.copies) AS copies2, max(a.n) AS n1, max(b.n) AS n2, count(*) AS shared
   FROM v_shingles a JOIN v_shingles b ON a.sh = b.sh AND a.block_id < b.block_id GROUP BY 1, 2) WHERE shared / (n1 + n2 - shared) >= 0.7
  UNION ALL SELECT block_id, block_id, copies, copies, 1.0, (copies * (copies - 1) / 2)::bigint FROM (SELECT DISTINCT block_id, copies FROM v_shingles) WHERE copies > 1""")


def blocks(t):
    return clones.blocks_sliding(t.corpus)


_B = ["project", "block_id", "file_path", "start_line", "end_line", "content", "language"]


@query("blocks_sliding", f"SELECT {', '.join(_B)} FROM v_blocks")
def _(t):
    return blocks(t).select(*_B)


view("v_numbered", f"""SELECT file_path, line_number - 1 AS i, {strip('line')} AS s, line_number = max(line_number) OVER (PARTITION BY file_path) AS last, line FROM v_lines""")
# Each cut depends on the one before: the next cut is the first eligible line at least five lines after the last.
view("v_eligible", "SELECT file_path, i FROM v_numbered WHERE starts_with(s, 'def ') OR starts_with(s, 'class ') OR last")
view("v_cuts", """SELECT file_path, 0 AS st0, (SELECT min(e.i) FROM v_eligible e WHERE e.file_path = f.file_path AND e.i >= 4) AS i FROM (SELECT DISTINCT file_path FROM v_lines) f
  UNION ALL SELECT c.file_path, c.i + 1, (SELECT min(e.i) FROM v_eligible e WHERE e.file_path = c.file_path AND e.i >= c.i + 5) FROM v_cuts c WHERE c.i IS NOT NULL""")


@query("blocks_segmented", """SELECT c.file_path, c.st0 AS start_line, c.i AS end_line, string_agg(n.line, chr(10) ORDER BY n.i) AS content FROM v_cuts c
  JOIN v_numbered n ON n.file_path = c.file_path AND n.i BETWEEN c.st0 AND c.i WHERE c.i - c.st0 + 1 > 5 GROUP BY 1, 2, 3""")
def _(t):
    return clones.blocks_segmented(t.corpus).select("file_path", "start_line", "end_line", "content")


@query("block_filter_min", "SELECT block_id, end_line - start_line + 1 AS line_count FROM v_blocks WHERE end_line - start_line + 1 >= 5")
def _(t):
    return clones.block_filter_min(blocks(t)).select("block_id", clones.line_count().alias("line_count"))


@query("block_normalize", f"SELECT block_id, {_NORM} AS normalized FROM v_blocks")
def _(t):
    return blocks(t).select("block_id", clones.normalize("content").alias("normalized"))


@query("duplicates_exact", "SELECT g.hash, b.block_id, g.first_id, g.copies, g.pairs FROM v_groups g JOIN v_blocks b ON sha256(b.content) = g.hash WHERE g.copies > 1")
def _(t):
    return clones.duplicates_exact(blocks(t)).drop("first_project")


@query("similar_pairs", "SELECT block_id1, block_id2, copies1, copies2, similarity, pairs FROM v_similar")
def _(t):
    return clones.similar_pairs(blocks(t)).drop("project")


@query("similar_pairs_lsh")
def _(t):
    return clones.similar_pairs_lsh(blocks(t)).drop("project")


_W = lambda x: f"list_distinct(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'))"


# The checking engine's edit distance counts bytes, so the accented letters of the data become one byte each first.
_ACCENTS = "çäÄóèñÑÊíêüÖÍÜÈöÓéÉßÇ"
_ONE = lambda x: f"translate({x}, '{_ACCENTS}', " + "||".join(f"chr({c})" for c in [*range(1, 9), 11, 12, *range(14, 25)]) + ")"


@query("pair_similarity", f"""SELECT file_path, line_number, CASE WHEN either = 0 THEN 1.0 ELSE round(shared / either, 6) END AS jaccard,
  CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE round(1 - levenshtein({_ONE('a')}, {_ONE('b')}) / greatest(length(a), length(b)), 6) END AS edit_similarity FROM (
  SELECT *, len(list_intersect({_W('a')}, {_W('b')})) AS shared, len(list_distinct(list_concat({_W('a')}, {_W('b')}))) AS either FROM (
  SELECT file_path, line_number, line AS a, lead(line) OVER (PARTITION BY file_path ORDER BY line_number) AS b FROM v_lines) WHERE b IS NOT NULL)""")
def _(t):
    """Each line against the next one of its file; a line's words are taken once for both of its pairs."""
    lines = F.transform(F.split("content", "\n", -1), lambda x: F.struct(x.alias("text"), clones.distinct_words(x).alias("words")))
    pairs = tx.let(lines, lambda l: F.transform(F.slice(l, 1, F.size(l) - 1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("a"), F.element_at(l, i + 2).alias("b"))))
    p = tx.one_each(t.corpus, pairs, "p", "file_path").select("file_path", col("p.n").alias("line_number"), "p.a", "p.b")
    jac, edit = clones.pair_similarity(col("a.text"), col("b.text"), col("a.words"), col("b.words"))
    return p.select("file_path", "line_number", jac.alias("jaccard"), edit.alias("edit_similarity"))


@query("pair_classify", "SELECT block_id1, block_id2, similarity, similarity >= 0.95 AS is_duplicate, similarity >= 0.7 AS is_similar FROM v_similar")
def _(t):
    p = clones.similar_pairs(blocks(t))
    return clones.pair_classify(p).select("block_id1", "block_id2", "similarity", "is_duplicate", "is_similar")


@query("duplication_ratio", """SELECT sum(copies)::bigint AS blocks, sum(pairs)::bigint AS duplicate_pairs, round(sum((copies - 1) * lines) / sum(lines), 6) AS duplication_ratio,
  round(sum(lines - lines / copies) / sum(lines), 6) AS redundant_ratio FROM v_groups""")
def _(t):
    return clones.duplication_ratio(blocks(t))


@query("clone_summary", """SELECT 'total_blocks' AS kind, NULL::varchar AS block_id1, NULL::varchar AS block_id2, NULL::double AS similarity, sum(copies)::bigint AS pairs FROM v_groups
  UNION ALL SELECT 'duplicate_pairs', NULL, NULL, NULL, sum(pairs)::bigint FROM v_groups UNION ALL SELECT 'similar_pairs', NULL, NULL, NULL, sum(pairs)::bigint FROM v_similar
  UNION ALL SELECT * EXCLUDE r FROM (SELECT 'duplicate', g.first_id, b.block_id, 1.0, 1, row_number() OVER (PARTITION BY split_part(g.first_id, ':', 1) ORDER BY g.first_id, b.block_id) AS r
    FROM v_groups g JOIN v_blocks b ON sha256(b.content) = g.hash WHERE g.first_id <> b.block_id) WHERE r <= 10
  UNION ALL SELECT * EXCLUDE r FROM (SELECT 'similar', block_id1, block_id2, similarity, pairs, row_number() OVER (PARTITION BY split_part(block_id1, ':', 1) ORDER BY similarity DESC, block_id1, block_id2) AS r
    FROM v_similar) WHERE r <= 10""")
def _(t):
    return clones.clone_summary(blocks(t), 10)
