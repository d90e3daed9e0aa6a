"""Query registry, and the named views of the checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules as rl
from ..functions import text as tx
from ..sources import snippets
from ..sources import views as vw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(vw.Tables(spark, sf_dir))
        QUERIES[name].__name__ = name
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _names(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\bv_\w+", sql)) if n in VIEWS]


def used_views(sql: str) -> list[str]:
    """Views named in ``sql``, directly or not, in order of dependence."""
    order: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for n in _names(text):
            if n not in open_:
                open_.add(n)
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    ctes = ",\n".join(f"{n} AS {'' if n in _names(VIEWS[n]) else 'MATERIALIZED '}({VIEWS[n]})" for n in used_views(sql))
    return f"WITH RECURSIVE {ctes}\nSELECT * FROM (\n{sql}\n)" if ctes else sql


# ---- SQL helpers ------------------------------------------------------------

WS = "(' '||" + "||".join(f"chr({c})" for c in tx.WS_CODES[1:]) + ")"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def re2(pattern: str) -> str:
    """A rule pattern for the checking engine's regex dialect, as a SQL literal."""
    if pattern == r'(?<!["\w])\d{2,}(?!["\w])':
        pattern = r'(^|[^"\w])\d{2,}($|[^"\w])'
    out, i, in_class = "", 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\w":
            out += r"\p{L}\p{N}_" if in_class else r"[\p{L}\p{N}_]"
            i += 2
        elif two == r"\d":
            out += "0-9" if in_class else "[0-9]"
            i += 2
        elif pattern[i] == "\\":
            out += two
            i += 2
        else:
            in_class = {"[": True, "]": False}.get(pattern[i], in_class)
            out += pattern[i]
            i += 1
    return q(out)


def half_even(x: str, n: int) -> str:
    return f"cast(round_even(cast({x} AS double), {n}) AS double)"


def lang(path_ext: str, name: str, fold: bool = True) -> str:
    e = f"lower({path_ext})" if fold else path_ext
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rl.LANGUAGE_MAPS[name].items())
    return f"CASE {e} {arms} END"


_table = ", ".join(q(s) for s in snippets.snippet_table())
view("v_paths", vw.PATHS.replace("{documents}", "documents"))
view("v_corpus", f"SELECT doc_id, project, lang, file_path, ext, text || chr(10) || ([{_table}])[doc_id % {snippets.PERIOD} + 1] AS content FROM v_paths")
view("v_lines", """SELECT project, file_path, ext, unnest(string_split(content, chr(10))) AS line,
  unnest(range(1, len(string_split(content, chr(10))) + 1))::int AS line_number FROM v_corpus""")
view("v_snap_old", vw.SNAP_OLD.replace("{corpus}", "v_corpus"))
view("v_snap_new", vw.SNAP_NEW.replace("{corpus}", "v_corpus"))
view("v_links", """SELECT source, target FROM (SELECT url AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)""")
view("v_flow", """SELECT source, target, count(*) AS weight FROM (SELECT event_type AS source,
  lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL GROUP BY 1, 2""")
view("v_hist", vw.HIST.replace("{events}", "events"))
view("v_timings", vw.TIMINGS.replace("{events}", "events"))
view("v_metrics", vw.METRICS.replace("{corpus}", "v_corpus").replace("{labels}", "labels"))
view("v_manifests", vw.MANIFESTS.replace("{documents}", "documents"))
view("v_reviews", vw.REVIEWS.replace("{conversations}", "conversations"))
view("v_difftext", f"""SELECT min(project) AS project, change_id, string_agg(section, chr(10) ORDER BY doc_id) AS diff_text FROM (
  SELECT project, {vw.CHANGE_ID} AS change_id, doc_id, {vw.DIFF_HEAD} || array_to_string(list_transform(string_split(text, chr(10)),
    lambda x, i: (['+', '-', ' '])[(i - 1 + doc_id) % 3 + 1] || x), chr(10)) AS section FROM v_paths) GROUP BY change_id""")


def _scan_view(rules: list[rl.Rule]) -> str:
    parts = []
    for r in rules:
        for i, p in enumerate(r.patterns):
            if "\\n" in p:
                continue
            where = "" if "all" in r.languages else f"ext IN ({', '.join(q('.' + x) for x in r.languages)}) AND "
            parts.append(
                f"SELECT project, file_path, line_number, {strip('line')} AS line_content, {q(r.rule_set)} AS rule_set, {q(r.rule_id)} AS rule_id, "
                f"{i} AS pattern_idx, {q(r.name)} AS rule_name, {q(r.category)} AS category, {q(r.severity)} AS severity, "
                f"{rl.SEVERITY_WEIGHT[r.severity]}::double AS weight, {rl.SEVERITY_RANK[r.severity]} AS rank, {q(r.description)} AS description, "
                f"{q(r.suggestion)} AS suggestion, {r.effort_hours}::double AS effort_hours, {q(r.improvement)} AS improvement "
                f"FROM v_lines WHERE {where}regexp_matches(line, {re2(p)})")
    return "\nUNION ALL ".join(parts)


view("v_security", _scan_view(rl.SECURITY))
view("v_performance", _scan_view(rl.PERFORMANCE))
view("v_debt", _scan_view(rl.DEBT))

_rows = ",\n".join(
    f"({q(r.rule_id)}, {q(r.name)}, {q(r.description)}, {q(r.category)}, {q(r.severity)}, {q(r.language)}, true, "
    f"{'NULL' if r.threshold is None else r.threshold}, {q(r.suggestion)}, [{', '.join(map(q, r.tags))}])" for r in rl.STRUCTURE)
view("v_rules", f"SELECT * FROM (VALUES {_rows}) t(rule_id, name, description, category, severity, language, enabled, threshold, suggestion, tags)")

# ---- structure --------------------------------------------------------------

_IN = lambda words: "(" + ", ".join(map(q, words)) + ")"
CONTROL, COUNTED = _IN(["if", "elif", "for", "while", "except"]), _IN(["if", "elif", "for", "while", "with"])
NESTING = _IN(["if", "elif", "else", "for", "while", "with"])
_FLAT = "replace(line, chr(9), '        ')"
END_WORD = r"([^\p{L}\p{N}_]|$)"
view("v_sig", f"""SELECT *, starts_with(text, ')') OR starts_with(text, ']') OR starts_with(text, '}}') AS bracket,
   row_number() OVER (PARTITION BY file_path ORDER BY n) AS rn
  FROM (SELECT project, file_path, line_number AS n, length({_FLAT}) - length(ltrim({_FLAT}, ' ')) AS indent, {strip(_FLAT)} AS text,
    regexp_extract({_FLAT}, '^\\s*(async\\s+def|def|class|if|elif|else|for|while|with|except|try|finally){END_WORD}', 1) AS word
  FROM v_lines WHERE lower(ext) = '.py') WHERE text <> '' AND NOT starts_with(text, '#')""")
view("v_head", """SELECT s.*, CASE WHEN starts_with(word, 'async') THEN 'def' ELSE word END AS kind, starts_with(word, 'async') AS is_async,
  (SELECT min(c.n) FROM v_sig c WHERE c.file_path = s.file_path AND c.n > s.n AND c.indent <= s.indent AND NOT c.bracket) AS closer,
  coalesce(plain, 0) < coalesce(stat, 0) AS is_static
  FROM (SELECT *, max(CASE WHEN NOT starts_with(text, '@') THEN rn END) OVER w AS plain, max(CASE WHEN text = '@staticmethod' THEN rn END) OVER w AS stat
    FROM v_sig WINDOW w AS (PARTITION BY file_path ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s
  WHERE word <> '' AND NOT bracket""")
view("v_nested", f"""SELECT h.file_path, h.n, count(p.n) AS depth, max(p.n) AS parent_line, count(CASE WHEN p.kind IN {NESTING} THEN 1 END) AS nest
  FROM v_head h LEFT JOIN v_head p ON p.file_path = h.file_path AND p.n < h.n AND (p.closer IS NULL OR p.closer > h.n) GROUP BY 1, 2""")
view("v_outline", f"""SELECT h.project, h.file_path, h.n AS start_line, h.indent, h.kind,
   CASE WHEN h.kind IN ('def', 'class') THEN regexp_extract(h.text, '(?:def|class)\\s+([\\p{{L}}\\p{{N}}_]+)', 1) ELSE '' END AS name,
   h.text, h.is_async, h.is_static, k.parent_line, p.kind AS parent_kind, k.depth, k.nest,
   1 + (SELECT count(*) FROM v_head c WHERE c.file_path = h.file_path AND c.n > h.n AND (h.closer IS NULL OR c.n < h.closer) AND c.kind IN {CONTROL}) AS cyclomatic,
   coalesce((SELECT max(x.nest) + 1 - k.nest FROM v_head c JOIN v_nested x ON x.file_path = c.file_path AND x.n = c.n
     WHERE c.file_path = h.file_path AND c.n > h.n AND (h.closer IS NULL OR c.n < h.closer) AND c.kind IN {COUNTED}), 0) AS nesting,
   (SELECT count(*) FROM v_head c WHERE c.file_path = h.file_path AND c.n > h.n AND (h.closer IS NULL OR c.n < h.closer) AND c.kind IN {COUNTED}) AS control_count,
   (SELECT max(s.n) FROM v_sig s WHERE s.file_path = h.file_path AND s.n >= h.n AND (h.closer IS NULL OR s.n < h.closer)) AS end_line
  FROM v_head h JOIN v_nested k ON k.file_path = h.file_path AND k.n = h.n
  LEFT JOIN v_head p ON p.file_path = h.file_path AND p.n = k.parent_line""")
view("v_functions_py", f"""SELECT project, file_path, name, start_line, end_line, indent, parent_line, parent_kind, is_async, is_static,
   CASE WHEN list_position(n2, '/') > 0 THEN n2[list_position(n2, '/') + 1:] ELSE n2 END AS parameters,
   nullif(regexp_extract(text, '\\)\\s*->\\s*["'']?([\\p{{L}}\\p{{N}}_]+)["'']?\\s*:', 1), '') AS return_type,
   cyclomatic, nesting, control_count, end_line - start_line + 1 AS loc FROM (
  SELECT *, CASE WHEN star > 0 THEN n1[1:star - 1] ELSE n1 END AS n2 FROM (
  SELECT *, list_position(list_transform(n1, lambda p: starts_with(p, '*')), true) AS star FROM (
  SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_extract(text, '\\((.*)\\)', 1), '\\[[^\\]]*\\]|\\([^)]*\\)', '', 'g'), ','),
    lambda p: {strip("regexp_extract(p, '^([^:=]*)', 1)")}), lambda p: p <> '') AS n1 FROM v_outline WHERE kind = 'def')))""")
view("v_classes_py", f"""SELECT c.project, c.file_path, c.name, c.start_line, c.end_line,
   len(list_filter(list_transform(string_split(regexp_extract(c.text, 'class\\s+[\\p{{L}}\\p{{N}}_]+\\s*\\((.*)\\)', 1), ','), lambda p: {strip('p')}),
     lambda p: p <> '' AND NOT contains(p, '='))) AS inheritance_depth,
   count(d.name) AS method_count, string_agg(d.name, ',' ORDER BY d.start_line) AS methods, coalesce(max(d.cyclomatic), 0) AS max_method_cyclomatic,
   c.end_line - c.start_line + 1 AS loc
  FROM v_outline c LEFT JOIN v_outline d ON d.file_path = c.file_path AND d.parent_line = c.start_line AND d.kind = 'def'
  WHERE c.kind = 'class' GROUP BY c.project, c.file_path, c.name, c.start_line, c.end_line, c.text""")
_JSF = [r"(?:async\s+)?function\s+(\w+)\s*\(", r"(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{", r"(?:async\s+)?(\w+)\s*:\s*(?:async\s+)?\([^)]*\)\s*=>"]
view("v_functions_js", " UNION ALL ".join(
    f"""SELECT project, file_path, line_number AS start_line, {i} AS pattern_idx, regexp_extract(line, {re2(p)}, 1) AS name, contains(line, 'async') AS is_async
    FROM v_lines WHERE lower(ext) <> '.py' AND regexp_matches(line, {re2(p)})""" for i, p in enumerate(_JSF)))
view("v_classes_js", f"""SELECT project, file_path, line_number AS start_line, regexp_extract(line, {re2(r'class' + chr(92) + 's+(' + chr(92) + 'w+)')}, 1) AS name,
  contains(line, 'extends')::int AS inheritance_depth FROM v_lines WHERE lower(ext) <> '.py' AND regexp_matches(line, {re2(r'class' + chr(92) + 's+(' + chr(92) + 'w+)')})""")


def _metrics(where: str, comment: str, branch: str) -> str:
    return f"""SELECT project, file_path, count(*) AS total_lines, count(*) FILTER ({strip('line')} = '') AS blank_lines,
      count(*) FILTER ({comment}) AS comment_lines, count(*) - count(*) FILTER ({strip('line')} = '') - count(*) FILTER ({comment}) AS lines_of_code,
      1 + count(*) FILTER (regexp_matches(line, {branch})) AS cyclomatic FROM v_lines WHERE {where} GROUP BY 1, 2"""


view("v_metrics_py", _metrics("lower(ext) = '.py'", f"starts_with({strip('line')}, '#')", f"'^\\s*(if|elif|for|while|except){END_WORD}'"))
view("v_metrics_js", _metrics("lower(ext) <> '.py'", r"regexp_matches(line, '^\s*(/|//|\*)')",
                              f"'(^|[^\\p{{L}}\\p{{N}}_])(if|else|case|for|while|catch){END_WORD}'"))
view("v_cognitive", f"""SELECT f.project, f.file_path, coalesce(w.w, 0) AS control_weight, coalesce(b.b, 0) AS boolean_operators, coalesce(w.w, 0) + coalesce(b.b, 0) AS cognitive
  FROM (SELECT project, file_path FROM v_corpus WHERE lower(ext) = '.py') f
  LEFT JOIN (SELECT file_path, sum(CASE WHEN kind IN ('if', 'elif', 'for', 'while') THEN 1 + nest WHEN kind = 'except' THEN 1 ELSE 0 END)::bigint AS w FROM v_outline GROUP BY 1) w USING (file_path)
  LEFT JOIN (SELECT file_path, sum(len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda t: t IN ('and', 'or'))))::bigint AS b FROM v_sig GROUP BY 1) b USING (file_path)""")
_JSH = r"(?:async\s+)?function\s+\w+|(?:async\s+)?\w+\s*\([^)]*\)\s*\{"
view("v_long_js", f"""SELECT project, file_path, hd AS line_number, (min(line_number) - hd + 1) AS lines FROM (
   SELECT *, sum(delta) OVER (PARTITION BY file_path, hd ORDER BY line_number) AS bal FROM (
   SELECT *, max(CASE WHEN head THEN line_number END) OVER (PARTITION BY file_path ORDER BY line_number) AS hd FROM (
   SELECT project, file_path, line_number, regexp_matches(line, {re2(_JSH)}) AS head,
     (length(line) - length(replace(line, '{{', ''))) - (length(line) - length(replace(line, '}}', ''))) AS delta FROM v_lines WHERE lower(ext) <> '.py'))
   WHERE hd IS NOT NULL) WHERE bal = 0 AND NOT head GROUP BY project, file_path, hd HAVING min(line_number) - hd + 1 > 50""")


def _viol(src: str, kind: str, label: str, metrics: dict[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT project, file_path, start_line, name AS owner, {q(r)} AS rule_id, ({x})::int AS value FROM {src}" for r, x in metrics.items())
    return f"""SELECT m.project, m.file_path, m.start_line AS line_number, {q(kind)} AS owner_kind, m.owner, r.name, r.severity,
      '{label} ''' || m.owner || ''': ' || r.description || ' (current: ' || m.value || ', threshold: ' || r.threshold || ')' AS description, r.suggestion
      FROM ({parts}) m JOIN v_rules r USING (rule_id) WHERE r.enabled AND m.value > r.threshold"""


view("v_smells_fn", _viol("v_functions_py", "function", "Function", {"COMPLEX001": "loc", "COMPLEX005": "len(parameters)", "COMPLEX002": "cyclomatic", "COMPLEX003": "nesting"}))
view("v_smells_cl", _viol("v_classes_py", "class", "Class", {"COMPLEX004": "loc", "DESIGN001": "inheritance_depth", "DESIGN002": "method_count"}))
view("v_eval", f"""SELECT project, file_path, line_number, {strip('line')} AS line_content FROM v_lines
  WHERE contains(line, 'eval(') AND NOT starts_with({strip('line')}, '#')""")
view("v_smells", """SELECT * FROM v_smells_fn UNION ALL SELECT * FROM v_smells_cl
  UNION ALL SELECT e.project, e.file_path, e.line_number, 'file', '', r.name, r.severity, r.description, r.suggestion FROM v_eval e, v_rules r WHERE r.rule_id = 'SEC001' AND ends_with(e.file_path, '.py')
  UNION ALL SELECT project, file_path, line_number, 'file', '', 'Long Function', 'medium', 'Function has ' || lines || ' lines', 'Consider breaking this function into smaller functions' FROM v_long_js""")
view("v_report", f"""SELECT m.*, coalesce(f.n, 0) AS functions, coalesce(c.n, 0) AS classes, coalesce(s.n, 0) AS smells, {lang('x.ext', 'analyzer')} AS language FROM (
   SELECT p.*, c.cognitive FROM v_metrics_py p JOIN v_cognitive c USING (file_path) UNION ALL SELECT *, cyclomatic FROM v_metrics_js) m
  JOIN (SELECT file_path, ext FROM v_corpus) x USING (file_path)
  LEFT JOIN (SELECT file_path, count(*) AS n FROM (SELECT file_path FROM v_functions_py UNION ALL SELECT file_path FROM v_functions_js) GROUP BY 1) f USING (file_path)
  LEFT JOIN (SELECT file_path, count(*) AS n FROM (SELECT file_path FROM v_classes_py UNION ALL SELECT file_path FROM v_classes_js) GROUP BY 1) c USING (file_path)
  LEFT JOIN (SELECT file_path, count(*) AS n FROM v_smells GROUP BY 1) s USING (file_path)""")
view("v_symbols", f"""SELECT s.*, {lang('x.ext', 'analyzer')} AS language FROM (
   SELECT project, file_path, name, 'function' AS kind, start_line AS line_start, end_line AS line_end, cyclomatic FROM v_functions_py
   UNION ALL SELECT project, file_path, name, 'class', start_line, end_line, NULL FROM v_classes_py
   UNION ALL SELECT project, file_path, name, 'function', start_line, start_line, 1 FROM v_functions_js
   UNION ALL SELECT project, file_path, name, 'class', start_line, start_line, NULL FROM v_classes_js) s JOIN (SELECT file_path, ext FROM v_corpus) x USING (file_path)""")


def finish() -> None:
    """Prefix every check with the views it names."""
    for k, v in ORACLES.items():
        if not v.startswith("WITH RECURSIVE v_"):
            ORACLES[k] = with_views(v)
