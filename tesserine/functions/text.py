"""Text helpers that keep the usual Python text semantics inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode \w \d \s \b, and '.'/'$' that stop at \n only.
FLAGS = "(?Ud)"

# Code points removed by str.strip().
WS_CODES = [32, *range(9, 14), *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
WS = "".join(map(chr, WS_CODES))
WORD = r"[\p{L}\p{N}_]+"


def regex(pattern: str) -> str:
    return FLAGS + pattern


def strip(c) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WS))


def sql_text(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def line_test(pattern: str):
    """Predicate on a line: the byte search first, then the regex."""
    lit, rx = needle(pattern), regex(pattern)
    return lambda x: (F.contains(x, F.lit(lit)) & x.rlike(rx)) if lit else x.rlike(rx)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when used inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_each(df, rows: Column, name: str, *keep):
    """A row for each element. Of a plain ``explode`` Spark infers a filter on the array's size and puts it below, so that a costly array is computed again there."""
    return df.select(*keep, F.explode_outer(rows).alias(name)).where(F.col(name).isNotNull())


def extension(path) -> Column:
    """Suffix with its dot, case kept; '' when there is none."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1)


def base_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def module_name(path) -> Column:
    """src/a/b.py -> src.a.b"""
    no_dot = F.regexp_replace(path, r"^(\./)+", "")
    base = F.regexp_replace(no_dot, r"([^/.][^/]*)\.[^./]*$", "$1")
    return F.translate(base, "/", ".")


def numbered(content) -> Column:
    """array<struct<n:int,line:string>>, 1-based, trailing empties kept."""
    c = F.col(content) if isinstance(content, str) else content
    return F.transform(F.split(c, "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))


def line_count(content) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def glob_regex(mask: str) -> str:
    """Glob mask to an anchored regex ('*' and '?' stay inside one path segment, '**' crosses)."""
    out, i = "", 0
    while i < len(mask):
        ch = mask[i]
        if mask.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if mask.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += "[^/]*" if ch == "*" else "[^/]" if ch == "?" else re.escape(ch)
        i += 1
    return f"^{out}$"


def round_even(c, digits: int) -> Column:
    return F.bround(c, digits)


def needle(pattern: str) -> str:
    """Longest literal every match must contain, '' when none is certain.

    A byte search for it spares most lines the regex engine.
    """
    if pattern.startswith("(?i"):
        return ""
    runs, cur, i, n = [], "", 0, len(pattern)
    while i < n:
        ch = pattern[i]
        lit = None
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            lit = nxt if not nxt.isalnum() else None
            i += 2
        elif ch == "|":
            return ""
        elif ch == "[":
            i = pattern.index("]", i + 2) + 1
        elif ch == "(":
            depth = 0
            while True:
                if pattern[i] == "\\":
                    i += 2
                    continue
                depth += {"(": 1, ")": -1}.get(pattern[i], 0)
                i += 1
                if depth == 0:
                    break
        else:
            lit = ch if ch not in ".^$*+?{}" else None
            i += 1
        quant = pattern[i] if i < n else ""
        if lit is None or quant in ("*", "?", "{"):
            runs.append(cur)
            cur = ""
        else:
            cur += lit
            if quant == "+":
                runs.append(cur)
                cur = ""
        if quant in ("*", "?", "+"):
            i += 1
        elif quant == "{":
            i = pattern.index("}", i) + 1
    runs.append(cur)
    return max(runs, key=len)


