"""Code structure from indentation, braces and import lines.

Every operator here works inside one file's row with higher-order functions, line by
line, and no line ever crosses the network. Before lines are read as code, multi-line
strings are emptied and statements inside open brackets are drawn onto their first
line. The indentation outline is an approximation of a parse tree; an ``elif`` is taken
at the depth of its ``if``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# FIXED VALUES: keywords that count, and the pattern of a header line.
CONTROL = ["if", "elif", "for", "while", "except"]  # raise cyclomatic complexity
COUNTED = ["if", "elif", "for", "while", "with"]
NESTING = ["if", "elif", "else", "for", "while", "with"]
HEADER = r"^\s*(async\s+def|def|class|if|elif|else|for|while|with|except|try|finally)\b"
_HEADER_TYPE = (
    "struct<start_line:int,indent:int,kind:string,name:string,text:string,is_async:boolean,is_static:boolean,"
    "parent_line:int,parent_kind:string,depth:int,nest:int,cyclomatic:int,nesting:int,control_count:int"
)
_OPEN, _DONE = f"array<{_HEADER_TYPE}>>", f"array<{_HEADER_TYPE},end_line:int>>"
_FIELDS = ["start_line", "indent", "kind", "name", "text", "is_async", "is_static", "parent_line", "parent_kind", "depth",
           "nest", "cyclomatic", "nesting", "control_count"]


STRINGS = (r'(?s)"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""|' r"'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'''|"
           r'"(?:\\.|[^"\\\n])*+"|' r"'(?:\\.|[^'\\\n])*+'|#[^\n]*+")
TAKEN = "\u0001"
_FLAT = r"[^\n()\[\]{}]*+"


def _groups(depth: int) -> str:
    """A bracketed group with up to ``depth`` groups inside each other."""
    inner = r"[^()\[\]{}]*+"
    return rf"[(\[{{]{inner}(?:{_groups(depth - 1)}{inner})*+[)\]}}]" if depth else rf"[(\[{{]{inner}[)\]}}]"


BRACKETED = rf"(?m)^{_FLAT}(?:{_groups(4)}{_FLAT})++$"


def _rewrite(text: Column, pattern: str, change) -> Column:
    """``text`` with every match of the pattern changed."""
    def build(c):
        hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(F.split(c, pattern, -1), hits, lambda p, h: F.concat(p, F.coalesce(change(h), F.lit("")))), "")

    return tx.let(text, build)


def logical(content: Column) -> Column:
    """Python text whose lines are statements: the lines keep their numbers, and those taken up by a string or a bracket hold ``TAKEN``, which neither opens nor closes a block."""
    breaks = lambda s: tx.line_count(s) - 1
    fill = lambda s: F.repeat(F.lit(f"\n{TAKEN}"), breaks(s))
    long = lambda s: s.startswith('"""') | s.startswith("'''")
    plain = F.when(content.rlike("\"\"\"|'''"), _rewrite(content, STRINGS, lambda s: F.when(long(s), F.concat(F.lit('""'), fill(s))).otherwise(s))).otherwise(content)
    one_line = lambda s: F.regexp_replace(F.regexp_replace(s, r"#[^\n]*", ""), rf"\s*\n[\s{TAKEN}]*", " ")
    joined = lambda c: F.when(c.rlike(r"[(\[{,][ \t]*(?:#[^\n]*)?\n"), _rewrite(c, BRACKETED, lambda s: F.when(breaks(s) > 0, F.concat(one_line(s), fill(s))).otherwise(s))).otherwise(c)
    return tx.let(plain, joined)


def _significant(content: Column) -> Column:
    """Lines that are neither blank nor comments, with indent and header kind."""
    def shape(x):
        flat = F.replace(x["line"], F.lit("\t"), F.lit(" " * 8))
        body = tx.strip(flat)
        word = F.regexp_extract(flat, tx.regex(HEADER), 1)
        return F.struct(
            x["n"].alias("n"), (F.length(flat) - F.length(F.ltrim(flat))).alias("indent"),
            F.when(word.startswith("async"), "def").otherwise(word).alias("kind"), word.startswith("async").alias("is_async"),
            body.alias("text"))

    lines = F.transform(tx.numbered(content), shape)
    return F.filter(lines, lambda x: (x["text"] != "") & ~x["text"].startswith("#"))


def _end(s, last):
    return F.struct(*[s[f].alias(f) for f in _FIELDS], last.alias("end_line"))


def _bump(s, x, nest):
    """Credit control line ``x`` to the open header ``s``."""
    change = {
        "cyclomatic": s["cyclomatic"] + x["kind"].isin(CONTROL).cast("int"),
        "control_count": s["control_count"] + x["kind"].isin(COUNTED).cast("int"),
        "nesting": F.when(x["kind"].isin(COUNTED), F.greatest(s["nesting"], nest + 1 - s["nest"])).otherwise(s["nesting"]),
    }
    return F.struct(*[change.get(f, s[f]).alias(f) for f in _FIELDS])


def _step(acc, x):
    bracket = F.substring(x["text"], 1, 1).isin(")", "]", "}", TAKEN)
    closes = F.exists(acc["open"], lambda s: s["indent"] >= x["indent"]) & ~bracket
    done = F.when(closes, F.concat(acc["done"], F.transform(
        F.filter(acc["open"], lambda s: s["indent"] >= x["indent"]), lambda s: _end(s, acc["last"])))).otherwise(acc["done"])
    kept = F.when(closes, F.filter(acc["open"], lambda s: s["indent"] < x["indent"])).otherwise(acc["open"])
    top = F.try_element_at(kept, F.lit(-1))
    nest = (F.coalesce(top["nest"], F.lit(0)) + F.coalesce(top["kind"].isin(NESTING).cast("int"), F.lit(0)))
    header = F.struct(
        x["n"].alias("start_line"), x["indent"].alias("indent"), x["kind"].alias("kind"),
        F.when(x["kind"].isin("def", "class"), F.regexp_extract(x["text"], tx.regex(r"(?:def|class)\s+(\w+)"), 1)).otherwise("").alias("name"),
        x["text"].alias("text"), x["is_async"].alias("is_async"), acc["static"].alias("is_static"),
        top["start_line"].alias("parent_line"), top["kind"].alias("parent_kind"), F.size(kept).alias("depth"),
        nest.alias("nest"), F.lit(1).alias("cyclomatic"), F.lit(0).alias("nesting"), F.lit(0).alias("control_count"))
    is_header = (x["kind"] != "") & ~bracket
    grown = F.concat(F.transform(kept, lambda s: _bump(s, x, nest)), F.array(header))
    deco = x["text"].startswith("@")
    return F.struct(
        F.when(is_header, grown).otherwise(kept).cast(_OPEN).alias("open"), done.cast(_DONE).alias("done"),
        x["n"].alias("last"), ((x["text"] == "@staticmethod") | (deco & acc["static"])).alias("static"))


def outline_column(content: Column) -> Column:
    """array of header structs with spans, by one fold over the file's lines."""
    start = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(_DONE).alias("done"), F.lit(0).alias("last"),
                     F.lit(False).alias("static"))
    return F.aggregate(_significant(content), start, _step,
                       lambda a: F.concat(a["done"], F.transform(a["open"], lambda s: _end(s, a["last"]))))


def _keep(files: DataFrame) -> list[str]:
    return [c for c in files.columns if c not in ("content", "ext")]


def python_files(files: DataFrame) -> DataFrame:
    return files.where(F.lower(tx.extension("file_path")) == ".py")


def python_code(files: DataFrame) -> DataFrame:
    """Python files with their text as statements."""
    return python_files(files).withColumn("content", logical(F.col("content")))


def other_files(files: DataFrame) -> DataFrame:
    return files.where(F.lower(tx.extension("file_path")) != ".py")


def block_outline(files: DataFrame) -> DataFrame:
    """Every def/class/control header of Python files with span, parent and depth."""
    keep = _keep(files)
    return python_code(files).select(*keep, F.explode(outline_column(F.col("content"))).alias("b")).select(*keep, "b.*")


def parameters(text: Column) -> Column:
    """Plain parameter names of a def line; names before '/' and after '*' do not count."""
    inner = F.regexp_extract(text, r"\((.*)\)", 1)
    inner = F.regexp_replace(F.regexp_replace(inner, r"\"[^\"]*\"|'[^']*'", ""), r"\[[^\]]*\]|\([^)]*\)", "")
    names = F.transform(F.split(inner, ","), lambda p: tx.strip(F.regexp_extract(p, r"^([^:=]*)", 1)))

    def before_star(n):
        at = F.array_position(F.transform(n, lambda p: p.startswith("*")), True).cast("int")
        return F.when(at > 0, F.slice(n, 1, at - 1)).otherwise(n)

    def after_slash(n):
        at = F.array_position(n, "/").cast("int")
        return F.when(at > 0, F.slice(n, at + 1, F.size(n))).otherwise(n)

    return tx.let(tx.let(F.filter(names, lambda p: p != ""), before_star), after_slash)


def bases(text: Column) -> Column:
    """Base classes of a class line, keyword arguments left out."""
    inner = F.regexp_extract(text, tx.regex(r"class\s+\w+\s*\((.*)\)"), 1)
    return F.filter(F.transform(F.split(inner, ","), lambda p: tx.strip(p)), lambda p: (p != "") & ~F.contains(p, F.lit("=")))


def direct_methods(outline: Column, cls: Column) -> Column:
    return F.filter(outline, lambda d: (d["kind"] == "def") & (d["parent_line"] == cls["start_line"]))


def functions_py(files: DataFrame) -> DataFrame:
    out = block_outline(files).where(F.col("kind") == "def")
    found = F.regexp_extract("text", tx.regex(r"\)\s*->\s*[\"']?(\w+)[\"']?\s*:"), 1)
    return out.select(
        *_keep(files), "name", "start_line", "end_line", "indent", "parent_line", "parent_kind", "is_async", "is_static",
        parameters(F.col("text")).alias("parameters"), F.when(found != "", found).alias("return_type"),
        "cyclomatic", "nesting", "control_count", (F.col("end_line") - F.col("start_line") + 1).alias("loc"))


def classes_py(files: DataFrame) -> DataFrame:
    keep = _keep(files)
    file = python_code(files).select(*keep, outline_column(F.col("content")).alias("_o"))
    rows = F.transform(F.filter("_o", lambda c: c["kind"] == "class"), lambda c: F.struct(
        c.alias("c"), F.array_sort(direct_methods(F.col("_o"), c), lambda a, b: a["start_line"] - b["start_line"]).alias("m")))
    flat = file.select(*keep, F.explode(rows).alias("r")).select(*keep, F.col("r.c").alias("c"), "r.m")
    return flat.select(
        *keep, F.col("c.name").alias("name"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"),
        F.size(bases(F.col("c.text"))).alias("inheritance_depth"), F.size("m").alias("method_count"),
        F.transform("m", lambda d: d["name"]).alias("methods"),
        F.coalesce(F.array_max(F.transform("m", lambda d: d["cyclomatic"])), F.lit(0)).alias("max_method_cyclomatic"),
        (F.col("c.end_line") - F.col("c.start_line") + 1).alias("loc"))


# FIXED VALUES: patterns of brace languages, line by line.
JS_FUNCTIONS = [r"(?:async\s+)?function\s+(\w+)\s*\(", r"(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{",
                r"(?:async\s+)?(\w+)\s*:\s*(?:async\s+)?\([^)]*\)\s*=>"]
JS_CLASS = r"class\s+(\w+)"
JS_IMPORTS = [r"import\s+(?:\{[^}]+\}|[\w*]+)\s+from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"]
JS_HEADER = r"(?:async\s+)?function\s+\w+|(?:async\s+)?\w+\s*\([^)]*\)\s*\{"
JS_COMMENT = r"^\s*(/|//|\*)"
JS_BRANCH = r"\b(if|else|case|for|while|catch)\b"


def functions_js(files: DataFrame) -> DataFrame:
    keep = _keep(files)
    rows = [F.transform(F.filter(F.col("_l"), lambda x: tx.line_test(p)(x["line"])), lambda x: F.struct(
        x["n"].alias("start_line"), F.lit(i).alias("pattern_idx"), F.regexp_extract(x["line"], tx.regex(p), 1).alias("name"),
        F.contains(x["line"], F.lit("async")).alias("is_async"))) for i, p in enumerate(JS_FUNCTIONS)]
    base = other_files(files).select(*keep, tx.numbered("content").alias("_l"))
    return base.select(*keep, F.explode(F.concat(*rows)).alias("r")).select(*keep, "r.*")


def classes_js(files: DataFrame) -> DataFrame:
    keep = _keep(files)
    hits = F.filter(tx.numbered("content"), lambda x: F.contains(x["line"], F.lit("class")) & x["line"].rlike(tx.regex(JS_CLASS)))
    rows = F.transform(hits, lambda x: F.struct(
        x["n"].alias("start_line"), F.regexp_extract(x["line"], tx.regex(JS_CLASS), 1).alias("name"),
        F.contains(x["line"], F.lit("extends")).cast("int").alias("inheritance_depth")))
    return other_files(files).select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def js_imports(content) -> Column:
    return F.concat(*[F.regexp_extract_all(content, F.lit(tx.regex(p)), F.lit(1)) for p in JS_IMPORTS])


def imports_js(files: DataFrame) -> DataFrame:
    return other_files(files).select(*_keep(files), F.explode(js_imports("content")).alias("module"))


def py_imports(source) -> Column:
    """array of (line_number, module): ``import a`` gives a, ``from m import n`` gives m.n."""
    body = lambda x: tx.strip(x["line"])
    plain, frm = tx.regex(r"^import\s+(.+)$"), tx.regex(r"^from\s+(\S+)\s+import\s+(.+)$")
    clean = lambda s: tx.strip(F.regexp_extract(F.regexp_replace(s, r"[()]", ""), tx.regex(r"^\s*(\S+)(?:\s+as\s+\S+)?\s*$"), 1))
    code = lambda s: tx.strip(F.regexp_replace(s, r"#.*$", ""))

    def names(x):
        pre = F.regexp_replace(F.regexp_extract(body(x), frm, 1), r"^\.+", "")
        a = F.transform(F.split(code(F.regexp_extract(body(x), plain, 1)), ","), lambda s: clean(s))
        b = F.transform(F.split(code(F.regexp_extract(body(x), frm, 2)), ","), lambda s: F.when(clean(s) == "", "").when(
            pre == "", clean(s)).otherwise(F.concat(pre, F.lit("."), clean(s))))
        found = F.when(body(x).startswith("import"), a).otherwise(b)
        return F.transform(F.filter(found, lambda s: s != ""), lambda s: F.struct(x["n"].alias("line_number"), s.alias("module")))

    lines = F.filter(tx.numbered(source), lambda x: F.contains(x["line"], F.lit("import")) & (
        body(x).rlike(plain) | body(x).rlike(frm)))
    return F.flatten(F.transform(lines, names))


def imports_py(files: DataFrame) -> DataFrame:
    """One row per imported name."""
    keep = _keep(files)
    return python_code(files).select(*keep, F.explode(py_imports("content")).alias("r")).select(*keep, "r.*")


# FIXED VALUES: lines that branch.
PY_BRANCH = r"^\s*(if|elif|for|while|except)\b"


def _line_metrics(lines: Column, is_comment, branch: str, code: Column | None = None) -> list[Column]:
    """``code``: the lines whose branches count, if not all."""
    count = lambda test: F.size(F.filter(lines, test))
    total, blank, comment = F.size(lines), count(lambda x: tx.strip(x) == ""), count(is_comment)
    return [total.alias("total_lines"), blank.alias("blank_lines"), comment.alias("comment_lines"),
            (total - blank - comment).alias("lines_of_code"),
            (F.size(F.filter(lines if code is None else code, lambda x: x.rlike(tx.regex(branch)))) + 1).alias("cyclomatic")]


def file_metrics_py(files: DataFrame) -> DataFrame:
    keep = _keep(files)
    base = python_files(files).select(*keep, F.split("content", "\n", -1).alias("_l"), F.split(logical(F.col("content")), "\n", -1).alias("_c"))
    return base.select(*keep, *_line_metrics(F.col("_l"), lambda x: tx.strip(x).startswith("#"), PY_BRANCH, F.col("_c")))


def file_metrics_js(files: DataFrame) -> DataFrame:
    keep = _keep(files)
    base = other_files(files).select(*keep, F.split("content", "\n", -1).alias("_l"))
    return base.select(*keep, *_line_metrics(F.col("_l"), lambda x: x.rlike(tx.regex(JS_COMMENT)), JS_BRANCH))


def _control_weight(outline: Column) -> Column:
    return F.aggregate(outline, F.lit(0), lambda s, h: s + F.when(
        h["kind"].isin("if", "elif", "for", "while"), 1 + h["nest"]).when(h["kind"] == "except", 1).otherwise(0))


def _boolean_operators(code: str = "content") -> Column:
    """and/or on lines that are not comments."""
    return F.aggregate(_significant(F.col(code)), F.lit(0), lambda s, x: s + F.size(
        F.filter(F.regexp_extract_all(x["text"], F.lit(tx.WORD), F.lit(0)), lambda w: w.isin("and", "or"))))


def cognitive_py(files: DataFrame) -> DataFrame:
    """Approximation: (1 + open nesting) per if/elif/for/while, 1 per except, 1 per and/or on code lines."""
    keep = _keep(files)
    py = python_code(files).select(*keep, _control_weight(outline_column(F.col("content"))).alias("control_weight"),
                                    _boolean_operators().alias("boolean_operators"))
    return py.withColumn("cognitive", F.col("control_weight") + F.col("boolean_operators"))


def long_functions(lines: Column, limit: int = 50) -> Column:
    """array of (line_number, lines): functions longer than ``limit`` lines by brace balance; a new header restarts the count."""
    count = lambda s, ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    item = "array<struct<line_number:int,lines:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("bal"), F.array().cast(item).alias("out"))

    def step(a, x):
        head = (F.contains(x["line"], F.lit("function")) | F.contains(x["line"], F.lit("("))) & x["line"].rlike(tx.regex(JS_HEADER))
        delta = count(x["line"], "{") - count(x["line"], "}")
        bal = F.when(head, delta).otherwise(a["bal"] + delta)
        ends = ~head & (a["at"] > 0) & (bal == 0)
        span = x["n"] - a["at"] + 1
        out = F.when(ends & (span > limit), F.concat(a["out"], F.array(F.struct(a["at"].alias("line_number"), span.alias("lines")))))
        return F.struct(F.when(head, x["n"]).when(ends, 0).otherwise(a["at"]).alias("at"), bal.alias("bal"),
                        out.otherwise(a["out"]).cast(item).alias("out"))

    return F.aggregate(lines, start, step, lambda a: a["out"])


def long_function_js(files: DataFrame, limit: int = 50) -> DataFrame:
    """Functions longer than ``limit`` lines."""
    keep = _keep(files)
    return other_files(files).select(*keep, F.explode(long_functions(tx.numbered("content"), limit)).alias("r")).select(*keep, "r.*")


def file_facts(files: DataFrame) -> DataFrame:
    """Metrics and counts of functions and classes of every file, all in the file's own row."""
    keep = _keep(files)
    o, l = F.col("_o"), F.col("_l")
    kind = lambda k: F.size(F.filter(o, lambda h: h["kind"] == k))
    py = python_files(files).select(*keep, F.split("content", "\n", -1).alias("_l"), logical(F.col("content")).alias("content"))
    py = py.select(*keep, "content", outline_column(F.col("content")).alias("_o"), "_l")
    py = py.select(*keep, *_line_metrics(l, lambda x: tx.strip(x).startswith("#"), PY_BRANCH, F.split("content", "\n", -1)),
                   (_control_weight(o) + _boolean_operators()).alias("cognitive"), kind("def").alias("functions"), kind("class").alias("classes"))
    hits = lambda p: F.size(F.filter(l, tx.line_test(p)))
    js = other_files(files).select(*keep, F.split("content", "\n", -1).alias("_l"))
    js = js.select(*keep, *_line_metrics(l, lambda x: x.rlike(tx.regex(JS_COMMENT)), JS_BRANCH),
                   sum((hits(p) for p in JS_FUNCTIONS[1:]), hits(JS_FUNCTIONS[0])).alias("functions"), hits(JS_CLASS).alias("classes"))
    return py.unionByName(js.withColumn("cognitive", F.col("cyclomatic")))
