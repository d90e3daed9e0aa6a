"""One analysis of a file: what its lines are folded into, as columns of the file's own row. Nothing is shuffled and the content is read once.

The columns are large expressions over fixed column names; they are made once and kept.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import STRUCTURE
from . import files as fl
from . import reports, structure

SYMBOL = "array<struct<name:string,kind:string,line_start:int,line_end:int,cyclomatic:int>>"


def is_python() -> Column:
    return F.lower(tx.extension("file_path")) == ".py"


@cache
def _outline() -> tuple[Column, dict[str, Column]]:
    code = F.when(F.col("py"), structure.logical(F.col("content")))
    return code, {"outline": F.when(F.col("py"), structure.outline_column(F.col("code"))), "lines": tx.numbered("content")}


def outlined(files: DataFrame) -> DataFrame:
    """(project, file_path, language, content, py, code, outline, lines); code and outline of Python files only."""
    keep = files.select("project", "file_path", fl.language("file_path").alias("language"), "content", is_python().alias("py"))
    code, folded = _outline()
    return keep.withColumn("code", code).withColumns(folded)


def symbols(file: DataFrame) -> DataFrame:
    """Adds ``symbols``: functions and classes in order of their first line, those of one line classes first."""
    return file.withColumn("symbols", _symbols())


@cache
def _symbols() -> Column:
    def one(name, kind, start, end, cyclomatic):
        return F.struct(name.alias("name"), F.lit(kind).alias("kind"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), cyclomatic.cast("int").alias("cyclomatic"))

    none = F.lit(None).cast("int")
    inside = F.transform(F.filter("outline", lambda h: h["kind"].isin("def", "class")), lambda h: F.when(h["kind"] == "def", one(h["name"], "function", h["start_line"], h["end_line"], h["cyclomatic"]))
                         .otherwise(one(h["name"], "class", h["start_line"], h["end_line"], none)))
    hit = lambda p, kind, cc: F.transform(F.filter("lines", lambda x: tx.line_test(p)(x["line"])), lambda x: one(F.regexp_extract(x["line"], tx.regex(p), 1), kind, x["n"], x["n"], cc))
    by_line = F.concat(*[hit(p, "function", F.lit(1)) for p in structure.JS_FUNCTIONS], hit(structure.JS_CLASS, "class", none))
    found = F.when(F.col("py"), inside.cast(SYMBOL)).otherwise(by_line.cast(SYMBOL))
    order = lambda a, b: F.when(a["line_start"] != b["line_start"], a["line_start"] - b["line_start"]).when(a["kind"] != b["kind"], F.when(a["kind"] < b["kind"], -1).otherwise(1)).otherwise(0)
    return F.when(F.col("language").isNotNull(), F.array_sort(found, order)).otherwise(F.array().cast(SYMBOL))


def _functions() -> Column:
    def one(h):
        found = F.regexp_extract(h["text"], tx.regex(r"\)\s*->\s*[\"']?(\w+)[\"']?\s*:"), 1)
        kept = [h[c].alias(c) for c in ("start_line", "name", "end_line", "cyclomatic", "nesting")]
        return F.struct(*kept, (h["end_line"] - h["start_line"] + 1).alias("loc"), structure.parameters(h["text"]).alias("parameters"), F.when(found != "", found).alias("return_type"),
                        h["is_async"].alias("is_async"), h["is_static"].alias("is_static"), h["parent_line"].alias("parent_line"), h["parent_kind"].alias("parent_kind"))

    return F.transform(F.filter("outline", lambda h: h["kind"] == "def"), one)


def _classes() -> Column:
    def one(c):
        methods = F.filter("functions", lambda f: f["parent_line"] == c["start_line"])
        return tx.let(methods, lambda m: F.struct(
            c["start_line"].alias("start_line"), c["name"].alias("name"), c["end_line"].alias("end_line"), F.size(structure.bases(c["text"])).alias("inheritance_depth"), F.array_sort(m).alias("methods"),
            F.coalesce(F.array_max(F.transform(m, lambda f: f["cyclomatic"])), F.lit(0)).alias("max_method_cyclomatic"), (c["end_line"] - c["start_line"] + 1).alias("loc")))

    return F.transform(F.filter("outline", lambda h: h["kind"] == "class"), one)


#: The measure of a function or class that a threshold rule looks at.
MEASURES = {
    "function": {"COMPLEX001": lambda f: f["loc"], "COMPLEX005": lambda f: F.size(f["parameters"]), "COMPLEX002": lambda f: f["cyclomatic"], "COMPLEX003": lambda f: f["nesting"]},
    "class": {"COMPLEX004": lambda c: c["loc"], "DESIGN001": lambda c: c["inheritance_depth"], "DESIGN002": lambda c: F.size(c["methods"])},
}


def _smell(line, kind: str, owner, name: str, severity: str, description, suggestion: str) -> Column:
    return F.struct(line.cast("int").alias("line_number"), F.lit(kind).alias("owner_kind"), owner.alias("owner"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), description.alias("description"), F.lit(suggestion).alias("suggestion"))


def _violations(owners: str, kind: str, rules: list) -> Column:
    """Smells of the functions or classes beyond a threshold."""
    known = {r.rule_id: r for r in rules if r.enabled and r.threshold is not None}

    def one(h):
        found = []
        for rule, measure in MEASURES[kind].items():
            if r := known.get(rule):
                text = F.format_string("%s '%s': %s (current: %d, threshold: %d)", F.lit(kind.capitalize()), h["name"], F.lit(r.description), measure(h), F.lit(r.threshold))
                found.append(F.when(measure(h) > r.threshold, _smell(h["start_line"], kind, h["name"], r.name, r.severity, text, r.suggestion)))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return F.flatten(F.transform(owners, one))


def _text_smells(rules: list) -> Column:
    """``eval(`` outside comments of Python, and long functions of the other languages."""
    none = F.lit("")
    found = [F.when(~F.col("py"), F.transform(structure.long_functions(F.col("lines")), lambda x: _smell(
        x["line_number"], "file", none, "Long Function", "medium", F.format_string("Function has %d lines", x["lines"]), "Consider breaking this function into smaller functions")))]
    for r in rules:
        if r.rule_id == "SEC001" and r.enabled:
            evals = F.filter("lines", lambda x: F.contains(x["line"], F.lit("eval(")) & ~tx.strip(x["line"]).startswith("#"))
            found.append(F.when(F.col("py") & F.contains("content", F.lit("eval(")), F.transform(evals, lambda x: _smell(x["n"], "file", none, r.name, r.severity, F.lit(r.description), r.suggestion))))
    return F.flatten(F.filter(F.array(*found), lambda a: a.isNotNull()))


def analysed(files: DataFrame, rules: list = STRUCTURE) -> DataFrame:
    """One row per file of a known language: metrics, ``functions``, ``classes`` with their ``methods``, ``imports``, ``smells`` and ``symbols``.

    Each part is a column of arrays; what a query does not ask for is not computed.
    """
    file = symbols(outlined(files.where(fl.language("file_path").isNotNull())))
    for step in _steps() if rules is STRUCTURE else _made_steps(rules):
        file = file.withColumns(step)
    return file.drop("content", "code", "outline", "raw", "statements", "lines")


@cache
def _steps() -> list[dict[str, Column]]:
    return _made_steps(STRUCTURE)


def _made_steps(rules: list) -> list[dict[str, Column]]:
    """Columns of the analysis; each step uses those before it."""
    py = F.col("py")
    py_parts = structure._line_metrics(F.col("raw"), lambda x: tx.strip(x).startswith("#"), structure.PY_BRANCH, F.col("statements"))
    js_parts = structure._line_metrics(F.col("raw"), lambda x: x.rlike(tx.regex(structure.JS_COMMENT)), structure.JS_BRANCH)
    names = ("total_lines", "blank_lines", "comment_lines", "lines_of_code", "cyclomatic")
    owned = F.when(py, F.concat(_violations("functions", "function", rules), _violations("classes", "class", rules)))
    return [
        {"raw": F.transform("lines", lambda x: x["line"]), "statements": F.split("code", "\n", -1)},
        {n: F.when(py, a).otherwise(b) for n, a, b in zip(names, py_parts, js_parts, strict=True)},
        {"functions": F.when(py, _functions()), "cognitive": F.when(py, structure._control_weight(F.col("outline")) + structure._boolean_operators("code")).otherwise(F.col("cyclomatic")),
         "imports": F.when(py, F.transform(structure.py_imports("code"), lambda x: x["module"])).otherwise(structure.js_imports("content"))},
        {"classes": F.when(py, _classes())},
        {"smells": F.flatten(F.filter(F.array(owned, _text_smells(rules)), lambda a: a.isNotNull()))}]


LEVELS = ("critical", "high", "medium", "low")


def report(files: DataFrame) -> DataFrame:
    """The analysis with counts in place of lists."""
    return files.select(*_report())


@cache
def _report() -> list:
    of = lambda kind: F.size(F.filter("symbols", lambda s: s["kind"] == kind))
    count = lambda test: F.size(F.filter("smells", test)).cast("long")
    severe = lambda level: lambda s: s["severity"] == level
    return [
        "project", "file_path", "language", "total_lines", "blank_lines", "comment_lines", "lines_of_code", "cyclomatic", "cognitive", of("function").alias("functions"), of("class").alias("classes"),
        F.size("smells").cast("long").alias("smells"), *[count(severe(v)).alias(f"{v}_smells") for v in LEVELS], count(lambda s: s["name"] == "Deep Nesting").alias("deep_nesting_count")]


def smell_rows(files: DataFrame) -> DataFrame:
    return tx.one_each(files, F.col("smells"), "s", "project", "file_path").select("project", "file_path", "s.*")


def symbol_rows(files: DataFrame) -> DataFrame:
    """Symbols with their quality: 100 less what their complexity and their own smells cost."""
    out = tx.one_each(files, _costs(), "r", "project", "file_path", "language").select("project", "file_path", "language", "r.s.*", "r.off")
    cc = F.col("cyclomatic")
    loss = F.when(cc > 10, F.least(F.lit(20), (cc - 10) * 2)).when(cc > 5, (cc - 5) * 2).otherwise(0)
    return out.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - loss - F.col("off")))).drop("off")


@cache
def _costs() -> Column:
    off = lambda s: F.when(s == "critical", 20).when(s == "high", 15).when(s == "medium", 10).when(s == "low", 5).otherwise(0)
    return tx.let(F.col("smells"), lambda all_: F.transform("symbols", lambda s: F.struct(s.alias("s"), F.aggregate(
        F.filter(all_, lambda x: (x["owner_kind"] == s["kind"]) & (x["line_number"] == s["line_start"])), F.lit(0), lambda a, x: a + off(x["severity"])).alias("off"))))


def hotspots(files: DataFrame, n: int, n_nested: int) -> DataFrame:
    """Per project: the n most complex functions, the n longest classes, the first n_nested places of deep nesting; one scan and one exchange."""
    item = lambda kind, line, name, value: F.struct(F.lit(kind).alias("kind"), line.alias("line_number"), name.alias("name"), value.cast("int").alias("value"))
    of = lambda c: F.coalesce(c, F.array())
    rows = F.concat(of(F.transform("functions", lambda f: item("function", f["start_line"], f["name"], f["cyclomatic"]))), of(F.transform("classes", lambda c: item("class", c["start_line"], c["name"], c["loc"]))),
                    F.transform(F.filter("smells", lambda s: F.contains(s["name"], F.lit("Deep Nesting"))), lambda s: item("deep_nesting", s["line_number"], s["owner"], F.lit(None))))
    flat = tx.one_each(files, rows, "r", "project", "file_path").select("project", "file_path", "r.*")
    place = F.row_number().over(W.partitionBy("project", "kind").orderBy(F.col("value").desc(), "file_path", "line_number"))
    top = flat.withColumn("place", place).where(F.col("place") <= max(n, n_nested))
    return top.where(F.col("place") <= F.when(F.col("kind") == "deep_nesting", n_nested).otherwise(n)).select("project", "kind", "file_path", "line_number", "name", "value")


def quality_metrics(files: DataFrame) -> DataFrame:
    """Per project: mean function complexity, smells and lines summed, defaults elsewhere."""
    counted = files.select("project", F.size("smells").cast("long").alias("smells"), "lines_of_code", F.coalesce(F.filter(F.transform("functions", lambda f: f["cyclomatic"]), lambda x: x > 0), F.array().cast("array<int>")).alias("cc"))
    counted = counted.select("project", "smells", "lines_of_code", F.size("cc").cast("long").alias("n"), F.aggregate("cc", F.lit(0).cast("long"), lambda a, x: a + x).alias("cc"))
    zero = lambda name: F.lit(0.0).alias(name)
    sums = counted.groupBy("project").agg(F.sum("smells").alias("code_smells"), F.sum("lines_of_code").alias("lines_of_code"), F.sum("n").alias("n"), F.sum("cc").alias("cc"))
    return sums.select("project", F.coalesce(F.try_divide("cc", "n"), F.lit(0.0)).alias("cyclomatic_complexity"), zero("cognitive_complexity"), "code_smells", zero("duplication_ratio"), zero("test_coverage"),
                       zero("documentation_ratio"), "lines_of_code", F.lit(75.0).alias("maintainability_index"), zero("technical_debt"))


def heatmap_rows(files: DataFrame) -> DataFrame:
    """Per file: metrics, ratio of comments to code, and its functions as an array."""
    fn = F.transform(F.array_sort("functions"), lambda f: F.struct(*[f[c].alias(c) for c in ("start_line", "name", "end_line", "cyclomatic", "nesting", "loc")], F.size(f["parameters"]).alias("params")))
    r = report(files.withColumns({"rows": F.coalesce(fn, F.array()), "nesting_depth": F.coalesce(F.array_max(F.transform("functions", lambda f: f["nesting"])), F.lit(0))}).withColumns({"language": F.struct("language", "rows", "nesting_depth")}))
    return r.select(
        "project", F.element_at(F.split("file_path", "/"), -1).alias("file"), "file_path", "total_lines", "cyclomatic", "cognitive", "language.nesting_depth", F.col("lines_of_code").alias("loc"),
        F.round(F.col("comment_lines") / F.greatest(F.col("lines_of_code"), F.lit(1)), 6).alias("comment_ratio"),
        F.col("functions").alias("function_count"), F.col("classes").alias("class_count"), F.col("smells").alias("smell_count"), F.col("language.rows").alias("function_rows"))


def class_severities(files: DataFrame) -> DataFrame:
    """(project, file_path, name, start_line, severity) of each class, from its methods and its own smells."""
    own = lambda all_, c: F.size(F.filter(all_, lambda x: (x["owner_kind"] == "class") & (x["line_number"] == c["start_line"])))
    rows = tx.let(F.col("smells"), lambda all_: F.transform("classes", lambda c: F.struct(
        c["name"].alias("name"), c["start_line"].alias("start_line"), reports.severity_class(c["max_method_cyclomatic"], own(all_, c)).alias("severity"))))
    return tx.one_each(files, rows, "r", "project", "file_path").select("project", "file_path", "r.*")


_NODE = "start_line:int,name:string,end_line:int,cyclomatic:int,nesting:int,loc:int,parameters:array<string>,return_type:string,is_async:boolean,is_static:boolean,severity:string"
TREE = (f"name string, type string, severity string, total_lines int, metrics struct<cyclomatic:int,cognitive:int,loc:int,comments:int,blank:int>, imports array<string>, "
        f"classes array<struct<start_line:int,name:string,end_line:int,inheritance_depth:int,methods:array<struct<{_NODE}>>>>, "
        f"functions array<struct<{_NODE}>>, smells array<struct<line_number:int,name:string,severity:string,description:string,suggestion:string>>")


def report_tree(files: DataFrame) -> DataFrame:
    """file -> imports, classes with methods, plain functions, smells, as one JSON per file; a projection of the analysis."""
    return files.select("project", "file_path", _tree().alias("tree"))


@cache
def _tree() -> Column:
    kept = ("start_line", "name", "end_line", "cyclomatic", "nesting", "loc", "parameters", "return_type", "is_async", "is_static")
    node = lambda f: F.struct(*[f[c].alias(c) for c in kept], reports.severity_function(f["cyclomatic"]).alias("severity"))
    plain = F.transform(F.array_sort(F.filter("functions", lambda f: F.coalesce(f["parent_kind"], F.lit("")) != "class")), node)
    classes = F.transform(F.array_sort("classes"), lambda c: F.struct(*[c[k].alias(k) for k in ("start_line", "name", "end_line", "inheritance_depth")], F.transform(c["methods"], node).alias("methods")))
    listed = F.array_sort(F.transform("smells", lambda s: F.struct(*[s[c].alias(c) for c in ("line_number", "name", "severity", "description", "suggestion")])))
    tree = F.struct(
        F.element_at(F.split("file_path", "/"), -1).alias("name"), F.lit("file").alias("type"), reports.severity_file(F.col("cyclomatic"), F.size("smells")).alias("severity"), "total_lines",
        F.struct("cyclomatic", "cognitive", F.col("lines_of_code").alias("loc"), F.col("comment_lines").alias("comments"), F.col("blank_lines").alias("blank")).alias("metrics"),
        F.array_sort("imports").alias("imports"), F.coalesce(classes, F.array()).alias("classes"), F.coalesce(plain, F.array()).alias("functions"), listed.alias("smells"))
    return F.to_json(tree)


def flat_tree(trees: DataFrame) -> DataFrame:
    """(project, file_path, part, line, item): the nodes of the JSON trees, read back."""
    t = trees.select("project", "file_path", F.from_json("tree", TREE).alias("t"))
    return tx.one_each(t, _nodes(), "r", "project", "file_path").select("project", "file_path", "r.*")


@cache
def _nodes() -> Column:
    def text(*parts):
        return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))

    def fn(part):
        return lambda f: F.struct(F.lit(part).alias("part"), f["start_line"].alias("line"), text(f["name"], f["end_line"], f["cyclomatic"], f["nesting"], f["loc"], F.array_join(f["parameters"], ","), f["return_type"], f["is_async"], f["is_static"], f["severity"]).alias("item"))

    none = F.lit(None).cast("int").alias("line")
    m = "t.metrics."
    return F.flatten(F.array(
        F.array(F.struct(F.lit("file").alias("part"), none, text(*(F.col(c) for c in ("t.name", "t.severity", "t.total_lines", m + "cyclomatic", m + "cognitive", m + "loc", m + "comments", m + "blank"))).alias("item"))),
        F.transform("t.imports", lambda i: F.struct(F.lit("import").alias("part"), none, i.alias("item"))),
        F.transform("t.classes", lambda c: F.struct(F.lit("class").alias("part"), c["start_line"].alias("line"), text(c["name"], c["end_line"], c["inheritance_depth"], F.size(c["methods"])).alias("item"))),
        F.flatten(F.transform("t.classes", lambda c: F.transform(c["methods"], fn("method")))), F.transform("t.functions", fn("function")),
        F.transform("t.smells", lambda s: F.struct(F.lit("smell").alias("part"), s["line_number"].alias("line"), text(s["name"], s["severity"], s["description"], s["suggestion"]).alias("item")))))
