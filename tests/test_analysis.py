"""The analysis of a file gives what the separate operators give, from one scan and without joins."""

import json

import pytest

from tesserine.operators import analysis, ruleset, scores, smells, structure, symbols

DEEP = "def deep(a, b, c, d, e, f):\n" + "".join("    " * k + f"if a > {k}:\n" for k in range(1, 8)) + "    " * 8 + "return eval('1')\n"
SOURCES = {
    "src/a.py": "import os, sys\nfrom x.y import z\n\nclass A(B, C):\n    def m(self, p=1):\n        if p and self:\n            return 1\n\n    @staticmethod\n    async def n() -> int:\n        return 2\n\n" + DEEP,
    "src/long.py": "def long():\n" + "    x = 1\n" * 60, "src/empty.py": "", "src/b.js": "import x from 'y'\nfunction f(a) {\n" + "  g()\n" * 60 + "}\nclass D extends E {}\n",
    "src/c.go": "func main() {\n}\n", "notes.txt": "def no(): pass",
}


@pytest.fixture
def f(files):
    return files(SOURCES)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_analysis_equals_the_separate_operators(spark, f):
    a = analysis.analysed(f)
    every = smells.all_smells(f, ruleset.builtin(spark))
    cols = ["project", "file_path", "line_number", "owner_kind", "owner", "name", "severity", "description", "suggestion"]
    assert rows(analysis.smell_rows(a), *cols) == rows(every, *cols) and any(r[5] == "Deep Nesting" for r in rows(every, *cols))
    old = scores.file_report(f, every)
    assert rows(analysis.report(a), *old.columns) == rows(old, *old.columns)
    from tesserine.operators import quality

    score = ["file_path", "name", "kind", "line_start", "cyclomatic", "quality_score"]
    assert rows(analysis.symbol_rows(a), *score) == rows(quality.symbol_quality(symbols.symbol_table(f), every), *score)
    top = ["project", "kind", "file_path", "line_number", "name", "value"]
    assert rows(analysis.hotspots(a, 2, 1), *top) == rows(scores.complexity_hotspots(structure.functions_py(f), structure.classes_py(f), every, 2, 1), *top)
    both = [df.select("project", "cyclomatic_complexity", "code_smells", "lines_of_code").first() for df in (analysis.quality_metrics(a), quality.metrics_extract(old, structure.functions_py(f)))]
    assert both[0] == both[1]


def test_tree(f):
    trees = {r.file_path: json.loads(r.tree) for r in analysis.report_tree(analysis.analysed(f)).collect()}
    assert set(trees) == set(SOURCES) - {"notes.txt"}
    tree = trees["src/a.py"]
    assert tree["imports"] == ["os", "sys", "x.y.z"] and [c["name"] for c in tree["classes"]] == ["A"] and [m["name"] for m in tree["classes"][0]["methods"]] == ["m", "n"]
    assert [x["name"] for x in tree["functions"]] == ["deep"] and tree["functions"][0]["severity"] == "medium" and tree["classes"][0]["methods"][1]["return_type"] == "int"
    assert {s["name"] for s in trees["src/b.js"]["smells"]} == {"Long Function"} and trees["src/empty.py"]["classes"] == []
    flat = analysis.flat_tree(analysis.report_tree(analysis.analysed(f)))
    assert {(r.part, r.line) for r in flat.where("file_path = 'src/a.py' AND part IN ('method', 'class')").collect()} == {("class", 4), ("method", 5), ("method", 10)}


def test_one_scan_and_one_exchange(spark, f):
    from tesserine.session import scratch_path

    path = scratch_path(spark, "files")
    f.write.parquet(path)
    a = analysis.analysed(spark.read.parquet(path))
    for df, exchanges in ((analysis.report_tree(a), 0), (analysis.heatmap_rows(a), 0), (scores.project_summary(analysis.report(a)), 1), (analysis.hotspots(a, 5, 3), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == exchanges and "Join" not in plan
