from pyspark.sql import functions as F

from tesserine.functions import rules as rl
from tesserine.functions import text as tx
from tesserine.operators import ruleset, scan, scores

A1 = {
    "config.py": 'password = "my_secret_123"\napi_key = "sk-abc123def456"\n', "loader.py": "import pickle\ndata = pickle.loads(raw)\n",
    "runner.py": "import subprocess\nsubprocess.run(cmd, shell=True)\n", "hash.py": "import hashlib\nh = hashlib.md5(data)\n",
    "app.js": "eval(userInput);\n", "dom.js": "element.innerHTML = userInput;\n", "clean.py": "def hello():\n    return 'world'\n",
    "todo.py": "# TODO: fix this later\n# FIXME: broken\n", "bad.py": "try:\n    x = 1\nexcept:\n    pass\n", "big.py": "\n".join(["x = 1"] * 600),
    "worker.py": "import time\ntime.sleep(5)\n", "counter.py": "count = 0\ndef inc():\n    global count\n    count += 1\n", "data.py": "data = list(range(100000))\n",
}


def hits(files, contents, rules):
    return {(r.file_path, r.rule_id, r.line_number) for r in scan.scan_lines(files(contents), rules).collect()}


def test_security_fixture(files):
    got = hits(files, A1, rl.SECURITY)
    assert got == {("config.py", "SEC002", 1), ("config.py", "SEC002", 2), ("loader.py", "SEC003", 2), ("runner.py", "SEC004", 2), ("hash.py", "SEC005", 2),
                   ("app.js", "SEC011", 1), ("dom.js", "SEC012", 1)}


def test_performance_and_debt_fixture(files):
    perf = hits(files, A1, rl.PERFORMANCE)
    assert {("worker.py", "PERF006", 2), ("counter.py", "PERF005", 3), ("data.py", "PERF007", 1)} <= perf
    debt = hits(files, A1, rl.DEBT)
    assert len([d for d in debt if d[:2] == ("todo.py", "Unresolved TODO")]) == 2
    assert ("bad.py", "Bare Except", 3) in debt and not any(d[1] == "Pass in Except" for d in debt)
    assert not any(d[0] == "clean.py" for d in perf | debt)
    big = scores.debt_large_file(files(A1)).collect()
    assert [(r.file_path, r.effort_hours, r.priority) for r in big] == [("big.py", 1.0, "medium")]


def test_literal_scan_equals_join_scan(spark, files):
    """The slow join form as a cross-check."""
    pats = [(r.rule_id, i, tx.regex(p), r.languages) for r in rl.SECURITY + rl.DEBT for i, p in enumerate(r.patterns) if not scan.is_multiline(p)]
    rules = spark.createDataFrame(pats, "rule_id string, pattern_idx int, rx string, langs array<string>")
    from tesserine.operators.files import explode_lines

    lines = explode_lines(files(A1)).withColumn("e", F.regexp_replace(tx.extension("file_path"), r"^\.", ""))
    slow = lines.join(rules, F.expr("line rlike rx and (array_contains(langs, 'all') or array_contains(langs, e))"))
    key = lambda df: sorted((r.file_path, r.rule_id, r.pattern_idx, r.line_number) for r in df.collect())
    assert key(scan.scan_lines(files(A1), rl.SECURITY + rl.DEBT)) == key(slow)


def test_needle_is_always_part_of_a_match():
    import random

    import regex as rx

    random.seed(3)
    words = ["execute", "(", 'f"', "SELECT", "password", "=", "'abc'", "pickle.loads(", "yaml.load(", "open", "+", "token", '"' + "a" * 25 + '"', "eval", "new ", "Function", " ",
             "#", "TODO", "//", "def ", "12345", "range", "global ", "x", "except", ":", "Exception", ".append", ")", "+=", "deprecat", '"/usr/']
    for r in rl.SECURITY + rl.PERFORMANCE + rl.DEBT:
        for p in r.patterns:
            n = tx.needle(p)
            for _ in range(300):
                s = "".join(random.choices(words, k=8))
                assert not rx.search(p, s) or n in s
    assert tx.needle("a|b") == "" and tx.needle("(a)|(b)") == "" and tx.needle("x?yz*") == "y" and tx.needle("ab{0,2}c") == "a"


def test_scores(files):
    f = files({"a.js": "eval(x)\n"})
    r = scores.risk_score(scores.projects(f), scan.scan_lines(f, rl.SECURITY)).collect()[0]
    assert (r.risk_score, r.is_safe, r.findings) == (7.5, False, 1)
    empty = files({"a.txt": "nothing\n"})
    r = scores.risk_score(scores.projects(empty), scan.scan_lines(empty, rl.SECURITY)).collect()[0]
    assert (r.risk_score, r.is_safe) == (0.0, True)
    p = files({"a.py": "requests.get(url)\n"})
    assert scores.performance_score(scores.projects(p), scan.scan_lines(p, rl.PERFORMANCE)).collect()[0].performance_score == 90.6


def test_debt_score(spark, files):
    items = spark.createDataFrame([("p", "todo", "a", "f", 1, "", 2.0, "low"), ("p", "error", "b", "f", 1, "", 1.0, "high")],
                                  "project string, category string, name string, file_path string, line_number int, description string, effort_hours double, priority string")
    r = scores.debt_score(files({"f": "\n".join(["x"] * 100)}), items).collect()[0]
    assert (r.total_effort_hours, r.debt_score) == (3.0, 75.0)
    assert scores.debt_top(items, 10).collect()[0].effort_hours == 2.0


def test_top_n_and_order_do_not_depend_on_input_order(files):
    many = {f"file{i}.py": 'password = "a1"\nsecret = "b2"\napi_key = "c3"\ntoken = "abcdefghijklmnopqrstuvwx"\n' for i in range(10)}
    top = scan.scan_top(scan.scan_lines(files(many), rl.SECURITY), 5).select("file_path", "line_number", "rule_id").collect()
    back = scan.scan_top(scan.scan_lines(files(dict(reversed(many.items()))), rl.SECURITY), 5).select("file_path", "line_number", "rule_id").collect()
    assert len(top) == 5 and top == back


def test_custom_pattern(files):
    mine = rl.Rule("security", "CUSTOM001", "c", "custom", "low", ["all"], [r"bad_pattern_\d+"], "d")
    assert hits(files, {"x.py": "bad_pattern_42\n"}, [*rl.SECURITY, mine]) == {("x.py", "CUSTOM001", 1)}
    assert hits(files, {"x.py": "bad_pattern_42\n"}, [mine._replace(enabled=False), mine._replace(rule_id="C2")]) == {("x.py", "C2", 1)}


def test_multiline_lines(files):
    text = "a\nfor x in y:\n    open(x)\nb\nfor x in z:\n    open(x)\n"
    got = scan.scan_multiline(files({"m.py": text}), rl.PERFORMANCE).where("rule_id = 'PERF001'").collect()
    assert sorted(r.line_number for r in got) == [2, 5]


def test_text_semantics(files, spark):
    assert hits(files, {"n.py": "v = é12 \n"}, rl.DEBT) == set()  # a letter before the digits
    c = spark.createDataFrame([("",), ("a\nb\n",), ("\ta\u00a0",)], "c string")
    assert [r[0] for r in c.select(tx.line_count("c")).collect()] == [1, 3, 1]
    assert c.where(tx.strip("c") == "a").count() == 1


def test_rule_config(spark):
    b = ruleset.builtin(spark)
    cfg = {"disabled_rules": ["COMPLEX001", "nope"], "thresholds": {"COMPLEX002": 99}, "severities": {"COMPLEX003": "critical"},
           "custom_rules": [{"rule_id": "C1", "name": "one"}, {"rule_id": "C1", "name": "two", "threshold": 1}]}
    e = {r.rule_id: r for r in ruleset.rules_config_apply(b, cfg).collect()}
    assert len(e) == 14 and not e["COMPLEX001"].enabled and e["COMPLEX002"].threshold == 99 and e["COMPLEX003"].severity == "critical" and e["C1"].name == "two"
    assert {r.rule_id for r in ruleset.rules_enabled(b, language="python").collect()} >= {"MAINT002", "SEC001"}
    assert "MAINT002" not in {r.rule_id for r in ruleset.rules_enabled(b, language="go").collect()}
    v = spark.createDataFrame([("COMPLEX001", 50), ("COMPLEX001", 51), ("MAINT001", 999)], "rule_id string, value int")
    assert [r.value for r in ruleset.threshold_violations(v, b).collect()] == [51]
    import json

    out = json.loads(ruleset.rules_config_export(ruleset.rules_config_apply(b, cfg), b).collect()[0][0])
    assert out["disabled_rules"] == ["COMPLEX001"] and out["thresholds"]["COMPLEX002"] == 99 and [r["rule_id"] for r in out["custom_rules"]] == ["C1"]
    assert ruleset.custom_rules_remove(b, ["SEC001"]).count() == 12


def test_rule_config_read_back(spark):
    from tesserine.session import scratch_path

    b = ruleset.builtin(spark)
    changed = ruleset.rules_config_apply(b, {"disabled_rules": ["COMPLEX001"], "thresholds": {"COMPLEX002": 99}, "custom_rules": [{"rule_id": "C1", "name": "zwölf", "threshold": 1, "tags": ["a"]}]})
    path = scratch_path(spark, "rules")
    ruleset.rules_config_save(ruleset.rules_config_export(changed, b), path)
    again = ruleset.rules_config_apply(b, ruleset.rules_config_load(spark, path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, changed.collect()))
    assert ruleset.rules_config_load(spark, scratch_path(spark, "nothing")) == {}


def test_search_and_globs(files):
    f = files({"src/a.py": "one\ntwo\nthree\nfour", "b.txt": "two"})
    r = scan.pattern_search(f, "two|four", before=1, after=1, include="src/**").orderBy("line_number").collect()
    assert [(x.line_number, x.context) for x in r] == [(2, ["one", "two", "three"]), (4, ["three", "four"])]
    import re

    rx = re.compile(tx.glob_regex("src/**/*.py"))
    assert rx.match("src/a.py") and rx.match("src/x/y/a.py") and not rx.match("lib/a.py") and not re.match(tx.glob_regex("*.py"), "a/b.py")
