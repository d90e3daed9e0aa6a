"""Diffs, snapshots, history, quality, reports, projects, plugins, IO and streams on literal rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tesserine.functions import rules as rl
from tesserine.operators import changeset, graph, history, plugins, projects, quality, reports, reviews, scan, scores, snapshots
from tesserine.session import scratch_path
from tesserine.sources import io
from tesserine.streaming import streams


def test_diff(spark):
    one = ("diff --git a/src/main.py b/src/main.py\nindex 1..2\n--- a/src/main.py\n+++ b/src/main.py\n@@ -10,7 +10,8 @@ def f\n ctx\n-old\n+new\n+new2\n"
           "diff --git a/n.py b/n.py\nnew file mode 100644\n@@ -0,0 +1,5 @@\n+a\n+b\n+c\ndiff --git a/d.py b/d.py\ndeleted file mode 100644\n@@ -1 +0,0 @@\n-a\n-b")
    d = spark.createDataFrame([("c1", one), ("c2", "")], "change_id string, diff_text string")
    f = changeset.diff_files(d).orderBy("file_no").collect()
    assert [(r.file_path, r.change_type, r.additions, r.deletions) for r in f] == [("src/main.py", "modified", 2, 1), ("n.py", "added", 3, 0), ("d.py", "deleted", 0, 2)]
    h = changeset.diff_hunks(d).orderBy("file_no").collect()
    assert [(r.old_start, r.old_lines, r.new_start, r.new_lines) for r in h] == [(10, 7, 10, 8), (0, 0, 1, 5), (1, 1, 0, 0)]


def test_diff_risk(spark):
    rows = spark.createDataFrame([(0, 5, 100, "low"), (5, 15, 100, "medium"), (10, 30, 100, "high"), (0, 0, 0, "low")], "s int, c int, a int, want string")
    assert rows.where(changeset.risk(F.col("s"), F.col("c"), F.col("a")) != F.col("want")).isEmpty()


def test_changed_files(files):
    old, new = files({"a.py": "1", "c.py": "1", "s.py": "same"}), files({"a.py": "2", "b.py": "1", "s.py": "same"})
    got = {r.file_path: r.status for r in snapshots.changed_files(old, new).collect()}
    assert got == {"a.py": "modified", "b.py": "new", "c.py": "deleted"}
    assert {r.status for r in snapshots.changed_files(old.limit(0), new).collect()} == {"new"}
    s = snapshots.change_status(old, old).collect()[0]
    assert (s.status, s.should_reanalyze) == ("no_changes", False)
    assert snapshots.change_status(old.limit(0), new).collect()[0].status == "no_cache"


def test_merge_has_one_row_per_path(spark):
    s = "project string, file_path string, v int"
    cached, fresh = spark.createDataFrame([("p", "a", 1), ("p", "b", 1), ("p", "c", 1)], s), spark.createDataFrame([("p", "a", 2), ("p", "b", 2)], s)
    changes = spark.createDataFrame([("p", "a", "modified"), ("p", "c", "deleted")], "project string, file_path string, status string")
    assert sorted((r.file_path, r.v) for r in snapshots.merge_incremental(cached, fresh, changes).collect()) == [("a", 2), ("b", 2)]


def test_reuse_respects_ttl(spark, files):
    f = files({"a": "x", "b": "y"})
    stored = snapshots.file_hash(f).select("sha256", F.expr("timestamp'2024-01-01 00:00:00'").alias("created_at")).where(F.col("sha256") == F.sha2(F.lit("x"), 256))
    count = lambda now, ttl: tuple(d.count() for d in snapshots.reuse_by_hash(f, stored, now, ttl))
    assert count("2024-01-01 01:00:00", 3600) == (1, 1) and count("2024-01-01 01:00:01", 3600) == (0, 2) and count("2030-01-01 00:00:00", 0) == (1, 1)


def _hist(spark, values, kind="security"):
    rows = [(str(i), "p", "/p", kind, '{"a": {"b": %s}}' % v, dt.datetime(2024, 1, 1 + i), 1.0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id string, project_name string, project_path string, analysis_type string, result_json string, timestamp timestamp, duration double, event_id int")


@pytest.mark.parametrize("values, latest, direction, rate", [
    ([70, 80, 90], 90.0, "improving", 12.5), ([90, 80], 80.0, "declining", -11.1), ([80, 80.2], 80.2, "stable", 0.3), ([0, 10], 10.0, "improving", 0.0), ([5], 5.0, "stable", 0.0)])
def test_trends(spark, values, latest, direction, rate):
    two = history.trend_change_rate(history.trend_direction(history.last_two(_hist(spark, values), "a.b"))).collect()[0]
    assert (two.latest_value, two.trend_direction, two.change_rate) == (latest, direction, rate)


def test_trend_keeps_time_order_and_drops_missing(spark):
    h = _hist(spark, [30, 20])
    assert [r.value for r in history.metric_trend(h, "a.b").orderBy("timestamp").collect()] == [30.0, 20.0]
    assert history.metric_trend(h, "a.nope").isEmpty()
    both = h.unionByName(_hist(spark, [1], "quality"))
    assert history.latest(both).count() == 3 and history.latest(both, analysis_type="quality").count() == 1
    assert history.retain(h, "2024-01-03 00:00:00", 1).count() == 1


def test_report_compare(spark):
    p = spark.createDataFrame([("x", '{"m": 50, "z": 0}', '{"m": 65, "z": 3, "only": 1}')], "k string, b string, a string")
    r = {x.metric_name: x for x in history.report_compare(p, "b", "a", ["m", "z", "only"]).collect()}
    assert set(r) == {"m", "z"} and (r["m"].absolute_change, r["m"].relative_change, r["m"].is_improved) == (15.0, 30.0, True) and r["z"].relative_change == 0.0


def _metrics(spark, **kw):
    base = dict(key="k", cyclomatic_complexity=1.0, cognitive_complexity=1.0, code_smells=0, duplication_ratio=0.0, test_coverage=1.0, documentation_ratio=1.0,
                lines_of_code=1, comment_lines=0, blank_lines=0, maintainability_index=100.0, technical_debt=0.0)
    return spark.createDataFrame([{**base, **kw}])


def test_quality(spark):
    best = quality.quality_score(_metrics(spark)).collect()[0]
    assert (round(best.overall_score, 6), best.grade) == (100.0, "A")
    score = lambda **kw: _metrics(spark, **kw).select(quality.complexity()).collect()[0][0]
    assert score(cyclomatic_complexity=30.0, cognitive_complexity=50.0) == 42.5
    assert [score(cyclomatic_complexity=float(c)) for c in (5, 10, 15, 16)] == [100, 90, 80, 97.5]
    rel = lambda c: round(_metrics(spark, test_coverage=c).select(quality.reliability()).collect()[0][0], 6)
    assert rel(1.5) == 130.0 and rel(1.51) == 40.906
    tips = _metrics(spark, cyclomatic_complexity=11.0, test_coverage=0.5).select(quality.recommendations()).collect()[0][0]
    assert len(tips) == 2 and "11.0" in tips[0] and "50.0%" in tips[1]


def test_timings(spark):
    t = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2), ("a", 2, 0.3), ("b", 0, 0.4)], "name string, iteration int, seconds double")
    r = {x.name: x for x in scores.timing_stats(t).collect()}
    assert (r["a"].min_time, r["a"].max_time, r["a"].mean_time, r["a"].total_time, r["b"].stdev_time) == (0.1, 0.3, 0.2, 0.6, 0.0)
    assert [(x.name1, x.name2, x.speedup) for x in scores.timing_compare(t).collect()] == [("a", "b", 0.5)]
    assert [(x.name1, x.name2, x.speedup) for x in scores.timing_compare(t, baseline="b").collect()] == [("b", "a", 2.0)]


def test_graph_fixture(files):
    e = graph.dep_edges(files({"types.py": "from typing import List, Dict\n", "app.js": 'const fs = require("fs");\n', "a.py": "import os\n", "b.py": "import os, sys\n"})).collect()
    assert {(r.source, r.target, r.import_type) for r in e} == {("types", "typing", "from_import"), ("app", "fs", "require"), ("a", "os", "import"), ("b", "os,", "import")}
    f = files({"a.py": "import b\nimport c\n", "b.py": "\n"})
    edges = graph.dep_edges(f)
    nodes = graph.dep_nodes(f, edges)
    assert {(r.module_name, r.file_path, r.in_degree, r.out_degree) for r in nodes.collect()} == {("a", "a.py", 0, 2), ("b", "b.py", 1, 0), ("c", "(external)", 1, 0)}
    assert graph.dep_coupling(edges, nodes).collect()[0].coupling == 0.667
    assert [r.module_name for r in graph.dep_roots(edges).collect()] == ["a"]


def test_locations(spark):
    df = spark.createDataFrame([("src/main.py:42",), ("plain.py",), ("c:/x.py",)], "l string")
    uri, line = reports.location_split("l")
    assert [tuple(r) for r in df.select(uri, line).collect()] == [("src/main.py", 42), ("plain.py", 1), ("c:/x.py", 1)]
    lv = df.limit(1).select(*[reports.level(F.lit(s)) for s in ("critical", "medium", "info", "odd")]).collect()[0]
    assert tuple(lv) == ("error", "warning", "note", "warning")


def test_reviews(spark):
    text = "评分 8/10\n关键发现\n- a\nx\n - b\n\n- c\n改进建议\n\n- d\n\n- e"
    r = spark.createDataFrame([(1, 1, text)], "conv_id int, turn int, text string")
    got = [(x.section, x.item) for x in reviews.review_bullets(r).orderBy("section", "item_no").collect()]
    assert [i for s, i in got if s == "findings"] == ["- a", "- b"] and [i for s, i in got if s == "recommendations"] == ["- d"]
    assert reviews.review_score(r).collect()[0].score == 8


def test_projects(spark):
    m = spark.createDataFrame([("a", "package.json", '{"dependencies": {"express": "4"}, "scripts": {"start": "node . -p 5001"}}'), ("b", "requirements.txt", "FastAPI\n"),
                               ("c", "go.mod", "module x\ngo 1.21"), ("c", ".env", "PORT=abc\n"), ("c", ".env.local", "PORT='7001'\n"), ("d", "package.json", "{broken")],
                              "project string, file_name string, content string")
    assert {r.project: r.project_type for r in projects.project_type(m).collect()} == {"a": "express", "b": "fastapi", "c": "go", "d": "node"}
    assert {r.project: r.port for r in projects.detect_port(m).collect()} == {"a": 5001, "b": 8000, "c": 7001, "d": 3000}


def test_plugins(files):
    reg = plugins.default_registry()
    f = files({"a.py": "x\n", "b.js": "y"})
    got = {r.key: r.value for r in reg.run("file_stats", f).collect()}
    assert got["total_files"] == "2" and got["ext:.py"] == "1" and got["ext:.js"] == "1"
    r = reg.run("absent", f).collect()[0]
    assert not r.success and "not found" in r.error

    def rows(batches):
        for b in batches:
            b = b.assign(key=b["file_path"], value=b["content"].str.len().astype(str))
            yield b[["key", "value"]]

    reg.register("lengths", plugins.row_plugin(rows))
    reg.register("bad", lambda df: df.select(F.raise_error(F.lit("late failure")).alias("key"), F.lit("").alias("value")))
    out = {(r.plugin, r.success, r.key) for r in reg.run_all(f, ["lengths", "bad"]).collect()}
    assert out == {("lengths", True, "a.py"), ("lengths", True, "b.js"), ("bad", False, None)}


def test_tree_source(spark, files):
    root = scratch_path(spark, "tree")
    io.write_tree(files({"src/a.py": "x\r\n", "node_modules/b.js": "y", "c.txt": "z"}), root)
    with open(os.path.join(root, "bad.go"), "wb") as f:
        f.write(b"ok \xff")
    got = {r.file_path: r.content for r in io.load_tree(spark, root).collect()}
    assert got == {"src/a.py": "x\r\n", "bad.go": "ok \ufffd"}


def test_tree_source_lists_and_reads_in_tasks(spark, files, monkeypatch):
    """Few tasks for many small files, several rounds of listing, and the rows of Spark's own file source."""
    root = scratch_path(spark, "tree")
    plain = {f"a/d{i % 40}/m{i}.py": f"x{i}" for i in range(1_000)}
    odd = {"a/b/c/d/e.go": "deep \u00e9\n", "UPPER.PY": "no", "n.txt": "no", "__init__.py": "no", "_h/x.py": "no", ".h/x.py": "no", "_k=1/x.py": "yes",
           "a/venv/x.py": "no", "a/venv.py": "yes", "a/b.js/c.js": "yes", "sp ace/%41 #?.ts": "yes", "big.java": "z" * 100_000}
    io.write_tree(files(plain | odd | {"empty.rs": ""}), "file://" + root)
    assert not [n for _, _, names in os.walk(root) for n in names if n.endswith(".part")]
    monkeypatch.setattr(io, "LISTED", 20)
    monkeypatch.setattr(io, "HELD", 1_000)
    tree = io.load_tree(spark, root)
    assert tree.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = sorted(tuple(r) for r in tree.collect())
    assert [r[:2] for r in got] == sorted([*plain.items(), *((k, v) for k, v in odd.items() if v != "no")])
    assert all(n == len(content.encode()) for _, content, n in got)
    assert sorted(tuple(r) for r in io.load_tree(spark, "file://" + root + "/").collect()) == got
    assert io.load_tree(spark, root).where("content = 'yes' AND bytes = 3").count() == 4
    monkeypatch.setattr(io, "_mounted", lambda *_: None)
    assert sorted(tuple(r) for r in io.load_tree(spark, root).collect()) == got


def test_tree_keeps_one_whole_text_of_equal_paths(spark):
    root = scratch_path(spark, "tree")
    texts = [("d/a.py", c * 50_000) for c in "abcdefgh"]
    io.write_tree(spark.createDataFrame(texts * 20, "file_path string, content string").repartition(8), root)
    got = [tuple(r) for r in io.load_tree(spark, root).select("file_path", "content").collect()]
    assert len(got) == 1 and got[0] in texts


def test_tree_of_nothing(spark):
    root = scratch_path(spark, "tree")
    os.makedirs(os.path.join(root, "a"))
    assert io.load_tree(spark, root).collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.load_tree(spark, root + "-absent")


def test_reports_skip_bad_files(spark):
    root = scratch_path(spark, "json")
    os.makedirs(root)
    for name, text in (("a.json", '{\n "file_path": "a", "total_lines": 3\n}'), ("b.json", "{ not json")):
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
    assert [(r.file_path, r.total_lines) for r in io.read_reports(spark, root, multi_line=True).collect()] == [("a", 3)]


def test_history_table(spark):
    path = scratch_path(spark, "hist")
    h = _hist(spark, [1, 2]).drop("event_id", "id")
    io.history_append(h, path)
    io.history_append(h.limit(1), path)
    back = spark.read.parquet(path)
    assert back.count() == 3 and back.select("id").distinct().count() == 2


def test_stream_changes_forget_after_ttl(spark):
    """A short TTL: the second sight of a path, long after the first, is new again."""
    import time

    src, out, mark = (scratch_path(spark, x) for x in ("in", "out", "mark"))
    schema = "project string, file_path string, version int, sha256 string"
    put = lambda v, h: spark.createDataFrame([("p", "a", v, h)], schema).coalesce(1).write.mode("append").parquet(src)
    put(1, "h1")
    q = (streams.stream_changes(spark.readStream.schema(schema).parquet(src), ttl_seconds=1).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", mark).outputMode("append").start())
    try:
        seen = lambda: sorted((r.version, r.status) for r in spark.read.schema(streams.CHANGE).parquet(out).collect())

        def wait(n):
            end = time.time() + 60
            while time.time() < end:
                if os.path.isdir(out) and len(seen()) >= n:
                    return seen()
                time.sleep(0.5)
            raise AssertionError("stream did not deliver")

        assert wait(1) == [(1, "new")]
        time.sleep(6)
        put(2, "h1")
        assert wait(2) == [(1, "new"), (2, "new")]
    finally:
        q.stop()


def test_stream_scan_uses_the_batch_operator(files):
    f = files({"a.js": "eval(x)\n"})
    assert streams.stream_scan(f, rl.SECURITY).collect() == scan.scan_lines(f, rl.SECURITY).collect()
