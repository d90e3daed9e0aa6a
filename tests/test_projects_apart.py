"""Projects with the same relative paths stay apart, and lists are per project."""

from pyspark.sql import functions as F

from tesserine.functions import rules as rl
from tesserine.operators import changeset, clones, files as fl, graph, plugins, projects, scan, scores

CODE = "\n".join(f"value_{i} = compute(alpha_{i}, beta_{i})" for i in range(6))


def three(spark, content=lambda p: CODE):
    return spark.createDataFrame([(p, "src/main.py", content(p)) for p in ("p1", "p2", "p3")], "project string, file_path string, content string")


def test_blocks_of_equal_paths(spark):
    near = three(spark, lambda p: CODE.replace("alpha_3", f"alpha_{p}"))
    blocks = clones.blocks_sliding(near)
    assert blocks.select("block_id").distinct().count() == blocks.count() == 3
    assert clones.similar_pairs(blocks, 0.6).count() == 3
    assert clones.duplicates_exact(clones.blocks_sliding(three(spark))).select("block_id", "first_id").distinct().count() == 3
    assert {r.block_id1.split(":")[0] for r in clones.clone_summary(clones.blocks_sliding(three(spark)), 1).where("kind = 'duplicate'").collect()} == {"p1"}


def test_cycles_do_not_cross_projects(spark):
    edges = spark.createDataFrame([("p1", "a", "b"), ("p2", "b", "a"), ("p3", "a", "b"), ("p3", "b", "a"), ("p1", "x", "x")], "project string, source string, target string")
    nodes, through, cycles = graph.project_cycles(edges)
    assert {(r.project, r.node) for r in nodes.collect()} == {("p3", "a"), ("p3", "b"), ("p1", "x")}
    assert {(r.project, r.cycle, r.length) for r in cycles.collect()} == {("p3", "a -> b -> a", 2), ("p1", "x -> x", 1)}
    assert {(r.project, r.source, r.target, r.length) for r in through.collect()} == {("p3", "a", "b", 2), ("p3", "b", "a", 2), ("p1", "x", "x", 1)}
    assert {(r.project, r.module_name) for r in graph.dep_roots(edges).collect()} == {("p1", "a"), ("p2", "b")}
    assert {(r.project, r.target) for r in graph.dep_hubs(edges, 1).collect()} == {("p1", "b"), ("p2", "a"), ("p3", "a")}


def test_a_change_meets_its_own_project_only(spark):
    diff = "diff --git a/setup.py b/setup.py\n--- a/setup.py\n+++ b/setup.py\n@@ -1,1 +1,2 @@\n+x\n"
    diffs = spark.createDataFrame([("p1", "c1", diff)], "project string, change_id string, diff_text string")
    report = spark.createDataFrame([(p, "setup.py", 1, 0, 2, 3) for p in ("p1", "p2", "p3")], "project string, file_path string, functions int, classes int, smells int, cyclomatic int")
    row = changeset.diff_assessment(diffs, report).first()
    assert (row.files_analyzed, row.total_code_smells) == (1, 2)
    both = diffs.unionByName(spark.createDataFrame([("p2", "c1", diff + diff.replace("setup", "other"))], diffs.schema))
    assert {(r.project, r.change_id, r.total_files) for r in changeset.diff_assessment(both, report).collect()} == {("p1", "c1", 1), ("p2", "c1", 2)}


def test_copies_of_projects_with_colons_in_their_names(spark):
    files = spark.createDataFrame([(p, f"src/{n}.py", CODE) for p in ("https://a/x", "https://b/y") for n in "mn"], "project string, file_path string, content string")
    own = files.withColumn("content", F.concat("content", F.lit("\n"), "project"))
    top = clones.clone_summary(clones.blocks_sliding(own, 7), 1).where("kind = 'duplicate'").collect()
    assert {r.block_id1 for r in top} == {"https://a/x:src/m.py:1", "https://b/y:src/m.py:1"}


def test_lists_are_per_project(spark):
    f = three(spark, lambda p: 'password = "my_secret_123"\n' * 3 + "if a and b or c:\n" * 12)
    found = scan.scan_lines(f, rl.SECURITY)
    count = lambda df: {r.project: r["count"] for r in df.groupBy("project").count().collect()}
    each = {"p1": 1, "p2": 1, "p3": 1}
    assert count(scan.scan_top(found, 2)) == {p: 2 for p in each} and count(fl.cap_files(f, 1)) == each
    items = scores.debt_scan_items(scan.scan_lines(three(spark, lambda p: "# TODO: x\n" * 3), rl.DEBT))
    assert count(scores.debt_top(items, 1)) == each
    top = plugins.complexity_hotspot(f).where("key LIKE 'top:%'").collect()
    assert sorted(r.key for r in top) == [f"top:{p}:src/main.py" for p in each]


def test_sample_rate_is_an_argument(spark):
    f = spark.range(1000).selectExpr("'p' AS project", "concat('f', id) AS file_path")
    assert fl.sample_files(f).count() == 1000 and fl.sample_files(f, rates=((0, 0.1),)).count() == 100


def test_the_manifest_at_the_root_counts(spark):
    rows = [("p", "requirements.txt", "requirements.txt", "fastapi==1"), ("p", "requirements.txt", "sub/requirements.txt", "zzz\n"), ("q", "requirements.txt", "a/requirements.txt", "numpy")]
    df = spark.createDataFrame(rows, "project string, file_name string, file_path string, content string")
    assert {r.project: r.project_type for r in projects.project_type(df).collect()} == {"p": "fastapi", "q": "python"}
