"""Incremental runs over stored results, and the history table with its commit log."""

import os

from pyspark.sql import functions as F

from tesserine.operators import results, snapshots
from tesserine.session import scratch_path
from tesserine.sources import history_table


def counted(files):
    return files.select("digest", F.length("content").alias("size"))


def run(files, path, name):
    return {(r.project, r.file_path): (r.size, r.origin) for r in results.incremental(files, path, "v1", name, counted).collect()}


def test_unchanged_texts_are_not_analysed_again(spark):
    path = scratch_path(spark, "results")
    results.create(spark, path, "v1", "size int")
    make = lambda rows: spark.createDataFrame(rows, "project string, file_path string, content string")
    old = make([("p", "a.py", "one"), ("p", "b.py", "three"), ("p", "copy.py", "one"), ("q", "a.py", "one"), ("q", "n.py", None)])
    assert run(old, path, "1") == {("p", "a.py"): (3, "fresh"), ("p", "b.py"): (5, "fresh"), ("p", "copy.py"): (3, "fresh"), ("q", "a.py"): (3, "fresh"), ("q", "n.py"): (None, "fresh")}
    assert results.read(spark, path, "v1").count() == 3  # copies once
    seen = []

    def watched(files):
        seen.extend(r.file_path for r in files.collect())
        return counted(files)

    new = make([("p", "a.py", "one"), ("p", "b.py", "three!"), ("p", "moved.py", "three"), ("p", "a.js", "one")])
    got = {r.file_path: (r.size, r.origin) for r in results.incremental(new, path, "v1", "2", watched).collect()}
    assert got == {"a.py": (3, "cache"), "b.py": (6, "fresh"), "moved.py": (5, "cache"), "a.js": (3, "fresh")} and sorted(seen) == ["a.js", "b.py"]
    assert run(new, path, "3").values() and set(o for _, o in run(new, path, "4").values()) == {"cache"}
    results.create(spark, path, "v1", "size int")  # stays
    assert results.read(spark, path, "v1").count() == 5


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(results, "BITMAP", 3)
    path = scratch_path(spark, "results")
    results.create(spark, path, "v1", "size int")
    files = spark.createDataFrame([("p", f"m{i}.py", "x" * i) for i in range(40)], "project string, file_path string, content string")
    assert run(files, path, "1") == {("p", f"m{i}.py"): (i, "fresh") for i in range(40)}


def test_reuse_flags(spark):
    files = spark.createDataFrame([("p", "a", "x"), ("p", "b", "x"), ("p", "c", "y")], "project string, file_path string, content string")
    stored = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("x", "2023-01-01 00:00:00")], "c string, t string").select(F.sha2("c", 256).alias("sha256"), F.col("t").cast("timestamp").alias("created_at"))
    assert {(r.file_path, r.reused) for r in snapshots.reuse_flags(files, stored, "2024-01-01 01:00:00", 7200).collect()} == {("a", True), ("b", True), ("c", False)}
    assert not snapshots.reuse_flags(files, stored, "2024-01-01 03:00:00", 7200).where("reused").count()


def history(spark, days, name="p"):
    return spark.createDataFrame([(name, "scan", f"2024-01-{d:02d} 12:00:00", "{}") for d in days], "project_name string, analysis_type string, t string, result_json string").withColumn("timestamp", F.to_timestamp("t")).drop("t")


def test_batches_are_committed_once(spark):
    path = scratch_path(spark, "history")
    assert history_table.append(history(spark, [1, 2, 3]), path, "b1")
    assert not history_table.append(history(spark, [1, 2, 3]), path, "b1")
    assert history_table.append(history(spark, [3, 4]), path, "b2")
    back = history_table.read(spark, path)
    assert back.count() == 5 and back.select("id").distinct().count() == 4
    # a batch that failed after writing: not read, and replaced by its repetition
    history(spark, [5]).withColumns({"id": F.lit("lost"), "day": F.to_date("timestamp"), "batch": F.lit("b3")}).write.mode("append").partitionBy("day", "batch").parquet(f"{path}/data")
    assert history_table.read(spark, path).count() == 5
    assert history_table.append(history(spark, [5]), path, "b3")
    back = history_table.read(spark, path)
    assert back.count() == 6 and back.where("id = 'lost'").isEmpty()


def test_retention_drops_days(spark):
    path = scratch_path(spark, "history")
    history_table.append(history(spark, [1, 2, 3, 10]), path, "b1")
    assert history_table.retain(spark, path, "2024-01-12 13:00:00", 9) == ["2024-01-01", "2024-01-02"]
    assert sorted(x for x in os.listdir(f"{path}/data") if x.startswith("day=")) == ["day=2024-01-03", "day=2024-01-10"]
    assert [str(r.timestamp) for r in history_table.read(spark, path).collect()] == ["2024-01-10 12:00:00"]  # of the third of January only the time after 13:00 counts
    history_table.append(history(spark, [1, 11]), path, "late")  # too old when it comes
    assert history_table.read(spark, path).count() == 2
    assert history_table.retain(spark, path, "2024-01-12 13:00:00", 9) == ["2024-01-01"]
