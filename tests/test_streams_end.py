"""Windows that are open when the input ends, and analysers over Arrow batches."""

from pyspark.sql import functions as F

from tesserine.operators import plugins
from tesserine.session import scratch_path
from tesserine.streaming import streams


def test_all_windows_of_a_drained_input(spark):
    path = scratch_path(spark, "events")
    rows = [(f"2024-01-{d:02d} {h:02d}:30:00", k, float(d + h)) for d in (1, 2, 5) for h in (0, 7, 23) for k in "ab"]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    df.coalesce(1).write.parquet(path)
    df.where("ts < '2024-01-03'").limit(2).write.mode("append").parquet(path)  # a second file
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.drain_windows(stream, lambda s: streams.trend_windows(s, lateness="10 days"))
    want = streams.trend_windows(spark.read.parquet(path))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 6


def test_an_empty_stream_has_no_windows(spark):
    path = scratch_path(spark, "events")
    empty = spark.createDataFrame([], "ts timestamp, event_type string, value double")
    empty.write.parquet(path)
    assert streams.drain_windows(spark.readStream.schema(empty.schema).parquet(path), streams.trend_windows).isEmpty()


def test_batch_and_row_analysers(spark, files):
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.functions import arrow_udtf, udtf

    @arrow_udtf(returnType="project string, file_path string, size int")
    class Sizes:
        def eval(self, batch: pa.RecordBatch):
            yield pa.table({"project": batch.column("project"), "file_path": batch.column("file_path"), "size": pc.utf8_length(batch.column("content"))})

    @udtf(returnType="size int")
    class Size:
        def eval(self, content: str):
            yield (len(content),)

    f = files({"a.go": "x", "b.go": "", "c.py": "yy"})
    for handler, batches in ((Sizes, True), (Size, False)):
        reg = plugins.LanguageAnalyzers(spark)
        reg.register("go", handler, batches=batches)
        assert {(r.file_path, r.size) for r in reg.run(f, "go").collect()} == {("a.go", 1), ("b.go", 0)}
