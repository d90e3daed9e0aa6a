"""Streaming forms: the same operators on files as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import Rule
from ..operators import scan
from ..session import scratch_path


def read_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Stream one table of a folder of Parquet files; it may be a file or a folder of parts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parquet*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, exactly once, into a Parquet folder below the shared scratch folder; read it back."""
    spark = stream.sparkSession
    out, mark = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-mark")
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", mark)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Later than any event. Its row only moves the watermark.
END = "9000-01-01 00:00:00"


def drain_windows(events: DataFrame, windows: Callable[[DataFrame], DataFrame], time: str = "ts") -> DataFrame:
    """Process what is there, and close the windows that are still open at the end.

    The stream is joined by a second one that is empty at first. When the input is drained it gets one row far in the future, which takes the watermark past all windows,
    and the query goes on from its checkpoint. ``windows`` must be over a watermark on ``time`` and have a column window_start.
    """
    spark = events.sparkSession
    bell, out, mark = (scratch_path(spark, f"stream-{x}") for x in ("bell", "out", "mark"))
    spark.createDataFrame([], events.schema).write.parquet(bell)
    result = windows(events.unionByName(spark.readStream.schema(events.schema).parquet(bell)))
    for last in (False, True):
        if last:
            kinds = {f.name: f.dataType for f in events.schema}
            spark.range(1).select(*(F.lit(END if c == time else None).cast(k).alias(c) for c, k in kinds.items())).write.mode("append").parquet(bell)
        q = (result.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(result.schema).parquet(out).where(F.col("window_start") < F.lit(END).cast("timestamp"))


def stream_scan(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """The batch scan, unchanged: it is stateless and file-local."""
    return scan.scan_lines(files, rules)


CHANGE = "project string, file_path string, version int, status string"
_STATE = "sha256 string"


def stream_changes(versions: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Keep the last hash per path; emit new and modified versions; forget a path after the TTL.

    ``versions``: project, file_path, version, sha256. State is one digest per path.
    """
    ttl = ttl_seconds * 1000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("version")
        out = []
        for v, h in zip(rows["version"], rows["sha256"]):
            if h != last:
                out.append((key[0], key[1], v, "new" if last is None else "modified"))
            last = h
        state.update((last,))
        if ttl:
            state.setTimeoutDuration(ttl)
        yield pd.DataFrame(out, columns=["project", "file_path", "version", "status"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    return versions.groupBy("project", "file_path").applyInPandasWithState(step, CHANGE, _STATE, "append", timeout)


def trend_windows(events: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Tumbling means per type; with a stream, windows appear once the watermark has passed them."""
    w = events.withWatermark("ts", lateness) if events.isStreaming else events
    return w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("points"), F.avg("value").alias("mean")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "points", F.round("mean", 6).alias("mean"))
