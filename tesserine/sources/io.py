"""Sources and sinks: source trees, JSON reports, the history table."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import SKIPPED_DIRS, SOURCE_EXTENSIONS
from ..session import scratch_path


#: Names that a task lists below a folder before it hands the folders further below on.
LISTED = 10_000
#: Files and bytes that a task reads.
TASK_FILES, TASK_BYTES = 8_192, 1 << 27
#: Bytes of files that a task holds, besides the last file.
HELD = 1 << 23


def load_tree(spark: SparkSession, root: str, extensions: list[str] = SOURCE_EXTENSIONS, skipped: list[str] = SKIPPED_DIRS) -> DataFrame:
    """Every source file below ``root``; undecodable bytes become replacement characters.

    In a folder that all executors mount the tasks list names and read bytes; the driver learns counts only. What Spark alone can open, patterns
    and single files are left to its file source, which lists the wanted names in the driver. Either way empty files and names
    that Spark takes for hidden (``_`` or ``.`` first) are left out.
    """
    top = _mounted(spark, root)
    if top is not None and os.path.isdir(top):
        names, parts = _names(spark, top, extensions, skipped)
        raw = _contents(names.repartition(parts, "path"), top)
        text = lambda c: F.make_valid_utf8(F.col(c).cast("string")).alias
        return raw.select(text("path")("file_path"), text("content")("content"), F.col("size").alias("bytes"))
    glob = "*{" + ",".join(extensions) + "}"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root))
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    out = raw.select(rel.alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("bytes"))
    return out.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(*[F.lit(s) for s in skipped])))


def _mounted(spark: SparkSession, root: str) -> str | None:
    """The path of ``root`` if its file system is the machines' own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _names(spark: SparkSession, top: str, extensions: list[str], skipped: list[str]) -> tuple[DataFrame, int]:
    """The wanted files below ``top`` (path below it, size), kept in the shared folder, and the number of tasks to read them with.

    Rounds of tasks list folders. A task goes on below a folder until it has seen ``LISTED`` names, and returns what is not listed yet with size -1.
    """
    base, ends, skip = os.fsencode(top), tuple(os.fsencode(e) for e in extensions), {os.fsencode(s) for s in skipped}

    def hidden(name: bytes) -> bool:
        """What Spark's listings leave out."""
        if name.startswith(b"_"):
            return b"=" not in name and not name.startswith((b"_metadata", b"_common_metadata"))
        return name.startswith(b".") or name.endswith(b"._COPYING_")

    def rows(found: list[tuple[bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["path", "size"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, int]] = []
        for start in (p for b in batches for p in b.column(0).to_pylist()):
            todo, seen = [start], 0
            while todo and seen < LISTED:
                at = todo.pop()
                try:
                    entries = os.scandir(os.path.join(base, at))
                except FileNotFoundError:  # gone meanwhile
                    continue
                with entries:
                    for e in entries:
                        seen += 1
                        if hidden(e.name) or e.name in skip:
                            continue
                        if e.is_dir():
                            todo.append(os.path.join(at, e.name))
                        elif e.name.endswith(ends) and e.is_file() and (size := e.stat().st_size):
                            found.append((os.path.join(at, e.name), size))
                        if len(found) >= LISTED:
                            yield rows(found)
                            found = []
            found += [(p, -1) for p in todo]
        yield rows(found)

    out, files, size, folders = scratch_path(spark, "names"), 0, 0, 1
    open_ = spark.createDataFrame([(bytearray(),)], "path binary").coalesce(1)
    cores, rounds = spark.sparkContext.defaultParallelism, []
    while folders:
        rounds.append(os.path.join(out, str(len(rounds))))
        open_.mapInArrow(walk, "path binary, size long").write.parquet(rounds[-1])
        found = spark.read.schema("path binary, size long").parquet(rounds[-1])
        is_file = F.col("size") > 0
        n = found.agg(F.count_if(is_file).alias("files"), F.sum(F.when(is_file, F.col("size"))).alias("size"), F.count_if(~is_file).alias("folders")).first()
        files, size, folders = files + n.files, size + (n.size or 0), n.folders
        open_ = found.where(~is_file).select("path").repartition(max(1, min(folders, max(4 * cores, folders // 16))), "path")
    parts = max(1, min(files, max(cores, files // TASK_FILES, size // TASK_BYTES)))
    return spark.read.schema("path binary, size long").parquet(*rounds).where("size > 0"), parts


def _contents(names: DataFrame, top: str) -> DataFrame:
    """The bytes of the files that ``names`` lists, read a few at a time."""
    base = os.fsencode(top)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, held, done = [], 0, 0
            for p in b.column(0).to_pylist():
                with open(os.path.join(base, p), "rb", buffering=0) as f:
                    some.append(f.read())
                held += len(some[-1])
                if held >= HELD or done + len(some) == b.num_rows:
                    part = b.slice(done, len(some))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(some, pa.binary())], ["path", "size", "content"])
                    some, held, done = [], 0, done + len(some)

    return names.mapInArrow(read, "path binary, size long, content binary")


def write_tree(files: DataFrame, root: str) -> None:
    """Write (file_path, content) rows as files below a folder that all executors mount, from the tasks.

    A file appears whole or not at all, and a retried task writes the same bytes again. A task that is killed may leave one hidden ``.part`` file.
    """
    top = _mounted(files.sparkSession, root)
    if top is None:
        raise ValueError(f"not a folder that the executors mount: {root}")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = f".{uuid.uuid4().hex}.part"  # no other task's, for rows of equal path
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                full = os.path.join(top, path)
                part = os.path.join(os.path.dirname(full), mark)
                try:
                    f = open(part, "wb")
                except FileNotFoundError:
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    f = open(part, "wb")
                with f:
                    f.write(content)
                os.replace(part, full)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = files.select("file_path", F.col("content").cast("binary"))
    rows.mapInArrow(put, "n long").agg(F.sum("n")).write.format("noop").mode("overwrite").save()


REPORT = ("file_path string, language string, total_lines int, functions array<struct<name:string,line_start:int,line_end:int,cyclomatic:int>>, "
          "code_smells array<struct<name:string,severity:string,line_number:int,description:string>>, "
          "overall_complexity struct<cyclomatic_complexity:int,cognitive_complexity:int,lines_of_code:int,comment_lines:int,blank_lines:int>")


def report_rows(report: DataFrame, functions: DataFrame, smells: DataFrame) -> DataFrame:
    """Nested per-file report rows; lists are collected per file only."""
    key = ["project", "file_path"]
    fn = functions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        F.col("start_line").alias("line_start"), "name", F.col("end_line").alias("line_end"), "cyclomatic"))).alias("_f"))
    sm = smells.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line_number", "name", "severity", "description"))).alias("_s"))
    j = report.join(fn, key, "left").join(sm, key, "left")
    return j.select("project", "file_path", "language", "total_lines", F.coalesce("_f", F.array()).alias("functions"),
                    F.coalesce("_s", F.array()).alias("code_smells"), F.struct(
                        F.col("cyclomatic").alias("cyclomatic_complexity"), F.col("cognitive").alias("cognitive_complexity"), "lines_of_code",
                        "comment_lines", "blank_lines").alias("overall_complexity"))


def write_report_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, path: str, schema: str = REPORT, multi_line: bool = False) -> DataFrame:
    """JSON reports; unreadable records are skipped."""
    df = (spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", str(multi_line).lower())
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def history_append(rows: DataFrame, path: str) -> None:
    """Append to the history table. The id is derived from the row, so a repeated append is recognisable."""
    ident = F.sha2(F.concat_ws("|", "project_name", "analysis_type", F.col("timestamp").cast("string"), "result_json"), 256)
    out = rows.withColumn("id", F.coalesce("id", ident)) if "id" in rows.columns else rows.withColumn("id", ident)
    # Ranges over project and time: narrow min/max statistics per file, and a hot project spans many tasks.
    order = ["analysis_type", "project_name", "timestamp"]
    out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("analysis_type").parquet(path)
