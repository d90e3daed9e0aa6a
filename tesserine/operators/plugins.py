"""User analyses: a registry of DataFrame -> DataFrame functions and adapters for Python row code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import HOTSPOT_WORDS
from ..session import cut_lineage
from . import files as fl
from . import scan
from .tops import first_per

HOTSPOTS = 5  # files shown per project

Analysis = Callable[[DataFrame], DataFrame]
RESULT = "plugin string, success boolean, key string, value string, error string"


class Registry:
    """Named analyses over ``files``; each returns (key string, value string)."""

    def __init__(self) -> None:
        self._items: dict[str, Analysis] = {}

    def register(self, name: str, fn: Analysis) -> None:
        self._items[name] = fn

    def unregister(self, name: str) -> bool:
        return self._items.pop(name, None) is not None

    @property
    def names(self) -> list[str]:
        return list(self._items)

    def run(self, name: str, files: DataFrame) -> DataFrame:
        """Result rows, or one failed row: a bad plugin does not stop the others.

        The result is materialised here, since Spark meets most errors only when it runs.
        """
        spark = files.sparkSession
        if name not in self._items:
            return _failed(spark, name, f"plugin '{name}' not found")
        try:
            out = cut_lineage(self._items[name](files).select("key", "value"))
        except Exception as e:  # noqa: BLE001 - reported in the row
            return _failed(spark, name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        none = F.lit(None).cast("string")
        return out.select(F.lit(name).alias("plugin"), F.lit(True).alias("success"), "key", "value", none.alias("error"))

    def run_all(self, files: DataFrame, names: list[str] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.run(n, files) for n in (names or self.names)])


def _failed(spark: SparkSession, name: str, error: str) -> DataFrame:
    return spark.createDataFrame([(name, False, None, None, error)], RESULT)


def row_plugin(fn: Callable[[Iterator], Iterator], schema: str = "key string, value string") -> Analysis:
    """Adapter for code that maps batches of files (pandas frames) to batches of results."""
    return lambda files: files.mapInPandas(fn, schema)


def complexity_hotspot(files: DataFrame) -> DataFrame:
    hot = scan.hotspot_keywords(files, HOTSPOT_WORDS)
    total = hot.agg(F.lit("total_hotspots").alias("key"), F.count("*").cast("string").alias("value"))
    top = first_per(hot, "project", [F.col("estimated_complexity").desc(), "file_path"], HOTSPOTS)
    return total.unionByName(top.select(F.concat(F.lit("top:"), F.col("project"), F.lit(":"), F.col("file_path")).alias("key"), F.col("estimated_complexity").cast("string").alias("value")))


def file_stats(files: DataFrame) -> DataFrame:
    s = fl.file_stats_ext(files)
    total = s.where("extension IS NULL").unpivot([], ["files", "lines", "bytes"], "key", "value")
    per = s.where("extension IS NOT NULL").select(F.concat(F.lit("ext:"), F.col("extension")).alias("key"), F.col("files").alias("value"))
    return total.unionByName(per).select(F.concat(F.when(~F.col("key").startswith("ext:"), "total_").otherwise(""), F.col("key")).alias("key"),
                                         F.col("value").cast("string").alias("value"))


def default_registry() -> Registry:
    r = Registry()
    r.register("complexity_hotspot", complexity_hotspot)
    r.register("file_stats", file_stats)
    return r


class LanguageAnalyzers:
    """Analysers per language as Python UDTFs; the only path that leaves the JVM."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._names = spark, {}

    def register(self, language: str, udtf, batches: bool = False) -> None:
        """``batches``: an Arrow UDTF over record batches of project, file_path and content, which returns its rows with the first two. Others get one text at a time."""
        name = f"analyze_{language}"
        self._spark.udtf.register(name, udtf)
        self._names[language] = name, batches

    def run(self, files: DataFrame, language: str) -> DataFrame:
        """Rows of the analyser for each file of the language."""
        sub = files.where(fl.language("file_path") == language).select("project", "file_path", "content")
        name, batches = self._names[language]
        if batches:
            return self._spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {{files}}))", files=sub)
        return self._spark.sql(f"SELECT f.project, f.file_path, r.* FROM {{files}} f, LATERAL {name}(f.content) r", files=sub)
