"""File-level operators: exploding, classifying, selecting and counting files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import EXCLUDED_DIRS, LANGUAGE_MAPS
from .tops import first_per


def explode_lines(files: DataFrame) -> DataFrame:
    keep = [c for c in files.columns if c != "content"]
    out = files.select(*keep, F.posexplode(F.split("content", "\n", -1)).alias("_p", "line"))
    return out.select(*keep, (F.col("_p") + 1).alias("line_number"), "line")


def language(path, map_name: str = "analyzer", fold_case: bool = True) -> Column:
    """Language of a path, null when unknown. The map is a small literal."""
    ext = tx.extension(path)
    ext = F.lower(ext) if fold_case else ext
    pairs = [F.lit(x) for kv in LANGUAGE_MAPS[map_name].items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), ext)


def detect_language(files: DataFrame, map_name: str = "analyzer") -> DataFrame:
    return files.withColumn("language", language("file_path", map_name))


def exclude_dirs(files: DataFrame, names: list[str] = EXCLUDED_DIRS) -> DataFrame:
    return files.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(*[F.lit(n) for n in names])))


def cap_files(files: DataFrame, n: int) -> DataFrame:
    """The first n files of each project."""
    return first_per(files, "project", ["file_path"], n)


def find_file_glob(files: DataFrame, mask: str) -> DataFrame:
    """A mask without '/' is matched against the file name."""
    subject = F.col("file_path") if "/" in mask else tx.base_name("file_path")
    return files.where(subject.rlike(tx.glob_regex(mask)))


def config_files(files: DataFrame) -> DataFrame:
    return files.where(tx.base_name("file_path").contains("config"))


def dir_stats(files: DataFrame) -> DataFrame:
    d = tx.parent_dir("file_path")
    return files.groupBy(F.when(d == "", ".").otherwise(d).alias("directory")).agg(F.count("*").alias("file_count"))


def module_role(files: DataFrame) -> DataFrame:
    low = F.lower("file_path")
    role = (F.when(low.contains("test"), "test").when(low.contains("example"), "example")
            .when(low.startswith("src/"), "core")
            .when(~F.col("file_path").contains("/") & low.startswith("analyze_"), "main").otherwise("general"))
    return files.withColumn("role", role)


def file_stats_ext(files: DataFrame) -> DataFrame:
    """Per extension plus a total row (extension null)."""
    ext = tx.extension("file_path")
    return (files.select(F.when(ext == "", "(no ext)").otherwise(ext).alias("extension"),
                         tx.line_count("content").alias("n"), F.octet_length("content").alias("b"))
            .rollup("extension")
            .agg(F.count("*").alias("files"), F.sum("n").alias("lines"), F.sum("b").alias("bytes")))


def language_stats(files: DataFrame, map_name: str = "display") -> DataFrame:
    """Files, lines and share per language; the total row has language null.

    Lines are counted as a file iterator would: a trailing line break opens no new line.
    """
    lines = tx.line_count("content") - F.when(F.col("content").endswith("\n") | (F.col("content") == ""), 1).otherwise(0)
    per = (files.select(language("file_path", map_name).alias("language"), lines.alias("n"))
           .where(F.col("language").isNotNull())
           .rollup("language").agg(F.count("*").alias("files"), F.sum("n").alias("lines")))
    total = F.max("files").over(W.partitionBy())  # one row per language by now
    return per.withColumn("share_pct", tx.round_even(F.col("files") / total * 100, 1))


SAMPLE_RATES = ((0, 1.0), (5_000, 0.2), (20_001, 0.05))  # from so many files of a project, this share of them


def sample_files(files: DataFrame, key: str = "project", seed: int = 7, rates: tuple[tuple[int, float], ...] = SAMPLE_RATES) -> DataFrame:
    """Deterministic sample per project, at a rate that depends on its number of files; one rate is ``((0, 0.1),)``.

    Rank by hash is found with a histogram of hash prefixes first, so that no project is
    sorted in one task: whole prefix buckets below the cut pass, only the bucket that holds
    the cut is ranked.
    """
    h = F.sha2(F.concat(F.col("file_path"), F.lit(f":{seed}")), 256)
    hashed = files.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 4))
    hist = hashed.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    by_key = W.partitionBy(key)
    before = F.sum("_n").over(by_key.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("_n").over(by_key)
    rate = F.lit(rates[0][1])
    for least, share in rates[1:]:
        rate = F.when(total >= least, share).otherwise(rate)
    hist = hist.select(key, "_b", F.col("_n"), F.coalesce(before, F.lit(0)).alias("_before"),
                       F.greatest(F.lit(1), F.floor(total * rate)).alias("_k"))
    j = hashed.join(hist, [key, "_b"])
    whole = j.where(F.col("_before") + F.col("_n") <= F.col("_k"))
    cut = j.where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_n") > F.col("_k")))
    rn = F.row_number().over(W.partitionBy(key, "_b").orderBy("_h", "file_path"))
    cut = cut.withColumn("_r", rn).where(F.col("_r") <= F.col("_k") - F.col("_before")).drop("_r")
    return whole.unionByName(cut).select(*files.columns)
