"""Symbol table, search and references, and the merge of two analysis sources."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import scratch_path
from . import analysis, quality

_COLS = ["project", "file_path", "language", "name", "kind", "line_start", "line_end", "cyclomatic"]


def symbol_table(files: DataFrame) -> DataFrame:
    """Functions and classes of every known-language file, from one fold of each file."""
    found = tx.one_each(analysis.symbols(analysis.outlined(files)), F.col("symbols"), "s", "project", "file_path", "language")
    return found.select("project", "file_path", "language", "s.*")


def _holds(outer: Column, inner: Column) -> Column:
    """Whether a symbol's span holds another symbol. Symbols of one line hold nothing."""
    return (outer["line_start"] < inner["line_start"]) & (outer["line_end"] >= inner["line_end"])


def find_symbol(files: DataFrame, pattern: str, path_prefix: str | None = None, depth: int = 0, with_body: bool = False) -> DataFrame:
    """Symbols whose name fits a pattern, or whose path of names (``Class/method``) does if the pattern has a slash, and what they hold down to ``depth`` levels.

    One row per found symbol and each symbol below it: ``found_line`` is the first line of the one that fits, ``level`` is 0 for it. ``name_path`` has the names of the
    symbols around. Everything happens in the file's row; only files under the path are read.
    """
    if path_prefix:
        files = files.where(F.col("file_path").startswith(path_prefix))
    file = analysis.symbols(analysis.outlined(files))
    around = lambda s: F.filter("symbols", lambda o: _holds(o, s))
    named = F.transform("symbols", lambda s: s.withField("name_path", F.array_join(F.array_append(F.transform(around(s), lambda o: o["name"]), s["name"]), "/")))
    file = file.withColumn("named", named)
    fits = lambda s: s["name_path" if "/" in pattern else "name"].rlike(tx.regex(pattern))
    level = lambda top, s: F.size(F.filter("symbols", lambda o: _holds(o, s) & (o["line_start"] >= top["line_start"])))
    below = lambda top: F.filter(F.transform(F.filter("named", lambda s: _holds(top, s)), lambda s: F.struct(level(top, s).alias("level"), s.alias("s"))), lambda x: x["level"] <= depth)
    rows = F.transform(F.filter("named", fits), lambda top: F.transform(F.concat(F.array(F.struct(F.lit(0).alias("level"), top.alias("s"))), below(top) if depth else F.array()),
                                                                        lambda x: F.struct(top["line_start"].alias("found_line"), x["level"].alias("level"), x["s"].alias("s"))))
    out = tx.one_each(file, F.flatten(rows), "r", "project", "file_path", "language", F.col("lines") if with_body else F.lit(None).alias("lines"))
    out = out.select("project", "file_path", "language", "r.found_line", "r.level", "r.s.*", "lines")
    if with_body:
        body = F.transform(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), lambda x: x["line"])
        out = out.withColumn("body", F.array_join(body, "\n"))
    return out.drop("lines")


# ---- references ----------------------------------------------------------------

#: Parts of a token's files, so that a token of very many files is not in one bucket.
PARTS = 8
KINDS = ["file", "function", "class"]


_WORD = re.compile(r"\w+")


#: Bits of the filter of names, as a power of two. Where names fill it, more words are indexed than are asked for, and nothing else changes.
FILTER = 27


def name_filter(symbols: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the checksums of all symbol names and their projects."""
    place = F.shiftright(F.crc32(F.encode(F.concat_ws("\0", F.coalesce("project", F.lit("")), "name"), "UTF-8")), 32 - FILTER)
    bits = symbols.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 32))")).alias("bits")).toArrow()  # at most 2^(FILTER - 5) rows
    out = np.zeros(1 << FILTER - 5, np.uint32)
    out[bits["cell"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint32)
    return out


def _postings(content: str, symbols: list[dict], asked) -> dict[str, list[tuple[int, int]]]:
    """word -> (line, mark) of a file; see :func:`mentions` for marks."""
    lines = content.split("\n")
    around, own = [1] * (len(lines) + 1), {}
    for s in sorted(symbols, key=lambda s: (s["line_start"], -s["line_end"], s["kind"])):  # inner ones come last
        span = range(s["line_start"], min(s["line_end"], len(lines)) + 1)
        around[span.start:span.stop] = [1 + KINDS.index(s["kind"])] * len(span)
        own.setdefault(s["name"], set()).update(span)
    words = {word for word in set(_WORD.findall(content)) if asked(word)}
    found: dict[str, list[tuple[int, int]]] = {}
    for n, line in enumerate(lines, 1):
        for word in words.intersection(_WORD.findall(line)):
            mark = around[n]
            found.setdefault(word, []).append((n, -mark if word in own and n in own[word] else mark))
    return found


def mentions(files: DataFrame, names: np.ndarray | None = None) -> DataFrame:
    """(project, token, part, file_path, gaps, within): where each word of a file stands, or each that a filter of names lets through.

    Words are grouped within their file, so nothing is shuffled.

    ``gaps`` are the distances of the line numbers, from line 0 on; ``within`` says for each line what the innermost symbol around it is, as 1 + a place in ``KINDS``,
    negative inside a definition of the word itself. Lines are counted once for a word.
    """
    kind = pa.schema([("project", pa.string()), ("token", pa.string()), ("file_path", pa.string()), ("gaps", pa.list_(pa.int32())), ("within", pa.list_(pa.int8()))])

    shared = None if names is None else files.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None if shared is None else memoryview(shared.value)

        def asked(project: str):
            head = zlib.crc32(f"{project or ''}\0".encode())

            def named(word: str) -> bool:
                place = zlib.crc32(word.encode(), head) >> 32 - FILTER
                return cells[place >> 5] >> (place & 31) & 1

            return named if cells is not None else lambda word: True

        for batch in batches:
            for project, path, content, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _postings(content or "", symbols or [], asked(project))
                n, lines = len(found), [x[0] for p in found.values() for x in p]
                at = np.cumsum([0, *map(len, found.values())])
                gaps = np.diff(np.array([0, *lines]))
                gaps[at[:-1]] = np.array(lines)[at[:-1]] if n else 0
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, t)) for v, t in ((gaps, pa.int32()), ([x[1] for p in found.values() for x in p], pa.int8()))]
                yield pa.RecordBatch.from_arrays([pa.array([project] * n, pa.string()), pa.array(found, pa.string()), pa.array([path] * n, pa.string()), *lists], schema=kind)

    file = analysis.symbols(analysis.outlined(files)).select("project", "file_path", "content", "symbols")
    found = file.mapInArrow(run, "project string, token string, file_path string, gaps array<int>, within array<tinyint>")
    return found.withColumn("part", F.pmod(F.xxhash64("file_path"), F.lit(PARTS)).cast("int"))


def write_index(files: DataFrame, name: str, path: str, symbols: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """The mentions as a table of that name at a path, in buckets of (project, token, part); with ``symbols``, those of their names only.

    Nothing is shuffled: each task writes its rows into their buckets.
    """
    spark = files.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = mentions(files, None if symbols is None else name_filter(symbols))
    found.write.bucketBy(buckets, "project", "token", "part").sortBy("project", "token", "part").option("path", path).saveAsTable(name)
    return spark.table(name)


def scratch_index(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """An index for this session, in the shared folder."""
    path = scratch_path(files.sparkSession, "index")
    return write_index(files, path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_"), path, symbols)


def symbol_references(index: DataFrame, symbols: DataFrame, include_kinds: list[str] | None = None, exclude_kinds: list[str] | None = None, name: str | None = None,
                      path_prefix: str | None = None) -> DataFrame:
    """Lines that mention a symbol of their project outside a definition of it in that file, with the kind of the innermost symbol around the line (or ``file``).

    The symbols looked up may be limited by name and by the path of the files that define them, the mentions by the kind around them. The index is not shuffled: it is
    joined bucket by bucket with the names.
    """
    if name:
        symbols = symbols.where(F.col("name") == name)
    if path_prefix:
        symbols = symbols.where(F.col("file_path").startswith(path_prefix))
    names = symbols.select("project", F.col("name").alias("token")).distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    hit = index.join(names, ["project", "token", "part"], "left_semi")
    lines = F.transform("within", lambda k, i: F.struct(F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0), lambda a, g: a + g).alias("line_number"), k.alias("k")))
    outside = hit.select("project", "file_path", F.col("token").alias("name"), F.explode(F.filter(lines, lambda x: x["k"] > 0)).alias("x"))
    out = outside.select("project", "file_path", "x.line_number", "name", F.element_at(F.array(*map(F.lit, KINDS)), F.col("x.k").cast("int")).alias("kind"))
    if include_kinds:
        out = out.where(F.col("kind").isin(include_kinds))
    return out.where(~F.col("kind").isin(exclude_kinds)) if exclude_kinds else out


def symbols_overview(symbols: DataFrame) -> DataFrame:
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("line_start", "name"))))
    names = lambda k: F.transform(pick(k), lambda s: s["name"])
    return symbols.groupBy("project", "file_path", "language").agg(names("class").alias("classes"), names("function").alias("functions"))


def language_totals(symbols: DataFrame) -> DataFrame:
    """Per language, over files that have symbols."""
    per = symbols.groupBy("language", "project", "file_path").agg(F.count_if(F.col("kind") == "class").alias("c"), F.count_if(F.col("kind") == "function").alias("f"))
    return per.groupBy("language").agg(F.count("*").alias("files"), F.sum("c").alias("classes"), F.sum("f").alias("functions"))


def unified_merge(symbols: DataFrame, semantic: DataFrame, smells: DataFrame) -> DataFrame:
    """Each symbol, with its quality, and the first semantic symbol of the same file, name and lower-cased kind."""
    return with_semantic(quality.symbol_quality(symbols, smells), semantic)


def with_semantic(symbols: DataFrame, semantic: DataFrame) -> DataFrame:
    key = ["project", "file_path", "name", "kind"]
    first = semantic.withColumn("kind", F.lower("kind")).groupBy(*key).agg(F.min("line").alias("semantic_line"))
    return symbols.join(first, key, "left")


def unified_summary(report: DataFrame, unified: DataFrame) -> DataFrame:
    """Per project; mean quality is 100 where there are no symbols."""
    langs = report.groupBy("project", "language").agg(F.count("*").alias("n"), F.sum("cyclomatic").alias("cc"), F.sum("smells").alias("s"))
    p = langs.groupBy("project").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("language", F.lit("="), F.col("n").cast("string")))), ",").alias("language_stats"),
        F.sum("cc").alias("total_complexity"), F.sum("s").alias("total_code_smells"))
    q = unified.groupBy("project").agg(F.avg("quality_score").alias("q"))
    return p.join(q, "project", "left").select("project", "language_stats", "total_complexity", "total_code_smells",
                                               F.round(F.coalesce("q", F.lit(100.0)), 6).alias("quality_score"))


def plain_functions(functions: DataFrame) -> DataFrame:
    """Functions that are not methods of a class in their file."""
    return functions.where(F.coalesce("parent_kind", F.lit("")) != "class")
