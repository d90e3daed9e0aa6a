"""Blocks, exact copies and similar pairs.

Copies are reported as stars, not as pairs: each member points to its group's first
block and the group row carries the pair count n(n-1)/2. Nothing is lost and a group
of a billion copies stays linear. Similar pairs are sought between distinct contents
only, with prefix filtering, so a shingle shared by everything is not a join key
unless a block has nothing rarer. Contents are told apart by 64-bit hashes, as shingles are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edits
from ..functions import text as tx
from ..session import shuffles_dropped, stored
from . import files as fl
from . import setjoin, skew
from .tops import first_per

WIDTH = 3  # tokens per shingle
CROWD = 64  # contents of a bucket that are tried pair by pair for company


def _block_id(start: Column) -> Column:
    """Unique over projects: (project, file_path, start_line)."""
    return F.concat_ws(":", "project", "file_path", start.cast("string"))


def blocks_sliding(files: DataFrame, min_lines: int = 6) -> DataFrame:
    step = max(1, min_lines // 2)
    base = files.select("project", "file_path", F.split("content", "\n", -1).alias("_l"))
    starts = F.when(F.size("_l") >= min_lines, F.sequence(F.lit(0), F.size("_l") - min_lines, F.lit(step)))
    cut = base.select("project", "file_path", "_l", F.explode(starts).alias("_i"))
    out = cut.select(
        "project", _block_id(F.col("_i") + 1).alias("block_id"), "file_path", (F.col("_i") + 1).alias("start_line"),
        (F.col("_i") + min_lines).alias("end_line"), F.array_join(F.slice("_l", F.col("_i") + 1, min_lines), "\n").alias("content"),
        F.coalesce(fl.language("file_path", "dependency", fold_case=False), F.lit("unknown")).alias("language"))
    return out.where(tx.strip("content") != "")


def blocks_segmented(files: DataFrame, at_least: int = 5) -> DataFrame:
    """Cut after a def/class line or the end of file once ``at_least`` lines have gathered; 0-based start."""
    base = files.select("project", "file_path", F.split("content", "\n", -1).alias("_l"))
    span = "array<struct<start_line:int,end_line:int>>"
    init = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(span).alias("out"))

    def step(a, x):
        length = a["i"] - a["at"] + 1
        body = tx.strip(x)
        cut = (length >= at_least) & (body.startswith("def ") | body.startswith("class ") | (a["i"] == F.size(F.col("_l")) - 1))
        grown = F.concat(a["out"], F.array(F.struct(a["at"].alias("start_line"), a["i"].alias("end_line"))))
        return F.struct(F.when(cut, a["i"] + 1).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"),
                        F.when(cut & (length > at_least), grown).otherwise(a["out"]).cast(span).alias("out"))

    cut = base.select("project", "file_path", "_l", F.explode(F.aggregate("_l", init, step, lambda a: a["out"])).alias("b"))
    s, e = F.col("b.start_line"), F.col("b.end_line")
    return cut.select("project", _block_id(s).alias("block_id"), "file_path", s.alias("start_line"),
                      e.alias("end_line"), F.array_join(F.slice("_l", s + 1, e - s + 1), "\n").alias("content"))


def line_count() -> Column:
    return F.col("end_line") - F.col("start_line") + 1


def block_filter_min(blocks: DataFrame, min_block_size: int = 5) -> DataFrame:
    return blocks.where(line_count() >= min_block_size)


def normalize(content) -> Column:
    """Drop comments from the first '#', trim lines, drop empty ones."""
    cut = F.transform(F.split(content, "\n", -1), lambda l: tx.strip(F.substring_index(l, "#", 1)))
    return F.array_join(F.filter(cut, lambda l: l != ""), "\n")


def _groups(blocks: DataFrame) -> DataFrame:
    hashed = blocks.select(F.sha2("content", 256).alias("hash"), line_count().cast("long").alias("lines"))
    groups = hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.sum("lines").alias("lines"))
    return groups.withColumn("pairs", (F.col("copies") * (F.col("copies") - 1) / 2).cast("long"))


def _project(blocks: DataFrame) -> Column:
    """The project of a block, if blocks say it."""
    return (F.col("project") if "project" in blocks.columns else F.lit(None).cast("string")).alias("project")


def duplicates_exact(blocks: DataFrame) -> DataFrame:
    """Every block that has copies, with its group's first block and that one's project, size and pair count."""
    hashed = blocks.select("block_id", _project(blocks), F.sha2("content", 256).alias("hash"))
    many = hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.min(F.struct("block_id", "project")).alias("f")).where(F.col("copies") > 1)
    many, hashed = many.select("hash", "copies", F.col("f.block_id").alias("first_id"), F.col("f.project").alias("first_project")), hashed.drop("project")
    pairs = (F.col("copies") * (F.col("copies") - 1) / 2).cast("long")
    return skew.join_groups(hashed, many, "hash", "block_id", "copies").select("hash", "block_id", "first_id", "first_project", "copies", pairs.alias("pairs"))


def duplication_ratio(blocks: DataFrame) -> DataFrame:
    """Lines summed over duplicate pairs / all lines (may pass 1), and the share of lines that are redundant copies."""
    g = _groups(blocks)
    return g.agg(F.sum("copies").alias("blocks"), F.sum("pairs").alias("duplicate_pairs"),
                 # each block of a group of n occurs in n-1 pairs
                 F.round(F.sum((F.col("copies") - 1) * F.col("lines")) / F.sum("lines"), 6).alias("duplication_ratio"),
                 F.round(F.sum(F.col("lines") - F.col("lines") / F.col("copies")) / F.sum("lines"), 6).alias("redundant_ratio"))


def shingles(norm: Column) -> Column:
    """Distinct token triples as 64-bit hashes; a shorter text is one shingle."""
    words = F.regexp_extract_all(norm, F.lit(tx.WORD), F.lit(0))

    def cut(w):
        n = F.size(w)
        triples = F.transform(F.sequence(F.lit(1), n - (WIDTH - 1)), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WIDTH)]))
        short = F.when(n > 0, F.array(F.xxhash64(F.array_join(w, " "))))
        return F.array_distinct(F.when(n >= WIDTH, triples).otherwise(F.coalesce(short, F.array().cast("array<bigint>"))))

    return tx.let(words, cut)


def distinct_contents(blocks: DataFrame) -> DataFrame:
    """One row per normalised content: key, first block, copies, shingle hashes. Copies combine map-side."""
    b = blocks.select("block_id", _project(blocks), normalize("content").alias("norm"))
    g = b.groupBy(F.sha2("norm", 256).alias("hash")).agg(F.min(F.struct("block_id", "project")).alias("f"), F.count("*").alias("copies"),
                                                         F.any_value("norm").alias("norm"))
    return g.select(F.xxhash64("hash").alias("key"), "f.block_id", "f.project", "copies", shingles(F.col("norm")).alias("shingles")).where(F.size("shingles") > 0)


def _contents(blocks: DataFrame | None, contents: DataFrame | None) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """One narrow row per normalised content (key, first block, copies); rows of key and text, made again from the blocks with each use, where copies may
    repeat; and what makes rows of key and shingles of these. ``contents`` stand in for the blocks if given.
    """
    if contents is not None:
        return contents.select("key", "block_id", "project", "copies"), contents.select("key", "shingles"), lambda d: d
    b = blocks.select("block_id", _project(blocks), normalize("content").alias("norm")).where(F.col("norm").rlike(tx.WORD))
    b = b.withColumn("hash", F.sha2("norm", 256)).withColumn("key", F.xxhash64("hash"))
    g = b.groupBy("hash").agg(F.min(F.struct("block_id", "project")).alias("f"), F.count("*").alias("copies"))
    with shuffles_dropped(blocks.sparkSession):
        heads = stored(g.select(F.xxhash64("hash").alias("key"), "f.block_id", "f.project", "copies"), "contents")
    return heads, b.select("key", "norm"), lambda d: d.withColumn("shingles", shingles(F.col("norm"))).drop("norm")


def _copies(contents: DataFrame) -> DataFrame:
    return contents.where(F.col("copies") > 1).select(
        F.col("block_id").alias("block_id1"), F.col("block_id").alias("block_id2"), F.col("copies").alias("copies1"),
        F.col("copies").alias("copies2"), F.lit(1.0).alias("similarity"),
        (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("pairs"), "project")


def _near(links: DataFrame, summary: DataFrame, threshold: float) -> DataFrame:
    """Pairs that no bound rules out, as members of cells (``setjoin.near``). Stored step by step, so that the shuffle files of a step end with it."""
    with shuffles_dropped(links.sparkSession):
        links = stored(links, "links")
        return stored(setjoin.near(links, setjoin.sizes_and_parities(summary), threshold), "near")


def _verify(members: DataFrame, contents: tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]], threshold: float, bands: int = 0, rows: int = 0) -> DataFrame:
    """Pairs with the Jaccard of full sets at the threshold or above, the block that comes first in front. Of the texts only those of members travel."""
    heads, texts, cut = contents
    body = next(c for c in texts.columns if c != "key")
    once = setjoin.among(texts, members).groupBy("key").agg(F.any_value(body).alias(body))
    full = members.join(once, "key").join(heads, "key").repartition(*setjoin.CELL).sortWithinPartitions(*setjoin.CELL)
    found = setjoin.verified(cut(full), threshold, bands, rows)
    return found.select("block_id1", "block_id2", "copies1", "copies2", F.round("jaccard", 6).alias("similarity"), (F.col("copies1") * F.col("copies2")).alias("pairs"),
                        F.col("project1").alias("project"))


def similar_pairs(blocks: DataFrame, threshold: float = 0.7, contents: DataFrame | None = None) -> DataFrame:
    """Exact: all pairs of contents with Jaccard >= threshold over token triples.

    Two sets that similar share an element among their first |x| - ceil(t|x|) + 1 in any order, so only those are join keys,
    rare ones first (``setjoin``); what is left is verified on full sets. A row with block_id1 = block_id2 stands for the copies of one content. ``project`` is that of block_id1.
    """
    heads, texts, cut = made = _contents(blocks, contents)
    summary = stored(setjoin.summaries(cut(texts)), "summary")
    links = setjoin.set_pairs(cut(texts), threshold, setjoin.counted(summary))
    return _verify(_near(links, summary, threshold), made, threshold).unionByName(_copies(heads))


def similar_pairs_lsh(blocks: DataFrame, threshold: float = 0.7, bands: int = 20, rows: int = 3, contents: DataFrame | None = None) -> DataFrame:
    """MinHash bands over distinct contents; candidates are verified with the exact Jaccard.

    Contents of a bucket are linked to a home instead of being paired, and the pairs there that no bound rules out are asked for a bucket in common
    when their full sets meet, so that the pairs of a large bucket that cannot reach the threshold are not made; no pair that reaches it is lost by that.
    """
    heads, texts, cut = made = _contents(blocks, contents)
    summary = stored(setjoin.summaries(cut(texts), bands, rows), "summary")
    links = setjoin.bucket_pairs(summary, bands, threshold, CROWD)
    return _verify(_near(links, summary, threshold), made, threshold, bands, rows).unionByName(_copies(heads))


def distinct_words(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(tx.WORD), F.lit(0)))


def pair_similarity(a, b, words_a: Column | None = None, words_b: Column | None = None) -> tuple[Column, Column]:
    """(Jaccard over words, 1 - edit distance / longer length) of two text columns; their distinct words can be given."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    sets = F.struct((distinct_words(a) if words_a is None else words_a).alias("a"), (distinct_words(b) if words_b is None else words_b).alias("b"))
    both = lambda s: F.size(F.array_intersect(s["a"], s["b"]))
    jaccard = lambda s: F.when(F.size(s["a"]) + F.size(s["b"]) == 0, 1.0).otherwise(
        F.round(both(s) / (F.size(s["a"]) + F.size(s["b"]) - both(s)), 6))
    longer = F.greatest(F.length(a), F.length(b))
    distance = F.arrow_udf(edits.edit_distance, "int")
    return (tx.let(sets, jaccard),
            F.when(longer == 0, 1.0).otherwise(F.round(1 - distance(a, b) / longer, 6)))


def pair_classify(pairs: DataFrame) -> DataFrame:
    s = F.col("similarity")
    return pairs.withColumn("is_duplicate", s >= 0.95).withColumn("is_similar", s >= 0.7)


def clone_summary(blocks: DataFrame, first: int, threshold: float = 0.7) -> DataFrame:
    """Counts, then the first copies and similar pairs (most similar first) of each project, that of the pair's first block."""
    g = _groups(blocks)
    sim = similar_pairs(blocks, threshold)
    with shuffles_dropped(blocks.sparkSession):
        sim = stored(sim, "similar")
    cols = ["kind", "block_id1", "block_id2", "similarity", "pairs"]
    none = F.lit(None).cast("string")
    count = lambda df, kind, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).alias("pairs")).select(
        F.lit(kind).alias("kind"), none.alias("block_id1"), none.alias("block_id2"), F.lit(None).cast("double").alias("similarity"), "pairs")
    dup = (duplicates_exact(blocks).where(F.col("block_id") != F.col("first_id"))
           .transform(lambda d: first_per(d, "first_project", ["first_id", "block_id"], first))
           .select(F.lit("duplicate").alias("kind"), F.col("first_id").alias("block_id1"), F.col("block_id").alias("block_id2"),
                   F.lit(1.0).alias("similarity"), F.lit(1).cast("long").alias("pairs")))
    top = (first_per(sim, "project", [F.col("similarity").desc(), "block_id1", "block_id2"], first)
           .select(F.lit("similar").alias("kind"), "block_id1", "block_id2", "similarity", "pairs"))
    return (count(g, "total_blocks", "copies").unionByName(count(g, "duplicate_pairs", "pairs")).unionByName(count(sim, "similar_pairs", "pairs"))
            .unionByName(dup).unionByName(top).select(*cols))
