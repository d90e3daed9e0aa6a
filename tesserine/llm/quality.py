"""Quality rules with thresholds that follow the data, in DataFrame functions only.

Per text come counts of words, symbols, repeated lines and words of repeated windows. Fixed base rules reject what no source should hold. The other cutoffs are
learned: for each language and source, and each measure, a quantile sketch is kept as counts of logarithmic buckets. Such sketches merge by adding counts, so they
are built with map-side combination whatever the size of a source, and those of small sources merge into the sketch of their language, and further into that of
everything. A measure fails beyond its fence: the median plus ``REACH`` times the distance between the lower quartile and the median, which half of a source
may be junk without moving, with a least distance per measure.

Defined cases: a null or empty text has no words and fails the base; a null language or source counts as the empty string; repeated rows are judged and
counted each; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.llm.tables import kept, need

#: Words of a window, and the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
#: Documents from which a source, or else a language, has sketches of its own.
OWN_SKETCH = 100
#: Buckets for each factor e of a measure.
STEPS = 16
REACH = 4
#: Measures per 1000 words, lines or characters, and the least distance counted.
MEASURES = {"symbols": 50, "dup_lines": 100, "repeats": 75, "capitals": 100}
SPACE = "[ \\t-\\r]+"


def counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and lines and capitals, of each whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = ("n_lines", "n_dup_lines", "n_symbols", "n_capitals")
    df = docs.select(*keep, text.alias("t"))
    df = df.select(*keep, F.array_remove(F.split("t", SPACE), "").alias("w"), F.expr("filter(split(t, '\\n', -1), l -> l rlike '[^ \\\\t-\\\\r]')").alias("lines"),
                   F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                   F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_capitals"))
    df = df.select(*keep, "n_symbols", "n_capitals", F.size("lines").cast("long").alias("n_lines"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                   F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.transform("w", lambda w: F.xxhash64(w)).alias("h1"))
    # hashes of 2, 4 and 8 words; only a text that repeats 4 words in a row can repeat 8
    keep = (*keep, *counted, "n_words", "word_chars")
    df = df.select(*keep, "h1", F.transform("h1", lambda h, i: F.xxhash64(h, F.get("h1", i + 1))).alias("h2"))
    df = df.select(*keep, F.transform("h2", lambda h, i: F.xxhash64(h, F.get("h2", i + 2))).alias("h4"))
    df = df.select(*keep, F.when((F.col("n_words") > WINDOW) & (F.size(F.array_distinct("h4")) < F.size("h4")), F.col("h4")).alias("h4"))
    df = df.select(*keep, F.expr(f"slice(transform(h4, (h, i) -> xxhash64(h, get(h4, i + 4))), 1, greatest(int(n_words) - {WINDOW - 1}, 0))").alias("h8"))
    df = df.select(*keep, F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    df = df.select(*keep, F.expr("array_sort(transform(filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) OR coalesce(x.h = get(s, i + 1).h, false)), x -> x.i))").alias("at"))
    covered = F.expr(f"aggregate(at, struct(0L AS n, -{WINDOW} AS last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last), a -> a.n)")
    return df.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def per_thousand(part: str, whole: str) -> Column:
    return F.expr(f"1000 * {part} div greatest({whole}, 1)")


def bucket(value: Column) -> Column:
    return F.floor(STEPS * F.log1p(value)).cast("int")


def sketches(rows: DataFrame) -> DataFrame:
    """Counts of buckets by (lang, source, measure): the mergeable form. ``rows`` has lang, source and the measures."""
    measured = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    return rows.select("lang", "source", measured.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, measure, total, fence) for sources, for languages (source null) and for all (lang null too)."""
    merged = None
    for keys in (("lang", "source"), ("lang",), ()):
        part = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        part = part.select(*[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("lang", "source")], F.lit(len(keys)).alias("level"), "measure", "bucket", "n")
        merged = part if merged is None else merged.unionAll(part)
    group = W.partitionBy("level", "lang", "source", "measure")  # as many rows as buckets
    ranked = merged.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
    at = ranked.groupBy("level", "lang", "source", "measure", "total").agg(
        *[F.min(F.when(F.expr(f"100 * upto >= {q} * total"), F.col("bucket"))).alias(f"q{q}") for q in (25, 50)])
    value = lambda b: F.round(F.exp((F.col(b) + 1) / F.lit(float(STEPS))) - 1).cast("long")
    least = F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair])
    return at.select("level", "lang", "source", "measure", "total", (value("q50") + REACH * F.greatest(value("q50") - value("q25"), F.element_at(least, F.col("measure")))).alias("fence"))


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``within``: no measure of the row lies beyond the fence of its source, or where that is small, of its language, or of everything."""
    limits = limits.where((F.col("level") == 0) | (F.col("total") >= OWN_SKETCH))
    wide = limits.groupBy("level", "lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", "fence"))).alias("fences"))  # as many as measures
    part = lambda n: wide.where(F.col("level") == n).withColumnRenamed("fences", f"_f{n}").drop("level")
    rows = rows.join(part(2), ["lang", "source"], "left").join(part(1).drop("source"), ["lang"], "left").crossJoin(F.broadcast(part(0).drop("lang", "source")))  # one row, or none for no documents
    mine = F.coalesce("_f2", "_f1", "_f0")
    within = F.lit(True)
    for m in MEASURES:
        within = within & (F.col(m) <= F.element_at(mine, m))
    return rows.withColumn("within", within).drop("_f0", "_f1", "_f2")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, the base counts, base_failed, kept) of every whole text."""
    rows = need(docs, id_col, text_col, lang_col, source_col).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))])
    rows = counts(rows, keep=("doc_id", "lang", "source"))
    shares = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars")}
    rows = kept(rows.withColumns({m: per_thousand(*p) for m, p in shares.items()}), "quality")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return judge(rows, fences(sketches(rows))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                                                      (~failed & F.col("within")).alias("kept"))
