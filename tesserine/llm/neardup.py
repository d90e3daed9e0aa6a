"""Near-duplicate documents over word shingles, by SetSketch registers.

1. Every whole text becomes a SetSketch of its distinct shingles. Texts with the same words are one text, represented by the smallest id.
2. Registers are cut into bands; texts that agree on a band share a bucket. With 48 bands of 6 registers a pair of similarity 0.8 shares none with probability
   5e-7. Each bucket links its members to one pivot only, its smallest id, which is a sum.
3. Both counts of register comparisons go into a joint likelihood; pairs that may reach the threshold (a true one is dropped with probability 3e-5) are verified on
   the full sets.
4. What the pivots left open is closed: in buckets whose members are still in several components, all pairs of different components are estimated in blocks of
   ``BLOCK`` members, each pair in its first common band. First the likeliest that would connect each bucket's components are verified, at most one per member. Then,
   between the components that are left, all likely ones are verified within their block, on the full sets of its members, until it is connected as far as it can
   be. So no link is lost, and a block gives at most a link for each member, whatever the number of its pairs.

Defined cases: documents without text or words have an empty set and are linked with nothing; fewer words than a shingle count as one shingle; equal texts are linked; rows
of one id are one document (where their texts differ, one of them is compared and copies of all count), and rows without an id are kept and linked with nothing; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.components import components
from tesserine.llm.setsketch import likely, minima, registers
from tesserine.llm.tables import kept, need
from tesserine.llm.words import blocks, mix, sequence_hash

BANDS, ROWS = 48, 6
COUNT = BANDS * ROWS
#: Members of a bucket that are compared in one block.
BLOCK = 2048
#: Shingles of the members that are compared in one block.
SETS = 1 << 22
#: Natural logarithm of how much less likely a pair may be at the threshold than at its best estimate.
DOUBT = 8.0


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, k1, k2, n, regs): two hashes of the word sequence, the size of the shingle set, and the registers (null for an empty set)."""
    schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                hashes = block.hashes(lower=True)
                elements, at = block.shingles(hashes, shingle)
                regs = registers(minima(elements, at, COUNT))
                n, k1, k2 = (np.zeros(block.n, np.int64) for _ in range(3))
                for i in np.flatnonzero(np.diff(at)):
                    n[i] = len(np.unique(elements[at[i]:at[i + 1]]))
                    words = hashes[block.words[i]:block.words[i + 1]]
                    k1[i], k2[i] = sequence_hash(words).astype(np.int64), sequence_hash(words ^ np.uint64(0x5851F42D4C957F2D)).astype(np.int64)
                raw = [r.tobytes() if m else None for r, m in zip(regs, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), *map(pa.array, (k1, k2, n)), pa.array(raw, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "id bigint, k1 bigint, k2 bigint, n bigint, regs binary")


def band_rows(texts: DataFrame) -> DataFrame:
    """(band, id): a 64-bit key of each band, whose lowest six bits are its number."""
    number = np.arange(BANDS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = number[None, :] + np.uint64(1)
            for k in range(ROWS):
                key = mix(key * np.uint64(0xD1342543DE82EF95) + regs[:, :, k])
            key = key & ~np.uint64(63) | number
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], names=["band", "id"])

    return texts.select("id", "regs").mapInArrow(run, "band bigint, id bigint")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COUNT)


def estimated(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose registers allow the threshold."""
    side = lambda s: texts.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = _matrix(batch.column("regs_a")), _matrix(batch.column("regs_b"))
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            ok = likely((ra > rb).sum(1), (ra < rb).sum(1), COUNT, na, nb, threshold, DOUBT) if len(na) else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets have 100 * intersection >= percent * union. ``docs`` is (id, text)."""

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for block in blocks(column):
            elements, at = block.shingles(block.hashes(lower=True), shingle)
            for i in range(block.n):
                yield np.unique(elements[at[i]:at[i + 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(sets(batch.column("text_a")), sets(batch.column("text_b")), strict=True):
                common = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ids = kept(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "open")
    open_texts = docs.join(ids, "id", "left_semi").dropDuplicates(["id"])
    side = lambda s: open_texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def dealt(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members of buckets that are still in several components, dealt into blocks (band, i, j) so that any two of a bucket meet once; ``members`` is
    (band, low, id, component), the pivot low being done. A block has at most some 2 * BLOCK members and 2 * SETS shingles."""
    mixed = members.groupBy("band").agg(F.min("component").alias("_c"), F.max("component").alias("_d")).where("_c <> _d").select("band")
    rows = kept(members.join(mixed, "band", "left_semi").join(texts.select("id", F.col("n").alias("size")), "id"), "mixed")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / SETS)).cast("int")
    rows = rows.join(rows.groupBy("band").agg(parts.alias("_p")), "band").withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_p")).cast("int"))
    # each member meets every block: once where a bucket is one block
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).select(
        "band", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), F.col("_i").alias("own"), "low", "id", "component", "size")
    return rows.join(texts.select("id", "regs"), "id")


def by_block(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` over the rows of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("band", "i", "j")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if held and any(held[-1].column(c)[-1].as_py() != k[0] for c, k in zip(("band", "i", "j"), keys, strict=True)):
                yield work(pa.Table.from_batches(held))
                held = []
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                held.append(batch.slice(begin, end - begin))
                if end < batch.num_rows:
                    yield work(pa.Table.from_batches(held))
                    held = []
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "id").mapInArrow(run, schema)


def open_pairs(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The likely pairs of a block, both places and the number of equal registers, and a number of each member's component."""
    # equal registers are binomial with at least the threshold: below six standard deviations the likelihood need not be asked
    least = COUNT * threshold - 6 * (COUNT * threshold * (1 - threshold)) ** 0.5
    ids, comp, own, size = (group.column(c).to_numpy() for c in ("id", "component", "own", "size"))
    band, i, j, low = (group.column(c)[0].as_py() for c in ("band", "i", "j", "low"))
    regs = _matrix(group.column("regs").combine_chunks())
    # within the largest component nothing is open: members outside of it meet everything of other components
    numbers = np.unique(comp, return_inverse=True)[1]
    outside = numbers != np.bincount(numbers).argmax()
    a, b, alike = [], [], []
    for x in np.flatnonzero(outside & (ids != low)):
        y = np.flatnonzero((comp != comp[x]) & (~outside | (ids > ids[x])) & (ids != low) & ((own != own[x]) | (i == j)))
        equal = regs[y] == regs[x]
        y, equal = y[near := equal.sum(1) >= least], equal[near]
        first = equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == (band & 63)  # the pair's first common band
        y, equal = y[first], equal[first]
        ok = likely((regs[x] > regs[y]).sum(1), (regs[x] < regs[y]).sum(1), COUNT, np.full(len(y), float(size[x])), size[y].astype(float), threshold, DOUBT) if len(y) else np.zeros(0, bool)
        y, equal = y[ok], equal[ok]
        a.append(np.full(len(y), x))
        b.append(y)
        alike.append(equal.sum(1))
    a, b, alike = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (a, b, alike))
    return a, b, alike, numbers


def forest(group: pa.Table, threshold: float, similar: Callable[[int, int], bool]) -> pa.RecordBatch:
    """(a, b): a spanning forest of a block's components over its likely pairs, the likeliest first, that are ``similar``. Pairs within what is joined are not asked."""
    a, b, alike, numbers = open_pairs(group, threshold)
    ids, root, links = group.column("id").to_numpy(), list(range(int(numbers.max()) + 1)), []
    for k in np.argsort(-alike, kind="stable"):
        ends = []
        for c in (numbers[a[k]], numbers[b[k]]):
            while root[c] != c:
                root[c] = c = root[root[c]]
            ends.append(c)
        if ends[0] != ends[1] and similar(a[k], b[k]):
            root[ends[0]] = ends[1]
            links.append(k)
    a, b = ids[a[links]], ids[b[links]]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (np.minimum(a, b), np.maximum(a, b))], names=["a", "b"])


def likeliest(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The likeliest pairs (a, b) that connect what can be connected in each block, not verified."""
    return by_block(dealt(members, texts), lambda group: forest(group, threshold, lambda x, y: True), "a bigint, b bigint").distinct()


def last_links(members: DataFrame, texts: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect the components of each bucket as far as any pair in it does. Likely pairs stay within their block, where the full sets of
    those in question are compared, so what leaves a block is at most a link a member."""
    columns = ("band", "i", "j", "own", "low", "id", "component", "size")

    def asked(group: pa.Table) -> pa.RecordBatch:
        a, b, _, _ = open_pairs(group, percent / 100)
        return group.take(pa.array(np.union1d(a, b))).combine_chunks().to_batches()[0] if len(a) else pa.RecordBatch.from_pylist([], group.schema)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                elements, at = block.shingles(block.hashes(lower=True), shingle)
                raw = [np.unique(elements[at[i]:at[i + 1]]).tobytes() for i in range(block.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(raw, pa.binary())], names=["id", "set"])

    def compare(group: pa.Table) -> pa.RecordBatch:
        full = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("set")]

        def similar(x: int, y: int) -> bool:
            common = len(np.intersect1d(full[x], full[y], assume_unique=True))
            return 100 * common >= percent * (len(full[x]) + len(full[y]) - common)

        return forest(group, percent / 100, similar)

    rows = dealt(members, texts).select(*columns, "regs")
    rows = kept(by_block(rows, asked, "band bigint, i int, j int, own int, low bigint, id bigint, component bigint, size bigint, regs binary"), "asked")
    ids = kept(rows.select("id").distinct(), "open")
    open_sets = docs.join(ids, "id", "left_semi").dropDuplicates(["id"]).select("id", "text").mapInArrow(sets, "id bigint, set binary")
    return by_block(rows.join(kept(open_sets, "sets"), "id"), compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept is the one with the smallest id of each component."""
    docs = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = kept(sketch(docs, shingle), "sketches")
    filled = sketches.where("n > 0 AND id IS NOT NULL")
    firsts = kept(filled.groupBy("k1", "k2").agg(F.min("id").alias("first")), "firsts")
    texts = kept(filled.select("id", "n", "regs").join(firsts.select(F.col("first").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]), "texts")
    bands = kept(band_rows(texts), "bands")
    buckets = kept(bands.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1"), "buckets")
    members = kept(bands.join(buckets, "band"), "members")
    to_pivots = members.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    links = verified(kept(estimated(to_pivots, texts, percent / 100), "pairs"), docs, shingle, percent)
    found = kept(components(links), "components")

    def rest() -> DataFrame:
        return members.where("n > 2").join(found, "id", "left").select("band", "low", "id", F.coalesce("component", "id").alias("component"))

    spanning = verified(kept(likeliest(rest(), texts, percent / 100), "pairs"), docs, shingle, percent)
    found = kept(components(spanning.unionAll(found.select(F.col("id").alias("a"), F.col("component").alias("b")))), "components")
    more = last_links(rest(), texts, docs, shingle, percent)
    # an id of several rows joins the texts of all of them
    rows = sketches.join(firsts, ["k1", "k2"], "left")
    several = rows.groupBy("id").agg(F.min("first").alias("a"), F.max("first").alias("_b"), F.count("*").alias("_n")).where("_n > 1 AND a <> _b").select("id", "a")
    more = more.unionAll(rows.join(several, "id").select("a", F.col("first").alias("b")).where("a <> b"))
    # components of components: only what was open before moves
    side = lambda s: found.select(F.col("id").alias(s), F.col("component").alias(f"_{s}"))
    more = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    joined = kept(components(more), "components").select(F.col("id").alias("component"), F.col("component").alias("_joined"))
    label = F.coalesce("_joined", "component", "first", "id")
    rows = rows.join(found.withColumnRenamed("id", "first"), "first", "left").withColumn("component", F.coalesce("component", "first")).join(joined, "component", "left")
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("id") == label, F.lit(True)).alias("kept"))
