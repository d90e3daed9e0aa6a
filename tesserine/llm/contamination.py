"""Benchmark decontamination: which documents hold a test item, by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle sets. A partition keeps, as sketch of an item, its shingles in the lowest part of the hash space, the part halving as
sizes double, so that each item keeps about ``SKETCH`` minima or more, and small items all their shingles. As the part is the same for both sides, the share of an item's minima among a document's
shingles estimates containment however long the document is. A filter of fixed size, ``FILTER_BITS`` bits, is all that is broadcast; documents that hit it are matched
with the sketches by join, and pairs above half the threshold are verified on the full sets.

Defined cases: a null or empty text, or one below a shingle, has no shingles; such items are in no document; repeated rows of a document or an item give one pair; empty
tables give no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.tables import kept, need
from tesserine.llm.words import blocks

SKETCH = 32
#: Bits of the filter, in as many slices as are built by tasks of their own.
FILTER_BITS, SLICES = 1 << 24, 64


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for block in blocks(column):
        elements, at = block.shingles(block.hashes(lower=True), shingle, short=False)
        for i in range(block.n):
            yield np.unique(elements[at[i]:at[i + 1]])


def _partition(sizes):
    """Halvings of the hash space for a set of this size: 0 for small ones."""
    return np.maximum(0, np.floor(np.log2(np.maximum(sizes, 1) / SKETCH))).astype(np.int64)


def sketches(items: DataFrame, shingle: int) -> DataFrame:
    """(hash, item_id, size, minima): the minima of every item, of ``items`` (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids, sizes, counts = [np.zeros(0, np.uint64)], [], [], []
            for item, s in zip(batch.column(0).to_pylist(), _sets(batch.column(1), shingle), strict=True):
                low = s[s >> np.uint64(1) < np.uint64(1) << np.uint64(63 - int(_partition(len(s))))]
                found.append(low)
                ids += [item] * len(low)
                sizes += [len(s)] * len(low)
                counts += [len(low)] * len(low)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *(pa.array(v, pa.int64()) for v in (ids, sizes, counts))], names=["hash", "item_id", "size", "minima"])

    return items.mapInArrow(run, "hash bigint, item_id bigint, size bigint, minima bigint")


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice and two bits in it, from separate parts of the hash."""
    width = np.uint64(FILTER_BITS // SLICES)
    return (hashes & np.uint64(SLICES - 1)).astype(np.int64), ((hashes >> np.uint64(6)) % width).astype(np.int64), ((hashes >> np.uint64(31)) % width).astype(np.int64)


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """The filter, SLICES rows of booleans: FILTER_BITS bytes at the most, whatever the number of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            part, *bits = _places(batch.column(0).to_numpy().view(np.uint64))
            for p in np.unique(part):
                bitmap = made.setdefault(int(p), np.zeros(FILTER_BITS // SLICES, bool))
                for b in bits:
                    bitmap[b[part == p]] = True
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([np.packbits(m).tobytes() for m in made.values()], pa.binary())], names=["slice", "bits"])

    out = np.zeros((SLICES, FILTER_BITS // SLICES), bool)
    slices = hashes.select("hash").distinct().repartition(SLICES, F.col("hash").bitwiseAND(SLICES - 1)).mapInArrow(run, "slice int, bits binary")
    for row in slices.collect():  # SLICES rows
        out[row.slice] |= np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool)
    return out


def hits(docs: DataFrame, members: np.ndarray, shingle: int) -> DataFrame:
    """(doc_id, text, hashes) of the documents with shingles in the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(members).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        width = FILTER_BITS // SLICES
        for batch in batches:
            rows, values = [], []
            for block in blocks(batch.column(1)):
                elements, at = block.shingles(block.hashes(lower=True), shingle, short=False)
                part, one, two = _places(elements)
                found = np.flatnonzero(bits[part * width + one])
                found = found[bits[part[found] * width + two[found]]]
                owner = np.searchsorted(at, found, "right") - 1
                for i in np.unique(owner):
                    rows.append(block.first + int(i))
                    values.append(np.unique(elements[found[owner == i]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "text", "hashes"])

    return docs.mapInArrow(run, "doc_id bigint, text string, hashes array<bigint>")


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) of every pair where the document holds at least ``percent`` of the item's shingles."""
    docs = need(docs, doc_col, text_col).select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = need(items, item_col, text_col).select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("item")).where("item_id IS NOT NULL")
    minima = kept(sketches(items, shingle), "minima")
    found = kept(hits(docs.where("doc_id IS NOT NULL"), hash_filter(minima), shingle), "hits")
    # a small item's minima are its whole set; of larger ones half the threshold is far below what a contained item gives
    enough = F.when(F.col("size") == F.col("minima"), 100 * F.col("n") >= percent * F.col("size")).otherwise(200 * F.col("n") >= percent * F.col("minima"))
    pairs = found.select("doc_id", F.explode("hashes").alias("hash")).distinct().join(minima.distinct(), "hash").groupBy("doc_id", "item_id", "size", "minima").agg(F.count("*").alias("n")).where(enough)
    pairs = kept(pairs.select("doc_id", "item_id").distinct(), "pairs")
    rows = found.select("doc_id", "text").join(pairs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [(len(i), len(np.intersect1d(d, i, assume_unique=True))) for d, i in zip(_sets(batch.column(2), shingle), _sets(batch.column(3), shingle), strict=True)]
            size, common = (pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, common], names=["doc_id", "item_id", "n_shingles", "n_shared"])
            yield out.filter(pa.array([n > 0 and 100 * c >= percent * n for n, c in counts], pa.bool_()))

    return rows.mapInArrow(run, "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that hold an item."""
    return docs.join(contaminated(docs, items, shingle, percent).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
