"""Best-fit packing of documents into token sequences.

The plan is made over the histogram of piece lengths, of at most ``capacity`` rows, and not over documents: lengths go in falling order to the fullest
open bins that still hold them, a whole run of equal bins at a time. Pieces then take the planned slots by their rank within their length, so a length that
holds a third of all pieces is ranked in as many parts as there are rank buckets.

Defined cases: a null or empty text is the separator alone; repeated document ids are packed as so many documents; an empty table gives an empty plan;
other columns are not touched.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.llm.tables import kept, need
from tesserine.llm.vocabulary import Vocabulary, byte_symbols
from tesserine.llm.workers import hold

#: Distinct words, and distinct pieces of words, whose ids a worker remembers.
MEMO = 300_000
#: Parts in which the pieces of one length are ranked.
RANK_BUCKETS = 256


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit in falling order of length, over counts.

    Gives runs (length, first rank, end rank, first sequence, pieces per sequence, first offset): the piece of that length with rank r goes to sequence
    ``first sequence + (r - first rank) // per`` at ``first offset + (r - first rank) % per * length``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs of bins (first sequence, number)
    sizes: list[int] = []
    runs, made = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(sizes, left)
        room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], sizes[at]
            else:
                left, first, n = capacity, made, -(-todo // (capacity // length))
                made += n
            per = left // length
            full = min(n, todo // per)
            if full:
                runs.append((length, rank, rank + full * per, first, per, capacity - left))
                put(left - per * length, first, full)
                rank, todo = rank + full * per, todo - full * per
            if full < n and todo:  # the last bin takes what is left, fewer than fit
                runs.append((length, rank, rank + todo, first + full, todo, capacity - left))
                put(left - todo * length, first + full, 1)
                rank, todo, full = rank + todo, 0, full + 1
            if full < n:
                put(left, first + full, n - full)
    return runs


def encoder(path: str) -> Callable[[str], bytes]:
    """Text -> its ids as little-endian 32-bit integers, by the tokenizers library.

    Where the vocabulary never joins anything across white space, each run between it goes through the library's model once and is remembered, as is each piece
    of such runs; further ones, beyond MEMO, go through it each time. Other vocabularies get whole texts.
    """
    from tokenizers import Tokenizer

    tokenizer, vocabulary = Tokenizer.from_file(path), Vocabulary(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    model, symbols = tokenizer.model, byte_symbols()
    memo: dict[bytes, bytes] = {}
    known: dict[str, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(text: str) -> bytes:
        return packed(tokenizer.encode(text, add_special_tokens=False).ids)

    if not vocabulary.by_word:
        return whole

    def piece(text: str) -> bytes:
        ids = known.get(text)
        if ids is None:
            ids = packed([t.id for t in model.tokenize(text if text.isascii() and text.isprintable() else "".join([symbols[b] for b in text.encode()]))])
            if len(known) < MEMO and len(text) < 64:
                known[text] = ids
        return ids

    def word(data: bytes) -> bytes:
        ids = memo.get(data)
        if ids is None:
            text = data.decode()
            ids = whole(text) if vocabulary.special and "<" in text and vocabulary.special.search(text) else b"".join(map(piece, vocabulary.pieces(text)))
            if len(memo) < MEMO and len(data) < 64:
                memo[data] = ids
        return ids

    def encode(text: str) -> bytes:
        words = text.encode().split()
        parts = list(map(memo.get, words))
        if None in parts:
            for i in [i for i, p in enumerate(parts) if p is None]:
                parts[i] = word(words[i])
        return b"".join(parts)

    return encode


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """Each document's ids and the separator, cut at ``capacity``: a row per piece, with the ids themselves where asked for."""
    end = np.asarray([separator], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
                       + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = hold(("encoder", tokenizer_path), lambda: encoder(tokenizer_path))  # what a worker has met in one task it knows in the next
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    types = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return need(docs, id_col, text_col).select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, types)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Gives each piece (with its length, at most ``capacity``) its sequence_id and offset. All other columns stay."""
    spark = pieces.sparkSession
    pieces = kept(pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS))), "pieces")
    counts = kept(pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "lengths")  # at most capacity x RANK_BUCKETS rows
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    runs = np.asarray(plan_slots(histogram, capacity), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    slots = spark.sparkContext.broadcast(runs)  # bounded by the lengths there are, not by the documents
    before = counts.select("length", "_bucket", (F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ties = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    ranked = (pieces.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*ties)) - 1)
              .join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_before"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def slot(length, rank):
        import pandas as pd

        runs = slots.value
        key = runs[:, 0] << 40 | runs[:, 1]  # ranks stay below 2 ** 40
        run = runs[np.searchsorted(key, length.to_numpy() << 40 | rank.to_numpy(), "right") - 1]
        nth = rank.to_numpy() - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + nth // run[:, 4], "offset": run[:, 5] + nth % run[:, 4] * run[:, 0]})

    return ranked.withColumn("_slot", slot("length", "_rank")).select(*[c for c in pieces.columns if c != "_bucket"], "_slot.*")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (doc_id, text)."""
    return pack(token_pieces(docs, tokenizer_path, capacity, with_ids=with_ids), capacity)


def sequences(packed: DataFrame, separator: int = 0) -> DataFrame:
    """The packed sequences: (sequence_id, length, ids), from pieces that carry their ids. A sequence is at most ``capacity`` tokens."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), rows.alias("_parts")).select(
        "sequence_id", "length", F.expr("aggregate(_parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
