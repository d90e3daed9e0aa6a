"""Removal of word sequences that appear earlier in the collection, by suffix automata.

A window is ``WINDOW`` consecutive words; a word goes if a window over it also starts earlier. Every window has one anchor, the least hash among its runs of ``GRAM`` words, so equal
windows have equal anchors, and only anchors that occur twice matter. The reference that documents are matched with grows with the collection, so its automata cannot be
broadcast; they are sharded by anchor instead, and each shard gets just the passages that hold its anchors:

1. Anchors that occur twice are found by sums; documents with such anchors are the open ones.
2. A segment is the run of a document's windows that share an anchor. Of equal segments only the first, by sums, can be new; in all others every window goes.
3. First segments whose anchor has several go to that anchor's shard in order of document and place. The shard keeps a suffix automaton of what it has seen:
   each segment is streamed through it, windows whose matching statistics reach ``WINDOW`` go, and the rest is added.
4. An anchor with more than ``SHARD`` different segments is split by window instead, again by sums, which is exact as well.

Defined cases: a null or empty text has no words; texts below a window stay as they are; rows of one id are one document, so equal windows at the same place of both are
kept, and rows without an id stay as they are; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.tables import kept, need
from tesserine.llm.words import Block, _power_tables, blocks, mix, rolling

WINDOW, GRAM = 20, 8
#: Different segments of one anchor that one automaton takes.
SHARD = 4096


class Segments:
    """The windows of a block of texts by anchor: per segment its row, first window (word of the block), number of windows, anchor and content hash."""

    def __init__(self, block: Block):
        h = block.hashes(lower=False)
        self.row = self.first = self.n = np.zeros(0, np.int64)
        self.gram = self.content = np.zeros(0, np.int64)
        if len(h) < WINDOW:
            return
        grams = rolling(h, GRAM)
        anchor = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(1) + np.arange(len(h) - WINDOW + 1)
        row = np.repeat(np.arange(block.n), np.diff(block.words))
        inside = np.flatnonzero(row[:len(anchor)] == row[WINDOW - 1:])
        if not len(inside):
            return
        at = anchor[inside]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[inside][1:] != row[inside][:-1])]))
        self.first, self.n = inside[new], np.diff(np.append(new, len(inside)))
        self.row, self.gram = row[self.first], grams[at[new]].view(np.int64)
        power, inverse = _power_tables(len(h) + 1)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(0x2545F4914F6CDD1D)) * power[: len(h)], out=sums[1:])
        end = self.first + self.n + WINDOW - 1
        self.content = mix((sums[end] - sums[self.first]) * inverse[self.first] + self.n.astype(np.uint64)).view(np.int64)


def _words(block: Block, begin: int, end: int) -> str:
    data = block.data[block.starts[begin]:block.ends[end - 1]].tobytes()
    return b" ".join(data.split()).decode()


def anchors(docs: DataFrame) -> DataFrame:
    """(gram, doc_id) of every anchor of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                s = Segments(block)
                ids = batch.column(0).slice(block.first, block.n).take(pa.array(s.row))
                yield pa.RecordBatch.from_arrays([pa.array(s.gram), ids], names=["gram", "doc_id"])

    return docs.mapInArrow(run, "gram bigint, doc_id bigint")


def _open(batch: pa.RecordBatch, column: int) -> Iterator[tuple[Block, Segments, int, int, np.ndarray]]:
    """(block, segments, row of the block, row of the batch, those of its segments whose anchor is listed in the column)."""
    for block in blocks(batch.column(1)):
        s = Segments(block)
        edges = np.searchsorted(s.row, np.arange(block.n + 1))
        for i in range(block.n):
            mine = np.arange(edges[i], edges[i + 1])
            listed = batch.column(column)[block.first + i].values
            yield block, s, i, block.first + i, mine[np.isin(s.gram[mine], listed.to_numpy(zero_copy_only=False))] if listed is not None else mine[:0]


def segments(open_docs: DataFrame) -> DataFrame:
    """(gram, content, doc_id), once for each different segment of a document. ``open_docs`` is (doc_id, text, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, content, doc = [], [], []
            for _, s, _, at, mine in _open(batch, 2):
                pairs = np.unique(np.stack([s.gram[mine], s.content[mine]]), axis=1)
                gram.append(pairs[0])
                content.append(pairs[1])
                doc += [batch.column(0)[at].as_py()] * pairs.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for v in (gram, content)] + [pa.array(doc, pa.int64())], names=["gram", "content", "doc_id"])

    return open_docs.mapInArrow(run, "gram bigint, content bigint, doc_id bigint")


def passages(wanted: DataFrame) -> DataFrame:
    """(gram, doc_id, start, content, words) of the first place of each wanted segment. ``wanted`` is (doc_id, text, grams, contents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for block, s, i, at, mine in _open(batch, 2):
                todo = set(batch.column(3)[at].as_py())
                for k in mine:
                    content = int(s.content[k])
                    if content in todo:
                        todo.remove(content)
                        begin = int(s.first[k])
                        values = int(s.gram[k]), batch.column(0)[at].as_py(), begin - int(block.words[i]), content, _words(block, begin, begin + int(s.n[k]) + WINDOW - 1)
                        for column, value in zip(rows, values, strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["gram", "doc_id", "start", "content", "words"])

    return wanted.mapInArrow(run, "gram bigint, doc_id bigint, start bigint, content bigint, words string")


class SuffixAutomaton:
    """Of any number of word sequences."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[str]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            known = nxt[last].get(w)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is None:
                made = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = made
                    p = link[p]
                last, target = made, (nxt[p][w] if p >= 0 else None)
            else:
                p, target, made = last, known, None
            if target is None:
                continue
            if length[target] != length[p] + 1:
                clone = len(nxt)
                nxt.append(dict(nxt[target]))
                length.append(length[p] + 1)
                link.append(link[target])
                link[target] = clone
                while p >= 0 and nxt[p].get(w) == target:
                    nxt[p][w] = clone
                    p = link[p]
                target = clone
            if made is None:
                last = target
            else:
                link[made] = target

    def matches(self, words: list[str]) -> list[int]:
        """At each word, the length of the longest run ending there that has been added."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            state = nxt[state].get(w, 0)
            n = n + 1 if state else 0
            out.append(n)
        return out


def repeated_windows(shards: DataFrame) -> DataFrame:
    """(doc_id, content, mask): bit k is set if window k of the segment has been seen before. ``shards`` comes by gram, in order of doc_id and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = None, SuffixAutomaton()
        for batch in batches:
            doc, content, mask = [], [], []
            for g, d, c, text in zip(*(batch.column(n).to_pylist() for n in ("gram", "doc_id", "content", "words")), strict=True):
                words = text.split(" ")
                if g != shard:
                    shard, seen = g, SuffixAutomaton()
                    seen.add(words)
                    continue
                old = [n >= WINDOW for n in seen.matches(words)[WINDOW - 1:]]
                if any(old):
                    doc.append(d)
                    content.append(c)
                    mask.append(sum(1 << k for k, o in enumerate(old) if o))
                begin = None
                for k, o in enumerate([*old, True]):  # the rest is new to the shard
                    if not o and begin is None:
                        begin = k
                    elif o and begin is not None:
                        seen.add(words[begin:k + WINDOW - 1])
                        begin = None
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (doc, content, mask)], names=["doc_id", "content", "mask"])

    return shards.repartition("gram").sortWithinPartitions("gram", "doc_id", "start").mapInArrow(run, "doc_id bigint, content bigint, mask bigint")


def repeated_windows_by_sum(crowded: DataFrame) -> DataFrame:
    """As :func:`repeated_windows`, for anchors with very many segments: window by window."""
    words = F.split("words", " ")
    window = F.concat_ws(" ", F.slice("_w", F.col("k") + 1, WINDOW))
    rows = crowded.withColumn("_w", words).select("gram", "doc_id", "start", "content", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - WINDOW)).alias("k")).select(
        "gram", "doc_id", "content", "k", (F.col("start") + F.col("k")).alias("at"), F.xxhash64(window).alias("h1"), F.xxhash64(window, F.lit(7)).alias("h2"))
    in_doc = rows.groupBy("gram", "h1", "h2", "doc_id").agg(F.min("at").alias("_at"))
    first = in_doc.groupBy("gram", "h1", "h2").agg(F.min("doc_id").alias("_doc"))
    old = (F.col("doc_id") > F.col("_doc")) | (F.col("at") > F.col("_at"))
    return rows.join(first, ["gram", "h1", "h2"]).join(in_doc, ["gram", "h1", "h2", "doc_id"]).where(old).groupBy("doc_id", "content").agg(
        F.sum(F.expr("shiftleft(1L, k)")).alias("mask"))


def removed_words(block: Block, s: Segments, i: int, mine: np.ndarray, whole: set[int], masks: dict[int, int]) -> np.ndarray:
    """Which words of row i go."""
    begin, end = int(block.words[i]), int(block.words[i + 1])
    windows = np.zeros(end - begin + 1, np.int64)
    seen = set()
    for k in mine:
        key = int(s.gram[k]), int(s.content[k])
        first = int(s.first[k]) - begin
        if key in seen or key[1] in whole:
            windows[first:first + int(s.n[k])] = 1
        elif key[1] in masks:
            windows[first:first + int(s.n[k])] = [masks[key[1]] >> b & 1 for b in range(int(s.n[k]))]
        seen.add(key)
    change = np.zeros(end - begin + 1, np.int64)
    starts = np.flatnonzero(windows)
    change[starts] += 1
    np.subtract.at(change, starts + WINDOW, 1)
    return np.cumsum(change)[:-1] > 0


def _kept_text(block: Block, i: int, gone: np.ndarray) -> bytes:
    """The row's text without the removed words: runs of kept words as they stand, joined by one space."""
    begin = int(block.words[i])
    stay = np.flatnonzero(~gone) + begin
    if not len(stay):
        return b""
    cut = np.flatnonzero(np.diff(stay) > 1) + 1
    return b" ".join(block.data[block.starts[r[0]]:block.ends[r[-1]]].tobytes() for r in np.split(stay, cut))


def _digest(text: bytes) -> str:
    return hashlib.sha256(b" ".join(text.split())).hexdigest()


def changed(docs: DataFrame) -> DataFrame:
    """(doc_id, before, n_removed, kept_sha256, text) of the documents that lose words; before is the digest of all their words. ``docs`` is (doc_id, text)."""
    found = anchors(docs)
    twice = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    grams = found.join(twice, "gram").groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))  # bounded by the document
    open_docs = kept(docs.join(grams, "doc_id"), "open")
    firsts = kept(segments(open_docs).groupBy("gram", "content").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "firsts")
    several = firsts.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1")
    wanted = firsts.join(several, "gram").groupBy(F.col("first").alias("doc_id")).agg(F.collect_set("content").alias("contents"))
    shards = passages(open_docs.join(wanted, "doc_id").select("doc_id", "text", "grams", "contents")).distinct().join(several, "gram")
    shards = kept(shards, "shards")
    masks = repeated_windows(shards.where(F.col("size") <= SHARD)).unionAll(repeated_windows_by_sum(shards.where(F.col("size") > SHARD)))
    whole = segments(open_docs).join(firsts.where("n > 1"), ["gram", "content"]).where("doc_id <> first").select("doc_id", "content", F.lit(-1).cast("long").alias("mask"))
    marks = masks.unionAll(whole).groupBy("doc_id").agg(F.collect_set(F.struct("content", "mask")).alias("marks"))
    rows = open_docs.join(marks, "doc_id", "left").select("doc_id", "text", "grams", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for block, s, i, at, mine in _open(batch, 2):
                marks = batch.column(3)[at].as_py() or []
                gone = removed_words(block, s, i, mine, {m["content"] for m in marks if m["mask"] == -1}, {m["content"]: m["mask"] for m in marks if m["mask"] != -1})
                if gone.any():
                    text = _kept_text(block, i, gone)
                    values = batch.column(0)[at].as_py(), _digest(block.data[block.bounds[i]:block.bounds[i + 1]].tobytes()), int(gone.sum()), _digest(text), text.decode()
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "before", "n_removed", "kept_sha256", "text"])

    return rows.mapInArrow(run, "doc_id bigint, before string, n_removed bigint, kept_sha256 string, text string")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, before) of every document; before is the digest of its words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t.as_py() or "").encode().split() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())],
                                             names=["doc_id", "n_words", "before"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, before string")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    docs = _plain(docs, id_col, text_col)
    lost = changed(docs).drop("text").dropDuplicates(["doc_id", "before"])
    return digests(docs).join(lost, ["doc_id", "before"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "before").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of the texts, and n_chars, if there, following; documents of which nothing stays go. Texts that lose nothing stay as they are."""
    lost = changed(_plain(docs, id_col, text_col)).select(F.col("doc_id").alias("_lost_id"), F.col("before").alias("_before"), F.col("text").alias("_left"), F.lit(True).alias("_lost")).dropDuplicates(["_lost_id", "_before"])
    # rows of one id may have different texts: the digest of the words says whose text it is
    rows = docs.withColumn("_now", F.sha2(F.array_join(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \\t-\\r]+"), ""), " "), 256))
    rows = rows.join(lost, (F.col(id_col).cast("long") == F.col("_lost_id")) & (F.col("_now") == F.col("_before")), "left").where("_lost IS NULL OR _left <> ''")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_lost"), F.length("_left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.withColumn(text_col, F.coalesce("_left", text_col)).select(*docs.columns)
