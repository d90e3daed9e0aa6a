"""Trie of the turns that conversations share at their front, by vertical bitmaps.

Conversations are dealt into shards of consecutive ids. A shard indexes its turns vertically: each (position, turn) has a bitset of the conversations that have that
turn there. Depth first, the bitset of a node is intersected with the postings of the next position: every intersection that is not empty is a child, its popcount the
members, and those of its bits whose conversation ends there its end list. Shards then merge by node: counts add up, the least id wins, end lists are strung together.

A node is known everywhere by 128 bits: the exclusive or of a hash of each (position, turn) of its path. So a very long conversation need not be in one shard; it is
cut into blocks of ``BLOCK`` turns, and each block starts from the hash of those before.

Sums over subtrees use that the nodes with the same least member are a chain of consecutive depths, and that chains form a tree. Totals of chains are gathered by
pointer jumping, in as many rounds as the logarithm of the nesting of chains; then each chain is summed from its end, in slices of ``SLICE`` depths.

Defined cases: rows without a conversation id belong to none and are left out; a null role or text is empty; null turn numbers come first, and rows of one
conversation and turn number are ordered by the MD5 of role and text; repeated rows are turns each; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.llm.tables import kept

#: Turns of a conversation that stand together, and depths of a chain that are summed together.
BLOCK, SLICE = 1 << 14, 1 << 16
#: Rows, and conversations or blocks of them, of a shard.
SHARD_ROWS, SHARD_UNITS = 1 << 16, 1 << 12


class Trie(NamedTuple):
    """``nodes``: k1, k2 (key), p1, p2 (key of the parent), depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    ``ends``: k1, k2, ids; the conversations that end at a node, ascending, in several rows where there are many. All ids of a row are above or below those of another."""

    nodes: DataFrame
    ends: DataFrame


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, n, turn_id, bytes): turns counted from 1 in their order, the number of turns of the conversation, and what tells a turn from others."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_id"),
                                                              F.octet_length(text).cast("long").alias("bytes"))
    order = ("conv_id", "turn", "turn_id")
    # sorted over all partitions; the place in a partition is in the row's id, and a conversation that spans partitions is counted on
    turns = kept(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn_id", "bytes", F.monotonically_increasing_id().alias("row")), "turns")
    turns = turns.withColumn("part", F.expr("shiftright(row, 33)"))
    spans = turns.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"), F.sum("n").over(W.partitionBy("conv_id")).alias("n"))
    return turns.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("row") + F.col("shift")).alias("p"), "n", "turn_id", "bytes")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, bytes, last) of numbered turns, with a row at position 0 for each conversation."""
    starts = turns.where("p = 1").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("turn_id"), F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("last"))
    return starts.unionAll(turns.select("conv_id", "p", "turn_id", "bytes", (F.col("p") == F.col("n"))))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Sequences in which the first h turns of a conversation c are those of conversation ``c - c % group``, where h is the CRC-32 of c modulo ``most``."""
    c = F.col("conv_id")
    convs = turns.where("p = 1").select("conv_id", "n", (c - c % group).alias("leader"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    leaders = convs.select(F.col("conv_id").alias("leader"), F.col("n").alias("of_leader"))
    convs = kept(convs.join(leaders, "leader", "left").select("conv_id", "n", "leader", "h", F.least("h", F.coalesce("of_leader", F.lit(0))).alias("k")), "conversations")
    heads = turns.where(F.col("p") < most).select(F.col("conv_id").alias("leader"), "p", "turn_id", "bytes")
    starts = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("turn_id"), F.lit(0).cast("long").alias("bytes"), F.expr("k = 0 AND n <= h").alias("last"))
    lead = convs.where("k > 0").join(heads, "leader").where("p <= k").select("conv_id", "p", "turn_id", "bytes", F.expr("p = k AND n <= h"))
    own = turns.drop("n").join(convs, "conv_id").where("p > h").select("conv_id", F.expr("p - h + k"), "turn_id", "bytes", F.expr("p = n"))
    return starts.unionAll(lead).unionAll(own)


_PART = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, n bigint, conv_id bigint, bytes bigint, ends array<bigint>"
_ARROW = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "p1", "p2", "depth", "n", "conv_id", "bytes")] + [("ends", pa.list_(pa.int64()))])
_IN = ("conv_id", "pos", "h1", "h2", "bytes", "last", "c1", "c2")


def shard_nodes(conv: np.ndarray, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray, size: np.ndarray, last: np.ndarray, c1: np.ndarray, c2: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
    """Nodes of one shard. Rows are sorted by conversation and position; units (conversations, or blocks of them) start at ``begin``."""
    rows, units = len(conv), len(begin)
    end = np.append(begin[1:], rows)
    unit = np.repeat(np.arange(units), end - begin)
    # keys of each row's path, and of the path before it
    key, up = [], []
    for h, c in ((h1, c1), (h2, c2)):
        total = np.bitwise_xor.accumulate(h)
        before = np.append(0, total)[begin] ^ c[begin]
        key.append(total ^ before[unit])
        up.append(key[-1] ^ h)
    # vertical index: bitsets of units by (position, turn), and of those that stop at a position
    pairs = np.empty(rows, [("a", np.int64), ("b", np.int64)])
    pairs["a"], pairs["b"] = h1, h2
    distinct, label = np.unique(pairs, return_inverse=True)
    posting = [0] * len(distinct)
    label_of = label.tolist()
    for x, u in zip(label_of, unit.tolist(), strict=True):
        posting[x] |= 1 << u
    first, stop, at = begin.tolist(), end.tolist(), pos.tolist()
    stops: dict[int, int] = {}
    final = fresh = 0
    done = last[end - 1].tolist()
    for u in range(units):
        p = at[stop[u] - 1]
        stops[p] = stops.get(p, 0) | 1 << u
        final |= done[u] << u
        fresh |= (at[first[u]] == 0) << u
    node, count, tails, ended = [], [], [], []

    def ids(bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(first[low.bit_length() - 1])
            bits ^= low
        return conv[out].tolist()

    def alone(u: int, row: int) -> None:
        """From this row on, the unit's path is its own."""
        if row < stop[u]:
            tails.append(np.arange(row, stop[u]))
        if done[u]:
            ended.append((stop[u] - 1, [int(conv[first[u]])]))

    for u in range(units):
        if not fresh >> u & 1:
            alone(u, first[u])
    todo = []
    if fresh:
        row = first[(fresh & -fresh).bit_length() - 1]
        node.append(row)
        count.append(fresh.bit_count())
        todo.append((fresh, row))
    while todo:
        members, row = todo.pop()
        depth = at[row]
        here = members & stops.get(depth, 0)
        if here & final:
            ended.append((row, ids(here & final)))
        rest = members & ~here
        while rest:
            u = (rest & -rest).bit_length() - 1
            row = first[u] + depth + 1 - at[first[u]]
            child = members & posting[label_of[row]]
            rest &= ~child
            n = child.bit_count()
            if n == 1:
                alone(u, row)
            else:
                node.append(row)
                count.append(n)
                todo.append((child, row))
    lone = np.concatenate([*tails, np.zeros(0, np.int64)]).astype(np.int64)
    pick = np.concatenate([np.array(node, np.int64), lone, np.array([r for r, _ in ended], np.int64)])
    n = np.concatenate([np.array(count, np.int64), np.ones(len(lone), np.int64), np.zeros(len(ended), np.int64)])
    lists = pa.concat_arrays([pa.nulls(len(pick) - len(ended), pa.list_(pa.int64())), pa.array([x for _, x in ended], pa.list_(pa.int64()))])
    columns = [key[0][pick], key[1][pick], up[0][pick], up[1][pick], pos[pick], n, conv[pick], size[pick]]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], schema=_ARROW)


def sharder(block: int, most_rows: int, most_units: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows to the nodes of their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def cut(rows: list[np.ndarray], whole: bool) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            """Shards off the front; what may go on in the next batch stays."""
            conv, part = rows[0], rows[1] // block
            begin = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (part[1:] != part[:-1]))) if len(conv) else np.zeros(0, np.int64)
            bounds = np.append(begin, len(conv))
            u, units = 0, len(begin) - (not whole)
            while u < units and (whole or bounds[units] - bounds[u] >= most_rows or units - u >= most_units):
                v = min(u + most_units, units, max(u + 1, int(np.searchsorted(bounds, bounds[u] + most_rows, "right")) - 1))
                yield [x[bounds[u]:bounds[v]] for x in rows], begin[u:v] - bounds[u]
                u = v
            held[:] = [[x[bounds[u]:] for x in rows]] if u < len(begin) else []

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(_IN))])
            if sum(len(x[0]) for x in held) >= most_rows:
                for rows, begin in cut([np.concatenate(x) for x in zip(*held, strict=True)], False):
                    yield shard_nodes(*rows, begin)
        if held:
            for rows, begin in cut([np.concatenate(x) for x in zip(*held, strict=True)], True):
                yield shard_nodes(*rows, begin)

    return run


def parts(seqs: DataFrame) -> DataFrame:
    """Nodes and end lists of every shard."""
    hashes = [F.when(F.col("pos") == 0, F.lit(0).cast("long")).otherwise(h) for h in (F.xxhash64("pos", "turn_id"), F.xxhash64("turn_id", "pos"))]
    seqs = seqs.select("conv_id", "pos", hashes[0].alias("h1"), hashes[1].alias("h2"), "bytes", "last", F.expr(f"pos div {BLOCK}").alias("block"))
    seqs = kept(seqs, "sequences")
    # what the blocks of very long conversations start from
    long = seqs.join(seqs.where(F.col("pos") == BLOCK).select("conv_id"), "conv_id", "left_semi")
    sums = long.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *(F.bit_xor(c).over(before).alias(c) for c in ("c1", "c2"))).where("block > 0")
    zero = F.lit(0).cast("long")
    later = seqs.where("block > 0").join(sums, ["conv_id", "block"])
    seqs = seqs.where("block = 0").withColumns({"c1": zero, "c2": zero}).unionByName(later)
    dealt = seqs.repartitionByRange("conv_id", "block").sortWithinPartitions("conv_id", "pos").select(*_IN)
    return kept(dealt.mapInArrow(sharder(BLOCK, SHARD_ROWS, SHARD_UNITS), _PART), "parts")


def trie(seqs: DataFrame) -> Trie:
    found = parts(seqs)
    nodes = found.groupBy("k1", "k2").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("bytes").alias("bytes"))
    nodes = kept(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    above = nodes.join(children, ["k1", "k2"]).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, ["k1", "k2"], "left").join(above, ["p1", "p2", "depth"], "left")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "leaves": F.col("n_children").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes"),
                               "top": F.expr("parent_conv_id IS NULL OR parent_conv_id <> conv_id")})
    nodes = kept(nodes, "nodes")
    totals = chain_totals(nodes)
    extra = totals.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    nodes = nodes.join(extra, ["conv_id", "depth"], "left").drop("top")
    nodes = nodes.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved").withColumn("slice", F.expr(f"depth div {SLICE}"))
    # from the end of each chain upwards
    nodes = kept(nodes, "nodes")
    ends = nodes.join(nodes.where(F.col("depth") % SLICE == 0).where("slice > 0").select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", "slice").agg(F.sum("leaves").alias("later_leaves"), F.sum("saved").alias("later_saved"))
    after = W.partitionBy("conv_id").orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("conv_id", "slice", *(F.sum(c).over(after).alias(c) for c in ("later_leaves", "later_saved")))
    down = W.partitionBy("conv_id", "slice").orderBy(F.desc("depth"))
    nodes = nodes.withColumns({"n_leaves": F.sum("leaves").over(down), "saved_tokens": F.sum("saved").over(down)}).join(ends, ["conv_id", "slice"], "left")
    nodes = nodes.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("later_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("later_saved", F.lit(0))})
    nodes = nodes.select("k1", "k2", "p1", "p2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return Trie(nodes, found.where("ends IS NOT NULL").select("k1", "k2", F.col("ends").alias("ids")))


def chain_totals(nodes: DataFrame) -> DataFrame:
    """For the chain of each least member: where it hangs (chain ``above``, depth ``at``), and leaves and savings of it and all chains below.

    After r rounds a chain has the sums of those fewer than 2^r steps below it, and knows the chain 2^r steps above.
    """
    top = lambda x: F.max(F.when(F.col("top"), x))
    chains = kept(nodes.groupBy("conv_id").agg(top(F.col("parent_conv_id")).alias("above"), top(F.col("depth") - 1).alias("at"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "chains")
    now = chains.withColumn("far", F.col("above"))
    while now.where("far IS NOT NULL").limit(1).count():
        given = now.where("far IS NOT NULL").groupBy(F.col("far").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        onward = now.where("far IS NOT NULL").select(F.col("conv_id").alias("far"), F.col("far").alias("further"))
        now = now.join(given, "conv_id", "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
        now = kept(now.join(onward, "far", "left").select("conv_id", "above", "at", "leaves", "saved", F.col("further").alias("far")), "chains")
    return now.drop("far")


def id_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the decimal ids that end at a node, ascending, joined by commas. Lists are streamed, whatever their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (k1, k2) == key:
                    digest.update(b",")
                else:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256()
                digest.update(",".join(map(str, ids)).encode())
            yield made(out)
        if key:
            yield made([(*key, digest.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["k1", "k2", "ends_sha256"])

    lists = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.expr("ids[0]"))
    return lists.mapInArrow(run, "k1 bigint, k2 bigint, ends_sha256 string")


def report(found: Trie) -> DataFrame:
    """One row per node, with a digest of its end list."""
    none = hashlib.sha256().hexdigest()
    return found.nodes.join(id_digests(found.ends), ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
