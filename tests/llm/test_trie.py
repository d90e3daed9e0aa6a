"""The trie of shared turns, against one built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tesserine.llm import prefix_trie


def plain_nodes(rows, rebuild=True):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[3:] for t in sorted(x)] for c, x in turns.items()}
    seqs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        seqs[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                children[tuple(s[:d - 1])].add(tuple(s[:d]))
        ends[tuple(s)].append(c)
    leaves, saved = {}, {}
    for x in sorted(members, key=len, reverse=True):
        leaves[x] = sum(leaves[k] for k in children[x]) or 1
        saved[x] = sum(saved[k] for k in children[x]) + ((len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0)
    return sorted((min(m), len(x), min(members[x[:-1]]) if x else -1, len(m), len(children[x]), leaves[x], saved[x],
                   hashlib.sha256(",".join(map(str, sorted(ends[x]))).encode()).hexdigest()) for x, m in members.items())


def nodes(seqs):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.report(prefix_trie.trie(seqs)).collect())


def some_conversations():
    rng = random.Random(2)
    rows = [(None, 1, "u", "nobody's"), (300, None, None, None), (301, 5, "u", "é"), (301, 5, "u", "é")]
    for c in range(60):
        rows += [(c * rng.choice([1, 1, 3]), rng.choice([t, t, None]), rng.choice(["u", "a", None]), rng.choice(["x", "y", "yy", None, ""])) for t in range(rng.randrange(1, 14))]
    rows += [(c, t, "u", "same") for c in range(100, 140) for t in range(6)]  # copies
    rows += [(200 + k, t, "u", str(t if t <= k else -k)) for k in range(12) for t in range(14)]  # chains that hang on chains
    return rows


@pytest.mark.parametrize(("block", "depths", "rows", "units"), [(1 << 14, 1 << 16, 1 << 16, 1 << 12), (4, 3, 8, 5), (1, 1, 1, 1)])
def test_nodes_equal_brute_force(spark, monkeypatch, block, depths, rows, units):
    for name, value in (("BLOCK", block), ("SLICE", depths), ("SHARD_ROWS", rows), ("SHARD_UNITS", units)):
        monkeypatch.setattr(prefix_trie, name, value)
    talks = some_conversations()
    df = spark.createDataFrame([(*r, 0, "x") for r in talks], "conv_id long, turn long, role string, text string, pos int, turn_id string")
    turns = prefix_trie.numbered(df)
    assert nodes(prefix_trie.rebuilt(turns)) == plain_nodes(talks)
    if block == 4:
        assert nodes(prefix_trie.sequences(turns)) == plain_nodes(talks, rebuild=False)


def test_a_conversation_of_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("SLICE", 64), ("SHARD_ROWS", 50)):
        monkeypatch.setattr(prefix_trie, name, value)
    talks = [(c, t, "u", str(t) if t < stop else f"{c} {t}") for c, stop in ((5, 1500), (10, 700), (15, 1500), (20, 31)) for t in range(1500)]
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(5)
    assert nodes(prefix_trie.rebuilt(prefix_trie.numbered(df))) == plain_nodes(talks)


def test_turnless_conversations_and_no_conversations(spark):
    some = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    df = spark.createDataFrame([(some, 0, "u", "only")], "conv_id long, turn long, role string, text string")
    assert nodes(prefix_trie.rebuilt(prefix_trie.numbered(df))) == plain_nodes([(some, 0, "u", "only")])
    assert nodes(prefix_trie.rebuilt(prefix_trie.numbered(df.limit(0)))) == []
