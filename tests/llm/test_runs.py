"""Periodic runs, against the definition: every period, every maximal stretch."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tesserine.llm import runs


def plain_runs(words, least=24, periods=3):
    """All maximal stretches of every period that is the smallest of its stretch."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            part = words[i:i + size]
            if j > i and size >= max(least, periods * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbers(words):
    known = {}
    return [known.setdefault(w, len(known)) for w in words]


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_short_sequences(seed):
    rng = random.Random(seed)
    for _ in range(300):
        letters = rng.choice([1, 2, 3, 5])
        s = [rng.randrange(letters) for _ in range(rng.randrange(1, 50))]
        at = rng.randrange(len(s))
        s[at:at] = [rng.randrange(letters) for _ in range(rng.randrange(1, 8))] * rng.randrange(6)
        assert runs.runs_of(numbers(s), 1, 2) == plain_runs(s, 1, 2)


@pytest.mark.parametrize("seed", range(4))
def test_stretches_lose_no_run(seed):
    rng = random.Random(seed)
    for _ in range(150):
        s = [rng.randrange(60) for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(1, 5)):
            root = [rng.randrange(rng.choice([2, 60])) for _ in range(rng.randrange(1, 40))]
            at = rng.randrange(len(s) + 1)
            s[at:at] = (root * 6)[:rng.randrange(2 * len(root), 6 * len(root) + 1)]
        words = [b"%d" % x for x in s]
        assert runs.text_runs(words) == plain_runs(words)


def test_far_copies_are_not_searched():
    rng = random.Random(3)
    passage = [rng.randrange(10**6) for _ in range(60)]
    words = numbers(passage + [rng.randrange(10**6) for _ in range(500)] + passage)
    assert runs.stretches(np.array(words)) == []


def test_long_texts():
    assert runs.text_runs([b"a"] * 30_000) == [(0, 30_000, 1)]
    rng = random.Random(4)
    root = [b"%d" % rng.randrange(10**6) for _ in range(4000)]
    assert runs.text_runs([b"x", *root * 4, b"y"]) == [(1, 16_000, 4000)]


def test_longest_extensions():
    rng = random.Random(5)
    s = [rng.randrange(2) for _ in range(60)]
    tree = runs.Extensions(s, True)
    for i in range(61):
        for j in range(61):
            if i != j:
                same = 0
                while max(i, j) + same < 60 and s[i + same] == s[j + same]:
                    same += 1
                assert tree.lce(np.array([i]), np.array([j]))[0] == same
    assert sorted(range(61), key=lambda i: s[i:]) == sorted(range(61), key=lambda i: tree.ranks[0][i])
    assert sorted(range(61), key=lambda i: [-x for x in s[i:]]) == sorted(range(61), key=lambda i: tree.ranks[1][i])


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_report_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(None, "no id " * 20), (1, None), (2, ""), (3, " \t\n"), (4, "a\x0bb c " * 30), (5, "one two three " * 9), (5, "one two three " * 9), (6, "x " * 23), (7, "x " * 24),
            (8, "p q " * 12 + "p q r " * 10 + "q r " * 15)]
    rows += [(100 + i, " ".join(str(rng.randrange(40)) for _ in range(rng.randrange(1, 300)))) for i in range(80)]
    docs = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, runs string, collapsed int")
    got = [tuple(r) for r in runs.report(runs.periodic_runs(runs.planted(docs))).collect()]
    assert sorted(got, key=repr) == sorted((expected(d, t) for d, t in rows), key=repr)
    assert sum(r[1] for r in got) > 10
    assert runs.report(runs.periodic_runs(runs.planted(docs.limit(0)))).count() == 0


def test_results_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(runs, "OUT_BYTES", 10)
    docs = spark.createDataFrame([(i, f"word{i} " * 30) for i in range(20)], "doc_id long, text string")
    assert sorted((r.doc_id, r.collapsed) for r in runs.periodic_runs(docs).collect()) == [(i, f"word{i}") for i in range(20)]
