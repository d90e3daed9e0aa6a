"""Near-duplicates, repeated passages, contamination and the pipeline, against brute force."""

import hashlib
import random

import pytest

from tesserine.llm import contamination, neardup, substring
from tesserine.llm.components import components

SF = "/root/testdata/sf0.001"


def shingles(text, n, short=True):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w and short else set())


def linked(rows, n, percent):
    """doc_id -> smallest reachable id, over all pairs."""
    sets = [(d, shingles(t, n)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d, _ in rows}


def near_copies(seed=5):
    """A base with copies that are alike only through it, chains, exact copies, short and empty texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(40):  # each differs from the base in its own place: near the base, less so to each other
        at = rng.randrange(100)
        rows.append((501 + i, " ".join(base[:at] + [f"x{i}_{k}" for k in range(7 + i % 6)] + base[at + 7:])))
    chain = base[:]
    for i in range(8):
        chain[10 * i] = f"c{i}"
        rows.append((700 - i, " ".join(chain)))
    rows += [(1, "a b c"), (2, "A  b\nC"), (3, "a b"), (4, ""), (5, None), (6, " \t"), (7, " ".join(base).upper()), (8, "solo text of some words that nobody has"), (9, "big " * 30_000)]
    return rows + [(500, " ".join(base)), (9, "big " * 30_000)]


@pytest.mark.parametrize("block", [2048, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(None, "no id", "x")], "doc_id long, text string, component_id string")
    got = neardup.near_duplicates(docs, shingle=4).collect()
    want = linked(rows, 4, 80)
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
            assert r.n_shingles == len(shingles(dict(rows)[r.doc_id], 4))
    assert len({want[d] for d, _ in rows}) > 5


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    lone = neardup.near_duplicates(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in lone) == [(1, 1, True), (2, 2, True)]


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(300, 200), (200, 250), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)} | {200: 200, 250: 200, 300: 200}
    assert got == {i: c for i, c in want.items() if i != 7 or (1, 7) in links}


def removed(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i:i + 20])
            if k in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(k)
        out[d] = len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("shard", [4096, 1])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(substring, "SHARD", shard)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices("abcd", k=3) + passage[rng.randrange(20):40 + rng.randrange(20)] + rng.choices("abcd", k=rng.randrange(30)))) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choices("ab", k=rng.randrange(200)))) for i in range(12)] + [(200, "same " * 500), (201, "same " * 19), (202, None), (203, " \n"), (204, rows[0][1]), (205, "Same  " * 25 + "é x")]
    rows += [(300, " ".join(f"u{i}" for i in range(50))), (301, "\n".join(f"u{i}" for i in range(50)))]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_report(docs).collect()}
    want = removed(rows)
    assert got == want and sum(w[1] for w in want.values()) > 2000
    texts = {r.doc_id: r.text for r in substring.remove_repeats(docs).collect()}
    for d, t in rows:
        kept = (texts.get(d) or "").encode().split()
        assert hashlib.sha256(b" ".join(kept)).hexdigest() == want[d][2]
        assert want[d][1] or texts[d] == t
    assert substring.removal_report(docs.limit(0)).count() == 0


def test_repeated_rows_of_one_document_stay(spark):
    text = " ".join(f"u{i}" for i in range(30))
    got = substring.removal_report(spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 30)]


def test_different_texts_of_one_id_keep_their_own_words(spark):
    shared, own, rest = (" ".join(f"{c}{i}" for i in range(30)) for c in "suv")
    other = own.replace("u", "w")
    rows = [(1, shared, len(shared)), (2, f"{rest}\n{shared}", 9), (2, f" {own}\t\x0b\f\r end ", 8), (2, f"{other} é {shared}", 7), (2, shared, 6)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()
    assert sorted(map(tuple, got)) == sorted([rows[0], (2, rest, len(rest)), rows[2], (2, f"{other} é", len(other) + 2)])


def test_suffix_automaton():
    a = substring.SuffixAutomaton()
    rng = random.Random(1)
    texts = [rng.choices("ab", k=12) for _ in range(30)]
    for n, t in enumerate(texts):
        known = {tuple(x[i:j]) for x in texts[:n] for i in range(12) for j in range(i + 1, 13)}
        want = [max((k for k in range(i + 2) if tuple(t[i + 1 - k:i + 1]) in known), default=0) for i in range(12)]
        assert a.matches(t) == want
        a.add(t)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([3, 5, 8, 20, 60, 300, 2000])] + [(90, None), (91, ""), (92, "a b c d"), (3, None)]
    items[-1] = (93, items[3][1])
    docs = []
    for i, t in items:
        w = (t or "").split()
        for share in (1.0, 0.9, 0.7, 0.3):
            docs.append((len(docs), " ".join(words(200) + w[:int(len(w) * share)] + words(3000)).title()))
        docs.append((len(docs), " ".join(words(5) + w[:len(w) // 2] + words(50) + w[len(w) // 2:])))  # in two places
    docs += [(900, None), (901, ""), (902, "a b c d"), (0, docs[0][1])]
    got = contamination.contaminated(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([*items, (None, "x y z a b")], "item_id long, text string")).collect()
    want = set()
    for i, t in items:
        s = shingles(t, 5, short=False)
        for d, x in docs:
            common = len(s & shingles(x, 5, short=False))
            if s and 100 * common >= 80 * len(s):
                want.add((d, i, len(s), common))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 15
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert contamination.contaminated(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), empty.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp
    from tesserine.llm.tables import kept

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames, rows = {}, docs
    for name, stage in cp.STAGES:
        rows = frames[name] = kept(stage(spark, rows, SF), name)
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    first = texts(frames["language"])
    assert len(first) >= 0.98 * docs.count() and all(frames[n].columns == docs.columns for n in list(frames)[:-1])
    roots = linked(first, 5, 80)
    second = texts(frames["near_duplicates"])
    assert sorted(d for d, _ in second) == sorted(d for d, _ in first if roots[d] == d)
    third = dict(texts(frames["substrings"]))
    for d, (_, _, digest) in removed(second).items():
        assert hashlib.sha256(b" ".join(third.get(d, "").encode().split())).hexdigest() == digest
    assert all(r.n_chars == len(r.text) for r in frames["substrings"].collect())
    items = [shingles(r.text, 5, short=False) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, t in third.items() if not any(100 * len(i & shingles(t, 5, short=False)) >= 80 * len(i) for i in items if i)}
    assert {d for d, _ in texts(frames["contamination"])} == clean and len(clean) < len(third)
    assert {r.doc_id for r in frames["packing"].collect()} == clean


def test_queries_equal_their_sql(spark):
    import parity
    from tesserine.llm.queries import ORACLES, QUERIES

    con = parity.connect(SF)
    wrong = {k: why for k, sql in ORACLES.items() if (why := parity.check(spark, con, SF, k, QUERIES[k], sql))}
    assert not wrong
