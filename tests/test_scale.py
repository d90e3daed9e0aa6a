"""The forms that keep hot groups apart must equal the plain forms."""

import os
import random
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.functions import edits
from tesserine.operators import clones, files as fl, graph, reports, setjoin, skew, timeline
from tesserine.session import shared_dir


def test_sliced_windows_equal_plain_windows(spark):
    random.seed(1)
    rows = [(random.choice("aab"), f"2024-01-{random.randint(1, 9):02d} {random.randint(0, 23):02d}:00:00", i, random.choice([None, *range(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t string, i int, v int").withColumn("t", F.col("t").cast("timestamp"))
    w = W.partitionBy("k").orderBy("t", "i")
    for step in (-1, 1):
        plain = df.withColumn("o", (F.lag if step < 0 else F.lead)("v").over(w))
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, timeline.neighbour(df, ["k"], ["t", "i"], "v", "o", "t", step).collect()))
    plain = df.withColumn("o", F.max("v").over(w.rowsBetween(W.unboundedPreceding, 0)))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, timeline.running_max(df, ["k"], ["t", "i"], "v", "o", "t").collect()))


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", i) for i in range(500, 505)], "k string, i int")
    groups = left.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.join_groups(left, groups, "k", "i", "n", hot=100)
    assert sorted(map(tuple, got.select("k", "i", "n").collect())) == sorted(map(tuple, left.join(groups, "k").select("k", "i", "n").collect()))


def test_sample_sizes(spark):
    f = spark.createDataFrame([("big", f"f{i}") for i in range(6000)] + [("small", f"g{i}") for i in range(100)], "project string, file_path string")
    s = fl.sample_files(f)
    assert {r.project: r["count"] for r in s.groupBy("project").count().collect()} == {"big": 1200, "small": 100}
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, fl.sample_files(f.repartition(13)).collect()))
    h = F.sha2(F.concat("file_path", F.lit(":7")), 256)
    plain = f.where("project = 'big'").orderBy(h).limit(1200)
    assert s.where("project = 'big'").exceptAll(plain).isEmpty()


def test_documents_in_parts_hold_every_row_once(spark):
    e = spark.createDataFrame([("p", f"a.{i}", f"b.{i % 7}", "import", i) for i in range(100)], "project string, source string, target string, import_type string, line_number int")
    parts = graph.export_mermaid(e, part_rows=30).collect()
    assert len(parts) == 4 and all(p.text.startswith("graph LR\n") for p in parts)
    assert sorted(x for p in parts for x in p.text.split("\n")[1:]) == sorted(f"    a_{i} --> b_{i % 7}" for i in range(100))
    one = graph.export_dot(e, part_rows=10_000).collect()
    assert len(one) == 1 and one[0].text.endswith('";\n}') and '"a.1" -> "b.1"' in one[0].text
    items = spark.createDataFrame([("p", 0, f"f{i}", i, f"R{i % 3}", 0, "high", "t", "m") for i in range(90)],
                                  "project string, source int, file_path string, line_number int, rule_id string, pattern_idx int, severity string, rule_text string, message string")
    rules = reports.sarif_rules(items)
    docs = reports.sarif_document(reports.sarif_results(items, rules), rules, document_rows=30).collect()
    assert sum(d.result_count for d in docs) == 90 and {d.rule_count for d in docs} == {3}
    import json

    assert all(json.loads(d.document)["runs"][0]["results"] for d in docs)


def _blocks(spark, texts):
    return spark.createDataFrame([(f"b{i:03d}", "f", 1, 6, t) for i, t in enumerate(texts)], "block_id string, file_path string, start_line int, end_line int, content string")


def _sets(t):
    w = t.split()
    return frozenset(tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2)))


def test_similar_pairs_equal_brute_force(spark):
    random.seed(5)
    base = [" ".join(random.choices("abcdefghijklmnop", k=12)) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            w = b.split()
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = random.choice("xyz")
            texts.append(" ".join(w))
    texts += [base[0]] * 4 + ["a b"]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, f"b{i:03d}")
    keys = sorted(first, key=first.get)
    want = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            s, u = _sets(a), _sets(b)
            if len(s & u) / len(s | u) >= 0.7:
                want.add((first[a], first[b]))
    got = clones.similar_pairs(_blocks(spark, texts)).collect()
    assert {(r.block_id1, r.block_id2) for r in got if r.block_id1 != r.block_id2} == want and want
    n = texts.count(base[0])
    assert {r.pairs for r in got if r.block_id1 == r.block_id2 == first[base[0]]} == {n * (n - 1) // 2}
    lsh = {(r.block_id1, r.block_id2) for r in clones.similar_pairs_lsh(_blocks(spark, texts)).collect() if r.block_id1 != r.block_id2}
    assert lsh <= want and len(lsh) >= 0.8 * len(want)


def test_duplicates_as_stars(spark):
    b = _blocks(spark, ["x\ny"] * 5 + ["z"] + ["w"] * 2)
    d = clones.duplicates_exact(b).collect()
    assert len(d) == 7 and {(r.first_id, r.copies, r.pairs) for r in d} == {("b000", 5, 10), ("b006", 2, 1)}
    r = clones.duplication_ratio(b).collect()[0]
    assert r.duplicate_pairs == 11 and r.duplication_ratio == round(11 * 12 / 48, 6)


def test_normalize(spark):
    df = spark.createDataFrame([("x = 1\n# comment\ny = 2",)], "c string")
    assert df.select(clones.normalize("c")).collect()[0][0] == "x = 1\ny = 2"


def _components(edges):
    reach = {n: {n2 for s, n2 in edges if s == n} for n in {x for e in edges for x in e}}
    while True:
        new = {n: r | {z for y in r for z in reach.get(y, ())} for n, r in reach.items()}
        if new == reach:
            return {n for n in reach if n in reach[n]}, reach
        reach = new


def test_cycles_equal_brute_force(spark):
    random.seed(9)
    for size, m in ((12, 16), (12, 22)):
        edges = sorted({(f"n{random.randrange(size):02d}", f"n{random.randrange(size):02d}") for _ in range(m)})
        df = spark.createDataFrame(edges, "source string, target string")
        comp = graph.strong_components(df)
        nodes, reach = _components(edges)
        assert {r.node for r in graph.cycle_nodes(df, comp).collect()} == nodes
        label = {r.node: r.component for r in comp.collect()}
        for a in label:
            for b in label:
                assert (label[a] == label[b]) == (a == b or (b in reach[a] and a in reach[b]))
        want = set()

        def walk(path):
            for s, t in edges:
                if s == path[-1]:
                    if t == path[0]:
                        want.add(" -> ".join([*path, t]))
                    elif t > path[0] and t not in path and len(path) < 4:
                        walk([*path, t])

        for n in {x for e in edges for x in e}:
            walk([n])
        got = [r.cycle for r in graph.simple_cycles(df, 4, comp).collect()]
        assert sorted(got) == sorted(want)


def test_no_cycle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    assert graph.cycle_nodes(df).isEmpty() and graph.simple_cycles(df, 4).isEmpty()


def test_median_equals_plain_median(spark):
    from tesserine.operators import scores, selection

    random.seed(2)
    rows = [("a", random.gauss(0, 10)) for _ in range(301)] + [("b", float(random.randint(0, 3))) for _ in range(200)] + [("c", 5.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    rows += [("f", random.random()) for _ in range(400)] + [("f", 1e300), ("f", -1e300)] + [("g", x) for x in (0.0, -0.0, 5e-324, -5e-324, 2.5e-308)] + [("h", -2.0), ("h", -4.0)]
    df = spark.createDataFrame(rows, "name string, seconds double")
    want = {r.name: r.m for r in df.where("seconds is not null").groupBy("name").agg(F.percentile("seconds", 0.5).alias("m")).collect()}
    got = {r.name: r["median"] for r in selection.medians(df, "name", "seconds").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r.name: r.median_time for r in scores.timing_stats(df).collect()}["d"] == 0.0
    assert selection.medians(df.limit(0), "name", "seconds").isEmpty()


def test_bits_are_in_the_order_of_the_doubles(spark):
    import struct

    from tesserine.operators import selection

    random.seed(4)
    values = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), 1.0, 2.0, 0.5, 1 - 2**-53, 2 - 2**-52, 2.0**1023, 8.0, 1000.0, 1e23]
    values += [struct.unpack("<d", struct.pack("<Q", random.randrange(2047 << 52)))[0] for _ in range(3000)] + [2.0**e * (1 + k * 2**-52) for e in range(-1020, 1020, 17) for k in (0, 1)] + [2.0**e - 2.0**(e - 53) for e in range(-900, 1020, 13)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.ordered_bits(F.col("v")).alias("b"), selection.ordered_bits(-F.col("v")).alias("minus")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", r.v))[0]
        assert (r.b, r.minus) == (bits, -bits), r.v


def test_ranks_of_a_key_that_holds_most_rows(spark, monkeypatch):
    from tesserine.operators import selection, skew

    monkeypatch.setattr(skew.join_groups, "__defaults__", (50, "inner"))
    rows = [("hot", (i * 7919 % 10007) / 10007) for i in range(10007)] + [("cold", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    ranks = spark.createDataFrame([("hot", r) for r in (0, 17, 5003, 10006)] + [("cold", 0)], "k string, rank long")
    got = {(r.k, r["rank"]): r.v for r in selection.at_ranks(df, ranks, "k", "v").collect()}
    assert got == {("hot", r): r / 10007 for r in (0, 17, 5003, 10006)} | {("cold", 0): 3.0}


def _sliding(rng, words, size, step, n):
    """Overlapping windows of one text: each shares a third of its triples with the next, by Jaccard."""
    text = [rng.choice(words) for _ in range(size + step * n)]
    return [" ".join(text[i * step:i * step + size]) for i in range(n)]


def test_bounds_of_similar_pairs_leave_few_candidates_and_lose_none(spark):
    rng, words = random.Random(3), [f"w{i}" for i in range(400)]
    texts = _sliding(rng, words, 60, 30, 300)
    for t in texts[:60]:
        w = t.split()
        w[rng.randrange(60)] = "changed"
        texts.append(" ".join(w))
    sets = [_sets(t) for t in texts]
    contents = clones.distinct_contents(_blocks(spark, texts)).cache()
    for threshold in (0.3, 0.7):
        want = {(f"b{i:03d}", f"b{j:03d}") for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= threshold * len(a | b)}
        rows = setjoin.short_rows(contents, threshold).cache()
        likely = setjoin.likely(setjoin.prefix_pairs(rows, threshold), rows, threshold).count()
        assert len(want) <= likely <= 2 * len(want) + 30
        got = clones.similar_pairs(None, threshold, contents).collect()
        assert {(r.block_id1, r.block_id2) for r in got} == want and len(got) == len(want)


def test_minima_are_those_of_xxhash64(spark):
    contents = spark.createDataFrame([(1, [5, -7, 2**62]), (2, [-1]), (3, [0, 2**63 - 1, -2**63])], "key long, shingles array<long>")
    low = F.array(*[F.array_min(F.transform("shingles", lambda s: F.xxhash64(s, F.lit(k)))) for k in range(4)])  # noqa: B023
    got = {r.key: r.minima for r in setjoin.short_rows(contents, 0.7, 4).collect()}
    assert got == {r.key: r.m for r in contents.select("key", low.alias("m")).collect()}


def test_lsh_of_crowded_buckets_equals_the_plain_form(spark, monkeypatch):
    """Blocks that share a long passage crowd their buckets; only those that are near one another may become candidates."""
    rng, words = random.Random(4), [f"w{i}" for i in range(400)]
    shared = rng.choices(words, k=40)
    texts = [" ".join(shared + rng.choices(words, k=25)) for _ in range(120)]
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[:20]]
    blocks, made = _blocks(spark, texts), []
    verify = clones._verify
    monkeypatch.setattr(clones, "_verify", lambda pairs, *a: made.append(pairs.count()) or verify(pairs, *a))
    crowded = sorted(map(tuple, clones.similar_pairs_lsh(blocks).collect()))
    monkeypatch.setattr(clones, "CROWD", 10**9)
    assert crowded == sorted(map(tuple, clones.similar_pairs_lsh(blocks).collect())) and len(crowded) >= 18
    assert max(made) <= 60  # 9,730 pairs share buckets or could


def _used(folder):
    return sum(_size(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def _peak(folder, run):
    """Most bytes in a folder while something runs."""
    most, over = [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], _used(folder))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        return run(), most[0]
    finally:
        over.set()
        watcher.join()


def _size(path):
    try:
        return os.path.getsize(path)
    except OSError:
        return 0


@pytest.fixture(scope="module")
def families(spark):
    """Forty families of fifty near copies, and as many texts without any."""
    rng, words = random.Random(8), [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=150)
        texts += [" ".join(base[:k] + [f"x{k}"] + base[k + 1:]) for k in range(50)]
    texts += [" ".join(rng.choices(words, k=150)) for _ in range(2000)]
    return _blocks(spark, texts).withColumn("project", F.concat(F.lit("p"), F.substring("block_id", -1, 1))).localCheckpoint(), sum(map(len, texts))


def _disk(spark, run):
    """What an operator gives, and the most bytes it has in the shared folder and in shuffle files."""
    local, shared = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0], shared_dir(spark)
    before = _used(local), _used(shared)
    (rows, kept), most = _peak(local, lambda: _peak(shared, run))
    return rows, max(0, most - before[0]) + kept - before[1]


@pytest.mark.parametrize("query", ["similar_pairs_lsh", "similar_pairs", "pair_classify", "clone_summary"])
def test_disk_of_similar_pairs_is_a_small_multiple_of_the_text(spark, families, query):
    run = {"similar_pairs_lsh": lambda b: clones.similar_pairs_lsh(b).count(), "similar_pairs": lambda b: clones.similar_pairs(b).count(),
           "pair_classify": lambda b: clones.pair_classify(clones.similar_pairs(b)).where("is_duplicate AND is_similar").count(),
           "clone_summary": lambda b: clones.clone_summary(b, 3).where("kind = 'similar_pairs'").first().pairs}[query]
    rows, most = _disk(spark, lambda: run(families[0]))
    assert rows == 40 * 50 * 49 // 2 or query == "pair_classify" and 0 < rows < 40 * 50 * 49 // 2
    assert most <= 1.5 * families[1]


def test_pairs_of_tiles_and_of_several_homes_come_once(spark, monkeypatch):
    """Families larger than a tile, whose members meet in many homes."""
    rng, words = random.Random(9), [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=60) for _ in range(3)]
    texts = [" ".join(w if rng.random() > 0.03 else rng.choice(words) for w in b) for b in base for _ in range(60)]
    blocks = _blocks(spark, texts + texts[:5])
    sets = [_sets(t) for t in texts]
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(t, i)
    own = sorted(same.values())
    want = {(f"b{i:03d}", f"b{j:03d}") for i in own for j in own if i < j and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    monkeypatch.setattr(setjoin, "TILE", 7)
    monkeypatch.setattr(setjoin, "CHUNK", 50)
    monkeypatch.setattr(setjoin, "FLUSH", 500)
    for small in (1, 32):
        monkeypatch.setattr(setjoin, "SMALL", small)
        got = [(r.block_id1, r.block_id2) for r in clones.similar_pairs(blocks).where("block_id1 <> block_id2").collect()]
        assert set(got) == want and len(got) == len(want) > 1000
    lsh = [(r.block_id1, r.block_id2) for r in clones.similar_pairs_lsh(blocks).where("block_id1 <> block_id2").collect()]
    assert set(lsh) <= want and len(lsh) == len(set(lsh)) >= 0.9 * len(want)


def test_packed_entries_come_back():
    rng = np.random.default_rng(1)
    first, second = (rng.integers(0, 1 << 40, 5000, dtype=np.uint64) for _ in range(2))
    third = rng.integers(0, 1 << 16, 5000).astype(np.uint16)
    batches = list(setjoin._dealt(7, [first, second, third], (5, 5, 2)))
    back = [np.concatenate(c) for c in zip(*setjoin._parts(iter(batches), 5, 5, 2))]
    assert sorted(zip(*(c.tolist() for c in back))) == sorted(zip(first.tolist(), second.tolist(), third.tolist()))
    assert batches[0]["part"].to_pylist() == list(range(7))


def _plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = [i]
        for j, y in enumerate(b, 1):
            last.append(min(row[j] + 1, last[-1] + 1, row[j - 1] + (x != y)))
        row = last
    return row[-1]


def test_edit_distances_equal_the_plain_table(monkeypatch):
    rng = random.Random(6)
    text = lambda: "".join(rng.choices("abcdé😀 x", k=rng.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, rng.randrange(200)])))
    a = [text() for _ in range(200)]
    b = [text() if i % 3 else x[:len(x) // 2] + "q" + x[len(x) // 2 + 2:] for i, x in enumerate(a)]
    want = [_plain_distance(x, y) for x, y in zip(a, b)]
    for cost in (edits.LARGE, 1e9, -1e9):  # as it chooses, all together, each alone
        monkeypatch.setattr(edits, "LARGE", cost)
        assert edits.distances(a, b).tolist() == want
    got = edits.edit_distance(pa.array([None, *a, "a"]), pa.array(["a", *b, None])).to_pylist()
    assert got == [None, *want, None]


def test_long_lines_are_compared_in_seconds(spark):
    """Two lines of 40,000 characters: 1.6 billion cells."""
    rng = random.Random(7)
    df = spark.createDataFrame([("".join(rng.choices("abcdefgh ", k=40_000)),) * 2, ("x" * 40_000, "x" * 39_999 + "y")], "a string, b string")
    df = df.unionByName(df.select(F.col("a").alias("a"), F.reverse("a").alias("b"))).repartition(4)
    start = time.time()
    got = sorted(r.e for r in df.select(clones.pair_similarity("a", "b")[1].alias("e")).collect())
    assert got[-3:] == [0.999975, 1.0, 1.0] and time.time() - start < 12
