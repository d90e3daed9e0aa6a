"""Components and shortest cycles, against searches in memory."""

import random

import pytest

from tesserine.operators import cycles


def plain_cycles(edges):
    """({edge: length of its shortest cycle}, {a cycle for each edge}); by levels from the edge's end back to its start."""
    after, through, found = {}, {}, set()
    for s, t in edges:
        after.setdefault(s, set()).add(t)
    for u, v in set(edges):
        back, level = {v: [v]}, {v: [v]}
        while level and u not in back:
            new = {}
            for x, path in level.items():
                for y in after.get(x, ()):
                    if y not in back and (y not in new or [y, *path] < new[y]):
                        new[y] = [y, *path]
            back |= new
            level = new
        if u in back:
            path = back[u][::-1]
            through[u, v] = len(path)
            at = path.index(min(path))
            found.add((*path[at:], *path[:at], path[at]))
    return through, found


def both(spark, edges):
    through, found = cycles.shortest_cycles(spark.createDataFrame(edges, "source string, target string"))
    return {(r.source, r.target): r.length for r in through.collect()}, {tuple(r.cycle) for r in found.collect()}


@pytest.mark.parametrize("seed", range(5))
def test_shortest_cycles_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    n = [5, 8, 14, 25, 25][seed]
    edges = [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range([12, 14, 28, 30, 60][seed])]
    ring = rng.randrange(2, 12)
    edges += [(f"r{i:02d}", f"r{(i + 1) % ring:02d}") for i in range(ring)] + [("r00", "n00")] * (seed % 2) + [("n01", f"r{ring - 1:02d}")] * (seed % 3)
    edges += [("n00", "x1"), ("x1", "x2"), ("x2", "x3"), ("x3", "n02"), ("n02", "y1"), ("y1", "n00"), ("z1", "z2"), ("z2", "z3")]  # runs between nodes, and one that leads nowhere
    assert both(spark, edges) == plain_cycles(edges)


def test_a_long_ring_takes_few_jobs(spark):
    n = 1000
    edges = [(f"n{i * 7919 % n:04d}", f"n{(i + 1) * 7919 % n:04d}") for i in range(n)] + [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(n)]
    spark.sparkContext.setJobGroup("ring", "ring")
    through, found = both(spark, edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ring"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(through) == n and set(through.values()) == {n} and [len(c) for c in found] == [n + 1]
    assert jobs < 100


def test_components_of_rings_with_bridges(spark):
    """Two long rings with shortcuts, joined one way only."""
    edges = [(f"{r}{i:03d}", f"{r}{(i + 1) % 60:03d}") for r in "ab" for i in range(60)] + [(f"{r}{i:03d}", f"{r}{(i * 7 + 3) % 60:03d}") for r in "ab" for i in range(0, 60, 4)] + [("a005", "b009"), ("b001", "c")]
    comp = {r.node: r.component for r in cycles.strong_components(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert len(comp) == 120 and {len({comp[f"{r}{i:03d}"] for i in range(60)}) for r in "ab"} == {1} and comp["a000"] != comp["b000"]


def test_no_edges_and_self_loops(spark):
    assert both(spark, [("a", "b"), ("b", "c"), ("a", "c")]) == ({}, set())
    assert both(spark, [("a", "a"), ("a", "a")]) == ({("a", "a"): 1}, {("a", "a")})
    empty = spark.createDataFrame([], "source string, target string")
    assert cycles.strong_components(empty).isEmpty() and all(d.isEmpty() for d in cycles.shortest_cycles(empty))
