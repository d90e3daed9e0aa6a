"""Cycles of directed graphs: strong components, and a shortest cycle through every edge that lies on one.

Rows moved per round are nodes and links. The number of rounds grows with the logarithm of the longest path:

* Runs of nodes with one way in and one way out become a single link first, by pointer jumping over their predecessors.
* Components come from pivots. Every node learns the highest-ranked node that reaches it and the highest one that it reaches; where both are the same, that is its
  component, and links between nodes that learnt different ones are cut. Ranks are hashes, new in each pass. What a node learns travels over links, over pointers that
  double their distance, and from the learnt node itself, which has learnt something too.
* Shortest cycles are sought from all links inside components at once; a search ends at the length of the cycle that it has found. Their rounds are the links of the
  longest shortest cycle after runs have been drawn together.

Self loops are cycles of length 1. A cycle is one value, so a task has to hold a cycle as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import stored

NODES = "array<string>"


def _counted(df: DataFrame, label: str, **counts) -> tuple[DataFrame, dict]:
    """Store a table; the counts come from the same job."""
    seen = Observation()
    out = stored(df.observe(seen, *(c.alias(k) for k, c in counts.items())), label)
    return out, seen.get


def drawn_together(edges: DataFrame) -> DataFrame:
    """(link, source, target, size, inner): distinct edges, with each run of nodes that have one way in and one way out as one link.

    ``size`` counts its edges, ``inner`` has the nodes between. A ring of such nodes becomes a loop at its smallest one.
    """
    edges = stored(edges.where("source <> target").select("source", "target").distinct(), "edges")
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    between = stored(ends.groupBy("e.node").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i")).where("o = 1 AND i = 1").select("node"), "between")
    # window of a node: itself and the nodes before it, back to but without ``up``; ``first`` is the one next to ``up``, ``low`` the smallest, ``at`` steps back
    run = edges.join(between.withColumnRenamed("node", "target"), "target").select(
        F.col("target").alias("node"), F.col("source").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("target").alias("first"), F.col("target").alias("low"), F.lit(0).cast("long").alias("at"))
    run = run.withColumn("open", F.lit(True))
    before = None
    while True:
        up = run.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("first").alias("first2"), F.col("low").alias("low2"), F.col("at").alias("at2"))
        lower = F.col("low2") < F.col("low")
        more = run.join(up, "up", "left").select(
            "node", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.coalesce("first2", "first").alias("first"),
            F.when(lower, F.col("low2")).otherwise(F.col("low")).alias("low"), F.when(lower, F.col("steps") + F.col("at2")).otherwise(F.col("at")).alias("at"),
            F.col("up2").isNotNull().alias("open"), F.coalesce(lower, F.lit(False)).alias("lowered"))
        run, now = _counted(more, "runs", open=F.count_if("open"), lowered=F.count_if("lowered"))
        run = run.drop("lowered")
        if not now["open"] or (now["open"] == before and not now["lowered"]):
            break  # what is still open goes round
        before = now["open"]
    closed = run.where("NOT open").select("node", F.col("up").alias("source"), "first", F.col("steps").alias("at"))
    rings = run.where("open AND at > 0").select("node", F.col("low").alias("source"), F.col("low").alias("first"), "at")
    chains = closed.unionAll(rings).groupBy("source", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("inner"))
    turned = between.join(rings.select(F.col("source").alias("node")).distinct(), "node", "left_anti")  # nodes at which no ring is fixed
    ahead = edges.join(turned.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("source").alias("last"), "target")
    links = chains.withColumn("last", F.element_at("inner", -1)).join(ahead, "last").select("source", "target", (F.size("inner") + 1).cast("long").alias("size"), "inner")
    plain = edges.join(turned.withColumnRenamed("node", "source"), "source", "left_anti").join(turned.withColumnRenamed("node", "target"), "target", "left_anti")
    links = plain.select("source", "target", F.lit(1).cast("long").alias("size"), F.array().cast(NODES).alias("inner")).unionAll(links)
    return stored(links.select(F.monotonically_increasing_id().alias("link"), "source", "target", "size", "inner"), "links")


def components_of(edges: DataFrame) -> DataFrame:
    """(node, component) of the components with more than one node, of distinct edges without loops."""
    edges, now = _counted(edges, "edges", n=F.count(F.lit(1)))
    found, turn = None, 0
    while now["n"]:
        links = edges.select(F.explode(F.array(*(F.struct(F.lit(way).alias("way"), F.col(a).alias("at"), F.col(b).alias("node")) for way, a, b in ((0, "source", "target"), (1, "target", "source"))))).alias("l")).select("l.*")
        links = stored(links, "ways")
        first = links.groupBy("way", "node").agg(F.min("at").alias("up")).unionAll(links.select("way", F.col("at").alias("node"), F.lit(None).cast("string").alias("up")))
        best = first.groupBy("way", "node").agg(F.max("up").alias("up")).select("way", "node", F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), F.col("node").alias("node")).alias("best"), "up")
        best = stored(best, "pivots")
        while True:
            best, seen = _counted(_learn(best, links), "pivots", changed=F.count_if("changed"))
            best = best.drop("changed")
            if not seen["changed"]:
                break
        side = lambda way: F.max(F.when(F.col("way") == way, F.col("best")))
        both = stored(best.groupBy("node").agg(side(0).alias("f"), side(1).alias("b")), "pivots")
        part = both.where("f = b").select("node", F.col("f.node").alias("component"))
        several = part.where("node <> component").select("component").distinct()
        part = part.join(several, "component", "left_semi").select("node", "component")
        found = part if found is None else found.unionByName(part)
        rest = both.where("f <> b")
        for end in ("source", "target"):
            edges = edges.join(rest.select(F.col("node").alias(end), F.struct("f", "b").alias(f"_{end}")), end)
        edges = edges.where("_source = _target").select("source", "target")
        edges, now = _counted(_inward(edges), "edges", n=F.count(F.lit(1)))
        turn += 1
    return edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0) if found is None else found


def _learn(best: DataFrame, links: DataFrame) -> DataFrame:
    over = links.join(best.select("way", F.col("node").alias("at"), "best"), ["way", "at"]).select("way", "node", "best", F.lit(None).cast("string").alias("up"), F.lit(None).cast("struct<rank:bigint,node:string>").alias("old"))
    up = best.select("way", F.col("node").alias("up"), F.col("best").alias("best2"), F.col("up").alias("up2"))
    own = best.join(up, ["way", "up"], "left").select("way", "node", F.greatest("best", "best2").alias("best"), F.col("up2").alias("up"), F.col("best").alias("old"))
    new = own.unionAll(over).groupBy("way", "node").agg(F.max("best").alias("best"), F.max("up").alias("up"), F.max("old").alias("old"))
    pivot = new.select("way", F.col("node").alias("pivot"), F.col("best").alias("best2"))
    new = new.withColumn("pivot", F.col("best.node")).join(pivot, ["way", "pivot"]).withColumn("best", F.greatest("best", "best2"))
    return new.select("way", "node", "best", "up", (F.col("best") != F.col("old")).alias("changed"))


def _inward(edges: DataFrame) -> DataFrame:
    """Without edges from nodes that have no way in, and to nodes that have no way out."""
    ins, outs = edges.select(F.col("target").alias("source")), edges.select(F.col("source").alias("target"))
    return edges.join(ins, "source", "left_semi").join(outs, "target", "left_semi").select("source", "target")


def _inside(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the links inside components, with ``component``; (node, component) of their ends)."""
    comp = stored(components_of(_inward(links.where("source <> target").select("source", "target").distinct())), "components")
    a, b = (comp.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in ("source", "target"))
    at = links.join(a, "source", "left").join(b, "target", "left")
    inside = at.where("source = target OR _source = _target").withColumn("component", F.coalesce("_source", "source")).drop("_source", "_target")
    return inside, comp


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every component with more than one node."""
    inside, comp = _inside(drawn_together(edges))
    return inside.select(F.explode(F.concat(F.array("source"), "inner")).alias("node"), "component").unionByName(comp).distinct()


def shortest_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, target, length), (cycle, length)): every edge that lies on a cycle with the length of the shortest one through it, and such a cycle for each.

    A cycle is an array of nodes that starts and ends with its smallest one, and comes once. Of several shortest cycles through u -> v that one counts
    whose nodes, from u backwards, come first in order.
    """
    links = drawn_together(edges)
    inside = stored(_inside(links)[0], "inside")
    last = F.coalesce(F.try_element_at("inner", F.lit(-1)), F.col("source"))
    steps = inside.where("source <> target").select("link", "source", F.col("target").alias("to"), "size", last.alias("last"))
    best = steps.select(F.col("link").alias("edge"), F.col("source").alias("home"), F.col("to").alias("node"),
                        F.struct(F.col("size").alias("length"), F.array("last").alias("back"), F.array("link").alias("links")).alias("way")).withColumn("fresh", F.lit(True))
    best, now = _counted(best, "ways", fresh=F.count(F.lit(1)))
    onward = steps.select(F.col("source").alias("node"), "to", "size", "last", F.col("link").alias("next"))
    while now["fresh"]:
        home = best.where("node = home").select("edge", F.col("way.length").alias("limit"))
        tip = best.where("fresh AND node <> home").join(home, "edge", "left").where("limit IS NULL OR way.length < limit").drop("limit")
        ahead = tip.join(onward, "node").select("edge", "home", F.col("to").alias("node"), F.struct(
            (F.col("way.length") + F.col("size")).alias("length"), F.concat(F.array("last"), "way.back").alias("back"), F.array_append("way.links", F.col("next")).alias("links")).alias("way"), F.lit(True).alias("fresh"))
        known = best.withColumn("fresh", F.lit(False))
        best = known.unionAll(ahead).groupBy("edge", "home", "node").agg(F.min(F.struct("way", "fresh")).alias("x")).select("edge", "home", "node", "x.way", "x.fresh")
        best, now = _counted(best, "ways", fresh=F.count_if("fresh"))
    loops = inside.where("source = target").select(F.col("link").alias("edge"), F.array("link").alias("links"), F.col("size").alias("length"))
    round_trips = best.where("node = home").select("edge", F.col("way.links").alias("links"), F.col("way.length").alias("length")).unionAll(loops)
    round_trips = stored(round_trips, "cycles")
    whole = inside.join(round_trips.select(F.col("edge").alias("link"), "length"), "link")
    path = F.concat(F.array("source"), "inner", F.array("target"))
    self_loops = edges.where("source = target").select("source").distinct()
    through = whole.select("length", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("inner") + 1), lambda i: F.struct(F.get(path, i - 1).alias("source"), F.get(path, i).alias("target"))))).select("col.source", "col.target", "length")
    through = through.unionByName(self_loops.select("source", F.col("source").alias("target"), F.lit(1).cast("long").alias("length")))
    # links of a cycle, then its nodes
    parts = round_trips.select("edge", F.posexplode("links").alias("i", "link")).join(inside.select("link", F.concat(F.array("source"), "inner").alias("nodes")), "link")
    cycles = parts.groupBy("edge").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "nodes"))), lambda x: x["nodes"])).alias("nodes"))
    at = F.array_position("nodes", F.array_min("nodes")).cast("int")
    turned = F.concat(F.slice("nodes", at, F.size("nodes")), F.slice("nodes", F.lit(1), at - 1), F.array(F.array_min("nodes")))
    cycles = cycles.select(turned.alias("cycle")).unionByName(self_loops.select(F.array("source", "source").alias("cycle"))).distinct()
    return through, cycles.select("cycle", (F.size("cycle") - 1).cast("long").alias("length"))
