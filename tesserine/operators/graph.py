"""Import graph: edges, degrees, cycles, exports. A graph belongs to a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage, stored
from . import files as fl
from . import skew
from .cycles import shortest_cycles, strong_components
from .tops import first_per

# FIXED VALUES: import patterns per language, on stripped lines.
IMPORTS = {
    "python": [(r"^import\s+(\S+)", "import"), (r"^from\s+([\w.]+)\s+import", "from_import")],
    "javascript": [(r"require\s*\(\s*['\"]([^\"']+)['\"]", "require"), (r"import\s+.*from\s+['\"]([^\"']+)['\"]", "import"),
                   (r"import\s+['\"]([^\"']+)['\"]", "import")],
    "go": [(r"\"([^\"]+)\"", "include")],
}
IMPORTS["typescript"] = IMPORTS["javascript"]


def dep_edges(files: DataFrame) -> DataFrame:
    """One edge per matching regex and line."""
    base = files.select("project", "file_path", fl.language("file_path", "dependency", fold_case=False).alias("_lang"), "content")
    base = base.where(F.col("_lang").isin(list(IMPORTS))).withColumn(
        "_l", F.transform(tx.numbered("content"), lambda x: F.struct(x["n"].alias("n"), tx.strip(x["line"]).alias("s"))))
    parts = []
    for lang, rules in IMPORTS.items():
        for p, kind in rules:
            hit = F.transform(F.filter(F.col("_l"), lambda x: x["s"].rlike(tx.regex(p))), lambda x: F.struct(
                F.regexp_extract(x["s"], tx.regex(p), 1).alias("target"), F.lit(kind).alias("import_type"), x["n"].alias("line_number")))
            parts.append(F.when(F.col("_lang") == lang, hit))
    rows = F.flatten(F.filter(F.array(*parts), lambda a: a.isNotNull()))
    return base.select("project", tx.module_name("file_path").alias("source"), F.explode(rows).alias("e")).select("project", "source", "e.*")


def modules(files: DataFrame) -> DataFrame:
    return files.select("project", tx.module_name("file_path").alias("module_name"), "file_path",
                        F.coalesce(fl.language("file_path", "dependency", fold_case=False), F.lit("unknown")).alias("language"))


def dep_nodes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Every module of the files, and modules outside of them that are imported."""
    m, key = modules(files), ["project", "module_name"]
    both = m.join(degrees(edges), key, "full")
    return both.select(*key, F.coalesce("file_path", F.lit("(external)")).alias("file_path"), F.coalesce("language", F.lit("unknown")).alias("language"),
                       F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def dep_hubs(edges: DataFrame, n: int, graph: str = "project") -> DataFrame:
    """The n most imported modules of each graph."""
    return first_per(edges.groupBy(graph, "target").agg(F.count("*").alias("in_count")), graph, [F.col("in_count").desc(), "target"], n)


def degrees(edges: DataFrame) -> DataFrame:
    """(project, module_name, out_degree, in_degree): both ends of each edge, summed once with map-side combination."""
    ends = F.array(F.struct(F.col("source").alias("module_name"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("module_name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select("project", F.explode(ends).alias("e")).groupBy("project", "e.module_name").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def dep_roots(edges: DataFrame) -> DataFrame:
    """Modules that import and are imported by nobody."""
    return degrees(edges).where("out_degree > 0 AND in_degree = 0").select("project", "module_name")


def dep_coupling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Out-count over the project's number of nodes."""
    total = nodes.groupBy("project").agg(F.count("*").alias("total"))
    out = edges.groupBy("project", F.col("source").alias("module_name")).agg(F.count("*").alias("out_count"))
    return skew.join_groups(out, total, "project", "module_name", "total").select("project", "module_name", "out_count",
                                             tx.round_even(F.col("out_count") / F.col("total"), 3).alias("coupling"))


def page_links(pages: DataFrame) -> DataFrame:
    href = F.regexp_extract_all("html", F.lit("href=\"([^\"]*)\""), F.lit(1))
    return pages.select(F.col("url").alias("source"), F.explode(href).alias("target"))


def import_frequency(imports: DataFrame) -> DataFrame:
    """Counts per module; the total row (module null) also counts distinct modules."""
    per = imports.groupBy("module").agg(F.count("*").alias("imports"))
    total = per.agg(F.sum("imports").alias("imports"), F.count("*").alias("unique_modules"))
    return per.withColumn("unique_modules", F.lit(1).cast("long")).unionByName(
        total.select(F.lit(None).cast("string").alias("module"), "imports", "unique_modules"))


# ---- cycles -----------------------------------------------------------------


def cycle_nodes(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Nodes that reach themselves."""
    comp = strong_components(edges) if components is None else components
    loops = edges.where(F.col("source") == F.col("target")).select(F.col("source").alias("node"))
    return comp.select("node").unionByName(loops).distinct()


def simple_cycles(edges: DataFrame, max_length: int, components: DataFrame | None = None) -> DataFrame:
    """Every simple cycle of at most ``max_length`` edges once, starting at its smallest node.

    There can be exponentially many, so the length is the caller's choice; :func:`strong_components` is complete whatever the length.
    """
    comp = strong_components(edges) if components is None else components
    c = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    loops = edges.where(F.col("source") == F.col("target")).select("source").distinct().select(
        F.array("source", "source").alias("path"))
    inner = cut_lineage(edges.where(F.col("source") != F.col("target")).select("source", "target").distinct()
                        .join(c("source"), "source").join(c("target"), "target")
                        .where(F.col("_source") == F.col("_target")).select("source", "target"))
    paths = inner.where(F.col("target") > F.col("source")).select(
        F.col("source").alias("start"), F.col("target").alias("last"), F.array("source", "target").alias("path"))
    out = loops
    for length in range(2, max_length + 1):
        nxt = paths.join(inner, paths["last"] == inner["source"]).drop("source")
        out = out.unionByName(nxt.where(F.col("target") == F.col("start")).select(F.array_append("path", F.col("target")).alias("path")))
        if length < max_length:
            paths = nxt.where((F.col("target") > F.col("start")) & ~F.array_contains("path", F.col("target"))).select(
                "start", F.col("target").alias("last"), F.array_append("path", F.col("target")).alias("path"))
    return out.select(F.array_join("path", " -> ").alias("cycle"), (F.size("path") - 1).alias("length"))


SEPARATOR = "\u001f"


def project_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((project, node), (project, source, target, length), (project, cycle, length)) of edges that carry their project: nodes that reach themselves, edges that lie
    on a cycle with the length of the shortest one through them, and such a cycle for each. All projects advance together, and none reaches another."""
    node = lambda c: F.concat_ws(SEPARATOR, F.coalesce("project", F.lit("")), c)
    keyed = edges.select(node(F.col("source")).alias("source"), node(F.col("target")).alias("target"))
    project, name = (lambda c: F.substring_index(c, SEPARATOR, 1)), (lambda c: F.regexp_replace(c, f"^[^{SEPARATOR}]*{SEPARATOR}", ""))
    through, cycles = shortest_cycles(keyed)
    through = stored(through.select(project("source").alias("project"), name("source").alias("source"), name("target").alias("target"), "length"), "through")
    cycles = cycles.select(project(F.col("cycle")[0]).alias("project"), F.array_join(F.transform("cycle", name), " -> ").alias("cycle"), "length")
    return through.select("project", F.col("source").alias("node")).distinct(), through, cycles


# ---- exports ----------------------------------------------------------------

def _documents(edges: DataFrame, line, head: str, tail: str, part_rows: int) -> DataFrame:
    """Text per graph in parts of bounded size; parts are cut by a hash of the source module."""
    sized = edges.groupBy("project").agg(F.count("*").alias("_n"), F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "source", "target", F.col("line_number").cast("string")), 256), 1, 8), 16, 10).cast("long")
    cut = skew.join_groups(edges, sized, "project", "source", "_n").withColumn("part", (h % F.col("parts")).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("source", "target", "line_number", "import_type")))
    body = F.transform(rows, lambda e: line(e))
    pieces = F.concat(F.array(*[F.lit(x) for x in head.split("\n")]), body, F.array(*[F.lit(tail)] if tail else []).cast("array<string>"))
    return cut.groupBy("project", "part", "parts").agg(F.array_join(pieces, "\n").alias("text"))


def export_mermaid(edges: DataFrame, part_rows: int) -> DataFrame:
    """Complete documents of about ``part_rows`` edges; part and parts are always there."""
    dots = lambda c: F.replace(c, F.lit("."), F.lit("_"))
    return _documents(edges, lambda e: F.concat(F.lit("    "), dots(e["source"]), F.lit(" --> "), dots(e["target"])), "graph LR", "", part_rows)


def export_dot(edges: DataFrame, part_rows: int) -> DataFrame:
    return _documents(edges, lambda e: F.concat(F.lit('    "'), e["source"], F.lit('" -> "'), e["target"], F.lit('";')),
                      "digraph dependencies {\n    rankdir=LR;", "}", part_rows)
