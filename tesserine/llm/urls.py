"""URL filter: given rules, then a tree of path templates per host, in DataFrame functions only.

URLs are first counted by (host, shape), the shape being up to ``DEPTH`` path segments with digit runs as ``#`` and what follows as ``**``; from there on everything works on
shapes, of which a host with a third of all pages has no more than another. Level by level, segments too rare are variable and become ``*``: those of fewer than
``OWN_URLS`` URLs, and those with neither ``OWN_PERCENT`` of their parent's nor ``MANY_URLS``, unless their labels, or those of a path below them, differ from their siblings'. The URLs that a rule judges are the labels: each branch has a rate of blocked ones, smoothed towards its parent's; a branch whose rate does not differ
significantly from its siblings' merges with them and takes the parent's rate. URLs without a rule are blocked where the rate of their template reaches ``PURITY``.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and the verdict of that template; repeated rows are judged alike and counted each; an
empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.tables import kept, need

DEPTH = 3
#: A segment is its own branch with at least so many URLs and so many percent of its parent's, or with so many URLs whatever its parent has.
OWN_URLS, OWN_PERCENT = 5, 2
MANY_URLS = 50
#: Weight of the parent's rate in labelled URLs; deviation, in standard errors, from which branches differ; blocked rate that rejects a template.
WEIGHT, DIFFER, PURITY = 10.0, 1.96, 0.7
Rule = tuple[str, str, str]  # host, path, verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict; null where none does. The list is a setting of a few rules."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def shape() -> Column:
    """Up to DEPTH segments of the path; deeper ones are one ``**``."""
    segments = F.filter(F.split(F.regexp_replace("path", "[0-9]+", "#"), "/"), lambda s: s != "")
    return F.when(F.size(segments) > DEPTH, F.concat(F.slice(segments, 1, DEPTH), F.array(F.lit("**")))).otherwise(segments)


def differs(labelled: str, blocked: str, all_labelled: str, all_blocked: str) -> Column:
    """Two-proportion test of a branch against the rest of all, multiplied out; false where either has no labels."""
    l, b, all_l, all_b = (F.col(c).cast("double") for c in (labelled, blocked, all_labelled, all_blocked))
    return F.pow(b * (all_l - l) - (all_b - b) * l, 2) * all_l > DIFFER**2 * all_b * (all_l - all_b) * l * (all_l - l)


def apart(done: DataFrame, d: int) -> DataFrame:
    """(host, template, _s) of the segments at ``d`` whose labels, or those of a path below, differ from the same of their siblings, or that alone have labels.

    Where no sibling has labels on the same path, the path is held against all labels of the siblings."""
    labelled = done.where("_s IS NOT NULL AND labelled > 0")
    paths = labelled.withColumn("_k", F.explode(F.expr(f"transform(sequence(0, size(shape) - {d + 1}), k -> slice(shape, {d + 2}, k))")))
    mine = kept(paths.groupBy("host", "template", "_s", "_k").agg(F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b")), "labelled")
    same = mine.groupBy("host", "template", "_k").agg(F.sum("_l").alias("_kl"), F.sum("_b").alias("_kb"))
    whole = mine.where("size(_k) = 0")
    rest = whole.groupBy("host", "template").agg(F.sum("_l").alias("_al"), F.sum("_b").alias("_ab"))
    own = whole.select("host", "template", "_s", F.col("_l").alias("_wl"), F.col("_b").alias("_wb"))
    both = mine.join(same, ["host", "template", "_k"]).join(rest, ["host", "template"]).join(own, ["host", "template", "_s"])
    # the path against all labels of the siblings: their sums, and the path's own added
    both = both.withColumns({"_ol": F.expr("_al - _wl + _l"), "_ob": F.expr("_ab - _wb + _b")})
    found = (F.col("_al") == F.col("_wl")) | F.when(F.col("_kl") > F.col("_l"), differs("_l", "_b", "_kl", "_kb")).otherwise(differs("_l", "_b", "_ol", "_ob"))
    return both.where(found).select("host", "template", "_s", F.lit(True).alias("_apart")).distinct()


def templates(urls: DataFrame) -> DataFrame:
    """(host, shape, template, rate) of all shapes of ``urls`` (host, shape, label: blocked 1, allowed 0, else null)."""
    level = kept(urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")), "shapes")
    totals = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    root = level.groupBy("host").agg(*totals)
    rates = [root.select("host", F.array().cast("array<string>").alias("template"), "n", "labelled", "blocked", ((F.col("blocked") + WEIGHT / 2) / (F.col("labelled") + WEIGHT)).alias("rate"))]
    done = level.select("host", "shape", F.array().cast("array<string>").alias("template"), "n", "labelled", "blocked")
    for d in range(DEPTH + 1):
        # siblings below each (host, template so far): sums with map-side combination, then small joins
        segment = F.get("shape", F.lit(d))
        done = done.withColumn("_s", segment)
        children = done.where("_s IS NOT NULL").groupBy("host", "template", "_s").agg(F.sum("n").alias("_n"))
        parents = children.groupBy("host", "template").agg(F.sum("_n").alias("_all"))
        large = (100 * F.col("_n") >= OWN_PERCENT * F.col("_all")) | (F.col("_n") >= MANY_URLS)
        named = children.where(F.col("_n") >= OWN_URLS).join(parents, ["host", "template"]).join(apart(done, d), ["host", "template", "_s"], "left").where(large | F.col("_apart")).select("host", "template", "_s", F.lit(True).alias("_own"))
        done = done.join(named, ["host", "template", "_s"], "left")
        grown = F.when(F.col("_s").isNull(), F.col("template")).otherwise(F.concat("template", F.array(F.when(F.col("_own"), F.col("_s")).otherwise(F.lit("*")))))
        done = kept(done.select("host", "shape", grown.alias("template"), "n", "labelled", "blocked"), "shapes")
        below = done.where(F.size("template") == d + 1).groupBy("host", "template").agg(*totals).withColumn("_up", F.slice("template", 1, d))
        up = rates[-1].select("host", F.col("template").alias("_up"), F.col("labelled").alias("_l"), F.col("blocked").alias("_b"), F.col("rate").alias("_r"))
        both = below.join(up, ["host", "_up"])
        own = (F.col("blocked") + WEIGHT * F.col("_r")) / (F.col("labelled") + WEIGHT)
        rates.append(kept(both.select("host", "template", "n", "labelled", "blocked", F.when(differs("labelled", "blocked", "_l", "_b"), own).otherwise(F.col("_r")).alias("rate")), "rates"))
    return done.select("host", "shape", "template").join(reduce(DataFrame.unionAll, rates).select("host", "template", "rate"), ["host", "template"])


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, rate) of every URL."""
    host, path = host_and_path(F.col(url_col))
    urls = need(pages, id_col, url_col).select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(rules)
    urls = kept(urls.select("*", shape().alias("shape"), rule.alias("rule"), verdict.alias("_given")), "urls")
    label = F.when(F.col("_given") == "block", 1).when(F.col("_given") == "allow", 0)
    found = kept(templates(urls.withColumn("label", label)), "templates")
    return urls.join(found, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("_given", F.when(F.col("rate") >= PURITY, "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.round("rate", 6).alias("rate"))
