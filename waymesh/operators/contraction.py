"""Shortcuts by contraction of independent sets, and searches over them.

In each round the nodes of least priority among their neighbours are taken out
together; a shortcut keeps each way through one of them unless an edge or a way
of two edges is no longer.  What is left after the last round is the core.  A
search goes upwards only: forwards from the source and on all edges within the
core, backwards from the target as far as the core.
"""

from __future__ import annotations

import gc
import math
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.operators import fragments
from waymesh.operators.search import meet, shortest
from waymesh.session import cut, join_small, keep

CORE = 1_000_000


def contract(edges: DataFrame, rounds: int | None, most_degree: int | None = 12, parts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(levels, up): levels(node, level), and edges with shortcuts (base, adj, edge, w, skip1, skip2, via).

    edges(base, adj, edge, w).  Only nodes with at most ``most_degree``
    neighbours are contracted, so one hub never makes more pairs than that
    squared; ties are broken by a hash of the node.  Core nodes have level CORE.
    Without ``rounds`` nodes are taken out until none can be; without
    ``most_degree`` it is the mean number of neighbours, but at least 12.
    Without ``parts`` only base, adj and w of the edges are made, for searches
    that nobody wants to unpack.
    """
    more = ["edge", "skip1", "skip2", "via"] if parts else []
    none = F.lit(None).cast("bigint")
    least = lambda rows, *names: rows.groupBy("base", "adj").agg(F.min(F.struct("w", *names)).alias("b"))
    best = least(edges.filter("base <> adj"), *["edge"] * parts)
    left, _ = keep(best.select("base", "adj", "b.w", *([F.col("b.edge").alias("edge"), none.alias("skip1"), none.alias("skip2"), none.alias("via")] if parts else [])))
    everything, levels, remove = left, None, None  # the edges themselves stay
    for level in count() if rounds is None else range(rounds):
        both = left.select(F.col("base").alias("node"), F.col("adj").alias("other")).unionByName(left.select(F.col("adj").alias("node"), F.col("base").alias("other"))).repartition("node").distinct()
        degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
        if most_degree is None:
            most_degree = max(12, math.ceil(degree.agg(F.avg("d")).head()[0] or 0))
        rank = degree.select("node", F.struct("d", F.xxhash64("node").alias("h"), "node").alias("r"))
        low = both.join(rank, "node").groupBy(F.col("other").alias("node")).agg(F.min("r").alias("ro"))  # neighbours of each other
        pick = cut(rank.join(low, "node").filter((F.col("r.d") <= most_degree) & (F.col("r") < F.col("ro"))).select("node"))
        if not pick.head(1):
            break
        levels = pick.select("node", F.lit(level).alias("level")) if levels is None else levels.unionByName(pick.select("node", F.lit(level).alias("level")))
        on = lambda rows, c, how: join_small(rows, pick.select(F.col("node").alias(c)), c, how, made=True)
        into = on(left, "adj", "inner").select(F.col("base").alias("a"), F.col("adj").alias("node"), *([F.col("edge").alias("e1")] if parts else []), F.col("w").alias("w1"))
        out = on(left, "base", "inner").select(F.col("base").alias("node"), F.col("adj").alias("b"), *([F.col("edge").alias("e2")] if parts else []), F.col("w").alias("w2"))
        ways = into.join(out, "node").filter("a <> b").groupBy("a", "b").agg(F.min(F.struct((F.col("w1") + F.col("w2")).alias("w"), *(["node", "e1", "e2"] if parts else []))).alias("m"))
        rest = on(on(left, "base", "left_anti"), "adj", "left_anti").select("base", "adj", "w", *more)
        known = rest.select(F.col("base").alias("a"), F.col("adj").alias("b"), F.col("w").alias("direct"))
        new = ways.join(known, ["a", "b"], "left").filter("direct is null or m.w < direct")
        # a shortcut's id is a hash of its two parts, below zero to stay apart from edges
        ident = -F.shiftrightunsigned(F.xxhash64("m.e1", "m.e2"), 1) - 1 if parts else None
        new, _ = keep(new.select(F.col("a").alias("base"), F.col("b").alias("adj"), F.col("m.w").alias("w"), *([ident.alias("edge"), F.col("m.e1").alias("skip1"), F.col("m.e2").alias("skip2"), F.col("m.node").alias("via")] if parts else [])))
        everything = everything.unionByName(new)
        both_ = least(rest.unionByName(new), *more)
        before = remove
        left, remove = keep(both_.select("base", "adj", "b.w", *[f"b.{c}" for c in more]))
        if before:
            before()
        gc.collect()  # else shuffle files of all rounds stay until the driver collects its garbage
        edges.sparkSession.sparkContext._jvm.System.gc()
    nodes = edges.select(F.col("base").alias("node")).unionByName(edges.select(F.col("adj").alias("node"))).distinct()
    if levels is None:
        return nodes.select("node", F.lit(CORE).alias("level")), everything
    if remove:
        remove()
    levels = nodes.join(levels, "node", "left").select("node", F.coalesce("level", F.lit(CORE)).alias("level"))
    return cut(levels), everything


def hierarchy_search(levels: DataFrame, up: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, node, w) of pairs(source, target) by two upward searches and their best meeting node."""
    a, b = levels.select(F.col("node").alias("base"), F.col("level").alias("la")), levels.select(F.col("node").alias("adj"), F.col("level").alias("lb"))
    e = up.join(a, "base").join(b, "adj")
    forward = e.filter("lb >= la").select("base", "adj", "edge", "w")
    # the forward search covers the core, so the backward one need not: it would label the core once for each target
    backward = e.filter("la > lb").select(F.col("adj").alias("base"), F.col("base").alias("adj"), "edge", "w")
    there = shortest(forward, pairs.select("source").distinct())
    home = shortest(backward, pairs.select(F.col("target").alias("source")).distinct())
    return meet(there, home).join(pairs.select("source", "target").distinct(), ["source", "target"], "left_semi")


def sweep(levels: DataFrame, up: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, w) of all nodes that sources(source) reach: upwards and over the core, then down, level by level.

    For few sources and many targets, where ``hierarchy_search`` would search from each target.
    """
    a, b = levels.select(F.col("node").alias("base"), F.col("level").alias("la")), levels.select(F.col("node").alias("adj"), F.col("level").alias("lb"))
    e = up.join(a, "base").join(b, "adj")
    there = shortest(e.filter("lb >= la").select("base", "adj", "w"), sources.distinct())
    down = e.filter("la > lb").select(F.lit(0).alias("a"), "base", "adj", "w")
    labels, _ = fragments.search(down, there.select("source", F.lit(0).alias("a"), "node", "w", "hops"))
    return labels.select("source", "node", "w")


def unpack(up: DataFrame, wanted: DataFrame) -> DataFrame:
    """(edge, seq, part): the base edges of wanted(edge) in driving order; all shortcuts are opened once a round."""
    parts = up.select(F.col("edge").alias("e"), "skip1", "skip2")
    rows = cut(wanted.select("edge", F.array(F.lit(0)).alias("key"), F.col("edge").alias("part")))
    while True:
        j = rows.join(parts, F.col("part") == F.col("e"), "left")
        two = F.array(F.struct(F.lit(0).alias("i"), F.col("skip1").alias("p")), F.struct(F.lit(1).alias("i"), F.col("skip2").alias("p")))
        kids = F.when(F.col("skip1").isNotNull(), two).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.col("part").alias("p"))))
        rows = cut(j.select("edge", "key", F.explode(kids).alias("k")).select("edge", F.concat("key", F.array("k.i")).alias("key"), F.col("k.p").alias("part")))
        if not rows.filter("part < 0").head(1):
            from pyspark.sql import Window

            return rows.select("edge", F.row_number().over(Window.partitionBy("edge").orderBy("key")).alias("seq"), "part")
