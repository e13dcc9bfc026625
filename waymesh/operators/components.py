"""Connected components of directed graphs, and marking of small ones."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.session import cut


def weak_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable over links(a, b) in either direction.

    Alternates hooking (take the smallest label among neighbours) and jumping
    (take the label of one's label), so rounds grow with the logarithm of the
    diameter.  A hub is one row a round on either side: neighbours are
    aggregated map-side before they are shuffled.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct().repartition(F.col("a")).persist(StorageLevel.MEMORY_AND_DISK)
    state = cut(nodes.select("node", F.col("node").alias("c")).distinct())
    while True:
        seen = both.join(state.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        hooked = cut(state.join(seen, "node", "left").select("node", F.col("c").alias("was"), F.least("c", F.coalesce("m", F.col("c"))).alias("c")))
        # the smallest label wanted by any member moves the root it points at, too
        lift = hooked.groupBy(F.col("was").alias("node")).agg(F.min("c").alias("m"))
        hooked = hooked.join(lift, "node", "left").select("node", "was", F.least("c", F.coalesce("m", F.col("c"))).alias("c"))
        up = hooked.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        nxt = cut(hooked.join(up, "c", "left").select("node", "was", F.least("c", F.coalesce("cc", F.col("c"))).alias("c")))
        if not nxt.filter("c <> was").head(1):
            both.unpersist()
            return nxt.select("node", F.col("c").alias("component"))
        state = nxt.select("node", "c")


def strong_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node of the strongly connected component.

    Rounds of colouring: every node takes the smallest label that reaches it;
    what reaches its own colour's root backwards inside the colour is the
    root's component.  Nodes without in- or out-links inside what is left are
    components of their own and are trimmed first.
    """
    left = cut(nodes.select("node").distinct())
    edges = cut(links.select("a", "b").filter("a <> b").distinct())
    parts = None
    while left.head(1):
        while True:  # trim
            inner = edges.select("a").distinct().intersect(edges.select("b").distinct()).select(F.col("a").alias("node"))
            single = cut(left.join(inner, "node", "left_anti"))
            if not single.head(1):
                break
            done = single.select("node", F.col("node").alias("component"))
            parts = done if parts is None else parts.unionByName(done)
            left = cut(left.join(inner, "node", "left_semi"))
            edges = cut(edges.join(left.select(F.col("node").alias("a")), "a", "left_semi").join(left.select(F.col("node").alias("b")), "b", "left_semi"))
        if not left.head(1):
            break
        colour = cut(left.select("node", F.col("node").alias("c"), F.lit(True).alias("fresh")))
        while colour.filter("fresh").head(1):
            push = colour.filter("fresh").join(edges, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("c").alias("m"))
            colour = cut(colour.join(push, "node", "left").select("node", F.least("c", F.coalesce("m", F.col("c"))).alias("c"), (F.coalesce("m", F.col("c")) < F.col("c")).alias("fresh")))
        colour = colour.select("node", "c")
        inside = cut(edges.join(colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").filter("ca = cb").select("a", "b"))
        hit = cut(colour.filter("node = c").select("node", "c", F.lit(True).alias("fresh")))
        while hit.filter("fresh").head(1):
            back = hit.filter("fresh").join(inside, F.col("node") == F.col("b")).select(F.col("a").alias("node"), "c").distinct()
            new = back.join(hit, "node", "left_anti").withColumn("fresh", F.lit(True))
            hit = cut(hit.withColumn("fresh", F.lit(False)).unionByName(new))
        done = hit.select("node", F.col("c").alias("component"))
        parts = done if parts is None else parts.unionByName(done)
        left = cut(left.join(hit, "node", "left_anti"))
        edges = cut(edges.join(left.select(F.col("node").alias("a")), "a", "left_semi").join(left.select(F.col("node").alias("b")), "b", "left_semi"))
    return parts if parts is not None else left.select("node", F.col("node").alias("component"))


def mark_subnetworks(components: DataFrame, least: int) -> DataFrame:
    """(node, component, size, subnetwork): subnetwork is true for components of fewer than ``least`` nodes."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return components.join(sizes, "component").select("node", "component", "size", (F.col("size") < least).alias("subnetwork"))
