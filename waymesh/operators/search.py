"""Shortest paths, trees and matrices, with and without turn costs, plain, goal-directed and from both ends.

All of them are label searches over fragments of the graph (``fragments``); a
call answers a table of sources or requests at once.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geo import haversine_m
from waymesh.operators import fragments, two_ended
from waymesh.session import cut


def _arcs(edges: DataFrame, both: bool = False) -> DataFrame:
    """Arcs of the first direction, and with ``both`` those against it."""
    zero = edges.select(F.lit(0).alias("a"), "base", "adj", "w")
    return zero.unionByName(edges.select(F.lit(1).alias("a"), F.col("adj").alias("base"), F.col("base").alias("adj"), "w")) if both else zero


def shortest(edges: DataFrame, sources: DataFrame, limit: int | None = None, rounds: int | None = None, goals: DataFrame | None = None, shared: DataFrame | None = None, fragment_arcs: int = fragments.FRAGMENT_ARCS) -> DataFrame:
    """(source, node, w, hops) from sources(source) over edges(base, adj, edge, w).

    All sources are searched at once.  ``limit`` keeps labels of at most that
    weight; ``rounds`` bounds the hops.  With goals(source, target), or
    shared(target) for all sources, a source is searched only as far as its
    farthest goal, and labels beyond it are left out; if one of its goals
    cannot be reached, all it reaches is labelled.  Of
    equally short ways the one with fewer hops counts.  Sources that are null
    are left out, and so are edges with a null end or weight; a source without
    edges reaches itself.
    """
    seeds = sources.filter(F.col("source").isNotNull()).select("source", F.lit(0).alias("a"), F.col("source").alias("node"), F.lit(0).alias("w"), F.lit(0).alias("hops")).distinct()
    labels, _ = fragments.search(_arcs(edges), seeds, limit=limit, rounds=rounds, goals=goals, shared=shared, fragment_arcs=fragment_arcs)
    return labels.select("source", "node", "w", "hops")


def turn_search(edges: DataFrame, sources: DataFrame, turns: DataFrame, u_turn_cost: int | None = None, limit: int | None = None, fragment_arcs: int = fragments.FRAGMENT_ARCS) -> DataFrame:
    """(source, edge, node, w): least weight of arriving over each directed edge, with turn costs.

    turns(from_edge, to_edge, cost): a null cost forbids the turn, a missing
    pair costs nothing; of several rows of one pair one that forbids holds,
    else the cheapest.  Going back over the edge one came by is forbidden
    unless ``u_turn_cost`` is given, whatever ``turns`` says.  The first edge
    has no turn.
    """
    listed = turns.select("from_edge", "to_edge", F.coalesce("cost", F.lit(-1)).cast("bigint").alias("cost")).filter("from_edge <> to_edge")
    if u_turn_cost is not None:
        back = edges.select(F.col("edge").alias("from_edge"), F.col("edge").alias("to_edge"), F.lit(u_turn_cost).cast("bigint").alias("cost")).distinct()
        listed = listed.unionByName(back)
    seeds = sources.distinct().join(edges, F.col("source") == F.col("base")).select("source", F.col("edge").alias("a"), F.col("adj").alias("node"), "w", F.lit(1).alias("hops"))
    labels, _ = fragments.search(edges.select(F.col("edge").alias("a"), "base", "adj", "w"), seeds, turns=listed, limit=limit, fragment_arcs=fragment_arcs, by_turns=True)
    return labels.select("source", F.col("a").alias("edge"), "node", "w")


def goal_search(edges: DataFrame, requests: DataFrame, features: DataFrame | None = None, both: bool = False, fragment_arcs: int = fragments.FRAGMENT_ARCS) -> tuple[DataFrame, DataFrame]:
    """Answers (request, source, target, w) to requests(request, source, target), and the labels (request, a, node, w) they took.

    Every request is a search of its own: from its source, or with ``both``
    from both ends at once.  features(node, f) of ``beeline_features`` or
    ``landmark_features`` direct it to its goal; without them it is the plain
    search that stops at the goal.  Requests without way, or with a null in
    them, have no answer; a request repeated under one id must be the same.
    """
    r = requests.select("request", "source", "target").filter("request is not null and source is not null and target is not null").distinct()
    seed = lambda a, node: r.select(F.col("request").alias("source"), F.lit(a).alias("a"), F.col(node).alias("node"), F.lit(0).alias("w"), F.lit(0).alias("hops"))
    seeds = seed(0, "source").unionByName(seed(1, "target")) if both else seed(0, "source")
    goals = r.select(F.col("request").alias("source"), "target")
    labels, best = fragments.search(_arcs(edges, both), seeds, goals=goals, features=features, both=both, fragment_arcs=fragment_arcs)
    answers = r.join(best.withColumnRenamed("source", "request"), "request").select("request", "source", "target", "w")
    return answers, labels.select(F.col("source").alias("request"), "a", "node", "w")


def pair_weights(edges: DataFrame, requests: DataFrame, features: DataFrame | None = None, both: bool = True, packed_arcs: int = two_ended.PACKED_ARCS, places: DataFrame | None = None) -> DataFrame:
    """(request, w) of requests(request, source, target): least weights without the labels they took.

    Up to ``packed_arcs`` arcs every request is searched from both ends in a
    task that holds the graph, and ``features`` narrow the search where they
    are few enough to be sent along; beyond that it is ``goal_search``.
    Requests are read as there.  places(node, lat, lon) may be given instead of
    features, for bounds by the great circle at the least weight a metre of
    all edges; positions that are null or no numbers count as not known.
    """
    if places is not None:
        places = places.filter("abs(lat) <= 90 and abs(lon) < double('infinity')")
    e = edges.select("base", "adj", "w").filter("base is not null and adj is not null and w is not null")
    n = e.count()
    if n > packed_arcs:
        if places is not None:
            features = beeline_features(places, least_rate(e, places))
        return goal_search(edges, requests, features, both)[0].select("request", "w")
    r = requests.select("request", "source", "target").filter("request is not null and source is not null and target is not null").distinct()
    if places is not None:
        features = places.select("node", F.array(F.radians("lat"), F.radians("lon")).alias("f"))
    if features is not None and (features.agg(F.sum(F.size("f"))).head()[0] or 0) > two_ended.PACKED_NUMBERS:
        features = None
    return two_ended.pair_weights(e, r, n, features, places=places is not None)


def least_rate(edges: DataFrame, places: DataFrame) -> float:
    """The least weight a metre of edges(base, adj, w) between places(node, lat, lon); 0 where an edge has an end without place, as nothing bounds its length."""
    side = lambda c, x: places.select(F.col("node").alias(c), F.col("lat").alias(f"la{x}"), F.col("lon").alias(f"lo{x}"))
    e = edges.join(side("base", "a"), "base", "left").join(side("adj", "b"), "adj", "left")
    metres = haversine_m(F.col("laa"), F.col("loa"), F.col("lab"), F.col("lob"))
    rate = F.when(metres.isNull(), 0.0).otherwise(F.col("w") / F.greatest(metres, F.lit(0.001)))
    return e.select(F.min(rate).alias("r")).head()["r"] or 0.0


def beeline_features(nodes: DataFrame, weight_per_metre: float) -> DataFrame:
    """Features of nodes(node, lat, lon) for bounds by the great circle; no edge may weigh less a metre than said."""
    return nodes.select("node", F.array(F.radians("lat"), F.radians("lon"), F.lit(float(weight_per_metre))).alias("f"))


def landmark_features(table: DataFrame) -> DataFrame:
    """Features of the nodes of a ``landmark_table`` for bounds by the triangle inequality.

    The numbers of landmarks are few by nature; more than 256 raise.
    """
    marks = sorted(r["landmark"] for r in table.select("landmark").distinct().limit(257).collect())
    if len(marks) > 256:
        raise ValueError("more than 256 landmarks")
    nan = F.lit(float("nan"))
    pick = lambda c, x: F.coalesce(F.max(F.when(F.col("landmark") == x, F.col(c).cast("double"))), nan)
    return table.groupBy("node").agg(F.array(*[pick(c, x) for x in marks for c in ("w_from", "w_to")]).alias("f"))


def active_landmarks(table: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(source, target, landmark, bound): the ``most`` landmarks that bound each of pairs(source, target) best, ties by id."""
    from pyspark.sql import Window

    s = table.select(F.col("node").alias("source"), "landmark", F.col("w_from").alias("sf"), F.col("w_to").alias("st"))
    t = table.select(F.col("node").alias("target"), "landmark", F.col("w_from").alias("tf"), F.col("w_to").alias("tt"))
    bound = F.greatest(F.lit(0), F.col("tf") - F.col("sf"), F.col("st") - F.col("tt")).cast("bigint")
    rows = pairs.distinct().join(s, "source").join(t, ["target", "landmark"]).withColumn("bound", bound)
    n = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("bound"), "landmark"))
    return rows.withColumn("n", n).filter(F.col("n") <= most).select("source", "target", "landmark", "bound")


def parents(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, node, edge, prev): of the edges that lie on a shortest way to a node the one with the smallest id.

    Weights above zero make this a tree; the source has no row.
    """
    e = edges.withColumnRenamed("w", "ew")
    at = labels.select("source", F.col("node").alias("base"), F.col("w").alias("bw"))
    to = labels.select("source", F.col("node").alias("adj"), F.col("w").alias("aw"))
    tight = at.join(e, "base").join(to, ["source", "adj"]).filter("bw + ew = aw and adj <> source")
    return tight.groupBy("source", F.col("adj").alias("node")).agg(F.min(F.struct("edge", "base")).alias("b")).select("source", "node", F.col("b.edge").alias("edge"), F.col("b.base").alias("prev"))


def extract_paths(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, target, seq, edge, node) of the ways to wanted(source, target), seq 1 at the source.

    Ways are walked from their targets all at once, one edge a round.  A target
    that cannot be reached, and a source itself, has no rows.
    """
    tree = tree.select("source", F.col("node").alias("at"), "edge", "prev").persist(StorageLevel.MEMORY_AND_DISK)
    front = wanted.select("source", "target", F.col("target").alias("node")).distinct()
    steps, back = None, 0
    while True:
        front = cut(front.join(tree, ["source"]).filter("node = at").select("source", "target", F.lit(back).alias("back"), "edge", "node", "prev") if back == 0 else front.join(tree, (front["source"] == tree["source"]) & (front["node"] == tree["at"])).select(front["source"], "target", F.lit(back).alias("back"), "edge", "node", "prev"))
        if not front.head(1):
            break
        done = front.select("source", "target", "back", "edge", "node")
        steps = done if steps is None else steps.unionByName(done)
        front = front.select("source", "target", F.col("prev").alias("node"))
        back += 1
    if steps is None:
        return front.select("source", "target", F.lit(0).alias("seq"), "edge", "node").limit(0)
    from pyspark.sql import Window

    last = F.max("back").over(Window.partitionBy("source", "target"))
    return steps.select("source", "target", (last - F.col("back") + 1).alias("seq"), "edge", "node")


def meet(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(source, target, node, w): the best meeting node of a forward and a backward search; ties by smallest node."""
    both = forward.select("source", "node", F.col("w").alias("fw")).join(backward.select(F.col("source").alias("target"), "node", F.col("w").alias("bw")), "node")
    best = both.groupBy("source", "target").agg(F.min(F.struct((F.col("fw") + F.col("bw")).alias("w"), "node")).alias("b"))
    return best.select("source", "target", F.col("b.node").alias("node"), F.col("b.w").alias("w"))


def isochrone_buckets(labels: DataFrame, limit: int, buckets: int) -> DataFrame:
    """Labels within ``limit`` with ``bucket`` 0..buckets-1 in equal steps; the limit itself is in the last one."""
    step = F.least(F.lit(buckets - 1), F.expr(f"cast((w * {buckets}) div {limit} as int)"))
    return labels.filter(F.col("w") <= limit).withColumn("bucket", step)


def frontier_edges(labels: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Edges with exactly one end within ``limit``; an end without label lies beyond."""
    inside = labels.filter(F.col("w") <= limit).select("node").distinct()
    a = edges.join(inside.select(F.col("node").alias("base"), F.lit(True).alias("a")), "base", "left")
    b = a.join(inside.select(F.col("node").alias("adj"), F.lit(True).alias("b")), "adj", "left")
    return b.filter(F.coalesce("a", F.lit(False)) != F.coalesce("b", F.lit(False))).select("edge", "base", "adj", "w")


def via_routes(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, legs, w, found) of requests(request, points array): legs are routed together and summed.

    A request with fewer than two points, or with a leg without way, is not found and has a null weight.
    """
    legs = requests.select("request", F.expr("transform(sequence(0, greatest(size(points) - 2, 0)), i -> struct(i as leg, get(points, i) as source, get(points, i + 1) as target))").alias("l"))
    legs = legs.select("request", F.explode("l").alias("l")).select("request", "l.leg", "l.source", "l.target")
    labels = shortest(edges, legs.select("source").distinct(), goals=legs.select("source", "target"))
    priced = legs.join(labels.select("source", F.col("node").alias("target"), "w"), ["source", "target"], "left")
    ok = F.count("w") == F.count(F.lit(1))
    return priced.groupBy("request").agg(F.count(F.lit(1)).alias("legs"), F.when(ok, F.sum("w")).alias("w"), ok.alias("found"))


def alternatives(edges: DataFrame, source: int, target: int, most: int = 2, stretch: float = 1.25) -> DataFrame:
    """(rank, via, w): the best way and other ways through a via node, up to ``stretch`` times as long.

    A via node counts once for each weight; of equal ones the smallest id.
    Weights tell ways apart: two ways of one weight are taken for the same.
    """
    spark = edges.sparkSession
    there = shortest(edges, spark.createDataFrame([(source,)], "source bigint")).select("node", F.col("w").alias("fw"))
    back = edges.select(F.col("adj").alias("base"), F.col("base").alias("adj"), "edge", "w")
    home = shortest(back, spark.createDataFrame([(target,)], "source bigint")).select("node", F.col("w").alias("bw"))
    total = there.join(home, "node").select("node", (F.col("fw") + F.col("bw")).alias("w"))
    best = total.agg(F.min("w").alias("best")).scalar()
    near = total.filter(F.col("w") <= best * stretch).groupBy("w").agg(F.min("node").alias("via"))
    from pyspark.sql import Window

    top = near.orderBy("w").limit(most)
    return top.select(F.row_number().over(Window.orderBy("w")).alias("rank"), "via", "w")


def landmark_table(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(node, landmark, w_from, w_to): weights from and to each landmark, null where there is no way."""
    frm = shortest(edges, landmarks.select(F.col("landmark").alias("source"))).select("node", F.col("source").alias("landmark"), F.col("w").alias("w_from"))
    back = edges.select(F.col("adj").alias("base"), F.col("base").alias("adj"), "edge", "w")
    to = shortest(back, landmarks.select(F.col("landmark").alias("source"))).select("node", F.col("source").alias("landmark"), F.col("w").alias("w_to"))
    return frm.join(to, ["node", "landmark"], "full")


def landmark_bound(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, bound): greatest triangle bound over all landmarks, at least 0, for pairs(source, target)."""
    s = table.select(F.col("node").alias("source"), "landmark", F.col("w_from").alias("sf"), F.col("w_to").alias("st"))
    t = table.select(F.col("node").alias("target"), "landmark", F.col("w_from").alias("tf"), F.col("w_to").alias("tt"))
    rows = pairs.join(s, "source").join(t, ["target", "landmark"])
    return rows.groupBy("source", "target").agg(F.greatest(F.lit(0), F.max(F.col("tf") - F.col("sf")), F.max(F.col("st") - F.col("tt"))).alias("bound"))


def farthest_landmarks(edges: DataFrame, start: int, count: int) -> list[int]:
    """Landmarks chosen one after the other, each the node farthest from those before it; ties by smallest id."""
    spark = edges.sparkSession
    chosen, seeds = [], [start]
    for _ in range(count):
        labels = shortest(edges, spark.createDataFrame([(x,) for x in seeds], "source bigint"))
        far = labels.groupBy("node").agg(F.min("w").alias("w")).orderBy(F.desc("w"), "node").head()
        if far is None or far["node"] in chosen:
            break
        chosen.append(far["node"])
        seeds = chosen
    return chosen
