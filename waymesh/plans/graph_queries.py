"""Searches, components and rules over the derived road network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.operators import components, search
from waymesh.plans import derived, rules
from waymesh.plans.derived import BASE_SQL

ROAD_CLASSES = {"URGENT", "HIGH", "MEDIUM", "NOT_SPECIFIED", "LOW"}
MODEL = {
    "speed": [{"if": "true", "limit_to": "100"}, {"if": "road_class == LOW", "multiply_by": "0.5"}, {"else_if": "road_env == 'F'", "limit_to": "80"}],
    "priority": [{"if": "road_class == URGENT", "multiply_by": "0.5"}],
}


def context() -> rules.Context:
    return rules.Context(
        {"road_class": "enum", "road_env": "enum", "year": "number", "w": "number"},
        {"road_class": ROAD_CLASSES, "road_env": {"F", "O", "P"}},
        {"south": F.col("src") % 10 < 3},
        F.col("w").cast("double"),
        {"backward_road_class": "road_class", "prev_year": "year"},
    )


def _e(spark: SparkSession, d: str, reverse: bool = False) -> DataFrame:
    return derived.directed(derived.edges(spark, d), F.col("w"), reverse)


def _sources(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "source bigint")


def sssp_dijkstra(spark, d):
    return search.shortest(_e(spark, d), _sources(spark, 1)).select("node", "w")


def sssp_reverse_flow(spark, d):
    return search.shortest(_e(spark, d, True), _sources(spark, 1)).select("node", "w")


def sssp_multi_source_matrix(spark, d):
    return search.shortest(_e(spark, d), _sources(spark, 1, 2, 3)).select("source", "node", "w")


def sssp_hop_bounded(spark, d):
    return search.shortest(_e(spark, d), _sources(spark, 1), rounds=3).select("node", "w")


def sssp_rule_model(spark, d):
    m = rules.compile_model(MODEL, context())
    edges = derived.edges(spark, d)
    weight = F.floor(rules.edge_weight(m, F.col("w").cast("double")) * 10)
    return search.shortest(derived.directed(edges, weight), _sources(spark, 1)).select("node", "w")


def spt_limit(spark, d):
    return search.shortest(_e(spark, d), _sources(spark, 5), limit=250_000).select("node", "w")


def spt_tree(spark, d):
    e = _e(spark, d)
    labels = search.shortest(e, _sources(spark, 5))
    return search.parents(labels, e).select("node", "edge", "prev")


def isochrone_buckets(spark, d):
    labels = search.shortest(_e(spark, d), _sources(spark, 5), limit=400_000)
    return search.isochrone_buckets(labels, 400_000, 5).groupBy("bucket").agg(F.count(F.lit(1)).alias("nodes"), F.max("w").alias("farthest"))


def isochrone_frontier_edges(spark, d):
    e = _e(spark, d)
    return search.frontier_edges(search.shortest(e, _sources(spark, 5), limit=200_000), e, 200_000).select("edge", "base", "adj")


def path_extract(spark, d):
    e = _e(spark, d)
    labels = search.shortest(e, _sources(spark, 5))
    wanted = spark.createDataFrame([(5, 17), (5, 99)], "source bigint, target bigint")
    return search.extract_paths(search.parents(labels, e), wanted).select("target", "seq", "edge", "node")


def via_route_totals(spark, d):
    req = spark.createDataFrame([(1, [5, 17, 99]), (2, [3, 8]), (3, [7])], "request bigint, points array<bigint>")
    return search.via_routes(_e(spark, d), req).filter("legs > 0 and found").select("request", "legs", "w")


def bidir_meet(spark, d):
    return search.meet(search.shortest(_e(spark, d), _sources(spark, 5)), search.shortest(_e(spark, d, True), _sources(spark, 99))).select("w")


def edge_based_sssp_turns(spark, d):
    e = _e(spark, d)
    a, b = e.select(F.col("edge").alias("from_edge"), F.col("adj").alias("via")), e.select(F.col("edge").alias("to_edge"), F.col("base").alias("via"))
    turns = a.join(b, "via").select("from_edge", "to_edge", F.when((F.col("from_edge") * 31 + F.col("to_edge")) % 17 == 0, None).otherwise((F.col("from_edge") + F.col("to_edge")) % 3 * 1000).alias("cost"))
    got = search.turn_search(e, _sources(spark, 5), turns.filter("cost is null or cost > 0"))
    return got.groupBy("node").agg(F.min("w").alias("w"))


def alternatives_via_node(spark, d):
    return search.alternatives(_e(spark, d), 5, 99, 3, 1.5).select("rank", "w")


def landmark_bounds(spark, d):
    table = search.landmark_table(_e(spark, d), spark.createDataFrame([(1,), (40,), (77,)], "landmark bigint"))
    pairs = derived.nodes(spark, d).select(F.lit(5).cast("bigint").alias("source"), F.col("node").alias("target"))
    return search.landmark_bound(table, pairs).select("target", "bound")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """A route for each supplier."""
    k, n = F.col("s_suppkey"), derived.node_count(spark, d)
    return derived.table(spark, d, "supplier").select(k.cast("bigint").alias("request"), (k * 7 % n + 1).cast("bigint").alias("source"), (k * 31 % n + 1).cast("bigint").alias("target"))


def _routed(spark: SparkSession, d: str, features: DataFrame | None, both: bool) -> DataFrame:
    return search.pair_weights(_e(spark, d), _requests(spark, d), features, both)


def dijkstra_to_target(spark, d):
    return _routed(spark, d, None, False)


def bidirectional_dijkstra(spark, d):
    return _routed(spark, d, None, True)


def _beeline(spark: SparkSession, d: str, both: bool) -> DataFrame:
    at = derived.nodes(spark, d).select("node", (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"))
    return search.pair_weights(_e(spark, d), _requests(spark, d), both=both, places=at)


def astar_beeline(spark, d):
    return _beeline(spark, d, False)


def bidirectional_astar_beeline(spark, d):
    return _beeline(spark, d, True)


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return search.landmark_features(search.landmark_table(_e(spark, d), spark.createDataFrame([(1,), (40,), (77,), (120,)], "landmark bigint")))


def astar_landmarks(spark, d):
    return _routed(spark, d, _marks(spark, d), False)


def bidirectional_astar_landmarks(spark, d):
    return _routed(spark, d, _marks(spark, d), True)


def active_landmarks(spark, d):
    table = search.landmark_table(_e(spark, d), spark.createDataFrame([(1,), (40,), (77,)], "landmark bigint"))
    pairs = derived.nodes(spark, d).select(F.lit(5).cast("bigint").alias("source"), F.col("node").alias("target"))
    return search.active_landmarks(table, pairs, 2).select("target", "landmark", "bound")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return derived.edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def weakly_connected_components(spark, d):
    return components.weak_components(derived.nodes(spark, d), _links(spark, d))


def scc(spark, d):
    return components.strong_components(derived.nodes(spark, d), _links(spark, d))


def subnetwork_marking(spark, d):
    return components.mark_subnetworks(scc(spark, d), 200)


def degree_stats(spark, d):
    e = derived.edges(spark, d)
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _rule(model: dict, kind: str, scale: int = 1000):
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = rules.fold(model[kind], F.lit(rules.START[kind]), context())
        return derived.edges(spark, d).select("edge", F.floor(c * scale).cast("bigint").alias("value"))

    return run


RULES = {
    "rule_speed_if_else": (_rule({"speed": [{"if": "road_class == URGENT || road_class == HIGH", "limit_to": "120"}, {"else_if": "year >= 1996", "limit_to": "80"}, {"else": "", "limit_to": "50"}]}, "speed"), "least(999.0, CASE WHEN road_class IN ('URGENT', 'HIGH') THEN 120 WHEN year >= 1996 THEN 80 ELSE 50 END)"),
    "rule_priority_multiply": (_rule({"priority": [{"if": "road_env == O", "multiply_by": "0.5"}, {"if": "road_class != LOW && year < 1995", "multiply_by": "0.25"}]}, "priority"), "(CASE WHEN road_env = 'O' THEN 0.5 ELSE 1.0 END) * (CASE WHEN road_class <> 'LOW' AND year < 1995 THEN 0.25 ELSE 1.0 END)"),
    "rule_limit_min_chain": (_rule({"speed": [{"if": "true", "limit_to": "100"}, {"if": "road_class == LOW", "limit_to": "60"}, {"if": "year > 1996", "limit_to": "90"}]}, "speed"), "least(100, CASE WHEN road_class = 'LOW' THEN 60 ELSE 999 END, CASE WHEN year > 1996 THEN 90 ELSE 999 END)"),
    "rule_do_block": (_rule({"speed": [{"if": "true", "limit_to": "100"}, {"if": "road_env == F", "do": [{"if": "year > 1995", "multiply_by": "0.5"}, {"else": "", "limit_to": "30"}]}]}, "speed"), "CASE WHEN road_env = 'F' THEN CASE WHEN year > 1995 THEN 50 ELSE 30 END ELSE 100 END"),
    "rule_backward_attr": (_rule({"priority": [{"if": "backward_road_class == LOW", "multiply_by": "0.5"}]}, "priority"), "CASE WHEN road_class = 'LOW' THEN 0.5 ELSE 1.0 END"),
    "rule_turn_penalty": (_rule({"turn_penalty": [{"if": "prev_year < 1995", "add": "3"}, {"if": "road_class == HIGH", "add": "2"}]}, "turn_penalty"), "(CASE WHEN year < 1995 THEN 3 ELSE 0 END) + (CASE WHEN road_class = 'HIGH' THEN 2 ELSE 0 END)"),
    "rule_area": (_rule({"priority": [{"if": "in_south && !(road_class == LOW)", "multiply_by": "0.5"}, {"else_if": "edge.getDistance() > 200000", "multiply_by": "0.25"}]}, "priority"), "CASE WHEN src % 10 < 3 AND road_class <> 'LOW' THEN 0.5 WHEN w > 200000 THEN 0.25 ELSE 1.0 END"),
}

QUERIES = {
    f.__name__: f
    for f in (
        sssp_dijkstra, sssp_reverse_flow, sssp_multi_source_matrix, sssp_hop_bounded, sssp_rule_model, spt_limit, spt_tree, isochrone_buckets, isochrone_frontier_edges, path_extract, via_route_totals, bidir_meet,
        edge_based_sssp_turns, alternatives_via_node, landmark_bounds, dijkstra_to_target, bidirectional_dijkstra, astar_beeline, bidirectional_astar_beeline, astar_landmarks, bidirectional_astar_landmarks, active_landmarks, weakly_connected_components, scc, subnetwork_marking, degree_stats,
    )
} | {k: v[0] for k, v in RULES.items()}


def _sp(source: str, base: str = "src", adj: str = "dst", edges: str = "edges", name: str = "sp") -> str:
    return f"""{name}(node, w) USING KEY (node) AS (SELECT CAST({source} AS BIGINT), CAST(0 AS BIGINT) UNION
 SELECT e.{adj}, min({name}.w + e.w) FROM {name} JOIN {edges} e ON e.{base} = {name}.node LEFT JOIN recurring.{name} r ON r.node = e.{adj} WHERE {name}.w + e.w < coalesce(r.w, 9223372036854775807) GROUP BY e.{adj})"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BASE_SQL.strip(), *parts])


_SPEED = "CASE WHEN road_class = 'LOW' THEN 50.0 WHEN road_env = 'F' THEN 80.0 ELSE 100.0 END"
_RULED = f"ruled AS (SELECT edge, src, dst, CAST(floor(CAST(w AS DOUBLE) / CAST({_SPEED} AS DOUBLE) * CAST(3.6 AS DOUBLE) / CAST(CASE WHEN road_class = 'URGENT' THEN 0.5 ELSE 1.0 END AS DOUBLE) * 10) AS BIGINT) AS w FROM edges)"
_TREE = "tree AS (SELECT e.dst AS node, min(e.edge) AS edge, arg_min(e.src, e.edge) AS prev FROM edges e JOIN sp a ON a.node = e.src JOIN sp b ON b.node = e.dst WHERE a.w + e.w = b.w AND e.dst <> 5 GROUP BY e.dst)"
_LM = ", ".join(_sp(str(x), name=f"f{x}") + ", " + _sp(str(x), "dst", "src", name=f"t{x}") for x in (1, 40, 77))
_PART = "part AS (SELECT src, dst FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst)"
_CLOSURE = "reach AS (SELECT src AS a, dst AS b FROM part UNION SELECT r.a, p.dst FROM reach r JOIN part p ON p.src = r.b)"

SQL = {
    "sssp_dijkstra": _with(_sp("1")) + " SELECT node, w FROM sp",
    "sssp_reverse_flow": _with(_sp("1", "dst", "src")) + " SELECT node, w FROM sp",
    "sssp_multi_source_matrix": _with(_sp("1", name="s1"), _sp("2", name="s2"), _sp("3", name="s3")) + " SELECT * FROM (SELECT 1::BIGINT AS source, node, w FROM s1 UNION ALL SELECT 2, node, w FROM s2 UNION ALL SELECT 3, node, w FROM s3)",
    "sssp_hop_bounded": _with("h0 AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS w)", *[f"h{i + 1} AS (SELECT node, min(w) AS w FROM (SELECT * FROM h{i} UNION ALL SELECT e.dst, h.w + e.w FROM h{i} h JOIN edges e ON e.src = h.node) GROUP BY node)" for i in range(3)]) + " SELECT node, CAST(w AS BIGINT) AS w FROM h3",
    "sssp_rule_model": _with(_RULED, _sp("1", edges="ruled")) + " SELECT node, w FROM sp",
    "spt_limit": _with(_sp("5")) + " SELECT node, w FROM sp WHERE w <= 250000",
    "spt_tree": _with(_sp("5"), _TREE) + " SELECT node, edge, prev FROM tree",
    "isochrone_buckets": _with(_sp("5")) + " SELECT CAST(least(4, w * 5 // 400000) AS INTEGER) AS bucket, count(*) AS nodes, max(w) AS farthest FROM sp WHERE w <= 400000 GROUP BY 1",
    "isochrone_frontier_edges": _with(_sp("5")) + " SELECT e.edge, e.src AS base, e.dst AS adj FROM edges e LEFT JOIN sp a ON a.node = e.src AND a.w <= 200000 LEFT JOIN sp b ON b.node = e.dst AND b.w <= 200000 WHERE (a.node IS NULL) <> (b.node IS NULL)",
    "path_extract": _with(_sp("5"), _TREE, "walk(target, back, edge, node, prev) AS (SELECT node, 0, edge, node, prev FROM tree WHERE node IN (17, 99) UNION ALL SELECT w.target, w.back + 1, t.edge, t.node, t.prev FROM walk w JOIN tree t ON t.node = w.prev)") + " SELECT target, CAST(max(back) OVER (PARTITION BY target) - back + 1 AS INTEGER) AS seq, edge, node FROM walk",
    "via_route_totals": _with(_sp("5", name="a"), _sp("17", name="b"), _sp("3", name="c")) + " SELECT 1::BIGINT AS request, 2::BIGINT AS legs, (SELECT w FROM a WHERE node = 17) + (SELECT w FROM b WHERE node = 99) AS w UNION ALL SELECT 2, 1, w FROM c WHERE node = 8",
    "bidir_meet": _with(_sp("5")) + " SELECT w FROM sp WHERE node = 99",
    "edge_based_sssp_turns": _with("""sp(edge, node, w) USING KEY (edge) AS (SELECT edge, dst, w FROM edges WHERE src = 5 UNION
 SELECT e.edge, e.dst, min(sp.w + e.w + (sp.edge + e.edge) % 3 * 1000) FROM sp JOIN edges e ON e.src = sp.node LEFT JOIN recurring.sp r ON r.edge = e.edge
 WHERE sp.edge <> e.edge AND (sp.edge * 31 + e.edge) % 17 <> 0 AND sp.w + e.w + (sp.edge + e.edge) % 3 * 1000 < coalesce(r.w, 9223372036854775807) GROUP BY e.edge, e.dst)""") + " SELECT node, min(w) AS w FROM sp GROUP BY node",
    "alternatives_via_node": _with(_sp("5"), _sp("99", "dst", "src", name="bk")) + " SELECT CAST(row_number() OVER (ORDER BY w) AS INTEGER) AS rank, w FROM (SELECT DISTINCT sp.w + bk.w AS w FROM sp JOIN bk USING (node)) WHERE w <= 1.5 * (SELECT w FROM sp WHERE node = 99) ORDER BY w LIMIT 3",
    "landmark_bounds": _with(_LM, "lm AS (" + " UNION ALL ".join(f"SELECT coalesce(f.node, t.node) AS node, {x} AS lm, f.w AS wf, t.w AS wt FROM f{x} f FULL JOIN t{x} t ON t.node = f.node" for x in (1, 40, 77)) + ")") + " SELECT b.node AS target, greatest(0, max(b.wf - a.wf), max(a.wt - b.wt)) AS bound FROM lm b JOIN lm a ON a.lm = b.lm AND a.node = 5 GROUP BY 1",
    "weakly_connected_components": _with(_PART, "both_ways AS (SELECT src, dst FROM part UNION SELECT dst, src FROM part)", "cc(node, c) USING KEY (node) AS (SELECT node, node FROM nodes UNION SELECT p.dst, min(cc.c) FROM cc JOIN both_ways p ON p.src = cc.node LEFT JOIN recurring.cc r ON r.node = p.dst WHERE cc.c < r.c GROUP BY p.dst)") + " SELECT node, c AS component FROM cc",
    "degree_stats": _with() + " SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node",
} | {k: _with() + f" SELECT edge, CAST(floor(({v[1]}) * 1000) AS BIGINT) AS value FROM edges" for k, v in RULES.items()}
_ROUTED = _with(
    "requests AS (SELECT CAST(s_suppkey AS BIGINT) AS request, CAST(s_suppkey * 7 % (SELECT n FROM cnt) + 1 AS BIGINT) AS source, CAST(s_suppkey * 31 % (SELECT n FROM cnt) + 1 AS BIGINT) AS target FROM supplier)",
    """sp(request, node, w) USING KEY (request, node) AS (SELECT request, source, CAST(0 AS BIGINT) FROM requests UNION
 SELECT sp.request, e.dst, min(sp.w + e.w) FROM sp JOIN edges e ON e.src = sp.node LEFT JOIN recurring.sp r ON r.node = e.dst AND r.request = sp.request WHERE sp.w + e.w < coalesce(r.w, 9223372036854775807) GROUP BY sp.request, e.dst)""",
) + " SELECT request, w FROM sp JOIN requests USING (request) WHERE node = target"
SQL |= {k: _ROUTED for k in ("dijkstra_to_target", "bidirectional_dijkstra", "astar_beeline", "bidirectional_astar_beeline", "astar_landmarks", "bidirectional_astar_landmarks")}
_MARK_TABLE = "lm AS (" + " UNION ALL ".join(f"SELECT coalesce(f.node, t.node) AS node, {x} AS lm, f.w AS wf, t.w AS wt FROM f{x} f FULL JOIN t{x} t ON t.node = f.node" for x in (1, 40, 77)) + ")"
SQL["active_landmarks"] = _with(_LM, _MARK_TABLE) + " SELECT target, landmark, bound FROM (SELECT n.node AS target, CAST(b.lm AS BIGINT) AS landmark, CAST(greatest(0, b.wf - a.wf, a.wt - b.wt) AS BIGINT) AS bound, row_number() OVER (PARTITION BY n.node ORDER BY greatest(0, b.wf - a.wf, a.wt - b.wt) DESC, b.lm) AS k FROM nodes n JOIN lm b ON b.node = n.node JOIN lm a ON a.lm = b.lm AND a.node = 5) WHERE k <= 2"
_SCC = _with(_PART, _CLOSURE, "comp AS (SELECT n.node, coalesce(min(least(r.b, n.node)), n.node) AS component FROM nodes n LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a) r ON r.a = n.node GROUP BY n.node)")
SQL["scc"] = _SCC + " SELECT node, component FROM comp"
SQL["subnetwork_marking"] = _SCC + " SELECT node, component, count(*) OVER (PARTITION BY component) AS size, count(*) OVER (PARTITION BY component) < 200 AS subnetwork FROM comp"
