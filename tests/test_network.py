import json
import random

import pytest
from pyspark.sql import functions as F

from waymesh.functions import polyline
from waymesh.operators import components, contours, contraction, routes, search
from waymesh.plans import rules
from waymesh.service import Network

E = "base bigint, adj bigint, edge bigint, w bigint"


def random_graph(seed, n=40, m=120):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), i, r.randint(1, 50)) for i in range(m)]


def dijkstra(edges, source, limit=10**9):
    best, todo = {source: 0}, [source]
    while todo:
        x = todo.pop()
        for a, b, _, w in edges:
            if a == x and best[x] + w < best.get(b, limit + 1):
                best[b] = best[x] + w
                todo.append(b)
    return best


def test_searches_equal_plain_code(spark):
    edges = random_graph(1)
    df = spark.createDataFrame(edges, E)
    src = spark.createDataFrame([(0,), (5,), (None,), (0,), (999,)], "source bigint")
    got = {(r["source"], r["node"]): r["w"] for r in search.shortest(df, src).collect()}
    want = {(s, k): v for s in (0, 5) for k, v in dijkstra(edges, s).items()} | {(999, 999): 0}
    assert got == want
    got = {r["node"]: r["w"] for r in search.shortest(df, src.filter("source = 0"), limit=40).collect()}
    assert got == dijkstra(edges, 0, 40)
    labels = search.shortest(df, src.filter("source = 0"))
    tree = search.parents(labels, df)
    paths = search.extract_paths(tree, labels.select("source", F.col("node").alias("target"))).collect()
    cost = {e: w for _, _, e, w in edges}
    total = {}
    for p in paths:
        total[p["target"]] = total.get(p["target"], 0) + cost[p["edge"]]
    assert total == {k: v for k, v in dijkstra(edges, 0).items() if k != 0}
    assert search.shortest(df.limit(0), src).count() == 3
    assert search.extract_paths(tree, src.select("source", F.col("source").alias("target")).limit(0)).count() == 0


def test_turn_costs_equal_plain_code(spark):
    r = random.Random(4)
    edges = random_graph(2, 15, 50)
    turns = [(a, b, r.choice([None, 7, 20])) for a in range(50) for b in range(50) if r.random() < 0.3]
    cost = {(a, b): c for a, b, c in turns}
    best, todo = {}, []
    for a, b, e, w in edges:
        if a == 0:
            best[e] = w
            todo.append(e)
    by = {e: (a, b, w) for a, b, e, w in edges}
    while todo:
        x = todo.pop()
        for a, b, e, w in edges:
            c = cost.get((x, e), 0)
            if a == by[x][1] and e != x and c is not None and best[x] + w + c < best.get(e, 10**9):
                best[e] = best[x] + w + c
                todo.append(e)
    got = search.turn_search(spark.createDataFrame(edges, E), spark.createDataFrame([(0,)], "source bigint"), spark.createDataFrame(turns, "from_edge bigint, to_edge bigint, cost bigint"))
    assert {r["edge"]: r["w"] for r in got.collect()} == best


def test_shortcuts_keep_distances(spark):
    edges = [x for x in random_graph(3, 60, 150) if x[0] != x[1]]
    levels, up = contraction.contract(spark.createDataFrame(edges, E), 5)
    nodes = {x for e in edges for x in e[:2]}
    pairs = spark.createDataFrame([(s, t) for s in (0, 7) for t in nodes], "source bigint, target bigint")
    got = {(r["source"], r["target"]): r["w"] for r in contraction.hierarchy_search(levels, up, pairs).collect()}
    assert got == {(s, k): v for s in (0, 7) for k, v in dijkstra(edges, s).items()}
    assert levels.filter(f"level < {contraction.CORE}").count() > 20


def test_components(spark):
    edges = random_graph(9, 40, 45)
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node bigint")
    links = spark.createDataFrame([e[:2] for e in edges], "a bigint, b bigint")
    reach = {i: set(dijkstra(edges, i)) for i in range(40)}
    both = edges + [(b, a, e, w) for a, b, e, w in edges]
    weak = {i: min(dijkstra(both, i)) for i in range(40)}
    strong = {i: min(j for j in reach[i] if i in reach[j]) for i in range(40)}
    assert {r["node"]: r["component"] for r in components.weak_components(nodes, links).collect()} == weak
    assert {r["node"]: r["component"] for r in components.strong_components(nodes, links).collect()} == strong


def ctx():
    return rules.Context({"kind": "enum", "n": "number", "ok": "boolean"}, {"kind": {"A", "B"}}, {"town": F.lit(True)}, F.col("n"))


def run(spark, statements, start=10.0):
    df = spark.createDataFrame([("A", 1.0, True), ("B", 2.0, False), (None, None, None)], "kind string, n double, ok boolean")
    return [r[0] for r in df.select(rules.fold(statements, F.lit(start), ctx())).collect()]


def test_rules(spark):
    assert run(spark, [{"if": "kind == A", "multiply_by": "0.5"}, {"else_if": "n > 1", "limit_to": "3"}, {"else": "", "add": "1"}]) == [5.0, 3.0, 11.0]
    assert run(spark, [{"if": "true", "limit_to": "8"}, {"if": "!(ok) || kind != 'A' && n >= 2", "do": [{"if": "n == 2", "add": "n * -1"}, {"else": "", "add": "5"}]}])[:2] == [8.0, 6.0]
    assert run(spark, [{"if": "in_town && sqrt(n + 3) == 2", "multiply_by": "2"}])[0] == 20.0
    assert run(spark, []) == [10.0] * 3


@pytest.mark.parametrize("text", ["kind > A", "kind == C", "n ==", "nobody", "n + 1", "ok && n", "(n > 1", "n > 1 )", "n $ 1", "in_sea", "kind == A == B >"])
def test_bad_conditions(spark, text):
    with pytest.raises(rules.RuleError):
        rules.condition(text, ctx())


def test_bad_models(spark):
    ok = {"speed": [{"if": "true", "limit_to": "50"}]}
    rules.compile_model(ok, ctx())
    for bad in ({"speed": [{"if": "ok", "limit_to": "5"}]}, ok | {"priority": [{"if": "true", "add": "1"}]}, ok | {"turn_penalty": [{"if": "true", "multiply_by": "1"}]}, ok | {"turn_penalty": [{"if": "true", "do": []}]}, {"speed": [{"else": "", "limit_to": "5"}]}, {"speed": [{"if": "true", "limit_to": "5", "add": "1"}]}, {}):
        with pytest.raises(rules.RuleError):
            rules.compile_model(bad, ctx())
    with pytest.raises(rules.RuleError):
        rules.merge({"areas": {"a": 1}}, {"areas": {"a": 2}})
    assert rules.merge(ok | {"distance_influence": 1}, {"speed": [{"if": "ok", "limit_to": "9"}], "distance_influence": 2}) == {"speed": [*ok["speed"], {"if": "ok", "limit_to": "9"}], "priority": [], "turn_penalty": [], "areas": {}, "distance_influence": 2}


@pytest.fixture(scope="module")
def town(spark):
    """A grid of four by four crossings."""
    at = lambda i: (47 + i // 4 * 0.001, 8 + i % 4 * 0.001)
    nodes = spark.createDataFrame([(i, *at(i)) for i in range(16)], "node bigint, lat double, lon double")
    pairs = [(i, i + 1) for i in range(16) if i % 4 < 3] + [(i, i + 4) for i in range(12)]
    edges = [(k, a, b, 111.0 if b - a == 4 else 76.0, [at(a), at(b)], {"highway": "residential", "name": f"Row {a // 4}" if b - a == 1 else f"Lane {a % 4}"} | ({"oneway": "yes"} if k == 0 else {})) for k, (a, b) in enumerate(pairs)]
    return Network(nodes, spark.createDataFrame(edges, "edge bigint, node_a bigint, node_b bigint, dist_m double, points array<struct<lat:double,lon:double>>, tags map<string,string>"))


def test_routes_of_a_town(spark, town):
    req = spark.createDataFrame([(1, 0, 15), (2, 1, 0), (3, 0, 77)], "path bigint, source bigint, target bigint")
    got = {r["path"]: json.loads(r["body"]) for r in town.route("car", req).collect()}
    p = got[1]["paths"][0]
    assert abs(p["distance"] - (3 * 111 + 3 * 76)) < 1e-6 and len(polyline.decode(p["points"])) == 7
    assert p["instructions"][-1]["text"] == "Arrive at destination" and p["instructions"][0]["sign"] == 0
    assert sum(i["time"] for i in p["instructions"]) == p["time"]
    assert abs(got[2]["paths"][0]["distance"] - (76 + 222)) < 1e-6  # the direct edge is one-way
    assert got[3]["hints"][0]["details"] == "ConnectionNotFound"
    foot = json.loads(town.route("foot", req.filter("path = 2")).head()["body"])
    assert foot["paths"][0]["distance"] == 76.0


def test_other_services(spark, town):
    s = town.snap(spark.createDataFrame([(1, 47.0011, 8.0002)], "id bigint, lat double, lon double")).head()
    assert s["node"] == 4
    trace = spark.createDataFrame([(1, i, 47.00002, 8.0 + 0.001 * i + 0.00002) for i in range(4)], "trace bigint, step int, lat double, lon double")
    m = town.match("foot", trace).orderBy("step").collect()
    assert [r["candidate"] for r in m] == [0, 1, 2, 3]
    iso = town.isochrone("car", spark.createDataFrame([(5,)], "source bigint"), [20_000.0, 60_000.0], 0.0005).collect()
    assert len(iso) == 2 and json.loads(iso[0]["geometry"])["coordinates"]
    assert town.info()["nodes"] == 16 and town.matrix("car", spark.createDataFrame([(0,)], "source bigint"), spark.createDataFrame([(3,), (9,)], "target bigint")).count() == 2


def test_roundabouts_count_exits(spark):
    rows = [(1, 0, "A", 0.0, 0.0, 10.0, 5, False, 0), (1, 1, None, 10.0, 60.0, 5.0, 2, True, 1), (1, 2, None, 60.0, 120.0, 5.0, 2, True, 1), (1, 3, "B", 90.0, 90.0, 9.0, 4, False, 0)]
    df = spark.createDataFrame(rows, "path bigint, seq int, name string, azimuth_in double, azimuth_out double, distance_m double, time_ms bigint, roundabout boolean, out_edges int")
    got = [(r["sign"], r["name"], r["exits"]) for r in routes.instructions(df).orderBy("no").collect()]
    assert got[0] == (0, "A", None) and got[1] == (6, None, 2) and got[-1][0] == 4


def test_contours():
    import numpy as np

    r = np.random.default_rng(0)
    pts = r.uniform(-1, 1, (300, 2))
    z = np.hypot(*pts.T)
    tri = contours.delaunay(pts)
    area = sum(abs(np.cross(*(pts[t[1:]] - pts[t[0]])) if False else (pts[t[1]] - pts[t[0]])[0] * (pts[t[2]] - pts[t[0]])[1] - (pts[t[1]] - pts[t[0]])[1] * (pts[t[2]] - pts[t[0]])[0]) for t in tri) / 2
    assert 3.5 < area <= 4.0
    lines = contours.polygons(contours.contour_segments(pts, z, 0.5))
    assert len(lines) == 1 and lines[0][0] == pytest.approx(lines[0][-1])
    assert all(abs(np.hypot(x, y) - 0.5) < 0.1 for x, y in lines[0])
    assert len(contours.delaunay(np.zeros((2, 2)))) == 0


def test_contours_keep_late_pockets_within_a_cell(spark):
    import json

    rows = [(1, 47 + i / 500, 8 + j / 500, 9.0 if (i, j) == (14, 14) else 1.0) for i in range(30) for j in range(30)]
    rows += [(1, 47 + 7 / 500, 8 + 7 / 500, 9.0)]  # a second, later label of a position
    got = contours.isochrones(spark.createDataFrame(rows, "source bigint, lat double, lon double, z double"), [5.0], 0.02).head()
    rings = sorted(json.loads(got["geometry"])["coordinates"], key=len)
    assert len(rings) == 2 and all(r[0] == pytest.approx(r[-1]) for r in rings)
    assert all(abs(x - 8.028) < 0.002 and abs(y - 47.028) < 0.002 for x, y in rings[0])


def test_sequences_of_candidates(spark):
    from waymesh.operators import matching

    r = random.Random(6)
    c = [(t, s, k, r.randint(0, 30)) for t in range(4) for s in range(6) for k in range(3) if r.random() < 0.9 and (t, s) != (3, 4)]
    m = [(t, s, a, b, r.randint(0, 30)) for t in range(4) for s in range(1, 6) for a in range(3) for b in range(3) if r.random() < 0.9]
    cost, move = {x[:3]: x[3] for x in c}, {x[:4]: x[4] for x in m}

    def best(t):
        layers = [{k: cost[t, 0, k] for k in range(3) if (t, 0, k) in cost}]
        for s in range(1, 6):
            nxt = {}
            for b in range(3):
                ways = [v + move[t, s, a, b] + cost[t, s, b] for a, v in layers[-1].items() if (t, s, a, b) in move and (t, s, b) in cost]
                if ways:
                    nxt[b] = min(ways)
            if not nxt:
                break
            layers.append(nxt)
        return len(layers), min(layers[-1].values())

    cs, ms = spark.createDataFrame(c, "trace bigint, step int, candidate bigint, cost double" .replace("double", "bigint")), spark.createDataFrame(m, "trace bigint, step int, a bigint, b bigint, cost bigint")
    for bound in (1000, 3, 2, 1):
        got = matching.viterbi(cs, ms, bound).collect()
        for t in range(4):
            mine = sorted((x["step"], x["candidate"], x["cost"]) for x in got if x["trace"] == t)
            assert (len(mine), mine[-1][2]) == best(t)
            for (s, a, w), (_, b, v) in zip(mine, mine[1:]):
                assert v == w + move[t, s + 1, a, b] + cost[t, s + 1, b]
    assert matching.viterbi(cs.limit(0), ms).count() == 0


def test_far_points_have_a_nearest_edge(spark):
    from waymesh.functions import geo
    from waymesh.operators import snapping

    r = random.Random(8)
    lines = [(i, 48 + r.random() * 0.2, 9 + r.random() * 0.2, 48 + r.random() * 0.2, 9 + r.random() * 0.2) for i in range(30)] + [(99, 52.0, 13.0, 52.1, 13.1)]
    points = [(1, 48.1, 9.1), (2, 48.0, 9.9), (3, 50.5, 11.5), (4, -33.0, 151.0), (5, None, 9.0), (6, 89.0, 9.0)]
    e = spark.createDataFrame(lines, "edge bigint, lat_a double, lon_a double, lat_b double, lon_b double")
    p = spark.createDataFrame(points, "id bigint, lat double, lon double")
    got = {x["id"]: (x["edge"], x["distance_m"]) for x in snapping.nearest_edges(p, e, 0.01).collect()}
    t = geo.project_fraction(*[F.col(c) for c in ("lat", "lon", "lat_a", "lon_a", "lat_b", "lon_b")])
    every = p.filter("lat is not null").join(e, F.lit(True)).withColumn("t", t)
    d = geo.plane_distance_m(F.col("lat"), F.col("lon"), F.col("lat_a") + (F.col("lat_b") - F.col("lat_a")) * F.col("t"), F.col("lon_a") + (F.col("lon_b") - F.col("lon_a")) * F.col("t"))
    want = {x["id"]: (x["m"]["edge"], x["m"]["d"]) for x in every.groupBy("id").agg(F.min(F.struct(d.alias("d"), "edge")).alias("m")).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in (1, 2, 3)) and got[4][1] > 1e6
    assert snapping.nearest_edges(p, e.limit(0), 0.01).count() == 0
