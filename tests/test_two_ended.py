import heapq
import random

import pytest

from waymesh.operators import search, two_ended

E = "base bigint, adj bigint, edge bigint, w bigint"
R = "request bigint, source bigint, target bigint"


def graph(seed, nodes, edges, ids):
    r = random.Random(seed)
    return [(ids(r.randrange(nodes)), ids(r.randrange(nodes)), i, r.choice([0, 1, 3, 70, 900, 3_000_000_000])) for i in range(edges)]


def plain(edges, source):
    out, queue, arcs = {}, [(0, source)], {}
    for a, b, _, w in edges:
        arcs.setdefault(a, []).append((b, w))
    while queue:
        w, x = heapq.heappop(queue)
        if x not in out:
            out[x] = w
            for b, v in arcs.get(x, []):
                heapq.heappush(queue, (w + v, b))
    return out


@pytest.mark.parametrize("ids", [lambda x: x + 5, lambda x: (x - 100) * 40_000_000_000_000_000])
def test_pair_weights(spark, ids):
    edges = graph(3, 200, 700, ids)
    want = {}
    req = [(i, ids(i * 13 % 200), ids(i * 7 % 230)) for i in range(400)]
    for i, s, t in req:
        w = plain(edges, s).get(t)
        if w is not None:
            want[i] = w
    df = spark.createDataFrame([*edges, (None, ids(1), 9000, 1), (ids(1), ids(2), 9001, None)], E)
    requests = spark.createDataFrame([*req, *req[:5], (900, None, 1), (901, 10**15, 10**15), (902, 10**15, 7)], R)
    marks = search.landmark_features(search.landmark_table(df, spark.createDataFrame([(ids(1),), (ids(30),)], "landmark bigint")))
    flat = search.beeline_features(spark.createDataFrame([(ids(i), 50.0 + i * 1e-6, 8.0) for i in range(0, 200, 2)], "node bigint, lat double, lon double"), 0.0)
    for features in (None, marks, flat):
        got = search.pair_weights(df, requests, features).collect()
        assert len(got) == len(want) + 1 and {r["request"]: r["w"] for r in got} == want | {901: 0}
    few = two_ended.pair_weights(df.select("base", "adj", "w").dropna(), requests.dropna().distinct(), 700, group_slots=1)
    assert {r["request"]: r["w"] for r in few.collect()} == want | {901: 0}


def test_pair_weights_of_nothing(spark):
    none = spark.createDataFrame([], E)
    assert [tuple(r) for r in search.pair_weights(none, spark.createDataFrame([(1, 3, 3), (2, 3, 4)], R)).collect()] == [(1, 0)]
    assert search.pair_weights(spark.createDataFrame([(1, 2, 1, 5)], E), spark.createDataFrame([], R)).count() == 0


def test_copies_of_the_graph(spark):
    """However many requests there are, the graph is sent once a core at most; it was sent once for every 12 of 60,000 requests."""
    assert two_ended.copies(60_000, 9_000_000, 6) == 6
    assert two_ended.copies(3, 9_000_000, 6) == 1
    edges = spark.range(4000).selectExpr("id % 500 as base", "id * 7 % 500 as adj", "id as edge", "id % 97 as w")
    requests = spark.range(3000).selectExpr("id as request", "id % 500 as source", "id * 31 % 500 as target")
    plan = search.pair_weights(edges, requests)
    assert plan.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and plan.count() > 0


def test_bounds_by_features():
    """What a label has left, by either end, is bounded by the features of the two nodes it goes between."""
    import numpy as np
    import pyarrow as pa

    n = 50
    arcs = pa.RecordBatch.from_pydict({"base": np.arange(n - 1), "adj": np.arange(1, n), "w": np.full(n - 1, 1000)})
    at = pa.RecordBatch.from_pydict({"node": np.arange(n), "f": [[np.radians(50 + i * 1e-3), np.radians(8.0), 5.0] for i in range(n)]})
    rows = [r for it in (two_ended._pack_arcs(iter([arcs])), two_ended._pack_features(iter([at]))) for r in it]
    data = [[r.column(c)[0].as_py() for c in ("a", "b", "c")] for r in rows]
    g = two_ended._Graph([tuple(data[0])], [tuple(data[1][:2])])
    s, t = np.array([3, 10]), np.array([40, 12])
    left = two_ended._left(g, np.array([5, 2 * n + n + 11]), s, t)
    step = 5 * 6_371_000 * np.radians(1e-3)
    assert np.allclose(left, [35 * step, step], atol=2)
    dist = np.full(4 * n, two_ended.INF)
    assert two_ended._search(g, s, t, dist).tolist() == [37_000, 2_000] and (dist == two_ended.INF).all()


def written(spark):
    """Bytes of shuffle that all stages so far have written."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_the_graph_is_written_once(spark):
    """All blocks read one copy; the graph was written for each of them, after two joins of all its arcs with places."""
    cores = spark.sparkContext.defaultParallelism
    edges = spark.range(400_000).selectExpr("pmod(xxhash64(id), 40000) as base", "pmod(xxhash64(id, 1), 40000) as adj", "id as edge", "1000 + pmod(xxhash64(id, 2), 1000000) as w")
    requests = spark.range(200).selectExpr("id as request", "id * 97 % 40000 as source", "id * 31 % 40000 as target")
    places = spark.range(40_000).selectExpr("id as node", "47 + id % 200 * 1e-3 as lat", "8 + id div 200 * 1e-3 as lon")
    assert two_ended.copies(200, 400_000, cores) == cores > 3
    before = written(spark)
    got = search.pair_weights(edges, requests, places=places).count()
    assert got > 100 and 400_000 * 4 < written(spark) - before < 400_000 * 12


@pytest.mark.parametrize("packed", [two_ended.PACKED_ARCS, 0])
def test_places(spark, packed):
    """Bounds by the least weight a metre, with places for all nodes and for all but one, which may be a short way to anywhere."""
    r = random.Random(8)
    at = [(i, 47 + r.random(), 8 + r.random()) for i in range(40)]
    places = spark.createDataFrame([*at, (77, 47.0, 8.0), (None, 47.0, 8.0)], "node bigint, lat double, lon double")
    metres = lambda a, b: 111_195 * ((at[a][1] - at[b][1]) ** 2 + (0.68 * (at[a][2] - at[b][2])) ** 2) ** 0.5
    ends = [(r.randrange(40), r.randrange(40)) for _ in range(300)]
    edges = [(a, b, i, 1 if 0 in (a, b) else int(metres(a, b)) + 2) for i, (a, b) in enumerate(ends)]
    req = [(i, i % 40, i // 40) for i in range(0, 1600, 1 if packed else 40)]
    odd = places.selectExpr("node", "if(node = 0, double('nan'), lat) as lat", "lon")
    for e, known in ((edges, places.filter("node <> 0")), (edges, odd), ([(a, b, i, w) for a, b, i, w in edges if 0 not in (a, b)], places)):
        trees = {s: plain(e, s) for s in range(40)}
        want = {i: trees[s][t] for i, s, t in req if t in trees[s]}
        got = search.pair_weights(spark.createDataFrame(e, E), spark.createDataFrame(req, R), packed_arcs=packed, places=known).collect()
        assert len(got) == len(want) and {x["request"]: x["w"] for x in got} == want


def test_astar_beeline_where_a_customer_is_missing(spark, tmp_path):
    """An order of no customer is an edge like others in the SQL; bounds that knew nothing of it missed ways over it."""
    from waymesh.plans import graph_queries

    r, n = random.Random(1), 30
    at = [(47 + k * 7919 % 10_000 * 1e-5, 8 + k * 104_729 % 10_000 * 1e-5) for k in range(n + 1)]
    rows, edges = [], []
    for k in r.sample(range(10_000), 240):
        a, b = r.randrange(n + 1), (k * 7919 + 13) % n
        w = 1 if 0 in (a, b) else int(111_195 * ((at[a][0] - at[b][0]) ** 2 + (0.68 * (at[a][1] - at[b][1])) ** 2) ** 0.5) + 2
        rows.append((k, a, float(w), "F", "1-URGENT"))
        edges += [(a, b, k, w)] * (a != b)
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string, o_orderpriority string")
    orders.selectExpr("*", "timestamp '1995-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, n + 1).selectExpr("id as c_custkey", "1 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(300).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    trees = {s: plain(edges, s) for s in range(n + 1)}
    want = {k: w for k in range(300) if (w := trees[k * 7 % n + 1].get(k * 31 % n + 1)) is not None}
    got = graph_queries.astar_beeline(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {x["request"]: x["w"] for x in got} == want


def test_requests_of_several_rows(spark):
    """A block of more requests than a packed row holds."""
    cores = spark.sparkContext.defaultParallelism
    n = cores * two_ended.CHUNK * 11 // 10
    edges = spark.createDataFrame([(i, (i + 1) % 5, i, 10**i) for i in range(5)], E)
    got = search.pair_weights(edges, spark.range(n).selectExpr("id as request", "id % 5 as source", "(id + 2) % 5 as target"))
    assert sorted(tuple(x) for x in got.groupBy("w").count().collect()) == sorted((10**i + 10 ** ((i + 1) % 5), n // 5) for i in range(5))
