"""Registered queries over the whole derived network, against plain code."""

import heapq

import pytest

from waymesh.operators import contraction
from waymesh.plans import derived, graph_queries, route_queries


@pytest.fixture(scope="module")
def network(spark, data):
    nodes = [r["node"] for r in derived.nodes(spark, data).collect()]
    return nodes, [(r["src"], r["dst"], r["w"]) for r in derived.edges(spark, data).collect()]


def dijkstra(edges, source):
    out, best, queue = {}, {}, [(0, source)]
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    while queue:
        w, x = heapq.heappop(queue)
        if x in best:
            continue
        best[x] = w
        for y, v in out.get(x, ()):
            heapq.heappush(queue, (w + v, y))
    return best


def test_virtual_nodes_reach_all(spark, data, network):
    want = dijkstra(network[1], 5)
    assert max(want.values()) > 300_000
    assert {r["node"]: r["w"] for r in route_queries.virtual_nodes(spark, data).collect()} == want


def closure(nodes, edges):
    """The nodes that each node reaches, itself among them."""
    out = {}
    for a, b, *_ in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for x in nodes:
        seen, todo = {x}, [x]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        reach[x] = seen
    return reach


def test_weak_components_of_all_edges(spark, data, network):
    nodes, edges = network
    reach = closure(nodes, [*edges, *((b, a) for a, b, _ in edges)])
    got = {r["node"]: r["component"] for r in graph_queries.weakly_connected_components(spark, data).collect()}
    assert got == {x: min(reach[x] & set(nodes)) for x in nodes}


def test_strong_components_of_all_edges(spark, data, network):
    nodes, edges = network
    reach = closure(nodes, edges)
    want = {x: min(y for y in reach[x] if x in reach.get(y, ())) for x in nodes}
    assert {r["node"]: r["component"] for r in graph_queries.scc(spark, data).collect()} == want
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    got = {(r["node"], r["component"], r["size"], r["subnetwork"]) for r in graph_queries.subnetwork_marking(spark, data).collect()}
    assert got == {(x, c, sizes[c], sizes[c] < 200) for x, c in want.items()}


def test_shortcuts_keep_distances_of_all_edges(spark, data, network):
    want = dijkstra(network[1], 5)
    customers = set(network[0])
    assert {r["target"]: r["w"] for r in route_queries.shortcut_search(spark, data).collect()} == {x: w for x, w in want.items() if x in customers}


def test_shortcuts_stand_for_ways_of_their_weight(spark, data):
    edges = {r["edge"]: (r["src"], r["dst"], r["w"]) for r in derived.edges(spark, data).collect()}
    rows = route_queries.shortcut_unpack(spark, data).collect()
    assert rows
    for r in rows:
        way = [edges[p] for p in r["parts"]]
        assert (way[0][0], way[-1][1], sum(x[2] for x in way)) == (r["base"], r["adj"], r["w"])
        assert all(a[1] == b[0] for a, b in zip(way, way[1:]))


def test_contraction_ends_when_no_node_can_be_taken_out(spark):
    rows = [(i, i + 1, i, 1) for i in range(40)] + [(i + 1, i, 100 + i, 1) for i in range(40)]
    levels, up = contraction.contract(spark.createDataFrame(rows, "base bigint, adj bigint, edge bigint, w bigint"), None, None)
    assert levels.filter(f"level = {contraction.CORE}").count() <= 1
    pairs = spark.createDataFrame([(0, 40), (33, 2), (7, 7)], "source bigint, target bigint")
    assert {(r["source"], r["target"]): r["w"] for r in contraction.hierarchy_search(levels, up, pairs).collect()} == {(0, 40): 40, (33, 2): 31, (7, 7): 0}


def test_sweep_finds_what_a_plain_search_finds(spark):
    """One source and all targets: no search from each target, and no parts of shortcuts that nobody asks for."""
    import random

    from waymesh.operators import contraction, search

    r = random.Random(8)
    rows = [(r.randrange(60), r.randrange(60), i, r.randrange(1, 40)) for i in range(150)]
    edges = spark.createDataFrame(rows, "base bigint, adj bigint, edge bigint, w bigint")
    levels, up = contraction.contract(edges, None, None, parts=False)
    assert up.columns == ["base", "adj", "w"] and levels.filter(f"level < {contraction.CORE}").count() > 0
    src = spark.createDataFrame([(5,), (6,), (5,)], "source bigint")
    got = sorted(tuple(x) for x in contraction.sweep(levels, up, src).collect())
    assert got == sorted(tuple(x) for x in search.shortest(edges, src.distinct()).select("source", "node", "w").collect())
