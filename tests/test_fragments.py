"""Searches over one and over many fragments, against plain code."""

import heapq
import random

import pytest

from waymesh.operators import search

E = "base bigint, adj bigint, edge bigint, w bigint"


def graph(seed, n=40, m=160, hub=0):
    r = random.Random(seed)
    rows = [(r.randrange(n), r.randrange(n), i, r.randrange(0, 30)) for i in range(m)]
    return rows + [(7, r.randrange(n), m + i, r.randrange(5, 60)) for i in range(hub)]


def plain(edges, source, rounds=None):
    """Least (weight, hops) of each node."""
    out, best, queue = {}, {}, [(0, 0, source)]
    for a, b, _, w in edges:
        out.setdefault(a, []).append((b, w))
    while queue:
        w, h, x = heapq.heappop(queue)
        if x in best:
            continue
        best[x] = (w, h)
        for y, v in out.get(x, ()):
            heapq.heappush(queue, (w + v, h + 1, y))
    return best


def bounded(edges, source, rounds):
    best = {source: 0}
    for _ in range(rounds):
        new = dict(best)
        for a, b, _, w in edges:
            if a in best:
                new[b] = min(new.get(b, 10**9), best[a] + w)
        best = new
    return best


@pytest.mark.parametrize("size", [10**6, 90])
def test_trees(spark, size):
    edges = graph(1, hub=90)
    df = spark.createDataFrame([*edges, (None, 3, 900, 1), (0, None, 901, 1), (0, 3, 902, None)], E)
    src = spark.createDataFrame([(0,), (5,), (None,), (0,), (999,)], "source bigint")
    got = {(r["source"], r["node"]): (r["w"], r["hops"]) for r in search.shortest(df, src, fragment_arcs=size).collect()}
    assert got == {(s, k): v for s in (0, 5, 999) for k, v in plain(edges, s).items()}
    got = {r["node"]: r["w"] for r in search.shortest(df, src.filter("source = 0"), limit=25, fragment_arcs=size).collect()}
    assert got == {k: w for k, (w, _) in plain(edges, 0).items() if w <= 25}
    for n in (0, 1, 2) if size > 1000 else (2,):
        got = {r["node"]: r["w"] for r in search.shortest(df, src.filter("source = 5"), rounds=n, fragment_arcs=size).collect()}
        assert got == bounded(edges, 5, n)


@pytest.mark.parametrize("size", [10**6, 110])
def test_goals(spark, size):
    edges = graph(2, 60, 200)
    df = spark.createDataFrame(edges, E)
    want = {s: plain(edges, s) for s in range(60)}
    pairs = [(0, 9), (0, 31), (4, 50), (8, 8), (3, 999)]
    goals = spark.createDataFrame([*pairs, (None, 3), (4, None)], "source bigint, target bigint")
    src = goals.select("source").distinct()
    got = {(r["source"], r["node"]): r["w"] for r in search.shortest(df, src, goals=goals, fragment_arcs=size).collect()}
    for s, t in pairs:
        assert got.get((s, t)) == (want[s][t][0] if t in want[s] else None)
    assert all(w == want[s][n][0] for (s, n), w in got.items())
    near = {(r["source"], r["node"]): r["w"] for r in search.shortest(df, src, shared=spark.createDataFrame([(9,), (31,), (None,)], "target bigint"), fragment_arcs=size).collect()}
    assert all(near.get((s, t)) == (want[s][t][0] if t in want[s] else None) for s in (0, 4, 8, 3) for t in (9, 31))
    req = [(i, i % 60, (i * 7) % 60) for i in range(40)]
    requests = spark.createDataFrame([*req, (77, None, 1), (78, 0, 999)], "request bigint, source bigint, target bigint")
    table = search.landmark_table(df, spark.createDataFrame([(1,), (30,)], "landmark bigint"))
    marks = search.landmark_features(table)
    plane = search.beeline_features(spark.createDataFrame([(i, 50.0 + i * 1e-6, 8.0) for i in range(60)], "node bigint, lat double, lon double"), 0.0)
    effort = {}
    for name, features, both in (("stop", None, False), ("both", None, True), ("marks", marks, False), ("both marks", marks, True), ("plane", plane, False), ("both plane", plane, True)):
        if size < 1000 and name not in ("both", "marks"):
            continue
        answers, labels = search.goal_search(df, requests, features, both, fragment_arcs=size)
        assert {r["request"]: r["w"] for r in answers.collect()} == {i: want[s][t][0] for i, s, t in req if t in want[s]}, name
        effort[name] = labels.count()
    if size > 1000:
        everything = sum(len(want[s]) for _, s, _ in req)
        assert effort["stop"] < everything
        assert effort["marks"] < effort["stop"]


@pytest.mark.parametrize(("size", "u_turn"), [(10**6, None), (10**6, 3), (60, 3)])
def test_turns(spark, size, u_turn):
    r = random.Random(4)
    both = [(a, b, e, w) for a, b, e, w in graph(5, 14, 50) if a != b]
    both += [(b, a, e, w) for a, b, e, w in both if e % 3 == 0]
    hub = [(7, r.randrange(14), 1000 + i, r.randrange(1, 30)) for i in range(80)]
    edges = both + [x for x in hub if x[1] != 7]
    ids = sorted({x[2] for x in edges})
    turns = [(a, b, r.choice([None, 7, 20])) for a in ids for b in ids if r.random() < 0.2]
    cost = {(a, b): c for a, b, c in turns}
    best, queue = {}, [(w, e, b) for a, b, e, w in edges if a == 0]
    heapq.heapify(queue)
    while queue:
        w, e, x = heapq.heappop(queue)
        if (e, x) in best:
            continue
        best[e, x] = w
        for a, b, f, v in edges:
            c = u_turn if e == f else cost.get((e, f), 0)
            if a == x and c is not None:
                heapq.heappush(queue, (w + v + c, f, b))
    got = search.turn_search(spark.createDataFrame(edges, E), spark.createDataFrame([(0,), (0,)], "source bigint"), spark.createDataFrame(turns, "from_edge bigint, to_edge bigint, cost bigint"), u_turn, fragment_arcs=size)
    assert {(x["edge"], x["node"]): x["w"] for x in got.collect()} == best


def test_nothing(spark):
    none = spark.createDataFrame([], E)
    src = spark.createDataFrame([(3,)], "source bigint")
    assert [(r["source"], r["node"], r["w"]) for r in search.shortest(none, src).collect()] == [(3, 3, 0)]
    assert search.shortest(none, src.limit(0)).count() == 0
    assert search.turn_search(none, src, spark.createDataFrame([], "from_edge bigint, to_edge bigint, cost bigint")).count() == 0
    answers, _ = search.goal_search(none, spark.createDataFrame([(1, 3, 3), (2, 3, 4)], "request bigint, source bigint, target bigint"), both=True)
    assert [(r["request"], r["w"]) for r in answers.collect()] == [(1, 0)]
