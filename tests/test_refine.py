import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waymesh.functions import calendar, geo, text
from waymesh.operators import refine, relational, sequences, transit


@pytest.mark.parametrize("rule, day, want", [
    ("Nov - Mar", (2024, 1, 5), True), ("Nov - Mar", (2024, 4, 1), False), ("2023 Oct 23 - 2024 Jan 5", (2024, 1, 5), True), ("2023 Oct 23 - 2024 Jan 5", (2024, 10, 25), False),
    ("Mo - Fr", (2024, 3, 2), False), ("Fr - Mo", (2024, 3, 2), True), ("2024-03-02", (2024, 3, 2), True), ("Mar 5", (2025, 3, 5), True), ("Mar 1 - 7", (2025, 3, 5), True), ("PH, Mo", (2024, 3, 4), True), ("nonsense", (2024, 1, 1), None), ("06:00-18:00", (2024, 1, 1), None),
])
def test_date_ranges(rule, day, want):
    assert calendar.in_range(rule, dt.date(*day)) is want


def test_conditional_values(spark):
    df = spark.createDataFrame([("no @ (Nov - Mar)",), ("no @ (Nov - Mar); yes @ (Mo)",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(calendar.conditional_on(F.col("t"), dt.date(2024, 1, 1))).collect()] == ["no", "yes", None, None]
    d = spark.createDataFrame([(3.0,), (444.0,), (1500.0,), (2000.0,)], "m double")
    assert [tuple(r) for r in d.select(calendar.spoken_distance(F.col("m")), calendar.spoken_distance(F.col("m"), True)).collect()] == [("0 m", "0 ft"), ("440 m", "1450 ft"), ("1.5 km", "4900 ft"), ("2 km", "1.2 mi")]
    assert spark.createDataFrame([("hello world",)], "t string").select(calendar.stable_hash(F.col("t"))).head()[0] == 1794106052


def test_texts(spark):
    df = spark.createDataFrame([("1:30",), ("90",), ("PT1H30M",), ("P1DT1S",), ("x",), (None,), ("P",), ("01:02:03",)], "t string")
    assert [r[0] for r in df.select(text.seconds_of_duration(F.col("t"))).collect()] == [5400, 5400, 5400, 86401, None, None, None, 3723]
    n = spark.createDataFrame([("Main St.", "main street"), ("The Road", "road"), ("Elm Street", "Oak Street"), ("", "x"), (None, "x")], "a string, b string")
    assert [(r["a"], r["b"]) for r in refine.similar_names(n, "a", "b").collect()] == [("Main St.", "main street")]
    c = spark.createDataFrame([("aé地b",)], "t string").select(*[text.cut_bytes(F.col("t"), k).alias(str(k)) for k in (0, 1, 2, 3, 5, 6, 7)]).head()
    assert tuple(c) == ("", "a", "a", "aé", "aé", "aé地", "aé地b")
    k = spark.createDataFrame([("maxSpeedLimit", "max_speed_limit")], "a string, b string").select(text.snake_case(F.col("a")), text.camel_case(F.col("b"))).head()
    assert tuple(k) == ("max_speed_limit", "maxSpeedLimit")


def test_geometry(spark):
    r = spark.range(1).select(
        geo.compass_point(F.lit(359.0)).alias("n"), geo.turn_angle_deg(F.lit(350.0), F.lit(10.0)).alias("t"), geo.clockwise(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("c"),
        geo.distance_3d(F.lit(3.0), F.lit(0.0), F.lit(4.0)).alias("d"), geo.between(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.5)).alias("m"), geo.segment_distance_m(F.lit(0.001), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("s"),
        refine.heading_fits(F.lit(350.0), F.lit(20.0)).alias("h"), refine.curbside(F.lit(0.0), F.lit(90.0)).alias("side"),
    ).head()
    assert (r["n"], round(r["t"], 6), r["c"], r["d"], r["h"], r["side"]) == ("N", 20.0, True, 5.0, True, "right")
    assert abs(r["m"]["lon"] - 45) < 1e-9 and abs(r["s"] - 111.19) < 0.1


def test_hilbert_keys_are_a_walk(spark):
    pts = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y")).withColumn("k", geo.hilbert_key(F.col("x"), F.col("y"), 4)).orderBy("k").collect()
    assert [p["k"] for p in pts] == list(range(256))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(pts, pts[1:]))


def test_layout(spark):
    r = random.Random(0)
    nodes = spark.createDataFrame([(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(300)], "node bigint, lat double, lon double")
    got = refine.hilbert_order(nodes).orderBy("key", "node").collect()
    assert [g["new_id"] for g in got] == list(range(300))
    e = refine.relabel(spark.createDataFrame([(0, 1)], "src bigint, dst bigint"), spark.createDataFrame([(0, 7), (1, 9)], "node bigint, new_id bigint"))
    assert tuple(e.select("src", "dst").head()) == (7, 9)


def test_lines(spark):
    rows = [(1, i, float(i), e) for i, e in enumerate([0.0, 10.0, 50.0, 30.0, 40.0])]
    df = spark.createDataFrame(rows, "p int, seq int, x double, ele double")
    s = refine.slopes(df, ["p"], "seq", "x", "ele").head()
    assert s["average_slope"] == 1000.0 and s["max_slope"] == 4500.0
    b = refine.bridge_heights(df.withColumn("bridge", F.col("seq") == 2), ["p"], "seq", "x", "ele", "bridge").orderBy("seq").collect()
    assert [r["ele"] for r in b] == [0.0, 10.0, 20.0, 30.0, 40.0]
    pts = df.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("x", "ele"))).alias("ps"))
    assert [p["ele"] for p in pts.select(refine.smooth_ramer(F.col("ps"), 35.0).alias("o")).head()["o"]] == [0.0, 10.0, 20.0, 30.0, 40.0]
    t = sequences.thin(df, ["p"], ["seq"], "x", 2.0).orderBy("seq").collect()
    assert [(r["seq"], r["carried"]) for r in t] == [(0, 0.0), (2, 2.0), (4, 2.0)]
    assert sequences.simplify([(0, 0), (1, 0.01), (2, 0), (3, 5)], 0.1) == [0, 2, 3]


def test_sets_and_turns(spark):
    r = spark.createDataFrame([(1, [1, 2]), (2, [1, 2, 3]), (3, [2, 1]), (4, [4]), (5, [])], "rule int, edges array<int>")
    assert sorted(x["rule"] for x in refine.minimal_sets(r).collect()) == [1, 4, 5]
    u = spark.createDataFrame([(1, 0, 0, "A", 50.0), (1, 1, -2, "B", 10.0), (1, 2, -2, "A", 50.0), (1, 3, 2, "C", 10.0)], "path int, no int, sign int, name string, distance_m double")
    assert [tuple(x) for x in refine.u_turns(u).collect()] == [(1, 2)]
    assert refine.rule_range([{"if": "true", "limit_to": "100"}, {"if": "x", "multiply_by": "0.5"}, {"if": "y", "add": "f * 2"}], 999, 999, {"f": (1, 3)}) == (50.0, 106.0)


def test_transit_extras(spark):
    calls = spark.createDataFrame([(1, 1, 1, 100, 100), (1, 2, 2, 200, 200), (2, 1, 1, 150, 150), (2, 2, 2, 190, 190), (3, 1, 1, 300, 300), (3, 2, 2, 400, 400)], "trip bigint, seq int, stop bigint, arrival_s bigint, dep_s bigint")
    got = {tuple(r) for r in refine.profile_query(calls, 1, 2, 0, 350).collect()}
    assert got == {(150, 190, 1), (300, 400, 1)}
    stops = spark.createDataFrame([(1, 47.0, 8.0), (2, 47.001, 8.0), (3, 48.0, 8.0)], "stop bigint, lat double, lon double")
    assert {(r["from_stop"], r["to_stop"]) for r in refine.walk_transfers(stops, 200).collect()} == {(1, 2), (2, 1)}
    labels = transit.earliest_arrival(calls, spark.createDataFrame([(9, 1, 0)], "source bigint, stop bigint, at bigint"), transfers=spark.createDataFrame([(2, 7, 60)], "from_stop bigint, to_stop bigint, walk_s bigint"))
    assert {(r["stop"], r["arrival"], r["trips"]) for r in labels.collect()} == {(1, 0, 0), (2, 190, 1), (7, 250, 1)}
    d = refine.urban_density(spark.createDataFrame([(1, 47.0, 8.0, 100.0), (2, 47.0001, 8.0, 100.0), (3, 50.0, 8.0, 5.0)], "edge bigint, lat double, lon double, length_m double"), 100, 0.01, 0.5)
    assert {r["edge"]: r["urban"] for r in d.collect()} == {1: "residential", 2: "residential", 3: "rural"}


def test_relational_helpers(spark):
    left = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(90)], "v int, k int")
    right = spark.createDataFrame([(k, f"n{k}") for k in (1, 3, 3, 6)], "k int, n string")
    assert relational.salted_join(left, right, ["k"], 10).count() == left.join(right, "k").count() == 63
    ask = spark.createDataFrame([(1, 5, "a"), (1, 20, "b"), (2, 1, "c")], "g int, t int, id string")
    ev = spark.createDataFrame([(1, 5, 50), (1, 5, 51), (1, 7, 70)], "g int, t int, x int")
    assert {(r["id"], r["x"]) for r in relational.next_event(ask, ev, ["g"], "t", ["x"]).collect()} == {("a", 50), ("b", None), ("c", None)}
    assert {(r["id"], r["x"]) for r in relational.as_of(ask, ev, ["g"], "t", ["x"]).collect()} == {("a", 51), ("b", 70), ("c", None)}
