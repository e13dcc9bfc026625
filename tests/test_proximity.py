import math
import random

from pyspark.sql import functions as F

from waymesh.functions import polyline
from waymesh.operators import proximity as p

PTS = "id bigint, lat double, lon double"


def metres(a, b):
    (y1, x1), (y2, x2) = ((math.radians(v) for v in q) for q in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))


def test_pairs_equal_brute_force(spark):
    r = random.Random(3)
    pts = []
    for lat, lon in ((0, 0), (47, 8), (89.9999, 30), (-89.99995, -170), (60, 179.9999), (10, -180), (80, 0)):
        for _ in range(60):
            dy = r.uniform(-60, 60) / 111_000
            dx = r.uniform(-60, 60) / 111_000 / max(1e-6, math.cos(math.radians(lat)))
            y, x = max(-90, min(90, lat + dy)), (lon + dx + 180) % 360 - 180
            pts.append((len(pts), float(y), float(x)))
    pts += [(len(pts) + i, 12.0, 13.0) for i in range(30)] + [(1000, None, 1.0), (1001, 90.0, 0.0), (1002, 90.0, 120.0)]
    want = {(a[0], b[0]) for i, a in enumerate(pts) for b in pts[i + 1 :] if a[1] is not None and b[1] is not None and metres(a[1:], b[1:]) <= 30}
    for hot in (2000, 7):
        got = p.near_pairs(spark.createDataFrame(pts, PTS), 30, hot).select("id_a", "id_b").collect()
        assert len(got) == len(set(got)) and {tuple(x) for x in got} == want
    assert len(want) > 500


def test_polygons(spark):
    ring = lambda *q: [{"lon": float(x), "lat": float(y)} for x, y in q]
    areas = spark.createDataFrame(
        [("c", [ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4)), ring((0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8))]), ("c", [ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4)), ring((0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8))]), ("world", [ring((-180, -90), (180, -90), (180, 90), (-180, 90))]), ("none", []), ("null", None), ("line", [ring((0, 0), (1, 1))])],
        "area_id string, rings array<array<struct<lon:double,lat:double>>>",
    )
    pts = spark.createDataFrame([(1, 0.5, 1.5), (2, 0.5, 0.5), (3, 3.0, 2.0), (4, 3.0, 0.5), (5, None, None)], PTS)
    got = {tuple(r) for r in p.containing_areas(pts, areas).collect()}
    assert got == {(1, "c"), (4, "c"), (1, "world"), (2, "world"), (3, "world"), (4, "world")}
    assert p.containing_areas(pts, areas.limit(0)).count() == 0


def test_positions(spark):
    rows = [(1, [8.0, 47.0], None, None), (2, [8.0, 47.0, 500.0], None, None), (3, [8.0], None, None), (4, None, polyline.encode([(47.12345, -8.5)]), None), (5, None, polyline.encode([(1, 2), (3, 4)]), None), (6, None, "", None), (7, None, None, (0.0, 0.0)), (8, None, None, (None, 8.0)), (9, None, None, (91.0, 0.0)), (10, None, None, (float("nan"), 0.0)), (11, None, None, (0.0, 5.0)), (None, [8.0, 47.0], None, None), (12, None, None, None), (1, [8.0, 47.0], None, None), (13, [None, 47.0], None, None)]
    df = spark.createDataFrame([(*r, "2024-01-01") for r in rows], "location_id bigint, coordinates array<double>, snapped_waypoints string, coordinate struct<lat:double,lon:double>, received_at string")
    got = {r["location_id"]: (r["lat"], r["lon"]) for r in p.location_positions(df).collect()}
    assert got == {1: (47.0, 8.0), 2: (47.0, 8.0), 4: (47.12345, -8.5), 11: (0.0, 5.0)}
    assert p.close_by(df.limit(0), spark.createDataFrame([], "area_id string, rings array<array<struct<lon:double,lat:double>>>"), 30).count() == 0


def test_polyline_round_trip(spark):
    r = random.Random(1)
    lines = [[(round(r.uniform(-90, 90), 5), round(r.uniform(-180, 180), 5)) for _ in range(r.randint(0, 6))] for _ in range(50)]
    for line in lines:
        back = polyline.decode(polyline.encode(line))
        assert len(back) == len(line) and all(abs(a - b) < 1e-9 for x, y in zip(back, line) for a, b in zip(x, y))
    assert polyline.decode("_") is None and polyline.decode(None) is None and polyline.decode("?") is None
    df = spark.createDataFrame([(polyline.encode(x),) for x in lines], "t string")
    one = df.select(polyline.decode_point(F.col("t")).alias("p"), polyline.decode_points(F.col("t")).alias("ps")).collect()
    for line, row in zip(lines, one):
        assert len(row["ps"]) == len(line)
        assert (row["p"] is not None) == (len(line) == 1)
        if row["p"] is not None:
            assert abs(row["p"]["lat"] - line[0][0]) < 1e-9 and abs(row["p"]["lon"] - line[0][1]) < 1e-9
