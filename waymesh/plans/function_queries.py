"""Scalar functions over positions and texts made of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions import calendar, geo, polyline, text
from waymesh.session import table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two points of each customer, with elevations."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), (47.0 + k * 7919 % 10_000 / 1e4).alias("a"), (8.0 + k * 104_729 % 10_000 / 1e4).alias("b"), (47.0 + k * 577 % 10_000 / 1e4).alias("c"), (8.0 + k * 733 % 10_000 / 1e4).alias("e"),
        F.when(k % 5 > 0, (k % 900).cast("double")).alias("h1"), (k % 700).cast("double").alias("h2"), (k % 360).cast("double").alias("deg"),
    )


_P = """WITH p AS (SELECT c_custkey AS id, 47.0::DOUBLE + c_custkey * 7919 % 10000 / 1e4::DOUBLE AS a, 8.0::DOUBLE + c_custkey * 104729 % 10000 / 1e4::DOUBLE AS b, 47.0::DOUBLE + c_custkey * 577 % 10000 / 1e4::DOUBLE AS c,
 8.0::DOUBLE + c_custkey * 733 % 10000 / 1e4::DOUBLE AS e, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 900 AS DOUBLE) END AS h1, CAST(c_custkey % 700 AS DOUBLE) AS h2, CAST(c_custkey % 360 AS DOUBLE) AS deg FROM customer)
"""
_HAV = "2 * 6371000 * asin(sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(e - b) / 2), 2)))"
_PLANE = "6371000 * sqrt(pow(radians(e - b) * cos(radians((a + c) / 2)), 2) + pow(radians(c - a), 2))"


def _points() -> tuple:
    return tuple(F.col(x) for x in ("a", "b", "c", "e"))


def distance_3d(spark, d):
    m = geo.distance_3d(geo.haversine_m(*_points()), F.col("h1"), F.col("h2"))
    return _pairs(spark, d).select("id", F.round(m, 4).alias("metres"))


def distance_measures(spark, d):
    p = _pairs(spark, d)
    box = geo.box_around(F.col("a"), F.col("b"), F.col("h2"))
    return p.select("id", F.round(geo.circumference_m(F.col("a")), 3).alias("parallel"), F.round(geo.plane_distance_m(*_points()), 4).alias("plane"), F.round(box["min_lat"], 9).alias("south"), F.round(box["max_lon"], 9).alias("east"), geo.crosses_date_line(F.col("b") - 180, F.col("e") + 160).alias("over"), geo.coordinate_int(F.col("a"), 1e6).alias("a_int"))


def segment_distance(spark, d):
    m = geo.segment_distance_m(F.col("a"), F.col("b"), F.col("c"), F.col("e"), F.col("c") + 0.1, F.col("e") + F.lit(0.2))
    return _pairs(spark, d).select("id", F.round(m, 3).alias("metres"))


def project_coordinate(spark, d):
    t = geo.project(F.col("a"), F.col("b"), F.col("h2") * 10, F.col("deg"))
    return _pairs(spark, d).select("id", F.round(t["lat"], 8).alias("lat"), F.round(t["lon"], 8).alias("lon"))


def intermediate_point(spark, d):
    t = geo.between(*_points(), F.lit(0.25))
    return _pairs(spark, d).select("id", F.round(t["lat"], 8).alias("lat"), F.round(t["lon"], 8).alias("lon"))


def polyline_length(spark, d):
    at = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    line = F.array(at(F.col("a"), F.col("b")), at(F.col("c"), F.col("e")), at(F.col("a"), F.col("b")))
    return _pairs(spark, d).select("id", F.round(geo.line_length_m(line), 3).alias("metres"))


def compass_and_turns(spark, d):
    x = F.col("deg")
    return _pairs(spark, d).select("id", geo.compass_point(x).alias("compass"), geo.turn_angle_deg(x, F.col("h2") % 360).alias("turn"), geo.clockwise(F.lit(0.0), F.lit(0.0), F.col("a"), F.col("b"), F.col("c"), F.col("e")).alias("clockwise"))


def polyline_round_trip(spark, d):
    at = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    line = polyline.decode_points(polyline.encode_points(F.array(at(F.col("a"), F.col("b")), at(F.col("c"), F.col("e")))))
    return _pairs(spark, d).select("id", F.explode(line).alias("x")).select("id", F.round(F.col("x.lat") * 1e5).cast("bigint").alias("lat"), F.round(F.col("x.lon") * 1e5).cast("bigint").alias("lon"))


def hilbert_neighbours(spark, d):
    """Neighbours on the curve lie side by side, and all keys of the square come out."""
    square = spark.range(64 * 64).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y")).select("x", "y", geo.hilbert_key(F.col("x"), F.col("y"), 6).alias("key"))
    nxt = square.select((F.col("key") - 1).alias("key"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return square.join(nxt, "key").select("key", (F.abs(F.col("x") - F.col("x2")) + F.abs(F.col("y") - F.col("y2"))).alias("step"))


_DURATIONS = ("15", "01:30", "00:10:20", "PT1H30M", "P1D", "soon")


def text_helpers(spark, d):
    k = F.col("p_partkey")
    duration = F.element_at(F.array(*map(F.lit, _DURATIONS)), (k % 6 + 1).cast("int"))
    camel = F.concat(F.lower("p_brand"), F.lit("PartName"))
    return table(spark, d, "part").select(k.alias("id"), text.snake_case(F.replace(camel, F.lit("#"), F.lit(""))).alias("snake"), text.cut_bytes(F.col("p_name"), 9).alias("cut"), text.seconds_of_duration(duration).cast("bigint").alias("seconds"), calendar.spoken_distance((k * 37 % 4_000).cast("double")).alias("spoken"))


QUERIES = {f.__name__: f for f in (distance_3d, distance_measures, segment_distance, project_coordinate, intermediate_point, polyline_length, compass_and_turns, polyline_round_trip, hilbert_neighbours, text_helpers)}

SQL = {
    "distance_3d": _P + f"SELECT id, round(sqrt(pow({_HAV}, 2) + pow(coalesce(h2 - h1, 0), 2)), 4) AS metres FROM p",
    "distance_measures": _P + f"SELECT id, round(2 * pi() * 6371000 * cos(radians(a)), 3) AS parallel, round({_PLANE}, 4) AS plane, round(a - degrees(h2 / 6371000), 9) AS south, round(b + degrees(h2 / 6371000) / cos(radians(a)), 9) AS east, abs(b - 180 - (e + 160)) > 300 AS over, CAST(round(a * 1e6) AS BIGINT) AS a_int FROM p",
    "segment_distance": _P + """, q AS (SELECT *, cos(radians((c + c + 0.1::DOUBLE) / 2)) AS s FROM p), r AS (SELECT *, greatest(0, least(1, ((b - e) * s * 0.2::DOUBLE * s + (a - c) * 0.1::DOUBLE) / (pow(0.2::DOUBLE * s, 2) + pow(0.1::DOUBLE, 2)))) AS t FROM q),
 n AS (SELECT id, a, b, c + 0.1::DOUBLE * t AS y, e + 0.2::DOUBLE * t AS x FROM r) SELECT id, round(6371000 * sqrt(pow(radians(x - b) * cos(radians((a + y) / 2)), 2) + pow(radians(y - a), 2)), 3) AS metres FROM n""",
    "project_coordinate": _P + """, q AS (SELECT *, h2 * 10 / 6371000 AS d, sin(radians(a)) * cos(h2 * 10 / 6371000) + cos(radians(a)) * sin(h2 * 10 / 6371000) * cos(radians(deg)) AS s FROM p)
 SELECT id, round(degrees(asin(s)), 8) AS lat, round(b + degrees(atan2(sin(radians(deg)) * sin(d) * cos(radians(a)), cos(d) - sin(radians(a)) * s)), 8) AS lon FROM q""",
    "intermediate_point": _P + f""", q AS (SELECT *, ({_HAV}) / 6371000 AS d FROM p), r AS (SELECT *, CASE WHEN d = 0 THEN 0.75 ELSE sin(0.75 * d) / sin(d) END AS u, CASE WHEN d = 0 THEN 0.25 ELSE sin(0.25 * d) / sin(d) END AS v FROM q),
 s AS (SELECT id, u * cos(radians(a)) * cos(radians(b)) + v * cos(radians(c)) * cos(radians(e)) AS x, u * cos(radians(a)) * sin(radians(b)) + v * cos(radians(c)) * sin(radians(e)) AS y, u * sin(radians(a)) + v * sin(radians(c)) AS z FROM r)
 SELECT id, round(degrees(atan2(z, sqrt(x * x + y * y))), 8) AS lat, round(degrees(atan2(y, x)), 8) AS lon FROM s""",
    "polyline_length": _P + f"SELECT id, round(2 * ({_HAV}), 3) AS metres FROM p",
    "compass_and_turns": _P + """SELECT id, (['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'])[CAST(floor((deg + 11.25) / 22.5) AS INTEGER) % 16 + 1] AS compass,
 CASE WHEN (h2 % 360 - deg + 540) % 360 = 0 THEN 180 ELSE (h2 % 360 - deg + 540) % 360 - 180 END AS turn, a * e - b * c < 0 AS clockwise FROM p""",
    "polyline_round_trip": _P + "SELECT id, CAST(round(a * 1e5) AS BIGINT) AS lat, CAST(round(b * 1e5) AS BIGINT) AS lon FROM p UNION ALL SELECT id, CAST(round(c * 1e5) AS BIGINT), CAST(round(e * 1e5) AS BIGINT) FROM p",
    "hilbert_neighbours": "SELECT CAST(range AS BIGINT) AS key, CAST(1 AS BIGINT) AS step FROM range(4095)",
    "text_helpers": """SELECT p_partkey AS id, replace(lower(p_brand), '#', '') || '_part_name' AS snake, p_name[1:9] AS cut, CAST(([900, 5400, 620, 5400, 86400, NULL])[p_partkey % 6 + 1] AS BIGINT) AS seconds,
 CASE WHEN m < 1000 THEN CAST(CAST(round(m / 10.0) * 10 AS INTEGER) AS VARCHAR) || ' m' ELSE regexp_replace(CAST(round(m / 1000.0, 1) AS VARCHAR), '\\.0$', '') || ' km' END AS spoken FROM (SELECT *, p_partkey * 37 % 4000 AS m FROM part)""",
}
