"""Geometry, spatial joins, storage keys and event-time windows over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.operators import proximity, snapping
from waymesh.plans import derived
from waymesh.plans.derived import BASE_SQL
from waymesh.plans.problem_queries import INSIDE_SQL, POSITIONS_SQL
from waymesh.session import table
from waymesh.streaming import events as ev


def _pos(spark: SparkSession, d: str) -> DataFrame:
    n = derived.nodes(spark, d)
    return n.select("node", (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"))


def _roads(spark: SparkSession, d: str) -> DataFrame:
    """Short straight edges at the nodes."""
    p = _pos(spark, d)
    k = F.col("node")
    return p.select(k.alias("edge"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), (F.col("lat") + (k % 7 - 3) * 0.002).alias("lat_b"), (F.col("lon") + (k % 5 - 2) * 0.003).alias("lon_b"))


def _asks(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(s.alias("id"), (47.0 + s * 733 % 1000 / 1e4).alias("lat"), (8.0 + s * 577 % 1000 / 1e4).alias("lon"))


def haversine(spark, d):
    p = _pos(spark, d)
    return p.select("node", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(47.05), F.lit(8.05)), 3).alias("metres"), F.round(geo.plane_distance_m(F.col("lat"), F.col("lon"), F.lit(47.05), F.lit(8.05)), 3).alias("plane"))


def plane_projection(spark, d):
    t = geo.project_fraction(F.lit(47.05), F.lit(8.05), F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return _roads(spark, d).select("edge", F.round(t, 6).alias("fraction"))


def azimuth_sign(spark, d):
    r = _roads(spark, d)
    a = geo.azimuth_deg(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return r.filter("lat_a <> lat_b").select("edge", F.round(a, 5).alias("azimuth"), (F.col("lon_b") > F.col("lon_a")).alias("east"))


def morton_key(spark, d):
    x, y = F.col("node") * 7919 % 1024, F.col("node") * 104_729 % 1024
    return derived.nodes(spark, d).select("node", geo.morton_key(x, y, 10).alias("key"))


def tile_key(spark, d):
    x, y = geo.tile_xy(F.col("lat"), F.col("lon"), 12)
    return _pos(spark, d).select("node", x.alias("x"), y.alias("y"))


def project_point(spark, d):
    p = geo.project(F.col("lat"), F.col("lon"), F.lit(1000.0), F.lit(60.0))
    return _pos(spark, d).select("node", p.alias("p"), "lat", "lon").select("node", F.round("p.lat", 7).alias("lat2"), F.round("p.lon", 7).alias("lon2"))


def bbox_range_join(spark, d):
    k = F.col("n_nationkey")
    boxes = table(spark, d, "nation").select(k.alias("box"), (47.0 + k * 0.003).alias("min_lat"), (47.005 + k * 0.003).alias("max_lat"), (8.0 + k * 0.003).alias("min_lon"), (8.005 + k * 0.003).alias("max_lon"))
    return snapping.in_box(_roads(spark, d), boxes, 0.01)


def nearest_join(spark, d):
    got = snapping.nearest_edges(_asks(spark, d), _roads(spark, d), 0.01)
    return got.select("id", F.round("distance_m", 3).alias("metres"))


def point_in_polygon(spark, d):
    pts = proximity.location_positions(table(spark, d, "locations")).select(F.col("location_id").alias("id"), "lat", "lon")
    return proximity.containing_areas(pts, table(spark, d, "areas"))


def area_smallest_wins(spark, d):
    found = point_in_polygon(spark, d)
    sizes = table(spark, d, "areas").select("area_id", F.size(F.element_at("rings", 1)).cast("bigint").alias("size"))
    return snapping.smallest_area(found, sizes)


def bounding_box(spark, d):
    return derived.nodes(spark, d).groupBy("nation").agg(F.min("lat_e7").alias("south"), F.max("lat_e7").alias("north"), F.min("lon_e7").alias("west"), F.max("lon_e7").alias("east"))


def road_density(spark, d):
    """Edges within 1 km of each asked point, by the same cells as near points."""
    a, r = _asks(spark, d), _roads(spark, d)
    pts = a.select((F.col("id") + 1_000_000_000).alias("id"), "lat", "lon").unionByName(r.select(F.col("edge").alias("id"), F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon")))
    near = proximity.near_pairs(pts, 1000.0).filter("id_a < 1000000000 and id_b >= 1000000000")
    return near.groupBy((F.col("id_b") - 1_000_000_000).alias("id")).agg(F.count(F.lit(1)).alias("edges"))


def _text(df: DataFrame) -> DataFrame:
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.select(*[f(c) if c in ("window_start", "window_end") else F.col(c) for c in df.columns])


def tumbling_window(spark, d):
    return _text(ev.tumbling(table(spark, d, "events"), "1 day"))


def sliding_window(spark, d):
    return _text(ev.sliding(table(spark, d, "events"), "2 days", "1 day"))


def session_window(spark, d):
    return _text(ev.session_windows(table(spark, d, "events"), "6 hours"))


def latest_update_wins(spark, d):
    return ev.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def late_data_drop(spark, d):
    """Events that arrive more than a day behind the greatest time seen before them, were event_id the order of arrival."""
    from pyspark.sql import Window

    seen = F.max(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    e = table(spark, d, "events").withColumn("lag", seen - F.unix_micros(F.col("ts").cast("timestamp")))
    return e.groupBy("event_type").agg(F.expr("count(*) filter (where lag > 86400000000)").alias("late"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (haversine, plane_projection, azimuth_sign, morton_key, tile_key, project_point, bbox_range_join, nearest_join, point_in_polygon, area_smallest_wins, bounding_box, road_density, tumbling_window, sliding_window, session_window, latest_update_wins, late_data_drop)}

_POS = "pos AS (SELECT node, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon FROM nodes), roads AS (SELECT node AS edge, lat AS lat_a, lon AS lon_a, lat + (node % 7 - 3) * CAST(0.002 AS DOUBLE) AS lat_b, lon + (node % 5 - 2) * CAST(0.003 AS DOUBLE) AS lon_b FROM pos), asks AS (SELECT s_suppkey AS id, 47.0 + s_suppkey * 733 % 1000 / 1e4 AS lat, 8.0 + s_suppkey * 577 % 1000 / 1e4 AS lon FROM supplier)"
_B = f"WITH {BASE_SQL.strip()}, {_POS} "


def _hav(a: str, b: str, c: str, e: str) -> str:
    return f"2 * 6371000 * asin(sqrt(least(1, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))))"


def _plane(a: str, b: str, c: str, e: str) -> str:
    return f"6371000 * sqrt(pow(radians({e} - {b}) * cos(radians(({a} + {c}) / 2)), 2) + pow(radians({c} - {a}), 2))"


def _frac(y: str, x: str) -> str:
    k = "cos(radians((lat_a + lat_b) / 2))"
    dx, dy = f"((lon_b - lon_a) * {k})", "(lat_b - lat_a)"
    return f"CASE WHEN {dx} * {dx} + {dy} * {dy} = 0 THEN 0 ELSE greatest(0, least(1, (({x} - lon_a) * {k} * {dx} + ({y} - lat_a) * {dy}) / ({dx} * {dx} + {dy} * {dy}))) END"


_PIP = POSITIONS_SQL + ", " + INSIDE_SQL


SQL = {
    "haversine": _B + f"SELECT node, round({_hav('lat', 'lon', '47.05', '8.05')}, 3) AS metres, round({_plane('lat', 'lon', '47.05', '8.05')}, 3) AS plane FROM pos",
    "plane_projection": _B + f"SELECT edge, round({_frac('47.05', '8.05')}, 6) AS fraction FROM roads",
    "azimuth_sign": _B + "SELECT edge, round((degrees(atan2((lon_b - lon_a) * cos(radians((lat_a + lat_b) / 2)), lat_b - lat_a)) + 360) % 360, 5) AS azimuth, lon_b > lon_a AS east FROM roads WHERE lat_a <> lat_b",
    "morton_key": _B + "SELECT node, CAST(" + " + ".join(f"((node * 7919 % 1024 >> {i}) & 1) * {4**i} + ((node * 104729 % 1024 >> {i}) & 1) * {2 * 4**i}" for i in range(10)) + " AS BIGINT) AS key FROM nodes",
    "tile_key": _B + "SELECT node, CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS y FROM pos",
    "bbox_range_join": _B + "SELECT n_nationkey AS box, edge FROM roads JOIN nation ON least(lat_a, lat_b) <= 47.005 + n_nationkey * CAST(0.003 AS DOUBLE) AND greatest(lat_a, lat_b) >= 47.0 + n_nationkey * CAST(0.003 AS DOUBLE) AND least(lon_a, lon_b) <= 8.005 + n_nationkey * CAST(0.003 AS DOUBLE) AND greatest(lon_a, lon_b) >= 8.0 + n_nationkey * CAST(0.003 AS DOUBLE)",
    "nearest_join": _B + f", f AS (SELECT id, lat, lon, lat_a, lon_a, lat_b, lon_b, {_frac('lat', 'lon')} AS t FROM asks JOIN roads ON true) SELECT id, round(min({_plane('lat', 'lon', '(lat_a + (lat_b - lat_a) * t)', '(lon_a + (lon_b - lon_a) * t)')}), 3) AS metres FROM f GROUP BY 1",
    "point_in_polygon": _PIP + " SELECT id, area_id FROM inside",
    "area_smallest_wins": _PIP + " SELECT id, arg_min(area_id, (len(rings[1]), area_id)) AS area_id FROM inside JOIN areas USING (area_id) GROUP BY 1",
    "bounding_box": _B + "SELECT nation, min(lat_e7) AS south, max(lat_e7) AS north, min(lon_e7) AS west, max(lon_e7) AS east FROM nodes GROUP BY 1",
    "road_density": _B + f"SELECT id, count(*) AS edges FROM asks JOIN roads ON {_hav('lat', 'lon', 'lat_a', 'lon_a')} <= 1000 GROUP BY 1",
    "tumbling_window": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL",
    "sliding_window": "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n FROM (SELECT date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS s FROM events, range(2) t(i)) GROUP BY 1, 2",
    "session_window": "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, user_id, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 21600000000 THEN 1 ELSE 0 END AS c FROM events)) GROUP BY user_id, s",
    "latest_update_wins": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "late_data_drop": "SELECT event_type, count(*) FILTER (WHERE lag > 86400000000) AS late, count(*) AS n FROM (SELECT event_type, max(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - epoch_us(ts) AS lag FROM events) GROUP BY 1",
}
