"""Points near other points, and the regions that contain them.

Points are hashed to grid cells twice as wide as the radius; each point looks
into the one to four cells its circle touches, and the great-circle distance
decides.  The width of a cell in degrees of longitude follows its latitude
band, so the grid holds at the poles and across the antimeridian.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geo import haversine_m
from waymesh.functions.polyline import decode_point
from waymesh.session import cut, join_small

EARTH_M = 6_371_000.0
HOT_CELL = 2_000


def location_positions(locations: DataFrame) -> DataFrame:
    """(location_id, lat, lon) of the usable positions, one per location.

    The first set one of ``coordinates`` (lon, lat, perhaps elevation),
    ``snapped_waypoints`` (a polyline of one point) and ``coordinate`` counts.
    Missing, incomplete and non-finite positions, those beyond +-90 and +-180,
    and exactly (0, 0) are left out, as are rows without an id.  Repeated rows
    count once; of different positions under one id the earliest received one.
    """
    point = decode_point(F.col("snapped_waypoints"))
    xy, ll = F.col("coordinates"), F.col("coordinate")
    full = F.size(xy) >= 2
    lon = F.when(xy.isNotNull(), F.when(full, F.get(xy, F.lit(0)))).when(F.col("snapped_waypoints").isNotNull(), point["lon"]).otherwise(ll["lon"])
    lat = F.when(xy.isNotNull(), F.when(full, F.get(xy, F.lit(1)))).when(F.col("snapped_waypoints").isNotNull(), point["lat"]).otherwise(ll["lat"])
    rows = locations.select("location_id", lat.alias("lat"), lon.alias("lon"), "received_at")
    fit = F.col("location_id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    first = rows.filter(fit).groupBy("location_id").agg(F.min(F.struct("received_at", "lat", "lon")).alias("p"))
    return first.select("location_id", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def _grid(radius_m: float):
    """Band of a latitude, number of cells of a band, cell of a longitude, half width of a circle in degrees."""
    delta = radius_m / EARTH_M * (1 + 1e-9) + 1e-12
    tall = 2 * math.degrees(delta)
    band = lambda lat: F.floor((lat + 90) / tall).cast("bigint")

    def count(b: Column) -> Column:
        low, high = b * tall - 90, (b + 1) * tall - 90
        edge = F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(high)))
        wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(delta)) / F.greatest(F.lit(1e-12), F.cos(F.radians(edge))))))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) / (2 * wide))).cast("bigint")

    def reach(lat: Column) -> Column:
        near_pole = F.abs(lat) + math.degrees(delta) >= 90
        return F.when(near_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(delta)) / F.cos(F.radians(lat))))) + 1e-9)

    return math.degrees(delta), band, count, reach


def near_pairs(points: DataFrame, radius_m: float, hot_cell: int = HOT_CELL) -> DataFrame:
    """Pairs (id_a < id_b, distance_m) of ``points``(id, lat, lon) at most ``radius_m`` apart.

    Each pair comes once.  A cell with more than ``hot_cell`` points is split
    over several tasks: its points are salted, and those that look into it are
    copied to every salt.  ``id`` must be unique; rows with a null are left out.
    """
    pad, band, count, reach = _grid(radius_m)
    pts = points.filter(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", "lat", "lon")
    home = pts.withColumn("band", band(F.col("lat"))).withColumn("n", count(F.col("band")))
    home = home.withColumn("cell", F.pmod(F.floor((F.col("lon") + 180) / 360.0 * F.col("n")).cast("bigint"), F.col("n"))).drop("n")
    look = pts.withColumn("w", reach(F.col("lat"))).withColumn("band", F.explode(F.sequence(band(F.greatest(F.lit(-90.0), F.col("lat") - pad)), band(F.least(F.lit(90.0), F.col("lat") + pad)))))
    look = look.withColumn("n", count(F.col("band")))
    # one turn round the globe at most, and no cell twice
    low = F.floor((F.col("lon") - F.col("w") + 180) / 360.0 * F.col("n")).cast("bigint")
    high = F.floor((F.col("lon") + F.col("w") + 180) / 360.0 * F.col("n")).cast("bigint")
    look = look.withColumn("cell", F.explode(F.sequence(low, F.least(high, low + F.col("n") - 1)))).withColumn("cell", F.pmod("cell", F.col("n")))
    look = look.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "band", "cell")
    crowd = home.groupBy("band", "cell").count().filter(F.col("count") > hot_cell)
    crowd = crowd.select("band", "cell", F.ceil(F.col("count") / hot_cell).cast("int").alias("salts"))
    crowd = cut(crowd)  # at most one row for every hot_cell points
    home = join_small(home, crowd, ["band", "cell"], made=True).withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("salts"))).otherwise(0).cast("int"))
    look = join_small(look, crowd, ["band", "cell"], made=True).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
    home = home.select("band", "cell", "salt", F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    pairs = look.drop("salts").join(home, ["band", "cell", "salt"]).filter((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("lat_a") - F.col("lat_b")) <= pad))
    d = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), EARTH_M)
    return pairs.withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m).select("id_a", "id_b", "distance_m")


def _ring_sides(ring: Column) -> Column:
    """Array of sides (x1, y1, x2, y2) of a ring; an open ring is closed."""
    n = F.size(ring)
    index = F.when(n >= 2, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.struct(F.get(ring, i)["lon"].alias("x1"), F.get(ring, i)["lat"].alias("y1"), F.get(ring, (i + 1) % n)["lon"].alias("x2"), F.get(ring, (i + 1) % n)["lat"].alias("y2")))


def _odd(sides: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: a ray to the east crosses an odd number of sides."""

    def crosses(s: Column) -> Column:
        return ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"])

    return F.size(F.filter(sides, crosses)) % 2 == 1


def containing_areas(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, area_id) for each of ``points``(id, lat, lon) inside an area(area_id, rings).

    In the plane of lon and lat: within the first ring and in none of the
    others.  Every area is cut into cells of a size that fits it (at most 25),
    and points look up their cell at each size in use (there are at most 12).
    The join takes a broadcast only where Spark finds the areas small enough.
    Areas without an outline contain nothing; repeated areas count once.
    """
    smallest = 0.25
    rings = F.transform("rings", _ring_sides)
    outline = F.get("rings", F.lit(0))
    box = areas.filter(F.size("rings") >= 1).filter(F.size(outline) >= 3).select(
        "area_id", rings.alias("sides"),
        F.array_min(F.transform(outline, lambda p: p["lon"])).alias("x1"), F.array_max(F.transform(outline, lambda p: p["lon"])).alias("x2"),
        F.array_min(F.transform(outline, lambda p: p["lat"])).alias("y1"), F.array_max(F.transform(outline, lambda p: p["lat"])).alias("y2"),
    )
    span = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(smallest))
    box = box.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(span / (4 * smallest)))).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level")) * smallest
    axis = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size).cast("int"), F.floor(F.col(high) / size).cast("int")))
    tiles = box.withColumn("cx", axis("x1", "x2")).withColumn("cy", axis("y1", "y2"))
    levels = sorted(r["level"] for r in box.select("level").distinct().collect())  # at most 12: the ladder ends at the globe
    if not levels:
        return points.select("id", F.lit(None).cast(areas.schema["area_id"].dataType).alias("area_id")).limit(0)
    rows = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", "lat", "lon", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    rows = rows.withColumn("cx", F.floor(F.col("lon") / size).cast("int")).withColumn("cy", F.floor(F.col("lat") / size).cast("int"))
    hit = rows.join(tiles, ["level", "cx", "cy"]).filter(F.col("lon").between(F.col("x1"), F.col("x2")) & F.col("lat").between(F.col("y1"), F.col("y2")))
    x, y = F.col("lon"), F.col("lat")
    inside = _odd(F.get("sides", F.lit(0)), x, y) & ~F.exists(F.slice("sides", 2, F.greatest(F.lit(1), F.size("sides"))), lambda s: _odd(s, x, y))
    return hit.filter(inside).select("id", "area_id").distinct()


def close_by(locations: DataFrame, areas: DataFrame, radius_m: float) -> DataFrame:
    """(relation, location_id, other_id): ``near`` pairs of locations and the areas each is ``inside`` of."""
    pts = cut(location_positions(locations).select(F.col("location_id").alias("id"), "lat", "lon"))  # used four times below
    near = near_pairs(pts, radius_m).select(F.lit("near").alias("relation"), F.col("id_a").alias("location_id"), F.col("id_b").cast("string").alias("other_id"))
    inside = containing_areas(pts, areas).select(F.lit("inside").alias("relation"), F.col("id").alias("location_id"), F.col("area_id").alias("other_id"))
    return near.unionByName(inside)
