"""Geometry on the sphere and in the plane, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the mean radius used for road distances, in metres.
MEAN_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_RADIUS_M) -> Column:
    """Great-circle distance in metres; null if any input is null."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def plane_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_RADIUS_M) -> Column:
    """Equirectangular distance: exact enough within a few kilometres and cheaper than the sphere."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return radius * F.sqrt(x * x + y * y)


def project_fraction(lat: Column, lon: Column, lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Where the perpendicular from a point meets segment a-b: 0 at a, 1 at b, clamped; 0 for an empty segment."""
    shrink = F.cos(F.radians((lat_a + lat_b) / 2))
    dx, dy = (lon_b - lon_a) * shrink, lat_b - lat_a
    px, py = (lon - lon_a) * shrink, lat - lat_a
    norm = dx * dx + dy * dy
    return F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / norm)))


def azimuth_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction from point 1 to point 2 in degrees clockwise from north, 0 to 360, in a local plane."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(x, lat2 - lat1)) + 360.0, F.lit(360.0))


def turn_angle_deg(azimuth_in: Column, azimuth_out: Column) -> Column:
    """Change of direction in (-180, 180]; positive to the right."""
    d = F.pmod(azimuth_out - azimuth_in + 180.0, F.lit(360.0)) - 180.0
    return F.when(d == -180.0, 180.0).otherwise(d)


def morton_key(x: Column, y: Column, bits: int) -> Column:
    """Interleave the low ``bits`` of two non-negative integers: x on even, y on odd places."""
    key = F.lit(0).cast("bigint")
    for i in range(bits):
        bit = lambda c: F.shiftright(c.cast("bigint"), i).bitwiseAND(F.lit(1).cast("bigint"))  # noqa: B023, E731
        key = key.bitwiseOR(F.shiftleft(bit(x), 2 * i)).bitwiseOR(F.shiftleft(bit(y), 2 * i + 1))
    return key


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile column and row; latitudes are clamped to the projection's range."""
    n = 1 << zoom
    phi = F.radians(F.greatest(F.lit(-85.0511287798066), F.least(F.lit(85.0511287798066), lat)))
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / 3.141592653589793) / 2 * n)
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("bigint")
    return clamp(x), clamp(y)


def distance_3d(flat_m: Column, ele1: Column, ele2: Column) -> Column:
    """Distance with the difference of elevation; unknown or NaN elevations leave the flat distance."""
    d = F.coalesce(F.nanvl(ele2 - ele1, F.lit(0.0)), F.lit(0.0))
    return F.sqrt(flat_m * flat_m + d * d)


def circumference_m(lat: Column) -> Column:
    """Length of the parallel at a latitude."""
    return 2 * 3.141592653589793 * MEAN_RADIUS_M * F.cos(F.radians(lat))


def box_around(lat: Column, lon: Column, radius_m: Column) -> Column:
    """struct(min_lat, max_lat, min_lon, max_lon) that holds the circle; not for circles over a pole."""
    dlat = F.degrees(radius_m / MEAN_RADIUS_M)
    dlon = dlat / F.cos(F.radians(lat))
    return F.struct((lat - dlat).alias("min_lat"), (lat + dlat).alias("max_lat"), (lon - dlon).alias("min_lon"), (lon + dlon).alias("max_lon"))


def segment_distance_m(lat: Column, lon: Column, lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Plane distance from a point to a segment."""
    t = project_fraction(lat, lon, lat_a, lon_a, lat_b, lon_b)
    return plane_distance_m(lat, lon, lat_a + (lat_b - lat_a) * t, lon_a + (lon_b - lon_a) * t)


def crosses_date_line(lon1: Column, lon2: Column) -> Column:
    return F.abs(lon1 - lon2) > 300


def project(lat: Column, lon: Column, distance_m: Column, heading_deg: Column) -> Column:
    """struct(lat, lon) reached from a point along a great circle."""
    d, h, p = distance_m / MEAN_RADIUS_M, F.radians(heading_deg), F.radians(lat)
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(h)
    east = F.atan2(F.sin(h) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * s)
    return F.struct(F.degrees(F.asin(s)).alias("lat"), (F.pmod(F.degrees(F.radians(lon) + east) + 180.0, F.lit(360.0)) - 180.0).alias("lon"))


def between(lat1: Column, lon1: Column, lat2: Column, lon2: Column, share: Column) -> Column:
    """struct(lat, lon) at a share of the great circle from point 1 to point 2."""
    d = haversine_m(lat1, lon1, lat2, lon2, 1.0)
    a = F.when(d == 0, 1.0 - share).otherwise(F.sin((1 - share) * d) / F.sin(d))
    b = F.when(d == 0, share).otherwise(F.sin(share * d) / F.sin(d))
    p1, l1, p2, l2 = F.radians(lat1), F.radians(lon1), F.radians(lat2), F.radians(lon2)
    x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
    y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))


def line_length_m(points: Column) -> Column:
    """Length of an array<struct<lat,lon>>."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(points) - 1)), F.lit(0.0), lambda acc, i: acc + F.coalesce(haversine_m(F.get(points, i - 1)["lat"], F.get(points, i - 1)["lon"], F.get(points, i)["lat"], F.get(points, i)["lon"]), F.lit(0.0)))


def compass_point(azimuth: Column) -> Column:
    """One of 16 directions."""
    names = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
    return F.element_at(F.array(*map(F.lit, names)), (F.floor((azimuth + 11.25) / 22.5) % 16).cast("int") + 1)


def clockwise(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """Whether three points turn to the right."""
    return (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) < 0


def coordinate_int(degrees: Column, factor: float = 1e7) -> Column:
    """A coordinate as an integer, rounded."""
    return F.round(degrees * factor).cast("bigint")


def hilbert_key(x: Column, y: Column, order: int) -> Column:
    """Position on a Hilbert curve of two non-negative integers below 2**order.

    A fold over the bits, highest first: written out as one expression it
    would double with each bit.
    """
    one = F.lit(1).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("key"), x.cast("bigint").alias("px"), y.cast("bigint").alias("py"))

    def step(acc: Column, bit: Column) -> Column:
        rx, ry = F.call_function("shiftright", acc["px"], bit).bitwiseAND(one), F.call_function("shiftright", acc["py"], bit).bitwiseAND(one)
        side = F.call_function("shiftleft", one, bit)
        low = side - 1
        turn = (ry == 0) & (rx == 1)
        px = F.when(turn, low - acc["px"].bitwiseAND(low)).otherwise(acc["px"].bitwiseAND(low))
        py = F.when(turn, low - acc["py"].bitwiseAND(low)).otherwise(acc["py"].bitwiseAND(low))
        return F.struct(
            (acc["key"] + (rx * 3).bitwiseXOR(ry) * side * side).alias("key"),
            F.when(ry == 0, py).otherwise(px).alias("px"), F.when(ry == 0, px).otherwise(py).alias("py"),
        )

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0)), start, step)["key"]
