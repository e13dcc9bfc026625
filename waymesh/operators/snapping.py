"""Nearest edges, box queries and areas of edges, over a tile index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geo import plane_distance_m, project_fraction
from waymesh.session import cut

def edge_tiles(edges: DataFrame, tile_deg: float) -> DataFrame:
    """(tx, ty, ...edge columns): an edge(edge, lat_a, lon_a, lat_b, lon_b) in every tile its segment passes.

    The segment is cut at the borders of tile columns, and each piece is given
    the rows it spans, so a long edge has as many tiles as it crosses and not
    those of its whole box.
    """
    x = lambda c: F.floor(c / tile_deg).cast("bigint")
    west = F.col("lon_a") <= F.col("lon_b")
    x1, x2 = F.when(west, F.col("lon_a")).otherwise(F.col("lon_b")), F.when(west, F.col("lon_b")).otherwise(F.col("lon_a"))
    y1, y2 = F.when(west, F.col("lat_a")).otherwise(F.col("lat_b")), F.when(west, F.col("lat_b")).otherwise(F.col("lat_a"))
    e = edges.withColumns({"__x1": x1, "__x2": x2, "__y1": y1, "__y2": y2}).withColumn("tx", F.explode(F.sequence(x(F.col("__x1")), x(F.col("__x2")))))
    at = lambda c: F.when(F.col("__x2") == F.col("__x1"), None).otherwise(F.col("__y1") + (F.col("__y2") - F.col("__y1")) * (c - F.col("__x1")) / (F.col("__x2") - F.col("__x1")))
    lo, hi = F.greatest(F.col("__x1"), F.col("tx") * tile_deg), F.least(F.col("__x2"), (F.col("tx") + 1) * tile_deg)
    ya, yb = F.coalesce(at(lo), F.col("__y1")), F.coalesce(at(hi), F.col("__y2"))
    e = e.withColumn("ty", F.explode(F.sequence(x(F.least(ya, yb)), x(F.greatest(ya, yb)))))
    return e.drop("__x1", "__x2", "__y1", "__y2")


def nearest_edges(points: DataFrame, edges: DataFrame, tile_deg: float, rings: int = 4) -> DataFrame:
    """(id, edge, distance_m, fraction): the nearest edge of points(id, lat, lon), ties by edge.

    Rings of tiles around a point are opened one after the other; a point is
    settled when its best edge is nearer than any tile not yet opened can be.
    Points that ``rings`` rings do not settle go on with tiles eight times as
    wide, until one tile holds the earth: every point with a position has a row
    unless there is no edge at all.  Points without position have none.
    """
    open_ = cut(points.select("id", "lat", "lon").filter("lat is not null and lon is not null"))
    done = None
    while True:
        last = tile_deg >= 360
        got, open_ = _rings(open_, edges, tile_deg, rings, last)
        done = got if done is None else done.unionByName(got)
        if last or not open_.head(1):
            return done
        tile_deg *= 8


def _rings(points: DataFrame, edges: DataFrame, tile_deg: float, rings: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Settled points with their edge, and the points that are left; in the ``last`` size all with any edge are settled."""
    tiles = edge_tiles(edges, tile_deg)
    open_ = points.withColumns({"px": F.floor(F.col("lon") / tile_deg).cast("bigint"), "py": F.floor(F.col("lat") / tile_deg).cast("bigint")})
    best, done = None, None
    metre = 111_000.0
    for ring in range(2 if last else rings):
        around = [(dx, dy) for dx in range(-ring, ring + 1) for dy in range(-ring, ring + 1) if max(abs(dx), abs(dy)) == ring]
        look = open_.withColumn("__d", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in around])))
        look = look.select("id", "lat", "lon", (F.col("px") + F.col("__d.dx")).alias("tx"), (F.col("py") + F.col("__d.dy")).alias("ty"))
        t = project_fraction(F.col("lat"), F.col("lon"), F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
        hit = look.join(tiles, ["tx", "ty"]).withColumn("fraction", t)
        d = plane_distance_m(F.col("lat"), F.col("lon"), F.col("lat_a") + (F.col("lat_b") - F.col("lat_a")) * F.col("fraction"), F.col("lon_a") + (F.col("lon_b") - F.col("lon_a")) * F.col("fraction"))
        got = hit.withColumn("d", d).groupBy("id").agg(F.min(F.struct("d", "edge", "fraction")).alias("m"))
        best = got if best is None else best.unionByName(got).groupBy("id").agg(F.min("m").alias("m"))
        # the nearest unopened tile is at least this far; a degree of longitude shrinks with latitude
        shrink = F.greatest(F.lit(0.0), F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("lat")) + tile_deg * (ring + 1)))))
        edge_x = F.least(F.col("lon") - (F.col("px") - ring) * tile_deg, (F.col("px") + ring + 1) * tile_deg - F.col("lon")) * shrink
        edge_y = F.least(F.col("lat") - (F.col("py") - ring) * tile_deg, (F.col("py") + ring + 1) * tile_deg - F.col("lat"))
        free = F.lit(float("inf")) if last and ring else F.least(edge_x, edge_y) * metre
        marked = cut(open_.join(best, "id", "left").withColumn("ok", F.coalesce(F.col("m.d") <= free, F.lit(False))))
        new = marked.filter("ok").select("id", F.col("m.edge").alias("edge"), F.col("m.d").alias("distance_m"), F.col("m.fraction").alias("fraction"))
        done = new if done is None else done.unionByName(new)
        open_, best = marked.filter("not ok").drop("m", "ok"), marked.filter("not ok and m is not null").select("id", "m")
        if not open_.head(1):
            break
    return done, open_.select("id", "lat", "lon")


def in_box(edges: DataFrame, boxes: DataFrame, tile_deg: float) -> DataFrame:
    """(box, edge) of edges whose own box meets boxes(box, min_lat, max_lat, min_lon, max_lon), by tiles."""
    t = lambda c: F.floor(F.col(c) / tile_deg).cast("bigint")
    b = boxes.withColumn("tx", F.explode(F.sequence(t("min_lon"), t("max_lon")))).withColumn("ty", F.explode(F.sequence(t("min_lat"), t("max_lat"))))
    box = edges.select("edge", F.least("lat_a", "lat_b").alias("s"), F.greatest("lat_a", "lat_b").alias("n"), F.least("lon_a", "lon_b").alias("w"), F.greatest("lon_a", "lon_b").alias("e"))
    box = box.withColumn("tx", F.explode(F.sequence(t("w"), t("e")))).withColumn("ty", F.explode(F.sequence(t("s"), t("n"))))
    hit = b.join(box, ["tx", "ty"]).filter("s <= max_lat and n >= min_lat and w <= max_lon and e >= min_lon")
    return hit.select("box", "edge").distinct()


def smallest_area(found: DataFrame, areas: DataFrame) -> DataFrame:
    """Of several areas(area_id, size) of one id the smallest, ties by area_id."""
    return found.join(areas, "area_id").groupBy("id").agg(F.min(F.struct("size", "area_id")).alias("m")).select("id", F.col("m.area_id").alias("area_id"))


def segmented(points: DataFrame, most_m: float) -> DataFrame:
    """Split lines(id, points array<struct<lat,lon>>) so that no gap is longer than ``most_m``: (id, pos, lat, lon)."""
    pair = F.expr("transform(sequence(0, greatest(size(points) - 2, 0)), i -> struct(i as i, get(points, i) as a, get(points, i + 1) as b))")
    s = points.filter(F.size("points") >= 2).select("id", F.size("points").alias("n"), F.explode(pair).alias("s"))
    d = plane_distance_m(F.col("s.a.lat"), F.col("s.a.lon"), F.col("s.b.lat"), F.col("s.b.lon"))
    s = s.withColumn("k", F.greatest(F.lit(1), F.ceil(d / most_m)).cast("int"))
    last = F.col("s.i") == F.col("n") - 2
    s = s.select("id", "s", "k", F.explode(F.sequence(F.lit(0), F.col("k") - F.when(last, 0).otherwise(1))).alias("j"))
    at = lambda c: F.col(f"s.a.{c}") + (F.col(f"s.b.{c}") - F.col(f"s.a.{c}")) * F.col("j") / F.col("k")
    from pyspark.sql import Window

    return s.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("s.i", "j")) - 1).alias("pos"), at("lat").alias("lat"), at("lon").alias("lon"))
