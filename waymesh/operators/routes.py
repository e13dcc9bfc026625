"""Routes for people: details, instructions, responses and round trips."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.geo import azimuth_deg, turn_angle_deg
from waymesh.operators.sequences import runs, turn_sign

#: Signs of instructions.
SIGNS = {-98: "u_turn", -8: "u_turn_left", -7: "keep_left", -6: "leave_roundabout", -3: "turn_sharp_left", -2: "turn_left", -1: "turn_slight_left", 0: "continue", 1: "turn_slight_right", 2: "turn_right", 3: "turn_sharp_right", 4: "finish", 5: "via", 6: "roundabout", 7: "keep_right", 8: "u_turn_right"}
TEXTS = {
    "en": {0: "Continue", 1: "Turn slight right", 2: "Turn right", 3: "Turn sharp right", -1: "Turn slight left", -2: "Turn left", -3: "Turn sharp left", 4: "Arrive at destination", 5: "Arrive at waypoint", 6: "Enter roundabout", "onto": "onto", "exit": "take exit"},
    "de": {0: "Weiter", 1: "Leicht rechts", 2: "Rechts abbiegen", 3: "Scharf rechts", -1: "Leicht links", -2: "Links abbiegen", -3: "Scharf links", 4: "Ziel erreicht", 5: "Zwischenziel erreicht", 6: "In den Kreisverkehr", "onto": "auf", "exit": "Ausfahrt"},
    "fr": {0: "Continuez", 1: "Légèrement à droite", 2: "Tournez à droite", 3: "Franchement à droite", -1: "Légèrement à gauche", -2: "Tournez à gauche", -3: "Franchement à gauche", 4: "Arrivée", 5: "Étape atteinte", 6: "Prenez le rond-point", "onto": "sur", "exit": "sortie"},
    "es": {0: "Continúe", 1: "Gire levemente a la derecha", 2: "Gire a la derecha", 3: "Gire fuerte a la derecha", -1: "Gire levemente a la izquierda", -2: "Gire a la izquierda", -3: "Gire fuerte a la izquierda", 4: "Ha llegado", 5: "Punto intermedio", 6: "Entre en la rotonda", "onto": "por", "exit": "salida"},
}


def details(path: DataFrame, value: str) -> DataFrame:
    """(path, first, last, value): intervals of edges with one value, as positions of points (edge i runs from i to i + 1)."""
    return runs(path.select("path", "seq", value), ["path"], ["seq"], value).select("path", "first", (F.col("last") + 1).alias("last"), value)


def instructions(path: DataFrame) -> DataFrame:
    """(path, no, sign, name, first, last, distance_m, time_ms, exits) of path(path, seq, name, azimuth_in, azimuth_out, distance_m, time_ms, roundabout, out_edges).

    azimuth_in is the direction at the start of an edge, azimuth_out at its
    end, in degrees; out_edges counts the other roads one could leave by at
    its end.  An instruction begins where the name changes and the direction
    with it, or where a roundabout begins or ends; within a roundabout
    ``exits`` counts the ways out, the one taken included.  A path ends with a
    finish of its own.  Null names are a name of their own.
    """
    w = Window.partitionBy("path").orderBy("seq")
    turn = F.radians(turn_angle_deg(F.lag("azimuth_out").over(w), F.col("azimuth_in")))
    sign = turn_sign(turn)
    ring = F.coalesce("roundabout", F.lit(False))
    was = F.coalesce(F.lag("roundabout").over(w), F.lit(False))
    same = F.col("name").eqNullSafe(F.lag("name").over(w))
    first = F.row_number().over(w) == 1
    start = first | (ring != was) | (~ring & ~same) | (~ring & (F.abs(sign) >= 2))
    p = path.withColumn("__pos", F.row_number().over(w) - 1).withColumn("__start", start.cast("int")).withColumn("__sign", F.when(first & ~ring, 0).when(ring & ~was, 6).otherwise(sign))
    p = p.withColumn("no", F.sum("__start").over(w) - 1)
    got = p.groupBy("path", "no").agg(
        F.min_by("__sign", "seq").alias("sign"), F.min_by("name", "seq").alias("name"), F.min("__pos").alias("first"), (F.max("__pos") + 1).alias("last"),
        F.sum("distance_m").alias("distance_m"), F.sum("time_ms").alias("time_ms"), F.max(ring).alias("r"), F.sum(F.when(ring, F.coalesce("out_edges", F.lit(0)))).alias("o"),
    )
    got = got.withColumn("exits", F.when(F.col("r"), F.greatest(F.lit(1), F.col("o")))).drop("r", "o")
    end = got.groupBy("path").agg((F.max("no") + 1).alias("no"), F.max("last").alias("last"))
    end = end.select("path", "no", F.lit(4).alias("sign"), F.lit(None).cast("string").alias("name"), F.col("last").alias("first"), "last", F.lit(0.0).alias("distance_m"), F.lit(0).cast("bigint").alias("time_ms"), F.lit(None).cast("bigint").alias("exits"))
    return got.select("path", "no", "sign", "name", "first", "last", F.col("distance_m").cast("double").alias("distance_m"), F.col("time_ms").cast("bigint").alias("time_ms"), F.col("exits").cast("bigint").alias("exits")).unionByName(end)


def instruction_text(sign: Column, name: Column, exits: Column, language: str = "en") -> Column:
    """One line for an instruction; unknown languages fall back to English."""
    t = TEXTS.get(language, TEXTS["en"])
    words = F.lit(t[0])
    for k, v in t.items():
        if isinstance(k, int) and k:
            words = F.when(sign == k, v).otherwise(words)
    out = F.when((sign == 6) & exits.isNotNull(), F.concat(words, F.lit(f", {t['exit']} "), exits.cast("string"))).otherwise(words)
    return F.when(name.isNull() | (name == "") | sign.isin(4, 5), out).otherwise(F.concat(out, F.lit(f" {t['onto']} "), name))


def responses(totals: DataFrame, steps: DataFrame, points: DataFrame, language: str = "en") -> DataFrame:
    """(path, body): JSON responses of totals(path, distance_m, time_ms, weight), instructions and points(path, points array<struct<lat,lon>>).

    Points are an encoded polyline.  Paths without points are answered with an error.
    """
    from waymesh.functions.polyline import encode_points

    row = F.struct(
        "no", F.col("sign").alias("sign"), instruction_text(F.col("sign"), F.col("name"), F.col("exits"), language).alias("text"), F.round("distance_m", 3).alias("distance"), F.col("time_ms").alias("time"), F.array("first", "last").alias("interval"), F.coalesce("name", F.lit("")).alias("street_name"),
    )
    lists = steps.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.dropFields("no")).alias("instructions"))
    j = totals.join(points, "path", "left").join(lists, "path", "left")
    line = encode_points(F.col("points"))
    one = F.struct(F.round("distance_m", 3).alias("distance"), F.round("weight", 6).alias("weight"), F.col("time_ms").alias("time"), F.lit(True).alias("points_encoded"), line.alias("points"), F.col("instructions"))
    ok = F.to_json(F.struct(F.array(one).alias("paths")))
    bad = F.to_json(F.struct(F.lit("Connection between locations not found").alias("message"), F.array(F.struct(F.lit("ConnectionNotFound").alias("details"))).alias("hints")))
    return j.select("path", F.when(F.col("points").isNull(), bad).otherwise(ok).alias("body"))


def bearings(edges: DataFrame) -> DataFrame:
    """edges(edge, points) with azimuth_in and azimuth_out of the first and last segment."""
    p = F.col("points")
    a, b, y, z = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.size(p) - 2), F.get(p, F.size(p) - 1)
    return edges.withColumns({"azimuth_in": azimuth_deg(a["lat"], a["lon"], b["lat"], b["lon"]), "azimuth_out": azimuth_deg(y["lat"], y["lon"], z["lat"], z["lon"])})


def round_trip_points(lat: float, lon: float, distance_m: float, heading: float, points: int = 3) -> list[tuple[float, float]]:
    """Corners of a tour of about ``distance_m``: equal legs that turn all the same way."""
    out, leg, h = [(lat, lon)], distance_m / (points + 1), math.radians(heading)
    for i in range(points):
        y, x = map(math.radians, out[-1])
        d = leg / 6_371_000
        a = h + 2 * math.pi * i / (points + 1)
        y2 = math.asin(math.sin(y) * math.cos(d) + math.cos(y) * math.sin(d) * math.cos(a))
        x2 = x + math.atan2(math.sin(a) * math.sin(d) * math.cos(y), math.cos(d) - math.sin(y) * math.sin(y2))
        out.append((math.degrees(y2), math.degrees(x2)))
    return [*out, (lat, lon)]


def validate_requests(requests: DataFrame, bounds: tuple[float, float, float, float], profiles: tuple[str, ...], most_m: float | None = None) -> DataFrame:
    """requests(request, points array<struct<lat,lon>>, profile) with ``errors``: codes of what is wrong, empty if nothing.

    Codes: NoPoints, PointMissing, PointOutOfBounds (south, north, west, east),
    UnknownProfile, TooFar (neighbours beyond ``most_m``).
    """
    from waymesh.functions.geo import haversine_m

    p = F.col("points")
    s, n, w, e = bounds
    missing = F.exists(p, lambda x: x["lat"].isNull() | x["lon"].isNull())
    outside = F.exists(p, lambda x: ~(x["lat"].between(s, n) & x["lon"].between(w, e)))
    index = F.when(F.size(p) >= 2, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
    far = F.exists(index, lambda i: haversine_m(F.get(p, i - 1)["lat"], F.get(p, i - 1)["lon"], F.get(p, i)["lat"], F.get(p, i)["lon"]) > (most_m or 1e12))
    codes = [(p.isNull() | (F.size(p) == 0), "NoPoints"), (missing, "PointMissing"), (outside, "PointOutOfBounds"), (~F.coalesce(F.col("profile").isin(*profiles), F.lit(False)), "UnknownProfile"), (far, "TooFar")]
    return requests.withColumn("errors", F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for c, code in codes]), lambda x: x.isNotNull()))
