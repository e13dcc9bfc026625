"""Finer shaping of networks: densities, slopes, names, headings, layout, fares, transfers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.geo import azimuth_deg, haversine_m, hilbert_key
from waymesh.session import cut

# Words that say what kind of street it is, and their short forms.
STREET_WORDS = {"street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "straße", "strasse", "str", "weg", "rue", "calle", "via", "platz", "square", "the", "de", "la"}


def name_key(text: Column) -> Column:
    """A street name without case, marks and words for the kind of street; the whole name if nothing else is left."""
    words = F.filter(F.split(F.lower(F.trim(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", " "))), " "), lambda w: ~w.isin(*STREET_WORDS) & (w != ""))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.lower(F.trim(text)))


def similar_names(df: DataFrame, a: str, b: str, least: float = 0.9) -> DataFrame:
    """Rows whose names are alike: Jaro-Winkler of their keys above ``least``; null or empty names are alike to none."""
    from waymesh.functions.text import jaro_winkler

    return df.withColumn("similarity", jaro_winkler(name_key(F.col(a)), name_key(F.col(b)))).filter((F.col("similarity") > least) & (F.col(a) != "") & (F.col(b) != ""))


def heading_fits(azimuth: Column, heading: Column, tolerance: float = 60.0) -> Column:
    """Whether a direction lies within ``tolerance`` degrees of a heading; a null heading fits all."""
    d = F.abs(F.pmod(azimuth - heading + 180.0, F.lit(360.0)) - 180.0)
    return heading.isNull() | (d <= tolerance)


def curbside(azimuth: Column, point_azimuth: Column) -> Column:
    """Side of a road a point lies on, seen along the edge: right or left."""
    d = F.pmod(point_azimuth - azimuth, F.lit(360.0))
    return F.when(d < 180.0, "right").otherwise("left")


def orientation(points: Column) -> Column:
    """Direction of the last segment of a line in steps of 12 degrees."""
    a, b = F.get(points, F.size(points) - 2), F.get(points, F.size(points) - 1)
    return (F.round(azimuth_deg(a["lat"], a["lon"], b["lat"], b["lon"]) / 12) * 12 % 360).cast("int")


def curvature(points: Column, length_m: Column) -> Column:
    """Beeline over length, 0..1; 1 for lines without length."""
    a, b = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    return F.when(length_m > 0, F.least(F.lit(1.0), haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]) / length_m)).otherwise(1.0)


def slopes(elevations: DataFrame, by: list[str], order: str, at: str, ele: str) -> DataFrame:
    """(by, average_slope, max_slope) in percent: ends of the line, and steepest step against the mean of the two rows before."""
    w = Window.partitionBy(*by).orderBy(order)
    before = (F.coalesce(F.lag(ele, 1).over(w), F.col(ele)) + F.coalesce(F.lag(ele, 2).over(w), F.lag(ele, 1).over(w), F.col(ele))) / 2
    step = F.col(at) - F.coalesce(F.lag(at, 1).over(w), F.col(at))
    s = elevations.withColumn("__s", F.when(step > 0, F.abs(F.col(ele) - before) / step * 100))
    first, last = (F.min_by(F.struct(F.col(at).alias("x"), F.col(ele).alias("e")), order), F.max_by(F.struct(F.col(at).alias("x"), F.col(ele).alias("e")), order))
    g = s.groupBy(*by).agg(first.alias("a"), last.alias("b"), F.max("__s").alias("max_slope"))
    run = F.col("b.x") - F.col("a.x")
    return g.select(*by, F.when(run > 0, (F.col("b.e") - F.col("a.e")) / run * 100).alias("average_slope"), "max_slope")


def bridge_heights(edges: DataFrame, by: list[str], order: str, at: str, ele: str, inside: str) -> DataFrame:
    """Elevations of bridges, tunnels and ferries drawn straight between the nearest rows outside; others stay."""
    from waymesh.operators.sequences import interpolate

    open_ = edges.withColumn("__e", F.when(~F.col(inside), F.col(ele)).cast("double"))
    return interpolate(open_, by, [order], "__e", at).withColumn(ele, F.coalesce("__e", F.col(ele).cast("double"))).drop("__e")


def smooth_ramer(points: Column, tolerance: float) -> Column:
    """Elevations of an array<struct<x,ele>> replaced by straight pieces that miss no value by more than ``tolerance``."""

    def fit(ps: list) -> list:
        xs, es = [p["x"] for p in ps], [p["ele"] for p in ps]
        out, stack = list(es), [(0, len(es) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            run = xs[b] - xs[a]
            line = [es[a] + (es[b] - es[a]) * ((xs[i] - xs[a]) / run if run else 0) for i in range(a, b + 1)]
            far, k = max((abs(es[a + j] - v), j) for j, v in enumerate(line))
            if far <= tolerance:
                out[a : b + 1] = line
            else:
                stack += [(a, a + k), (a + k, b)]
        return [{"x": x, "ele": float(e)} for x, e in zip(xs, out)]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda ps: None if ps is None else fit(list(ps)))

    return F.pandas_udf(run, "array<struct<x:double,ele:double>>")(points)


def urban_density(edges: DataFrame, radius_m: float, residential: float, city: float) -> DataFrame:
    """(edge, density, urban) of edges(edge, lat, lon, length_m): road metres within a radius by its square, and its class.

    A radius join over cells, not a walk along roads: roads near but not
    connected count, too.
    """
    from waymesh.operators.proximity import near_pairs

    pts = edges.select(F.col("edge").alias("id"), "lat", "lon")
    near = near_pairs(pts, radius_m).select("id_a", "id_b")
    size = edges.select(F.col("edge").alias("other"), "length_m")
    both = near.select(F.col("id_a").alias("edge"), F.col("id_b").alias("other")).unionByName(near.select(F.col("id_b").alias("edge"), F.col("id_a").alias("other"))).unionByName(edges.select("edge", F.col("edge").alias("other")))
    d = both.join(size, "other").groupBy("edge").agg((F.sum("length_m") / radius_m / radius_m).alias("density"))
    return d.withColumn("urban", F.when(F.col("density") >= city, "city").when(F.col("density") >= residential, "residential").otherwise("rural"))


def hilbert_order(nodes: DataFrame, order: int = 16) -> DataFrame:
    """nodes(node, lat, lon) with ``key`` along a Hilbert curve and ``new_id`` dense in its order, laid out by range of key.

    Positions are counted within range partitions and shifted by what came
    before, so no task sorts all nodes.
    """
    n = 1 << order
    x = F.least(F.lit(n - 1), F.floor((F.col("lon") + 180) / 360 * n)).cast("bigint")
    y = F.least(F.lit(n - 1), F.floor((F.col("lat") + 90) / 180 * n)).cast("bigint")
    keyed = nodes.withColumn("key", hilbert_key(x, y, order))
    laid = cut(keyed.repartitionByRange("key", "node").sortWithinPartitions("key", "node").withColumn("__p", F.spark_partition_id()))
    sizes = laid.groupBy("__p").count()
    before = sizes.withColumn("__o", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__o")  # one row a partition
    local = F.row_number().over(Window.partitionBy("__p").orderBy("key", "node"))
    return laid.join(before, "__p").withColumn("new_id", F.col("__o") + local - 1).drop("__p", "__o")


def relabel(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges(src, dst, ...) with the ids of names(node, new_id)."""
    a, b = names.select(F.col("node").alias("src"), F.col("new_id").alias("__a")), names.select(F.col("node").alias("dst"), F.col("new_id").alias("__b"))
    return edges.join(a, "src").join(b, "dst").withColumns({"src": F.col("__a"), "dst": F.col("__b")}).drop("__a", "__b")


def minimal_sets(rules: DataFrame) -> DataFrame:
    """rules(rule, edges array) without those that contain all edges of another one; of equal ones the least rule stays.

    Candidates share the least common edge of the contained rule: an equi-join,
    no comparison of all pairs.
    """
    r = rules.select("rule", F.array_sort(F.array_distinct("edges")).alias("edges")).filter(F.size("edges") > 0)
    small = r.select(F.col("rule").alias("r2"), F.col("edges").alias("e2"), F.get("edges", F.lit(0)).alias("k"))
    big = r.withColumn("k", F.explode("edges"))
    inside = (F.size(F.array_except("e2", "edges")) == 0) & (F.col("rule") != F.col("r2"))
    proper = (F.size("e2") < F.size("edges")) | (F.col("r2") < F.col("rule"))
    gone = big.join(small, "k").filter(inside & proper).select("rule").distinct()
    return rules.join(gone, "rule", "left_anti")


def u_turns(steps: DataFrame) -> DataFrame:
    """(path, no): instructions that with the one before make a u-turn: two turns to one side, close, back on the same street.

    steps(path, no, sign, name, distance_m): the street before both turns and after them has one name.
    """
    w = Window.partitionBy("path").orderBy("no")
    side = F.signum(F.col("sign").cast("double"))
    ok = (F.abs("sign") == 2) & (F.abs(F.lag("sign").over(w)) == 2) & (side == F.signum(F.lag("sign").over(w).cast("double"))) & (F.lag("distance_m").over(w) < 35) & F.col("name").eqNullSafe(F.lag("name", 2).over(w))
    return steps.withColumn("__u", F.coalesce(ok, F.lit(False))).filter("__u").select("path", "no")


def walk_transfers(stops: DataFrame, radius_m: float, metres_a_second: float = 1.2) -> DataFrame:
    """(from_stop, to_stop, walk_s) between stops(stop bigint, lat, lon) within a beeline radius, both ways."""
    from waymesh.operators.proximity import near_pairs

    p = near_pairs(stops.select(F.col("stop").alias("id"), "lat", "lon"), radius_m)
    s = F.ceil(F.col("distance_m") / metres_a_second).cast("bigint")
    return p.select(F.col("id_a").alias("from_stop"), F.col("id_b").alias("to_stop"), s.alias("walk_s")).unionByName(p.select(F.col("id_b").alias("from_stop"), F.col("id_a").alias("to_stop"), s.alias("walk_s")))


def profile_query(calls: DataFrame, stop: int, target: int, start_s: int, end_s: int, rounds: int = 4, change_s: int = 0) -> DataFrame:
    """(departure, arrival, trips): departures in a window from which no later one arrives as early with as few trips.

    Every departure of the stop within the window is a source of its own.
    """
    from waymesh.operators.transit import earliest_arrival

    deps = calls.filter((F.col("stop") == stop) & F.col("dep_s").between(start_s, end_s)).select(F.col("dep_s").cast("bigint").alias("source")).distinct()
    got = earliest_arrival(calls, deps.select("source", F.lit(stop).cast("bigint").alias("stop"), F.col("source").alias("at")), rounds, change_s)
    at = got.filter((F.col("stop") == target) & (F.col("trips") > 0)).select(F.col("source").alias("departure"), "arrival", "trips")
    w = Window.partitionBy("trips").orderBy(F.desc("departure"), "arrival").rowsBetween(Window.unboundedPreceding, -1)
    keep = at.withColumn("__m", F.min("arrival").over(w)).filter(F.col("__m").isNull() | (F.col("arrival") < F.col("__m"))).drop("__m")
    return keep


def rule_range(statements: list[dict], low: float, high: float, values: dict[str, tuple[float, float]]) -> tuple[float, float]:
    """Least and greatest result of rule statements from a start in low..high, for names within their ranges.

    Conditions may hold or not, so the bounds are safe, if not always tight.
    """
    import re

    def span(text: str | float) -> tuple[float, float]:
        t = str(text).strip()
        if re.fullmatch(r"-?\d+(?:\.\d+)?", t):
            return float(t), float(t)
        if t in values:
            return values[t]
        if m := re.fullmatch(r"(\w+)\s*\*\s*(-?\d+(?:\.\d+)?)", t):
            a, b = values[m[1]]
            k = float(m[2])
            return min(a * k, b * k), max(a * k, b * k)
        raise ValueError(f"no range for {text!r}")

    from waymesh.plans.rules import groups

    for group in groups(statements):
        ends, sure = [], False
        for s in group:
            op = next(k for k in ("multiply_by", "limit_to", "add", "do") if k in s)
            if op == "do":
                ends.append(rule_range(s["do"], low, high, values))
            else:
                a, b = span(s[op])
                c = [(x * y if op == "multiply_by" else min(x, y) if op == "limit_to" else x + y) for x in (low, high) for y in (a, b)]
                ends.append((min(c), max(c)))
            sure |= "else" in s or s.get("if") == "true"
        if not sure:
            ends.append((low, high))
        low, high = min(e[0] for e in ends), max(e[1] for e in ends)
    return low, high
