"""Operators on ordered rows: runs, gaps, smoothing, interpolation, thinning, turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal ``value`` along ``order``: (by, run, value, first, last, rows); positions from 0.

    Null is a value of its own.  End ``order`` with a unique column.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("__pos", F.row_number().over(w) - 1)
    change = F.when(F.col("__pos") == 0, 0).otherwise((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"))
    df = df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w))
    return df.groupBy(*by, "run", value).agg(F.min("__pos").alias("first"), F.max("__pos").alias("last"), F.count(F.lit(1)).alias("rows"))


def sessions(df: DataFrame, by: list[str], order: str, tie: str, gap_s: int) -> DataFrame:
    """``df`` with ``session``: a new one starts after more than ``gap_s`` seconds without a row."""
    w = Window.partitionBy(*by).orderBy(order, tie)
    sec = F.unix_micros(F.col(order).cast("timestamp"))
    new = F.coalesce(sec - F.lag(sec).over(w) > gap_s * 1_000_000, F.lit(False)).cast("int")
    return df.withColumn("__n", new).withColumn("session", F.sum("__n").over(w)).drop("__n")


def climbs(df: DataFrame, by: list[str], order: list[str], ele: str) -> DataFrame:
    """(by, ascend, descend): sums of the rises and of the falls between neighbours; nulls neither rise nor fall."""
    d = F.coalesce(F.col(ele) - F.lag(ele).over(Window.partitionBy(*by).orderBy(*order)), F.lit(0))
    return df.withColumn("__d", d).groupBy(*by).agg(F.sum(F.greatest(F.col("__d"), F.lit(0))).alias("ascend"), F.sum(F.greatest(-F.col("__d"), F.lit(0))).alias("descend"))


def running_total(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def moving_average(df: DataFrame, by: list[str], at: str, value: str, reach: int, name: str) -> DataFrame:
    """Mean of ``value`` over all rows within ``reach`` of ``at`` on either side."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(at).rangeBetween(-reach, reach)))


def interpolate(df: DataFrame, by: list[str], order: list[str], value: str, at: str) -> DataFrame:
    """Fill nulls of ``value`` linearly by the share of ``at`` between the known rows around them.

    Nulls before the first and after the last known row stay null.  Where
    ``at`` does not grow between the known rows, the earlier value holds.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(at).alias("x")))
    df = df.withColumn("__a", F.last(known, ignorenulls=True).over(back)).withColumn("__b", F.first(known, ignorenulls=True).over(ahead))
    share = F.when(F.col("__b.x") > F.col("__a.x"), (F.col(at) - F.col("__a.x")) / (F.col("__b.x") - F.col("__a.x"))).otherwise(0.0)
    between = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * share)
    return df.withColumn(value, F.coalesce(F.col(value).cast("double"), between)).drop("__a", "__b")


#: Angle bands of turns in radians, and their signs.
TURN_BANDS = (0.2, 0.8, 1.8)
TURN_SIGNS = {"continue": 0, "slight": 1, "turn": 2, "sharp": 3}


def turn_sign(angle: Column) -> Column:
    """Sign of a change of direction in radians: 0 ahead, 1 slight, 2 normal, 3 sharp; negative to the left."""
    a = F.abs(angle)
    size = F.when(a < TURN_BANDS[0], 0).when(a < TURN_BANDS[1], 1).when(a < TURN_BANDS[2], 2).otherwise(3)
    return F.when(angle.isNull(), None).otherwise(F.when(angle < 0, -size).otherwise(size))


def thin(df: DataFrame, by: list[str], order: list[str], x: str, least: float) -> DataFrame:
    """Keep the first row of a group and each row at least ``least`` from the last kept one.

    ``carried`` is the distance skipped since.  The fold depends on what was
    kept before, so it runs over the sorted array of a group: memory follows
    the longest trace.
    """
    item = F.struct(*[F.col(c) for c in order], F.col(x).alias("__x"))
    groups = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("__r"))
    kind = groups.schema["__r"].dataType.elementType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<r:{kind},carried:double>>").alias("out"), F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("skip"), F.lit(None).cast("double").alias("prev"))

    def step(acc: Column, r: Column) -> Column:
        v = r["__x"].cast("double")
        keep = acc["last"].isNull() | (F.abs(v - acc["last"]) >= least)
        walked = acc["skip"] + F.coalesce(F.abs(v - acc["prev"]), F.lit(0.0))
        return F.struct(
            F.when(keep, F.concat(acc["out"], F.array(F.struct(r.alias("r"), walked.alias("carried"))))).otherwise(acc["out"]).alias("out"),
            F.when(keep, v).otherwise(acc["last"]).alias("last"), F.when(keep, F.lit(0.0)).otherwise(walked).alias("skip"), v.alias("prev"),
        )

    kept = groups.select(*by, F.explode(F.aggregate("__r", start, step)["out"]).alias("k"))
    return kept.select(*by, *[F.col(f"k.r.`{c}`").alias(c) for c in order], F.col("k.r.__x").alias(x), F.col("k.carried").alias("carried"))


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Ramer-Douglas-Peucker: positions of the points kept; both ends always are."""
    n = len(points)
    if n < 3:
        return list(range(n))
    keep, stack = {0, n - 1}, [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        norm = dx * dx + dy * dy
        far, at = -1.0, -1
        for i in range(a + 1, b):
            px, py = points[i][0] - ax, points[i][1] - ay
            t = max(0.0, min(1.0, (px * dx + py * dy) / norm)) if norm else 0.0
            d = (px - t * dx) ** 2 + (py - t * dy) ** 2
            if d > far:
                far, at = d, i
        if far > tolerance * tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return sorted(keep)


def simplify_points(points: Column, tolerance: float) -> Column:
    """Simplified array<struct<lat,lon>> in Arrow batches, within ``tolerance`` degrees."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda ps: None if ps is None else [ps[i] for i in simplify([(p["lat"], p["lon"]) for p in ps], tolerance)])

    return F.pandas_udf(run, "array<struct<lat:double,lon:double>>")(points)


def sample_gaps(a: Column, b: Column, most: float) -> Column:
    """Positions from ``a`` to ``b`` with equal gaps of at most ``most``, both ends included."""
    n = F.greatest(F.lit(1), F.ceil(F.abs(b - a) / most)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: a + (b - a) * i / n)
