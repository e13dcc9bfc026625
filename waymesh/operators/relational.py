"""General joins and aggregates that hold under skew, where Spark has no operator by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Inner join of ``points`` with the ``intervals`` that hold low <= at < high, by buckets of ``width``.

    Intervals are copied to the buckets they touch, so choose a width near the
    usual length; the equi-join on the bucket is chosen and split by Spark.
    Nulls and empty intervals join nothing.
    """
    p = points.withColumn("__b", F.floor(F.col(at) / width).cast("bigint"))
    i = intervals.filter(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width).cast("bigint"), F.floor((F.col(high) - 1) / width).cast("bigint"))))
    return p.join(i, "__b").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__b")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str]) -> DataFrame:
    """Each left row with ``take`` of the last right row of its ``by`` group at or before ``at``.

    One sort-based pass over the union of both sides.  Ties on ``at`` go to the
    greatest ``take``; left rows without match get nulls; left rows are kept,
    also repeated ones.
    """
    payload = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.lit(1).alias("__side"), F.struct(*payload).alias("__row"), F.lit(None).cast(right.select(F.struct(*take).alias("t")).schema["t"].dataType).alias("__take"))
    b = right.select(*by, at, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*take).alias("__take"))
    w = Window.partitionBy(*by).orderBy(at, "__side", "__take").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__last", F.last("__take", ignorenulls=True).over(w)).filter("__side = 1")
    return out.select(*by, at, *[F.col(f"__row.`{c}`").alias(c) for c in payload], *[F.col(f"__last.`{c}`").alias(c) for c in take])


def next_event(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str]) -> DataFrame:
    """Each left row with ``take`` of the first right row at or after ``at``; ties go to the smallest ``take``."""
    payload = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.lit(0).alias("__side"), F.struct(*payload).alias("__row"), F.lit(None).cast(right.select(F.struct(*take).alias("t")).schema["t"].dataType).alias("__take"))
    b = right.select(*by, at, F.lit(1).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*take).alias("__take"))
    w = Window.partitionBy(*by).orderBy(at, "__side", "__take").rowsBetween(0, Window.unboundedFollowing)
    out = a.unionByName(b).withColumn("__next", F.first("__take", ignorenulls=True).over(w)).filter("__side = 0")
    return out.select(*by, at, *[F.col(f"__row.`{c}`").alias(c) for c in payload], *[F.col(f"__next.`{c}`").alias(c) for c in take])


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot_rows: int = 1_000_000) -> DataFrame:
    """Inner join in which keys with more than ``hot_rows`` left rows are spread over several salts.

    Right rows of such keys are copied to each salt.  Hot keys number at most
    rows / hot_rows, so Spark may broadcast them where they fit its threshold.
    """
    hot = left.groupBy(*on).count().filter(F.col("count") > hot_rows).select(*on, F.ceil(F.col("count") / hot_rows).cast("int").alias("__n"))
    salts = F.coalesce(F.col("__n"), F.lit(1))
    a = left.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("__n")
    b = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__n")
    return a.join(b, [*on, "__salt"]).drop("__salt")


def salted_sum(df: DataFrame, by: list[str], what: str, name: str, salts: int = 16) -> DataFrame:
    """Sum by group in two stages, so that no task sees all of a hot group."""
    part = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).groupBy(*by, "__salt").agg(F.sum(what).alias("__s"))
    return part.groupBy(*by).agg(F.sum("__s").alias(name))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; Spark limits each group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
