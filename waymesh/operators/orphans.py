"""References to records that do not exist, told apart as missing, late or deleted.

Both streams are brought together on (parent table, scope, key), sorted by
time and merged in one pass: version starts count +1, version ends -1, and a
reference that meets a count of zero has no valid parent at that moment.

Only parent rows change the running count, so references may be spread freely:
a key with more than ``hot_rows`` references is split over several salts, and
its few parent rows are copied to each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.session import cut, join_small

HOT_ROWS = 100_000


def orphan_references(references: DataFrame, parents: DataFrame, hot_rows: int = HOT_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """The rows of ``references`` whose key has no version valid at their time, with ``kind``.

    references(parent_table, scope, key, at, ...any payload)
    parents(parent_table, scope, key, valid_from, valid_to): one row a version

    * A version is valid from ``valid_from`` (included) to ``valid_to``
      (excluded, null: still valid).  Repeated versions count once or more
      without effect.  One with a null ``valid_from``, or one that ends before
      it starts, exists but is never valid.
    * ``missing``: the key has no version at all; ``late``: one starts after
      ``at``; ``deleted``: all others.
    * A null or empty key is no reference.  A null ``scope`` is a scope of its
      own.  A null ``at`` lies before every version.
    * Empty references give no rows; empty parents make every reference missing.
    Payload columns may have any names except those starting with ``__``.
    ``keys``(parent_table, scope, key) may name rows that are cheaper to count
    than the references when hot keys are looked for, such as those before
    deduplication; it changes no result.
    """
    payload = [c for c in references.columns if c not in ("parent_table", "scope", "key", "at")]
    refs = references.filter(F.col("key").isNotNull() & (F.col("key") != ""))
    refs = refs.select("parent_table", "scope", "key", "at", F.struct(*[F.col(c) for c in payload]).alias("__row") if payload else F.lit(None).cast("struct<x:int>").alias("__row"))
    size = (refs if keys is None else keys).groupBy("parent_table", "scope", "key").count().filter(F.col("count") > hot_rows)
    # at most one key for every hot_rows references
    hot = size.select(F.col("parent_table").alias("__t"), F.col("scope").alias("__s"), F.col("key").alias("__k"), F.ceil(F.col("count") / hot_rows).cast("int").alias("__n"))
    same = (F.col("parent_table") == F.col("__t")) & F.col("scope").eqNullSafe(F.col("__s")) & (F.col("key") == F.col("__k"))
    hot = cut(hot)
    salted = join_small(refs, hot, same, made=True).withColumn("__salt", F.when(F.col("__n").isNotNull(), F.pmod(F.xxhash64("at", "__row"), F.col("__n"))).otherwise(0).cast("int"))
    stream = salted.select("parent_table", "scope", "key", "at", F.lit(1).alias("__rank"), F.lit(0).alias("__delta"), F.lit(None).cast("boolean").alias("__start"), "__salt", "__row")
    ok = F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    marks = F.array(
        F.struct(F.col("valid_from").alias("at"), F.when(ok, 1).otherwise(0).alias("d"), F.lit(True).alias("s")),
        F.struct(F.col("valid_to").alias("at"), F.when(ok & F.col("valid_to").isNotNull(), -1).otherwise(0).alias("d"), F.lit(False).alias("s")),
    )
    versions = parents.select("parent_table", "scope", "key", "valid_from", "valid_to").distinct()
    salts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__n"), F.lit(1)) - 1))
    events = join_small(versions, hot, same, made=True).withColumn("__salt", salts).select("*", F.explode(marks).alias("__m"))
    events = events.select("parent_table", "scope", "key", F.col("__m.at").alias("at"), F.lit(0).alias("__rank"), F.col("__m.d").alias("__delta"), F.col("__m.s").alias("__start"), "__salt", F.lit(None).cast(stream.schema["__row"].dataType).alias("__row"))
    events = events.filter(F.col("__start") | (F.col("__delta") != 0))
    merged = stream.unionByName(events)
    group = ["parent_table", "scope", "key", "__salt"]
    upto = Window.partitionBy(*group).orderBy(F.col("at").asc_nulls_first(), "__rank").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group).orderBy(F.col("at").asc_nulls_first(), "__rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = merged.withColumn("__valid", F.sum("__delta").over(upto))
    merged = merged.withColumn("__known", F.count("__start").over(whole)).withColumn("__last", F.max(F.when(F.col("__start"), F.col("at"))).over(whole))
    late = F.col("__last").isNotNull() & (F.col("at").isNull() | (F.col("__last") > F.col("at")))
    kind = F.when(F.col("__known") == 0, "missing").when(late, "late").otherwise("deleted")
    found = merged.filter((F.col("__rank") == 1) & (F.col("__valid") <= 0))
    return found.select("parent_table", "scope", "key", "at", *[F.col(f"__row.`{c}`").alias(c) for c in payload], kind.alias("kind"))


#: Which column of which table refers to which key: (table, column, parent table, parent key).
TIMETABLE_LINKS = (
    ("stop_times", "trip_id", "trips", "trip_id"),
    ("stop_times", "stop_id", "stops", "stop_id"),
    ("trips", "route_id", "routes", "route_id"),
    ("stops", "parent_station", "stops", "stop_id"),
)


def timetable_orphans(tables: dict[str, DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Broken references of parsed feeds, one row per referring row and field.

    A row delivered several times counts once, with its earliest ``loaded_at``.
    Columns: feed_id, file, source_file_line, field, affected_entity_id, kind, period.
    """
    refs = keys = None
    for name in dict.fromkeys(x[0] for x in TIMETABLE_LINKS):
        links = [x for x in TIMETABLE_LINKS if x[0] == name]
        cols = [x[1] for x in links]
        rows = tables[name].groupBy("feed_id", "source_file_line", *cols).agg(F.min("loaded_at").alias("loaded_at"))
        each = F.explode(F.array(*[F.struct(F.lit(field).alias("field"), F.lit(parent).alias("parent_table"), F.col(field).alias("key")) for _, field, parent, _ in links]))
        rows = rows.withColumn("__l", each).select(
            F.col("__l.parent_table").alias("parent_table"), F.col("feed_id").alias("scope"), F.col("__l.key").alias("key"), F.col("loaded_at").alias("at"), F.lit(name).alias("file"), "source_file_line", F.col("__l.field").alias("field")
        )
        refs = rows if refs is None else refs.unionByName(rows)
        raw = tables[name].withColumn("__l", each).select(F.col("__l.parent_table").alias("parent_table"), F.col("feed_id").alias("scope"), F.col("__l.key").alias("key"))
        keys = raw if keys is None else keys.unionByName(raw)
    versions = None
    for name, key in dict.fromkeys((x[2], x[3]) for x in TIMETABLE_LINKS):
        rows = tables[name].select(F.lit(name).alias("parent_table"), F.col("feed_id").alias("scope"), F.col(key).alias("key"), F.col("loaded_at").alias("valid_from"), F.col("deleted_at").alias("valid_to"))
        versions = rows if versions is None else versions.unionByName(rows)
    found = orphan_references(refs, versions, hot_rows, keys)
    month = F.substring(F.col("at").cast("string"), 1, 7)
    return found.select(F.col("scope").alias("feed_id"), "file", "source_file_line", "field", F.col("key").alias("affected_entity_id"), "kind", month.alias("period")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of ``timetable_orphans`` per table, field, kind and month."""
    return found.groupBy("file", "field", "kind", "period").agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct("feed_id").alias("feeds"))
