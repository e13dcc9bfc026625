import datetime as dt
import random

from pyspark.sql import functions as F

from waymesh.operators import orphans as o

T = lambda d: None if d is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
REFS = "parent_table string, scope string, key string, at timestamp_ntz, line bigint, kind string"
PARENTS = "parent_table string, scope string, key string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def brute(refs, parents):
    out = set()
    for t, s, k, at, line, _ in refs:
        if not k:
            continue
        vs = [v for v in parents if v[:3] == (t, s, k)]
        if any(v[3] is not None and at is not None and v[3] <= at and (v[4] is None or v[4] > at) for v in vs):
            continue
        late = any(v[3] is not None and (at is None or v[3] > at) for v in vs)
        out.add((line, "missing" if not vs else "late" if late else "deleted"))
    return out


def test_equals_brute_force_also_when_hot(spark):
    r = random.Random(2)
    keys = [None, "", "a", "A", "b", "c", "d"]
    refs = [("p", r.choice(["x", "y", None]), r.choice(keys), T(r.choice([None, *range(20)])), i, "clash") for i in range(600)]
    parents = [("p", r.choice(["x", "y", None]), r.choice(keys[2:5]), T(r.choice([None, *range(15)])), T(r.choice([None, *range(20)]))) for _ in range(14)]
    parents += parents[:4]
    a, b = spark.createDataFrame(refs, REFS).withColumnRenamed("kind", "note"), spark.createDataFrame(parents, PARENTS)
    want = brute(refs, parents)
    assert {k for _, k in want} == {"missing", "late", "deleted"}
    for hot in (100_000, 20):
        got = o.orphan_references(a, b, hot).select("line", "kind").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert o.orphan_references(a, b.limit(0)).filter("kind <> 'missing'").count() == 0
    assert o.orphan_references(a.limit(0), b).count() == 0


def test_timetable(spark):
    st = spark.createDataFrame([("f", "t1", "s1", 1, T(5)), ("f", "t1", "s1", 1, T(3)), ("f", "t2", None, 2, T(40)), ("g", "t1", "", 1, T(5))], "feed_id string, trip_id string, stop_id string, source_file_line bigint, loaded_at timestamp_ntz").withColumn("deleted_at", F.lit("clash"))
    trips = spark.createDataFrame([("f", "t1", None, 1, T(4), None)], "feed_id string, trip_id string, route_id string, source_file_line bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    stops = spark.createDataFrame([("f", "s1", "s1", 1, T(0), T(2))], "feed_id string, stop_id string, parent_station string, source_file_line bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    routes = spark.createDataFrame([], "feed_id string, route_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    found = o.timetable_orphans({"stop_times": st, "trips": trips, "stops": stops, "routes": routes})
    assert {tuple(r) for r in found.collect()} == {
        ("f", "stop_times", 1, "trip_id", "t1", "late", "2024-01"),
        ("f", "stop_times", 1, "stop_id", "s1", "deleted", "2024-01"),
        ("f", "stop_times", 2, "trip_id", "t2", "missing", "2024-02"),
        ("g", "stop_times", 1, "trip_id", "t1", "missing", "2024-01"),
    }
    assert o.orphan_report(found).agg(F.sum("orphans")).head()[0] == 4
