import datetime as dt
import time

from pyspark.sql import functions as F

from waymesh.streaming import events as ev

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def rows(n, start=0):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return [(start + i, base + dt.timedelta(minutes=7 * (start + i)), (start + i) % 3, "ab"[(start + i) % 2], float(start + i)) for i in range(n)]


def folder(spark, tmp_path, *batches):
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    src = tmp_path / "src"
    src.mkdir()
    for k in range(len(batches)):
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(src / f"{k}.parquet")
            time.sleep(0.02)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))


def collect(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    stream = folder(spark, tmp_path, rows(40), rows(40, 40), rows(1, 4000))
    batch = spark.createDataFrame(rows(80), SCHEMA)
    got = collect(ev.tumbling(stream, "1 hour"), spark, "t1")
    assert got == {tuple(r) for r in ev.tumbling(batch, "1 hour").collect()}


def test_late_rows_are_dropped_and_repeated_ones_count_once(spark, tmp_path):
    late = [(9000, dt.datetime(2023, 12, 1, tzinfo=dt.timezone.utc), 0, "a", 1.0)]
    stream = folder(spark, tmp_path, rows(40), rows(1, 4000), rows(1, 4000) + late, rows(1, 9999))
    got = collect(ev.unique_events(stream).select("event_id"), spark, "t2")
    assert (9000,) not in got and len(got) == 42


def test_sessions_on_a_stream(spark, tmp_path):
    stream = folder(spark, tmp_path, rows(40), rows(1, 4000), rows(1, 9999))
    got = collect(ev.session_windows(stream, "30 minutes").select("user_id", "n"), spark, "t3")
    assert {(0, 14), (1, 13), (2, 13)} <= got


def test_latest_wins_also_when_a_batch_is_retried(spark, tmp_path):
    path, write = str(tmp_path / "t"), None
    write = ev.upsert(path, "user_id", ["ts", "event_id"])
    a, b = spark.createDataFrame(rows(10), SCHEMA), spark.createDataFrame(rows(5, 10), SCHEMA)
    write(a, 0)
    write(b, 1)
    write(b, 1)
    got = {r["user_id"]: r["event_id"] for r in ev.overlay_table(spark, path, "user_id", ["ts", "event_id"]).collect()}
    assert got == {0: 12, 1: 13, 2: 14}


def test_state_of_each_user(spark, tmp_path):
    stream = folder(spark, tmp_path, rows(9), rows(6, 9))
    got = collect(ev.running_counts(stream), spark, "t5", "update")
    assert {(0, 5, 12.0), (1, 5, 13.0), (2, 5, 14.0)} <= got


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert ev.tumbling(e, "1 hour").count() == 0 and ev.latest(e, "user_id", ["ts"]).count() == 0 and ev.sliding(e, "2 hours", "1 hour").filter(F.lit(True)).count() == 0
