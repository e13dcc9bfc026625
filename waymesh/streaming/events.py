"""Event-time pipelines: windows, sessions, late data and latest-wins updates.

Each function takes a batch or a streaming DataFrame of events(event_id, ts,
user_id, event_type, value) and gives the same rows for both; on a stream the
watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_time(events: DataFrame, late: str) -> DataFrame:
    """Events with ``ts`` as a timestamp and, on a stream, a watermark of ``late``."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", late) if df.isStreaming else df


def _open(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end")).drop("w")


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of each event type in windows side by side."""
    return _open(with_time(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value").cast("bigint")).alias("total")))


def sliding(events: DataFrame, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Count in overlapping windows."""
    return _open(with_time(events, late).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")))


def session_windows(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Count in sessions of each user that end after a gap without events."""
    return _open(with_time(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")))


def unique_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once; on a stream within the watermark."""
    df = with_time(events, late)
    return df.dropDuplicatesWithinWatermark(["event_id"]) if df.isStreaming else df.dropDuplicates(["event_id"])


def latest(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last update of each key; on a stream keep it with ``upsert``."""
    row = F.struct(*[F.col(c) for c in updates.columns if c != key])
    return updates.groupBy(key).agg(F.max_by(row, F.struct(*[F.col(c) for c in order])).alias("r")).select(key, "r.*")


def upsert(path: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges updates into a parquet table of versions, one folder a batch.

    Writing a batch again replaces its folder, so a retried batch counts once.
    Read the table with ``overlay_table``.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def overlay_table(spark: SparkSession, path: str, key: str, order: list[str]) -> DataFrame:
    """Latest state of a table written by ``upsert``."""
    return latest(spark.read.parquet(path).drop("batch"), key, order)


def running_counts(events: DataFrame, idle: str = "30 days") -> DataFrame:
    """(user_id, n, last_value): events and the value of the latest one by (ts, event_id), kept for each user; streams only.

    Rows of one batch may come in any order and late ones never replace a later
    value.  A user who sends nothing for ``idle`` of processing time is
    forgotten, so state stays bounded by the users of that time.
    """
    amount, unit = idle.split()
    pause = int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")] * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, at, number, value = state.get if state.exists else (0, -(2**62), -(2**62), 0.0)
        for f in frames:
            n += len(f)
            last = f.sort_values(["ts", "event_id"]).iloc[-1]
            here = (int(pd.Timestamp(last["ts"]).value // 1000), int(last["event_id"]))
            if here >= (at, number):
                (at, number), value = here, float(last["value"])
        state.update((n, at, number, value))
        state.setTimeoutDuration(pause)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_value": [value]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, last_value double", "n bigint, at bigint, number bigint, value double", "update", GroupStateTimeout.ProcessingTimeTimeout)
