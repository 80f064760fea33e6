"""Batch completion and task states over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from quillstone.operators.events import TERMINAL, channel, subscribed, wire
from quillstone.runtime import ship

STATE_HOURS = 72


def _countdown(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Tell once when a batch's last task has ended; forget a batch after its time to live, by event time."""
    if state.hasTimedOut:
        state.remove()
        return
    tasks, total, told = state.get if state.exists else ([], None, False)
    seen, last = set(tasks), 0
    for part in parts:
        seen.update(part.task_id)
        known = part.total.dropna()
        if len(known):
            total = max(total or 0, int(known.max()))
        last = max(last, int(part.ts.max().timestamp() * 1000))
    done = total is not None and len(seen) >= total
    state.update((sorted(seen), total, told or done))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + STATE_HOURS * 3600 * 1000)
    if done and not told:
        yield pd.DataFrame({"batch_id": [key[0]], "done": [len(seen)], "event": ["batch_completed"]})


def batch_completions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """T4, T5: one `batch_completed` row per batch, from a stream of (batch_id, task_id, event, total, ts).

    State is the set of ended tasks, so redelivered events don't count twice, and both ways of
    ending count, so no batch hangs on a failure. A batch waits for its total. It is forgotten
    after `STATE_HOURS`; events as old as that are late by then and dropped.
    """
    ship(events.sparkSession)
    ended = events.withWatermark("ts", late).where(F.col("event").isin(*TERMINAL)).select("batch_id", "task_id", "total", "ts")
    return ended.groupBy("batch_id").applyInPandasWithState(_countdown, "batch_id string, done int, event string", "tasks array<string>, total int, told boolean", "append", "EventTimeTimeout")


def _last(late_ms: int):
    """The last event of a task; forgotten when the watermark has passed it by `late_ms`."""

    def fn(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for part in parts:
            ms = part.ts.astype("datetime64[us]").astype("int64")
            row = max(zip(ms, part.event, strict=True), key=lambda x: (x[0], x[1] or ""))
            best = max(best or row, (int(row[0]), row[1]), key=lambda x: (x[0], x[1] or ""))
        state.update((int(best[0]), best[1]))
        state.setTimeoutTimestamp(max(int(best[0]) // 1000, state.getCurrentWatermarkMs()) + late_ms)
        yield pd.DataFrame({"task_id": [key[0]], "event": [best[1]], "ts": pd.to_datetime([int(best[0])], unit="us")})

    return fn


def task_states(events: DataFrame, late_hours: int = STATE_HOURS) -> DataFrame:
    """The last event of each task, as a stream in update mode; a task is forgotten `late_hours` of event time after it."""
    ship(events.sparkSession)
    kept = events.withWatermark("ts", f"{late_hours} hours").select("task_id", "event", "ts")
    return kept.groupBy("task_id").applyInPandasWithState(_last(late_hours * 3600 * 1000), "task_id string, event string, ts timestamp", "us bigint, event string", "update", "EventTimeTimeout")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind. An extra beyond the inventory."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n"))


def once(events: DataFrame, late: str = "72 hours") -> DataFrame:
    """Events without redelivered copies."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_id", "event", "ts"])


def publish(events: DataFrame, path: str, checkpoint: str, task: str = "task_id") -> StreamingQuery:
    """A stream of events into a folder of (channel, message) rows, nulls kept in the JSON."""
    said = events.select(channel(F.col(task)).alias("channel"), wire(events).alias("message"))
    return said.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(spark: SparkSession, path: str) -> DataFrame:
    """Messages of task channels as a stream, word for word."""
    return subscribed(spark.readStream.schema("channel string, message string").parquet(path))
