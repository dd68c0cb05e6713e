"""Structured Streaming: event windows, hourly histories that fill their gaps, and rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tarmac.storage import stored


def windowed(events: DataFrame, at: str, size: str, slide: str | None = None, late: str | None = "2 hours 30 minutes", keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Counts and sums by tumbling or sliding window; events later than ``late`` are dropped in a stream (None: it has a watermark)."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    events = events.withWatermark(at, late) if late else events
    return events.groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, keys: tuple[str, ...], late: str = "2 hours 30 minutes") -> DataFrame:
    """Bursts of events of a key with no gap of ``gap`` in them."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def once(events: DataFrame, key: str, at: str, late: str = "2 hours 30 minutes") -> DataFrame:
    """Each event once, however often it is delivered within the lateness."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def upsert(history: DataFrame | None, batch: DataFrame, keys: tuple[str, ...], at: str, keep_hours: int) -> DataFrame:
    """A history with a batch in it: the newest value by key and hour, only the last ``keep_hours`` hours; a repeated batch changes nothing."""
    both = batch if history is None else history.unionByName(batch)
    rest = [c for c in batch.columns if c not in (*keys, "hour")]
    newest = both.groupBy(*keys, "hour").agg(F.max_by(F.struct(*rest), at).alias("_v")).select(*keys, "hour", "_v.*")
    last = newest.agg(F.max("hour").alias("_last"))
    return newest.crossJoin(F.broadcast(last)).where(F.col("hour") > F.col("_last") - F.expr(f"interval {keep_hours} hours")).drop("_last")


def keep_history(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...], at: str, keep_hours: int = 72):
    """A query that keeps an hourly history under ``path`` by batch; each version is written beside the last."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(batch.schema).parquet(f"{path}/{number - 1}") if number else None
        stored(upsert(before, batch, keys, at, keep_hours)).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limited(events: DataFrame, key: str, at: str, limit: int, seconds: int = 60) -> DataFrame:
    """``events`` with ``allowed``: whether a key had fewer than ``limit`` events in the ``seconds`` up to each."""
    by = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000) + 1, 0)
    return events.withColumn("allowed", F.count("*").over(by) <= limit)


def periodic(spark: SparkSession, job: Callable[[SparkSession, int], None], checkpoint: str, every: str = "10 minutes") -> StreamingQuery:
    """Runs a job on the driver's schedule: one call a trigger, with the trigger's number; ticks carry no data."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, number: job(batch.sparkSession, number)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def missing_hours(history: DataFrame, keys: tuple[str, ...], keep_hours: int = 72) -> DataFrame:
    """``(*keys, hour)``: hours among the last ``keep_hours`` of a history, up to its latest one of all keys, that a key has no value for."""
    last = history.agg(F.max("hour").alias("_last"))
    span = F.sequence(F.col("_last") - F.expr(f"interval {keep_hours - 1} hours"), F.col("_last"), F.expr("interval 1 hour"))
    wanted = history.select(*keys).distinct().crossJoin(F.broadcast(last)).select(*keys, F.explode(span).alias("hour"))  # one row
    return wanted.join(history.where("value is not null").select(*keys, "hour"), [*keys, "hour"], "left_anti")


class _Sliding(StatefulProcessor):
    """Times of a key's events, as long as an event may still count them."""

    def __init__(self, columns: list[str], limit: int, micros: int, late: int) -> None:
        self.columns, self.limit, self.micros, self.late = columns, limit, micros, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "at array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).set_axis(self.columns, axis=1)
        known = np.array(self.times.get()[0] if self.times.exists() else [], np.int64)
        times = np.sort(np.concatenate([known, batch["_at"].to_numpy(np.int64)]))
        own = batch["_at"].to_numpy(np.int64)
        count = np.searchsorted(times, own, "right") - np.searchsorted(times, own - self.micros, "right")
        self.times.update(([int(t) for t in times[times > times[-1] - self.micros - self.late]],))
        yield batch.drop(columns="_at").assign(allowed=count <= self.limit)

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, key: str, at: str, limit: int, seconds: int = 60, late_seconds: int = 0) -> DataFrame:
    """``rate_limited`` for a stream: a sliding log of each key's times, kept in the state store.

    An event is judged once, by the events seen so far in the ``seconds`` up to it, those of its own batch and instant
    included, and counts whether it was allowed or not.  Times older than the window and ``late_seconds`` are
    forgotten, so an event that is later than that finds fewer.  Needs the RocksDB state store.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    timed = events.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    return timed.groupBy(key).transformWithStateInPandas(_Sliding(timed.columns, limit, seconds * 1_000_000, late_seconds * 1_000_000), schema, "append", "none")


class _HourRing(StatefulProcessor):
    """A key's values by hour, the last ones only."""

    def __init__(self, key: str, keep: int) -> None:
        self.key, self.keep = key, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "hours array<bigint>, seen array<bigint>, amounts array<double>, latest bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        held, latest = {}, -(2**62)
        if self.ring.exists():
            hours, seen, amounts, latest = self.ring.get()
            held = {h: (s, a) for h, s, a in zip(hours, seen, amounts, strict=True)}
        batch = pd.concat(list(rows)).set_axis([self.key, "_hour", "_at", "value"], axis=1)
        fresh = set()
        for hour, at, value in zip(batch["_hour"].tolist(), batch["_at"].tolist(), batch["value"].tolist(), strict=True):
            latest = max(latest, hour)  # a report without a value still tells the time
            if value == value and (hour not in held or at > held[hour][0]):
                held[hour] = (at, float(value))
                fresh.add(hour)
        held = {h: v for h, v in held.items() if h > latest - self.keep}
        self.ring.update((sorted(held), [held[h][0] for h in sorted(held)], [held[h][1] for h in sorted(held)], latest))
        out = [(h, held[h][1], False) for h in sorted(fresh & set(held))] + [(h, None, True) for h in range(latest - self.keep + 1, latest + 1) if h not in held]
        yield pd.DataFrame({self.key: [key[0]] * len(out), "hour": pd.to_datetime([h * 3_600_000_000 for h, _, _ in out], unit="us"), "value": pd.array([v for _, v, _ in out], "Float64"), "asked": [a for _, _, a in out]})

    def close(self) -> None:
        pass


def ring_history(stream: DataFrame, key: str, at: str, keep_hours: int = 72) -> DataFrame:
    """An hourly history in the state store: ``(key, hour, value, asked)`` of what each batch changed, and of what to ask for again.

    ``stream`` has ``key``, ``hour``, ``value`` and ``at``, which tells which of two reports of an hour is newer; a repeated report
    changes nothing.  Whenever a key reports, its hours among the last ``keep_hours`` without a value are ``asked`` for, every
    time until they come or fall out.  State is ``keep_hours`` values a key, whatever the history's length.
    """
    hour = F.floor(F.unix_micros(F.col("hour").cast("timestamp")) / 3_600_000_000)
    own = stream.select(key, hour.alias("_hour"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col("value").cast("double"))
    schema = T.StructType([stream.schema[key], T.StructField("hour", T.TimestampType()), T.StructField("value", T.DoubleType()), T.StructField("asked", T.BooleanType())])
    return own.groupBy(key).transformWithStateInPandas(_HourRing(key, keep_hours), schema, "append", "none")
