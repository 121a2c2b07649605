"""Live operators. State is bounded by a watermark; rows later than it are counted by Spark
(``numRowsDroppedByWatermark``) and belong on the back-fill path, which loses nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.scalars import packed_order, packed_tie
from ..operators.align import METRICS, align_run, forecast_errors, hourly_means
from ..operators.filters import _instant
from ..session import scratch_path
from ..sources.frames import frames_to_readings
from ..sources.points import readings_to_points, upsert_points
from ..sources.store import Store

WATERMARK = "10 minutes"
FLUSH = "10 seconds"
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start_append(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] = (),
                 interval: str | None = None) -> StreamingQuery:
    """Append to parquet exactly once; without ``interval`` run through what is there and stop."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**trigger).start(path)


def run_to_table(stream: DataFrame, name: str, partition_by: list[str] = ()) -> DataFrame:
    """Process everything available into a fresh table in the shared folder and return it."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    start_append(stream, f"{path}/data", f"{path}/checkpoint", partition_by).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def stream_points(readings: DataFrame, path: str, checkpoint: str, interval: str | None = FLUSH) -> StreamingQuery:
    """Readings merged into the points table each flush interval.

    The same idempotent writer serves the live path and the back-fill: a replayed batch changes nothing, and both may
    touch the same days.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = readings_to_points(readings).writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
    return writer.foreachBatch(lambda batch, _: upsert_points(batch, path)).start()


def stream_ingest(frames: DataFrame) -> DataFrame:
    """Frames to points: routing and decode are the batch expressions."""
    return readings_to_points(frames_to_readings(frames))


def stream_latest(readings: DataFrame, interval: str = FLUSH) -> DataFrame:
    """Only the newest reading per sensor and flush interval, ties by id."""
    newest = packed_order("ts", "event_id")
    fields = ["temperature", "humidity", "pressure", "battery_voltage", "rssi"]
    windows = readings.withWatermark("ts", WATERMARK).groupBy(F.window("ts", interval), "mac").agg(
        F.max(newest).alias("newest"), F.max("ts").alias("ts"), *[F.max_by(f, newest).alias(f) for f in fields])
    id_type = readings.schema["event_id"].dataType
    return windows.select(
        "mac", F.col("window.end").alias("flush_ts"), packed_tie(F.col("newest")).cast(id_type).alias("event_id"), "ts", *fields)


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB and save what changed, not all of it."""
    before = {key: spark.conf.get(key, None) for key in _STATE_CONF}
    for key, value in _STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stream_last_seen(readings: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Last-seen time per sensor, kept as the keyed state of the stream.

    A batch touches the sensors that reported in it and saves those alone. There is no second table to keep in step:
    ``last_seen_table`` reads the state of the last finished batch, and a replayed batch starts from the one before it.
    """
    newest = readings.groupBy("mac").agg(F.max("ts").alias("last_seen"))
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    with _state_on_disk(readings.sparkSession):
        return (
            newest.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**trigger).format("noop").start()
        )


def last_seen_table(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The state of ``stream_last_seen`` after its newest batch, or after an earlier one that is still kept."""
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(checkpoint).select("key.mac", F.col("value.max").alias("last_seen"))


def stream_stats(readings: DataFrame) -> DataFrame:
    """Readings, points and incomplete readings per minute."""
    fields = ["temperature", "humidity", "pressure", "battery_voltage", "rssi"]
    points = sum((F.col(f).isNotNull().cast("long") for f in fields), F.lit(0))
    incomplete = F.col("temperature").isNull() | F.col("humidity").isNull() | F.col("pressure").isNull()
    return (
        readings.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 minute"))
        .agg(F.count("*").alias("readings"), F.sum(points).alias("points"), F.count_if(incomplete).alias("incomplete"))
        .select(F.col("window.end").alias("ts"), "readings", "points", "incomplete")
    )


def stream_window(readings: DataFrame, every: str = "1 hour", keys: list[str] = ()) -> DataFrame:
    """Tumbling means of the three metrics."""
    return (
        readings.withWatermark("ts", WATERMARK).groupBy(F.window("ts", every), *keys)
        .agg(*[F.avg(c).alias(c) for c in METRICS.values()], F.count("*").alias("n"))
        .select(F.col("window.end").alias("ts"), *keys, *METRICS.values(), "n")
    )


def stream_moving_average(readings: DataFrame, period: str = "24 hours", every: str = "1 hour") -> DataFrame:
    """Trailing mean over ``period``.

    Readings are first reduced to one sum and count per ``every``, so each row
    that is repeated into the sliding windows is already an aggregate.
    """
    base = readings.withWatermark("ts", WATERMARK).groupBy(F.window("ts", every)).agg(
        F.sum("temperature").alias("s"), F.count("temperature").alias("c")
    )
    return (
        base.groupBy(F.window(F.window_time("window"), period, every).alias("w"))
        .agg(F.try_divide(F.sum("s"), F.sum("c")).alias("moving_average"), F.sum("c").alias("n"))
        .select(F.col("w.end").alias("ts"), "moving_average", "n")
    )


def _silence_rows(sessions: DataFrame, gap: str) -> DataFrame:
    return sessions.select(
        "mac", F.col("session_window.start").alias("first_seen"),
        (F.col("session_window.end") - F.expr(f"INTERVAL {gap}")).alias("last_seen"),
        F.col("session_window.end").alias("alert_ts"), "readings",
    )


def silences(readings: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Alerts for sensors that stopped reporting for at least ``gap`` (of one second or more).

    A session closes ``gap`` after its last reading, so each closed session is a
    silence: it began at ``last_seen`` and was noticed at ``alert_ts``. Readings
    of one second are merged first, which bounds the rows of a busy sensor.
    """
    seconds = readings.groupBy("mac", F.window("ts", "1 second")).agg(
        F.min("ts").alias("ts"), F.max("ts").alias("_last"), F.count("*").alias("_n")
    )
    span = F.unix_micros("_last") - F.unix_micros("ts") + F.unix_micros(F.expr(f"timestamp_seconds(0) + INTERVAL {gap}"))
    own_gap = F.concat(span.cast("string"), F.lit(" microseconds"))
    sessions = seconds.groupBy(F.session_window("ts", own_gap), "mac").agg(F.sum("_n").alias("readings"))
    return _silence_rows(sessions, gap)


def stream_silence(readings: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """The same live, once the watermark has passed the alert (sessions merge before the shuffle, see the session defaults)."""
    marked = readings.withWatermark("ts", WATERMARK)
    return _silence_rows(marked.groupBy(F.session_window("ts", gap), "mac").agg(F.count("*").alias("readings")), gap)


def stream_silence_timers(readings: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """``mac, last_seen, alert_ts``: one alert for every sensor from which nothing arrived for ``gap``.

    Each sensor has a timer on the clock, set anew by every batch in which it reports; so the alert needs no later
    reading of any sensor, as ``stream_silence`` does, and comes when the whole feed stops. ``alert_ts`` is when the timer
    ran out. A sensor that reports again can fall silent again. After a stop of the stream itself what has arrived
    meanwhile is taken in before timers are looked at. Readings without a time or sensor set no timer.
    """
    spark = readings.sparkSession
    wait = spark.range(1).select(F.unix_millis(F.expr(f"timestamp_seconds(0) + INTERVAL {gap}"))).first()[0]

    class Silence(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.newest = handle.getValueState("newest", "micros long")

        def handleInputRows(self, key, rows, timerValues):
            last = max(int(chunk["micros"].max()) for chunk in rows)
            if self.newest.exists():
                last = max(last, self.newest.get()[0])
            self.newest.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + wait)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield pd.DataFrame({"mac": [key[0]], "last": [self.newest.get()[0]], "alert": [expiredTimerInfo.getExpiryTimeInMs()]})

        def close(self) -> None:
            pass

    seen = readings.filter(F.col("mac").isNotNull() & F.col("ts").isNotNull()).select("mac", F.unix_micros("ts").alias("micros"))
    alerts = seen.groupBy("mac").transformWithStateInPandas(
        Silence(), "mac string, last long, alert long", "append", "processingTime")
    return alerts.select("mac", F.timestamp_micros("last").alias("last_seen"), F.timestamp_millis("alert").alias("alert_ts"))


def start_alerts(alerts: DataFrame, path: str, checkpoint: str, interval: str = FLUSH) -> StreamingQuery:
    """Append alerts exactly once; timers are looked at every ``interval``, whether or not readings arrive."""
    with _state_on_disk(alerts.sparkSession):
        return start_append(alerts, path, checkpoint, interval=interval)


def silent_now(last_seen: DataFrame, now: str, gap: str = "5 minutes") -> DataFrame:
    """Sensors whose last reading is at least ``gap`` before ``now``, from the saved last-seen table.

    The live alert waits for the watermark, and so for a later reading of any sensor. This one depends on the clock
    alone: run by a timer, it also tells that the whole feed has stopped.
    """
    alert = F.col("last_seen") + F.expr(f"INTERVAL {gap}")
    return last_seen.select("mac", "last_seen", alert.alias("alert_ts")).filter(F.col("alert_ts") <= _instant(now))


def stream_dedupe(readings: DataFrame, within: str = WATERMARK) -> DataFrame:
    """Repeated advertisements pass once: same sensor and sequence number.

    A reading without a number (format 3 has none) is known by its time and values.
    """
    values = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), *[
        F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("temperature", "humidity", "pressure", "battery_voltage")])
    known = F.coalesce(F.col("measurement_sequence").cast("string"), values)
    keyed = readings.withColumn("_reading", known).withWatermark("ts", within)
    return keyed.dropDuplicatesWithinWatermark(["mac", "_reading"]).drop("_reading")


def errors_store(spark: SparkSession, path: str) -> Store:
    """Forecast errors by the day they were measured."""
    return Store(spark, path, ["date"])


def incremental_errors(readings: DataFrame, forecasts: DataFrame, now: str, horizons: list[int], path: str,
                       look_back_hours: int = 48) -> DataFrame:
    """Recompute the errors of the look-back, today's up to ``now`` among them, and replace exactly those days at once.

    The window starts at a day border so that a replaced day is always whole. Run again, at the same time or later the
    same day, it replaces what it wrote; stopped on the way, it leaves the table as it was.
    """
    spark, store = readings.sparkSession, errors_store(readings.sparkSession, path)
    start = F.date_trunc("day", _instant(now) - F.expr(f"INTERVAL {int(look_back_hours)} HOURS"))
    due = (F.col("ts") >= start) & (F.col("ts") < _instant(now))
    actual = hourly_means(readings.filter(due))
    predicted = hourly_means(forecasts.filter(due & (F.col("data_type") == "forecast")), ["horizon_hours", "source"])
    # a window ending at midnight belongs to the day it measured
    errors = forecast_errors(align_run(actual, predicted, horizons), ["source"]).withColumn(
        "date", F.to_date(F.col("ts") - F.expr("INTERVAL 1 SECOND"))
    )
    first, last = map(str, spark.range(1).select(F.to_date(start), F.to_date(_instant(now))).first())
    # a recomputed day may have lost all its rows: every day of the look-back is replaced
    store.commit(errors, lambda part: first <= (part["date"] or "") <= last)
    return store.read()


def backfill(history: DataFrame, path: str) -> None:
    """Late history into the same points table, any age, twice if need be."""
    upsert_points(readings_to_points(history), path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                interval: str | None = None) -> StreamingQuery:
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
        .foreachBatch(handle).start()
    )
