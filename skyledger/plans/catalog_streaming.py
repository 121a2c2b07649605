"""Registered queries: live operators, each compared with its batch meaning.

In append mode a window is published once the watermark (newest time minus ten
minutes) has passed its end, so the checks keep the windows closed by then.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align
from ..schemas import FIELD_MEASUREMENT
from ..session import scratch_path
from ..sources import points
from ..streaming import extend, live
from .catalog_sources import _F3, _F5, POINT_COLUMNS
from .catalog_tables import ERROR_COLUMNS, ERROR_VALUES
from .oracle import with_views
from .registry import query
from .views import HORIZONS, NOW, RANGE_START, RANGE_STOP, Tables

CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - interval '10 minutes' FROM readings)"


def _bucket(every: str) -> str:
    return f"time_bucket(interval '{every}', ts, timestamp '1970-01-01') + interval '{every}'"


@query("a06_stream_points", with_views(
    "points",
    f"SELECT {POINT_COLUMNS.replace('ts', 'second AS ts')} FROM (SELECT *, date_trunc('second', ts) AS second FROM points) QUALIFY "
    "row_number() OVER (PARTITION BY measurement, mac, data_format, field, second ORDER BY event_id DESC) = 1",
))
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "stream-points")
    live.stream_points(t.stream_readings, f"{path}/data", f"{path}/checkpoint", None).awaitTermination()
    return points.read_points(t.spark, f"{path}/data").select(*POINT_COLUMNS.split(", "))


@query("h01_stream_ingest", with_views(
    "frame_ints",
    " UNION ALL ".join(
        f"SELECT event_id, mac, data_format, ts, '{measurement}' AS measurement, '{field}' AS field, cast({field} AS DOUBLE) AS value "
        f"FROM decoded WHERE {field} IS NOT NULL" for field, measurement in FIELD_MEASUREMENT.items()
    ),
    decoded=f"SELECT * REPLACE (upper(address) AS mac), frame_id AS event_id, received_at AS ts FROM ({_F3} UNION ALL BY NAME {_F5})",
))
def _(t: Tables) -> DataFrame:
    ingest = live.stream_ingest(t.streamed(t.frames, "landing"))
    return live.run_to_table(ingest, "ingest").select(*POINT_COLUMNS.split(", "))


@query("h02_stream_latest", with_views(
    "readings",
    f"SELECT mac, {_bucket('10 seconds')} AS flush_ts, event_id, ts, temperature, humidity, pressure, battery_voltage, rssi FROM readings "
    f"WHERE {_bucket('10 seconds')} <= {CLOSED} "
    "QUALIFY row_number() OVER (PARTITION BY mac, flush_ts ORDER BY ts DESC, event_id DESC) = 1",
))
def _(t: Tables) -> DataFrame:
    return live.run_to_table(live.stream_latest(t.stream_readings), "latest")


@query("h03_stream_last_seen", with_views("readings", "SELECT mac, max(ts) AS last_seen FROM readings GROUP BY mac"))
def _(t: Tables) -> DataFrame:
    checkpoint = scratch_path(t.spark, "last-seen")
    live.stream_last_seen(t.stream_readings, checkpoint).awaitTermination()
    return live.last_seen_table(t.spark, checkpoint)


@query("h04_stream_stats", with_views(
    "readings",
    "SELECT ts, count(*) AS readings, cast(sum(points) AS BIGINT) AS points, count(*) FILTER (incomplete) AS incomplete FROM "
    f"(SELECT {_bucket('1 minute')} AS ts, (temperature IS NOT NULL)::INT + (humidity IS NOT NULL)::INT + (pressure IS NOT NULL)::INT + "
    "(battery_voltage IS NOT NULL)::INT + (rssi IS NOT NULL)::INT AS points, temperature IS NULL OR humidity IS NULL OR pressure IS NULL "
    f"AS incomplete FROM readings) WHERE ts <= {CLOSED} GROUP BY ts",
))
def _(t: Tables) -> DataFrame:
    return live.run_to_table(live.stream_stats(t.stream_readings), "stats")


@query("h05_stream_window", with_views(
    "readings",
    "SELECT w AS ts, avg(temperature) AS temperature, avg(pressure) AS pressure, avg(humidity) AS humidity, count(*) AS n FROM "
    f"(SELECT *, {_bucket('1 hour')} AS w FROM readings) WHERE w <= {CLOSED} GROUP BY w",
), "temperature pressure humidity")
def _(t: Tables) -> DataFrame:
    return live.run_to_table(live.stream_window(t.stream_readings), "window")


@query("h06_stream_moving_average", with_views(
    "readings",
    "SELECT e.ts, avg(r.temperature) AS moving_average, count(r.temperature) AS n FROM ends e JOIN readings r ON r.ts < e.ts AND "
    f"r.ts >= e.ts - interval '24 hours' WHERE e.ts <= {CLOSED} GROUP BY e.ts",
    ends="SELECT unnest(generate_series(date_trunc('hour', min(ts)) + interval '1 hour', max(ts), interval '1 hour')) AS ts FROM readings",
), "moving_average")
def _(t: Tables) -> DataFrame:
    return live.run_to_table(live.stream_moving_average(t.stream_readings), "moving")


@query("h07_stream_silence", with_views(
    "readings",
    "SELECT mac, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) + interval '5 minutes' AS alert_ts, count(*) AS readings FROM "
    "(SELECT *, count(*) FILTER (gap) OVER (PARTITION BY mac ORDER BY ts, event_id) AS session FROM (SELECT *, "
    "ts - lag(ts) OVER (PARTITION BY mac ORDER BY ts, event_id) > interval '5 minutes' AS gap FROM readings)) "
    f"GROUP BY mac, session HAVING max(ts) + interval '5 minutes' <= {CLOSED}",
))
def _(t: Tables) -> DataFrame:
    return live.run_to_table(live.stream_silence(t.stream_readings), "silence")


@query("h07_silent_now", with_views(
    "readings",
    "SELECT * FROM (SELECT mac, max(ts) AS last_seen, max(ts) + interval '12 hours' AS alert_ts FROM readings GROUP BY mac) "
    f"WHERE alert_ts <= timestamp '{NOW}'",
))
def _(t: Tables) -> DataFrame:
    """The feed has ended; the saved last-seen table and the clock tell who is silent."""
    checkpoint = scratch_path(t.spark, "silent")
    live.stream_last_seen(t.stream_readings, checkpoint).awaitTermination()
    return live.silent_now(live.last_seen_table(t.spark, checkpoint), NOW, "12 hours")


@query("h07_silence_timers", with_views("readings", "SELECT mac, max(ts) AS last_seen, cast(1 AS BIGINT) AS alerts FROM readings GROUP BY mac"))
def _(t: Tables) -> DataFrame:
    """The feed ends and every sensor falls silent: the clock alone raises each alert once, while the stream runs on."""
    path = scratch_path(t.spark, "timers")
    sensors = t.readings.select("mac").distinct().count()
    run = live.start_alerts(live.stream_silence_timers(t.stream_readings, "1 second"), f"{path}/data", f"{path}/checkpoint", "1 second")
    try:
        deadline = time.monotonic() + 120
        while _alerts(t, f"{path}/data").count() < sensors and run.isActive and time.monotonic() < deadline:
            time.sleep(0.5)
        batches = len(run.recentProgress)
        while len(run.recentProgress) < batches + 2 and run.isActive and time.monotonic() < deadline:
            time.sleep(0.5)  # timers are looked at again: nothing is raised twice
    finally:
        run.stop()
    return _alerts(t, f"{path}/data").groupBy("mac").agg(F.max("last_seen").alias("last_seen"), F.count("*").alias("alerts"))


def _alerts(t: Tables, path: str) -> DataFrame:
    return t.spark.read.schema("mac string, last_seen timestamp, alert_ts timestamp").parquet(path)


@query("h08_stream_dedupe", with_views(
    "readings",
    "SELECT DISTINCT mac, measurement_sequence FROM readings WHERE measurement_sequence IS NOT NULL UNION ALL "
    "SELECT mac, NULL FROM (SELECT DISTINCT mac, ts, temperature, humidity, pressure, battery_voltage FROM readings "
    "WHERE measurement_sequence IS NULL)",
))
def _(t: Tables) -> DataFrame:
    """Every reading is advertised three times: a second apart if it is numbered, at the same time if not."""
    repeated = t.stream_readings.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    repeated = repeated.withColumn("ts", F.when(F.col("measurement_sequence").isNull(), F.col("ts")).otherwise(
        F.timestamp_add("SECOND", F.col("again"), F.col("ts")))).drop("again")
    once = live.run_to_table(live.stream_dedupe(repeated), "dedupe")
    return once.select("mac", "measurement_sequence")


@query("h09_incremental_errors", with_views("forecast_errors", f"SELECT {ERROR_COLUMNS} FROM forecast_errors"), ERROR_VALUES)
def _(t: Tables) -> DataFrame:
    """A first run over everything, two runs in the afternoon of a day, then the one that rewrites the last two days."""
    path = scratch_path(t.spark, "errors")
    live.incremental_errors(t.readings, t.forecast_points, "2024-01-29 06:00:00", HORIZONS, path, 30 * 24)
    for _ in range(2):
        live.incremental_errors(t.readings, t.forecast_points, "2024-01-29 15:00:00", HORIZONS, path, 48)
    table = live.incremental_errors(t.readings, t.forecast_points, NOW, HORIZONS, path, 48)
    return table.select(*ERROR_COLUMNS.split(", "))


@query("h10_backfill", with_views(
    "points",
    "SELECT measurement, mac, data_format, field, date_trunc('second', ts) AS ts, value FROM points QUALIFY "
    "row_number() OVER (PARTITION BY measurement, mac, data_format, field, date_trunc('second', ts) ORDER BY event_id DESC) = 1",
))
def _(t: Tables) -> DataFrame:
    """The live path begins the table; a third of the history arrives late, twice."""
    path = scratch_path(t.spark, "backfill")
    live.stream_points(t.stream_readings.filter("event_id % 3 <> 0"), path, scratch_path(t.spark, "backfill-checkpoint"),
                       None).awaitTermination()
    for _ in range(2):
        live.backfill(t.readings.filter("event_id % 3 = 0"), path)
    return points.read_points(t.spark, path).select("measurement", "mac", "data_format", "field", "ts", "value")


@query("i01_batch_callbacks", with_views(
    "readings", "SELECT (SELECT count(*) FROM readings) AS stored, cast(1 AS BIGINT) AS failures"
))
def _(t: Tables) -> DataFrame:
    """One callback stores, one fails; the failure is reported and the data arrives."""
    path = scratch_path(t.spark, "callbacks")
    callbacks = extend.BatchCallbacks()

    def broken(batch: DataFrame, batch_id: int) -> None:
        raise RuntimeError("display unavailable")

    callbacks.add("display", broken)
    callbacks.add("store", lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}"))
    live.run_batches(t.stream_readings, callbacks, f"{path}/checkpoint").awaitTermination()
    failed = len({name for name, _, _ in callbacks.failures})
    return t.spark.read.parquet(f"{path}/data").agg(F.count("*").alias("stored")).withColumn("failures", F.lit(failed).cast("long"))


@query("i02_progress_log", "SELECT count(*) AS points FROM events")
def _(t: Tables) -> DataFrame:
    """Progress of a run as an operation-metric table."""
    progress = extend.ProgressLog(t.spark, scratch_path(t.spark, "progress-log"))
    t.spark.streams.addListener(progress)
    try:
        live.run_to_table(t.stream_readings, "progress")
        progress.ended.wait(60)  # told after the last progress of the run
    finally:
        t.spark.streams.removeListener(progress)
    return progress.table().agg(F.sum("points").alias("points"))


@query("i03_map_columns", with_views("errors_long", "SELECT ts, metric, horizon_hours, source, signed_error * signed_error AS squared "
       "FROM errors_long"), "squared")
def _(t: Tables) -> DataFrame:
    rows = align.errors_long(t.forecast_errors)
    e = F.col("signed_error")
    return rows.select("ts", "metric", "horizon_hours", "source", (e * e).alias("squared"))


@query("i04_sql_surface", with_views(
    "readings",
    "SELECT mac, CASE WHEN battery_voltage >= 3.0 THEN 'Excellent' WHEN battery_voltage >= 2.8 THEN 'Good' WHEN battery_voltage >= 2.6 "
    "THEN 'Fair' WHEN battery_voltage >= 2.4 THEN 'Low' WHEN battery_voltage IS NOT NULL THEN 'Critical' END AS band, count(*) AS n "
    "FROM readings GROUP BY ALL",
))
def _(t: Tables) -> DataFrame:
    extend.register_functions(t.spark)
    extend.register_views({"readings": t.readings, "points": t.points, "forecast_errors": t.forecast_errors, "sensors": t.sensors})
    return t.spark.sql(
        "SELECT normalize_mac(mac) AS mac, battery_band(battery_voltage) AS band, count(*) AS n FROM readings GROUP BY ALL"
    )


def _tables(t: Tables) -> None:
    extend.register_table_functions(t.spark, {"points": t.points, "forecast_errors": t.forecast_errors})


@query("i04_window_mean", with_views(
    "points",
    "SELECT mac, time_bucket(interval '1 hour', ts, timestamp '1970-01-01') + interval '1 hour' AS ts, avg(value) AS mean FROM points "
    f"WHERE field = 'temperature' AND ts >= timestamp '{RANGE_START}' AND ts < timestamp '{RANGE_STOP}' GROUP BY ALL",
), "mean")
def _(t: Tables) -> DataFrame:
    _tables(t)
    return t.spark.sql(f"SELECT * FROM window_mean('temperature', 3600, timestamp '{RANGE_START}', timestamp '{RANGE_STOP}')")


@query("i04_horizon_report", with_views(
    "forecast_errors",
    "SELECT horizon_hours, count(*) AS records, avg(temp_abs_error) AS temp_mae, max(temp_abs_error) AS temp_max_error, "
    "avg(temp_signed_error) AS temp_bias, avg(pressure_abs_error) AS pressure_mae, avg(humidity_abs_error) AS humidity_mae, "
    "CASE WHEN avg(temp_signed_error) > 0 THEN 'over-prediction' ELSE 'under-prediction' END AS direction "
    f"FROM forecast_errors WHERE ts >= timestamp '{RANGE_START}' AND ts < timestamp '{RANGE_STOP}' GROUP BY horizon_hours",
), "temp_mae temp_max_error temp_bias pressure_mae humidity_mae")
def _(t: Tables) -> DataFrame:
    _tables(t)
    return t.spark.sql(f"SELECT * FROM horizon_report(timestamp '{RANGE_START}', timestamp '{RANGE_STOP}')")


@query("i04_alert_windows", with_views(
    "forecast_errors",
    "SELECT source, time_bucket(interval '30 minutes', ts, timestamp '1970-01-01') + interval '30 minutes' AS ts, "
    "avg(temp_abs_error) AS mae FROM forecast_errors WHERE horizon_hours = 24 GROUP BY ALL HAVING avg(temp_abs_error) > 3",
), "mae")
def _(t: Tables) -> DataFrame:
    _tables(t)
    return t.spark.sql("SELECT * FROM alert_windows(24, 1800, 3.0D)")
