"""Streams over several batches, restarts and late rows."""

import re
import time

import pytest
from pyspark.sql import functions as F
from test_queries import executed_plans

from skyledger.operators import aggregates, filters
from skyledger.sources import points
from skyledger.sources.points import readings_to_points
from skyledger.streaming import extend, live

SCHEMA = "event_id bigint, mac string, ts timestamp, temperature double, humidity double, pressure double, " \
         "battery_voltage double, rssi int, measurement_sequence int"


def land(spark, path, rows):
    """Append one file of (event_id, mac, second of the day, sequence) rows."""
    df = spark.createDataFrame(rows, "event_id long, mac string, s int, measurement_sequence int")
    df.selectExpr(
        "event_id", "mac", "timestamp '2024-01-01' + make_dt_interval(0, 0, 0, s) as ts", "cast(event_id as double) as temperature",
        "50.0D as humidity", "1000.0D as pressure", "3.0D as battery_voltage", "-60 as rssi", "measurement_sequence",
    ).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def landing(spark, tmp_path):
    path = str(tmp_path / "landing")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return path


def stream(spark, path):
    return live.read_stream(spark, path, SCHEMA, files_per_trigger=1)


def drain(df, path, checkpoint):
    live.start_append(df, path, checkpoint).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_dedupe_across_batches_and_restart(spark, landing, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    land(spark, landing, [(1, "a", 10, 1), (2, "a", 11, 1), (3, "b", 12, 1)])
    assert drain(live.stream_dedupe(stream(spark, landing)), out, ckpt).count() == 2
    land(spark, landing, [(4, "a", 13, 1), (5, "a", 14, 2)])  # seen before the restart
    kept = drain(live.stream_dedupe(stream(spark, landing)), out, ckpt)
    assert sorted(tuple(r) for r in kept.select("mac", "measurement_sequence").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_latest_per_flush(spark, landing, tmp_path):
    land(spark, landing, [(1, "a", 1, 1), (2, "a", 9, 2), (3, "a", 10, 3), (4, "b", 5, 1)])
    land(spark, landing, [(9, "z", 7200, 1)])  # moves the watermark
    out = drain(live.stream_latest(stream(spark, landing)), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert sorted((r["mac"], r["event_id"]) for r in out.collect()) == [("a", 2), ("a", 3), ("b", 4)]


def seen(spark, checkpoint, batch=None):
    found = live.last_seen_table(spark, checkpoint, batch).selectExpr("mac", "unix_seconds(last_seen) % 86400 as s")
    return sorted(tuple(r) for r in found.collect())


def test_last_seen_is_state(spark, landing, tmp_path):
    ckpt = str(tmp_path / "ckpt")
    land(spark, landing, [(1, "a", 10, 1), (2, "b", 20, 1)])
    live.stream_last_seen(stream(spark, landing), ckpt).awaitTermination()
    assert seen(spark, ckpt) == [("a", 10), ("b", 20)]
    land(spark, landing, [(3, "a", 5, 2), (4, "c", 30, 1), (5, "b", 40, 1)])
    live.stream_last_seen(stream(spark, landing), ckpt).awaitTermination()
    assert seen(spark, ckpt) == [("a", 10), ("b", 40), ("c", 30)]


def test_last_seen_survives_a_replayed_batch(spark, landing, tmp_path):
    """The second batch is run again as if it had been lost before its end was noted."""
    ckpt = tmp_path / "ckpt"
    land(spark, landing, [(1, "a", 10, 1), (2, "b", 20, 1)])
    live.stream_last_seen(stream(spark, landing), str(ckpt)).awaitTermination()
    land(spark, landing, [(3, "b", 40, 1)])
    live.stream_last_seen(stream(spark, landing), str(ckpt)).awaitTermination()
    last = max(int(f.name) for f in (ckpt / "commits").iterdir() if f.name.isdigit())
    for f in (ckpt / "commits").glob(f"*{last}*"):
        f.unlink()
    assert seen(spark, str(ckpt)) == [("a", 10), ("b", 20)]
    land(spark, landing, [(4, "c", 50, 1)])
    live.stream_last_seen(stream(spark, landing), str(ckpt)).awaitTermination()
    assert seen(spark, str(ckpt)) == [("a", 10), ("b", 40), ("c", 50)]


def test_last_seen_batches_save_what_changed(spark, landing, tmp_path):
    """A thousand sensors, then one of them: the second batch writes one row of state."""
    ckpt = str(tmp_path / "ckpt")
    land(spark, landing, [(i, f"s{i}", 10, 1) for i in range(1000)])
    live.stream_last_seen(stream(spark, landing), ckpt).awaitTermination()
    land(spark, landing, [(2000, "s7", 20, 1)])
    run = live.stream_last_seen(stream(spark, landing), ckpt)
    run.awaitTermination()
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress if p["numInputRows"]]
    assert updated == [1] and len(seen(spark, ckpt)) == 1000


def wait_for(condition, seconds=90):
    deadline = time.monotonic() + seconds
    while not condition() and time.monotonic() < deadline:
        time.sleep(0.3)
    assert condition()


def test_timers_tell_that_every_sensor_stopped(spark, landing, tmp_path):
    """No reading follows; each alert comes once, also after a restart, and again after a new silence."""
    out, ckpt = str(tmp_path / "alerts"), str(tmp_path / "ckpt")
    alerts = lambda: sorted(tuple(r) for r in spark.read.schema("mac string, last_seen timestamp").parquet(out)
                            .selectExpr("mac", "unix_seconds(last_seen) % 86400").collect())
    start = lambda: live.start_alerts(live.stream_silence_timers(stream(spark, landing), "1 second"), out, ckpt, "1 second")
    land(spark, landing, [(1, "a", 10, 1), (2, "b", 20, 1), (3, "a", 30, 2), (4, None, 40, 1)])
    run = start()
    wait_for(lambda: run.recentProgress and alerts() == [("a", 30), ("b", 20)])
    run.stop()
    land(spark, landing, [(5, "a", 25, 3)])  # late, but a sign of life
    run = start()
    wait_for(lambda: len(alerts()) == 3)
    batches = len(run.recentProgress)
    wait_for(lambda: len(run.recentProgress) >= batches + 2)
    run.stop()
    assert alerts() == [("a", 30), ("a", 30), ("b", 20)]


def test_silence_is_reported_once_closed(spark, landing, tmp_path):
    land(spark, landing, [(1, "a", 0, 1), (2, "a", 200, 2), (3, "a", 1000, 3), (4, "b", 5000, 1)])
    out = drain(live.stream_silence(stream(spark, landing)), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    rows = out.selectExpr("mac", "unix_seconds(last_seen) % 86400 as last", "unix_seconds(alert_ts) % 86400 as alert", "readings")
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 200, 500, 2), ("a", 1000, 1300, 1)]


def test_a_feed_that_stops_is_told(spark, landing, tmp_path):
    """No reading follows the last one, so no watermark moves; the clock alone raises the alerts."""
    land(spark, landing, [(1, "a", 0, 1), (2, "b", 200, 2)])
    live.stream_last_seen(stream(spark, landing), str(tmp_path / "ckpt")).awaitTermination()
    newest = live.last_seen_table(spark, str(tmp_path / "ckpt"))
    day = newest.selectExpr("date_format(max(last_seen), 'yyyy-MM-dd')").first()[0]
    told = lambda clock: sorted(r["mac"] for r in live.silent_now(newest, f"{day} {clock}").collect())
    assert told("00:04:00") == [] and told("00:05:00") == ["a"] and told("00:30:00") == ["a", "b"]


def test_batch_silence_equals_plain_sessions(tables):
    plain = tables.readings.groupBy(F.session_window("ts", "5 minutes"), "mac").agg(F.count("*").alias("readings"))
    want = plain.selectExpr("mac", "session_window.start first_seen", "session_window.end alert_ts", "readings")
    got = live.silences(tables.readings).select(*want.columns)
    assert want.count() == got.count() and want.exceptAll(got).isEmpty()


def test_late_rows_are_counted_and_backfilled(spark, landing, tmp_path):
    """A row older than the watermark leaves the live window, is counted, and arrives by back-fill."""
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    query = live.stream_window(stream(spark, landing), "1 hour")
    land(spark, landing, [(1, "a", 60, 1), (2, "a", 40000, 2)])
    live.start_append(query, out, ckpt).awaitTermination()
    land(spark, landing, [(3, "a", 70, 3)])
    run = live.start_append(query, out, ckpt)
    run.awaitTermination()
    assert sum(s.get("numRowsDroppedByWatermark", 0) for p in run.recentProgress for s in p["stateOperators"]) == 1

    from skyledger.sources import points
    from skyledger.sources.points import readings_to_points

    table = str(tmp_path / "points")
    rows = spark.read.schema(SCHEMA).parquet(landing).withColumn("data_format", F.lit(5))
    points.write_points(readings_to_points(rows.filter("event_id < 3")), table)
    for _ in range(2):
        live.backfill(rows.filter("event_id = 3"), table)
    assert points.read_points(spark, table).filter("field = 'temperature'").count() == 3


def test_live_writes_and_backfill_share_a_table(spark, landing, tmp_path):
    from skyledger.sources import points

    table = str(tmp_path / "points")
    rows = [(i, "a", 10 * i, i) for i in range(9)]
    live.backfill(spark.createDataFrame([], "event_id long, mac string, ts timestamp, temperature double, data_format int"), table + "-none")
    for part in (rows[:3], rows[3:6]):
        land(spark, landing, part)
        source = stream(spark, landing).withColumn("data_format", F.lit(5))
        live.stream_points(source, table, str(tmp_path / "ckpt"), None).awaitTermination()
        late = spark.read.schema(SCHEMA).parquet(landing).withColumn("data_format", F.lit(5))
        live.backfill(late, table)
    land(spark, landing, rows[6:])
    for _ in range(2):
        live.backfill(spark.read.schema(SCHEMA).parquet(landing).withColumn("data_format", F.lit(5)), table)
    assert points.read_points(spark, table).filter("field = 'temperature'").count() == 9


def test_readings_without_a_number_pass(spark, landing, tmp_path):
    rows = [("a", 1, "00:00:01", 1.0), ("a", 1, "00:00:02", 1.0), ("a", None, "00:00:01", 1.0), ("a", None, "00:00:01", 1.0), ("a", None, "00:00:03", 1.0)]
    df = spark.createDataFrame(rows, "mac string, measurement_sequence int, t string, temperature double").selectExpr(
        "mac", "measurement_sequence", "cast('2024-01-01 ' || t as timestamp) ts", "temperature", "1.0D humidity", "1.0D pressure", "3.0D battery_voltage")
    df.write.parquet(f"{landing}-numbers")
    source = spark.readStream.schema(df.schema).parquet(f"{landing}-numbers")
    out = drain(live.stream_dedupe(source), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert sorted((r["measurement_sequence"] or 0 for r in out.collect())) == [0, 0, 1]


def test_moving_average_matches_batch(spark, landing, tmp_path):
    land(spark, landing, [(i, "a", 1800 * i, i) for i in range(48)])
    out = drain(live.stream_moving_average(stream(spark, landing), "3 hours"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r["s"] // 3600: r["moving_average"] for r in out.selectExpr("unix_seconds(ts) % 86400 as s", "moving_average").collect()}
    assert got[5] == pytest.approx(sum(range(4, 10)) / 6)


def test_callbacks_are_isolated(spark, landing, tmp_path):
    land(spark, landing, [(1, "a", 1, 1)])
    seen, callbacks = [], extend.BatchCallbacks()
    callbacks.add("bad", lambda batch, i: 1 / 0)
    callbacks.add("good", lambda batch, i: seen.append(batch.count()))
    callbacks.add("gone", lambda batch, i: seen.append("never"))
    callbacks.remove("gone")
    live.run_batches(stream(spark, landing), callbacks, str(tmp_path / "ckpt")).awaitTermination()
    assert sum(seen) == 1 and {f[0] for f in callbacks.failures} == {"bad"}


def test_sql_functions(spark):
    extend.register_functions(spark)
    row = spark.sql(
        "SELECT battery_band(2.65D) b, normalize_mac('aabbccddeeff') m, abs_error(1.0D, 3.0D) a, signed_error(3.0D, 1.0D) s, "
        "horizon_hours(timestamp '2024-01-01', timestamp '2024-01-02') h, tx_power_from_word(51224) t, battery_from_word(51224) v"
    ).first()
    assert tuple(row) == ("Fair", "AA:BB:CC:DD:EE:FF", 2.0, -2.0, 24, 8, 3.2)


def test_sql_table_functions_equal_their_operators(spark, tables):
    names = extend.register_table_functions(spark, {"points": tables.points, "forecast_errors": tables.forecast_errors})
    since, until = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
    between = f"timestamp '{since}', timestamp '{until}'"

    def same(sql, df):
        left, right = spark.sql(sql), df.select(*spark.sql(sql).columns)
        keys = [c for c, kind in left.dtypes if kind != "double"]
        a, b = ({tuple(r[k] for k in keys): [r[c] for c in left.columns if c not in keys] for r in d.collect()} for d in (left, right))
        assert a and a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)

    temperature = filters.time_range(tables.points.filter("field = 'temperature'"), since, until)
    same(f"SELECT * FROM window_mean('temperature', 21600, {between})",
         aggregates.aggregate_window(temperature, "6 hours", ["mac"], [F.avg("value").alias("mean")]))
    same(f"SELECT * FROM horizon_report({between})",
         aggregates.horizon_report(filters.time_range(tables.forecast_errors, since, until)))
    day = tables.forecast_errors.filter("horizon_hours = 24")
    mae = aggregates.aggregate_window(day, "30 minutes", ["source"], [F.avg("temp_abs_error").alias("mae")])
    same("SELECT * FROM alert_windows(24, 1800, 3.0D)", mae.filter("mae > 3"))
    joined = spark.sql(f"SELECT count(*) AS n FROM alert_windows(24, 3600, 2.0D) a JOIN horizon_report({between}) r ON r.horizon_hours = 24")
    assert joined.first()["n"] > 0 and set(names) == set(extend.TABLE_FUNCTIONS)


def test_late_history_is_shuffled_by_second_not_by_point(spark, tables, tmp_path):
    """A new field arrives with the late rows; stored fields keep their values, and a repeat changes nothing."""
    path = str(tmp_path / "table")
    some = tables.readings.filter(F.to_date("ts") == "2024-01-05")
    points.write_points(readings_to_points(some.filter("event_id % 3 <> 0").drop("rssi")), path)
    for _ in range(2):
        before = max(executed_plans(spark), default=-1)
        live.backfill(some.filter("event_id % 3 = 0"), path)
        written = [p for p in executed_plans(spark, before).values() if "InsertIntoHadoopFsRelationCommand" in p]
        assert written and not [p for p in written if re.search(r"hashpartitioning\(measurement#\d+, mac", p)]
    want = points.dedupe_points(readings_to_points(some).filter("field <> 'rssi' or event_id % 3 = 0"))
    columns = ["measurement", "mac", "data_format", "field", "ts", "value"]
    got = points.read_points(spark, path).select(*columns)
    assert got.count() == want.count() and got.exceptAll(want.select(*columns)).isEmpty()
