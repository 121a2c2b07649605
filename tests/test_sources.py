"""File shapes, validation, stored points and the sensor dimension."""

import pytest
from pyspark.sql import functions as F

from skyledger.functions import scalars as s
from skyledger.operators import aggregates, align, filters, sensors, windows
from skyledger.sources import files, forecast_json, points


def write_text(path, *documents):
    path.mkdir()
    for i, text in enumerate(documents):
        (path / f"{i}.txt").write_text(text)
    return str(path)


def test_json_shapes(spark, tmp_path):
    path = write_text(
        tmp_path / "docs", '{"export_info": {"record_count": 1},\n "data": [{"mac": "a", "temperature": 1.5}]}',
        '[{"mac": "b"}, {"mac": "c", "rssi": -70}]', '{"mac": "d"}', '"neither"',
    )
    got = files.import_json(spark, path, whole_files=True).select("mac", "temperature", "rssi")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "1.5", None), ("b", None, None), ("c", None, "-70"), ("d", None, None)]


def test_export_is_readable_by_import(spark, tables, tmp_path):
    files.export_json(tables.readings, tables.sensors, str(tmp_path))
    back = files.import_json(spark, f"{tmp_path}/data")
    good, bad = files.validate_import(back)
    assert bad.count() == 0
    columns = ["mac", "ts", "temperature", "rssi"]
    assert good.select(*columns).exceptAll(tables.readings.select(*columns)).isEmpty()


def test_validation_keeps_zero_and_defaults(spark):
    rows = [("1", "a", "", "0", "5"), ("2", None, "2024-01-01", "x", "5"), ("3", "c", "01/02/2024", "1", "5")]
    df = spark.createDataFrame(rows, "event_id string, mac string, ts string, temperature string, rssi string")
    good, bad = files.validate_import(df, F.lit("2024-05-01").cast("timestamp"))
    kept = good.collect()
    assert [(r["mac"], r["temperature"], str(r["ts"])[:10], r["data_format"]) for r in kept] == [("a", 0.0, "2024-05-01", -1)]
    assert sorted(r["problems"] for r in bad.collect()) == ["temperature", "ts"]


def test_annotated_csv(spark, tmp_path):
    text = "#datatype,string\n#group,false\n,result,table,_start,_value\n,_result,0,2024,1.5\n\n,short\n,_result,0,2024,2.5\n"
    rows = files.read_annotated_csv(spark, write_text(tmp_path / "csv", text, text)).collect()
    assert [r["_value"] for r in rows] == ["1.5", "2.5"] * 2
    with pytest.raises(ValueError):
        files.read_annotated_csv(spark, write_text(tmp_path / "none", "a,b\n1,2\n"))


def test_line_protocol_leaves_out_nulls(spark):
    df = spark.createDataFrame([("a", 1.5, None), (None, None, 3)], "mac string, t double, r int")
    df = df.withColumn("ts", F.lit("1970-01-01 00:00:01").cast("timestamp"))
    assert [r["value"] for r in files.line_protocol(df, ["t", "r"]).collect()] == [
        "sensors,mac=a t=1.5 1000000000", "sensors,mac=unknown r=3 1000000000"
    ]


def test_forecast_json_edge_cells(spark):
    doc = ('{"timezone":"UTC","hourly":{"time":["2024-01-01T00:00","bad","2024-01-01T02:00Z"],'
           '"temperature_2m":[1.5,2.5,"cold"],"weathercode":[3.7,1],"uv_index":[null,1,2]}}')
    docs = spark.createDataFrame([(doc,), ("{}",), ("not json",)], "doc string")
    rows = forecast_json.parse_forecast_json(docs).orderBy("ts").collect()
    assert [(r["pos"], r["temperature"], r["weather_code"], r["uv_index"], r["humidity"]) for r in rows] == [
        (0, 1.5, 3, None, None), (2, None, None, 2.0, None)
    ]


def test_current_json_zero_fill(spark):
    doc = '{"current_weather":{"time":"2024-01-01T00:00Z","temperature":1.0}}'
    docs = spark.createDataFrame([(doc,)], "doc string")
    assert forecast_json.parse_current_json(docs).first()["humidity"] is None
    assert forecast_json.parse_current_json(docs, zero_fill=True).first()["humidity"] == 0.0


def test_write_points_replaces_only_its_days(spark, tables, tmp_path):
    path = str(tmp_path / "points")
    points.write_points(tables.points, path)
    before = points.read_points(spark, path).groupBy("date").count().collect()
    day = tables.points.filter(F.to_date("ts") == "2024-01-05")
    points.write_points(day.withColumn("value", F.col("value") + 1), path)
    after = points.read_points(spark, path)
    assert sorted(map(tuple, before)) == sorted(map(tuple, after.groupBy("date").count().collect()))


def test_sensor_metadata_round_trip(spark, tables, tmp_path):
    files.export_sensors(tables.sensors, str(tmp_path / "s"))
    back = files.load_sensors(spark, str(tmp_path / "s")).select(*tables.sensors.columns)
    assert back.exceptAll(tables.sensors).isEmpty() and back.count() == tables.sensors.count()


def test_replace_import_and_config(spark, tables):
    one = tables.sensors.limit(1)
    assert sensors.merge_sensors(tables.sensors, one, merge=False).count() == 1
    old = spark.createDataFrame([("1", 20)], "v string, scan int").withColumn("last_updated", F.lit("2024-01-01").cast("timestamp"))
    new = spark.createDataFrame([("1", 30)], "v string, scan int").withColumn("last_updated", F.lit("2024-02-01").cast("timestamp"))
    assert sensors.newer_config(old, new).first()["scan"] == 30 and sensors.newer_config(old, old).first()["scan"] == 20


def test_durations(spark):
    for text in ("48h", "-48h", "30 days", "30d", "5m", "10s", "1 hour", "2w"):
        assert "INTERVAL" in str(filters.interval(text))
    for text in ("soon", "3 months", ""):
        with pytest.raises(ValueError):
            filters.interval(text)


def test_iso_parsing(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00+02:00", "2024-01-01", "2024", "01.01.2024", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [None if r[0] is None else str(r[0]) for r in df.select(s.parse_iso(F.col("t")).cast("string")).collect()]
    assert out == ["2024-01-01 00:00:00"] * 3 + [None] * 3


# --- invariants ----------------------------------------------------------------

def test_error_statistics_are_ordered(tables):
    keys = ["metric", "horizon_hours"]
    e = tables.forecast_errors
    joined = aggregates.mae(e, keys).join(aggregates.rmse(e, keys), keys).join(aggregates.bias(e, keys), keys)
    for r in joined.collect():
        assert r["rmse"] + 1e-9 >= r["mae"] >= abs(r["bias"]) - 1e-9


def test_window_counts_cover_the_input(tables):
    counted = aggregates.aggregate_window(tables.points, "1 hour", ["field"], [F.count("*").alias("n")])
    assert counted.agg(F.sum("n")).first()[0] == tables.points.count()


def test_zero_shift_is_a_plain_join(tables):
    forecast = align.hourly_means(tables.forecast_points, ["source"])
    shifted = align.align_shift(tables.actual_hourly, forecast, 0)
    assert shifted.count() == tables.actual_hourly.join(forecast, "ts").count()


def test_alignment_ramps(spark):
    """Ramps a constant apart give that constant error at every matched hour."""
    hours = spark.range(49).withColumn("ts", F.timestamp_seconds(F.col("id") * 3600))
    actual = hours.selectExpr("ts", "20 + 0.1D * id temperature", "1013 + 0.5D * id pressure", "50 + 0.2D * id humidity")
    forecast = hours.selectExpr("ts + interval 24 hours ts", "19.5 + 0.1D * id temperature", "1012 + 0.5D * id pressure",
                                "51 + 0.2D * id humidity")
    rows = align.forecast_errors(align.align_shift(actual, forecast, 24)).collect()
    assert len(rows) == 49
    for r in rows:
        assert (round(r["temp_signed_error"], 9), round(r["pressure_abs_error"], 9), round(r["humidity_signed_error"], 9)) == (-0.5, 1.0, 1.0)


def test_errors_need_one_metric(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "horizon_hours int, temperature_actual double, pressure_actual double")
    df = df.withColumns({"ts": F.current_timestamp(), "humidity_actual": F.lit(None).cast("double"), "temperature_forecast": F.lit(3.0),
                         "pressure_forecast": F.lit(1.0), "humidity_forecast": F.lit(1.0)})
    rows = align.forecast_errors(df).collect()
    assert [(r["horizon_hours"], r["temp_abs_error"], r["pressure_abs_error"]) for r in rows] == [(1, 2.0, None)]


def test_alert_hold_time(spark):
    mae = [4, 4, 4, 4, 4, 1, 6, 6, 6, 1, 1]
    df = spark.createDataFrame([(i, float(m)) for i, m in enumerate(mae)], "i int, temp_abs_error double").selectExpr(
        "timestamp '2024-01-01' + make_dt_interval(0, 0, i * 30) ts", "24 horizon_hours", "'p' source", "temp_abs_error"
    )
    spans = {(r["level"], r["windows"]) for r in windows.alert_intervals(df).collect()}
    assert spans == {("warning", 5), ("critical", 3), ("recovery", 2)}


def test_latest_rows_break_ties_by_id(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "mac string, event_id int, value double")
    df = df.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "field": F.lit("t")})
    assert windows.latest_per_sensor(df).first()["event_id"] == 2
    assert aggregates.last_value(df, ["mac"]).first()["value"] == 2.0
