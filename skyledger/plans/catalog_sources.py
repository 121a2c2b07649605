"""Registered queries: sources, sinks and binary decode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import files, forecast_json, frames, points
from .oracle import with_views
from .registry import query
from .views import HISTORY_RECORD_INTS, NOW, RANGE_START, RANGE_STOP, Tables, select_sql

POINT_COLUMNS = "event_id, mac, data_format, ts, measurement, field, value"


@query("a01_scan_points", with_views(
    "points",
    f"SELECT event_id, mac, ts, field, value FROM points WHERE measurement = 'environmental' AND data_format = 5 "
    f"AND ts >= timestamp '{RANGE_START}' AND ts < timestamp '{RANGE_STOP}'",
))
def _(t: Tables) -> DataFrame:
    found = points.scan_points(t.points, "environmental", RANGE_START, RANGE_STOP, {"data_format": 5})
    return found.select("event_id", "mac", "ts", "field", "value")


@query("a02_readings_to_points", with_views("points", f"SELECT {POINT_COLUMNS} FROM points"))
def _(t: Tables) -> DataFrame:
    return t.points


# Rows of the forecast documents as the provider would have sent them.
DOC_ROWS = (
    "SELECT *, source || '-' || block AS doc_id FROM (SELECT *, event_id // 100 AS block, "
    "row_number() OVER (PARTITION BY source, event_id // 100 ORDER BY event_id) - 1 AS pos, "
    "count(*) OVER (PARTITION BY source, event_id // 100) AS cnt FROM forecast_points)"
)
PARSED = (
    "SELECT doc_id, source, cast(pos AS INT) AS pos, ts, temperature, "
    "CASE WHEN block % 3 = 0 AND pos = cnt - 1 THEN NULL ELSE humidity END AS humidity, pressure, weather_code, "
    "source = 'provider_a' AS is_forecast FROM doc_rows WHERE NOT (block % 5 = 0 AND pos = 0)"
)


def _parsed(t: Tables) -> DataFrame:
    """Provider a sends forecasts, provider b sends history."""
    a, b = t.forecast_docs.filter("source = 'provider_a'"), t.forecast_docs.filter("source = 'provider_b'")
    parse = forecast_json.parse_forecast_json
    return parse(a, True).unionByName(parse(b, False))


@query("a03_forecast_to_points", with_views(
    "forecast_points",
    "SELECT data_type, cast(is_forecast AS VARCHAR) AS is_forecast, ts, field, value FROM ("
    + " UNION ALL ".join(
        f"SELECT data_type, is_forecast, ts, '{f}' AS field, cast({f} AS DOUBLE) AS value FROM parts WHERE {f} IS NOT NULL"
        for f in ("temperature", "humidity", "pressure", "weather_code")
    ) + ")",
    doc_rows=DOC_ROWS, parsed=PARSED,
    ranked="SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS up, "
    "row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS down FROM parsed",
    parts="SELECT *, CASE WHEN is_forecast THEN 'forecast' ELSE 'historical' END AS data_type FROM ranked "
    "UNION ALL SELECT *, 'current' FROM ranked WHERE down = 1 "
    "UNION ALL SELECT *, 'daily_forecast' FROM ranked WHERE up = 1",
))
def _(t: Tables) -> DataFrame:
    responses = forecast_json.as_response(_parsed(t), ["doc_id", "source"]).withColumns({
        "current": F.element_at("hourly", -1), "daily": F.slice("hourly", 1, 1),
        "retrieved_at": F.lit(NOW).cast("timestamp"),
    })
    return points.forecast_to_points(responses).select(
        "data_type", F.col("tags")["is_forecast"].alias("is_forecast"), "ts", "field", "value"
    )


@query("a04_errors_to_points", with_views(
    "forecast_errors",
    " UNION ALL ".join(
        "SELECT CASE WHEN horizon_hours = 6 THEN 'unknown' ELSE source END AS source, "
        "CASE WHEN horizon_hours = 48 THEN '0' ELSE cast(horizon_hours AS VARCHAR) END AS horizon, ts, "
        f"'{f}' AS field, {f} AS value, 'forecast_errors' AS measurement FROM forecast_errors "
        f"WHERE hour(ts) <> 3 AND {f} IS NOT NULL"
        for f in ("temp_abs_error", "temp_signed_error", "pressure_abs_error", "pressure_signed_error",
                  "humidity_abs_error", "humidity_signed_error")
    ),
), "value")
def _(t: Tables) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = t.forecast_errors.withColumns({
        "ts": F.when(F.hour("ts") == 3, F.lit("yesterday")).otherwise(iso),
        "source": F.when(F.col("horizon_hours") != 6, F.col("source")),
        "horizon_hours": F.when(F.col("horizon_hours") != 48, F.col("horizon_hours")),
    })
    return points.errors_to_points(text)


@query("a05_write_points", with_views(
    "points",
    "SELECT measurement, mac, data_format, field, date_trunc('second', ts) AS ts, value FROM twice QUALIFY "
    "row_number() OVER (PARTITION BY measurement, mac, data_format, field, date_trunc('second', ts) "
    "ORDER BY ts DESC, event_id DESC) = 1",
    twice="SELECT * FROM points UNION ALL SELECT * REPLACE (value + 1 AS value, event_id + 1000000000000 AS event_id) FROM points",
))
def _(t: Tables) -> DataFrame:
    again = t.points.withColumns({"value": F.col("value") + 1, "event_id": F.col("event_id") + 10**12})
    path = scratch_path(t.spark, "points")
    for _ in range(2):  # writing the same batch twice must leave the same table
        points.write_points(t.points.unionByName(again), path)
    stored = points.read_points(t.spark, path)
    return stored.select("measurement", "mac", "data_format", "field", "ts", "value")


_ERROR_FIELDS = ("temp_abs_error", "temp_signed_error", "pressure_abs_error", "pressure_signed_error", "humidity_abs_error",
                 "humidity_signed_error")


@query("a05_write_errors", with_views(
    "forecast_errors",
    " UNION ALL ".join(
        "SELECT 'forecast_errors' AS measurement, source, cast(horizon_hours AS VARCHAR) AS horizon, "
        f"'{f}' AS field, ts, {f} AS value FROM forecast_errors WHERE {f} IS NOT NULL" for f in _ERROR_FIELDS
    ),
), "value")
def _(t: Tables) -> DataFrame:
    """Error points in the same kind of table, half of them written twice."""
    path = scratch_path(t.spark, "error-points")
    stored = points.errors_to_points(t.forecast_errors).withColumn("run", F.lit(1))
    for part in (stored, stored.filter("cast(horizon AS INT) % 2 = 0")):
        points.upsert_points(part, path, points.ERROR_TAGS, "run")
    return points.read_points(t.spark, path).select("measurement", "source", "horizon", "field", "ts", "value")


@query("a07_export_json", with_views(
    "sensors",
    "SELECT 'record_count' AS item, count(*) AS n FROM events UNION ALL SELECT 'data_lines', count(*) FROM events UNION ALL "
    "SELECT 'sensor_lines', count(*) FROM sensors",
))
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "export")
    files.export_json(t.readings, t.sensors, path)
    out = t.spark.read.schema("record_count bigint").json(f"{path}/export_info").select(
        F.lit("record_count").alias("item"), F.col("record_count").alias("n")
    )
    for part, name in (("data", "data_lines"), ("sensors", "sensor_lines")):
        lines = t.spark.read.text(f"{path}/{part}").agg(F.count("*").alias("n"))
        out = out.unionByName(lines.withColumn("item", F.lit(name)))
    return out


@query("a08_export_csv", with_views("readings", "SELECT * FROM readings"))
def _(t: Tables) -> DataFrame:
    """Every column comes back as it went out."""
    path = scratch_path(t.spark, "csv")
    files.export_csv(t.readings, path)
    back = files.import_csv(t.spark, path, t.readings.columns)
    return back.select(*[F.col(c).cast(kind).alias(c) for c, kind in t.readings.dtypes])


@query("a09_export_line_protocol", with_views(
    "readings",
    "SELECT 'sensors,mac=' || mac || ' ' || concat_ws(',', 'temperature=' || temperature, 'humidity=' || humidity, "
    "'pressure=' || pressure, 'battery_voltage=' || battery_voltage, 'rssi=' || rssi) || ' ' || "
    "cast(epoch_us(ts) * 1000 AS VARCHAR) AS value FROM readings",
))
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "lines")
    files.export_line_protocol(t.readings, ["temperature", "humidity", "pressure", "battery_voltage", "rssi"], path)
    return t.spark.read.text(path)


def _import_columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_id").cast("long").alias("event_id"), "mac", "data_format", "ts", *files.IMPORT_NUMBERS)


IMPORTED = with_views(
    "readings",
    "SELECT event_id, mac, -1 AS data_format, ts, temperature, humidity, pressure, battery_voltage, rssi FROM readings",
)


@query("a10_import_json", IMPORTED)
def _(t: Tables) -> DataFrame:
    """Documents of both shapes, at most 500 records each (ids are unique)."""
    record = F.struct("event_id", "mac", F.date_format("ts", files.ISO_MICROS).alias("ts"), *files.IMPORT_NUMBERS)
    docs = t.readings.groupBy(F.expr("event_id div 500").alias("block")).agg(F.collect_list(record).alias("data"))
    text = F.when(F.col("block") % 2 == 0, F.to_json(F.struct("data"))).otherwise(F.to_json("data"))
    path = scratch_path(t.spark, "documents")
    docs.select(text.alias("value")).write.text(path)
    good, _ = files.validate_import(files.import_json(t.spark, path))
    return _import_columns(good)


@query("a11_import_csv", IMPORTED)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    columns = ["event_id", "mac", "ts", *files.IMPORT_NUMBERS]
    files.export_csv(t.readings.select(*columns), path)
    good, _ = files.validate_import(files.import_csv(t.spark, path, columns))
    return _import_columns(good)


def _faulty(t: Tables) -> DataFrame:
    """Readings as text with unreadable numbers, unreadable times and empty cells."""
    def text(c: str):
        return F.col(c).cast("string")

    e = F.col("event_id")
    return t.readings.select(
        text("event_id").alias("event_id"), "mac",
        F.when(e % 31 == 0, "31.12.2023").when(e % 37 == 0, "").otherwise(F.date_format("ts", files.ISO_MICROS)).alias("ts"),
        F.when(e % 41 == 0, "warm").otherwise(text("temperature")).alias("temperature"),
        F.when(e % 43 == 0, "").otherwise(text("humidity")).alias("humidity"),
        text("pressure").alias("pressure"), text("battery_voltage").alias("battery_voltage"),
        F.when(e % 47 == 0, "-40.5").otherwise(text("rssi")).alias("rssi"),
    )


@query("a12_import_good", with_views(
    "readings",
    "SELECT event_id, mac, -1 AS data_format, "
    f"CASE WHEN event_id % 37 = 0 THEN timestamp '{NOW}' ELSE ts END AS ts, temperature, "
    "CASE WHEN event_id % 43 <> 0 THEN humidity END AS humidity, pressure, battery_voltage, rssi "
    "FROM readings WHERE event_id % 31 <> 0 AND event_id % 41 <> 0 AND event_id % 47 <> 0",
))
def _(t: Tables) -> DataFrame:
    return _import_columns(files.validate_import(_faulty(t), F.lit(NOW).cast("timestamp"))[0])


@query("a12_import_rejects", with_views(
    "readings",
    "SELECT cast(event_id AS VARCHAR) AS event_id, concat_ws(',', CASE WHEN event_id % 41 = 0 THEN 'temperature' END, "
    "CASE WHEN event_id % 47 = 0 THEN 'rssi' END, CASE WHEN event_id % 31 = 0 THEN 'ts' END) AS problems "
    "FROM readings WHERE event_id % 31 = 0 OR event_id % 41 = 0 OR event_id % 47 = 0",
))
def _(t: Tables) -> DataFrame:
    return files.validate_import(_faulty(t))[1].select("event_id", "problems")


@query("a10_rejected_documents", with_views(
    "readings",
    "SELECT CASE WHEN event_id % 7 = 0 THEN 'not JSON' ELSE 'neither a record nor a list' END AS reason, count(*) AS n "
    "FROM readings WHERE event_id % 7 = 0 OR event_id % 11 = 0 GROUP BY 1",
))
def _(t: Tables) -> DataFrame:
    """One document per reading, some cut off and some a bare number; the others must all arrive."""
    path = scratch_path(t.spark, "documents")
    doc = F.to_json(F.struct("event_id", "mac", "temperature"))
    text = F.when(F.col("event_id") % 7 == 0, F.expr("substring(to_json(struct(event_id, mac)), 1, 12)")).when(
        F.col("event_id") % 11 == 0, F.col("event_id").cast("string")).otherwise(doc)
    t.readings.select(text.alias("value")).write.text(path)
    arrived = files.import_json(t.spark, path, ["event_id", "mac", "temperature"]).count()
    rejected = files.rejected_json(t.spark, path)
    if arrived + rejected.count() != t.readings.count():
        raise RuntimeError("documents were lost")
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


@query("a13_read_annotated_csv", with_views(
    "points", "SELECT mac, measurement, field, ts, value FROM points"
))
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "annotated")
    files.write_annotated_csv(t.points, path, RANGE_START, RANGE_STOP)
    return files.read_annotated_csv(t.spark, path).select(
        "mac", F.col("_measurement").alias("measurement"), F.col("_field").alias("field"),
        F.col("_time").cast("timestamp").alias("ts"), F.col("_value").cast("double").alias("value"),
    )


PARSED_COLUMNS = "doc_id, pos, ts, temperature, humidity, pressure, weather_code, is_forecast"


def _parsed_query(source: str) -> str:
    return with_views("forecast_points", f"SELECT {PARSED_COLUMNS} FROM parsed WHERE source = '{source}'",
                      doc_rows=DOC_ROWS, parsed=PARSED)


@query("a14_parse_forecast_json", _parsed_query("provider_a"))
def _(t: Tables) -> DataFrame:
    docs = t.forecast_docs.filter("source = 'provider_a'")
    return forecast_json.parse_forecast_json(docs, True).select(*PARSED_COLUMNS.split(", "))


@query("a15_parse_current_json", with_views(
    "forecast_points",
    "SELECT doc_id, ts, temperature, 3.5e0 AS wind_speed, 180.0e0 AS wind_direction, weather_code, "
    "cast(NULL AS DOUBLE) AS humidity FROM doc_rows WHERE pos = cnt - 1",
    doc_rows=DOC_ROWS,
))
def _(t: Tables) -> DataFrame:
    return forecast_json.parse_current_json(t.forecast_docs).select(
        "doc_id", "ts", "temperature", "wind_speed", "wind_direction", "weather_code", "humidity"
    )


@query("a16_parse_historical_json", _parsed_query("provider_b"))
def _(t: Tables) -> DataFrame:
    docs = t.forecast_docs.filter("source = 'provider_b'")
    return forecast_json.parse_forecast_json(docs, False).select(*PARSED_COLUMNS.split(", "))


@query("a17_sensor_metadata", with_views("sensors", "SELECT * FROM sensors"))
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "sensors")
    files.export_sensors(t.sensors, path)
    return files.load_sensors(t.spark, path).select(*t.sensors.columns)


@query("a18_apply_retention", with_views(
    "points", f"SELECT {POINT_COLUMNS} FROM points WHERE ts >= timestamp '{NOW}' - interval '10' day"
))
def _(t: Tables) -> DataFrame:
    return points.apply_retention(t.points, 10, NOW)


@query("a18_delete_expired", with_views(
    "points",
    "SELECT measurement, mac, data_format, field, date_trunc('second', ts) AS ts, value FROM points "
    f"WHERE date_trunc('second', ts) >= timestamp '{NOW}' - interval '10' day - interval '5' hour QUALIFY "
    "row_number() OVER (PARTITION BY measurement, mac, data_format, field, date_trunc('second', ts) ORDER BY event_id DESC) = 1",
))
def _(t: Tables) -> DataFrame:
    """A stored table after retention, the edge inside a day."""
    path = scratch_path(t.spark, "retention")
    points.write_points(t.points, path)
    edge = t.spark.range(1).select(F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 5 HOURS")).first()[0]
    points.delete_expired(t.spark, path, 10, edge)
    return points.read_points(t.spark, path).select("measurement", "mac", "data_format", "field", "ts", "value")


# --- binary decode -------------------------------------------------------------

def _signed(c: str, wide: int = 16) -> str:
    return f"CASE WHEN {c} >= {1 << (wide - 1)} THEN {c} - {1 << wide} ELSE {c} END"


_ACC = ", ".join(f"({_signed(f'{a}_raw')}) / 1000.0e0 AS acceleration_{a}" for a in "xyz")
_POWER = "((w_raw >> 5) + 1600) / 1000.0e0 AS battery_voltage, cast((w_raw & 31) * 2 - 40 AS INT) AS tx_power"
_OK = "NOT other AND kept_bytes = 24"

_F3 = (
    "SELECT frame_id, address, rssi, received_at, 3 AS data_format, (h_raw % 256) / 2.0e0 AS humidity, "
    f"({_signed('(t_raw % 256)', 8)}) + ((t_raw >> 8) % 100) / 100.0e0 AS temperature, "
    f"(p_raw + 50000) / 100.0e0 AS pressure, {_ACC}, w_raw / 1000.0e0 AS battery_voltage, "
    "cast(NULL AS INT) AS tx_power, cast(NULL AS INT) AS movement_counter, cast(NULL AS INT) AS measurement_sequence, "
    f"cast(NULL AS VARCHAR) AS mac FROM frame_ints WHERE fmt = 3 AND {_OK}"
)
_F5 = (
    f"SELECT frame_id, address, rssi, received_at, 5 AS data_format, h_raw * 0.0025e0 AS humidity, "
    f"({_signed('t_raw')}) * 0.005e0 AS temperature, (p_raw + 50000) / 100.0e0 AS pressure, {_ACC}, {_POWER}, "
    "cast(move AS INT) AS movement_counter, cast(seq AS INT) AS measurement_sequence, "
    "concat_ws(':', " + ", ".join(f"substr(lpad(hex(mac_raw), 12, '0'), {i}, 2)" for i in (1, 3, 5, 7, 9, 11))
    + f") AS mac FROM frame_ints WHERE fmt = 5 AND {_OK}"
)
_DECODED = ["frame_id", "data_format", *frames.READING_FIELDS]


@query("b01_route_frames", with_views(
    "frame_ints",
    "SELECT route, count(*) AS frames FROM (SELECT CASE WHEN other THEN 'other_manufacturer' WHEN kept_bytes = 0 THEN "
    "'empty' WHEN fmt = 99 THEN 'unknown_format' WHEN kept_bytes = 10 THEN 'short_frame' ELSE 'decoded' END AS route "
    "FROM frame_ints) GROUP BY route",
))
def _(t: Tables) -> DataFrame:
    return frames.route_counts(t.frames)


@query("b02_decode_f3", with_views("frame_ints", f"SELECT {', '.join(_DECODED)} FROM ({_F3})"))
def _(t: Tables) -> DataFrame:
    return frames.decode_f3(t.frames).select(*_DECODED)


@query("b03_decode_f5", with_views("frame_ints", f"SELECT {', '.join(_DECODED)} FROM ({_F5})"))
def _(t: Tables) -> DataFrame:
    return frames.decode_f5(t.frames).select(*_DECODED)


@query("b04_attach_envelope", with_views(
    "frame_ints",
    f"SELECT frame_id AS event_id, upper(address) AS mac, received_at AS ts, rssi, {', '.join(_DECODED[1:-1])} "
    f"FROM ({_F3} UNION ALL BY NAME {_F5})",
))
def _(t: Tables) -> DataFrame:
    return frames.frames_to_readings(t.frames)


_HISTORY = ", ".join(select_sql(HISTORY_RECORD_INTS))
_RECORDS = "SELECT *, unnest(range(cast(l_linenumber AS BIGINT))) AS k FROM lineitem"


@query("b05_decode_history", with_views(
    "",
    "SELECT l_orderkey, l_linenumber, l_partkey, cast(k AS INT) AS record_no, "
    "timestamp '1970-01-01' + (1700000000 + l_suppkey + offset_s) * interval '1' second AS ts, "
    f"({_signed('t_raw')}) * 0.005e0 AS temperature, h_raw * 0.0025e0 AS humidity, "
    f"(p_raw + 50000) / 100.0e0 AS pressure, {_ACC}, {_POWER}, cast(move AS INT) AS movement_counter, "
    "cast(seq AS INT) AS measurement_sequence FROM ints",
    records=_RECORDS, ints=f"SELECT *, {_HISTORY} FROM records",
))
def _(t: Tables) -> DataFrame:
    decoded = frames.decode_history(frames.split_records(t.history_blobs))
    return decoded.drop("record", "base_seconds", "data_format")


@query("b06_split_records", with_views(
    "", "SELECT l_orderkey, l_linenumber, l_partkey, cast(k AS INT) AS record_no, 24 AS bytes FROM records", records=_RECORDS
))
def _(t: Tables) -> DataFrame:
    return frames.split_records(t.history_blobs).select(
        "l_orderkey", "l_linenumber", "l_partkey", "record_no", F.length("record").alias("bytes")
    )


_RECEIVED = "SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY transfer_id, chunk_id ORDER BY tie) = 1"


@query("b07_reassemble", with_views(
    "chunks",
    "SELECT transfer_id, max(total) AS total, string_agg(payload, '' ORDER BY chunk_id) AS payload FROM received "
    "GROUP BY transfer_id HAVING count(*) >= max(total)",
    received=_RECEIVED,
))
def _(t: Tables) -> DataFrame:
    return frames.reassemble(t.chunks).withColumn("payload", F.hex("payload"))


@query("b07_rejected_chunks", with_views(
    "chunks",
    "SELECT transfer_id, CASE WHEN wide < 0 THEN 'negative id' ELSE 'id too large' END AS reason, count(*) AS n FROM "
    "(SELECT *, chunk_id * 20000 - 30000 AS wide FROM chunks) WHERE wide < 0 OR wide > 65535 GROUP BY ALL",
))
def _(t: Tables) -> DataFrame:
    return frames.rejected_chunks(t.chunks.withColumn("chunk_id", F.expr("chunk_id * 20000 - 30000")))


@query("b08_transfer_progress", with_views(
    "chunks",
    "SELECT transfer_id, count(*) AS received_chunks, max(total) AS total_chunks, count(*) * 100.0e0 / max(total) AS "
    "progress_percent, count(*) >= max(total) AS is_complete FROM received GROUP BY transfer_id",
    received=_RECEIVED,
), "progress_percent")
def _(t: Tables) -> DataFrame:
    return frames.transfer_progress(t.chunks)


@query("b09_decode_capabilities", (
    "SELECT c_custkey, c_custkey % 10 <> 0 AND c_custkey % 2 = 1 AS supports_history, "
    "cast(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE (c_custkey * 7) % 65536 END AS INT) AS max_records, "
    "cast(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE (c_custkey * 3) % 65536 END AS INT) AS interval_seconds, "
    "CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'v' || (c_custkey % 9) END AS firmware_version, "
    "CASE WHEN c_custkey % 10 = 0 OR c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS hardware_version FROM customer"
))
def _(t: Tables) -> DataFrame:
    def le(expr: str) -> str:
        return f"lpad(hex(({expr}) & 255), 2, '0'), lpad(hex(shiftright({expr}, 8) & 255), 2, '0')"

    hw = "hex(encode(c_mktsegment, 'UTF-8'))"
    body = (
        f"concat(lpad(hex(c_custkey % 2), 2, '0'), {le('(c_custkey * 7) % 65536')}, {le('(c_custkey * 3) % 65536')}, "
        f"'000000', hex(encode(concat('v', c_custkey % 9), 'UTF-8')), '00', {hw}, "
        "case when c_custkey % 7 = 0 then '' else '00' end)"
    )
    records = t.raw("customer").selectExpr(
        "c_custkey", f"unhex(case when c_custkey % 10 = 0 then '0102' else {body} end) AS payload"
    )
    return frames.decode_capabilities(records).drop("payload")
