"""Registered queries: filters, aggregates, joins, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import aggregates as agg
from ..operators import align, filters, sensors, windows
from ..schemas import RANGE_SPEC, RANGE_SPEC_WIDE
from ..sources.points import with_reading_tags
from .oracle import with_views
from .registry import query
from .views import HORIZONS, NOW, RANGE_START, RANGE_STOP, Tables

N = f"timestamp '{NOW}'"
ERROR_COLUMNS = (
    "ts, horizon_hours, source, temp_abs_error, temp_signed_error, pressure_abs_error, pressure_signed_error, "
    "humidity_abs_error, humidity_signed_error"
)
ERROR_VALUES = ERROR_COLUMNS.replace("ts, horizon_hours, source, ", "").replace(",", "")
BASE = "event_id, mac, data_format, ts, measurement, field, value"


# --- filters and projections -----------------------------------------------

@query("c01_time_range", with_views(
    "points", f"SELECT {BASE} FROM points WHERE ts >= timestamp '2024-01-05' AND ts < timestamp '2024-01-20'"
))
def _(t: Tables) -> DataFrame:
    return filters.time_range(t.points, "2024-01-05", "2024-01-20")


@query("c02_relative_range", with_views(
    "points", f"SELECT {BASE}, '48h' AS span FROM points WHERE ts >= {N} - interval '48' hour AND ts < {N} "
    f"UNION ALL SELECT {BASE}, '30 days' FROM points WHERE ts >= {N} - interval '30' day AND ts < {N}"
))
def _(t: Tables) -> DataFrame:
    spans = [filters.last(t.points, d, NOW).withColumn("span", F.lit(d)) for d in ("48h", "30 days")]
    return spans[0].unionByName(spans[1])


@query("c03_measurement_like", with_views(
    "points", f"SELECT {BASE} FROM points WHERE regexp_matches(measurement, '^(env|pow)')"
))
def _(t: Tables) -> DataFrame:
    return filters.measurement_like(t.points, "^(env|pow)")


@query("c04_fields_in", with_views(
    "points", f"SELECT {BASE} FROM points WHERE field IN ('temperature', 'pressure', 'humidity')"
))
def _(t: Tables) -> DataFrame:
    return filters.fields_in(t.points, ["temperature", "pressure", "humidity"])


@query("c05_errors_query", with_views(
    "forecast_errors", f"SELECT {ERROR_COLUMNS} FROM forecast_errors WHERE ts >= timestamp '{RANGE_START}' "
    f"AND ts < timestamp '{RANGE_STOP}' AND horizon_hours = 24 AND source = 'provider_b'"
), ERROR_VALUES)
def _(t: Tables) -> DataFrame:
    return filters.errors_query(t.forecast_errors, RANGE_START, RANGE_STOP, 24, "provider_b")


@query("c06_tag_in", with_views(
    "forecast_errors",
    f"SELECT {ERROR_COLUMNS} FROM forecast_errors WHERE horizon_hours IN (6, 24) AND source IN ('provider_a', 'provider_b')",
), ERROR_VALUES)
def _(t: Tables) -> DataFrame:
    return filters.tag_in(
        filters.tag_in(t.forecast_errors, "horizon_hours", [6, 24]), "source", ["provider_a", "provider_b"]
    )


@query("c07_keep", with_views("forecast_errors", "SELECT ts, temp_signed_error FROM forecast_errors"), "temp_signed_error")
def _(t: Tables) -> DataFrame:
    return filters.keep(t.forecast_errors, ["ts", "temp_signed_error"])


@query("c08_tag_values", with_views("forecast_errors", "SELECT DISTINCT horizon_hours FROM forecast_errors"))
def _(t: Tables) -> DataFrame:
    return filters.tag_values(t.forecast_errors, "horizon_hours")


@query("c09_schema_keys", with_views(
    "points", "SELECT DISTINCT 'field' AS kind, field AS key FROM points UNION ALL "
    "SELECT 'tag', unnest(['sensor_mac', 'data_format'])"
))
def _(t: Tables) -> DataFrame:
    return filters.schema_keys(with_reading_tags(t.points))


@query("c10_pivot_fields", with_views(
    "points",
    "SELECT mac, ts, any_value(CASE WHEN field = 'temperature' THEN value END) AS temperature, "
    "any_value(CASE WHEN field = 'humidity' THEN value END) AS humidity, "
    "any_value(CASE WHEN field = 'pressure' THEN value END) AS pressure FROM points "
    "WHERE field IN ('temperature', 'humidity', 'pressure') GROUP BY mac, ts",
))
def _(t: Tables) -> DataFrame:
    return filters.pivot_fields(t.points, ["mac", "ts"], ["temperature", "humidity", "pressure"])


@query("c11_analysis_frame", with_views(
    "env_wide", "SELECT ts, temperature, humidity, pressure FROM env_wide WHERE "
    "coalesce(temperature, humidity, pressure) IS NOT NULL"
))
def _(t: Tables) -> DataFrame:
    return filters.analysis_frame(t.env_wide, ["temperature", "humidity", "pressure", "dew_point"])


@query("c12_complete_rows", with_views(
    "env_wide", "SELECT * FROM env_wide WHERE temperature IS NOT NULL AND humidity IS NOT NULL AND pressure IS NOT NULL"
))
def _(t: Tables) -> DataFrame:
    return filters.complete_rows(t.env_wide, ["temperature", "humidity", "pressure"])


def _issue_sql(spec: dict) -> str:
    tests = ", ".join(f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{c}' END" for c, (lo, hi) in spec.items())
    return f"coalesce(concat_ws(',', {tests}), '')"


def _issues(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.array_join("issues", ",").alias("issues"), "passed")


@query("c13_range_issues", with_views(
    "readings", f"SELECT event_id, {_issue_sql(RANGE_SPEC)} AS issues, {_issue_sql(RANGE_SPEC)} = '' AS passed FROM readings"
))
def _(t: Tables) -> DataFrame:
    return _issues(filters.range_issues(t.readings))


@query("c13_range_issues_wide", with_views(
    "readings",
    f"SELECT event_id, {_issue_sql(RANGE_SPEC_WIDE)} AS issues, {_issue_sql(RANGE_SPEC_WIDE)} = '' AS passed FROM readings",
))
def _(t: Tables) -> DataFrame:
    return _issues(filters.range_issues(t.readings, RANGE_SPEC_WIDE))


@query("c14_consistency_issues", with_views(
    "readings",
    "SELECT event_id, issues, issues = '' AS passed FROM (SELECT event_id, concat_ws(',', "
    "CASE WHEN data_format = 5 AND tx_power IS NULL THEN 'missing_tx_power' END, "
    "CASE WHEN data_format = 5 AND movement_counter IS NULL THEN 'missing_movement_counter' END, "
    "CASE WHEN data_format = 5 AND measurement_sequence IS NULL THEN 'missing_measurement_sequence' END, "
    "CASE WHEN epoch_us(timestamp '2024-01-15 00:00:00') - epoch_us(ts) > 3600000000 THEN 'too_old' END, "
    "CASE WHEN epoch_us(timestamp '2024-01-15 00:00:00') - epoch_us(ts) < -60000000 THEN 'in_future' END) AS issues "
    "FROM faulty)",
    faulty="SELECT * REPLACE (CASE WHEN event_id % 3 <> 0 THEN tx_power END AS tx_power) FROM readings",
))
def _(t: Tables) -> DataFrame:
    faulty = t.readings.withColumn("tx_power", F.when(F.col("event_id") % 3 != 0, F.col("tx_power")))
    return _issues(filters.consistency_issues(faulty, "2024-01-15 00:00:00"))


BUCKET = "time_bucket(interval '1 hour', ts) + interval '1 hour'"


@query("c15_scatter_xy", with_views(
    "points",
    f"SELECT mac, {BUCKET} AS ts, avg(CASE WHEN field = 'temperature' THEN value END) AS x, "
    "avg(CASE WHEN field = 'humidity' THEN value END) AS y FROM points WHERE field IN ('temperature', 'humidity') GROUP BY ALL",
), "x y")
def _(t: Tables) -> DataFrame:
    two = filters.fields_in(t.points, ["temperature", "humidity"])
    hourly = agg.aggregate_window(two, "1 hour", ["mac", "field"], [F.avg("value").alias("value")])
    wide = filters.pivot_fields(hourly, ["mac", "ts"], ["temperature", "humidity"])
    return wide.select("mac", "ts", F.col("temperature").alias("x"), F.col("humidity").alias("y"))


@query("c16_validate_sensors", with_views(
    "sensors",
    "SELECT mac, issues, issues = '' AS valid FROM (SELECT mac, concat_ws(',', CASE WHEN length(trim(name)) < 1 THEN 'name' END, "
    "CASE WHEN battery_level < 0 OR battery_level > 100 THEN 'battery_level' END, "
    "CASE WHEN NOT regexp_full_match(mac, '([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}') THEN 'mac' END) AS issues FROM faulty)",
    faulty="SELECT CASE WHEN location = 'BUILDING' THEN 'AA-BB' ELSE mac END AS mac, "
    "CASE WHEN enabled THEN name ELSE '  ' END AS name, battery_level FROM sensors",
))
def _(t: Tables) -> DataFrame:
    faulty = t.sensors.withColumns({
        "mac": F.when(F.col("location") == "BUILDING", "AA-BB").otherwise(F.col("mac")),
        "name": F.when(F.col("enabled"), F.col("name")).otherwise("  "),
    })
    return filters.validate_sensors(faulty).select("mac", F.array_join("issues", ",").alias("issues"), "valid")


# --- aggregates ------------------------------------------------------------

for _every, _sql in (("1 minute", "1 minute"), ("5 minutes", "5 minutes"), ("1 hour", "1 hour"), ("6 hours", "6 hours"), ("1 day", "1 day")):
    def _window(t: Tables, every: str = _every) -> DataFrame:
        return agg.aggregate_window(t.points, every, ["mac", "field"], [F.avg("value").alias("mean")])

    query(f"d01_aggregate_window_{_every.replace(' ', '')}", with_views(
        "points",
        f"SELECT mac, field, time_bucket(interval '{_sql}', ts, timestamp '1970-01-01') + interval '{_sql}' AS ts, "
        "avg(value) AS mean FROM points GROUP BY ALL",
    ), "mean")(_window)


@query("d02_aggregate_window_empty", with_views(
    "points",
    "SELECT s.mac, s.ts, h.mean FROM spine s LEFT JOIN hourly h ON h.mac = s.mac AND h.ts = s.ts",
    hourly="SELECT mac, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') + interval '6 hours' AS ts, avg(value) AS mean "
    "FROM points WHERE field = 'temperature' GROUP BY ALL",
    spine=f"SELECT mac, unnest(generate_series(timestamp '{RANGE_START}' + interval '6 hours', timestamp '{RANGE_STOP}', "
    "interval '6 hours')) AS ts FROM (SELECT DISTINCT mac FROM hourly)",
), "mean")
def _(t: Tables) -> DataFrame:
    return agg.aggregate_window(
        t.points.filter("field = 'temperature'"), "6 hours", ["mac"], [F.avg("value").alias("mean")],
        create_empty=True, start=RANGE_START, stop=RANGE_STOP,
    )


@query("d03_by_hour", with_views(
    "points", "SELECT cast(hour(ts) AS VARCHAR) AS hour, avg(value) AS mean FROM points WHERE field = 'temperature' GROUP BY ALL"
), "mean")
def _(t: Tables) -> DataFrame:
    return agg.by_hour(t.points, "temperature")


@query("d04_by_weekday", with_views(
    "points", "SELECT cast(dayofweek(ts) AS VARCHAR) AS weekday, avg(value) AS mean FROM points WHERE field = 'humidity' GROUP BY ALL"
), "mean")
def _(t: Tables) -> DataFrame:
    return agg.by_weekday(t.points, "humidity")


@query("d05_range_mean", with_views(
    "forecast_errors", "SELECT horizon_hours, source, avg(temp_abs_error) AS mean FROM forecast_errors GROUP BY ALL"
), "mean")
def _(t: Tables) -> DataFrame:
    return agg.range_mean(t.forecast_errors, ["horizon_hours", "source"], "temp_abs_error")


@query("d06_ingest_summary", with_views(
    "points",
    "SELECT count(*) AS total_points, count(DISTINCT mac) AS unique_sensors, count(*) / (30 * 86400.0e0) AS points_per_second "
    f"FROM points WHERE ts >= timestamp '{RANGE_START}' AND ts < timestamp '{RANGE_STOP}'",
), "points_per_second")
def _(t: Tables) -> DataFrame:
    return agg.ingest_summary(t.points, RANGE_START, RANGE_STOP)


@query("d07_count_by", with_views("points", "SELECT measurement, count(*) AS n FROM points GROUP BY measurement"))
def _(t: Tables) -> DataFrame:
    return agg.count_by(t.points, "measurement")


@query("d08_catalog_summary", with_views(
    "points",
    "SELECT measurement, field, count(*) AS n, count(DISTINCT mac) AS sensors, max(ts) AS latest, "
    "grouping(measurement, field) AS level FROM points GROUP BY ROLLUP (measurement, field)",
))
def _(t: Tables) -> DataFrame:
    return agg.catalog_summary(t.points)


@query("d09_points_per_minute", with_views(
    "points",
    "SELECT mac, count(*) / 5.0e0 AS per_minute FROM points WHERE ts >= timestamp '2024-01-15 12:00:00' - interval '5' minute "
    "AND ts < timestamp '2024-01-15 12:00:00' GROUP BY mac",
))
def _(t: Tables) -> DataFrame:
    return agg.points_per_minute(t.points, "5m", "2024-01-15 12:00:00")


_LATEST = "row_number() OVER (PARTITION BY mac, field ORDER BY ts DESC, event_id DESC) = 1"


@query("d10_last_value", with_views("points", f"SELECT mac, field, ts, value FROM points QUALIFY {_LATEST}"))
def _(t: Tables) -> DataFrame:
    return agg.last_value(t.points, ["mac", "field"])


@query("d11_latest_wide", with_views(
    "points",
    "SELECT mac, max(CASE WHEN field = 'temperature' THEN value END) AS temperature, max(CASE WHEN field = 'battery_voltage' "
    "THEN value END) AS battery_voltage, max(CASE WHEN field = 'rssi' THEN value END) AS rssi, max(ts) AS last_ts FROM "
    f"(SELECT * FROM points WHERE field IN ('temperature', 'battery_voltage', 'rssi') QUALIFY {_LATEST}) GROUP BY mac",
))
def _(t: Tables) -> DataFrame:
    return agg.latest_wide(t.points, ["temperature", "battery_voltage", "rssi"])


_STATS = {
    "d12_mae": ("avg(absolute_error) AS mae", "mae", agg.mae),
    "d13_rmse": ("sqrt(avg(signed_error * signed_error)) AS rmse", "rmse", agg.rmse),
    "d14_bias": ("avg(signed_error) AS bias, CASE WHEN avg(signed_error) > 0 THEN 'over-prediction' ELSE 'under-prediction' "
                 "END AS direction", "bias", agg.bias),
    "d15_error_stddev": ("stddev_samp(signed_error) AS stddev", "stddev", agg.error_stddev),
}
for _name, (_sql, _column, _op) in _STATS.items():
    def _stat(t: Tables, op=_op) -> DataFrame:
        return op(t.forecast_errors, ["metric", "horizon_hours"])

    query(_name, with_views("errors_long", f"SELECT metric, horizon_hours, {_sql} FROM errors_long GROUP BY metric, horizon_hours"),
          _column)(_stat)


@query("d16_horizon_report", with_views(
    "forecast_errors",
    "SELECT horizon_hours, count(*) AS records, avg(temp_abs_error) AS temp_mae, max(temp_abs_error) AS temp_max_error, "
    "avg(temp_signed_error) AS temp_bias, avg(pressure_abs_error) AS pressure_mae, avg(humidity_abs_error) AS humidity_mae, "
    "CASE WHEN avg(temp_signed_error) > 0 THEN 'over-prediction' ELSE 'under-prediction' END AS direction "
    "FROM forecast_errors GROUP BY horizon_hours",
), "temp_mae temp_max_error temp_bias pressure_mae humidity_mae")
def _(t: Tables) -> DataFrame:
    return agg.horizon_report(t.forecast_errors)


_SERIES = {"mae": "avg(absolute_error)", "rmse": "sqrt(avg(signed_error * signed_error))", "bias": "avg(signed_error)"}
for _stat_name, _every in (("mae", "1 hour"), ("rmse", "6 hours"), ("bias", "1 day")):
    def _series(t: Tables, every: str = _every, stat: str = _stat_name) -> DataFrame:
        return agg.error_series(t.forecast_errors, every, stat)

    query(f"d17_error_series_{_stat_name}", with_views(
        "errors_long",
        f"SELECT metric, horizon_hours, time_bucket(interval '{_every}', ts, timestamp '1970-01-01') + interval '{_every}' AS ts, "
        f"{_SERIES[_stat_name]} AS {_stat_name} FROM errors_long GROUP BY ALL",
    ), _stat_name)(_series)


@query("d18_error_histogram", with_views(
    "forecast_errors",
    "SELECT floor(round(temp_signed_error, 9) / 0.5e0) * 0.5e0 AS bucket, count(*) AS n FROM forecast_errors "
    "WHERE temp_signed_error IS NOT NULL GROUP BY ALL",
))
def _(t: Tables) -> DataFrame:
    # means differ in their last bits between engines; nine digits settle the bucket
    settled = t.forecast_errors.withColumn("temp_signed_error", F.round("temp_signed_error", 9))
    return agg.error_histogram(settled)


@query("d18_error_overlay", with_views(
    "forecast_errors",
    "SELECT avg(temp_signed_error) AS mean, quantile_cont(temp_signed_error, 0.5) AS median, "
    "stddev_samp(temp_signed_error) AS stddev FROM forecast_errors",
), "mean median stddev")
def _(t: Tables) -> DataFrame:
    return agg.error_overlay(t.forecast_errors)


ENV = ["temperature", "humidity", "pressure"]


@query("d19_describe", with_views("env_wide", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, "
    f"max({c}) AS max, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75 "
    "FROM env_wide" for c in ENV
)), "mean std min max p25 p50 p75")
def _(t: Tables) -> DataFrame:
    return agg.describe(t.env_wide, ENV)


@query("d20_completeness", with_views("env_wide", " UNION ALL ".join(
    f"SELECT count(*) AS rows, '{c}' AS \"column\", count(*) - count({c}) AS missing, "
    f"(count(*) - count({c})) * 100.0e0 / count(*) AS missing_percent FROM env_wide" for c in ENV
)), "missing_percent")
def _(t: Tables) -> DataFrame:
    return agg.completeness(t.env_wide, ENV)


@query("d21_perf_summary", with_views(
    "op_metrics",
    "SELECT metric, count(*) AS total, count(*) FILTER (success) AS successful, coalesce(avg(duration) FILTER (success), 0) AS "
    "avg_duration, coalesce(avg(points) FILTER (success), 0) AS avg_devices, cast(sum(points) AS BIGINT) AS total_points "
    "FROM op_metrics GROUP BY metric",
), "avg_duration avg_devices")
def _(t: Tables) -> DataFrame:
    return agg.perf_summary(t.op_metrics)


@query("d22_write_stats", with_views(
    "op_metrics",
    "SELECT metric, cast(coalesce(sum(points) FILTER (success), 0) AS BIGINT) AS points_written, "
    "cast(coalesce(sum(points) FILTER (NOT success), 0) AS BIGINT) AS points_failed, count(*) FILTER (success) AS batches_sent, "
    "count(*) FILTER (NOT success) AS batches_failed, max(ts) FILTER (success) AS last_write, "
    "coalesce(sum(duration) FILTER (success), 0) AS total_write_time, coalesce(avg(duration) FILTER (success), 0) AS avg_write_time "
    "FROM op_metrics GROUP BY metric",
), "total_write_time avg_write_time")
def _(t: Tables) -> DataFrame:
    return agg.write_stats(t.op_metrics)


@query("d23_error_runs", with_views(
    "op_metrics",
    "SELECT metric, cast(sum(length) AS BIGINT) AS errors, max(length) AS longest_run, max(length) >= 10 AS fatal FROM "
    "(SELECT metric, run, count(*) FILTER (NOT success) AS length FROM numbered GROUP BY metric, run) GROUP BY metric",
    numbered="SELECT *, count(*) FILTER (success) OVER (PARTITION BY metric ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM op_metrics",
))
def _(t: Tables) -> DataFrame:
    return agg.error_runs(t.op_metrics)


@query("d24_status_rollup", with_views(
    "op_metrics",
    "SELECT count(*) AS total, count(*) FILTER (share <= 0.1) AS passed, count(*) FILTER (share > 0.1 AND share <= 0.2) AS warning, "
    "count(*) FILTER (share > 0.2) AS failed, CASE WHEN max(share) > 0.2 THEN 'failed' WHEN max(share) > 0.1 THEN 'warning' "
    "ELSE 'passed' END AS overall_status FROM (SELECT avg(CASE WHEN success THEN 0.0e0 ELSE 1.0e0 END) AS share FROM op_metrics "
    "GROUP BY metric, date_trunc('hour', ts))",
))
def _(t: Tables) -> DataFrame:
    return agg.status_rollup(agg.metric_checks(t.op_metrics))


@query("d25_recent_activity", with_views(
    "points",
    "SELECT count(*) AS recent, CASE WHEN count(*) > 0 THEN 'OK' ELSE 'WARNING' END AS state FROM points "
    "WHERE ts >= timestamp '2024-01-20 12:00:00' - interval '10' minute AND ts < timestamp '2024-01-20 12:00:00'",
))
def _(t: Tables) -> DataFrame:
    return agg.recent_activity(t.points, "2024-01-20 12:00:00")


@query("d27_itemset_counts", with_views(
    "binned",
    "SELECT temperature_binned, humidity_binned, pressure_binned, count(*) AS n, "
    "grouping(temperature_binned, humidity_binned, pressure_binned) AS level FROM binned "
    "GROUP BY CUBE (temperature_binned, humidity_binned, pressure_binned)",
))
def _(t: Tables) -> DataFrame:
    from ..operators.mining import discretize

    return agg.itemset_counts(discretize(t.env_wide, ENV), [f"{c}_binned" for c in ENV])


# --- joins -----------------------------------------------------------------

def _aligned_sql(select: str, condition: str) -> str:
    cols = ", ".join(f"a.{c} AS {c}_actual, f.{c} AS {c}_forecast" for c in ("temperature", "pressure", "humidity"))
    return f"SELECT {select}, {cols} FROM {condition}"


ALIGNED = "temperature_actual temperature_forecast pressure_actual pressure_forecast humidity_actual humidity_forecast"
_FORECAST_BY_SOURCE = (
    "SELECT time_bucket(interval '1 hour', ts) + interval '1 hour' AS ts, source, avg(temperature) AS temperature, "
    "avg(pressure) AS pressure, avg(humidity) AS humidity FROM forecast_points WHERE data_type = 'forecast' GROUP BY ALL"
)


def _by_source(t: Tables) -> DataFrame:
    return align.hourly_means(t.forecast_points.filter("data_type = 'forecast'"), ["source"])


@query("e01_align_shift", with_views(
    "actual_hourly forecast_points",
    _aligned_sql("a.ts, 24 AS horizon_hours, f.source", "actual_hourly a JOIN by_source f ON f.ts - interval '24' hour = a.ts"),
    by_source=_FORECAST_BY_SOURCE,
), ALIGNED)
def _(t: Tables) -> DataFrame:
    return align.align_shift(t.actual_hourly, _by_source(t), 24)


@query("e02_align_run", with_views(
    "actual_hourly forecast_points",
    _aligned_sql("a.ts, f.event_id, f.horizon_hours, f.source, f.run_time, f.data_type",
                 "actual_hourly a JOIN (SELECT * REPLACE (ts + interval '1 hour' AS ts) FROM forecast_points "
                 "WHERE data_type = 'forecast') f ON f.ts = a.ts"),
), ALIGNED)
def _(t: Tables) -> DataFrame:
    """Un-averaged forecast rows; the horizon is derived from the run time."""
    rows = t.forecast_points.filter("data_type = 'forecast'").drop("weather_code")
    derived = rows.withColumn("horizon_hours", s.horizon_hours(F.col("run_time"), F.col("ts")))
    valid = derived.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return align.align_run(t.actual_hourly, valid, HORIZONS)


@query("e03_align_all", with_views(
    "actual_hourly forecast_points",
    _aligned_sql("a.ts, h.horizon_hours, f.source",
                 "actual_hourly a CROSS JOIN (SELECT unnest([1, 6, 24, 48]) AS horizon_hours) h "
                 "JOIN by_source f ON f.ts = a.ts + h.horizon_hours * interval '1' hour"),
    by_source=_FORECAST_BY_SOURCE,
), ALIGNED)
def _(t: Tables) -> DataFrame:
    return align.align_all(t.actual_hourly, _by_source(t), HORIZONS)


@query("e04_forecast_errors", with_views("forecast_errors", f"SELECT {ERROR_COLUMNS} FROM forecast_errors"), ERROR_VALUES)
def _(t: Tables) -> DataFrame:
    return t.forecast_errors


_PAIRS = (
    "SELECT a.ts, a.temperature AS actual, f.temperature AS forecast FROM actual_hourly a JOIN (SELECT time_bucket(interval "
    "'1 hour', ts) + interval '1 hour' AS ts, avg(temperature) AS temperature FROM forecast_points WHERE data_type = 'forecast' "
    "AND horizon_hours = 24 GROUP BY ALL) f ON f.ts = a.ts WHERE a.temperature IS NOT NULL AND f.temperature IS NOT NULL"
)


def _pairs(t: Tables) -> DataFrame:
    day_ahead = t.forecast_points.filter("data_type = 'forecast' and horizon_hours = 24")
    return align.actual_vs_forecast(t.actual_hourly, align.hourly_means(day_ahead))


@query("e05_actual_vs_forecast", with_views("actual_hourly forecast_points", _PAIRS), "actual forecast")
def _(t: Tables) -> DataFrame:
    return _pairs(t)


@query("e05_correlation", with_views(
    "actual_hourly forecast_points", "SELECT corr(actual, forecast) AS correlation, count(*) AS n FROM pairs", pairs=_PAIRS
), "correlation")
def _(t: Tables) -> DataFrame:
    return align.correlation(_pairs(t))


_NEWEST = "SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY mac ORDER BY ts DESC, event_id DESC) = 1"


@query("e06_dashboard", with_views(
    "readings sensors",
    "SELECT s.mac, s.name, r.temperature, r.humidity, r.pressure, r.battery_voltage, r.rssi, "
    "coalesce(strftime(r.ts, '%H:%M:%S'), 'No data') AS last_update FROM sensors s LEFT JOIN newest r ON r.mac = s.mac",
    newest=_NEWEST,
))
def _(t: Tables) -> DataFrame:
    return sensors.dashboard(t.sensors, t.readings)


@query("e06_activity", with_views(
    "readings sensors",
    "SELECT r.mac, r.ts, r.event_id, r.temperature, r.humidity, r.rssi, coalesce(s.name, substr(r.mac, 1, 8) || '...') AS name "
    "FROM newest r LEFT JOIN (SELECT * FROM sensors WHERE enabled) s ON r.mac = s.mac",
    newest=_NEWEST,
))
def _(t: Tables) -> DataFrame:
    return sensors.activity(t.readings, t.sensors.filter("enabled"))


@query("e07_new_sensors", with_views(
    "readings sensors",
    "SELECT mac, count(*) AS readings FROM readings WHERE mac NOT IN (SELECT mac FROM sensors WHERE enabled) GROUP BY mac",
))
def _(t: Tables) -> DataFrame:
    return sensors.new_sensors(t.readings, t.sensors.filter("enabled"))


@query("e08_seen_sensors", with_views("readings sensors", "SELECT * FROM sensors WHERE mac IN (SELECT mac FROM readings)"))
def _(t: Tables) -> DataFrame:
    return sensors.seen_sensors(t.sensors, t.readings)


@query("e09_reconcile", with_views(
    "readings points",
    "SELECT w.mac, count(p.field) AS found, count(p.field) > 0 AS verified, concat_ws(',', "
    + ", ".join(f"CASE WHEN coalesce(bool_or(p.field = '{f}'), false) = false THEN '{f}' END" for f in ("humidity", "pressure", "temperature"))
    + ") AS missing_fields FROM newest w LEFT JOIN stored p ON p.mac = w.mac AND p.ts >= w.ts - interval '2' minute "
    "AND p.ts < w.ts + interval '2' minute GROUP BY w.mac",
    newest=_NEWEST,
    stored="SELECT * FROM points WHERE measurement = 'environmental' AND event_id % 7 <> 0",
))
def _(t: Tables) -> DataFrame:
    """Every sensor's newest reading against a store that lost some rows."""
    written = windows.latest_per_sensor(t.readings)
    stored = t.points.filter("event_id % 7 <> 0")
    return sensors.reconcile(written, stored).withColumn("missing_fields", F.array_join("missing_fields", ","))


@query("e10_merge_sensors", with_views(
    "sensors",
    "SELECT mac, name, location, status, enabled, last_seen, notes, battery_level FROM imported UNION ALL "
    "SELECT mac, name, location, status, enabled, last_seen, notes, battery_level FROM sensors WHERE status <> 'error' "
    "AND mac NOT IN (SELECT mac FROM imported)",
    imported="SELECT * REPLACE ('imported ' || name AS name, '' AS location) FROM sensors WHERE enabled",
))
def _(t: Tables) -> DataFrame:
    current = t.sensors.filter("status <> 'error'")
    imported = t.sensors.filter("enabled").withColumns({
        "name": F.concat(F.lit("imported "), F.col("name")), "location": F.lit("")
    })
    return sensors.merge_sensors(current, imported)


# --- windows, sort, limit, set operations ------------------------------------

@query("f01_latest_forecast", with_views(
    "forecast_points",
    "SELECT event_id, ts, run_time, horizon_hours, source, temperature FROM forecast_points WHERE data_type = 'forecast' "
    f"AND ts >= {N} - interval '24' hour AND ts < {N} ORDER BY ts DESC, event_id DESC LIMIT 1",
))
def _(t: Tables) -> DataFrame:
    return windows.latest_forecast(t.forecast_points, "forecast", NOW).select(
        "event_id", "ts", "run_time", "horizon_hours", "source", "temperature"
    )


@query("f02_latest_per_sensor", with_views("readings", _NEWEST))
def _(t: Tables) -> DataFrame:
    return windows.latest_per_sensor(t.readings)


@query("f03_timed_moving_average", with_views(
    "errors_long",
    "SELECT h.metric, h.horizon_hours, e.ts, avg(h.value) AS moving_average FROM hourly h JOIN ends e ON e.metric = h.metric "
    "AND e.horizon_hours = h.horizon_hours AND h.ts < e.ts AND h.ts >= e.ts - interval '24' hour GROUP BY ALL",
    hourly=f"SELECT metric, horizon_hours, {BUCKET} AS ts, avg(absolute_error) AS value FROM errors_long GROUP BY ALL",
    ends="SELECT metric, horizon_hours, unnest(generate_series(min(ts), max(ts), interval '1 hour')) AS ts FROM hourly "
    "GROUP BY metric, horizon_hours",
), "moving_average")
def _(t: Tables) -> DataFrame:
    hourly = agg.error_series(t.forecast_errors, "1 hour", "mae")
    return windows.timed_moving_average(hourly, "1 hour", "24 hours", ["metric", "horizon_hours"], "mae")


@query("f04_alert_intervals", with_views(
    "forecast_errors",
    "SELECT source, level, min(ts) AS start_ts, max(ts) AS end_ts, avg(mae) AS mean_mae, count(*) AS windows FROM islands "
    "WHERE met GROUP BY source, level, island, hold HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= hold * 6e7",
    mae="SELECT source, time_bucket(interval '30 minutes', ts, timestamp '1970-01-01') + interval '30 minutes' AS ts, "
    "avg(temp_abs_error) AS mae FROM forecast_errors WHERE horizon_hours = 24 AND temp_abs_error IS NOT NULL GROUP BY ALL",
    tested="SELECT *, 'warning' AS level, 120 AS hold, mae > 3 AS met FROM mae UNION ALL "
    "SELECT *, 'critical', 60, mae > 5 FROM mae UNION ALL SELECT *, 'recovery', 30, mae < 2 FROM mae",
    islands="SELECT *, count(*) FILTER (NOT met) OVER (PARTITION BY source, level ORDER BY ts) AS island FROM tested",
), "mean_mae")
def _(t: Tables) -> DataFrame:
    return windows.alert_intervals(t.forecast_errors)


@query("f05_band_mae", with_views(
    "forecast_errors",
    "SELECT ts, source, horizon_hours, CASE WHEN e IS NULL THEN NULL WHEN e >= 4 THEN 'red' WHEN e >= 2 THEN 'yellow' ELSE 'green' "
    "END AS band FROM (SELECT *, round(temp_abs_error, 9) AS e FROM forecast_errors WHERE horizon_hours = 24)",
))
def _(t: Tables) -> DataFrame:
    settled = t.forecast_errors.filter("horizon_hours = 24").withColumn("temp_abs_error", F.round("temp_abs_error", 9))
    banded = windows.band(settled, "temp_abs_error", windows.BANDS["temp_mae_24h"])
    return banded.select("ts", "source", "horizon_hours", "band")


@query("f05_band_battery", with_views(
    "readings",
    "SELECT event_id, CASE WHEN battery_voltage IS NULL THEN NULL WHEN battery_voltage >= 2.8 THEN 'green' WHEN "
    "battery_voltage >= 2.5 THEN 'yellow' ELSE 'red' END AS band FROM readings",
))
def _(t: Tables) -> DataFrame:
    return windows.band(t.readings, "battery_voltage", windows.BATTERY_STEPS, "red").select("event_id", "band")


@query("f06_sort_time", with_views("readings", "SELECT event_id, ts, mac FROM readings ORDER BY ts, event_id"))
def _(t: Tables) -> DataFrame:
    return windows.sort_time(t.readings.select("event_id", "ts", "mac"))


@query("f07_recent", with_views(
    "points", "SELECT ts, event_id, mac, field, value FROM points ORDER BY ts DESC, event_id DESC, field LIMIT 50"
))
def _(t: Tables) -> DataFrame:
    return windows.recent(t.points, 50, "field").select("ts", "event_id", "mac", "field", "value")


@query("f08_limit_per_series", with_views(
    "points",
    "SELECT mac, field, ts, event_id, value FROM points QUALIFY row_number() OVER (PARTITION BY mac, field ORDER BY ts, event_id) <= 5",
))
def _(t: Tables) -> DataFrame:
    return windows.limit_per_series(t.points, 5, ["mac", "field"]).select("mac", "field", "ts", "event_id", "value")


@query("f09_top_k", with_views(
    "readings",
    "SELECT mac, ts, event_id FROM newest ORDER BY ts DESC, event_id DESC LIMIT 10", newest=_NEWEST,
))
def _(t: Tables) -> DataFrame:
    newest = windows.latest_per_sensor(t.readings.select("mac", "ts", "event_id"))
    return windows.top_k(newest, 10, F.desc("ts"), F.desc("event_id"))


@query("f10_compare_series", with_views(
    "actual_hourly forecast_points",
    "SELECT 'actual' AS series, ts, temperature AS value FROM actual_hourly UNION ALL SELECT horizon_hours || 'h', "
    f"{BUCKET} AS ts, avg(temperature) FROM forecast_points WHERE data_type = 'forecast' AND horizon_hours IN (1, 6, 24) GROUP BY ALL",
), "value")
def _(t: Tables) -> DataFrame:
    predicted = align.hourly_means(t.forecast_points.filter("data_type = 'forecast'"), ["horizon_hours"])
    return windows.compare_series(t.actual_hourly, predicted, [1, 6, 24])


_EXPECTED = ["temperature", "humidity", "pressure", "battery_voltage", "tx_power", "dew_point"]


@query("f11_missing_fields", with_views(
    "points",
    f"SELECT mac, field FROM (SELECT DISTINCT mac FROM points) CROSS JOIN (SELECT unnest({_EXPECTED}) AS field) "
    "EXCEPT SELECT mac, field FROM points",
))
def _(t: Tables) -> DataFrame:
    return windows.missing_fields(t.points, _EXPECTED)


@query("f12_available_fields", with_views(
    "points", f"SELECT unnest({_EXPECTED}) AS field INTERSECT SELECT field FROM points"
))
def _(t: Tables) -> DataFrame:
    return windows.available_fields(t.points, _EXPECTED)


# --- scalar functions --------------------------------------------------------

@query("g01_normalize_mac", with_views(
    "readings",
    "SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN mac END AS mac FROM readings",
))
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    bare = F.lower(F.regexp_replace("mac", ":", ""))
    messy = F.when(e % 6 == 0, F.substring(bare, 1, 10)).when(e % 6 < 3, bare).otherwise(F.regexp_replace("mac", ":", "-"))
    return t.readings.select("event_id", s.normalize_mac(messy).alias("mac"))


@query("g02_validate_mac", with_views("readings", "SELECT event_id, event_id % 3 <> 0 AS valid FROM readings"))
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat(F.lit("x"), "mac")).when(e % 3 == 1, F.regexp_replace("mac", ":", "-")).otherwise(F.col("mac"))
    return t.readings.select("event_id", s.is_valid_mac(text).alias("valid"))


@query("g03_same_text", with_views("sensors", "SELECT mac, lower(location) = 'building' AS same FROM sensors"))
def _(t: Tables) -> DataFrame:
    return t.sensors.select("mac", s.same_text(F.col("location"), F.lit("BuildinG")).alias("same"))


@query("g04_parse_iso", with_views(
    "readings",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - interval '2' hour "
    "WHEN 2 THEN date_trunc('day', ts) END AS ts FROM readings",
))
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    text = (
        F.when(e % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(e % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(e % 4 == 2, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "dd/MM/yyyy"))
    )
    return t.readings.select("event_id", s.parse_iso(text).alias("ts"))


@query("g05_local_time", with_views(
    "readings", "SELECT event_id, ts + interval '2' hour AS helsinki, ts - interval '5' hour AS new_york FROM readings"
))
def _(t: Tables) -> DataFrame:
    """January, so the offsets are fixed."""
    return t.readings.select(
        "event_id", s.local_time(F.col("ts"), F.lit("Europe/Helsinki")).alias("helsinki"),
        s.local_time(F.col("ts"), F.lit("America/New_York")).alias("new_york"),
    )


@query("g06_horizon_hours", with_views("forecast_points", "SELECT event_id, horizon_hours FROM forecast_points"))
def _(t: Tables) -> DataFrame:
    return t.forecast_points.select("event_id", s.horizon_hours(F.col("run_time"), F.col("ts")).alias("horizon_hours"))


@query("g07_epoch_offset", "SELECT l_orderkey, l_linenumber, l_partkey, timestamp '1970-01-01' + (1700000000 + l_suppkey + l_partkey) "
       "* interval '1' second AS ts FROM lineitem")
def _(t: Tables) -> DataFrame:
    base, offset = F.lit(1700000000) + F.col("l_suppkey"), F.col("l_partkey")
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s.epoch_offset(base, offset).alias("ts"))


_V = "battery_voltage"
_BAND_SQL = f"WHEN {_V} >= 3.0 THEN {{}} WHEN {_V} >= 2.8 THEN {{}} WHEN {_V} >= 2.6 THEN {{}} WHEN {_V} >= 2.4 THEN {{}} ELSE {{}} END"


@query("g08_battery_health", with_views(
    "readings",
    f"SELECT event_id, CASE WHEN {_V} IS NULL THEN NULL "
    + _BAND_SQL.format("'Excellent'", "'Good'", "'Fair'", "'Low'", "'Critical'")
    + f" AS health, CASE WHEN {_V} IS NULL THEN NULL " + _BAND_SQL.format(12, 6, 3, 1, 0)
    + f" AS months_left, coalesce({_V} >= 2.6, false) AS passed FROM readings",
))
def _(t: Tables) -> DataFrame:
    return t.readings.select("event_id", F.inline(F.array(s.battery_health(F.col("battery_voltage")))))


@query("g09_item_label", with_views("binned", "SELECT l_orderkey, l_linenumber, 'temperature_' || temperature_binned AS item FROM binned"))
def _(t: Tables) -> DataFrame:
    from ..operators.mining import discretize

    binned = discretize(t.env_wide, ["temperature"])
    return binned.select("l_orderkey", "l_linenumber", s.item_label("temperature", F.col("temperature_binned")).alias("item"))


@query("g10_item_list", "SELECT doc_id, CASE WHEN lang < source THEN lang || ',' || source ELSE source || ',' || lang END AS items "
       "FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", s.item_list(F.array("source", "lang")).alias("items"))


@query("g11_display", with_views(
    "sensors",
    "SELECT mac, CASE WHEN enabled AND status = 'active' THEN 'Active' ELSE 'Inactive' END AS shown_status, "
    "coalesce(strftime(last_seen, '%Y-%m-%d %H:%M'), 'Never') AS shown_last_seen, "
    "CASE WHEN location = 'BUILDING' THEN 'Unknown' ELSE location END AS shown_location FROM sensors",
))
def _(t: Tables) -> DataFrame:
    place = F.when(F.col("location") == "BUILDING", "").otherwise(F.col("location"))
    return t.sensors.select(
        "mac", s.display_status(F.col("enabled"), F.col("status")).alias("shown_status"),
        s.last_seen_text(F.col("last_seen")).alias("shown_last_seen"), s.location_text(place).alias("shown_location"),
    )


@query("g12_error_functions", with_views(
    "readings",
    "SELECT event_id, abs(temperature - humidity) AS absolute, humidity - temperature AS signed, (humidity - temperature) * "
    "(humidity - temperature) AS square, sqrt(abs(temperature - humidity)) AS root FROM readings",
), "absolute signed square root")
def _(t: Tables) -> DataFrame:
    a, f = F.col("temperature"), F.col("humidity")
    e = s.signed_error(a, f)
    return t.readings.select(
        "event_id", s.abs_error(a, f).alias("absolute"), e.alias("signed"), (e * e).alias("square"),
        F.sqrt(s.abs_error(a, f)).alias("root"),
    )


@query("g13_json_field", "SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", s.json_field(F.col("props"), "$.k").try_cast("long").alias("k"))


@query("g14_tag_map", with_views(
    "readings", "SELECT event_id, mac AS sensor_mac, cast(data_format AS VARCHAR) AS data_format, "
    "cast(2 + (tx_power IS NOT NULL)::INT AS BIGINT) AS tags FROM readings"
))
def _(t: Tables) -> DataFrame:
    tags = s.tag_map(sensor_mac=F.col("mac"), data_format=F.col("data_format"), tx_power=F.col("tx_power"))
    tagged = t.readings.select("event_id", tags.alias("tags"))
    return tagged.select(
        "event_id", s.tag_value(F.col("tags"), "sensor_mac").alias("sensor_mac"),
        s.tag_value(F.col("tags"), "data_format").alias("data_format"), F.size("tags").cast("long").alias("tags"),
    )


@query("g15_bits", "SELECT event_id, (event_id * 29) % 65536 >> 5 AS high, (event_id * 29) % 65536 & 31 AS low FROM events")
def _(t: Tables) -> DataFrame:
    word = (F.col("event_id") * 29) % 65536
    return t.raw("events").select("event_id", s.bits(word, 5, 0x7FF).alias("high"), s.bits(word, 0, 0x1F).alias("low"))
