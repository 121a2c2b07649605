"""Latest rows, moving averages, hold-time alerts, bands, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import banded
from ..session import materialize
from .aggregates import aggregate_window
from .filters import last
from .ordered import running_before

SALTS = 64

# Lower bound and label, worst first (fixed values of the stat panels).
BANDS = {
    "temp_mae_1h": [(2.0, "red"), (1.0, "yellow")],
    "temp_mae_24h": [(4.0, "red"), (2.0, "yellow")],
    "humidity_mae": [(10.0, "red"), (5.0, "yellow")],
    "pressure_mae": [(5.0, "red"), (2.0, "yellow")],
    "temp_error": [(5.0, "red"), (2.0, "yellow")],
}
BATTERY_STEPS = [(2.8, "green"), (2.5, "yellow")]

# (level, comparison, threshold, minutes the condition must hold) (fixed values).
ALERT_RULES = [
    ("warning", ">", 3.0, 120),
    ("critical", ">", 5.0, 60),
    ("recovery", "<", 2.0, 30),
]


def latest_forecast(forecasts: DataFrame, data_type: str, now: str) -> DataFrame:
    """Newest record of the last 24 h for a data type."""
    recent = last(forecasts.filter(F.col("data_type") == data_type), "24h", now)
    return recent.orderBy(F.desc("ts"), F.desc("event_id")).limit(1)


def latest_per_sensor(readings: DataFrame) -> DataFrame:
    return latest_n(readings, 1)


def latest_n(readings: DataFrame, n: int, keys: list[str] = ("mac",)) -> DataFrame:
    """The newest ``n`` rows per sensor."""
    return _first_rows(readings, n, list(keys), [F.desc("ts"), F.desc("event_id")])


def limit_per_series(points: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The first ``n`` rows of every series."""
    return _first_rows(points, n, keys, [F.asc("ts"), F.asc("event_id")])


def _first_rows(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first ``n`` rows per group.

    Salted parts of a group are limited first, so no task sorts a whole group.
    Spark also limits each part inside the map task (a window group limit).
    """
    def limited(rows: DataFrame, by: list) -> DataFrame:
        numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return numbered.filter(F.col("_rn") <= n).drop("_rn")

    return limited(limited(df, [*keys, F.pmod(F.xxhash64("ts", "event_id"), F.lit(SALTS))]), keys)


def timed_moving_average(series: DataFrame, every: str, period: str, keys: list[str], value: str = "value") -> DataFrame:
    """Mean over the trailing ``period``, every ``every``, for windows ending inside the series' range.

    ``series`` is already a windowed series, so a row falls into a fixed number
    of sliding windows (period / every). It is stored, as it is read twice.
    """
    series = materialize(series, "series")
    sliding = (
        series.groupBy(F.window("ts", period, every).alias("w"), *keys)
        .agg(F.avg(value).alias("moving_average"))
        .select(F.col("w.end").alias("ts"), *keys, "moving_average")
    )
    spans = series.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    clipped = sliding.join(spans, list(keys)).filter(F.col("ts").between(F.col("_first"), F.col("_last")))
    return clipped.drop("_first", "_last")


def alert_intervals(errors: DataFrame, horizon: int = 24, every: str = "30 minutes", rules: list = ALERT_RULES) -> DataFrame:
    """Spans in which the windowed temperature MAE met a rule without a break for its hold time.

    Islands are found on the windowed series, one row per window, not on readings: windows that do not meet the rule
    are counted over sorted ranges, so decades of one source spread over all tasks, and windows with the same count
    before them are one span.
    """
    mae = aggregate_window(
        errors.filter(F.col("horizon_hours") == horizon), every, ["source"], [F.avg("temp_abs_error").alias("mae")]
    ).filter(F.col("mae").isNotNull())
    rule = F.explode(F.array(*[
        F.struct(F.lit(l).alias("level"), F.lit(op).alias("op"), F.lit(t).alias("threshold"),
                 F.lit(float(m)).alias("hold_minutes"))
        for l, op, t, m in rules
    ]))
    tested = mae.withColumn("r", rule).select("source", "ts", "mae", "r.*")
    met = F.when(F.col("op") == ">", F.col("mae") > F.col("threshold")).otherwise(F.col("mae") < F.col("threshold"))
    broken = F.when(F.col("met"), 0).otherwise(1)
    islands = running_before(tested.withColumn("met", met), ["source", "level"], ["ts"], broken, "island").filter("met")
    spans = islands.groupBy("source", "level", "island").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.avg("mae").alias("mean_mae"),
        F.max("hold_minutes").alias("hold_minutes"), F.count("*").alias("windows"),
    )
    held = (F.col("end_ts").cast("double") - F.col("start_ts").cast("double")) / 60.0
    return spans.filter(held >= F.col("hold_minutes")).drop("island", "hold_minutes")


def band(df: DataFrame, column: str, steps: list, otherwise: str = "green", name: str = "band") -> DataFrame:
    return df.withColumn(name, banded(F.col(column), steps, otherwise))


def sort_time(df: DataFrame) -> DataFrame:
    return df.orderBy("ts", "event_id")


def recent(df: DataFrame, n: int, *ties: str) -> DataFrame:
    """The newest ``n`` rows overall; ``ties`` order rows of one event."""
    return df.orderBy(F.desc("ts"), F.desc("event_id"), *ties).limit(n)


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def compare_series(actual: DataFrame, forecast: DataFrame, horizons: list[int], metric: str = "temperature") -> DataFrame:
    """Actual and forecast series under one label column."""
    labelled = actual.select(F.lit("actual").alias("series"), "ts", F.col(metric).alias("value"))
    predicted = (
        forecast.filter(F.col("horizon_hours").isin(*horizons))
        .select(F.concat(F.col("horizon_hours").cast("string"), F.lit("h")).alias("series"), "ts",
                F.col(metric).alias("value"))
    )
    return labelled.unionByName(predicted)


def missing_fields(points: DataFrame, expected: list[str]) -> DataFrame:
    """Expected fields a sensor has never reported."""
    found = points.select("mac", "field").distinct()
    wanted = found.select("mac").distinct().withColumn("field", F.explode(F.array(*[F.lit(f) for f in expected])))
    return wanted.join(found, ["mac", "field"], "left_anti")


def available_fields(points: DataFrame, expected: list[str]) -> DataFrame:
    """Expected fields that occur at all."""
    return points.filter(F.col("field").isin(*expected)).select("field").distinct()
