"""Windowed and grouped aggregates, error statistics and operations summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import packed_order
from ..session import materialize
from .align import errors_long
from .filters import interval, last, time_range
from .ordered import quantiles, running_before


# --- windows ---------------------------------------------------------------

def aggregate_window(df: DataFrame, every: str, keys: list[str], aggs: list[Column], create_empty: bool = False,
                     start: str | None = None, stop: str | None = None) -> DataFrame:
    """Aggregate per epoch-aligned window and series, stamped with the window end.

    With ``create_empty`` each series also gets null rows for its empty windows
    between ``start`` and ``stop``. The grid is unrolled from the series' own
    rows, so no product of series and times is joined.
    """
    windows = (
        df.groupBy(F.window("ts", every).alias("w"), *keys).agg(*aggs)
        .withColumn("ts", F.col("w.end")).drop("w")
    )
    if not create_empty:
        return windows
    windows = materialize(windows, "windows")  # read twice below
    grid = F.sequence(_first_end(start, every), _last_end(stop, every), F.expr(f"INTERVAL {every}"))
    spine = windows.select(*keys).distinct().withColumn("ts", F.explode(grid))
    return spine.join(windows, [*keys, "ts"], "left")


def _first_end(start: str, every: str) -> Column:
    """End of the window holding ``start``."""
    size = _seconds(every)
    return F.expr(f"timestamp_seconds((unix_seconds(timestamp '{start}') div {size} + 1) * {size})")


def _last_end(stop: str, every: str) -> Column:
    """End of the last window that begins before ``stop``."""
    size = _seconds(every)
    return F.expr(f"timestamp_seconds(((unix_seconds(timestamp '{stop}') - 1) div {size} + 1) * {size})")


def _seconds(every: str) -> int:
    number, unit = every.split()
    scale = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    return int(number) * scale[unit.rstrip("s")]


def by_hour(points: DataFrame, field: str) -> DataFrame:
    hour = F.hour("ts").cast("string")
    return points.filter(F.col("field") == field).groupBy(hour.alias("hour")).agg(F.avg("value").alias("mean"))


def by_weekday(points: DataFrame, field: str) -> DataFrame:
    """0 is Sunday."""
    day = (F.dayofweek("ts") - 1).cast("string")
    return points.filter(F.col("field") == field).groupBy(day.alias("weekday")).agg(F.avg("value").alias("mean"))


def range_mean(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"))


# --- counts ----------------------------------------------------------------

def ingest_summary(points: DataFrame, start: str, stop: str) -> DataFrame:
    """Points, unique sensors and points per second of a range."""
    seconds = F.lit(stop).cast("timestamp").cast("long") - F.lit(start).cast("timestamp").cast("long")
    per_sensor = time_range(points, start, stop).groupBy("mac").agg(F.count("*").alias("n"))
    return per_sensor.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_points"), F.count("*").alias("unique_sensors")
    ).withColumn("points_per_second", F.col("total_points") / seconds)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def catalog_summary(points: DataFrame) -> DataFrame:
    """Counts, unique sensors and latest time per field, per measurement and overall.

    Reduced to one row per (measurement, field, sensor) first: the subtotals
    are then rolled up from that small table.
    """
    base = points.groupBy("measurement", "field", "mac").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return base.rollup("measurement", "field").agg(
        F.sum("n").alias("n"), F.countDistinct("mac").alias("sensors"), F.max("latest").alias("latest"),
        F.grouping_id().alias("level"),
    )


def points_per_minute(points: DataFrame, duration: str, now: str) -> DataFrame:
    """Points per minute and sensor over the last ``duration``."""
    end = F.lit(now).cast("timestamp")
    minutes = (end.cast("long") - (end - interval(duration)).cast("long")) / F.lit(60.0)
    recent = last(points, duration, now).groupBy("mac").agg(F.count("*").alias("n"))
    return recent.select("mac", (F.col("n") / minutes).alias("per_minute"))


def recent_activity(points: DataFrame, now: str, duration: str = "10m") -> DataFrame:
    return last(points, duration, now).agg(F.count("*").alias("recent")).withColumn(
        "state", F.when(F.col("recent") > 0, "OK").otherwise("WARNING")
    )


# --- latest values ---------------------------------------------------------

def last_value(points: DataFrame, keys: list[str]) -> DataFrame:
    """Newest value per series, ties by id; one row per series leaves the hash table of each task."""
    newest = F.max_by("value", packed_order("ts", "event_id")).alias("value")
    return points.groupBy(*keys).agg(F.max("ts").alias("ts"), newest)


def latest_wide(points: DataFrame, fields: list[str], keys: list[str] = ("mac",)) -> DataFrame:
    """One row per sensor with the last value of each field."""
    newest = last_value(points.filter(F.col("field").isin(*fields)), [*keys, "field"])
    picks = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return newest.groupBy(*keys).agg(*picks, F.max("ts").alias("last_ts"))


# --- forecast error statistics ---------------------------------------------

def mae(errors: DataFrame, keys: list[str]) -> DataFrame:
    return errors_long(errors).groupBy(*keys).agg(F.avg("absolute_error").alias("mae"))


def rmse(errors: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("signed_error")
    return errors_long(errors).groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"))


def bias(errors: DataFrame, keys: list[str]) -> DataFrame:
    out = errors_long(errors).groupBy(*keys).agg(F.avg("signed_error").alias("bias"))
    return out.withColumn("direction", F.when(F.col("bias") > 0, "over-prediction").otherwise("under-prediction"))


def error_stddev(errors: DataFrame, keys: list[str]) -> DataFrame:
    return errors_long(errors).groupBy(*keys).agg(F.stddev_samp("signed_error").alias("stddev"))


def horizon_report(errors: DataFrame) -> DataFrame:
    """Count, mean and worst temperature error, bias and the other mean errors per horizon."""
    return (
        errors.groupBy("horizon_hours")
        .agg(
            F.count("*").alias("records"),
            F.avg("temp_abs_error").alias("temp_mae"),
            F.max("temp_abs_error").alias("temp_max_error"),
            F.avg("temp_signed_error").alias("temp_bias"),
            F.avg("pressure_abs_error").alias("pressure_mae"),
            F.avg("humidity_abs_error").alias("humidity_mae"),
        )
        .withColumn(
            "direction", F.when(F.col("temp_bias") > 0, "over-prediction").otherwise("under-prediction")
        )
    )


def error_series(errors: DataFrame, every: str, stat: str, start: str | None = None,
                 stop: str | None = None) -> DataFrame:
    """Windowed mae, rmse or bias per metric and horizon."""
    e = F.col("signed_error")
    stats = {"mae": F.avg("absolute_error"), "rmse": F.sqrt(F.avg(e * e)), "bias": F.avg(e)}
    rows = errors_long(errors)
    if start:
        rows = time_range(rows, start, stop)
    return aggregate_window(rows, every, ["metric", "horizon_hours"], [stats[stat].alias(stat)])


def error_histogram(errors: DataFrame, width: float = 0.5, column: str = "temp_signed_error") -> DataFrame:
    bucket = (F.floor(F.col(column) / F.lit(width)) * F.lit(width)).alias("bucket")
    return errors.filter(F.col(column).isNotNull()).groupBy(bucket).agg(F.count("*").alias("n"))


def error_overlay(errors: DataFrame, column: str = "temp_signed_error") -> DataFrame:
    """Mean, median and deviation drawn over the histogram; the errors, often a join, are worked out once."""
    errors = materialize(errors.select(column), "errors")
    moments = per_column(errors, [column], lambda v: {"mean": F.avg(v), "stddev": F.stddev_samp(v)})
    median = quantiles(errors, [column], [0.5]).select("column", F.col("q0").alias("median"))
    return moments.join(median, "column").select("mean", "median", "stddev")


def per_column(df: DataFrame, columns: list[str], aggs: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """The same aggregates of several columns from one scan without repeating its rows: one row per column."""
    named = {c: aggs(F.col(c).cast("double")) for c in columns}
    wide = df.agg(*[agg.alias(f"{c}|{name}") for c, found in named.items() for name, agg in found.items()])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{name}`").alias(name) for name in found])
        for c, found in named.items()
    ]
    return wide.select(F.inline(F.array(*rows)))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per column."""
    moments = per_column(df, columns, lambda v: {
        "count": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v),
    })
    q = quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    return moments.join(q, "column", "left")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells and their share per column, in one scan."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["rows"], columns, "column", "missing").withColumn(
        "missing_percent", F.col("missing") * 100.0 / F.col("rows")
    )


# --- operations ------------------------------------------------------------

def perf_summary(ops: DataFrame) -> DataFrame:
    """Totals per metric; averages over successes, points over every attempt."""
    ok = F.col("success")
    return ops.groupBy("metric").agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("successful"),
        F.coalesce(F.avg(F.when(ok, F.col("duration"))), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.avg(F.when(ok, F.col("points").cast("double"))), F.lit(0.0)).alias("avg_devices"),
        F.sum("points").alias("total_points"),
    )


def write_stats(ops: DataFrame) -> DataFrame:
    ok = F.col("success")
    return ops.groupBy("metric").agg(
        F.coalesce(F.sum(F.when(ok, F.col("points"))), F.lit(0)).alias("points_written"),
        F.coalesce(F.sum(F.when(~ok, F.col("points"))), F.lit(0)).alias("points_failed"),
        F.count_if(ok).alias("batches_sent"),
        F.count_if(~ok).alias("batches_failed"),
        F.max(F.when(ok, F.col("ts"))).alias("last_write"),
        F.coalesce(F.sum(F.when(ok, F.col("duration"))), F.lit(0.0)).alias("total_write_time"),
        F.coalesce(F.avg(F.when(ok, F.col("duration"))), F.lit(0.0)).alias("avg_write_time"),
    )


def error_runs(ops: DataFrame, fatal: int = 10) -> DataFrame:
    """Errors and the longest run of consecutive errors per metric.

    Errors between two successes share the number of successes before them. With
    that number as a distributed running total the runs are a plain group-by.
    """
    numbered = running_before(
        ops.select("metric", "ts", "event_id", "success"), ["metric"], ["ts", "event_id"],
        F.when(F.col("success"), 1).otherwise(0), "run",
    )
    runs = numbered.groupBy("metric", "run").agg(F.count_if(~F.col("success")).alias("length"))
    return (
        runs.groupBy("metric")
        .agg(F.sum("length").alias("errors"), F.max("length").alias("longest_run"))
        .withColumn("fatal", F.col("longest_run") >= fatal)
    )


def status_rollup(checks: DataFrame) -> DataFrame:
    """Counts per verdict and the worst one as overall status."""
    counts = checks.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "warning", "failed")]
    )
    overall = F.when(F.col("failed") > 0, "failed").when(F.col("warning") > 0, "warning").otherwise("passed")
    return counts.withColumn("overall_status", overall)


def metric_checks(ops: DataFrame) -> DataFrame:
    """A check per metric and hour: failed above 20 % errors, warning above 10 %."""
    hourly = ops.groupBy("metric", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_share")
    )
    share = F.col("error_share")
    return hourly.withColumn("status", F.when(share > 0.2, "failed").when(share > 0.1, "warning").otherwise("passed"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Successful and failed sensors of a batch operation (``mac``, ``passed``)."""
    per_sensor = results.groupBy("mac").agg(F.bool_and("passed").alias("passed"))
    return per_sensor.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("successful"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def itemset_counts(binned: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every grouping set; distinct combinations are counted once, then cubed."""
    combos = binned.groupBy(*columns).agg(F.count("*").alias("n"))
    return combos.cube(*columns).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
