"""Forecast-to-actual alignment and error calculation.

Both sides are reduced to one row per hour (and forecast key) before the join,
so no hour, however busy, carries more than a handful of rows into it. Spark
broadcasts the hourly side only when its measured size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import abs_error, signed_error
from .correlation import safe_corr

METRICS = {"temp": "temperature", "pressure": "pressure", "humidity": "humidity"}


def hourly_means(df: DataFrame, keys: list[str] = (), every: str = "1 hour") -> DataFrame:
    """Windowed mean of the three metrics, stamped with the window end."""
    return (
        df.groupBy(F.window("ts", every).alias("w"), *keys)
        .agg(*[F.avg(c).alias(c) for c in METRICS.values()])
        .select(F.col("w.end").alias("ts"), *keys, *METRICS.values())
    )


def _suffixed(df: DataFrame, suffix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{c}_{suffix}") for c in METRICS.values()])


def align_shift(actual: DataFrame, forecast: DataFrame, horizon: int) -> DataFrame:
    """Pair the actual at t with the forecast valid at t + horizon."""
    return align_all(actual, forecast, [horizon])


def align_all(actual: DataFrame, forecast: DataFrame, horizons: list[int]) -> DataFrame:
    """Every horizon in one join: the hourly actuals are repeated per horizon, not the forecasts read again."""
    wanted = F.explode(F.array(*[F.lit(int(h)) for h in horizons]))
    shifted = _suffixed(actual, "actual", ["ts"]).withColumn("horizon_hours", wanted)
    shifted = shifted.withColumn("valid_ts", F.col("ts") + F.make_dt_interval(hours=F.col("horizon_hours")))
    extra = [c for c in forecast.columns if c not in (*METRICS.values(), "ts", "horizon_hours")]
    right = _suffixed(forecast.withColumnRenamed("ts", "valid_ts"), "forecast", ["valid_ts", *extra])
    return shifted.join(right, "valid_ts").drop("valid_ts")


def align_run(actual: DataFrame, forecast: DataFrame, horizons: list[int]) -> DataFrame:
    """Pair the actual at t with forecasts valid at t, by hours since the forecast run."""
    extra = [c for c in forecast.columns if c not in (*METRICS.values(), "ts")]
    right = _suffixed(forecast.filter(F.col("horizon_hours").isin(*horizons)), "forecast", ["ts", *extra])
    return _suffixed(actual, "actual", ["ts"]).join(right, "ts")


def forecast_errors(aligned: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Absolute and signed error per metric; a row without any metric is dropped."""
    errors: list[Column] = []
    for short, name in METRICS.items():
        a, f = F.col(f"{name}_actual"), F.col(f"{name}_forecast")
        errors += [abs_error(a, f).alias(f"{short}_abs_error"), signed_error(a, f).alias(f"{short}_signed_error")]
    out = aligned.select("ts", "horizon_hours", *keys, *errors)
    return out.filter(F.coalesce(*[f"{m}_abs_error" for m in METRICS]).isNotNull())


def actual_vs_forecast(actual: DataFrame, forecast: DataFrame, metric: str = "temperature") -> DataFrame:
    """Scatter pairs of one metric on equal times."""
    left = actual.select("ts", F.col(metric).alias("actual"))
    right = forecast.select("ts", F.col(metric).alias("forecast"))
    return left.join(right, "ts").filter("actual is not null and forecast is not null")


def correlation(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        safe_corr(F.col("actual"), F.col("forecast")).alias("correlation"), F.count("*").alias("n")
    )


def errors_long(errors: DataFrame, keys: list[str] = ("ts", "horizon_hours", "source")) -> DataFrame:
    """(metric, absolute_error, signed_error) rows of the wide error table."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("metric"), F.col(f"{short}_abs_error").alias("absolute_error"),
            F.col(f"{short}_signed_error").alias("signed_error"),
        )
        for short, name in METRICS.items()
    ])
    return errors.select(*keys, F.inline(rows)).filter(F.col("absolute_error").isNotNull())
