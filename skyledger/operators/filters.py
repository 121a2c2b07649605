"""Predicates, projections and validation verdicts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_valid_mac, tag_value
from ..schemas import RANGE_SPEC

_UNITS = {
    "s": "SECONDS", "m": "MINUTES", "h": "HOURS", "d": "DAYS", "w": "WEEKS",
    "second": "SECONDS", "minute": "MINUTES", "hour": "HOURS", "day": "DAYS", "week": "WEEKS",
}


def interval(duration: str) -> Column:
    """``48h``, ``-7d`` or ``30 days`` as an interval (always positive)."""
    match = re.fullmatch(r"\s*-?\s*(\d+)\s*([a-z]+?)s?\s*", duration.lower())
    if not match or match.group(2) not in _UNITS:
        raise ValueError(f"not a duration: {duration!r}")
    return F.expr(f"INTERVAL {match.group(1)} {_UNITS[match.group(2)]}")


def _instant(text: str) -> Column:
    return F.lit(str(text)).cast("timestamp")


def time_range(df: DataFrame, start: str, stop: str | None = None) -> DataFrame:
    """Half-open ``[start, stop)``; without ``stop`` up to now."""
    end = _instant(stop) if stop else F.current_timestamp()
    return df.filter((F.col("ts") >= _instant(start)) & (F.col("ts") < end))


def last(df: DataFrame, duration: str, now: str) -> DataFrame:
    """The last ``duration`` before an explicit ``now``."""
    return df.filter((F.col("ts") >= _instant(now) - interval(duration)) & (F.col("ts") < _instant(now)))


def measurement_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(F.col("measurement").rlike(pattern))


def fields_in(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.filter(F.col("field").isin(*fields))


def tag_in(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(*values))


def errors_query(errors: DataFrame, start: str, stop: str, horizon: int | None = None,
                 source: str | None = None) -> DataFrame:
    """Error rows of a range, by horizon and source when given."""
    out = time_range(errors, start, stop)
    if horizon is not None:
        out = out.filter(F.col("horizon_hours") == horizon)
    if source is not None:
        out = out.filter(F.col("source") == source)
    return out


def keep(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def tag_values(df: DataFrame, tag: str) -> DataFrame:
    column = F.col(tag) if tag in df.columns else tag_value(F.col("tags"), tag).alias(tag)
    return df.select(column).distinct()


def schema_keys(tagged_points: DataFrame) -> DataFrame:
    """Distinct tag and field keys, with their kind."""
    keys = F.concat(
        F.transform(F.map_keys("tags"), lambda k: F.struct(F.lit("tag").alias("kind"), k.alias("key"))),
        F.array(F.struct(F.lit("field").alias("kind"), F.col("field").alias("key"))),
    )
    return tagged_points.select(F.inline(keys)).distinct()


def pivot_fields(points: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One column per field; the fixed list saves the job that would look for values."""
    return fields_in(points, fields).groupBy(*keys).pivot("field", fields).agg(F.first("value", ignorenulls=True))


def analysis_frame(df: DataFrame, columns: list[str], keys: list[str] = ("ts",)) -> DataFrame:
    """Available analysis columns, without rows where all of them are null."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("no analysis columns available")
    return df.select(*keys, *present).dropna(how="all", subset=present)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=columns)


def range_issues(df: DataFrame, spec: dict[str, tuple[float, float]] = RANGE_SPEC) -> DataFrame:
    """``issues`` lists the fields outside their physical range; ``passed`` when none is."""
    checks = [F.when(~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in spec.items() if c in df.columns]
    return df.withColumn("issues", F.array_compact(F.array(*checks))).withColumn("passed", F.size("issues") == 0)


def consistency_issues(df: DataFrame, now: str) -> DataFrame:
    """Format-5 rows need their extra fields; the time must be at most an hour old and a minute ahead."""
    five = F.col("data_format") == 5
    age = _instant(now).cast("double") - F.col("ts").cast("double")
    checks = [
        F.when(five & (F.coalesce("mac", F.lit("")) == ""), "missing_mac"),
        F.when(five & F.col("tx_power").isNull(), "missing_tx_power"),
        F.when(five & F.col("movement_counter").isNull(), "missing_movement_counter"),
        F.when(five & F.col("measurement_sequence").isNull(), "missing_measurement_sequence"),
        F.when(age > 3600, "too_old"),
        F.when(age < -60, "in_future"),
    ]
    return df.withColumn("issues", F.array_compact(F.array(*checks))).withColumn("passed", F.size("issues") == 0)


def validate_sensors(sensors: DataFrame) -> DataFrame:
    """Verdicts on sensor metadata."""
    name = F.length(F.trim("name"))
    checks = {
        "name": F.coalesce(name >= 1, F.lit(False)) & (F.length("name") <= 100),
        "location": F.coalesce(F.length("location") <= 100, F.lit(True)),
        "notes": F.coalesce(F.length("notes") <= 500, F.lit(True)),
        "battery_level": F.coalesce(F.col("battery_level").between(0, 100), F.lit(True)),
        "mac": is_valid_mac(F.col("mac")),
    }
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(k)) for k, ok in checks.items()]))
    return sensors.withColumn("issues", failed).withColumn("valid", F.size("issues") == 0)
