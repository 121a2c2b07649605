"""Provider forecast documents to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_iso

# Our column and the provider's array name (fixed values).
HOURLY_NAMES = {
    "temperature": "temperature_2m",
    "humidity": "relativehumidity_2m",
    "pressure": "surface_pressure",
    "wind_speed": "windspeed_10m",
    "wind_direction": "winddirection_10m",
    "precipitation": "precipitation",
    "cloud_cover": "cloudcover",
    "visibility": "visibility",
    "uv_index": "uv_index",
    "weather_code": "weathercode",
}

# Arrays are read as text so that one unreadable cell stays one null cell.
_HOURLY = "struct<time:array<string>," + ",".join(f"{n}:array<string>" for n in HOURLY_NAMES.values()) + ">"
_CURRENT = "struct<time:string,temperature:double,windspeed:double,winddirection:double,weathercode:double>"
_DOC = f"struct<timezone:string,latitude:double,longitude:double,hourly:{_HOURLY},current_weather:{_CURRENT}>"


def _typed(column: str, cell: Column) -> Column:
    number = cell.try_cast("double")
    return number.cast("int") if column == "weather_code" else number


def parse_forecast_json(docs: DataFrame, is_forecast: bool = True, doc: str = "doc") -> DataFrame:
    """One row per hour: parallel arrays are zipped, short or absent arrays give nulls, a bad time drops its hour."""
    parsed = docs.withColumn("d", F.from_json(doc, _DOC))
    # an absent array would make the whole zip null, so it is read as empty
    arrays = [F.coalesce(f"d.hourly.{n}", F.array().cast("array<string>")).alias(n) for n in HOURLY_NAMES.values()]
    zipped = F.arrays_zip(F.col("d.hourly.time").alias("time"), *arrays)
    keys = [c for c in docs.columns if c != doc]
    hours = parsed.select(
        *keys, F.col("d.timezone").alias("timezone"), F.col("d.latitude").alias("latitude"),
        F.col("d.longitude").alias("longitude"), F.posexplode(zipped).alias("pos", "h"),
    )
    names = ["time", *HOURLY_NAMES.values()]
    cells = {n: F.col("h")[n] for n in names}
    return hours.select(
        *keys, "timezone", "latitude", "longitude", "pos", parse_iso(cells["time"]).alias("ts"),
        *[_typed(c, cells[n]).alias(c) for c, n in HOURLY_NAMES.items()], F.lit(is_forecast).alias("is_forecast"),
    ).filter(F.col("ts").isNotNull())


def parse_current_json(docs: DataFrame, zero_fill: bool = False, doc: str = "doc") -> DataFrame:
    """Current weather; what the provider does not report is null, or 0 with ``zero_fill``."""
    keys = [c for c in docs.columns if c != doc]
    current = docs.select(*keys, F.from_json(doc, _DOC).alias("d")).filter(F.col("d.current_weather").isNotNull())
    absent = F.lit(0.0 if zero_fill else None).cast("double")
    c = F.col("d.current_weather")
    return current.select(
        *keys, F.col("d.timezone").alias("timezone"), parse_iso(c["time"]).alias("ts"),
        c["temperature"].alias("temperature"), c["windspeed"].alias("wind_speed"),
        c["winddirection"].alias("wind_direction"), c["weathercode"].cast("int").alias("weather_code"),
        *[absent.alias(n) for n in ("humidity", "pressure", "precipitation", "cloud_cover")],
        F.lit(False).alias("is_forecast"),
    ).filter(F.col("ts").isNotNull())


def as_response(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Hourly rows regrouped as responses (the input shape of ``forecast_to_points``).

    ``keys`` must identify a document, which the provider bounds to a few hundred hours.
    """
    fields = ["ts", "is_forecast", *HOURLY_NAMES]
    hour = F.struct("pos", *fields)
    return parsed.groupBy(*keys, "timezone", "latitude", "longitude").agg(F.array_sort(F.collect_list(hour)).alias("hourly"))
