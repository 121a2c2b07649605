"""The long points table: build, scan, store, age out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_iso, tag_map, tag_value
from ..schemas import ERROR_FIELDS, FIELD_MEASUREMENT, FORECAST_FIELDS
from .store import ConcurrentChange, Store

READING_KEYS = ["event_id", "mac", "data_format", "ts"]


def _long(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Wide fields to (field, value) rows; null fields are not points."""
    doubles = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields])
    return doubles.unpivot(keys, fields, "field", "value").filter(F.col("value").isNotNull())


def _measurement_of(field: Column) -> Column:
    groups: dict[str, list[str]] = {}
    for name, measurement in FIELD_MEASUREMENT.items():
        groups.setdefault(measurement, []).append(name)
    out = None
    for measurement, names in groups.items():
        test = field.isin(*names)
        out = F.when(test, measurement) if out is None else out.when(test, measurement)
    return out


def scan_points(points: DataFrame, measurement: str, start: str, stop: str, tags: dict | None = None) -> DataFrame:
    """Rows of one measurement in ``[start, stop)``, optionally by tag, in time order."""
    out = points.filter(
        (F.col("measurement") == measurement)
        & (F.col("ts") >= F.lit(start).cast("timestamp"))
        & (F.col("ts") < F.lit(stop).cast("timestamp"))
    )
    for key, value in (tags or {}).items():
        column = F.col(key) if key in points.columns else tag_value(F.col("tags"), key)
        out = out.filter(column == value)
    return out.orderBy("ts")


def readings_to_points(readings: DataFrame) -> DataFrame:
    """A reading becomes one point per non-null field, in four measurements."""
    keys = [k for k in READING_KEYS if k in readings.columns]
    fields = [f for f in FIELD_MEASUREMENT if f in readings.columns]
    return _long(readings, keys, fields).withColumn("measurement", _measurement_of(F.col("field")))


def with_reading_tags(points: DataFrame) -> DataFrame:
    return points.withColumn("tags", tag_map(sensor_mac=F.col("mac"), data_format=F.col("data_format")))


def forecast_to_points(responses: DataFrame) -> DataFrame:
    """Forecast responses to long points.

    ``responses`` holds latitude, longitude, timezone, retrieved_at, ``current``
    (struct or null) and the arrays ``hourly`` and ``daily``. The three parts
    become one array before the explode, so a response is read once.
    """
    def part(row: Column, data_type: Column) -> Column:
        return F.struct(
            data_type.alias("data_type"), row["is_forecast"].alias("is_forecast"), row["ts"].alias("ts"),
            *[row[f].cast("double").alias(f) for f in FORECAST_FIELDS],
        )

    none = F.array().cast(_part_type())
    current = F.when(F.col("current").isNotNull(), F.array(part(F.col("current"), F.lit("current"))))
    hourly = F.transform(
        "hourly", lambda r: part(r, F.when(r["is_forecast"], F.lit("forecast")).otherwise(F.lit("historical")))
    )
    daily = F.transform("daily", lambda r: part(r, F.lit("daily_forecast")))
    rows = F.concat(*[F.coalesce(x.cast(_part_type()), none) for x in (current, hourly, daily)])
    tags = tag_map(
        location_lat=F.col("latitude"), location_lon=F.col("longitude"), timezone=F.col("timezone"),
        retrieved_at=F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss"),
        data_type=F.col("row.data_type"), is_forecast=F.col("row.is_forecast"),
    )
    flat = responses.select("*", F.explode(rows).alias("row")).select(
        F.lit("forecasts").alias("measurement"), tags.alias("tags"),
        F.col("row.data_type").alias("data_type"), F.col("row.ts").alias("ts"),
        *[F.col(f"row.{f}") for f in FORECAST_FIELDS],
    )
    return _long(flat, ["measurement", "tags", "data_type", "ts"], FORECAST_FIELDS)


def _part_type() -> str:
    fields = ",".join(f"{f}:double" for f in FORECAST_FIELDS)
    return f"array<struct<data_type:string,is_forecast:boolean,ts:timestamp,{fields}>>"


def errors_to_points(errors: DataFrame) -> DataFrame:
    """Error records to long points; the time may be an instant or ISO text."""
    is_text = dict(errors.dtypes)["ts"] == "string"
    ts = parse_iso(F.col("ts")) if is_text else F.col("ts")
    source = F.coalesce(F.col("source"), F.lit("unknown")) if "source" in errors.columns else F.lit("unknown")
    horizon = F.coalesce(F.col("horizon_hours"), F.lit(0)).cast("string")
    keyed = errors.withColumns({"ts": ts, "source": source, "horizon": horizon}).filter(F.col("ts").isNotNull())
    fields = [f for f in ERROR_FIELDS if f in errors.columns]
    return _long(keyed, ["source", "horizon", "ts"], fields).withColumn("measurement", F.lit("forecast_errors"))


def dedupe_points(points: DataFrame, tags: list[str] = ("mac", "data_format"), later: str = "event_id") -> DataFrame:
    """One value per (measurement, tags, field, second): the later write wins.

    ``max_by`` on a number combines in a hash table before the shuffle, so a
    sensor that repeats the same second many times is reduced where it is read.
    ``later`` grows with every write.
    """
    second = F.date_trunc("second", "ts")
    return (
        points.withColumn("second", second)
        .groupBy("measurement", *tags, "field", "second")
        .agg(F.max_by("value", later).alias("value"), F.max(later).alias(later))
        .withColumnRenamed("second", "ts")
    )


SIDE = 16  # fields of one second that are shuffled side by side
READING_TAGS, FORECAST_TAGS, ERROR_TAGS = ("mac", "data_format"), ("source", "data_type", "horizon"), ("source", "horizon")


def points_store(spark: SparkSession, path: str) -> Store:
    """The stored points: by measurement and day."""
    return Store(spark, path, ["measurement", "date"])


def read_points(spark: SparkSession, path: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Stored points of the newest version, optionally of the days from the first to the last given only."""
    return points_store(spark, path).read(lambda part: days[0] <= (part["date"] or "") <= days[1] if days else True)


def _names(points: DataFrame) -> set[tuple[str | None, str | None]]:
    """The measurements and fields that occur; a schema's worth of rows reaches the driver."""
    return {(r["measurement"], r["field"]) for r in points.select("measurement", "field").distinct().collect()}


def _by_day(points: DataFrame, tags: tuple[str, ...], later: str, names: set[tuple[str | None, str | None]]) -> DataFrame:
    """What ``dedupe_points`` keeps, clustered by day: up to ``SIDE`` fields of equal tags and second are shuffled as one row.

    The tags are most of a point, so that is several times less than a row per point. ``names`` lists the
    measurements and fields; more than ``SIDE`` of them make several rows.
    """
    ordered = sorted(names, key=lambda n: tuple((x is not None, x or "") for x in n))
    number = F.coalesce(*[F.when(F.col("measurement").eqNullSafe(F.lit(m)) & F.col("field").eqNullSafe(F.lit(f)), F.lit(i))
                          for i, (m, f) in enumerate(ordered)], F.raise_error(F.lit("the points have changed meanwhile")).cast("int"))
    numbered = points.select(*tags, F.date_trunc("second", "ts").alias("ts"), F.col("value"), F.col(later), number.alias("_name"))
    slots = range(min(SIDE, len(ordered)))
    wide = numbered.groupBy(*tags, "ts", F.floor(F.col("_name") / F.lit(SIDE)).cast("int").alias("_side")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("_name") % SIDE)).alias("_present"),
        # the orders last and together: they are mostly the same number, which then compresses to nothing
        *[f(F.when(F.col("_name") % SIDE == i, F.col(later))).alias(f"{n}{i}")
          for f, n in ((lambda o: F.max_by("value", o), "_v"), (F.max, "_l")) for i in slots])
    clustered = wide.withColumn("date", F.to_date("ts")).hint("rebalance", "date")
    if not ordered:
        slots, ordered = range(1), [(None, None)]
        clustered = clustered.withColumns({"_v0": F.lit(None).cast(points.schema["value"].dataType),
                                           "_l0": F.lit(None).cast(points.schema[later].dataType)})
    each = F.stack(F.lit(len(slots)), *[c for i in slots for c in (F.lit(i), F.col(f"_v{i}"), F.col(f"_l{i}"))])
    rows = clustered.select(*tags, "ts", "date", "_side", "_present", each.alias("_slot", "value", later))
    rows = rows.filter(F.call_function("shiftright", F.col("_present"), F.col("_slot")).bitwiseAND(F.lit(1)) == 1)
    name = F.array(*[F.struct(F.lit(m).cast("string").alias("measurement"), F.lit(f).cast("string").alias("field"))
                     for m, f in ordered])[F.col("_side") * SIDE + F.col("_slot")]
    return rows.select(name["measurement"].alias("measurement"), *tags, name["field"].alias("field"), "ts", "value", later, "date")


def write_points(points: DataFrame, path: str, tags: tuple[str, ...] = READING_TAGS, later: str = "event_id") -> int:
    """Store de-duplicated points by measurement and day, in one commit; the version.

    Only the days present in the batch are replaced: writing the same batch twice
    leaves the same rows. The rebalance hint clusters rows by day and lets AQE
    split a busy day and merge quiet ones. The batch is read once more for the names
    of its fields. ``tags`` name the columns that with the
    measurement, field and second identify a point (readings, forecasts and errors
    each have theirs); of two points the one larger in ``later`` stays.
    """
    return points_store(points.sparkSession, path).commit(_by_day(points, tags, later, _names(points)))


def upsert_points(points: DataFrame, path: str, tags: tuple[str, ...] = READING_TAGS, later: str = "event_id") -> int:
    """Merge a batch (for instance late history) into stored points, touching only its days; the version.

    The days and fields come back to the driver (a calendar is short), so the rest
    of the stored table is not opened. A table that does not exist yet is begun. Where
    another writer has changed one of these days meanwhile, the merge starts again
    from what it left.
    """
    store = points_store(points.sparkSession, path)
    found = points.select(F.to_date("ts").alias("date"), "measurement", "field").distinct().collect()
    days, new = {str(r["date"]) for r in found}, {(r["measurement"], r["field"]) for r in found}
    columns = ["measurement", *tags, "field", "ts", "value", later]
    while True:
        base = store.version() or 0
        merged, names = points.select(*columns), new
        if base:
            touched = store.read(lambda part: part["date"] in days, base)  # noqa: B023
            merged, names = touched.select(*columns).unionByName(merged), new | _names(touched)
        try:
            return store.commit(_by_day(merged, tags, later, names), base=base)
        except ConcurrentChange:
            continue


def apply_retention(points: DataFrame, days: int, now: str | datetime) -> DataFrame:
    """Keep points of the last ``days`` days; on a table stored by date whole days are skipped."""
    edge = F.lit(str(now)).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    kept = points.filter(F.col("ts") >= edge)
    return kept.filter(F.col("date") >= F.to_date(edge)) if "date" in points.columns else kept


def delete_expired(spark: SparkSession, path: str, days: int, now: str | datetime, grace_seconds: float = 86_400) -> int:
    """Remove stored points older than ``days`` days for good, in one commit; how many day folders went.

    Days wholly before the edge are left out unread, and the day of the edge is rewritten without its older points.
    The files go once neither the newest version nor the one before it lists them.
    """
    edge = F.lit(str(now)).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    border = str(spark.range(1).select(F.to_date(edge).alias("d")).first()["d"])
    store = points_store(spark, path)
    while base := store.version():
        gone = sum(part["date"] < border for part in map(store.values, store.parts(base)))
        stored = store.read(lambda part: part["date"] == border, base)
        if not gone and stored.filter(F.col("ts") < edge).isEmpty():
            return 0
        try:
            store.commit(stored.filter(F.col("ts") >= edge), lambda part: part["date"] <= border, base)
        except ConcurrentChange:
            continue
        store.vacuum(grace_seconds=grace_seconds)
        return gone
    return 0
