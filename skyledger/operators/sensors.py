"""Sensor diagnostics, calibration report and the sensor dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import battery_health, normalize_mac, same_text
from ..session import materialize
from .filters import _instant, range_issues
from .ordered import max_gap
from .windows import latest_n, latest_per_sensor

SENSOR_COLUMNS = ["name", "location", "status", "enabled", "last_seen", "notes", "battery_level"]


# --- diagnostics -----------------------------------------------------------

def signal_test(readings: DataFrame, n: int = 5) -> DataFrame:
    """Mean above -80 dBm and spread under 20 dBm over the newest readings with a signal."""
    newest = latest_n(readings.filter(F.col("rssi").isNotNull()).select("mac", "ts", "event_id", "rssi"), n)
    out = newest.groupBy("mac").agg(
        F.avg("rssi").alias("average_rssi"), (F.max("rssi") - F.min("rssi")).alias("rssi_spread")
    )
    return out.withColumn("passed", (F.col("average_rssi") > -80) & (F.col("rssi_spread") < 20))


def consistency_test(readings: DataFrame, n: int = 10) -> DataFrame:
    """Spread of the newest readings; fewer than three readings cannot pass."""
    limits = {"temperature": 5.0, "humidity": 10.0, "pressure": 50.0}
    newest = latest_n(readings.select("mac", "ts", "event_id", *limits), n)
    spread = [F.coalesce(F.max(c) - F.min(c), F.lit(0.0)).alias(f"{c}_spread") for c in limits]
    out = newest.groupBy("mac").agg(F.count("*").alias("readings"), *spread)
    ok = F.col("readings") >= 3
    for c, limit in limits.items():
        ok = ok & (F.col(f"{c}_spread") < limit)
    return out.withColumn("passed", ok)


def range_test(readings: DataFrame) -> DataFrame:
    return range_issues(latest_per_sensor(readings))


def battery_test(readings: DataFrame) -> DataFrame:
    """Battery band of the newest reading; an unknown voltage fails."""
    newest = latest_per_sensor(readings.select("mac", "ts", "event_id", "battery_voltage"))
    return newest.withColumn("b", battery_health(F.col("battery_voltage"))).select(
        "mac", "battery_voltage", "b.health", "b.months_left", "b.passed"
    )


def interval_test(readings: DataFrame, mean_limit: float = 5.0, max_limit: float = 10.0) -> DataFrame:
    """Seconds between stored readings of a sensor; one reading has no interval and fails."""
    gaps = max_gap(readings.select("mac", "ts"), ["mac"])
    ok = (F.col("mean_gap") < mean_limit) & (F.col("max_gap") < max_limit)
    return gaps.withColumn("passed", F.coalesce(ok, F.lit(False)))


def calibration(readings: DataFrame, mean_limit: float = 5.0, max_limit: float = 10.0) -> DataFrame:
    """Five verdicts per sensor and the overall result.

    Signal, consistency, range and battery share one table of each sensor's newest readings: the tests look at no
    other. The newest five with a signal may be older than the newest ten, so each group keeps both.
    """
    needed = readings.select("mac", "ts", "event_id", "temperature", "humidity", "pressure", "battery_voltage", "rssi")
    newest = materialize(latest_n(needed, 10), "newest")
    heard = latest_n(needed.filter(F.col("rssi").isNotNull()), 5)
    parts = {
        "signal": signal_test(heard), "consistency": consistency_test(newest), "range": range_test(newest),
        "battery": battery_test(newest), "interval": interval_test(readings, mean_limit, max_limit),
    }
    verdicts = None
    for name, part in parts.items():
        one = part.select("mac", F.lit(name).alias("test"), "passed")
        verdicts = one if verdicts is None else verdicts.unionByName(one)
    # at most five short rows a sensor meet in one aggregate; a missing verdict is a failure
    out = verdicts.groupBy("mac").agg(*[
        F.coalesce(F.bool_or(F.when(F.col("test") == name, F.col("passed"))), F.lit(False)).alias(name) for name in parts])
    total = sum((F.col(p).cast("int") for p in parts), F.lit(0))
    return out.withColumn("tests_passed", total).withColumn("tests_total", F.lit(len(parts))).withColumn(
        "passed", F.col("tests_passed") == F.col("tests_total")
    )


# --- dimension -------------------------------------------------------------

def active(sensors: DataFrame) -> DataFrame:
    return sensors.filter(F.col("enabled") & (F.col("status") == "active"))


def stale_sensors(sensors: DataFrame, hours: int, now: str) -> DataFrame:
    """Seen, but not within ``hours``; a sensor never seen is not stale."""
    return sensors.filter(F.col("last_seen") < _instant(now) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def by_name(sensors: DataFrame, name: str) -> DataFrame:
    return sensors.filter(same_text(F.col("name"), F.lit(name)))


def by_location(sensors: DataFrame, location: str) -> DataFrame:
    return sensors.filter(same_text(F.col("location"), F.lit(location)))


def dashboard(sensors: DataFrame, readings: DataFrame) -> DataFrame:
    """Every registered sensor with its newest reading, or ``No data``."""
    newest = latest_per_sensor(
        readings.select("mac", "ts", "event_id", "temperature", "humidity", "pressure", "battery_voltage", "rssi")
    )
    short = F.concat(F.substring("mac", 1, 8), F.lit("..."))
    return sensors.select("mac", "name").join(newest.drop("event_id"), "mac", "left").withColumns({
        "name": F.coalesce("name", short),
        "last_update": F.coalesce(F.date_format("ts", "HH:mm:ss"), F.lit("No data")),
    }).drop("ts")


def activity(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Newest reading per sensor seen; an unregistered one is named by its address."""
    newest = latest_per_sensor(readings.select("mac", "ts", "event_id", "temperature", "humidity", "rssi"))
    short = F.concat(F.substring("mac", 1, 8), F.lit("..."))
    return newest.join(sensors.select("mac", "name"), "mac", "left").withColumn("name", F.coalesce("name", short))


def new_sensors(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Sensors heard but not registered."""
    heard = readings.groupBy("mac").agg(F.count("*").alias("readings"))
    return heard.join(sensors.select("mac"), "mac", "left_anti")


def seen_sensors(sensors: DataFrame, readings: DataFrame) -> DataFrame:
    """Registered sensors that were heard."""
    return sensors.join(readings.select("mac").distinct(), "mac", "left_semi")


def reconcile(written: DataFrame, stored: DataFrame, minutes: int = 2,
              expected: list[str] = ("temperature", "humidity", "pressure")) -> DataFrame:
    """Is each written sample (one per sensor) found in storage within the tolerance?

    Both sides meet on (sensor, minute), so the points of a busy sensor spread
    over its minutes and only those near the sample survive the join.
    """
    written = materialize(written.select("mac", "ts"), "samples")  # one row per sensor, read twice
    slack = F.expr(f"INTERVAL {int(minutes)} MINUTES")
    minute = F.expr("INTERVAL 1 MINUTE")
    span = F.sequence(F.date_trunc("minute", F.col("ts") - slack), F.date_trunc("minute", F.col("ts") + slack), minute)
    samples = written.select("mac", F.col("ts").alias("sample_ts"))
    wanted = written.select("mac", F.col("ts").alias("sample_ts"), F.explode(span).alias("minute"))
    environmental = stored.filter(F.col("measurement") == "environmental").select(
        "mac", F.col("ts").alias("point_ts"), "field", F.date_trunc("minute", "ts").alias("minute")
    )
    near = wanted.join(environmental, ["mac", "minute"]).filter(
        (F.col("point_ts") >= F.col("sample_ts") - slack) & (F.col("point_ts") < F.col("sample_ts") + slack)
    )
    # one partial row per sensor: a count and a set of at most the known field names
    found = near.groupBy("mac").agg(F.count("*").alias("found"), F.collect_set("field").alias("fields"))
    out = samples.join(found, "mac", "left")
    names = F.array(*[F.lit(f) for f in expected])
    have = F.coalesce("fields", F.array().cast("array<string>"))
    return out.select(
        "mac", F.coalesce("found", F.lit(0)).alias("found"), F.col("found").isNotNull().alias("verified"),
        F.array_sort(F.array_except(names, have)).alias("missing_fields"),
    )


def merge_sensors(current: DataFrame, imported: DataFrame, merge: bool = True) -> DataFrame:
    """Imported rows replace current ones with the same address; without ``merge`` they replace everything."""
    if not merge:
        return imported
    columns = [c for c in current.columns if c != "mac"]
    left = current.select("mac", F.struct(*columns).alias("old"))
    right = imported.select("mac", F.struct(*columns).alias("new"))
    joined = left.join(right, "mac", "full").withColumn("row", F.coalesce("new", "old"))
    return joined.select("mac", *[F.col(f"row.{c}").alias(c) for c in columns])


def newer_config(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Of two one-row configurations the one updated later (the current one on a tie)."""
    both = current.withColumn("_rank", F.lit(1)).unionByName(imported.withColumn("_rank", F.lit(0)))
    return both.orderBy(F.desc("last_updated"), F.desc("_rank")).limit(1).drop("_rank")


def apply_changes(sensors: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply adds, updates and removals; returns the new dimension and the rejects.

    ``changes(change_id, mac, action, name, location, status)``: the latest
    change per address counts. Adding a known address, changing an unknown one
    or an unreadable address is rejected.
    """
    clean = changes.withColumn("key", normalize_mac(F.col("mac")))
    payload = F.struct("change_id", "mac", "action", "name", "location", "status")
    # one slot per unreadable address keeps each of them as its own reject
    latest = (
        clean.withColumn("slot", F.coalesce("key", F.concat(F.lit("?"), F.col("change_id").cast("string"))))
        .groupBy("slot").agg(F.max_by(payload, "change_id").alias("c"), F.first("key").alias("key"))
    )
    known = sensors.select("mac", F.struct(*[c for c in sensors.columns if c != "mac"]).alias("s"))
    joined = known.join(latest, known["mac"] == latest["key"], "full")
    exists, action = F.col("s").isNotNull(), F.col("c.action")
    reason = (
        F.when(F.col("c").isNull(), None)
        .when(F.col("key").isNull(), "invalid_mac")
        .when((action == "add") & exists, "already_exists")
        .when(action.isin("update", "remove") & ~exists, "not_found")
        .when(~action.isin("add", "update", "remove"), "unknown_action")
    )
    judged = joined.select(known["mac"].alias("known_mac"), "key", "s", "c", reason.alias("reason"))
    rejects = judged.filter(F.col("reason").isNotNull()).select("c.change_id", "c.mac", "c.action", "reason")
    applies = F.col("c").isNotNull() & F.col("reason").isNull()
    kept = judged.filter(exists | (applies & (F.col("c.action") == "add"))).filter(
        ~(applies & (F.col("c.action") == "remove"))
    )

    def value(column: str) -> Column:
        old = F.col(f"s.{column}")
        if column not in ("name", "location", "status"):
            defaults = {"enabled": F.lit(True), "notes": F.lit("")}
            return F.when(exists, old).otherwise(defaults.get(column, F.lit(None)))
        new = F.when(applies, F.col(f"c.{column}"))
        defaults = {"location": F.lit(""), "status": F.lit("unknown")}
        return F.coalesce(new, old, defaults.get(column, F.lit(None)))

    columns = [c for c in sensors.columns if c != "mac"]
    out = kept.select(F.coalesce("known_mac", "key").alias("mac"), *[value(c).alias(c) for c in columns])
    return out, rejects


def refresh_last_seen(sensors: DataFrame, readings: DataFrame) -> DataFrame:
    heard = readings.groupBy("mac").agg(F.max("ts").alias("heard"))
    joined = sensors.join(heard, "mac", "left")
    return joined.withColumn("last_seen", F.greatest("last_seen", "heard")).drop("heard")


def system_status(sensors: DataFrame, points: DataFrame) -> DataFrame:
    """(item, value) of the status screen."""
    dimension = sensors.agg(
        F.count("*").alias("sensors"), F.count_if(F.col("enabled") & (F.col("status") == "active")).alias("active_sensors")
    ).unpivot([], ["sensors", "active_sensors"], "item", "value")
    per_sensor = points.groupBy("mac").agg(F.count("*").alias("n"))
    stored = per_sensor.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("points_written"), F.count("*").alias("devices")
    ).unpivot([], ["points_written", "devices"], "item", "value")
    return dimension.unionByName(stored)
