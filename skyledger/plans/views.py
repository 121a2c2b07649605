"""Logical views over the given tables.

Each view is map-only or pre-aggregated, so it scales with the table it reads.
The scalar expressions are written in the SQL both Spark and the check engine
accept; the same text therefore defines a view on both sides.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align
from ..session import materialize, prepare, scratch_path
from ..sources.points import readings_to_points
from ..streaming.live import read_stream

NOW = "2024-01-31 00:00:00"
RANGE_START, RANGE_STOP = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
HORIZONS = [1, 6, 24, 48]


def mac_sql(x: str) -> str:
    """A sensor id from an integer key: five bytes, so ids stay distinct at any scale."""
    digits = f"lpad(hex({x}),10,'0')"
    return "concat('AA'," + ",".join(f"':',substr({digits},{i},2)" for i in (1, 3, 5, 7, 9)) + ")"


_F5 = "event_id % 5 <> 0"

# Adding zero turns a rounded -0.0 into 0.0 on both sides.
READINGS = {
    "event_id": "event_id",
    "mac": mac_sql("user_id"),
    "ts": "cast(ts as timestamp)",
    "data_format": "cast(case when event_id % 5 = 0 then 3 else 5 end as int)",
    "temperature": "case when event_id % 17 <> 0 then round(value * 0.6 - 10, 3) + 0.0e0 end",
    "humidity": "case when event_id % 13 <> 0 then round(value + event_id % 10, 2) end",
    "pressure": "case when event_id % 19 <> 0 then round(950 + value * 0.5 + event_id % 7, 3) end",
    "acceleration_x": "(event_id % 2001 - 1000) / 1000.0e0",
    "acceleration_y": "((event_id * 3) % 2001 - 1000) / 1000.0e0",
    "acceleration_z": "((event_id * 7) % 2001 - 1000) / 1000.0e0",
    "battery_voltage": "case when event_type <> 'error' then round(2.2 + value * 0.01, 4) end",
    "tx_power": f"case when {_F5} then cast((event_id % 32) * 2 - 40 as int) end",
    "movement_counter": f"case when {_F5} then cast(event_id % 256 as int) end",
    "measurement_sequence": f"case when {_F5} then cast(event_id % 65536 as int) end",
    "rssi": "cast(-40 - floor(value * 0.4) as int)",
}

_H = "(case event_id % 4 when 0 then 1 when 1 then 6 when 2 then 24 else 48 end)"

FORECAST_POINTS = {
    "event_id": "event_id",
    "ts": "cast(date_trunc('hour', ts) as timestamp)",
    "run_time": f"cast(date_trunc('hour', ts) as timestamp) - {_H} * interval '1' hour",
    "horizon_hours": f"cast({_H} as int)",
    "source": "case when user_id % 3 = 0 then 'provider_a' else 'provider_b' end",
    "data_type": "case when event_id % 10 = 0 then 'historical' else 'forecast' end",
    "temperature": f"round(value * 0.6 - 10 + (event_id % 11 - 5) * 0.05 * {_H}, 3) + 0.0e0",
    "humidity": "round(value + event_id % 9, 2)",
    "pressure": "round(950 + value * 0.5 - event_id % 5, 3)",
    "weather_code": "case when event_id % 6 <> 0 then cast(event_id % 100 as int) end",
}

SENSORS = {
    "mac": mac_sql("c_custkey"),
    "name": "c_name",
    "location": "c_mktsegment",
    "status": "case c_nationkey % 4 when 2 then 'inactive' when 3 then 'error' else 'active' end",
    "enabled": "c_nationkey % 5 <> 0",
    "last_seen": "case when c_custkey % 7 <> 0 then "
    "timestamp '2024-01-31 00:00:00' - (c_custkey % 72) * interval '1' hour end",
    "notes": "case when c_custkey % 3 = 0 then 'roof' else '' end",
    "battery_level": "case when c_custkey % 5 <> 0 then round(c_acctbal / 100.0e0, 4) end",
}

ENV_WIDE = {
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "ts": "cast(l_shipdate as timestamp)",
    "temperature": "case when (l_orderkey + l_partkey) % 23 <> 0 then l_quantity end",
    "humidity": "l_discount * 100",
    "pressure": "case when l_partkey % 29 <> 0 then l_extendedprice end",
}

OP_METRICS = {
    "event_id": "event_id",
    "ts": "cast(ts as timestamp)",
    "metric": "event_type",
    "duration": "value",
    "points": "event_id % 50",
    "success": "event_id % 9 <> 0 and event_id % 400 > 12",
}

CHUNKS = {
    "transfer_id": "l_orderkey",
    "chunk_id": "l_linenumber",
    "tie": "l_partkey * 100000 + l_suppkey",
    "payload": "unhex(lpad(hex(l_partkey), 8, '0'))",
}

# Integers a frame is built from; the expected decode is computed from them.
FRAME_INTS = {
    "frame_id": "event_id",
    "address": f"lower({mac_sql('user_id')})",
    "received_at": "cast(ts as timestamp)",
    "rssi": "cast(-40 - floor(value * 0.4) as int)",
    "fmt": "case when event_id % 23 = 0 then 99 when event_id % 5 = 0 then 3 else 5 end",
    "other": "event_id % 11 = 0",
    "kept_bytes": "case when event_id % 29 = 0 then 0 when event_id % 7 = 0 then 10 else 24 end",
    "t_raw": "(event_id * 37 + cast(round(value * 100) as bigint)) % 65536",
    "h_raw": "(event_id * 53 + cast(round(value * 100) as bigint)) % 65536",
    "p_raw": "(event_id * 71) % 65536",
    "x_raw": "(event_id * 13) % 65536",
    "y_raw": "(event_id * 17) % 65536",
    "z_raw": "(event_id * 19) % 65536",
    "w_raw": "(event_id * 29) % 65536",
    "move": "event_id % 256",
    "seq": "event_id % 65536",
    "mac_raw": "user_id + 187723572702975",
}

HISTORY_INTS = {
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_partkey": "l_partkey",
    "base_seconds": "1700000000 + l_suppkey",
    "n_records": "l_linenumber",
}

# Integers of record k inside a blob.
HISTORY_RECORD_INTS = {
    "offset_s": "(l_orderkey * 60 + k * 10) % 4294967296",
    "t_raw": "(l_partkey * 31 + k * 7) % 65536",
    "h_raw": "(l_partkey * 5 + k) % 65536",
    "p_raw": "(l_orderkey * 3 + k) % 65536",
    "x_raw": "(l_orderkey * 11 + k) % 65536",
    "y_raw": "(l_orderkey * 13 + k) % 65536",
    "z_raw": "(l_orderkey * 17 + k) % 65536",
    "w_raw": "(l_partkey * 19 + k) % 65536",
    "move": "(l_partkey + k) % 65536",
    "seq": "(l_orderkey + k) % 65536",
}


def select_sql(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def _be(expr: str, digits: int) -> str:
    return f"lpad(hex({expr}), {digits}, '0')"


def _le_text(fields: list[tuple[str, int]]) -> str:
    """Little-endian fields of 2 or 4 bytes, zeros up to a multiple of eight bytes, as hexadecimal text; null if any field is.

    Four pairs of bytes make a long, whose bytes are then swapped within the pairs all at once.
    """
    pairs = [f"shiftright({expr}, {16 * i}) & 65535" if i else f"({expr}) & 65535" for expr, width in fields for i in range(width // 2)]
    pairs += ["0L"] * (-len(pairs) % 4)
    longs = [" | ".join(f"shiftleft({p}, {48 - 16 * j})" for j, p in enumerate(pairs[i:i + 4])) for i in range(0, len(pairs), 4)]
    low = 0x00FF00FF00FF00FF
    swapped = f"shiftleft(w & {low}L, 8) | shiftrightunsigned(w, 8) & {low}L"
    return "concat(" + ",".join(f"lpad(hex(transform(array({x}), w -> {swapped})[0]), 16, '0')" for x in longs) + ")"


class Tables:
    """The logical views, built lazily from one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A given table as a stream. A pattern, as the table may be one file and a plain path must be a folder."""
        return read_stream(self.spark, f"{self.sf_dir}/[{name[0]}]{name[1:]}.parquet", self.raw(name).schema)

    def streamed(self, df: DataFrame, name: str) -> DataFrame:
        """A derived table, landed as files, as a stream."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        return read_stream(self.spark, path, df.schema)

    @property
    def stream_readings(self) -> DataFrame:
        return self.stream("events").selectExpr(*select_sql(READINGS))

    @cached_property
    def readings(self) -> DataFrame:
        return self.raw("events").selectExpr(*select_sql(READINGS))

    @cached_property
    def points(self) -> DataFrame:
        return readings_to_points(self.readings)

    @cached_property
    def forecast_points(self) -> DataFrame:
        return self.raw("events").selectExpr(*select_sql(FORECAST_POINTS))

    @cached_property
    def actual_hourly(self) -> DataFrame:
        return align.hourly_means(self.readings)

    @cached_property
    def forecast_hourly(self) -> DataFrame:
        forecasts = self.forecast_points.filter("data_type = 'forecast'")
        return align.hourly_means(forecasts, keys=["horizon_hours", "source"])

    @cached_property
    def forecast_errors(self) -> DataFrame:
        aligned = align.align_run(self.actual_hourly, self.forecast_hourly, HORIZONS)
        return align.forecast_errors(aligned, keys=["source"])

    @cached_property
    def sensors(self) -> DataFrame:
        return self.raw("customer").selectExpr(*select_sql(SENSORS))

    @cached_property
    def env_wide(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*select_sql(ENV_WIDE))

    @cached_property
    def op_metrics(self) -> DataFrame:
        return self.raw("events").selectExpr(*select_sql(OP_METRICS))

    @cached_property
    def chunks(self) -> DataFrame:
        """Every line of an order is a chunk; the last line number is the total, so lost numbers leave gaps."""
        sent = self.raw("lineitem").selectExpr(*select_sql(CHUNKS))
        totals = sent.groupBy("transfer_id").agg(F.max("chunk_id").alias("total"))
        return sent.join(totals, "transfer_id")

    @cached_property
    def frames(self) -> DataFrame:
        ints = self.raw("events").selectExpr(*select_sql(FRAME_INTS))
        acc = [_be(c, 4) for c in ("x_raw", "y_raw", "z_raw")]
        five = [_be("fmt", 2), _be("t_raw", 4), _be("h_raw", 4), _be("p_raw", 4), *acc,
                _be("w_raw", 4), _be("move", 2), _be("seq", 4), _be("mac_raw", 12)]
        three = ["'03'", _be("h_raw % 256", 2), _be("t_raw % 256", 2), _be("shiftright(t_raw, 8) % 100", 2),
                 _be("p_raw", 4), *acc, _be("w_raw", 4)]
        text = f"case when fmt = 3 then concat({','.join(three)}) else concat({','.join(five)}) end"
        frame = ints.selectExpr("*", f"unhex(substring({text}, 1, kept_bytes * 2)) AS body")
        # a foreign manufacturer's data may ride along; it must be ignored
        return materialize(frame.selectExpr(
            "frame_id", "address", "rssi", "received_at",
            "case when other then map(76, body) else map(1177, body, 76, unhex('01020304')) end"
            " AS manufacturer_data",
        ), "frames")

    @cached_property
    def history_blobs(self) -> DataFrame:
        k = HISTORY_RECORD_INTS
        widths = [("offset_s", 4), ("t_raw", 2), ("h_raw", 2), ("p_raw", 2), ("x_raw", 2), ("y_raw", 2),
                  ("z_raw", 2), ("w_raw", 2), ("move", 2), ("seq", 2)]
        record = _le_text([(f"({k[name]})", width) for name, width in widths])
        body = f"array_join(transform(sequence(0L, cast(n_records - 1 as bigint)), k -> {record}), '')"
        partial = "case when l_orderkey % 5 = 0 then 'AABBCC' else '' end"
        return self.raw("lineitem").selectExpr(*select_sql(HISTORY_INTS)).selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey", "base_seconds",
            f"unhex(concat({body}, {partial})) AS payload",
        )

    @cached_property
    def forecast_docs(self) -> DataFrame:
        """Provider responses of at most 100 hours, as JSON text.

        Ids are unique, so a document's id block bounds the collected list.
        Some documents are ragged, some hold an unreadable time.
        """
        hour = F.struct("event_id", "ts", "temperature", "humidity", "pressure", "weather_code")
        docs = (
            self.forecast_points.withColumn("block", F.expr("event_id div 100"))
            .groupBy("source", "block")
            .agg(F.array_sort(F.collect_list(hour)).alias("h"))
        )
        times = F.transform("h", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm'Z'"))
        times = F.when(
            F.col("block") % 5 == 0,
            F.concat(F.array(F.lit("not-a-time")), F.slice(times, F.lit(2), F.size("h"))),
        ).otherwise(times)
        humidity = F.col("h.humidity")
        ragged = F.when(F.col("block") % 3 == 0, F.slice(humidity, F.lit(1), F.size("h") - 1)).otherwise(humidity)
        last = F.element_at("h", -1)
        hourly = F.struct(
            times.alias("time"), F.col("h.temperature").alias("temperature_2m"),
            ragged.alias("relativehumidity_2m"), F.col("h.pressure").alias("surface_pressure"),
            F.col("h.weather_code").alias("weathercode"),
        )
        current = F.struct(
            F.date_format(last["ts"], "yyyy-MM-dd'T'HH:mm'Z'").alias("time"),
            last["temperature"].alias("temperature"), F.lit(3.5).alias("windspeed"),
            F.lit(180.0).alias("winddirection"), last["weather_code"].alias("weathercode"),
        )
        body = F.struct(
            F.lit("Europe/Helsinki").alias("timezone"), F.lit(60.17).alias("latitude"),
            F.lit(24.94).alias("longitude"), hourly.alias("hourly"), current.alias("current_weather"),
        )
        return docs.select(
            F.concat_ws("-", "source", "block").alias("doc_id"), "source", F.to_json(body).alias("doc")
        )
