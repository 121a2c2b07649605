"""Extension points: batch callbacks, progress as a table, SQL functions and views."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.scalars import BATTERY_BANDS

log = logging.getLogger(__name__)


class BatchCallbacks:
    """Functions run on every micro-batch; one that fails does not stop the others."""

    def __init__(self) -> None:
        self._callbacks: dict[str, Callable[[DataFrame, int], None]] = {}
        self.failures: list[tuple[str, int, str]] = []

    def add(self, name: str, callback: Callable[[DataFrame, int], None]) -> None:
        self._callbacks[name] = callback

    def remove(self, name: str) -> None:
        self._callbacks.pop(name, None)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # several callbacks read the batch; keep it rather than recompute it per callback
        batch.persist()
        try:
            for name, callback in list(self._callbacks.items()):
                try:
                    callback(batch, batch_id)
                except Exception as error:  # isolation is the point
                    log.warning("callback %s failed on batch %s: %s", name, batch_id, error)
                    self.failures.append((name, batch_id, str(error)))
        finally:
            batch.unpersist()


class ProgressLog(StreamingQueryListener):
    """Query progress as operation-metric rows, appended to a table; only the last ``held`` rows wait on the driver."""

    SCHEMA = "metric string, ts string, duration double, points long, late_rows long, success boolean"

    def __init__(self, spark: SparkSession, path: str, held: int = 100) -> None:
        self.spark, self.path, self.held = spark, path, held
        self.rows: list[tuple] = []
        self._lock = threading.Lock()
        self.ended = threading.Event()  # a query has ended and all its progress is here

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self._add((p.name or str(p.id), p.timestamp, p.batchDuration / 1000.0, p.numInputRows, late, True))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._add((str(event.id), None, 0.0, 0, 0, False))
        self.ended.set()

    def _add(self, row: tuple) -> None:
        with self._lock:
            self.rows.append(row)
            full = len(self.rows) >= self.held
        if full:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).selectExpr(
            "metric", "cast(ts as timestamp) as ts", "duration", "points", "late_rows", "success"
        )


def register_functions(spark: SparkSession) -> list[str]:
    """SQL functions for the scalar helpers; the optimiser inlines their bodies."""
    bands = " ".join(f"WHEN v >= {bound} THEN '{name}'" for bound, name, _, _ in BATTERY_BANDS)
    bodies = {
        "battery_band": ("v DOUBLE", "STRING", f"CASE WHEN v IS NULL THEN NULL {bands} ELSE 'Critical' END"),
        "normalize_mac": (
            "m STRING", "STRING",
            "CASE WHEN length(regexp_replace(upper(m), '[^0-9A-Z]', '')) = 12 "
            "THEN regexp_replace(regexp_replace(upper(m), '[^0-9A-Z]', ''), '(..)(?=.)', '$1:') END",
        ),
        "abs_error": ("actual DOUBLE, forecast DOUBLE", "DOUBLE", "abs(actual - forecast)"),
        "signed_error": ("actual DOUBLE, forecast DOUBLE", "DOUBLE", "forecast - actual"),
        "horizon_hours": ("run TIMESTAMP, valid TIMESTAMP", "INT", "CAST(timestampdiff(HOUR, run, valid) AS INT)"),
        "battery_from_word": ("w INT", "DOUBLE", "(shiftright(w, 5) + 1600) / 1000.0D"),
        "tx_power_from_word": ("w INT", "INT", "(w & 31) * 2 - 40"),
    }
    for name, (params, result, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return list(bodies)


# SQL table functions: parameters, result and the query over the registered views ``points`` and ``forecast_errors``.
_BUCKET = "timestamp_seconds((floor(unix_timestamp(ts) / every) + 1) * every)"
TABLE_FUNCTIONS = {
    "window_mean": (
        "wanted STRING, every BIGINT, since TIMESTAMP, until TIMESTAMP", "mac STRING, ts TIMESTAMP, mean DOUBLE",
        f"SELECT mac, {_BUCKET} AS ts, avg(value) AS mean FROM points WHERE field = wanted AND points.ts >= since "
        f"AND points.ts < until GROUP BY mac, {_BUCKET}",
    ),
    "horizon_report": (
        "since TIMESTAMP, until TIMESTAMP",
        "horizon_hours INT, records BIGINT, temp_mae DOUBLE, temp_max_error DOUBLE, temp_bias DOUBLE, pressure_mae DOUBLE, "
        "humidity_mae DOUBLE, direction STRING",
        "SELECT horizon_hours, count(*), avg(temp_abs_error), max(temp_abs_error), avg(temp_signed_error), avg(pressure_abs_error), "
        "avg(humidity_abs_error), CASE WHEN avg(temp_signed_error) > 0 THEN 'over-prediction' ELSE 'under-prediction' END "
        "FROM forecast_errors WHERE ts >= since AND ts < until GROUP BY horizon_hours",
    ),
    "alert_windows": (
        "horizon INT, every BIGINT, threshold DOUBLE", "source STRING, ts TIMESTAMP, mae DOUBLE",
        f"SELECT source, {_BUCKET} AS ts, avg(temp_abs_error) AS mae FROM forecast_errors WHERE horizon_hours = horizon "
        f"GROUP BY source, {_BUCKET} HAVING avg(temp_abs_error) > threshold",
    ),
}


def register_table_functions(spark: SparkSession, views: dict[str, DataFrame]) -> list[str]:
    """Table operators to be called from SQL alone: ``SELECT * FROM window_mean('temperature', 3600, since, until)``.

    ``views`` holds the tables they read. Widths are seconds, ranges half-open, windows are named by their end.
    """
    register_views(views)
    for name, (params, result, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE({result}) RETURN {body}")
    return list(TABLE_FUNCTIONS)


def register_views(views: dict[str, DataFrame]) -> None:
    """Tables and operator results under SQL names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
