"""The logical views as common table expressions for the check engine."""

from __future__ import annotations

from ..schemas import FIELD_MEASUREMENT
from . import views as v


def _select(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(v.select_sql(columns))} FROM {table}"





_POINTS = " UNION ALL ".join(
    f"SELECT event_id, mac, data_format, ts, '{measurement}' AS measurement, '{field}' AS field, "
    f"cast({field} AS double) AS value FROM readings WHERE {field} IS NOT NULL"
    for field, measurement in FIELD_MEASUREMENT.items()
)


def _hourly(table: str, keys: str = "", where: str = "") -> str:
    return (
        f"SELECT time_bucket(interval '1 hour', ts) + interval '1 hour' AS ts{keys}, avg(temperature) AS temperature, "
        f"avg(pressure) AS pressure, avg(humidity) AS humidity FROM {table} {where} GROUP BY ALL"
    )


def _errors(table: str) -> str:
    cols = []
    for short, name in (("temp", "temperature"), ("pressure", "pressure"), ("humidity", "humidity")):
        cols.append(f"abs(a.{name} - f.{name}) AS {short}_abs_error, f.{name} - a.{name} AS {short}_signed_error")
    return (
        f"SELECT * FROM (SELECT a.ts, f.horizon_hours, f.source, {', '.join(cols)} "
        f"FROM actual_hourly a JOIN {table} f ON f.ts = a.ts WHERE f.horizon_hours IN (1, 6, 24, 48)) "
        "WHERE coalesce(temp_abs_error, pressure_abs_error, humidity_abs_error) IS NOT NULL"
    )


CTES = {
    "readings": _select(v.READINGS, "events"),
    "points": _POINTS,
    "forecast_points": _select(v.FORECAST_POINTS, "events"),
    "actual_hourly": _hourly("readings"),
    "forecast_hourly": _hourly("forecast_points", ", horizon_hours, source", "WHERE data_type = 'forecast'"),
    "forecast_errors": _errors("forecast_hourly"),
    "errors_long": " UNION ALL ".join(
        f"SELECT ts, horizon_hours, source, '{name}' AS metric, {short}_abs_error AS absolute_error, "
        f"{short}_signed_error AS signed_error FROM forecast_errors WHERE {short}_abs_error IS NOT NULL"
        for short, name in (("temp", "temperature"), ("pressure", "pressure"), ("humidity", "humidity"))
    ),
    "sensors": _select(v.SENSORS, "customer"),
    "env_wide": _select(v.ENV_WIDE, "lineitem"),
    "op_metrics": _select(v.OP_METRICS, "events"),
    "chunks": "SELECT *, max(chunk_id) OVER (PARTITION BY transfer_id) AS total FROM ("
    + _select({**v.CHUNKS, "payload": "lpad(hex(l_partkey), 8, '0')"}, "lineitem") + ")",
    "frame_ints": _select(v.FRAME_INTS, "events"),
}

REQUIRES = {
    "points": ["readings"],
    "actual_hourly": ["readings"],
    "forecast_hourly": ["forecast_points"],
    "forecast_errors": ["actual_hourly", "forecast_hourly"],
    "errors_long": ["forecast_errors"],
}

# Intermediate tables several checks share.
CTES["edges"] = (
    "SELECT " + ", ".join(
        f"quantile_cont({c}, 1/3.0e0) AS {c}1, quantile_cont({c}, 2/3.0e0) AS {c}2"
        for c in ("temperature", "humidity", "pressure")
    ) + " FROM env_wide"
)
CTES["binned"] = (
    "SELECT e.*, " + ", ".join(
        f"CASE WHEN e.{c} IS NULL THEN NULL WHEN e.{c} <= x.{c}1 THEN 'low' WHEN e.{c} <= x.{c}2 THEN 'medium' "
        f"ELSE 'high' END AS {c}_binned"
        for c in ("temperature", "humidity", "pressure")
    ) + " FROM env_wide e, edges x"
)
REQUIRES["edges"] = ["env_wide"]
REQUIRES["binned"] = ["env_wide", "edges"]


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in REQUIRES.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(names: str, body: str, **extra: str) -> str:
    """``body`` preceded by the views it names (space separated) and any extra ones."""
    ctes = [f"{n} AS ({CTES[n]})" for n in _closure(names.split())]
    ctes += [f"{n} AS ({text})" for n, text in extra.items()]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body

