"""Registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Tables


@dataclass
class Query:
    build: Callable[[Tables], DataFrame]
    oracle: str | None
    rounded: list[str] = field(default_factory=list)
    digits: int = 6


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, rounded: str = "", digits: int = 6):
    """Register a query; ``rounded`` columns are rounded on both sides before they are compared."""
    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = Query(build, oracle, rounded.split(), digits)
        return build

    return add


def _offset(digits: int) -> float:
    # keeps exact ties on one side whatever the order of summation
    return 10.0 ** -(digits + 3)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = QUERIES[name]
    df = q.build(Tables(spark, sf_dir))
    if q.rounded:
        df = df.withColumns({c: F.round(F.col(c) + F.lit(_offset(q.digits)), q.digits) for c in q.rounded})
    return df


def oracle(name: str) -> str | None:
    q = QUERIES[name]
    if q.oracle is None or not q.rounded:
        return q.oracle
    replaced = ", ".join(f"round({c} + {_offset(q.digits)!r}, {q.digits}) AS {c}" for c in q.rounded)
    return f"SELECT * REPLACE ({replaced}) FROM ({q.oracle})"
