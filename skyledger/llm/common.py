"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small: texts may be very long, and a batch is held whole by a Python worker."""
    spark.conf.set(_BATCH, "200")
    return spark


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for jobs that read short rows."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state(shared: Broadcast, build: Callable[[dict], Any]) -> Any:
    """``build(shared.value)``, made once per Python worker and kept with the broadcast dictionary."""
    held = shared.value
    if "_state" not in held:
        held["_state"] = build(held)
    return held["_state"]
