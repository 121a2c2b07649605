"""Reproducible shuffle into shards by a permutation of global row numbers.

Rows are numbered in the order of stated columns. A Feistel network over the number, written as two digits of a mixed
radix just large enough for the row count, gives a permutation of that square; a number that leaves the row range walks
on along its cycle until it is back in range. Shard and slot follow from the new number, so either can be computed for
any row without reading the others, and no row moves to be shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import prepare

ROUNDS = 8
_MASK = np.uint64(0xFFFFFFFF)


def _mixed(value: np.ndarray, key: int) -> np.ndarray:
    """A 32-bit hash of 32-bit halves: multiply, fold, multiply."""
    v = (value.astype(np.uint64) + np.uint64(key)) & _MASK
    v = (v * np.uint64(1_540_483_477)) & _MASK
    v ^= v >> np.uint64(15)
    v = (v * np.uint64(739_982_445)) & _MASK
    return v ^ (v >> np.uint64(13))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int(_mixed(np.array([seed & 0xFFFFFFFF], np.uint64), 7919 * i + 1)[0]) for i in range(rounds)]


def permute(numbers: np.ndarray, count: int, seed: int) -> np.ndarray:
    """The place of each row number of ``0 .. count - 1`` in the shuffle."""
    high = math.isqrt(max(count - 1, 0)) + 1
    low = -(-count // high) if count else 1
    keys = round_keys(seed)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x // np.uint64(low), x % np.uint64(low)
        for i, key in enumerate(keys):
            if i % 2:
                right = (right + _mixed(left, key)) % np.uint64(low)
            else:
                left = (left + _mixed(right, key)) % np.uint64(high)
        return left * np.uint64(low) + right

    out = network(numbers.astype(np.uint64))
    while (away := out >= count).any():  # fewer than ``high`` of the square's numbers are out of range
        out[away] = network(out[away])
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """Add ``out``: 0, 1, 2, ... in the order of ``order`` (nulls first).

    Rows are range partitioned and sorted once and stored with their place in the range; one count per range goes
    through the driver. Equal rows share the stretch of numbers in any order, so the result is the same up to their
    exchange. An empty table gives an empty table; a column named ``out`` is replaced.
    """
    spark = prepare(df.sparkSession)
    kept = df.drop(out)
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    per_range = stored.groupBy(F.shiftright("_place", 33).alias("_range")).count().collect()  # one row per partition
    starts, total = [], 0
    for found in sorted(per_range):
        starts.append((found["_range"], total))
        total += found["count"]
    offsets = spark.createDataFrame(starts, "_of long, _start long")
    joined = stored.join(F.broadcast(offsets), F.shiftright("_place", 33) == F.col("_of"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(out, F.col("_start") + inside).drop("_place", "_of", "_start")


def assign(df: DataFrame, order: list[str], shards: int, seed: int = 1, out: str = "place") -> DataFrame:
    """Add ``out``: struct ``row_number``, ``position`` (after the shuffle), ``shard``, ``slot``.

    Every shard gets the same count of rows or one more, slots run from 0 without gaps. Null values are ordered first
    and texts play no part. The rows of ``df`` stay as they are, repeated ones too; empty gives empty.
    """
    numbered = number_rows(df, order, "_row")
    count = numbered.count()

    @F.arrow_udf("long")
    def shuffled(numbers: pa.Array) -> pa.Array:
        return pa.array(permute(numbers.to_numpy(zero_copy_only=False), count, seed))

    placed = numbered.withColumn("_position", shuffled("_row"))
    return placed.withColumn(out, F.struct(
        F.col("_row").alias("row_number"), F.col("_position").alias("position"),
        F.pmod("_position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_position div {shards}").alias("slot"))).drop("_row", "_position")


def write_shards(placed: DataFrame, path: str, place: str = "place") -> None:
    """Write the rows as Parquet, one folder per shard, sorted by slot: readers get the shuffled order."""
    out = placed.withColumn("shard", F.col(f"{place}.shard")).withColumn("slot", F.col(f"{place}.slot")).drop(place)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
