"""Running totals, ranks and exact quantiles over groups of any size.

A window over a whole group sends the group to one task. Here rows are range
partitioned on (keys, order), so even a single group is spread evenly, and
written once with the number of their range. Every range is then scanned on its
own, and only one row per (keys, range) crosses between ranges.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CHUNK = "_chunk"


def ordered_chunks(df: DataFrame, order: list[str], name: str = "ordered") -> DataFrame:
    """Rows with the number of the sorted range they fall in.

    The ranges are stored, so every reader sees the same cut.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn(CHUNK, F.spark_partition_id())
    return materialize(ranged, name)


def _before(keys: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running_before(df: DataFrame, keys: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over earlier rows of the group.

    ``keys + order`` must identify a row (or order ties must carry no meaning).
    """
    chunked = ordered_chunks(df.withColumn("_w", weight.cast("long")), keys + order)
    totals = chunked.groupBy(*keys, CHUNK).agg(F.sum("_w").alias("_t"))
    # one row per range of a group: a small window whatever the group's size
    offset = F.coalesce(F.sum("_t").over(_before(keys, [F.col(CHUNK)])), F.lit(0))
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, CHUNK])], offset.alias("_start"))
    inside = F.coalesce(F.sum("_w").over(_before(keys + [CHUNK], [F.col(c) for c in order])), F.lit(0))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, CHUNK])])  # null is a group too
    joined = chunked.withColumn("_in", inside).join(starts, same)
    return joined.select(*df.columns, (F.col("_start") + F.col("_in")).alias(name))


def max_gap(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Count, mean and longest gap in seconds between neighbouring times of a group.

    The mean telescopes to (last - first) / (n - 1); the longest gap is the
    larger of those inside ranges and those between a range and the next. Rows
    of one instant are counted first: a clock that stands still is one row.
    """
    instants = df.select(*keys, F.unix_micros(ts).alias("_s")).groupBy(*keys, "_s").agg(F.count("*").alias("_c"))
    chunked = ordered_chunks(instants, keys + ["_s"])
    step = F.col("_s") - F.lag("_s").over(Window.partitionBy(*keys, CHUNK).orderBy("_s"))
    per_range = (
        chunked.withColumn("_g", step)
        .groupBy(*keys, CHUNK)
        .agg(F.sum("_c").alias("_n"), F.min("_s").alias("_first"), F.max("_s").alias("_last"),
             F.max(F.when(F.col("_c") > 1, F.greatest("_g", F.lit(0))).otherwise(F.col("_g"))).alias("_g"))
    )
    previous = F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK))
    return (
        per_range.withColumn("_bridge", F.col("_first") - previous)
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("n"),
            F.try_divide((F.max("_last") - F.min("_first")) / 1e6, F.sum("_n") - 1).alias("mean_gap"),
            (F.greatest(F.max("_g"), F.max("_bridge")) / 1e6).alias("max_gap"),
        )
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for several numeric columns in one pass, nulls left out."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return (
        wide.unpivot([], columns, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def ranked_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, before): ``before`` rows of the column are smaller."""
    return running_before(value_counts(df, columns), ["column"], ["value"], F.col("n"), "before")


_ACCURACY = 10_000
_MARGIN = 5.0 / _ACCURACY  # the sketch is within 1 / accuracy of the true rank


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per column, ``n, q0 .. qk``.

    A sketch brackets each quantile; a second scan keeps the values inside brackets (about a thousandth of the rows)
    and, for all others, only how many lie in each gap between brackets. Running totals over both give every kept value
    its rank in the whole column. Should a bracket miss its rank, all values are ranked.
    """
    aggs = []
    for c in columns:
        value = F.col(c).cast("double")
        sides = [x for p in probs for x in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN))]
        aggs += [F.count(value).alias(f"{c}|n"), F.percentile_approx(value, sides, _ACCURACY).alias(f"{c}|b")]
    sketch = df.agg(*aggs).first()
    totals = {c: sketch[f"{c}|n"] for c in columns}
    brackets = {c: list(zip(sketch[f"{c}|b"][::2], sketch[f"{c}|b"][1::2])) for c in columns if totals[c]}
    found = _bracketed(df, probs, totals, brackets)
    return quantiles_of(ranked_values(df, columns), probs) if found is None else found


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Brackets in order, those that touch as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cell(value: Column, kept: list[tuple[float, float]]) -> Column:
    """Odd numbers for brackets, even ones for the gaps before, between and after them."""
    place = F.when(value < kept[0][0], 0).when(value <= kept[0][1], 1)
    for i, (lo, hi) in enumerate(kept[1:], 1):
        place = place.when(value < lo, 2 * i).when(value <= hi, 2 * i + 1)
    return place.otherwise(2 * len(kept))


def _bracketed(df: DataFrame, probs: list[float], totals: dict[str, int],
               brackets: dict[str, list[tuple[float, float]]]) -> DataFrame | None:
    """Quantiles from the values inside the brackets, or None if a bracket missed its rank."""
    schema = "column string, n long, " + ", ".join(f"q{i} double" for i in range(len(probs)))
    if not brackets:
        return df.sparkSession.createDataFrame([], schema)
    values = [(c, F.col(c).cast("double"), _merged(b)) for c, b in brackets.items()]
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(v.isNotNull(), _cell(v, kept)).alias("cell"), v.alias("value"))
        for c, v, kept in values
    ])
    inside = F.when(F.col("cell") % 2 == 1, F.col("value")).alias("value")
    counts = (
        df.select(F.inline(cells)).filter(F.col("cell").isNotNull())
        .groupBy("column", "cell", inside).agg(F.count("*").alias("n"))
    )
    ranked = running_before(counts, ["column"], ["cell", "value"], F.col("n"), "before")

    positions = {(c, i): p * (totals[c] - 1) for c in brackets for i, p in enumerate(probs)}
    wanted = [(c, i, rank(position), upper) for (c, i), position in positions.items()
              for upper, rank in ((False, math.floor), (True, math.ceil))]
    spark = df.sparkSession
    asked = spark.createDataFrame(wanted, "column string, i int, rank long, upper boolean")
    hits = ranked.filter(F.col("value").isNotNull()).join(asked, "column").filter(
        (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    picked = {(r["column"], r["i"], r["upper"]): r["value"] for r in hits.select("column", "i", "upper", "value").collect()}  # two per quantile
    if len(picked) < len(wanted):
        return None

    def at(c: str, i: int) -> float:
        lo, hi = picked[c, i, False], picked[c, i, True]
        return lo + (hi - lo) * (positions[c, i] - math.floor(positions[c, i]))

    return spark.createDataFrame([(c, totals[c], *[at(c, i) for i in range(len(probs))]) for c in brackets], schema)


def lookup(values: dict[str, float], key: Column) -> Column:
    """A literal map: a handful of per-column numbers needs no join with the big table."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs)[key] if pairs else F.lit(None).cast("long")


def quantiles_of(ranked: DataFrame, probs: list[float]) -> DataFrame:
    totals = {r["column"]: r["_t"] for r in ranked.groupBy("column").agg(F.sum("n").alias("_t")).collect()}
    rows = ranked.withColumn("_total", lookup(totals, F.col("column")))

    def at(rank: Column) -> Column:
        inside = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col("value")))

    picks = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [
            at(F.floor(position)).alias(f"_lo{i}"),
            at(F.ceil(position)).alias(f"_hi{i}"),
            F.max(position - F.floor(position)).alias(f"_f{i}"),
        ]
    found = rows.groupBy("column").agg(F.max("_total").alias("n"), *picks)
    return found.select(
        "column", "n",
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )
