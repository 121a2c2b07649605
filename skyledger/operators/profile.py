"""Whole-table profile: overview, variable statistics, histograms, missing values, alerts."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .aggregates import per_column
from .correlation import corr_pearson
from .ordered import quantiles, value_counts

QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
ALERTS = {"missing_percent": 5.0, "zeros_percent": 10.0, "correlation": 0.9, "skewness": 1.0, "outlier_percent": 1.0}


def profile_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicates from one grouping of whole rows."""
    columns = df.columns
    grouped = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.lit(len(columns)).cast("long").alias("n_columns"),
        F.coalesce(F.sum(nulls * F.col("_n")), F.lit(0)).alias("missing_cells"),
        F.count_if(F.col("_n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def _sample_skewness(v: Column) -> Column:
    n = F.count(v).cast("double")
    return F.when(n > 2, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.skewness(v))


def _sample_kurtosis(v: Column) -> Column:
    n = F.count(v).cast("double")
    return F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments from one scan, distinct values from the value counts, exact quantiles.

    Skewness and excess kurtosis are corrected for the size of the sample; too few rows have none.
    """
    moments = per_column(df, columns, lambda v: {
        "count": F.count(v), "missing": F.count_if(v.isNull()), "min": F.min(v), "max": F.max(v), "mean": F.avg(v),
        "std": F.stddev_samp(v), "variance": F.var_samp(v), "skewness": _sample_skewness(v), "kurtosis": _sample_kurtosis(v),
        "zeros": F.count_if(v == 0), "negatives": F.count_if(v < 0),
    })
    distinct = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("distinct"))
    q = quantiles(df, columns, QUANTILES).select(
        "column", *[F.col(f"q{i}").alias(f"p{round(p * 100)}") for i, p in enumerate(QUANTILES)]
    )
    return (
        moments.join(distinct, "column", "left").join(q, "column", "left")
        .withColumn("iqr", F.col("p75") - F.col("p25"))
        .withColumn("cv", F.try_divide("std", "mean"))
    )


def _extremes(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    aggs = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}_min"], row[f"{c}_max"]) for c in columns if row[f"{c}_min"] is not None}


def _bucket(column: str, span: tuple[float, float], bins: int) -> Column:
    """Equal-width bin number; the largest value belongs to the last bin."""
    lo, hi = span
    if hi == lo:
        return F.when(F.col(column).isNotNull(), F.lit(0))
    place = F.floor((F.col(column) - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)).cast("int")
    return F.when(place.isNotNull(), F.least(place, F.lit(bins - 1)))  # least() alone would skip a null


def profile_histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(column, bin, n); all columns share one scan."""
    spans = _extremes(df, columns)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), _bucket(c, spans[c], bins).alias("bin")) for c in columns if c in spans
    ])
    return (
        df.select(F.inline(cells)).filter(F.col("bin").isNotNull())
        .groupBy("column", "bin").agg(F.count("*").alias("n"))
    )


def interactions(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(a, b, bin_a, bin_b, n): binned density of every column pair."""
    spans = _extremes(df, columns)
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _bucket(a, spans[a], bins).alias("bin_a"),
                 _bucket(b, spans[b], bins).alias("bin_b"))
        for a, b in combinations([c for c in columns if c in spans], 2)
    ])
    return (
        df.select(F.inline(cells)).dropna(subset=["bin_a", "bin_b"])
        .groupBy("a", "b", "bin_a", "bin_b").agg(F.count("*").alias("n"))
    )


def missing_bar(df: DataFrame, columns: list[str]) -> DataFrame:
    """Known values per column."""
    return df.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "column", "present")


def missing_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """How often each combination of missing columns occurs."""
    flags = [F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns]
    return df.groupBy(F.concat(*flags).alias("pattern")).agg(F.count("*").alias("n"))


def missing_distances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, differing): rows in which exactly one of two columns is missing; patterns are counted before pairs are made."""
    patterns = df.groupBy(*[F.col(c).isNull().alias(c) for c in columns]).agg(F.count("*").alias("_n"))
    pairs = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col(a) != F.col(b), F.col("_n")).otherwise(0).alias("n"))
        for a, b in combinations(sorted(columns), 2)
    ]).cast("array<struct<a: string, b: string, n: bigint>>")  # one column has no pairs
    return patterns.select(F.inline(pairs)).groupBy("a", "b").agg(F.sum("n").alias("differing"))


def missing_dendrogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(step, left, right, distance, size): columns joined by how alike their missing rows are, closest first.

    The distance of two columns is the Euclidean one of their missing flags, that of two groups the mean over their
    pairs; ties go to the smaller names. Only the distances, one per pair of columns, reach the driver. A group is
    named by its columns in order; a table without rows has distances of zero.
    """
    found = {frozenset((r["a"], r["b"])): math.sqrt(r["differing"]) for r in missing_distances(df, columns).collect()}
    groups, steps = [(c,) for c in sorted(columns)], []

    def mean(left: tuple, right: tuple) -> float:
        return math.fsum(found.get(frozenset((a, b)), 0.0) for a in left for b in right) / (len(left) * len(right))

    between = {(a, b): mean(a, b) for a, b in combinations(groups, 2)}
    while len(groups) > 1:
        (left, right), distance = min(between.items(), key=lambda g: (round(g[1], 12), g[0]))
        joined = tuple(sorted(left + right))
        groups = [g for g in groups if g not in (left, right)]
        between = {pair: d for pair, d in between.items() if not {left, right} & set(pair)}
        between |= {(min(g, joined), max(g, joined)): mean(g, joined) for g in groups}
        groups.append(joined)
        steps.append((len(steps) + 1, ",".join(left), ",".join(right), distance, len(joined)))
    return df.sparkSession.createDataFrame(steps, "step int, left string, right string, distance double, size int")


def samples(df: DataFrame, order: list[str], n: int = 10, seed: int = 42) -> DataFrame:
    """First, last and hash-ordered rows."""
    shuffled = F.md5(F.concat_ws("|", F.lit(seed), *order))
    head = df.orderBy(*order).limit(n).withColumn("sample", F.lit("head"))
    tail = df.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("sample", F.lit("tail"))
    random = df.orderBy(shuffled, *order).limit(n).withColumn("sample", F.lit("random"))
    return head.unionByName(tail).unionByName(random)


def profile_alerts(df: DataFrame, columns: list[str], limits: dict = ALERTS, stats: DataFrame | None = None) -> DataFrame:
    """(alert, column, value) of columns and pairs that break a limit; ``stats`` is a numeric profile already made."""
    stats = materialize(profile_numeric(df, columns), "profile") if stats is None else stats
    fences = {
        r["column"]: (r["p25"] - 1.5 * r["iqr"], r["p75"] + 1.5 * r["iqr"])
        for r in stats.select("column", "p25", "p75", "iqr").collect()  # one row per column
        if r["iqr"] is not None
    }
    outside = df.agg(*[
        F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in fences.items()
    ]).unpivot([], list(fences), "column", "outliers")
    rows = F.col("count") + F.col("missing")
    tests = {
        "high_missing": (F.col("missing") * 100.0 / rows, "missing_percent"),
        "constant": (F.when(F.col("distinct") <= 1, 1.0).otherwise(0.0), None),
        "zeros": (F.col("zeros") * 100.0 / rows, "zeros_percent"),
        "skewed": (F.abs("skewness"), "skewness"),
        "outliers": (F.try_divide(F.col("outliers") * 100.0, F.col("count")), "outlier_percent"),
    }
    found = stats.join(outside, "column", "left").select("column", F.inline(F.array(*[
        F.struct(F.lit(alert).alias("alert"), value.alias("value"), F.lit(limits[key] if key else 0.5).alias("limit"))
        for alert, (value, key) in tests.items()
    ])))
    pairs = corr_pearson(df, columns).select(
        F.concat_ws(",", "a", "b").alias("column"), F.lit("high_correlation").alias("alert"),
        F.abs("corr").alias("value"), F.lit(limits["correlation"]).alias("limit"),
    )
    return found.unionByName(pairs).filter(F.col("value") > F.col("limit")).select("alert", "column", "value")
