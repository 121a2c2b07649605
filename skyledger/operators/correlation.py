"""Correlation matrices; every pair uses the rows where both columns are known."""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import lookup, running_before

# the functions that run on executors travel with the job: nothing to install there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_CELLS = 500_000  # distinct value pairs one task should scan
LEAST_EDGES = 64


def corr_pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs in one scan."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return _named_pairs(wide)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's coefficient, null for a constant column (``corr`` would divide by zero)."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def _named_pairs(wide: DataFrame) -> DataFrame:
    long = wide.unpivot([], wide.columns, "pair", "corr")
    parts = F.split("pair", "\\|")
    return long.select(parts[0].alias("a"), parts[1].alias("b"), "corr")


def pair_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, x, y, n): distinct value pairs of every column pair, one scan and one shuffle."""
    pairs = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"),
                 F.col(b).cast("double").alias("y"))
        for a, b in combinations(columns, 2)
    ])
    return (
        df.select(F.inline(pairs))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("a", "b", "x", "y")
        .agg(F.count("*").alias("n"))
    )


def corr_spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson on average ranks. Ranks come from value counts and distributed running totals."""
    cells = materialize(pair_cells(df, columns), "cells")
    sides = F.inline(F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("value")),
        F.struct(F.lit("y").alias("side"), F.col("y").alias("value")),
    ))
    counts = cells.select("a", "b", "n", sides).groupBy("a", "b", "side", "value").agg(F.sum("n").alias("n"))
    ranked = running_before(counts, ["a", "b", "side"], ["value"], F.col("n"), "before")
    ranks = ranked.select("a", "b", "side", "value", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))
    rx = ranks.filter("side = 'x'").select("a", "b", F.col("value").alias("x"), F.col("rank").alias("rx"))
    ry = ranks.filter("side = 'y'").select("a", "b", F.col("value").alias("y"), F.col("rank").alias("ry"))
    # the mean rank is (N + 1) / 2 exactly: centring first keeps the sums small
    mids = {f"{r['a']}|{r['b']}": (r["n"] + 1) / 2 for r in cells.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    both = cells.join(rx, ["a", "b", "x"]).join(ry, ["a", "b", "y"])
    mid = lookup(mids, F.concat_ws("|", "a", "b"))
    dx, dy, n = F.col("rx") - mid, F.col("ry") - mid, F.col("n")
    sums = both.groupBy("a", "b").agg(
        F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy")
    )
    return sums.select("a", "b", F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("corr"))


def concordance(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> float:
    """Sum over pairs of ``w_i w_j sign(u_i - u_j) sign(v_i - v_j)``.

    Two different ranks of ``u`` first differ in one bit. For each bit, rows that
    share the higher bits are compared by running weights along ``v``.
    """
    if len(u) < 2:
        return 0.0
    u = np.unique(u, return_inverse=True)[1].astype(np.int64)
    levels, v = np.unique(v, return_inverse=True)
    v, w = v.astype(np.int64), w.astype(np.float64)
    total = 0.0
    for bit in range(int(u.max()).bit_length()):
        group, right = u >> (bit + 1), (u >> bit) & 1
        keys, at = np.unique(group * len(levels) + v, return_inverse=True)
        left_w = np.bincount(at, weights=w * (1 - right), minlength=len(keys))
        upto = np.cumsum(left_w)
        g = keys // len(levels)
        starts = np.searchsorted(g, g, side="left")
        ends = np.searchsorted(g, g, side="right") - 1
        base = upto[starts] - left_w[starts]
        less = upto - left_w - base
        more = upto[ends] - upto
        total += float(np.sum(w * right * (less - more)[at]))
    return total


def _block_of(cuts: dict[str, np.ndarray]):
    """Order-preserving block number of a value in its series.

    Each edge value is a block of its own, with open intervals between. A value
    frequent enough to be an edge sits alone, and equal values never count in
    Kendall's sum, so no block that has to be scanned is large.
    """
    @F.pandas_udf("int")
    def block(series: pd.Series, values: pd.Series) -> pd.Series:
        out = np.zeros(len(values), dtype="int32")
        x, names = values.to_numpy(dtype=float), series.to_numpy()
        for name in pd.unique(names):
            cut, rows = cuts[name], names == name
            position = np.searchsorted(cut, x[rows], side="left")
            on_edge = cut[np.minimum(position, len(cut) - 1)] == x[rows]
            out[rows] = 2 * position + on_edge
        return pd.Series(out)

    return block


def _scan_block(rows: pd.DataFrame) -> pd.DataFrame:
    s = concordance(rows["u"].to_numpy(), rows["v"].to_numpy(), rows["n"].to_numpy())
    return pd.DataFrame({"pair": [rows["pair"].iloc[0]], "s": [s]})


def _concordances(cells: DataFrame, edges: int | None = None) -> dict[str, float]:
    """Kendall's sum per ``pair`` of (pair, x, y, n) cells.

    The plane is cut into blocks along x and y, as many as it takes for a block to fit one task. Two cells differ in
    both block numbers, or share only their y block, or share their x block; the latter two kinds are scanned block by
    block. The block totals are cells themselves, fewer than before: they are scanned as one group where they fit, and
    cut again where they do not.
    """
    largest = cells.groupBy("pair").count().agg(F.max("count")).first()[0] or 0
    edges = edges or max(LEAST_EDGES, largest // BLOCK_CELLS)
    probs = [(i + 1) / (edges + 1) for i in range(edges)]
    cuts = {}
    for r in cells.groupBy("pair").agg(
        F.percentile_approx("x", probs).alias("x"), F.percentile_approx("y", probs).alias("y")
    ).collect():  # one row per pair
        for side in ("x", "y"):
            cuts[f"{r['pair']}|{side}"] = np.unique(np.asarray(r[side], dtype=float))
    block = _block_of(cuts)
    blocked = materialize(cells.select(
        "pair", "x", "y", "n", block(F.concat("pair", F.lit("|x")), "x").alias("bx"),
        block(F.concat("pair", F.lit("|y")), "y").alias("by"),
    ), "blocks")

    same_y = F.when(F.col("by") % 2 == 0, F.struct(
        F.lit("y").alias("kind"), F.col("by").alias("block"), F.col("bx").cast("double").alias("u"), F.col("y").alias("v")))
    same_x = F.when(F.col("bx") % 2 == 0, F.struct(
        F.lit("x").alias("kind"), F.col("bx").alias("block"), F.col("x").alias("u"), F.col("y").alias("v")))
    scans = blocked.select("pair", "n", F.inline(F.array_compact(F.array(same_y, same_x))))
    grid = materialize(blocked.groupBy(
        "pair", F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y")).agg(F.sum("n").alias("n")), "grid")
    most = grid.groupBy("pair").count().agg(F.max("count")).first()[0] or 0
    score: dict[str, float] = {}
    if BLOCK_CELLS < most < largest:
        score = _concordances(grid)
    else:
        scans = scans.unionByName(grid.select("pair", "n", F.lit("grid").alias("kind"), F.lit(0).alias("block"),
                                              F.col("x").alias("u"), F.col("y").alias("v")))
    found = scans.groupBy("pair", "kind", "block").applyInPandas(_scan_block, "pair string, s double")
    for r in found.groupBy("pair").agg(F.sum("s").alias("s")).collect():
        score[r["pair"]] = score.get(r["pair"], 0.0) + r["s"]
    return score


def kendall_tau(cells: DataFrame, edges: int | None = None) -> dict[str, float | None]:
    """Exact tau-b per ``pair`` from (pair, x, y, n) cells, without comparing all pairs of rows."""
    score = _concordances(cells, edges)
    total = {r["pair"]: float(r["n"]) for r in cells.groupBy("pair").agg(F.sum("n").alias("n")).collect()}

    sides = F.inline(F.array(*[
        F.struct(F.lit(c).alias("side"), F.col(c).alias("value")) for c in ("x", "y")
    ]))
    tied = cells.select("pair", "n", sides).groupBy("pair", "side", "value").agg(F.sum("n").cast("double").alias("t"))
    ties = {
        (r["pair"], r["side"]): r["ties"]
        for r in tied.groupBy("pair", "side").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("ties")).collect()
    }
    out = {}
    for pair, s in score.items():
        pairs = total[pair] * (total[pair] - 1) / 2
        scale = ((pairs - ties[pair, "x"]) * (pairs - ties[pair, "y"])) ** 0.5
        out[pair] = s / scale if scale else None
    return out


def corr_kendall(df: DataFrame, columns: list[str], edges: int | None = None) -> DataFrame:
    cells = materialize(pair_cells(df, columns), "cells").withColumn("pair", F.concat_ws(",", "a", "b"))
    tau = kendall_tau(cells, edges)
    rows = [(a, b, tau.get(f"{a},{b}")) for a, b in combinations(columns, 2)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def contingency(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, x, y, n): observed counts of every pair of categorical columns."""
    pairs = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
        for a, b in combinations(columns, 2)
    ])
    combos = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return (
        combos.select("n", F.inline(pairs)).dropna(subset=["x", "y"])
        .groupBy("a", "b", "x", "y").agg(F.sum("n").alias("n"))
    )


def corr_cramers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected Cramer's V and the chi-square it rests on."""
    cells = contingency(df, columns)
    rows = cells.groupBy("a", "b", "x").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy("a", "b", "y").agg(F.sum("n").alias("col_n"))
    shares = cells.join(rows, ["a", "b", "x"]).join(cols, ["a", "b", "y"])
    stats = shares.groupBy("a", "b").agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n") * F.col("n") / (F.col("row_n").cast("double") * F.col("col_n"))).alias("share"),
        F.countDistinct("x").alias("r"), F.countDistinct("y").alias("k"),
    )
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    phi2 = F.greatest(F.lit(0.0), F.col("share") - 1 - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    v = F.sqrt(F.try_divide(phi2, F.least(kc - 1, rc - 1)))
    return stats.select("a", "b", (n * (F.col("share") - 1)).alias("chi2"), v.alias("cramers_v"))


def missing_corr(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of the null flags; a column that is never or always null has none."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    return corr_pearson(flags, columns).filter(F.col("corr").isNotNull())
