"""Distributed running totals, quantiles and correlations against brute force, with hot groups."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.operators import aggregates, correlation, ordered, windows


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables would be merged into one range; keep them apart so that ranges really meet."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, one value holds a third of them."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 10 else f"cold{i % 70}"
        value = 5.0 if rng.random() < 0.33 else float(rng.randint(-50, 50))
        rows.append((key, i, value))
    return spark.createDataFrame(rows, "key string, pos int, value double"), pd.DataFrame(rows, columns=["key", "pos", "value"])


def test_running_before(skewed):
    df, pdf = skewed
    got = ordered.running_before(df, ["key"], ["pos"], F.when(F.col("value") > 0, 1).otherwise(0), "before").toPandas()
    pdf = pdf.assign(w=(pdf.value > 0).astype(int)).sort_values(["key", "pos"])
    pdf["before"] = pdf.groupby("key")["w"].cumsum() - pdf["w"]
    merged = got.merge(pdf, on=["key", "pos"])
    assert len(merged) == len(pdf) and (merged.before_x == merged.before_y).all()


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "key string, pos int")
    got = ordered.running_before(df, ["key"], ["pos"], F.lit(1), "before")
    assert sorted((str(r["key"]), r["before"]) for r in got.collect()) == [("None", 0), ("None", 1), ("a", 0)]


def test_first_rows_of_a_hot_group(skewed):
    df, pdf = skewed
    rows = df.withColumnsRenamed({"key": "mac", "pos": "event_id"}).withColumn("ts", F.timestamp_seconds("event_id"))
    got = windows.latest_n(rows, 5).toPandas().groupby("mac")["event_id"].apply(sorted)
    want = pdf.groupby("key")["pos"].apply(lambda p: sorted(p)[-5:])
    assert got.to_dict() == want.to_dict()


def test_a_hot_group_is_split(skewed):
    df, _ = skewed
    sizes = ordered.ordered_chunks(df, ["key", "pos"]).groupBy(ordered.CHUNK).count().toPandas()["count"]
    assert len(sizes) > 1 and sizes.max() < 0.5 * sizes.sum()


def test_quantiles(skewed):
    df, pdf = skewed
    probs = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]
    row = ordered.quantiles(df, ["value"], probs).first()
    assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(pdf.value.quantile(probs)))


def test_a_bracket_that_misses_falls_back(skewed, monkeypatch):
    """Brackets from a sketch that lies must not give a wrong value."""
    monkeypatch.setattr(ordered, "_MARGIN", -0.2)
    df, pdf = skewed
    assert ordered.quantiles(df, ["value"], [0.5]).first()["q0"] == pdf.value.median()


def test_quantiles_with_nulls_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, 2.0)], "a double, b double")
    rows = {r["column"]: (r["n"], r["q0"]) for r in ordered.quantiles(df, ["a", "b"], [0.5]).collect()}
    assert rows == {"a": (2, 2.0), "b": (3, 2.0)}


def test_quantiles_of_nothing(spark):
    assert ordered.quantiles(spark.createDataFrame([(None,)], "a double"), ["a"], [0.5]).count() == 0


def test_an_instant_that_repeats_is_one_row(spark):
    """A third of all rows at one instant of one sensor."""
    df = spark.range(30_000).selectExpr("'m' AS mac", "timestamp_seconds(if(id % 3 = 0, 500, id)) AS ts")
    row = ordered.max_gap(df, ["mac"]).first()
    assert row["n"] == 30_000 and row["max_gap"] == 2.0


def test_max_gap(spark):
    times = [0, 5, 6, 100, 40, 41]
    df = spark.createDataFrame([("m", t) for t in times] + [("single", 1)], "mac string, s int")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    rows = {r["mac"]: (r["n"], r["mean_gap"], r["max_gap"]) for r in ordered.max_gap(df, ["mac"]).collect()}
    assert rows == {"m": (6, 20.0, 59.0), "single": (1, None, None)}


def test_error_runs_across_ranges(spark):
    flags = [True, False, False, True] + [False] * 25 + [True, False]
    df = spark.createDataFrame([("m", i, i, f) for i, f in enumerate(flags)], "metric string, t int, event_id int, success boolean")
    row = aggregates.error_runs(df.withColumn("ts", F.timestamp_seconds("t"))).first()
    assert (row["errors"], row["longest_run"], row["fatal"]) == (28, 25, True)


def brute(u, v, w):
    return sum(
        w[i] * w[j] * np.sign(u[i] - u[j]) * np.sign(v[i] - v[j]) for i, j in itertools.combinations(range(len(u)), 2)
    )


def test_concordance_matches_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60):
        u, v, w = rng.integers(0, 9, n).astype(float), rng.integers(0, 5, n).astype(float), rng.integers(1, 4, n)
        assert correlation.concordance(u, v, w) == pytest.approx(brute(u, v, w))


@pytest.mark.parametrize("edges", [2, 5, 64])
def test_rank_correlations_match_pandas(spark, edges):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(400) < 0.34, 7.0, rng.normal(size=400).round(1))  # a third of one value
    y = np.where(rng.random(400) < 0.34, -1.0, (x + rng.normal(size=400)).round(1))
    pdf = pd.DataFrame({"x": x, "y": y})
    pdf.loc[::17, "y"] = None
    df = spark.createDataFrame([(a, None if np.isnan(b) else float(b)) for a, b in pdf.itertuples(index=False)], "x double, y double")
    kept = pdf.dropna()
    n = np.ones(len(kept))
    s = correlation.concordance(kept.x.to_numpy(), kept.y.to_numpy(), n)
    pairs = len(kept) * (len(kept) - 1) / 2
    ties = [sum(t * (t - 1) / 2 for t in kept[c].value_counts()) for c in ("x", "y")]
    expected = s / ((pairs - ties[0]) * (pairs - ties[1])) ** 0.5
    assert correlation.corr_kendall(df, ["x", "y"], edges).first()["corr"] == pytest.approx(expected)
    ranks = kept.rank()
    assert correlation.corr_spearman(df, ["x", "y"]).first()["corr"] == pytest.approx(ranks.x.corr(ranks.y))


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert correlation.corr_pearson(df, ["a", "b"]).first()["corr"] is None
    assert correlation.corr_kendall(df, ["a", "b"]).first()["corr"] is None
    assert correlation.corr_spearman(df, ["a", "b"]).first()["corr"] is None


def test_packed_order_sorts_like_its_parts(spark):
    from skyledger.functions.scalars import packed_order, packed_tie

    times = [None, "0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "2024-01-01 00:00:00", "9999-12-31 23:59:59.999999"]
    ids = [None, -2 ** 63, -1, 0, 2 ** 63 - 1]
    rows = [(t, i, n, m) for n, t in enumerate(times) for m, i in enumerate(ids)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "t string, id long, n int, m int").withColumn("ts", F.col("t").cast("timestamp"))
    got = df.withColumn("p", packed_order("ts", "id")).orderBy("p").select("n", "m", "id", packed_tie(F.col("p")).cast("long").alias("back")).collect()
    assert [(r["n"], r["m"]) for r in got] == sorted((n, m) for _, _, n, m in rows)
    assert all(r["id"] == r["back"] for r in got)


def test_quantiles_rank_in_one_scan_after_the_sketch(spark, tmp_path):
    rng = np.random.default_rng(5)
    columns = {"flat": rng.random(20_000), "heavy": np.where(rng.random(20_000) < 0.4, 3.0, rng.normal(size=20_000)),
               "few": rng.integers(0, 3, 20_000).astype(float), "big": rng.pareto(0.5, 20_000)}
    pdf = pd.DataFrame(columns)
    pdf.loc[::7, "flat"] = np.nan
    path = str(tmp_path / "wide")
    spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "flat double, heavy double, few double, big double").write.parquet(path)
    probs = [0.0, 0.003, 0.25, 0.5, 0.504, 0.95, 1.0]
    for row in ordered.quantiles(spark.read.parquet(path), list(columns), probs).collect():
        want = pdf[row["column"]].quantile(probs).tolist()
        assert row["n"] == pdf[row["column"]].count() and [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(want, rel=1e-12)


def test_spans_of_one_source_meet_across_ranges(spark):
    """One source with many windows: every span equals a plain walk, also those cut by a range."""
    rng = random.Random(11)
    mae = [6.0 if rng.random() < 0.9 else 1.0 for _ in range(4000)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(mae)], "i int, temp_abs_error double").selectExpr(
        "timestamp '2024-01-01' + make_dt_interval(0, 0, i * 30) ts", "24 horizon_hours", "'p' source", "temp_abs_error")
    got = sorted(r["windows"] for r in windows.alert_intervals(df).filter("level = 'critical'").collect())
    runs = [len(list(run)) for high, run in itertools.groupby(mae, lambda m: m > 5) if high]
    assert got == sorted(n for n in runs if (n - 1) * 30 >= 60)
