"""Discretisation rules, guards, rules and profile invariants."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from test_queries import executed_plans

from skyledger.operators import filters, mining, profile
from skyledger.plans.comprehensive import comprehensive


def column(spark, values, name="temperature"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def labels(df):
    return [r["temperature_binned"] for r in df.collect()]


def test_three_bins(spark):
    assert labels(mining.discretize(column(spark, [1, 2, 3, 4, 5, 6, None]), ["temperature"])) == [
        "low", "low", "medium", "medium", "high", "high", None
    ]


def test_repeated_edges_fall_back_to_halves(spark):
    out = mining.discretize(column(spark, [20, 20, 21, 21, 20]), ["temperature"])
    assert "temperature_binned" not in out.columns  # the median equals the minimum: no two halves
    out = mining.discretize(column(spark, [1, 2, 2, 2, 2, 2, 2, 3, 3]), ["temperature"])
    assert labels(out) == ["low"] * 7 + ["high"] * 2


def test_too_few_values_or_missing_column_is_skipped(spark):
    df = column(spark, [1, 2, None])
    assert mining.discretize(df, ["temperature", "dew_point"]).columns == ["temperature"]


def test_bin_labels(spark):
    assert set(labels(mining.discretize(column(spark, range(10)), ["temperature"], 2))) == {"low", "high"}
    assert set(labels(mining.discretize(column(spark, range(20)), ["temperature"], 4))) == {f"bin_{i}" for i in (1, 2, 3, 4)}


@pytest.fixture(scope="module")
def baskets(spark):
    rows = [["a", "b"]] * 6 + [["a", "b", "c"]] * 3 + [["c"]] * 1
    return spark.createDataFrame([(r,) for r in rows], "items array<string>")


def test_itemsets_and_all_rule_splits(baskets):
    sets = mining.frequent_itemsets(baskets, 0.05)
    support = {tuple(r["items"]): r["support"] for r in sets.collect()}
    assert support == {("a",): 0.9, ("b",): 0.9, ("c",): 0.4, ("a", "b"): 0.9, ("a", "c"): 0.3, ("b", "c"): 0.3, ("a", "b", "c"): 0.3}
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in mining.association_rules(sets, 0.0).collect()}
    assert len(rules) == 2 * 3 + 6
    both = rules[(("c",), ("a", "b"))]
    assert both["confidence"] == pytest.approx(0.75) and both["lift"] == pytest.approx(0.75 / 0.9)
    assert both["leverage"] == pytest.approx(0.3 - 0.36) and both["conviction"] == pytest.approx(0.1 / 0.25)
    assert math.isinf(rules[(("a",), ("b",))]["conviction"])
    for r in rules.values():
        assert r["support"] <= min(r["antecedent_support"], r["consequent_support"]) + 1e-12


def test_support_exactly_at_the_threshold_of_wide_baskets(spark):
    """0.07 * 100 is a little more than 7 in floating point; an itemset of count 7 still has support 0.07."""
    rows = [([f"i{k:02d}" for k in range(12)] if i < 7 else [f"r{i}"],) for i in range(100)]
    sets = mining.frequent_itemsets(spark.createDataFrame(rows, "items array<string>"), 0.07)
    assert sets.count() == 2**12 - 1 and sets.agg(F.min("n"), F.max("n")).first() == (7, 7)


def brute_sets(rows, least):
    """Counts of every itemset, by unfolding each basket whole."""
    counts = Counter(s for r in rows if r for k in range(1, len(set(r)) + 1) for s in combinations(sorted(set(r), key=str), k))
    return {s: n for s, n in counts.items() if n / len(rows) >= least}


def test_itemsets_equal_brute_force_without_cached_baskets(spark):
    """Repeated items, empty and null baskets, a null item; baskets never leave the tables to be cached as objects."""
    draw = random.Random(3)
    rows = [[f"i{draw.randrange(9)}" for _ in range(draw.randrange(8))] for _ in range(300)] + [[None, "i1"]] * 40 + [None] * 10
    df = spark.createDataFrame([(r,) for r in rows], "items array<string>")
    before = max(executed_plans(spark), default=-1)
    found = {tuple(sorted(r["items"], key=str)): r["n"] for r in mining.frequent_itemsets(df, 0.08).collect()}
    assert found == brute_sets(rows, 0.08) and (None, "i1") in found
    assert not [p for p in executed_plans(spark, before).values() if "DeserializeToObject" in p]


def test_columns_that_are_absent_are_skipped(spark):
    df = spark.createDataFrame([(1.0,)], "other double")
    assert mining.discretize(df, ["temperature"]).columns == ["other"]


def test_no_rule_above_threshold(baskets):
    assert mining.association_rules(mining.frequent_itemsets(baskets, 0.99), 0.5).count() == 0


def test_guards(spark):
    small = column(spark, [1, 2, 3, 4, 5])
    with pytest.raises(mining.NotEnoughData):
        mining.require_rows(small, 10)
    assert mining.require_rows(small, 5).count() == 5
    with pytest.raises(ValueError):
        filters.analysis_frame(small, ["humidity"], [])


def test_comprehensive_isolates_failures(spark):
    rows = [(i, 20.0 + i % 7, 50.0 + i % 5, 1000.0 + i % 11) for i in range(15)]
    df = spark.createDataFrame(rows, "h int, temperature double, humidity double, pressure double")
    df = df.withColumn("ts", F.expr("timestamp '2024-01-01' + make_dt_interval(0, h)"))
    results, failures = comprehensive(df, "2024-01-02", 30)
    assert set(failures) == {"rules"}  # fifteen rows: enough to profile, too few for rules
    assert results["summary"].first()["points"] == 15 and results["overview"].first()["n_rows"] == 15


def test_histogram_keeps_every_value_and_skips_nulls(spark):
    df = column(spark, [0, 1, 2, 3, 10, 10, None])
    rows = {r["bin"]: r["n"] for r in profile.profile_histogram(df, ["temperature"]).collect()}
    assert sum(rows.values()) == 6 and rows[9] == 2


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None)] * 12, "temperature double, humidity double")
    assert [tuple(r) for r in profile.profile_histogram(df, ["temperature", "humidity"]).collect()] == [("temperature", 0, 12)]
    alerts = {(r["alert"], r["column"]) for r in profile.profile_alerts(df, ["temperature", "humidity"]).collect()}
    assert ("constant", "temperature") in alerts and ("high_missing", "humidity") in alerts


def brute_tree(flags):
    """Average linkage by trying all pairs of groups in every step, over all rows."""
    groups, steps = [(c,) for c in sorted(flags)], []

    def distance(g, h):
        return sum(math.dist(flags[a], flags[b]) for a in g for b in h) / (len(g) * len(h))

    while len(groups) > 1:
        d, g, h = min((round(distance(g, h), 12), min(g, h), max(g, h)) for g in groups for h in groups if g != h)
        groups = [x for x in groups if x not in (g, h)] + [tuple(sorted(g + h))]
        steps.append((len(steps) + 1, ",".join(g), ",".join(h), d, len(g + h)))
    return steps


def test_tree_of_missing_columns_equals_brute_force(spark):
    draw = random.Random(5)
    rows = [tuple(None if draw.random() < share else 1.0 for share in (0.1, 0.1, 0.5, 0.9, 0.6, 0.0, 1.0)) for _ in range(400)]
    names = list("gbcafde")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    found = [tuple(r) for r in profile.missing_dendrogram(df, names).sort("step").collect()]
    want = brute_tree({c: [float(r[i] is None) for r in rows] for i, c in enumerate(names)})
    assert [f[:3] + f[4:] for f in found] == [w[:3] + w[4:] for w in want]
    assert [f[3] for f in found] == pytest.approx([w[3] for w in want])


def test_tree_of_few_rows_and_columns(spark):
    df = spark.createDataFrame([(None, 1.0, None)], "b double, a double, c double")
    assert [tuple(r) for r in profile.missing_dendrogram(df, ["a", "b", "c"]).sort("step").collect()] == [
        (1, "b", "c", 0.0, 2), (2, "a", "b,c", 1.0, 3)]
    assert [r["distance"] for r in profile.missing_dendrogram(df.limit(0), ["a", "b", "c"]).collect()] == [0.0, 0.0]
    assert profile.missing_dendrogram(df, ["a"]).isEmpty()
