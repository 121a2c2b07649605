"""Discretisation, frequent itemsets and association rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import item_label
from ..session import materialize
from .ordered import quantiles


class NotEnoughData(ValueError):
    """The input has fewer rows than the operator needs."""


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """The input itself, or an error when it has fewer than ``n`` rows (reads at most ``n``)."""
    found = df.limit(n).count()
    if found < n:
        raise NotEnoughData(f"need at least {n} rows, found {found}")
    return df


def bin_edges(df: DataFrame, columns: list[str], n: int = 3) -> dict[str, tuple[list[float], list[str]]]:
    """Inner edges and labels per column that can be cut; one row per column comes back."""
    present = [c for c in columns if c in df.columns]
    probs = [i / n for i in range(n + 1)] + [0.5]
    labels = {2: ["low", "high"], 3: ["low", "medium", "high"]}.get(n, [f"bin_{i + 1}" for i in range(n)])
    out = {}
    if not present:
        return out
    for row in quantiles(df, present, probs).collect():
        if row["n"] < n:
            continue
        edges = [row[f"q{i}"] for i in range(n + 1)]
        halves = [row["q0"], row[f"q{n + 1}"], row[f"q{n}"]]
        if len(set(edges)) == n + 1:
            out[row["column"]] = (edges[1:-1], labels)
        elif len(set(halves)) == 3:
            out[row["column"]] = (halves[1:-1], ["low", "high"])
    return out


def discretize(df: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """Add ``<column>_binned``: equal-frequency bins, right-closed, lowest included, null stays null.

    Repeated edges fall back to two halves; a column without two distinct
    halves, with too few values or absent from the input is skipped.
    """
    edges = bin_edges(df, columns, n)
    out = df
    for name in [c for c in columns if c in edges]:
        inner, labels = edges[name]
        value = F.col(name)
        cut = F.when(value <= inner[0], labels[0])
        for edge, label in zip(inner[1:], labels[1:]):
            cut = cut.when(value <= edge, label)
        out = out.withColumn(f"{name}_binned", F.when(value.isNotNull(), cut.otherwise(labels[-1])))
    return out


def transactions(binned: DataFrame) -> DataFrame:
    """``items`` of every row whose bins are all known."""
    bins = [c for c in binned.columns if c.endswith("_binned")]
    items = F.array(*[item_label(c.removesuffix("_binned"), F.col(c)) for c in bins])
    return binned.dropna(how="any", subset=bins).withColumn("items", F.array_sort(items))


def _subsets(items: str, first: int, last: str) -> Column:
    """Every subset of a short item array whose bit mask lies in the range."""
    return F.explode(F.expr(
        f"transform(sequence({first}, {last}), m -> "
        f"struct(filter({items}, (x, i) -> (shiftright(m, i) & 1) = 1) as picked, "
        f"filter({items}, (x, i) -> (shiftright(m, i) & 1) = 0) as rest))"
    ))


def _numbered(items: Column, frequent: list, seed: int) -> Column:
    """The frequent items of a basket as sorted numbers; other items go."""
    known = [i for i in frequent if i is not None]

    def kept(x: Column) -> Column:
        found = F.coalesce(x.isin(known), F.lit(False)) if known else F.lit(False)
        return found | x.isNull() if None in frequent else found

    return F.array_sort(F.transform(F.filter(items, kept), lambda x: F.xxhash64(F.lit(seed), x)))


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.05) -> DataFrame:
    """(items, n, support) of itemsets with at least ``min_support``.

    Itemsets grow by one item per pass over the baskets (Apriori): a basket is unfolded into the frequent itemsets it
    holds and the items after each, and these are counted where they are read. So a task reads its share of the baskets
    and shuffles one count per candidate, however many baskets there are; nothing is cached. Baskets of the same
    frequent items are merged first. The frequent items, at most mean basket size / ``min_support`` of them, come to
    the driver; itemsets stay in tables.
    """
    spark = baskets.sparkSession
    known = materialize(baskets.select(F.array_distinct("items").alias("items")), "baskets")
    total = known.count()
    support = F.col("n") / F.lit(float(total))
    items = known.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).filter(support >= min_support)
    items = materialize(items, "items")
    frequent = [r["item"] for r in items.collect()]
    number, seed = F.xxhash64(F.lit(0), "item"), 0
    while items.select(number).distinct().count() < len(frequent):  # each item a number of its own
        seed += 1
        number = F.xxhash64(F.lit(seed), "item")
    items = items.select("item", number.alias("number"), "n")

    # ``rest``: the numbers of a basket that may still join the itemset; all itemsets begin with the empty one
    numbers = known.select(_numbered(F.col("items"), frequent, seed).alias("rest")).filter(F.size("rest") > 0)
    merged = materialize(numbers.groupBy("rest").agg(F.count("*").alias("times")), "numbers")
    held = merged.select(F.lit(0).cast("long").alias("set"), "rest", "times")
    level = items.select(F.lit(0).cast("long").alias("set"), "number", F.monotonically_increasing_id().alias("longer"),
                         F.array("item").alias("items"), "n")
    found = []
    while True:
        level = materialize(level, "itemsets")
        if level.isEmpty():
            break
        found.append(level.select(F.array_sort("items").alias("items"), "n", support.alias("support")))
        held = _unfolded(held).join(level.select("set", "number", "longer"), ["set", "number"]).select(
            F.col("longer").alias("set"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "times")
        counted = _unfolded(held).groupBy("set", "number").agg(F.sum("times").alias("n")).filter(support >= min_support)
        sets = level.select(F.col("longer").alias("set"), F.col("items").alias("shorter"))
        level = materialize(counted, "counted").join(sets, "set").join(items.select("number", "item"), "number").select(
            "set", "number", F.monotonically_increasing_id().alias("longer"),
            F.array_append("shorter", F.col("item")).alias("items"), "n")
    none = spark.createDataFrame([], items.select(F.array("item").alias("items"), "n", support.alias("support")).schema)
    return reduce(DataFrame.unionByName, found, none)


def _unfolded(held: DataFrame) -> DataFrame:
    """One row per itemset in a basket and item after it: its ``number`` and where it stands in ``rest``."""
    return held.select("set", "rest", "times", F.posexplode("rest").alias("at", "number"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Rules from every antecedent/consequent split, with all metrics.

    Each itemset is unfolded into its splits and the two part supports are
    looked up by equality, so no pair of itemsets is compared.
    """
    splits = itemsets.filter(F.size("items") > 1).select(
        "support", _subsets("items", 1, "shiftleft(1, size(items)) - 2").alias("s")
    ).select("support", F.col("s.picked").alias("antecedents"), F.col("s.rest").alias("consequents"))
    left = itemsets.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    right = itemsets.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support"))
    rules = splits.join(left, "antecedents").join(right, "consequents")
    return rule_metrics(rules).filter(F.col("confidence") >= min_confidence)


def rule_metrics(rules: DataFrame) -> DataFrame:
    """Confidence, lift, leverage and conviction from the three supports."""
    s, a, c = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    confidence = s / a
    conviction = F.when(confidence >= 1, F.lit(float("inf"))).otherwise((1 - c) / (1 - confidence))
    return rules.select(
        "antecedents", "consequents", "antecedent_support", "consequent_support", "support",
        confidence.alias("confidence"), (confidence / c).alias("lift"), (s - a * c).alias("leverage"),
        conviction.alias("conviction"),
    )


def top_rules(rules: DataFrame, min_lift: float = 1.0, k: int | None = 10) -> DataFrame:
    """Rules with enough lift, best first; ties by item text.

    A rule and its reverse have equal lift up to the last bit, so the order looks at twelve digits.
    """
    ordered = rules.filter(F.col("lift") >= min_lift).orderBy(
        F.round("lift", 12).desc(), F.round("confidence", 12).desc(), F.array_join("antecedents", ","), F.array_join("consequents", ",")
    )
    return ordered.limit(k) if k else ordered


def rule_summary(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count("*").alias("rules"), F.avg("confidence").alias("mean_confidence"), F.avg("lift").alias("mean_lift"),
        F.max("lift").alias("max_lift"),
    )
