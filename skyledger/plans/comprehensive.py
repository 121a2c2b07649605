"""The composed analysis: range, profile and rules over one table."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correlation, mining, profile
from ..operators.filters import analysis_frame, last
from ..session import materialize

log = logging.getLogger(__name__)
COLUMNS = ["temperature", "humidity", "pressure"]


def data_summary(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def comprehensive(df: DataFrame, now: str, days: int, columns: list[str] = COLUMNS, min_support: float = 0.05,
                  min_confidence: float = 0.5, min_lift: float = 1.0) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Result tables by name, and the reason for each part that could not be built.

    A part that fails (too few rows, say) leaves the others in place.
    """
    frame = materialize(analysis_frame(last(df, f"{days}d", now), columns), "frame")
    present = [c for c in columns if c in frame.columns]

    def rules() -> dict[str, DataFrame]:
        binned = mining.discretize(mining.require_rows(frame, 20), present)
        itemsets = mining.frequent_itemsets(mining.transactions(binned), min_support)
        found = mining.association_rules(itemsets, min_confidence).filter(F.col("lift") >= min_lift)
        return {"top_rules": mining.top_rules(found, min_lift), "rule_summary": mining.rule_summary(found)}

    def described() -> dict[str, DataFrame]:
        values = mining.require_rows(frame, 10).select(*present)
        numeric = materialize(profile.profile_numeric(values, present), "profile")
        return {
            "overview": profile.profile_overview(values), "numeric": numeric,
            "pearson": correlation.corr_pearson(values, present), "spearman": correlation.corr_spearman(values, present),
            "missing": profile.missing_bar(values, present), "alerts": profile.profile_alerts(values, present, stats=numeric),
        }

    parts: dict[str, Callable[[], dict[str, DataFrame]]] = {
        "summary": lambda: {"summary": data_summary(frame)}, "profile": described, "rules": rules,
    }
    results: dict[str, DataFrame] = {}
    failures: dict[str, str] = {}
    for name, build in parts.items():
        try:
            results.update(build())
        except Exception as error:  # the other parts must still be delivered
            log.warning("%s failed: %s", name, error)
            failures[name] = str(error)
    return results, failures
