"""Text quality by a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins at quantiles. Boosting goes round the features in turn: each step fits a tree
of two levels to the gradient over one feature's bins and adds it, damped, to that feature's lookup table. The pairs
of features whose coarse grids explain most of what is left get tables of their own the same way. The score of a text
is a sum of table entries, one per feature and pair, for a whole Arrow batch at once, so each entry can be read as
what that bin adds to the log odds.
"""

from __future__ import annotations

from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .labels import labelled_sample

LABELLED = 20_000  # at most so many labelled documents are fitted
BINS, COARSE, PAIRS = 32, 8, 8
CYCLES, RATE, SMOOTHING = 150, 0.15, 5.0

FEATURES = (
    "log_chars", "log_words", "word_length", "capitals", "symbols", "digits", "beyond_ascii", "full_stops", "pipes",
    "exclamations", "distinct_words", "distinct_pairs", "top_word", "repeats", "line_words", "repeated_lines",
)

_STOP, _PIPE, _EXCLAMATION = b".|!"
_PLAIN = [c for c in range(128) if chr(c).isalnum() or chr(c).isspace() or chr(c) in ".,;:'\"-()?!|"]


def features(text: str | None) -> list[float]:
    """Statistics of the whole text; null counts as empty, and empty gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
    words, lines = text.split(), [line for line in text.split("\n") if line]
    n, n_bytes = max(len(words), 1), raw.sum()
    upper, lower = raw[65:91].sum(), raw[97:123].sum()
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n, upper / max(upper + lower, 1),
        (raw[:128].sum() - raw[_PLAIN].sum()) / n, raw[48:58].sum() / n_bytes, raw[128:].sum() / n_bytes,
        raw[_STOP] / n, raw[_PIPE] / n, raw[_EXCLAMATION] / n, len(counts) / n,
        len(set(zip(words, words[1:]))) / n, max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
    ]


def _feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _two_levels(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps of a tree with up to four leaves over ordered bins."""
    def cut(lo: int, hi: int) -> int | None:
        g, w = gradient[lo:hi].cumsum(), weight[lo:hi].cumsum()
        if hi - lo < 2:
            return None
        left = g[:-1] ** 2 / (w[:-1] + SMOOTHING) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + SMOOTHING)
        return lo + int(left.argmax()) + 1

    edges = {0, len(gradient)}
    middle = cut(0, len(gradient))
    for lo, hi in ((0, middle), (middle, len(gradient))) if middle else ():
        edges |= {lo, hi} | ({at} if (at := cut(lo, hi)) else set())
    out, edges = np.zeros(len(gradient)), sorted(edges)
    for lo, hi in zip(edges, edges[1:]):
        out[lo:hi] = gradient[lo:hi].sum() / (weight[lo:hi].sum() + SMOOTHING)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Tables for rows ``x`` of features and labels ``y``; without both labels only the intercept."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = {"intercept": float(np.log(rate / (1 - rate))), "edges": [], "tables": [], "pairs": []}
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    bins = np.stack([np.searchsorted(e, column, side="right") for e, column in zip(edges, x.T)])
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), model["intercept"])

    def step(places: np.ndarray, size: int, tree) -> np.ndarray:
        p = 1 / (1 + np.exp(-margin))
        return RATE * tree(np.bincount(places, y - p, size), np.bincount(places, p * (1 - p), size))

    for _ in range(CYCLES):
        for places, table in zip(bins, tables):
            added = step(places, len(table), _two_levels)
            table += added
            margin += added[places]

    coarse = [np.unique(np.quantile(column, np.linspace(0, 1, COARSE + 1)[1:-1])) for column in x.T]
    grid = np.stack([np.searchsorted(e, column, side="right") for e, column in zip(coarse, x.T)])
    p = 1 / (1 + np.exp(-margin))

    def explained(a: int, b: int) -> float:
        cells = grid[a] * COARSE + grid[b]
        g, w = np.bincount(cells, y - p), np.bincount(cells, p * (1 - p))
        return float((g ** 2 / (w + SMOOTHING)).sum())

    chosen = sorted(combinations(range(len(coarse)), 2), key=lambda ab: -explained(*ab))[:PAIRS]
    pairs = [(a, b, np.zeros(COARSE * COARSE)) for a, b in chosen]

    def crossed(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A tree that cuts one axis, then the other on either side."""
        g, w = gradient.reshape(COARSE, COARSE), weight.reshape(COARSE, COARSE)
        trees = []
        for turned in (False, True):
            gt, wt = (g.T, w.T) if turned else (g, w)
            for at in range(1, COARSE):
                out = np.zeros((COARSE, COARSE))
                out[:at], out[at:] = (_one_level(gt[s].sum(0), wt[s].sum(0)) for s in (slice(0, at), slice(at, None)))
                gain = (gt * out).sum() * 2 - (wt * out ** 2).sum()
                trees.append((gain, (out.T if turned else out).ravel()))
        return max(trees, key=lambda t: t[0])[1]

    for _ in range(CYCLES // 5):
        for a, b, table in pairs:
            cells = grid[a] * COARSE + grid[b]
            added = step(cells, len(table), crossed)
            table += added
            margin += added[cells]
    return model | {"edges": edges, "tables": tables, "coarse": coarse, "pairs": pairs}


def _one_level(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    g, w = gradient.cumsum(), weight.cumsum()
    at = int((g[:-1] ** 2 / (w[:-1] + SMOOTHING) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + SMOOTHING)).argmax()) + 1
    out = np.empty(len(gradient))
    out[:at] = g[at - 1] / (w[at - 1] + SMOOTHING)
    out[at:] = (g[-1] - g[at - 1]) / (w[-1] - w[at - 1] + SMOOTHING)
    return out


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["intercept"])
    for edges, table, column in zip(model["edges"], model["tables"], x.T):
        out += table[np.searchsorted(edges, column, side="right")]
    for a, b, table in model["pairs"]:
        out += table[np.searchsorted(model["coarse"][a], x[:, a], side="right") * COARSE
                     + np.searchsorted(model["coarse"][b], x[:, b], side="right")]
    return out


def train(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "quality", doc_id: str = "doc_id",
          text: str = "text") -> Broadcast:
    """Fit on at most ``LABELLED`` labelled documents for which ``learnable`` (over ``doc_id``) holds.

    Features are taken where the texts are; only their numbers come to the driver.
    """
    spark = prepare(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array(list(_feature_rows(texts.to_pylist())), pa.list_(pa.float64()))

    sample = labelled_sample(docs, labels, label, learnable, LABELLED, doc_id, text)
    measures = sample.select("doc_id", measured("text").alias("x"), "label")
    rows = measures.groupBy("doc_id").agg(F.max("x").alias("x"), F.max("label").alias("label")).collect()
    rows.sort(key=lambda r: (r["x"], r["label"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    return spark.sparkContext.broadcast(fit(x, np.array([float(r["label"] > 0) for r in rows])))


def score(df: DataFrame, model: Broadcast, text: str = "text", out: str = "quality") -> DataFrame:
    """Add ``out`` (double, 0 to 1): how likely the text has label 1.

    Null and empty texts are scored like a text of no words. Without labels of both kinds every text gets the share of
    label 1. A column named ``out`` is replaced; the other columns and repeated rows stay; empty gives empty.
    """
    prepare(df.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-margins(model.value, _feature_rows(texts.to_pylist())))))

    return df.withColumn(out, scored(F.col(text)))
