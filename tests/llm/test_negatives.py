import math

import numpy as np
import pytest

from skyledger.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def plain(rows, scale=256):
    """The definition, in Python integers."""
    kept = [(i, l, [math.floor(scale * float(x)) for x in v]) for i, v, l in rows
            if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, a in kept:
        if i % 10:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a, b)), j, k) for j, k, b in kept), key=lambda s: (-s[0], s[1]))
        for p, j in [(s, j) for s, j, k in scored if k == l and j != i][:5]:
            fit = [(s, n) for s, n, k in scored if k != l and 80 * p <= 100 * s <= 100 * p][:5]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(fit)]
    return sorted(out)


def compare(spark, rows):
    df = spark.createDataFrame([(i, v, l, 0) for i, v, l in rows], SCHEMA)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    found = negatives.mine(df, F.col("vec_id") % 10 == 0).collect()
    got = sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found)
    assert got == plain(rows)
    return got


def test_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 16)  # several broadcasts
    monkeypatch.setattr(negatives, "ROWS", 32)
    monkeypatch.setattr(negatives, "CELLS", 128)
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=5).tolist(), int(draw.integers(3))) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.0, 0.0, 0.0], i % 2) for i in range(200)]  # ties, a third of the rows
    assert len(compare(spark, rows)) > 1000


def test_unusual_rows(spark):
    nan = float("nan")
    rows = [(10, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [0.9, 2.0], 1), (2, [0.9, 2.0], 1), (3, None, 0), (4, [nan, 1.0], 0), (5, [1.0, None], 1),
            (None, [1.0, 1.0], 1), (6, [1.0, 1.0], None), (7, [2.0], 1), (8, [1.0, 2.0, 9.0], 1), (20, [], 0), (30, [0.0, 0.0], 1), (40, [-1.0, -2.0], 2), (9, [-1.0, -1.9], 2)]
    assert compare(spark, rows)
    assert compare(spark, rows[4:9]) == [] and compare(spark, rows[:1]) == []


@pytest.mark.parametrize("size,width", [(4, 3), (300, 64), (1 << 20, 100), (negatives.LIMIT, 64), (0, 2), (5, 0)])
def test_products_are_exact(size, width):
    draw = np.random.default_rng(size)
    a, b = draw.integers(-size, size + 1, (17, width)), draw.integers(-size, size + 1, (23, width))
    if size:
        a[0], b[0], b[1] = size, size, -size  # the largest scores of either sign
    got = negatives.products(negatives.Factors(a), negatives.Factors(b))
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
