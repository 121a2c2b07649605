import hashlib
import math

import numpy as np
import pytest

from skyledger.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int"


def plain(rows, dim, scale, k, rounds):
    """The definition, in Python integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((r for r in kept if r[0] is not None), key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:k]
    cents = [v for _, v in seeds]
    for last in [False] * rounds + [True]:
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((i, d.index(min(d)), min(d)))
        if last:
            return out, cents
        for n in range(len(cents)):
            mine = [v for (_, v), (_, c, _) in zip(kept, out) if c == n]
            cents[n] = [sum(col) // len(mine) for col in zip(*mine)] if mine else cents[n]


def compare(spark, rows, dim=4, scale=64, k=5, rounds=3):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)
    got = centroids.cluster(df, dim=dim, scale=scale, k=k, rounds=rounds).collect()
    want, cents = plain([(r["vec_id"], r["embedding"]) for r in df.collect()], dim, scale, k, rounds)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r["centroid"] == cents[r["cluster"]] and r["inertia"] == sum(w[2] for w in want) for r in got)
    assert all(r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"]) for r in got)
    return got


def test_equals_the_definition(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.25, -0.5, 1.0, 0.0]) for i in range(400)]  # many copies of one vector
    compare(spark, rows)


def test_unusual_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, []), (4, [1.0, 2.0, 3.0]), (5, [1.0, None, 3.0, 4.0]),
            (6, [nan, 0.0, 0.0, 0.0]), (7, [inf, 0.0, 0.0, 0.0]), (None, [-1.0, -2.0, 0.0, 0.5]), (8, [0.0] * 4), (9, [-0.01] * 4)]
    assert len(compare(spark, rows)) == 5
    assert compare(spark, rows[1:2], k=16) and not centroids.cluster(spark.createDataFrame(rows[2:3], "vec_id long, embedding array<float>")).collect()
    huge = centroids.cluster(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], "vec_id long, embedding array<float>"), k=1, rounds=0)
    assert {r["distance"] for r in huge.collect()} == {0, 64 * (1 << 28) ** 2}


@pytest.mark.parametrize("dim,bits", [(2, 1), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dim, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij")).reshape(dim, -1)
    keys = centroids.hilbert_keys(grid, bits)
    path = grid.T[sorted(range(len(keys)), key=keys.__getitem__)]
    assert len(set(keys)) == len(keys) and (abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_leave_out_only_losers():
    draw = np.random.default_rng(2)
    left = 0
    for _ in range(200):
        cents = draw.integers(-40, 40, (9, 3))
        values = draw.integers(-40, 40, 3) + draw.integers(-4, 5, (30, 3))
        low, high = values.min(0), values.max(0)
        cluster, distance = centroids.nearest(values, low, high, cents)
        all_of = ((values[:, None] - cents) ** 2).sum(2)
        assert (cluster == all_of.argmin(1)).all() and (distance == all_of.min(1)).all()
        left += len(centroids.candidates(low, high, cents))
    assert left < 200 * 9 / 2  # boxes prune where vectors lie together
