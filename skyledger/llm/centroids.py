"""Clustering around centroids with zone maps along a space-filling curve.

Vectors become integers, are ordered along a Hilbert curve and stored in blocks with the smallest and largest value of
every component. A block's box bounds by how much one centroid can be nearer than another for any vector inside it;
centroids that lose everywhere in the box are no candidates, the rest are compared exactly, a block at a time. All
arithmetic is on integers, so neither the order of the rows nor the number of tasks changes a result. Per round each
task sends one sum per centroid and component; the driver holds the centroids and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import batches, prepare

BLOCK = 256  # vectors behind one box
CURVE_BITS = 2  # bits of every component that the curve orders by
LIMIT = 1 << 27  # integers saturate here, so that a squared distance of 64 components fits a long


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector has ``dim`` components (any number by default), none of them null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(vector) == dim) if dim is not None else finite, F.lit(False))


def integers(values: pa.Array, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of the components of a list array, saturated."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype(np.int64)


def hilbert_keys(axes: np.ndarray, bits: int) -> list[bytes]:
    """Keys in the order of a Hilbert curve through a grid; ``axes`` has one row per component, ``bits`` bits each."""
    x, n = axes.astype(np.uint32), len(axes)
    for bit in range(bits - 1, 0, -1):  # undo the turns of the sub-cubes, from coarse to fine
        at, below = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for i in range(n):
            upper = (x[i] & at) != 0
            turned = np.where(upper, below, (x[0] ^ x[i]) & below)
            x[0] ^= turned
            x[i] ^= np.where(upper, np.uint32(0), turned)
    np.bitwise_xor.accumulate(x, axis=0, out=x)  # Gray code
    carried = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        carried ^= np.where(x[-1] & np.uint32(1 << bit), np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= carried
    planes = (x[None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]) & 1
    packed = np.packbits(planes.reshape(bits * n, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _moments(kept: DataFrame, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every component over all vectors; they only place the curve."""

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim), np.zeros(dim)
        for part in parts:
            values = integers(part.column("vector"), scale).reshape(-1, dim).astype(np.float64)
            n, s, q = n + len(values), s + values.sum(0), q + (values * values).sum(0)
        yield pa.record_batch({"part": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()),
                               "s": pa.array(s), "q": pa.array(q)})

    found = kept.select("vector").mapInArrow(sums, "part int, n long, s double, q double")
    rows = found.groupBy("part").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()  # one row per component
    mean, deviation = np.zeros(dim), np.ones(dim)
    for part, n, s, q in rows:
        mean[part] = s / max(n, 1)
        deviation[part] = np.sqrt(max(q / max(n, 1) - mean[part] ** 2, 0.0)) or 1.0
    return mean, deviation


def blocks(kept: DataFrame, dim: int, scale: int) -> DataFrame:
    """Store vectors in curve order: ``ids``, packed integers ``vectors``, and their box ``low``, ``high``.

    Rows are range partitioned on curve key and row, so any number of equal vectors spreads over tasks.
    """
    spark = kept.sparkSession
    mean, deviation = _moments(kept, dim, scale)

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = integers(part.column("vector"), scale).reshape(-1, dim)
            cells = np.clip(((values - mean) / (4 * deviation) + 0.5) * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
            packed = values.astype("<i4")
            yield pa.record_batch({
                "id": part.column("id"), "salt": part.column("salt"),
                "curve": pa.array(hilbert_keys(cells.T.astype(np.uint32), CURVE_BITS), pa.binary()),
                "vector": pa.array([row.tobytes() for row in packed], pa.binary())})

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for part in parts:
            ids += part.column("id").to_pylist()
            vectors += part.column("vector").to_pylist()
            while len(ids) >= BLOCK:
                yield block(ids[:BLOCK], vectors[:BLOCK])
                ids, vectors = ids[BLOCK:], vectors[BLOCK:]
        if ids:
            yield block(ids, vectors)

    def block(ids: list, vectors: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(vectors)
        values = np.frombuffer(whole, "<i4").reshape(-1, dim)
        return pa.record_batch({"ids": pa.array([ids], pa.list_(pa.int64())), "vectors": pa.array([whole], pa.binary()),
                                "low": pa.array([values.min(0).tobytes()], pa.binary()),
                                "high": pa.array([values.max(0).tobytes()], pa.binary())})

    with batches(spark, 4096):
        salted = kept.withColumn("salt", F.xxhash64("id", F.monotonically_increasing_id()))
        ordered = salted.mapInArrow(keyed, "id long, salt long, curve binary, vector binary")
        ordered = ordered.repartitionByRange("curve", "salt").sortWithinPartitions("curve", "salt")
        return materialize(ordered.mapInArrow(packed, "ids array<long>, vectors binary, low binary, high binary"), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest, ties included, to some point of the box.

    For a point x the squared distances to centroids s and j differ by 2x(j - s) - (|j|^2 - |s|^2), which is largest
    at a corner of the box that every component chooses by itself. Where even that is negative, s is always nearer.
    """
    inside = (low + high) // 2
    best = int(((centroids - inside) ** 2).sum(1).argmin())
    apart = centroids - centroids[best]
    norms = (centroids * centroids).sum(1)
    most = 2 * np.maximum(low * apart, high * apart).sum(1) - (norms - norms[best])
    return np.flatnonzero(most >= 0)


def nearest(values: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of every vector of a block."""
    some = candidates(low, high, centroids)
    chosen = centroids[some]
    reach = int(max(abs(low).max(), abs(high).max())) + int(abs(chosen).max())
    kind = np.float64 if values.shape[1] * reach * reach < 1 << 52 else np.int64  # either is exact
    v, c = values.astype(kind), chosen.astype(kind)
    squared = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
    at = squared.argmin(1)
    return some[at], squared[np.arange(len(v)), at].astype(np.int64)


def _assigned(part: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    dim = centroids.shape[1]
    for vectors, low, high in zip(*(part.column(c).to_pylist() for c in ("vectors", "low", "high"))):
        values = np.frombuffer(vectors, "<i4").reshape(-1, dim).astype(np.int64)
        box = (np.frombuffer(b, "<i4").astype(np.int64) for b in (low, high))
        yield values, *nearest(values, *box, centroids)


def _moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid becomes the floor of the mean of its vectors, empty ones stay."""
    k, dim = centroids.shape

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, dim + 1), np.int64)
        for part in parts:
            for values, cluster, _ in _assigned(part, centroids):
                for number in np.unique(cluster):
                    mine = cluster == number
                    totals[number, :dim] += values[mine].sum(0)
                    totals[number, dim] += mine.sum()
        number, place = np.indices(totals.shape)
        yield pa.record_batch({"cluster": pa.array(number.ravel(), pa.int32()), "part": pa.array(place.ravel(), pa.int32()),
                               "total": pa.array(totals.ravel(), pa.int64())})

    found = stored.select("vectors", "low", "high").mapInArrow(sums, "cluster int, part int, total long")
    totals = {(c, p): int(t) for c, p, t in  # centroids times components
              found.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect()}
    return np.array([[totals[c, p] // totals[c, dim] if totals.get((c, dim)) else int(centroids[c, p])
                      for p in range(dim)] for c in range(k)], np.int64)


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16,
            rounds: int = 3, seed: int = 1) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of every usable vector.

    The first centroids are the vectors whose id has the smallest SHA-256 of ``seed:id`` (fewer vectors: fewer
    centroids; ids are whole numbers). Vectors of another length or with a null or non-finite component take no part.
    A null id is clustered but starts no centroid; rows that repeat are as many vectors. Components beyond 2^27 after
    scaling count as 2^27. Other columns are not returned; an empty table gives an empty table.
    """
    spark = prepare(df.sparkSession)
    kept = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    kept = kept.filter(usable(F.col("vector"), dim))
    first = kept.filter(F.col("id").isNotNull()).withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256))
    starts = first.orderBy("hash", "vector").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid array<long>")
    centroids = integers(pa.array([r["vector"] for r in starts], pa.list_(pa.float64())), scale).reshape(-1, dim)
    stored = blocks(kept, dim, scale)
    for _ in range(rounds):
        centroids = _moved(stored, centroids)

    def assigned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for ids, (_, number, distance) in zip(part.column("ids"), _assigned(part, centroids)):
                yield pa.record_batch({"vec_id": ids.values, "cluster": pa.array(number, pa.int32()),
                                       "distance": pa.array(distance, pa.int64())})

    found = materialize(stored.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    total, most = sum(int(r["s"]) for r in sums), (1 << 63) - 1
    described = spark.createDataFrame(
        [(r["cluster"], min(int(r["s"]), most), min(total, most), centroids[r["cluster"]].tolist()) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(described), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
