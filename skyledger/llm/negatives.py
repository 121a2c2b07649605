"""Hard negatives by exact integer scores in a residue number system.

Vectors become integers. Their inner products are taken modulo several small primes: residues of at most nine bits and
a sign keep every float32 matrix product of a slice of components exact, and the products are put together by Chinese
remaindering (mixed radix digits), with as many primes as the largest possible score of a block needs.

The anchors are a stated query set, taken in groups of bounded size that are broadcast one after the other; each group
is scored against all stored rows. A task keeps the best few rows per anchor, so what leaves it does not depend on how
many rows it read. A first scan finds the positives, their scores set the windows in which a second scan selects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .centroids import usable
from .common import batches, prepare
from .sharding import number_rows

PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)  # product beyond 2^69
SLICE = 64  # components of one product: 64 * 510^2 < 2^24, exact in float32
LIMIT = 1 << 27  # integers saturate here
ROWS = 2048  # stored rows of one block
GROUP = 16_384  # anchors of one broadcast
CELLS = 1 << 20  # scores held at once


def residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues of least absolute value, as float32."""
    half = prime // 2
    return ((values + half) % prime - half).astype(np.float32)


def _centred(x: np.ndarray, prime: int) -> np.ndarray:
    return x - np.float32(prime) * np.rint(x * np.float32(1 / prime))


class Factors:
    """The residues of a matrix of integers, one component matrix per prime, made when first asked for."""

    def __init__(self, values: np.ndarray):
        self.values, self.held = values, {}
        self.largest = int(abs(values).max()) if values.size else 0

    def __getitem__(self, prime: int) -> np.ndarray:
        if prime not in self.held:
            self.held[prime] = residues(self.values, prime)
        return self.held[prime]


def products(left: Factors, right: Factors) -> np.ndarray:
    """All inner products of the rows of two integer matrices of equal width, exact."""
    width = left.values.shape[1]
    bound, modulus, score = 2 * left.largest * right.largest * width + 1, 1, None
    for prime in PRIMES:
        a, b, part = left[prime], right[prime], None
        for at in range(0, max(width, 1), SLICE):
            one = _centred(a[:, at:at + SLICE] @ b[:, at:at + SLICE].T, prime)
            part = one if part is None else _centred(part + one, prime)
        part = _centred(part, prime).astype(np.int64)
        if score is None:
            score = part
        else:  # the next mixed radix digit, of least absolute value
            digit = (part - score) % prime * pow(modulus, -1, prime) % prime
            score += np.where(digit > prime // 2, digit - prime, digit) * modulus
        modulus *= prime
        if modulus > bound:
            break
    return score


class Best:
    """The best ``keep`` rows of every query: highest score first, then smallest id."""

    def __init__(self, queries: int, keep: int):
        self.keep = keep
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(queries, np.iinfo(np.int64).min)  # a row must reach this score
        self.full = np.zeros(queries, bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        query, score, ids = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        kept = place < self.keep
        self.query, self.score, self.id = query[kept], score[kept], ids[kept]
        last = place == self.keep - 1
        self.least[query[last]], self.full[query[last]] = score[last], True

    def batch(self) -> pa.RecordBatch:
        return pa.record_batch({"query": pa.array(self.query), "id": pa.array(self.id), "score": pa.array(self.score)})


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Packed integers as rows of one width; shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, packed in zip(out, vectors):
        found = np.frombuffer(packed, "<i4")
        row[:len(found)] = found
    return out


def _scored(parts: Iterator[pa.RecordBatch], anchors: Factors) -> Iterator[tuple]:
    """``ids, labels, first anchor, scores`` of stored blocks against slices of the anchors."""
    width = anchors.values.shape[1]
    step = max(1, CELLS // ROWS)
    slices = [(at, Factors(anchors.values[at:at + step])) for at in range(0, len(anchors.values), step)]
    for part in parts:
        for ids, labels, lengths, packed in zip(*(part.column(c) for c in ("ids", "labels", "lengths", "vectors"))):
            ends = np.cumsum([0, *lengths.as_py()]) * 4
            whole = packed.as_py()
            # components that no anchor has add nothing to a score
            rows = Factors(_matrix([whole[a:min(b, a + 4 * width)] for a, b in zip(ends[:-1], ends[1:])], width))
            numbers = ids.values.to_numpy(zero_copy_only=False), labels.values.to_numpy(zero_copy_only=False)
            for at, some in slices:
                yield *numbers, at, products(some, rows)


def store(df: DataFrame, scale: int) -> DataFrame:
    """Rows ``id, label, vector`` written as blocks of packed integers, as they are read: no shuffle."""

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = part.column("vector")
            offsets = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            values = np.clip(values, -LIMIT, LIMIT).astype("<i4")
            if len(part):
                yield pa.record_batch({
                    "ids": pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("id")),
                    "labels": pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("label")),
                    "lengths": pa.array([np.diff(offsets)], pa.list_(pa.int32())),
                    "vectors": pa.array([values.tobytes()], pa.binary())})

    with batches(df.sparkSession, ROWS):
        blocks = df.mapInArrow(packed, "ids array<long>, labels array<long>, lengths array<int>, vectors binary")
        return materialize(blocks, "blocks")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The best of what the tasks kept; ``place`` counts from 1."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def _positives(stored: DataFrame, anchors: list, keep: int) -> DataFrame:
    held = stored.sparkSession.sparkContext.broadcast(anchors)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix = _opened(held.value)
        best = Best(len(ids), keep)
        for row_ids, row_labels, at, scores in _scored(parts, Factors(matrix)):
            mine = slice(at, at + len(scores))
            fit = (labels[mine, None] == row_labels) & (ids[mine, None] != row_ids) & (scores >= best.least[mine, None])
            anchor, row = np.nonzero(fit)
            best.add(anchor + at, scores[anchor, row], row_ids[row])
        yield best.batch()

    return _best(stored.mapInArrow(scan, "query long, id long, score long"), keep)


def _negatives(stored: DataFrame, anchors: list, windows: list, keep: int, low: int, high: int) -> DataFrame:
    """``windows``: (number of the anchor, positive score); a query is a place in that list."""
    held = stored.sparkSession.sparkContext.broadcast((anchors, windows))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = held.value
        _, labels, matrix = _opened(anchors)
        owner, score = (np.array(c, np.int64) for c in zip(*windows))
        # 100 * s between low * p and high * p, in whole numbers
        best = Best(len(owner), keep)
        best.least, most = -((-low * score) // 100), (high * score) // 100
        order = np.argsort(owner, kind="stable")
        for row_ids, row_labels, at, scores in _scored(parts, Factors(matrix)):
            queries = order[slice(*np.searchsorted(owner[order], [at, at + len(scores)]))]
            for some in np.array_split(queries, -(-len(queries) // len(scores))) if len(queries) else ():
                mine = scores[owner[some] - at]
                fit = (mine >= best.least[some, None]) & (mine <= most[some, None])
                fit &= labels[owner[some], None] != row_labels
                query, row = np.nonzero(fit)
                best.add(some[query], mine[query, row], row_ids[row])
        yield best.batch()

    return _best(stored.mapInArrow(scan, "query long, id long, score long"), keep)


def _opened(anchors: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, vectors = zip(*anchors)
    width = max(len(v) for v in vectors) // 4
    return np.array(ids, np.int64), np.array(labels, np.int64), _matrix(vectors, width)


def mine(df: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
         scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor.

    ``anchor`` says of a row of ``df`` whether it is one. Positives are an anchor's best rows of its label, negatives
    per positive its best rows of other labels with ``low * positive <= 100 * negative <= high * positive``; ties go
    to the smaller id. Rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter
    vectors count as filled up with zeros; integers saturate at 2^27. An id stands for one vector: rows that share the
    anchor's id are not its positives, and a repeated row is as many candidates and as many anchors. Other columns are
    not returned; an empty table gives an empty result.
    """
    spark = prepare(df.sparkSession)
    label = label if isinstance(label, Column) else F.col(f"`{label}`")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("long").alias("label"),
                     F.col(f"`{vector}`").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    stored = store(rows.select("id", "label", "vector"), scale)
    asked = number_rows(rows.filter("anchor").select("id", "label", "vector"), ["id", "label"], "number")
    asked = materialize(asked, "anchors")
    groups = -(-asked.count() // GROUP)
    found = [_group(spark, stored, asked.filter(F.expr(f"number div {GROUP} = {g}")), scale, positives, negatives, low, high)
             for g in range(groups)]
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    whole = found[0]
    for one in found[1:]:
        whole = whole.unionAll(one)
    return whole


def _group(spark: SparkSession, stored: DataFrame, asked: DataFrame, scale: int, positives: int, negatives: int,
           low: int, high: int) -> DataFrame:
    """The result for at most ``GROUP`` anchors, which the driver holds one group at a time."""
    anchors = [(r["id"], r["label"], np.clip(np.floor(np.array(r["vector"], np.float64) * scale), -LIMIT, LIMIT).astype("<i4").tobytes())
               for r in asked.collect()]
    best = _positives(stored, anchors, positives).collect()  # at most positives * GROUP rows
    windows = [(r["query"], r["score"]) for r in best]
    pairs = spark.createDataFrame([(n, anchors[r["query"]][0], r["id"], r["score"]) for n, r in enumerate(best)],
                                  "query long, anchor_id long, positive_id long, positive_score long")
    if not windows:
        chosen = spark.createDataFrame([], "query long, id long, score long, place int")
    else:
        chosen = _negatives(stored, anchors, windows, negatives, low, high)
    joined = chosen.join(F.broadcast(pairs), "query").select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
    return materialize(joined, "negatives")
