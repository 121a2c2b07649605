"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of an example is a term, so each example finds itself at cosine 1. Beginnings of words are terms as well
where their presence goes with the label, so that an inflected form unseen among the examples still shares a term with
those seen. Association is a weight and chooses no neighbours by itself: words that go with the label (log odds of at
least ``ASSOCIATION`` standard errors) weigh fully, all others ``FAINT`` as much, or a long text would drown the few that matter.

The examples are a bounded sample of the labelled documents, as many of either label, sorted so that like vectors are
neighbours and cut into blocks. For every term the index keeps its postings by block and the largest weight in each block. A text looks at the
blocks in the order of their upper bounds and stops at the first bound that cannot beat its k-th neighbour, so the
neighbours are exact. Their votes, weighted by similarity, are mapped to probabilities learned from the votes that the
examples get from each other, each counted as often as its label is among all labelled documents; the neighbours themselves are the evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, worker_state
from .labels import labelled, labelled_sample

LABELLED = 2_048  # at most so many labelled documents of either label are examples
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_EXAMPLES = 5  # what goes with the label in fewer examples is chance
ASSOCIATION, EFFECT = 3.0, 1.5
FAINT = 0.005  # weight of a word that does not go with the label
SORTED_BY = 48  # so many of the commonest words order the examples: texts of one language come together
CALIBRATED = 2_000  # examples whose votes from the others teach the probabilities
NEIGHBOURS, BLOCK = 15, 256
STEEPNESS = 3  # votes fall with this power of the similarity: far neighbours of a long text say little
SHRINK = 0.5  # weight that the vote of texts without a neighbour counts as
COUNTED_TERMS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
EVIDENCE = "array<struct<doc_id: bigint, similarity: double, label: int>>"


def word_terms(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) >= n]


def _term_counts(sample: DataFrame) -> DataFrame:
    """``term, positive, negative``: examples of either label that hold the term."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string())] + [
                pa.array([c[t] for t in terms], pa.int64()) for c in counts], ["term", "negative", "positive"])
            for c in counts:
                c.clear()

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORD.findall(text.lower()))
                counts[label > 0].update({t for w in words for t in word_terms(w)})
            if sum(map(len, counts)) > COUNTED_TERMS:
                yield from flush()
        yield from flush()

    schema = "term string, negative long, positive long"
    return sample.select("text", "label").mapInArrow(counted, schema).groupBy("term").agg(
        F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


class Terms:
    """Numbers of the terms in the space, by word and by beginning."""

    def __init__(self, numbers: dict[str, int]):
        self.words = numbers  # beginnings too, which equal no word: they end with a star
        self.beginnings = {t[:-1]: n for t, n in numbers.items() if t.endswith("*")}
        sizes: dict[str, set[int]] = {}  # by their first letters: most words begin like none
        for beginning in self.beginnings:
            sizes.setdefault(beginning[:BEGINNINGS[0]], set()).add(len(beginning))
        self.sizes = {first: sorted(found) for first, found in sizes.items()}

    def counts(self, text: str | None) -> dict[int, int]:
        """Occurrences of each term in the whole text."""
        counted = Counter(_WORD.findall(text.lower())) if text else {}
        out = {t: n for t, n in zip(map(self.words.get, counted), counted.values()) if t is not None}
        for word in counted:
            if (first := word[:BEGINNINGS[0]]) in self.sizes:
                for size in self.sizes[first]:
                    if (term := self.beginnings.get(word[:size])) is not None and len(word) >= size:
                        out[term] = out.get(term, 0) + counted[word]
        return out


class Model(dict):
    """A trained model as it is sent: the finished index and its terms as one text. ``vectors`` are read back from the postings."""

    def __missing__(self, key: str) -> list[tuple[np.ndarray, np.ndarray]]:
        if key != "vectors":
            raise KeyError(key)
        rows, weights, first, _, starts, _ = self["postings"]
        terms = np.repeat(np.repeat(np.arange(len(first) - 1), np.diff(first)), np.diff(starts))
        order = np.argsort(rows, kind="stable")
        ends = np.cumsum(np.bincount(rows, minlength=len(self["ids"])))[:-1]
        return list(zip(np.split(terms[order], ends), np.split(weights[order], ends)))


def _numbered(terms: str | list[str]) -> dict[str, int]:
    """The terms of a list, or of a text with blanks between them, by their place."""
    return {t: i for i, t in enumerate(terms.split() if isinstance(terms, str) else terms)}


def _postings(vectors: list, width: int) -> tuple[np.ndarray, ...]:
    """``rows, weights, first, block_of, starts, tops`` of an index over ``width`` terms.

    Most terms stand in few blocks: only pairs of a term and a block that has it take room. Pairs of term t lie between
    ``first[t]`` and ``first[t + 1]``, postings of pair p between ``starts[p]`` and ``starts[p + 1]``.
    """
    vectors = [arrays(v) for v in vectors]
    terms = np.concatenate([np.zeros(0, np.int32), *[t for t, _ in vectors]])
    weights = np.concatenate([np.zeros(0), *[w for _, w in vectors]])
    rows = np.repeat(np.arange(len(vectors), dtype=np.min_scalar_type(max(len(vectors), BLOCK))), [len(t) for t, _ in vectors])
    order = np.argsort(terms, kind="stable")
    terms, rows, weights = terms[order], rows[order], weights[order]
    blocks = rows // BLOCK
    new = np.concatenate([np.ones(min(len(terms), 1), bool), (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])])
    starts = np.flatnonzero(new)
    first = np.concatenate([[0], np.cumsum(np.bincount(terms[starts], minlength=width))]).astype(np.int32)
    # rounded up, so that they stay bounds
    tops = np.maximum.reduceat(weights, starts) if len(starts) else np.zeros(0)
    tops = np.nextafter(tops.astype(np.float32), np.float32(2))
    return rows, weights, first, blocks[starts], np.append(starts, len(rows)).astype(np.int32), tops


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Postings by term and block, with the largest weight of each."""

    def __init__(self, held: dict):
        self.terms = Terms(_numbered(held["terms"]))
        self.idf, self.labels, self.ids = np.asarray(held["idf"], float), held["labels"], held["ids"]
        self.empty_rate, self.steps = held["empty_rate"], held.get("steps")
        self.blocks = -(-len(self.ids) // BLOCK)
        self.postings = held["postings"] if "postings" in held else _postings(held["vectors"], len(self.idf))
        self.rows, self.weights, self.first, self.block_of, self.starts, self.tops = self.postings

    def weigh(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of the unit TF-IDF vector."""
        terms, n = arrays(counts)
        return terms, _unit(terms, n, self.idf)

    def _scores(self, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines with the examples of the blocks of some pairs; zero for the others."""
        first = self.starts[pairs]
        sizes = self.starts[pairs + 1] - first
        at = _ranges(first, sizes)
        return np.bincount(self.rows[at], np.repeat(weights, sizes) * self.weights[at], self.blocks * BLOCK)

    def nearest(self, vector: dict[int, float] | tuple, k: int = NEIGHBOURS, without: int | None = None) -> list[tuple[float, int]]:
        """The k examples of the largest cosine above zero, ties by their order; ``without`` leaves one out.

        Blocks are read in the order of their bounds, one, four, sixteen .. at a time, until no bound can beat the k-th.
        """
        terms, weights = arrays(vector)
        if not len(terms) or not self.blocks:
            return []
        sizes = self.first[terms + 1] - self.first[terms]
        pairs, weights = _ranges(self.first[terms], sizes), np.repeat(weights, sizes)
        block_of = self.block_of[pairs]
        upper = np.bincount(block_of, weights * self.tops[pairs], self.blocks)
        order = np.argsort(-upper, kind="stable")
        best: list[tuple[float, int]] = []
        at, many = 0, 1
        while at < len(order):
            least = max(1e-12, best[-1][0] if len(best) == k else 0.0)
            group = order[at:at + many]
            group = group[upper[group] >= least - 1e-9]
            if not len(group):
                break
            read = np.zeros(self.blocks, bool)
            read[group] = True
            read = np.flatnonzero(read[block_of])
            scores = self._scores(pairs[read], weights[read])
            if without is not None:
                scores[without] = 0.0
            found = np.flatnonzero(scores >= least - 1e-9)
            if len(found) > k:  # the k-th largest of these is a bound too
                found = found[scores[found] >= np.partition(scores[found], -k)[-k] - 1e-9]
            best = sorted(best + [(round(s, 12), r) for r, s in zip(found.tolist(), scores[found].tolist()) if s > 0],
                          key=lambda f: (-f[0], f[1]))[:k]
            at, many = at + many, 4 * many
        return best

    def vote(self, neighbours: list[tuple[float, int]]) -> float:
        """Share of the label among the neighbours by similarity, shrunk to the rate of texts without any."""
        weights = [s ** STEEPNESS for s, _ in neighbours]
        agreed = sum(w for w, (_, row) in zip(weights, neighbours) if self.labels[row])
        return (agreed + SHRINK * self.empty_rate) / (sum(weights) + SHRINK)

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        neighbours = self.nearest(self.weigh(self.terms.counts(text)))
        if not neighbours:
            return self.empty_rate, []
        return float(np.interp(self.vote(neighbours), *self.steps)), neighbours


def _lasting(held: dict) -> Index:
    """The index of a worker, which needs nothing else of what was sent."""
    index = Index(held)
    held["terms"] = None  # the rest is what the index reads
    return index


def _known(held: dict) -> Terms:
    return Terms(_numbered(held.pop("terms")))


def arrays(vector: dict[int, float] | tuple) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a sparse vector, which may come as these two already."""
    if isinstance(vector, tuple):
        return vector
    return np.fromiter(vector, int, len(vector)), np.fromiter(vector.values(), float, len(vector))


def _unit(terms: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    raw = (1 + np.log(n)) * idf[terms]
    norm = math.sqrt(raw @ raw)
    return raw / norm if norm else raw


def weighted(counts: dict[int, int], idf: np.ndarray | list[float]) -> dict[int, float]:
    """Unit TF-IDF vector, term frequency damped by a logarithm."""
    terms, n = arrays(counts)
    return dict(zip(counts, _unit(terms, n.astype(float), np.asarray(idf, float)).tolist()))


def _rising(votes: np.ndarray, labels: np.ndarray, times: np.ndarray) -> tuple[list[float], list[float]]:
    """Probability by vote: the best rising step function, each step shrunk by one example of either label.

    An example counts ``times``: as often as the labelled documents have its label more often than the sample.
    """
    steps: list[list[float]] = []
    for at in np.argsort(votes, kind="stable"):
        steps.append([votes[at], labels[at] * times[at], times[at]])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            last = steps.pop()
            steps[-1] = [(steps[-1][0] * steps[-1][2] + last[0] * last[2]) / (steps[-1][2] + last[2]),
                         steps[-1][1] + last[1], steps[-1][2] + last[2]]
    return [s[0] for s in steps], np.maximum.accumulate([(s[1] + 1) / (s[2] + 2) for s in steps]).tolist()


def train(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic", doc_id: str = "doc_id",
          text: str = "text") -> Broadcast:
    """Index at most ``LABELLED`` documents of either label for which ``learnable`` (over ``doc_id``) holds."""
    spark = prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, learnable, LABELLED, doc_id, text, each=True)
    every = labelled(labels, label, learnable, doc_id).agg(
        F.count_if(F.col("label") > 0).alias("positive"), F.count("*").alias("n")).first()
    sizes = {r["positive"]: r["n"] for r in sample.groupBy((F.col("label") > 0).alias("positive")).agg(
        F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)

    pos, neg = F.col("positive") + 0.5, F.col("negative") + 0.5
    odds = F.log(pos / (n_pos + 1.0)) - F.log(neg / (n_neg + 1.0))
    telling = (
        (F.col("positive") + F.col("negative") >= LEAST_EXAMPLES)
        & (F.abs(odds) >= ASSOCIATION * F.sqrt(1 / pos + 1 / neg))
        # what goes with the absence of the label says little in a text that has both
        & (odds >= EFFECT))
    found = _term_counts(sample).select("term", (F.col("positive") + F.col("negative")).alias("n"), telling.alias("telling")).filter(
        F.col("telling") | ~F.col("term").endswith("*"))
    words = found.toArrow().sort_by("term")  # of a bounded sample; Arrow holds them without an object per row
    terms, held_by, strong = words["term"].to_pylist(), words["n"].to_numpy(), words["telling"].to_numpy()
    idf = (np.log((1 + n_pos + n_neg) / (1 + held_by)) + 1) * np.where(strong, 1.0, FAINT)
    shared = spark.sparkContext.broadcast({"terms": " ".join(terms)})
    common = np.argsort(-held_by, kind="stable")[:SORTED_BY]

    @F.arrow_udf("binary")
    def vectors(texts: pa.Array) -> pa.Array:
        """Term numbers in order, then their counts, as 32-bit integers: an example is one short value."""
        known = worker_state(shared, _known)
        return pa.array([np.array(sorted(known.counts(t).items()), "<i4").reshape(-1, 2).T.tobytes() for t in texts.to_pylist()],
                        pa.binary())

    rows = []
    each = sample.select("doc_id", "label", vectors("text").alias("counts"))
    for r in each.groupBy("doc_id").agg(F.max("counts").alias("counts"), F.max("label").alias("label")).toLocalIterator():
        at, n = np.frombuffer(r["counts"], "<i4").reshape(2, -1)
        telling_here = at[strong[at]]
        # examples of the same telling terms come together, then those of the same common words
        like = (sorted(zip((-idf[telling_here]).tolist(), telling_here.tolist())), np.isin(common, at, invert=True).tolist(), r["doc_id"])
        rows.append((like, r["label"] > 0, at, n))
    empty = [label for _, label, at, _ in rows if not len(at)]
    kept = sorted((r for r in rows if len(r[2])), key=lambda r: r[0])
    rate = (sum(empty) + every["positive"] / (every["n"] + 1)) / (len(empty) + 1)
    examples = [(at, _unit(at, n, idf)) for _, _, at, n in kept]
    held = Model({"terms": " ".join(terms), "idf": idf, "ids": [like[-1] for like, _, _, _ in kept], "empty_rate": rate,
                  "labels": [label for _, label, _, _ in kept], "postings": _postings(examples, len(terms))})
    index = Index(held)
    taught = range(0, len(kept), -(-len(kept) // CALIBRATED) or 1)
    votes = np.array([index.vote(index.nearest(examples[i], without=i)) for i in taught])
    truth = np.array([float(held["labels"][i]) for i in taught])
    # counted as in all labelled documents, but together no more than there are examples
    share = every["positive"] / max(every["n"], 1)
    times = np.where(truth > 0, share / max(truth.mean(), 1e-9), (1 - share) / max(1 - truth.mean(), 1e-9)) if kept else truth
    held["steps"] = _rising(votes, truth, np.maximum(times, 1e-9)) if kept else ([0.0], [rate])
    return spark.sparkContext.broadcast(held)


def score(df: DataFrame, model: Broadcast, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``: struct ``score`` (0 to 1) and ``evidence`` (neighbours with similarity and label, nearest first).

    Null and empty texts, and texts that share no word with an example, get the rate of the label among such examples
    and no evidence; without labelled documents that is 0. A column named ``out`` is replaced; the other columns and
    repeated rows stay; an empty table gives an empty table.
    """
    prepare(df.sparkSession)

    @F.arrow_udf(f"struct<score: double, evidence: {EVIDENCE}>")
    def scored(texts: pa.Array) -> pa.Array:
        index = worker_state(model, _lasting)
        scores, ends, near = [], [0], []
        for one in texts.to_pylist():
            found, neighbours = index.score(one)
            scores.append(found)
            near += neighbours
            ends.append(len(near))
        evidence = pa.StructArray.from_arrays([
            pa.array([index.ids[r] for _, r in near], pa.int64()), pa.array([s for s, _ in near], pa.float64()),
            pa.array([int(index.labels[r]) for _, r in near], pa.int32())], ["doc_id", "similarity", "label"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), evidence)
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), lists], ["score", "evidence"])

    return df.withColumn(out, scored(F.col(text)))
