import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from skyledger.llm import context_tree, queries


class Plain:
    """Context-tree weighting by its definition: counts per context and bit prefix, products over longer contexts."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, {}
        self.seen = set()
        for text in texts:
            for context, bits in self.bits(text):
                for d in range(depth + 1):
                    for i in range(8):
                        record = self.counts.setdefault((context[depth - d:], bits[:i]), [0, 0])
                        record[int(bits[i])] += 1
        self.children = {}
        for context, prefix in self.counts:
            if context:
                self.children.setdefault((context[1:], prefix), []).append((context, prefix))

    def bits(self, text):
        whole = b"\xff" * self.depth + text + b"\xff"
        for i in range(self.depth, len(whole)):
            yield whole[i - self.depth:i], f"{whole[i]:08b}"

    @lru_cache(None)
    def own(self, node):
        zeros, ones = self.counts[node]
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    @lru_cache(None)
    def below(self, node):
        return sum(self.weighted(c) for c in self.children[node])

    @lru_cache(None)
    def weighted(self, node):
        if len(node[0]) == self.depth:
            return self.own(node)
        return float(np.logaddexp(self.own(node), self.below(node))) - math.log(2)

    @lru_cache(None)
    def one(self, context, prefix, d):
        node = (context[self.depth - d:], prefix)
        if node not in self.counts:
            return None
        zeros, ones = self.counts[node]
        here = (ones + 0.5) / (zeros + ones + 1)
        longer = self.one(context, prefix, d + 1) if d < self.depth else None
        if longer is None:
            return here
        weight = 1 / (1 + math.exp(min(700, self.below(node) - self.own(node))))
        return weight * here + (1 - weight) * longer

    def score(self, text):
        total = 0.0
        for context, bits in self.bits(text):
            for i in range(8):
                p = self.one(context, bits[:i], 0)
                p = 0.5 if p is None else p
                total += math.log10(p if bits[i] == "1" else 1 - p)
        return total


def check(spark, rows, depth):
    df = spark.createDataFrame([(i, t, l, "x") for i, t, l in rows], "_block long, text string, learn boolean, lm string").repartition(3)
    got = context_tree.score(df, F.col("learn"), depth=depth).collect()
    lowered = {i: "".join(c.lower() if c.isascii() else c for c in t or "").encode() for i, t, _ in rows}
    training = [lowered[i] for i, _, l in rows if l]
    plain = Plain(training, depth)
    counts = Counter(w for t in training for w in t.split())
    counts[None] = len(training)
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    assert len(got) == len(rows)
    for r in got:
        text, lm = lowered[r["_block"]], r["lm"]
        tokens = [*text.split(), None]
        assert (lm["n_tokens"], lm["n_known"], lm["train_tokens"], lm["n_bytes"]) == (
            len(tokens), sum(counts[t] > 0 for t in tokens), n, len(text))
        assert lm["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), abs=1e-9)
        assert lm["score"] == pytest.approx(plain.score(text), rel=1e-7, abs=1e-7)
    return got


@pytest.mark.parametrize("depth", [1, 4])
def test_equals_the_definition(spark, monkeypatch, depth):
    monkeypatch.setattr(context_tree, "WINDOW", 40)
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 300)
    monkeypatch.setattr(context_tree, "ROWS", 50)
    draw = random.Random(depth)
    words = ["sun", "sand", "Sonne", "été", "a", "—"]
    rows = [(i, draw.choice([" ", "\n"]).join(draw.choices(words, k=draw.randint(0, 30))), draw.random() < 0.7) for i in range(40)]
    rows += [(100 + i, "the same text", i % 2 == 0) for i in range(20)]
    rows += [(200, None, True), (201, "", False), (202, "x" * 500, False), (203, "日本   語", False), (204, "\t \n", True)]
    check(spark, rows, depth)


def test_no_training_texts_and_no_rows(spark):
    got = check(spark, [(1, "ab c", False), (2, None, None)], 2)
    assert {r["_block"]: r["lm"]["score"] for r in got} == pytest.approx({1: -40 * math.log10(2), 2: -8 * math.log10(2)})
    assert context_tree.score(spark.createDataFrame([], "text string"), F.lit(True)).collect() == []


def test_probabilities_of_different_texts_stay_below_one(spark):
    rows = [(-1, "a", True), (-2, "b", True), (-3, "a", True)] + [(i, chr(i), False) for i in range(97, 123)]
    got = check(spark, rows, 2)
    assert 0.1 < sum(10 ** r["lm"]["score"] for r in got if r["_block"] >= 0) < 1


def test_learns(spark):
    """Held-out documents take fewer bits than by word counts, training ones fewer still."""
    out = queries.op13_context_tree(spark, SF_DIR).toPandas()
    held = out[out.held_out]
    assert len(out) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count() and 0 < len(held) < len(out)
    assert out[~out.held_out].bits_per_byte.median() < held.bits_per_byte.median() < 4
