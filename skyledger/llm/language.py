"""Language identification by words first, backing off to shorter and shorter character n-grams.

Every word of every labelled text is counted per language. Words that make up at least ``MIN_SHARE`` of a language's
words are known and score by their log frequency. An unseen word is read from left to right with end marks; each
character scores by the longest known n-gram that ends there. The n-gram counts come from all words too: counting the
longest order over padded words gives the shorter ones as sums over their continuations. A share of at least
``MIN_SHARE`` bounds the model by itself: no language can have more than ``1 / MIN_SHARE`` words or n-grams of an order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import prepare, worker_state

MIN_SHARE = 1e-5
ORDER = 4
COUNTED_WORDS = 200_000  # distinct words a task holds before it hands on its counts
CACHED_WORDS = 200_000  # words a Python worker remembers the scores of
LEAST_SCORE = -60.0
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(text: str | None, found: list[str]) -> bool:
    """Whether any character is a letter; numerals such as a superscript two form words but are none."""
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text)))


def count_words(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, word, n`` over all rows with both; each task adds up before the shuffle."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for language, counter in counts.items():
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([language] * len(counter), pa.string()), "word": pa.array(counter.keys(), pa.string()),
                    "n": pa.array(counter.values(), pa.int64())})
            counts.clear()

        for batch in batches:
            for language, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(language, Counter()).update(words(one))
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield from flush()
        yield from flush()

    prepare(df.sparkSession)
    labelled = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    return labelled.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Broadcast:
    """Fit the tables on all rows whose text and language are not null; no such rows give a model that knows nothing."""
    spark = df.sparkSession
    counts = count_words(df, text, lang).persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}

    def frequent(found: DataFrame, sizes: dict[str, int]) -> DataFrame:
        least = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, n * MIN_SHARE)])
        return found.filter(F.col("n") >= least[F.col("lang")])

    known, grams = [], []
    if totals:
        known = frequent(counts, totals).collect()  # at most 1 / MIN_SHARE rows a language
        # one n-gram for each character and for the end of the word
        each = F.explode(F.expr(f"transform(sequence(1, length(word) + 1), i -> substr(concat('^', word, '{'$' * (ORDER - 1)}'), i, {ORDER}))"))
        longest = materialize(counts.select("lang", "n", each.alias("gram")).groupBy("lang", "gram").agg(
            F.sum("n").alias("n")), "grams")
        sizes = {r["lang"]: r["n"] for r in longest.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        prefixes = F.explode(F.array(*[F.substring("gram", 1, order) for order in range(1, ORDER + 1)]))
        every = longest.select("lang", "n", prefixes.alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        grams = frequent(every, sizes).collect()  # at most ORDER / MIN_SHARE rows a language
    counts.unpersist()
    langs = sorted(totals)
    return spark.sparkContext.broadcast({
        "langs": langs, "words": _table(known, "word", langs), "grams": _table(grams, "gram", langs),
        "totals": [totals[k] for k in langs]})


def _table(rows: list, key: str, langs: list[str]) -> dict[str, list[int]]:
    place = {k: i for i, k in enumerate(langs)}
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r[key], [0] * len(langs))[place[r["lang"]]] = r["n"]
    return out


class Scorer(dict):
    """Word -> row of ``scores`` (log probability per language); unseen words are read when first met."""

    def __init__(self, held: dict):
        super().__init__()
        self.langs, self.used = held["langs"], 0
        totals = np.maximum(np.array(held["totals"] or [0], float), 1)
        counts = np.array(list(held["words"].values()), float).reshape(-1, max(len(self.langs), 1))
        self.known = {word: i for i, word in enumerate(held["words"])}
        self.known_scores = np.log((counts + 0.1) / totals)
        # probability of the last character of an n-gram after the others, one row per n-gram
        grams, self.grams = held["grams"], {gram: i for i, gram in enumerate(held["grams"])}
        after = np.array(list(grams.values()), float).reshape(-1, max(len(self.langs), 1))
        before = np.array([grams[g[:-1]] if g[:-1] in grams else totals for g in grams], float).reshape(after.shape)
        self.gram_scores = np.log((after + 0.1) / (np.maximum(before, after) + 1))
        self.scores = np.zeros((1024, len(self.langs)))

    def __missing__(self, word: str) -> int:
        if self.used == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        at = self.known.get(word)
        self.scores[self.used] = self.known_scores[at] if at is not None else self.backed_off(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def backed_off(self, word: str) -> np.ndarray | float:
        """An unseen word: each character after as long a context as is known."""
        text, grams, rows = f"^{word}$", self.grams, []
        for end in range(2, len(text) + 1):
            for start in range(max(end - ORDER, 0), end):
                row = grams.get(text[start:end])
                if row is not None:
                    rows.append(row)
                    break
        # the sum over a long word is bounded, as is what a single unknown word can say
        return np.maximum(math.log(MIN_SHARE) + self.gram_scores[rows].sum(axis=0), LEAST_SCORE)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not self.langs or not has_letter(text, found):
            return UNDETERMINED, 0.0
        if self.used > CACHED_WORDS:
            self.clear()
            self.used = 0
        places = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        mean = self.scores[places].mean(axis=0)
        # words of a text are not independent: evidence grows with the root of their number
        odds = np.exp((mean - mean.max()) * math.sqrt(len(found)))
        best = int(mean.argmax())
        return self.langs[best], float(1 / odds.sum())


def predict(df: DataFrame, model: Broadcast, text: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``: struct ``lang`` and ``score`` (0 to 1).

    Null texts, texts without a letter and any text under a model that knows nothing are ``und`` with score 0; ties go
    to the first language by name. A column named ``out`` is replaced; the other columns and repeated rows stay.
    """
    prepare(df.sparkSession)

    @F.arrow_udf("lang string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        scorer = worker_state(model, Scorer)
        rows = [scorer.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                           pa.array([r[1] for r in rows], pa.float64())], ["lang", "score"])

    return df.withColumn(out, predicted(F.col(text)))
