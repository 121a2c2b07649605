"""Benchmark decontamination: find benchmark windows in documents, remove spans or documents.

A word is a run of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII. A window is ``width``
consecutive words of a benchmark item; an item of fewer words is one window. The windows of a bounded block of items
form a hash set that is broadcast; token windows of every document are looked up in it. Only windows made wholly of
words that some item holds are looked up, and a hit compares the words themselves, not a digest. Larger benchmarks are
cut into more blocks, each seen by every document, so the broadcast never grows with the benchmark.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import prepare, worker_state

WIDTH = 13
BLOCK_CHARS = 4_000_000  # characters of benchmark text behind one broadcast: some 100 MB in a Python worker
HIT_SHARE = 20  # contaminated: at least one word in so many is hit

_SPLITS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_NORMAL = bytes.maketrans(bytes(range(65, 91)) + _SPLITS, bytes(range(97, 123)) + b" " * len(_SPLITS))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = "n_words bigint, hit_words array<int>, items array<bigint>"


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Windows:
    """The windows of one block of items, by width and word numbers."""

    def __init__(self, held: dict):
        self.vocabulary = _Vocabulary()
        self.items: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        for item_id, text in held["items"]:
            found = words(text)
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int32)
            width = min(held["width"], len(numbers))
            for start in range(len(numbers) - width + 1 if width else 0):
                owners = self.items[width].setdefault(numbers[start:start + width].tobytes(), [])
                if item_id not in owners[-1:]:
                    owners.append(item_id)

    def hits(self, found: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Numbers of the hit words, ascending, and the items whose windows occur."""
        numbers = np.fromiter(map(self.vocabulary.__getitem__, found), np.int32, len(found))
        unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
        hit, items = np.zeros(len(numbers) + 1, np.int32), set()
        for width, windows in self.items.items():
            if width > len(numbers):
                continue
            for start in np.flatnonzero(unknown[width:] == unknown[:-width]).tolist():
                owners = windows.get(numbers[start:start + width].tobytes())
                if owners:
                    items.update(owners)
                    hit[start] += 1
                    hit[start + width] -= 1
        return np.flatnonzero(np.cumsum(hit)[:-1] > 0), items


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_NORMAL).split() if text else []


def _blocks(benchmark: DataFrame, item_id: str, text: str, width: int) -> list[Broadcast]:
    spark = benchmark.sparkSession
    items = benchmark.filter(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("long").alias("_item"), F.col(text).alias("_words")).distinct()
    total = items.agg(F.sum(F.length("_words"))).first()[0] or 0
    count = math.ceil(total / BLOCK_CHARS)
    numbered = items.withColumn("_block", F.pmod(F.xxhash64("_item", "_words"), F.lit(max(count, 1))))
    # each round of the loop holds one bounded block on the driver, not the table
    return [spark.sparkContext.broadcast({"width": width, "items": [
        tuple(r) for r in numbered.filter(F.col("_block") == block).drop("_block").collect()]}) for block in range(count)]


def find_hits(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", out: str = "hits", width: int = WIDTH) -> DataFrame:
    """Add ``out``: struct ``n_words``, ``hit_words`` (numbers of the words inside a window), ``items`` (sorted ids).

    Null and empty texts have no words and no hits. Items with null id or text are no items; repeated items count
    once. With an empty benchmark nothing is hit. A column named ``out`` is replaced, the others and repeated rows stay.
    """
    spark = prepare(df.sparkSession)

    def looked_up(windows: Broadcast | None):
        @F.arrow_udf(HITS)
        def hits(texts: pa.Array, before: pa.Array) -> pa.Array:
            block = worker_state(windows, Windows) if windows else None
            rows = []
            for one, earlier in zip(texts.to_pylist(), before.to_pylist()):
                found = words(one)
                hit, items = block.hits(found) if block and found else (np.zeros(0, np.int64), set())
                if earlier:
                    hit, items = np.union1d(hit, earlier["hit_words"]), items | set(earlier["items"])
                rows.append({"n_words": len(found), "hit_words": hit.astype(np.int32), "items": sorted(items)})
            return pa.array(rows, pa.struct([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())),
                                             ("items", pa.list_(pa.int64()))]))

        return hits

    blocks = _blocks(benchmark, item_id, item_text, width) or [None]
    found = df.withColumn(out, F.lit(None).cast(f"struct<{_ddl(HITS)}>"))
    for number, block in enumerate(blocks):
        if number:
            found = materialize(found, "hits")
        found = found.withColumn(out, looked_up(block)(F.col(text), F.col(out)))
    return found


def _ddl(fields: str) -> str:
    return ", ".join(field.replace(" ", ":", 1) for field in fields.split(", "))


def contaminated(hits: Column) -> Column:
    """At least one word hit, and at least one word in ``HIT_SHARE``."""
    n_hit = F.size(hits["hit_words"])
    return (n_hit > 0) & (HIT_SHARE * n_hit >= hits["n_words"])


def remove_documents(df: DataFrame, benchmark: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """The rows of ``df`` whose text is not contaminated, unchanged."""
    found = find_hits(df, benchmark, text, out="_hits", **names)
    return found.filter(~contaminated(F.col("_hits"))).select(*[F.col(f"`{c}`") for c in df.columns])


def remove_spans(df: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "cleaned", **names: str) -> DataFrame:
    """Add ``out``: the text without its hit words and what stands between them; null stays null."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, hit_words: pa.Array) -> pa.Array:
        return pa.array([t if not hit else _without(t, hit) for t, hit in zip(texts.to_pylist(), hit_words.to_pylist())],
                        pa.string())

    found = find_hits(df, benchmark, text, out="_hits", **names)
    return found.withColumn(out, cut(F.col(text), F.col("_hits.hit_words"))).drop("_hits")


def _without(text: str, hit: list[int]) -> str:
    places = [m.span() for m in WORD.finditer(text)]
    kept, end, last = [], 0, None
    for number in hit:
        if last is None or number != last + 1:
            kept.append(text[end:places[number][0]])
        end, last = places[number][1], number
    return "".join(kept) + text[end:]
