"""Language-model scores by context-tree weighting over bytes.

A text is a run of bytes between boundary marks; a byte is eight binary choices, each a node of a tree below the last
``depth`` bytes. At every context of 0 to ``depth`` bytes a node holds how often the training texts chose 0 and 1, and
the Krichevsky-Trofimov estimate of that record. A context's weight against its longer contexts is the ratio of its
own estimate to the product of theirs, which a walk from the longest contexts to the shortest sums up; a walk back
mixes the predictions of all depths into one probability per node. A context that training never met says nothing:
its shorter neighbour then has all the remaining weight.

On Spark: rows are stored in blocks of consecutive rows. Each block's distinct byte runs (context and next byte) are
counted where they are read and added up over all blocks. Below the contexts of ``depth - 2`` bytes the tree falls into
groups of bounded size that do not know of each other (at most 2^24 runs); whole groups are computed together in
tasks. Above, every depth is one aggregate and one join. Each block is then given the log probability of its own
distinct runs and the counts of its own distinct words, and scores its texts by looking them up. Nothing of the model is
broadcast or passes the driver but three totals.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path, released_shuffles, scratch_path
from .common import batches, prepare

DEPTH = 5  # bytes of the longest context
BLOCK_BYTES = 48_000_000  # about so much text gets one list of runs and words
MARK = 0xFF  # a byte that UTF-8 never uses: before a text, and its end
WINDOW = 1 << 21  # bytes looked at together
ROWS = 1 << 18  # runs of whole groups computed together, if no group is larger
SCORES = T.StructType([T.StructField(name, T.DoubleType() if name.endswith("score") else T.LongType()) for name in (
    "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")])


def runs(texts: list[bytes], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Context and next byte of every place of the texts and their ends, packed in one number.

    Yields the place where a stretch begins, its numbers, and which of its places are marks between texts. Text ``i``
    begins at the sum of the lengths before it and ``depth`` per text.
    """
    if not texts:
        return
    mark = bytes([MARK])
    buffer = np.frombuffer(mark * depth + (mark * depth).join(texts) + mark, np.uint8)
    ends = np.cumsum([len(t) + depth for t in texts]) - depth + 1  # behind the end mark of each text
    total = len(buffer) - depth
    for at in range(0, total, WINDOW):
        size = min(WINDOW, total - at)
        packed = np.zeros(size, np.int64)
        for i in range(depth + 1):
            packed <<= 8
            packed |= buffer[at + i:at + i + size]
        between = np.zeros(size, bool)
        near = ends[np.searchsorted(ends, at - depth):np.searchsorted(ends, at + size)]
        gaps = (near[:, None] + np.arange(depth - 1)).ravel() - at
        between[gaps[(gaps >= 0) & (gaps < size)]] = True
        yield at, packed, between


class Tally:
    """Distinct numbers and their counts, kept sorted."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, values: np.ndarray, weight: int) -> None:
        found, counts = np.unique(values, return_counts=True)
        self.parts.append((found, counts * weight))
        if len(self.parts) > 8:
            self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        values, counts = (np.concatenate(p) for p in zip(*self.parts))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        return values[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class Lookup:
    """Values of known numbers: sorted by a one-to-one hash, a table of first places points into them."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = keys.astype(np.uint64) * self.FACTOR
        order = np.argsort(hashed)
        self.hashed, self.values = hashed[order], values[order]
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashed >> self.shift, np.arange(1 << bits, dtype=np.uint64))

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        hashed = keys.astype(np.uint64) * self.FACTOR
        at = self.first[hashed >> self.shift]
        away = np.flatnonzero(self.hashed[at] != hashed)
        while len(away):
            at[away] += 1
            away = away[self.hashed[at[away]] != hashed[away]]
        return self.values[at]


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    """Consecutive texts of about ``WINDOW`` bytes."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= WINDOW:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _counted(stored: DataFrame, depth: int) -> DataFrame:
    """``_block, run, word, n``: a block's distinct runs and words and how often its training texts hold them."""

    def rows(block: int, tally: Tally, words: Counter) -> Iterator[pa.RecordBatch]:
        found, counts = tally.merged()
        names, times = list(words), np.fromiter(words.values(), np.int64, len(words))
        for some, other, n in ((found, None, counts), (None, names, times)):
            for at in range(0, len(n), 100_000):
                size = len(n[at:at + 100_000])
                yield pa.record_batch({
                    "_block": pa.array(np.full(size, block)),
                    "run": pa.array(some[at:at + size]) if some is not None else pa.nulls(size, pa.int64()),
                    "word": pa.array(other[at:at + size], pa.binary()) if other is not None else pa.nulls(size, pa.binary()),
                    "n": pa.array(n[at:at + size])})

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tally, words, held, waiting = None, Tally(), Counter(), {True: [], False: []}, 0

        def flush() -> None:
            for learn, texts in held.items():
                for _, packed, between in runs(texts, depth):
                    tally.add(packed[~between], int(learn))
                texts.clear()

        for part in parts:
            for block, learn, text in zip(*(part.column(c).to_pylist() for c in ("_block", "_learn", "_bytes"))):
                if block != current:
                    flush()
                    if current is not None:
                        yield from rows(current, tally, words)
                    current, tally, words = block, Tally(), Counter()
                text = (text or b"").lower()
                held[learn].append(text)
                if learn:
                    words.update(text.split())
                else:
                    for word in text.split():
                        words[word] += 0
                waiting += len(text)
                if waiting >= WINDOW:
                    flush()
                    waiting = 0
        flush()
        if current is not None:
            yield from rows(current, tally, words)

    return stored.select("_block", "_learn", "_bytes").mapInArrow(count, "_block long, run long, word binary, n long")


def _log_gamma(x, ln):
    """Stirling's series, eight steps further out; for columns and for arrays."""
    z, product = x + 8, x
    for i in range(1, 8):
        product = product * (x + i)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * ln(z) - z + 0.5 * math.log(2 * math.pi) + series - ln(product)


def log_estimate(zeros, ones, ln):
    """Natural logarithm of the Krichevsky-Trofimov probability of a record of zeros and ones, not both none."""
    return _log_gamma(zeros + 0.5, ln) + _log_gamma(ones + 0.5, ln) - _log_gamma(zeros + ones + 1.0, ln) - math.log(math.pi)


class _Scratch:
    """Tables of one run; each is deleted when it is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = scratch_path(self.spark, name)
        with released_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.paths.pop(name))


class Group:
    """The part of the tree below some contexts of ``tail`` bytes, from all their runs.

    A node is numbered by its context bytes and, in the lowest byte, a 1 followed by the bits chosen so far. Levels are
    held from the longest contexts to those of ``tail`` bytes.
    """

    def __init__(self, runs: np.ndarray, counts: np.ndarray, depth: int, tail: int):
        byte, step = runs & 255, np.arange(8)
        self.bits = (byte[:, None] >> (7 - step)) & 1
        nodes = ((runs >> 8) << 8)[:, None] | (1 << step) | (byte[:, None] >> (8 - step))
        keys, self.places = np.unique(nodes, return_inverse=True)
        self.places = self.places.reshape(nodes.shape)
        add = lambda at, weights, size: np.bincount(at, weights=weights, minlength=size)
        chosen = np.repeat(counts, 8).astype(np.float64)
        ones = add(self.places.ravel(), chosen * self.bits.ravel(), len(keys))
        zeros = add(self.places.ravel(), chosen, len(keys)) - ones
        self.levels = [(keys, zeros, ones, np.full(len(keys), -np.inf))]  # a longest context has none below
        self.above = []
        weighted = self.own(zeros, ones)
        for d in range(depth - 1, tail - 1, -1):
            found, at = np.unique(keys & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
            keys, zeros, ones, below = found, *(add(at, v, len(found)) for v in (zeros, ones, weighted))
            self.levels.append((keys, zeros, ones, below))
            self.above.append(at)
            own = self.own(zeros, ones)
            weighted = np.logaddexp(own, below) - math.log(2)

    @staticmethod
    def own(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        return np.where(zeros + ones > 0, log_estimate(zeros, ones, np.log), 0.0)

    def mixed(self, part: np.ndarray, rest: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 of the probability of every run, given what shorter contexts add for the nodes of the last level."""
        for i in range(len(self.levels) - 1, -1, -1):
            _, zeros, ones, below = self.levels[i]
            if i + 1 < len(self.levels):
                part, rest, before = (v[self.above[i]] for v in (part, rest, before))
            weight = 1 / (1 + np.exp(np.minimum(below - self.own(zeros, ones), 700)))
            one = (ones + 0.5) / (zeros + ones + 1)
            before = np.where(zeros + ones > 0, part + rest * one, before)
            part, rest = part + rest * weight * one, rest * (1 - weight)
        one = before[self.places]
        return np.log10(np.where(self.bits == 1, one, 1 - one)).sum(1)


def _whole_groups(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by ``tail``, put together until they are ``ROWS`` and no group is cut."""
    held: list[dict[str, np.ndarray]] = []

    def joined(some: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return {name: np.concatenate([s[name] for s in some]) for name in some[0]}

    for part in parts:
        if not len(part):
            continue
        held.append({name: part.column(name).to_numpy(zero_copy_only=False) for name in part.schema.names})
        if sum(len(h["tail"]) for h in held) >= ROWS and held[-1]["tail"][-1] != held[0]["tail"][0]:
            whole = joined(held)
            cut = np.searchsorted(whole["tail"], whole["tail"][-1])
            yield {name: v[:cut] for name, v in whole.items()}
            held = [{name: v[cut:] for name, v in whole.items()}]
    if held:
        yield joined(held)


def _probabilities(counts: DataFrame, depth: int, scratch: _Scratch) -> DataFrame:
    """``run, log10``: the mixed log probability of the last byte of every run after the others."""
    tail = max(0, depth - 2)
    with_tail = lambda node: F.expr(f"({node} >> 8) & {(1 << 8 * tail) - 1}")
    grouped = lambda df: df.repartition("tail").sortWithinPartitions("tail")

    def upward(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(parts):
            keys, zeros, ones, below = Group(rows["run"], rows["n"], depth, tail).levels[-1]
            yield pa.record_batch({"node": pa.array(keys), "zeros": pa.array(zeros), "ones": pa.array(ones), "below": pa.array(below)})

    with batches(scratch.spark, 20_000):
        level = grouped(counts.withColumn("tail", with_tail("run"))).mapInArrow(
            upward, "node long, zeros double, ones double, below double")
        levels = [scratch.put(level, f"depth{tail}")]
    seen = F.col("zeros") + F.col("ones") > 0
    own = F.when(seen, log_estimate(F.col("zeros"), F.col("ones"), F.ln)).otherwise(0.0)
    for d in range(tail - 1, -1, -1):
        larger, smaller = F.greatest("own", "below"), F.least("own", "below")
        level = levels[0].withColumn("own", own).select(
            F.col("node").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("node"), "zeros", "ones",
            (larger + F.log1p(F.exp(smaller - larger)) - math.log(2)).alias("weighted"))
        level = level.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        levels.insert(0, scratch.put(level, f"depth{d}"))

    state = None
    for d, level in enumerate(levels):
        weight, one = 1 / (1 + F.exp(F.col("below") - own)), (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        if state is None:
            level = level.withColumns({"part": F.lit(0.0), "rest": F.lit(1.0), "before": F.lit(0.5)})
        else:
            level = level.withColumn("shorter", F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1)))
            level = level.join(state.withColumnRenamed("node", "shorter"), "shorter")
        if d < tail:
            state = level.select(
                "node", (F.col("part") + F.col("rest") * weight * one).alias("part"), (F.col("rest") * (1 - weight)).alias("rest"),
                F.when(seen, F.col("part") + F.col("rest") * one).otherwise(F.col("before")).alias("before"))

    def downward(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(parts):
            run = rows["n"] >= 0
            group = Group(rows["key"][run], rows["n"][run], depth, tail)
            order = np.argsort(rows["key"][~run])
            logs = group.mixed(*(rows[c][~run][order] for c in ("part", "rest", "before")))
            yield pa.record_batch({"run": pa.array(rows["key"][run]), "log10": pa.array(logs)})

    none = F.lit(0.0)
    both = counts.select(with_tail("run").alias("tail"), F.col("run").alias("key"), "n", none.alias("part"), none.alias("rest"),
                         none.alias("before"))
    both = both.unionAll(level.select(with_tail("node"), "node", F.lit(-1).cast("long"), "part", "rest", "before"))
    with batches(scratch.spark, 20_000):
        known = scratch.put(grouped(both).mapInArrow(downward, "run long, log10 double"), "known")
    scratch.drop(*[f"depth{d}" for d in range(tail + 1)])
    return known


def score(df: DataFrame, learn: Column, text: str = "text", out: str = "lm", depth: int = DEPTH) -> DataFrame:
    """Add ``out``: struct ``n_tokens, n_known, train_tokens, base_score, score, n_bytes`` of every row's text.

    Rows for which ``learn`` is true train the model. Texts are taken with A-Z in lower case. ``score`` is the tree's
    log10 probability of the bytes and the end of the text, so ``-score / log10(2) / (n_bytes + 1)`` is its code length
    in bits per byte. Tokens are runs of other bytes than ASCII white space, and one end: ``base_score`` sums
    ``log10((c + 1) / (N + V + 1))``, with c the token's count, N all and V distinct tokens of the training texts.
    Null counts as empty, an empty text has its end only; without training texts every bit has probability one half.
    Repeated rows train as often as they occur. A column named ``out`` is replaced, the others stay.
    """
    spark, scratch = prepare(df.sparkSession), _Scratch(df.sparkSession)
    kept = df.drop(out)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("binary")), F.lit(0))
    count, total = kept.agg(F.count("*"), F.sum(size.cast("long"))).first()
    per_block = max(1, BLOCK_BYTES * count // max(total or 0, 1))
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept.columns)]  # names of ours clash with none
    stored = scratch.put(kept.select(*columns, F.coalesce(learn, F.lit(False)).alias("_learn"),
                                     F.monotonically_increasing_id().alias("_number")), "rows")
    # rows were numbered as they were written: a block lies in one file
    block = F.shiftright("_number", 33) * (1 << 24) + F.expr(f"(_number & {(1 << 33) - 1}) div {per_block}")
    stored, place = stored.withColumn("_block", block).drop("_number"), f"c{kept.columns.index(text)}"

    counted = scratch.put(_counted(stored.withColumn("_bytes", F.col(place).cast("binary")), depth), "counted")
    runs_in = counted.filter("run is not null").select("_block", "run", "n")
    counts = scratch.put(runs_in.groupBy("run").agg(F.sum("n").alias("n")), "counts")
    known = _probabilities(counts, depth, scratch)
    runs_of = scratch.put(runs_in.join(known, "run").groupBy("_block").agg(
        F.collect_list(F.struct("run", "log10")).alias("l")).select("_block", "l.run", "l.log10"), "runs_of")
    scratch.drop("counts", "known")
    words_in = counted.filter("word is not null").select("_block", "word", "n")
    spread = Window.partitionBy("word")
    words_in = scratch.put(words_in.withColumns({
        "c": F.sum("n").over(spread), "first": F.row_number().over(spread.orderBy("_block")) == 1}), "words")
    ends = stored.filter("_learn").count()
    tokens, distinct = words_in.agg(F.sum("n"), F.count_if(F.col("first") & (F.col("c") > 0))).first()
    totals = {"ends": ends, "tokens": (tokens or 0) + ends, "distinct": distinct + (ends > 0)}
    # a word whose whole count lies in a block is counted there again
    words_of = scratch.put(words_in.filter("c > n").groupBy("_block").agg(F.collect_list(F.struct("word", "c")).alias("l"))
                           .select("_block", "l.word", "l.c"), "words_of")
    scratch.drop("counted", "words")

    no = F.lit(None)
    given = runs_of.select("_block", F.col("run").alias("runs"), F.col("log10").alias("logs"),
                           no.cast("array<binary>").alias("words"), no.cast("array<bigint>").alias("counts"))
    given = given.unionAll(words_of.select("_block", no.cast("array<bigint>"), no.cast("array<double>"), "word", "c"))

    def scored(given: pa.Table, rows: pa.Table) -> pa.Table:
        texts = [(t or b"").lower() for t in rows.column(place).cast(pa.binary()).to_pylist()]
        logs, counts = None, Counter()
        for text, learn in zip(texts, rows.column("_learn").to_pylist()):
            if learn:
                counts.update(text.split())
        for runs_of, logs_of, words_of, counts_of in zip(*(given.column(c) for c in ("runs", "logs", "words", "counts"))):
            if runs_of.is_valid:
                logs = Lookup(runs_of.values.to_numpy(), logs_of.values.to_numpy())
            else:
                dict.update(counts, zip(words_of.values.to_pylist(), counts_of.values.to_pylist()))
        found = _scores(texts, logs, counts, totals, depth)
        whole = rows.drop_columns(["_block", "_learn"])
        return whole.append_column("_scores", pa.StructArray.from_arrays(list(found.values()), names=list(found)))

    schema = T.StructType([f for f in stored.schema.fields if f.name[0] == "c"] + [T.StructField("_scores", SCORES)])
    found = given.groupBy("_block").cogroup(stored.groupBy("_block")).applyInArrow(scored, schema)
    return found.toDF(*kept.columns, out)


def _scores(texts: list[bytes], logs: Lookup, counts: dict[bytes, int], totals: dict[str, int], depth: int) -> dict[str, pa.Array]:
    """The scores of the texts of a block, which holds every run and every trained word of them."""
    score, base = np.zeros(len(texts)), np.zeros(len(texts))
    n_tokens, n_known = np.ones(len(texts), np.int64), np.full(len(texts), int(totals["ends"] > 0))
    for chunk in _chunks(texts):
        some = texts[chunk]
        starts = np.cumsum([0, *(len(t) + depth for t in some[:-1])])
        for at, packed, between in runs(some, depth):
            found = np.zeros(len(packed))
            found[~between] = logs[packed[~between]]
            low, high = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + len(packed))
            score[chunk][low:high] += np.add.reduceat(found, np.maximum(starts[low:high], at) - at)
    for i, text in enumerate(texts):
        words = text.split()
        seen = np.fromiter((counts.get(w, 0) for w in words), np.float64, len(words))
        n_tokens[i] += len(words)
        n_known[i] += np.count_nonzero(seen)
        base[i] = np.log10(seen + 1).sum()
    base += math.log10(totals["ends"] + 1) - n_tokens * math.log10(totals["tokens"] + totals["distinct"] + 1)
    return {"n_tokens": pa.array(n_tokens), "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(texts), totals["tokens"])), "base_score": pa.array(base),
            "score": pa.array(score), "n_bytes": pa.array(np.array([len(t) for t in texts], np.int64))}
