"""Near-duplicate classes by Order MinHash and banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence. A sketch hashes the labelled shingles,
takes the ``LENGTH`` smallest and keeps them *in the order of the text*, so it agrees for texts a few edits apart and
not for texts that merely share vocabulary. Each of ``SKETCHES`` sketches puts a text into one bucket.

The buckets find most links cheaply. No bucket is expanded into pairs: its best-known member (the one whose buckets hold
most texts, the likely original of a family of copies) is compared with the others; those it does not match go on to
the next round under finer keys made of several sketches, until none is left open. This loses links: a bucket may be
led by a third text, and finer keys keep fewer texts together.

What the buckets lose is found exactly by a prefix filter. Shingles have one order for all texts, rare ones first. Two
texts of the wanted similarity share one of their first shingles (``prefix_sizes``), whatever the order is, so texts of
different classes that share one, and whose sizes and places in the order still allow the similarity, are compared,
in turns between which classes are joined: a pair inside a class needs no comparison.

A pair is verified by alignment: the longest common subsequence of the two shingle sequences inside the diagonal band
that a similarity of ``SIMILARITY`` allows. Similarity is matched over all distinct shingles of the pair, so it is the
Jaccard similarity of texts whose common parts stand in the same order, and smaller otherwise. Classes are the
connected components of the verified pairs.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import prepare
from .decontamination import words

WORDS, SIMILARITY = 5, 0.8
SKETCHES, LENGTH = 16, 3
# finer keys of the second round: steps between the sketches that form one key
FINER = ((0, 1, 2), (0, 3, 7), (0, 1, 5, 10), (0, 2, 6, 9))
_TOGETHER = 4096  # shingles of one text hashed for all sketches at once
CELL_BITS, CHUNK_BITS = 22, 16  # shingles are counted in so many cells, and the counts added up in chunks
SIEVE_BITS = 28  # 32 MB
LEADERS, GROWTH = 8, 8  # texts of a key that the others are compared with in the first turn, and times more in each next
_SHARE = SIMILARITY / (1 + SIMILARITY)  # of the shingles of both texts of a pair, that must be common

_ODD = np.random.default_rng(20).integers(1, 2**63, SKETCHES + WORDS, np.uint64) | np.uint64(1)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def word_numbers(text: str | None) -> np.ndarray:
    """A 32-bit number for each word, in order: all that shingles are made of, at half their size."""
    found = words(text.lower()) if text else []
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of every five consecutive words, in order; a shorter text of any words is one shingle."""
    return joined_words(word_numbers(text))


def joined_words(numbers: np.ndarray) -> np.ndarray:
    """The shingles of a text by the numbers of its words."""
    if not len(numbers):
        return np.zeros(0, np.uint64)
    numbers = numbers.astype(np.uint64)
    width = min(WORDS, len(numbers))
    count = len(numbers) - width + 1
    total = np.full(count, width, np.uint64)
    for i in range(width):
        total = _stirred(total * _ODD[SKETCHES + i] + numbers[i:i + count])
    return total


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Make repeated shingles differ by the number of their occurrence."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if first.all():
        return hashes
    starts = np.flatnonzero(first)
    occurrence = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    out = hashes.copy()
    again = order[occurrence > 0]
    out[again] = _stirred(hashes[again] + occurrence[occurrence > 0].astype(np.uint64) * _ODD[0])
    return out


def sketches(hashes: np.ndarray) -> list[int]:
    """One number per sketch, none for a text without words."""
    if not len(hashes):
        return []
    marked = labelled(hashes)
    take = min(LENGTH, len(marked))
    keys = _ODD[:SKETCHES, None]
    blocks = [keys] if len(marked) <= _TOGETHER else [keys[i:i + 1] for i in range(SKETCHES)]
    out = []
    for block in blocks:
        drawn = _stirred((marked[None, :] ^ (block >> np.uint64(7))) * block)
        places = np.sort(np.argpartition(drawn, take - 1, axis=1)[:, :take], axis=1)
        value = np.zeros(len(block), np.uint64)
        for i in range(take):
            value = _stirred(value * _ODD[1] + marked[places[:, i]])
        out += value.astype(np.int64).tolist()
    return out


def _rising(places: np.ndarray) -> int:
    """Length of the longest increasing run of entries."""
    if len(places) < 2 or (np.diff(places) > 0).all():
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        at = bisect_left(tails, p)
        tails[at:at + 1] = [p]
    return len(tails)


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Matched shingles over all shingles of two texts; neither array holds a value twice."""
    total = len(a) + len(b)
    band = max(len(a), len(b)) - SIMILARITY / (1 + SIMILARITY) * total  # a longer shift leaves too few matches
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(ia - ib) <= band
    ia, ib = ia[inside], ib[inside]
    if len(ia) < SIMILARITY * (total - len(ia)):
        return len(ia) / (total - len(ia))
    matched = _rising(ib[np.argsort(ia)])
    return matched / (total - matched)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Every shingle once, where it occurs first."""
    return hashes[np.sort(np.unique(hashes, return_index=True)[1])]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sketched(texts: pa.Array) -> pa.Array:
    return pa.array([sketches(shingles(t)) for t in texts.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(T.BinaryType())
def _shingled(texts: pa.Array) -> pa.Array:
    return pa.array([word_numbers(t).tobytes() for t in texts.to_pylist()], pa.binary())


@F.arrow_udf(T.DoubleType())
def _compared(left: pa.Array, right: pa.Array) -> pa.Array:
    made: dict[bytes, np.ndarray] = {}  # a leader stands in many pairs of a batch

    def read(a: bytes) -> np.ndarray:
        if a not in made:
            made[a] = distinct(joined_words(np.frombuffer(a, np.uint32)))
        return made[a]

    return pa.array([aligned(read(a), read(b)) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.float64())


def _of_sketches(start: int, offsets: tuple[int, ...], *more: Column) -> Column:
    parts = [F.col("sketches")[(start + o) % SKETCHES] for o in offsets]
    return F.xxhash64(F.lit(start), F.lit(str(offsets)), *parts, *more)


def _finer(left: DataFrame, sketched: DataFrame) -> DataFrame:
    """The texts that share an open bucket, under keys of several sketches."""
    shared = left.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    ids = left.join(shared, "key", "left_semi").select("id", "rank").distinct()
    keys = F.explode(F.array(*[_of_sketches(start, o) for start in range(SKETCHES) for o in FINER]))
    return ids.join(sketched, "id").select(keys.alias("key"), "id", "rank")


def _longer(left: DataFrame, sketched: DataFrame, turn: int) -> DataFrame:
    """The same buckets divided by more sketches, one more of them each turn."""
    more = tuple(7 * i for i in range(turn))
    return left.join(sketched, "id").select(_of_sketches(3 * turn, more, F.col("key")).alias("key"), "id", "rank")


def _verified(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    both = pairs.join(prints.select(F.col("id").alias("a"), F.col("print").alias("_pa")), "a").join(
        prints.select(F.col("id").alias("b"), F.col("print").alias("_pb")), "b")
    return materialize(both.select(*pairs.columns, _compared("_pa", "_pb").alias("similarity"))
                       .filter(F.col("similarity") >= SIMILARITY), "links")


def links(sketched: DataFrame, prints_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Verified pairs ``a, b, similarity`` between the distinct ids of ``id, sketches`` rows, as far as buckets find them.

    ``prints_of`` returns ``id, print`` for a table of ids, the numbers of a text's words, of which its shingles are made
    where it is compared: prints are most of what is shuffled and stored. They are returned as well.
    """
    each = sketched.select("id", F.posexplode("sketches").alias("_of", "_value"))
    rows = each.select(F.xxhash64("_of", "_value").alias("key"), "id")
    # how many texts share buckets with an id: the original of a family ranks first
    sizes = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = materialize(rows.join(sizes, "key"), "buckets")
    ranks = shared.groupBy("id").agg(F.sum("_n").alias("rank"))
    rows = materialize(shared.select("key", "id").join(ranks, "id"), "ranked")
    prints = materialize(prints_of(ranks.select("id")), "prints")
    return _led(rows, sketched, prints), prints


def _led(rows: DataFrame, sketched: DataFrame, prints: DataFrame) -> DataFrame:
    found, turn = [], 0
    while True:
        leaders = rows.groupBy("key").agg(F.max(F.struct("rank", F.negative("id").alias("neg"))).alias("_l"),
                                          F.count("*").alias("_n")).filter("_n > 1")
        starred = materialize(rows.join(leaders.select("key", F.negative("_l.neg").alias("leader")), "key")
                              .filter("id <> leader"), "starred")
        if starred.isEmpty():
            break
        pairs = starred.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        verified = _verified(pairs, prints)
        found.append(verified)
        matched = verified.select(F.explode(F.array(
            F.struct(F.col("a").alias("id"), F.col("b").alias("leader")),
            F.struct(F.col("b").alias("id"), F.col("a").alias("leader")))).alias("_m")).select("_m.*")
        left = materialize(starred.join(matched, ["id", "leader"], "left_anti").select("key", "id", "rank"), "left")
        # the second round takes finer keys and the third the same again; later ones divide what is still shared
        rows = _finer(left, sketched) if turn == 0 else left if turn == 1 else _longer(left, sketched, turn)
        turn += 1
    empty = sketched.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).limit(0)
    for part in found:
        empty = empty.unionByName(part)
    return empty


def prefix_sizes(n: int) -> tuple[int, int]:
    """How many of its first shingles a text of ``n`` must share one of with a longer text, and with a shorter one.

    ``n`` and ``m`` distinct shingles need ``SIMILARITY / (1 + SIMILARITY) * (n + m)`` common ones, and the longer text
    has at most ``n / SIMILARITY``.
    """
    common = math.ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-9)
    return n - common + 1, n - math.ceil(SIMILARITY * n - 1e-9) + 1


def ordered(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Distinct shingles as keys that sort by how often their cell was counted."""
    once = np.unique(hashes)
    level = levels[once >> np.uint64(64 - CELL_BITS)].astype(np.uint64)
    return np.sort((level << np.uint64(58)) | (once >> np.uint64(6)))


def shingle_levels(texts: DataFrame) -> Broadcast:
    """Binary logarithm of the shingles in each cell; any error here costs time, not links."""
    chunk = 1 << CHUNK_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(cells, shingles(text) >> np.uint64(64 - CELL_BITS), 1)
        for i in range(0, len(cells), chunk):
            if cells[i:i + chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // chunk], pa.int32()),
                                                  pa.array([cells[i:i + chunk].tobytes()], pa.binary())], ["chunk", "cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(chunk, np.uint64), None
        for batch in batches:
            number = batch.column(0)[0]
            for cells in batch.column(1).to_pylist():
                total += np.frombuffer(cells, np.uint32)
        levels = np.ceil(np.log2(total + 1.0)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([number.as_py()], pa.int32()), pa.array([levels.tobytes()], pa.binary())],
                                         ["chunk", "levels"])

    found = texts.select("text").mapInArrow(counted, "chunk int, cells binary").groupBy("chunk").applyInArrow(
        added, "chunk int, levels binary")
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    for r in materialize(found, "levels").collect():
        levels[r["chunk"] * chunk:(r["chunk"] + 1) * chunk] = np.frombuffer(r["levels"], np.uint8)
    return texts.sparkSession.sparkContext.broadcast(levels)


def prefixes(texts: DataFrame) -> DataFrame:
    """``n, first``, the size of every text in distinct shingles and its first ones, added to ``texts`` without ``text``."""
    shared = shingle_levels(texts)

    @F.arrow_udf("struct<n: int, first: array<bigint>>")
    def prefixed(column: pa.Array) -> pa.Array:
        sizes, firsts = [], []
        for text in column.to_pylist():
            keys = ordered(shingles(text), shared.value)
            sizes.append(len(keys))
            firsts.append(keys[:prefix_sizes(len(keys))[1]].view(np.int64) if len(keys) else [])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], ["n", "first"])

    return texts.withColumn("_p", prefixed("text")).drop("text").select("*", "_p.*").drop("_p")


class Sieve:
    """A Bloom filter of one hash that drops, where rows are read, most of those whose key is not among ``keys``.

    It has 16 bits a key up to ``2^SIEVE_BITS`` bits; beyond, it drops less. What passes is joined exactly afterwards.
    """

    def __init__(self, keys: DataFrame, column: str):
        count = keys.count()
        self.bits = min(SIEVE_BITS, max(15, (16 * count).bit_length()))
        place = self._place(F.col(column)) + 1
        buckets = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy(
            "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        whole = np.zeros((1 << self.bits - 15, 1 << 12), np.uint8)
        for r in materialize(buckets, "sieve").collect():  # at most 2^SIEVE_BITS bits
            whole[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
        self.held = keys.sparkSession.sparkContext.broadcast(whole.ravel())

    def _place(self, key: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - self.bits)

    def passing(self, keys: Column) -> Column:
        """The places in an array of those that may be among them."""
        held = self.held

        @F.arrow_udf("array<int>")
        def known(places: pa.Array) -> pa.Array:
            found = [np.flatnonzero(_set(held.value, np.array(p, np.int64))) if p else [] for p in places.to_pylist()]
            return pa.array(found, pa.list_(pa.int32()))

        return known(F.transform(keys, self._place))

    def prints(self, texts: DataFrame, column: str) -> DataFrame:
        """``id, print`` and ``column`` of the ``texts`` whose key may be among them: no other is made a print or shuffled."""
        held = self.held

        def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = batch.column(2).to_numpy()
                kept = batch.filter(pa.array(_set(held.value, places)))
                made = pa.array([word_numbers(t).tobytes() for t in kept.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), made], ["id", column, "print"])

        rows = texts.select("id", column, self._place(F.col(column)).alias("place"), "text")
        return rows.mapInArrow(printed, T.StructType([*rows.schema.fields[:2], T.StructField("print", T.BinaryType())]))


def _set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def missed(lists: DataFrame, prints_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs ``a, b, similarity`` of texts ``id, class, n, first`` whose classes differ: all that are needed to join them.

    A pair is left out only where pairs of an earlier turn have already put both texts into one class.
    """
    # a shingle that only one class has among its first ones links nothing
    several = materialize(lists.select(F.explode("first").alias("key"), "class").groupBy("key").agg(
        F.min("class").alias("_a"), F.max("class").alias("_z")).filter("_a <> _z").select("key"), "several")
    rows = lists.select("id", "class", "n", "first", F.explode(Sieve(several, "key").passing(F.col("first"))).alias("at"))
    rows = rows.select("id", "class", "n", "at", F.col("first")[F.col("at")].alias("key"))
    # the shorter text, of equal ones that of the smaller id, is looked up by fewer of its shingles
    rows = rows.withColumn("early", F.col("at") < F.col("n") - F.ceil(2 * _SHARE * F.col("n") - 1e-9) + 1)
    rows = materialize(rows.join(several, "key"), "first_shingles")
    # the class most of a key's texts are in: two of them are no pair, and nothing looks for one
    most = rows.groupBy("key", "class").count().groupBy("key").agg(F.max(F.struct("count", "class"))["class"].alias("main"))
    rows = materialize(rows.join(most, "key"), "main_classes")
    others = materialize(_partnered(rows.filter("class <> main"), rows), "others")
    rows = materialize(others.unionByName(_partnered(rows.filter("class = main"), others)), "partnered")
    return _in_turns(rows, materialize(prints_of(rows.select("id").distinct()), "prints"))


def _possible() -> Column:
    """Whether texts ``s`` and ``t`` that share a first shingle may be similar and are not in one class."""
    n, m = F.col("s.n"), F.col("t.n")
    shorter = (n < m) | ((n == m) & (F.col("s.id") < F.col("t.id")))
    return ((F.col("s.key") == F.col("t.key")) & (F.col("s.class") != F.col("t.class"))
            & F.when(shorter, F.col("s.early")).otherwise(F.col("t.early"))
            & (F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9)
            # were this their first common shingle, enough would have to follow in both
            & (F.least(n - F.col("s.at"), m - F.col("t.at")) >= _SHARE * (n + m) - 1e-9))


def _partnered(rows: DataFrame, partners: DataFrame) -> DataFrame:
    return rows.alias("s").join(partners.alias("t"), _possible(), "left_semi")


def _in_turns(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """Compare the texts of each key with its first ``LEADERS`` ones, then with ``GROWTH`` times as many, and so on.

    The classes are joined after every turn. A stray copy of a large class meets a few of its texts until one matches,
    not all of them; texts that match nothing are compared with every text the filter leaves, each pair once.
    """
    in_main, u = F.col("class") == F.col("main"), F.shiftrightunsigned(F.xxhash64("id"), 33) / 2.0**31
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if(in_main).alias("_m"))
    # the main class leads, in an order that keys of the same texts have in common
    place = F.when(in_main, F.floor(u * F.col("_m"))).otherwise(F.col("_m") + F.floor(u * (F.col("size") - F.col("_m"))))
    rows = materialize(rows.join(sizes, "key").withColumn("place", place).drop("_m"), "placed")
    found, done, start, end = [], [], 0, LEADERS
    while True:
        leader = F.least("s.place", "t.place")
        pairs = rows.alias("s").join(rows.filter("class <> main").alias("t"), _possible() & (leader >= start) & (leader < end)
                                     & ((F.col("s.class") == F.col("s.main")) | (F.col("s.id") < F.col("t.id"))))
        pairs = pairs.select(F.least("s.id", "t.id").alias("a"), F.greatest("s.id", "t.id").alias("b"),
                             F.least("s.class", "t.class").alias("_c"), F.greatest("s.class", "t.class").alias("_d")).distinct()
        for before in done:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        done.append(pairs.select("a", "b"))
        verified = _verified(pairs, prints)
        found.append(verified.select("a", "b", "similarity"))
        rows = rows.filter(F.col("size") > end)  # all pairs of the others have had their turn
        if rows.isEmpty():
            break
        if not verified.isEmpty():
            moved = components(verified.select(F.col("_c").alias("a"), F.col("_d").alias("b")))
            rows = _renamed(_renamed(rows, moved, "class"), moved, "main")
        rows = materialize(rows, "open")
        if rows.filter("class <> main").isEmpty():
            break
        start, end = end, GROWTH * end
    return reduce(DataFrame.unionByName, found)


def _renamed(rows: DataFrame, moved: DataFrame, column: str) -> DataFrame:
    to = moved.select(F.col("id").alias(column), F.col("class").alias("_to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def components(edges: DataFrame) -> DataFrame:
    """``id, class`` for the ids of ``a, b`` pairs; the class is the smallest id that can be reached.

    Every round links each id's larger neighbours, then its smaller ones, to the smallest (two reductions per round);
    the number of rounds grows with the logarithm of the longest chain. Only counts reach the driver.
    """
    links_ = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = links_.union(links_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            low.select("u", F.col("low").alias("v"))).distinct()
        links_ = materialize(small, "edges")
        before, state = state, links_.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if state == before:
            break
    return links_.select(F.col("u").alias("id"), F.col("v").alias("class"))


def _text_classes(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows as ``id, same``; distinct texts as ``tid, first, same`` (their smallest id, their hash); ``id, class`` of the
    texts that are linked to others, both numbers of texts.

    Texts are told apart by their hash from start to end, whatever ids they carry; rows with a null id take no part.
    """
    prepare(df.sparkSession)
    named = df.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hashed = named.withColumn("same", F.sha2("text", 256))
    # one pass over the texts; from here on rows are narrow
    scanned = materialize(hashed.select("id", "same", _sketched("text").alias("sketches")), "sketches")
    texts = materialize(scanned.filter("id is not null").groupBy("same").agg(
        F.min("id").alias("first"), F.any_value("sketches").alias("sketches")).withColumn(
        "tid", F.monotonically_increasing_id()), "texts")
    sketched = texts.filter(F.size("sketches") > 0).select(F.col("tid").alias("id"), "sketches")
    # a text is read where its smallest id has it
    standing = texts.filter(F.size("sketches") > 0).select(F.col("first").alias("id"), "same", "tid")

    def prints_of(ids: DataFrame) -> DataFrame:
        wanted = materialize(standing.join(ids.select(F.col("id").alias("tid")), "tid", "left_semi"), "wanted")  # broadcast if few
        # repeated rows are told by what they were joined by: as tid, at the price of no second shuffle
        found = Sieve(wanted, "same").prints(hashed, "same").join(wanted, ["id", "same"]).dropDuplicates(["id", "same"])
        return found.select(F.col("tid").alias("id"), "print")

    linked, prints = links(sketched, prints_of)
    joined = components(linked.select("a", "b"))
    classed = standing.join(joined.select(F.col("id").alias("tid"), "class"), "tid", "left").withColumn(
        "class", F.coalesce("class", "tid"))
    # an inner join, which is not moved below the lists of shingles: no text is shuffled
    listed = prefixes(hashed).join(classed, ["id", "same"])
    lists = materialize(listed.dropDuplicates(["id", "same"]).select(F.col("tid").alias("id"), "class", "n", "first"), "prefixes")

    def all_prints(ids: DataFrame) -> DataFrame:
        new = materialize(ids.join(prints, "id", "left_anti"), "new_ids")
        return prints.join(ids, "id", "left_semi").union(prints_of(new))

    more = missed(lists, all_prints)
    if not more.isEmpty():
        joined = components(joined.select(F.col("id").alias("a"), F.col("class").alias("b")).union(more.select("a", "b")))
    return scanned.select("id", "same"), texts.select("tid", "first", "same"), joined


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id`` of every row: rows in one class are exact copies or linked by near-duplicate pairs.

    The class is named by its smallest id. Null texts count as empty; empty texts are copies of each other, and texts
    without any word match only their exact copies. Every text of an id given to several finds its own links, and the
    id, being one document in the result, joins their classes. Rows with a null id get a null class and link nothing.
    Repeated rows are returned as often as they occur; an empty table gives an empty table.
    """
    rows, texts, joined = _text_classes(df, doc_id, text)
    # stored, so that the join has a shuffle of its own, which may split a text of very many copies
    copies = materialize(rows.join(texts.select("same", "tid"), "same", "left").select(
        "id", F.when(F.col("id").isNotNull(), F.col("tid")).alias("tid")), "copies")
    several = copies.groupBy("id").agg(F.min("tid").alias("a"), F.max("tid").alias("z")).filter("a <> z")
    tied = materialize(copies.join(several.select("id", "a"), "id").select("a", F.col("tid").alias("b")).filter("a <> b"), "tied")
    if not tied.isEmpty():
        joined = components(joined.select(F.col("id").alias("a"), F.col("class").alias("b")).union(tied))
    classed = texts.join(joined.withColumnRenamed("id", "tid"), "tid", "left").select(
        "tid", "first", F.coalesce("class", "tid").alias("class"))
    names = classed.groupBy("class").agg(F.min("first").alias("class_id"))
    named = materialize(classed.join(names, "class").select("tid", "class_id"), "classes")
    return copies.join(named, "tid", "left").select(F.col("id").alias(doc_id), "class_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of texts, of the smallest id and then the smallest hash; rows with a null id all stay.

    Unlike in ``classes`` an id ties nothing: of an id given to unlike texts each of them stays.
    """
    _, texts, joined = _text_classes(df, doc_id, text)
    classed = texts.join(joined.withColumnRenamed("id", "tid"), "tid", "left").withColumn("class", F.coalesce("class", "tid"))
    kept = materialize(classed.groupBy("class").agg(F.min(F.struct("first", "same")).alias("k")).select(
        F.col("k.first").alias("_first"), F.col("k.same").alias("_same")), "kept")
    hashed = df.withColumns({"_first": F.col(f"`{doc_id}`"), "_same": F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)})
    one = hashed.join(kept, ["_first", "_same"], "left_semi").dropDuplicates(["_first", "_same"])
    columns = [F.col(f"`{c}`") for c in df.columns]
    return one.select(*columns).unionByName(df.filter(F.col(f"`{doc_id}`").isNull()).select(*columns))
