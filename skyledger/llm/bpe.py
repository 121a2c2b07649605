"""Byte-level BPE encoding and decoding in linear time.

The vocabulary is a rank file: a token's id is also the priority of the merge that makes it. A sequence of tokens is
the one that merging by priority gives exactly when every pair of neighbours is *compatible*: merging the bytes of the
pair alone gives back the same two tokens. So a piece is encoded without merging: an Aho-Corasick automaton over the
vocabulary (bytes written as Latin-1 characters) yields every token that occurs in it, and a walk takes the longest
token at each place that is compatible with its left neighbour, stepping back when none is. Places found to be dead
ends are marked, so each place is left at most once per token that starts there. Compatibility is memoised.

Encoding is a column expression over Arrow batches: no shuffle, and the other columns never reach Python.
"""

from __future__ import annotations

import base64
from array import array
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, worker_state

CACHED_PIECES = 400_000  # pieces kept per Python worker; the memo starts anew when full
CACHED_PAIRS = 400_000
CACHED_LENGTH = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain definition of BPE, quadratic in the piece: join the neighbours of the lowest rank, the leftmost first."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks) * 2), i) for i in range(len(parts) - 1))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Encoder:
    """Encodes the pieces of a text; kept by a Python worker between batches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds every token; made by the first text, as decoding does without."""
        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            found.add_word(token.decode("latin-1"), (rank, len(token)))
        found.make_automaton()
        return found

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 32 | right  # one number takes half the memory of a pair
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = merge(self.tokens[left] + self.tokens[right], self.ranks) == [left, right]
            self.pairs[pair] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        starting: list[list[tuple[int, int]]] = [[] for _ in piece]
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            starting[end - length + 1].append((rank, length))  # ends ascend, so the longest comes last
        dead = bytearray(len(piece) + 1)
        path: list[tuple[int, int, int]] = []  # token, start, choices left at that start
        at, left = 0, len(starting[0])
        while at < len(piece):
            choices = starting[at]
            while left:
                left -= 1
                rank, length = choices[left]
                if not dead[at + length] and (not path or self.compatible(path[-1][0], rank)):
                    path.append((rank, at, left))
                    at += length
                    left = len(starting[at]) if at < len(piece) else 0
                    break
            else:
                if not path:
                    raise ValueError("a byte of the text has no token in the vocabulary")
                dead[at] = 1
                _, at, left = path.pop()
        return [rank for rank, _, _ in path]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        pieces, known = self.pattern.findall(text), self.pieces
        out = []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = array("I", self.encode_piece(piece.encode("utf-8"))).tobytes()
                if len(piece) <= CACHED_LENGTH:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in array("I", ids)])


def share(spark: SparkSession, ranks_path: str, pattern: str) -> Broadcast:
    """Read the rank file on the driver and send it to the executors; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast({"ranks": read_ranks(ranks_path), "pattern": pattern})


def _encoder(held: dict) -> Encoder:
    return Encoder(held["ranks"], held["pattern"])


def encode(df: DataFrame, vocabulary: Broadcast, text: str = "text", out: str = "bpe") -> DataFrame:
    """Add ``out``: struct ``ids`` (binary, little-endian unsigned 32-bit integers) and ``n_tokens`` (long).

    Null and empty texts give empty ids and 0. A column of the name ``out`` is replaced; all others stay, repeated
    rows too. An empty table gives an empty table. Special tokens in a text are ordinary text.
    """
    prepare(df.sparkSession)

    @F.arrow_udf("ids binary, n_tokens bigint")
    def encoded(texts: pa.Array) -> pa.Array:
        encoder = worker_state(vocabulary, _encoder)
        ids = [encoder.encode(t) if t else b"" for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                                          ["ids", "n_tokens"])

    return df.withColumn(out, encoded(F.col(text)))


def decode(df: DataFrame, vocabulary: Broadcast, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes of packed ids. Null gives null, empty gives empty; an unknown id is an error."""
    prepare(df.sparkSession)

    @F.arrow_udf("binary")
    def decoded(packed: pa.Array) -> pa.Array:
        encoder = worker_state(vocabulary, _encoder)
        return pa.array([None if i is None else encoder.decode(i) for i in packed.to_pylist()], pa.binary())

    return df.withColumn(out, decoded(F.col(ids)))

