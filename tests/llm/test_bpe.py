import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from conftest import SF_DIR

from skyledger.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
TEXTS = ["", " ", "a", "naïve café", "x" * 5000, "aaaa bbbb\n\n\n  end", "日本語 テキスト", "🙂🙃 <|endoftext|>", "1234567890" * 40,
         " \t \r\n", "don't WON'T", "\x1c\x1d\x85", "ab" * 30000]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ids_equal_the_library(library):
    encoder = bpe.Encoder(RANKS, PATTERN)
    draw = random.Random(5)
    noise = ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(161, 0x2FFF)])) for _ in range(80)) for _ in range(200)]
    for text in TEXTS + noise:
        ids = encoder.encode(text)
        assert array("I", ids).tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids).decode() == text


def test_walk_equals_plain_merging():
    draw = random.Random(1)
    ranks = {bytes([b]): b for b in range(4)}
    for _ in range(60):  # a small vocabulary made of merges, so that greedy choices often fail
        a, b = draw.choice(list(ranks)), draw.choice(list(ranks))
        ranks.setdefault(a + b, len(ranks))
    ranks = {t: r for t, r in ranks.items() if bpe.merge(t, ranks) == [r]}
    encoder = bpe.Encoder(ranks, "(?s).+")
    for _ in range(3000):
        piece = bytes(draw.randrange(4) for _ in range(draw.randrange(1, 25)))
        if piece not in ranks:
            assert encoder.encode_piece(piece) == bpe.merge(piece, ranks)


def test_columns_nulls_and_repeats(spark):
    vocabulary = bpe.share(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), PATTERN)
    rows = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "hi hi", None), (2, "hi hi", None)],
                                 "doc_id long, text string, bpe string")
    out = bpe.decode(bpe.encode(rows, vocabulary).select("*", "bpe.ids"), vocabulary).collect()
    assert len(out) == 4 and sorted(bytes(r["decoded"]) for r in out) == [b"", b"", b"hi hi", b"hi hi"]
    assert [r["bpe"]["n_tokens"] for r in out if r["doc_id"] == 1] == [0]
    assert bpe.encode(rows.limit(0), vocabulary).count() == 0


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.op10_byte_bpe(spark, SF_DIR).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
