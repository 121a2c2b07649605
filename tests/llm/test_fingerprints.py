import hashlib
import random
import re

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from skyledger.llm import fingerprints as fp
from skyledger.llm import queries

PARAGRAPH = re.compile(fp.PARAGRAPH)


def alike(a: str, b: str) -> float:
    left, right = set(PARAGRAPH.findall(a)), set(PARAGRAPH.findall(b))
    return len(left & right) / len(left | right) if left | right else 1.0


@pytest.mark.parametrize("block_chars", [fp.BLOCK_CHARS, 20_000, 3_000])
def test_query_against_plain_sets(spark, monkeypatch, block_chars):
    monkeypatch.setattr(fp, "BLOCK_CHARS", block_chars)  # more blocks than one level of bounds at 3,000
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    docs.sort(reverse=True)
    found = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, SF_DIR).collect()}
    assert len(found) == len(docs)
    for (doc_id, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        row, cut = found[doc_id], len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == pytest.approx(alike(text, edited))
        assert row["near_next"] == pytest.approx(alike(text, following))


def differ(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a array<long>, b array<long>")
    for side in "ab":
        rows = fp.with_sketch(rows, side, f"{side}_cells")
    out = fp.differences(rows, "a", "a_cells", "b", "b_cells", "apart").collect()
    return {r["i"]: {(x["key"], x["n"]) for x in r["apart"]} for r in out}


def test_differences_of_any_size(spark):
    draw = random.Random(2)
    pairs = []
    for shared, left, right in [(0, 0, 0), (5, 1, 0), (50, 3, 4), (300, 15, 15), (10, 80, 60), (0, 900, 700), (2000, 1, 0)]:
        keys = [draw.randrange(-2**63, 2**63) for _ in range(shared + left + right)]
        pairs.append((keys[:shared + left], keys[:shared] + keys[shared + left:]))
    found = differ(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        assert found[i] == {(x, 1) for x in set(a) - set(b)} | {(x, -1) for x in set(b) - set(a)}


def test_stuck_sketches_fall_back(spark):
    # digests that agree in every bit the tables and parts read cannot be peeled
    same = [i << 59 for i in range(4)]
    assert differ(spark, [(same[:3], same[3:])])[0] == {(x, 1) for x in same[:3]} | {(same[3], -1)}


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a\nb", 3), (2, "a\nb\na", 4)], "doc_id long, text string, fingerprint int")
    out = fp.fingerprint(rows).withColumn("printed", F.array_join(F.col("fingerprint.digests").cast("array<string>"), ",")).collect()
    prints = {(r["doc_id"], r["text"]): set(r["printed"].split(",")) for r in out}
    assert prints[1, None] == prints[2, ""] == {""} and prints[None, "a\nb"] == prints[2, "a\nb\na"]
    assert fp.fingerprint(rows.limit(0)).count() == 0
    chars = rows.withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    follow = {(r["doc_id"], r["fingerprint"]): r["next_fingerprint"] for r in fp.with_next(chars, "doc_id", ["fingerprint"], "n").collect()}
    assert len(follow) == 4 and follow[None, 3] is None and follow[1, 1] in (2, 4)
    assert {follow[2, 2], follow[2, 4]} in ({4, 1}, {2, 1})
    assert fp.with_next(chars.limit(0), "doc_id", ["fingerprint"], "n").count() == 0
    alone = fp.with_next(chars.filter("fingerprint = 1"), "doc_id", ["fingerprint"], "n").first()
    assert alone["next_fingerprint"] == 1
