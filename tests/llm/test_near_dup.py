import random
import re
from itertools import combinations

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from test_queries import executed_plans

from skyledger.llm import near_dup as n


def plain_classes(ids, links):
    top = {i: i for i in ids}
    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in ids}


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_the_common_subsequence():
    draw = random.Random(4)
    for _ in range(200):
        a = draw.sample(range(60), draw.randint(1, 40))
        b = [x for x in a if draw.random() < 0.93]
        if draw.random() < 0.5 and len(b) > 2:
            i, j = sorted(draw.sample(range(len(b)), 2))
            b[i], b[j] = b[j], b[i]
        if not b:
            continue
        matched = longest_common(a, b)
        want = matched / (len(a) + len(b) - matched)
        got = n.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert (got >= n.SIMILARITY) == (want >= n.SIMILARITY) and (got < n.SIMILARITY or abs(got - want) < 1e-12)


def text_of(draw, words):
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(words))


def edited(draw, text, edits):
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


def test_sketches_keep_the_order():
    draw = random.Random(9)
    base = text_of(draw, 300)
    agree = lambda a, b: sum(x == y for x, y in zip(n.sketches(n.shingles(a)), n.sketches(n.shingles(b))))
    half = len(base.split()) // 2
    turned = " ".join(base.split()[half:] + base.split()[:half])
    assert agree(base, base.upper()) == n.SKETCHES
    assert agree(base, edited(draw, base, 3)) >= 5 > agree(base, text_of(draw, 300))
    assert agree(base, turned) < n.SKETCHES // 2  # the same shingles in another order
    assert n.sketches(n.shingles("!!")) == [] and len(set(n.sketches(n.shingles("word " * 9000)))) > 1


def test_classes_against_all_pairs(spark):
    draw = random.Random(3)
    texts = []
    for family in range(12):
        base = text_of(draw, draw.randint(60, 200))
        texts += [base, base.upper() + "!"] + [edited(draw, base, draw.randint(1, 6)) for _ in range(draw.randint(0, 12))]
    shared = text_of(draw, 80)
    texts += [shared + " " + text_of(draw, 150) for _ in range(40)]  # a passage is not a copy
    texts += [None, "", "", "...", "...", "two words", "Two words.", "two other"]
    texts += texts[:5]
    draw.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [set(n.shingles(t).tolist()) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2)
             if (texts[a] or "") == (texts[b] or "") or (prints[a] and len(prints[a] & prints[b]) >= 0.8 * len(prints[a] | prints[b]))]
    want = plain_classes(range(len(texts)), links)
    found = {r["doc_id"]: r["class_id"] for r in n.classes(rows).collect()}
    assert found == want
    kept = n.keep_one(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == rows.columns


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([(1, long, 0), (1, long, 0), (None, long, 1), (2, long + " more", 2), (3, "other text", 3), (2, "third text", 4)],
                                 "doc_id long, text string, class_id int")
    found = sorted(((r["doc_id"], r["class_id"]) for r in n.classes(rows).collect()), key=str)
    assert found == sorted([(1, 1), (1, 1), (None, None), (2, 1), (2, 1), (3, 3)], key=str)
    kept = n.keep_one(rows).collect()
    # the third text is like no other, though its id is that of a copy as well
    assert sorted(((r["doc_id"], r["class_id"]) for r in kept), key=str) == sorted([(1, 0), (2, 4), (3, 3), (None, 1)], key=str)
    assert n.classes(rows.limit(0)).count() == 0 and n.keep_one(rows.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 150), (150, 300)], "a long, b long")
    found = {r["id"]: r["class"] for r in n.components(edges).collect()}
    assert all(found.get(i, 0) == 0 for i in range(61)) and found[200] == found[300] == 150


def test_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    prints = {i: set(n.shingles(t).tolist()) for i, t in docs}
    links = [(a, b) for a, b in combinations(prints, 2) if prints[a] and len(prints[a] & prints[b]) >= 0.8 * len(prints[a] | prints[b])]
    found = {r["doc_id"]: r["class_id"] for r in n.classes(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()}
    assert found == plain_classes(list(prints), links)


def pairs_of(prints):
    return [(a, b) for a, b in combinations(range(len(prints)), 2)
            if prints[a] and len(prints[a] & prints[b]) >= 0.8 * len(prints[a] | prints[b])]


@pytest.mark.parametrize("size", [1, 3])
def test_chains_and_families_over_one_template(spark, size):
    draw = random.Random(11 + size)
    texts, template = [], text_of(draw, 150)
    for family in range(20 * size):
        base = edited(draw, template, 9)  # families are not alike, but share most of their shingles
        texts += [base] + [edited(draw, base, 3) for _ in range(4)]
    for chain in range(2 * size):
        last = text_of(draw, 120)
        for _ in range(25):
            texts.append(last)
            last = edited(draw, last, 2)
    draw.shuffle(texts)
    prints = [set(n.shingles(t).tolist()) for t in texts]
    found = {r["doc_id"]: r["class_id"] for r in n.classes(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == plain_classes(range(len(texts)), pairs_of(prints))


def test_links_without_a_common_sketch(spark):
    draw = random.Random(2)
    texts = []
    for size in list(range(1, 12)) + [40, 90, 400]:
        base = text_of(draw, size + 4)
        texts += [base] + [edited(draw, base, 1) for _ in range(3)] + [base + " " + text_of(draw, max(1, size // 5))]
    prints = [n.distinct(n.shingles(t)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lists = n.prefixes(rows).withColumn("class", n.F.col("id"))
    found = n.missed(lists, lambda ids: rows.join(ids, "id", "left_semi").select("id", n._shingled("text").alias("print")))
    want = [(a, b) for a, b in combinations(range(len(texts)), 2) if n.aligned(prints[a], prints[b]) >= n.SIMILARITY]
    assert sorted((r["a"], r["b"]) for r in found.collect()) == want


def test_copies_with_a_repeated_line(spark):
    draw = random.Random(5)
    texts = []
    for _ in range(6):
        base, line = text_of(draw, 150), text_of(draw, 8)
        texts += [f"{base}\n{line}", base + f"\n{line}" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in n.classes(rows).collect()} == {i: i - i % 2 for i in range(12)}


def test_ids_of_two_texts_lose_no_link(spark):
    """Forty ids with two unrelated texts each, and a near copy of either under an id of its own."""
    draw = random.Random(6)
    rows = []
    for i in range(40):
        for j in range(2):
            base = text_of(draw, 100)
            rows += [(i, base), (1000 + 2 * i + j, edited(draw, base, 2))]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["class_id"]) for r in n.classes(df).collect()}
    assert found == {(d, d if d < 1000 else (d - 1000) // 2) for d, _ in rows}
    kept = sorted((r["doc_id"], r["text"]) for r in n.keep_one(df).collect())
    assert kept == sorted((d, t) for d, t in rows if d < 1000)  # both texts of every id, none of the copies


def test_prints_are_no_larger_than_the_words_need(spark):
    """Four bytes a word instead of eight a shingle; the similarities are those of the shingles."""
    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(120 + i)) for i in range(12)] + ["one two"]
    texts += [t + " tail of it" for t in texts[:12]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    prints = rows.select("id", n._shingled("text").alias("print"))
    assert all(len(r["print"]) <= 4 * len(texts[r["id"]].split()) for r in prints.collect())
    pairs = prints.alias("s").join(prints.alias("t"), F.col("s.id") < F.col("t.id")).select(
        F.col("s.id").alias("a"), F.col("t.id").alias("b"), n._compared("s.print", "t.print").alias("similarity"))
    words_of = {i: n.distinct(n.shingles(t)) for i, t in enumerate(texts)}
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == 300 and all(s == n.aligned(words_of[a], words_of[b]) for a, b, s in found)


def test_no_text_is_shuffled_and_only_wanted_ones_are_made_prints(spark):
    """Null and repeated rows, ids of several texts; the classes are the same with and without a sort-merge join."""
    draw = random.Random(8)
    texts = [text_of(draw, 60) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + i, edited(draw, texts[i], 1)) for i in range(10)]
    rows += [(0, texts[0]), (5, texts[299]), (None, texts[1]), (700, None), (701, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, n.classes(df).collect()))
    threshold, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), max(executed_plans(spark), default=-1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, n.classes(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = [x for p in executed_plans(spark, before).values() for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", p)]
    assert any("print#" in x for x in moved) and not any(re.search(r"\btext#", x) for x in moved)
    hashed = df.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("same", F.sha2("text", 256))
    made = n.Sieve(hashed.filter("id >= 1000").select("same"), "same").prints(hashed, "same").collect()
    assert {1000 + i for i in range(10)} <= {r["id"] for r in made} and len(made) < 60
    assert all(bytes(r["print"]) == n.word_numbers(dict(rows)[r["id"]]).tobytes() for r in made if r["id"] and r["id"] >= 1000)


def test_stray_copies_are_not_compared_with_all_of_a_class(spark, monkeypatch):
    """A large class and near copies that the buckets left out: every one is joined, and three times as many texts of
    both kinds make no nine times as many pairs. Families that are not alike are still compared in full."""
    draw = random.Random(12)
    base, apart = text_of(draw, 150), text_of(draw, 100)
    copies = [edited(draw, base, 1 + i % 2) for i in range(330)]
    others = [edited(draw, apart, 12) for _ in range(20)]  # share shingles, match nothing
    compared, verified = [], n._verified
    monkeypatch.setattr(n, "_verified", lambda pairs, prints: compared.append(
        {(r["a"], r["b"]) for r in pairs.collect()}) or verified(pairs, prints))
    counts = []
    for size, strays in ((100, 10), (300, 30)):
        texts = copies[:size + strays] + others
        kinds = [0 if i < size else i for i in range(len(texts))]
        rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        classed = rows.join(spark.createDataFrame(list(enumerate(kinds)), "id long, class long"), "id")
        lists = n.materialize(n.prefixes(classed), "lists")
        compared.clear()
        found = n.missed(lists, lambda ids: rows.join(ids, "id", "left_semi").select("id", n._shingled("text").alias("print")))
        links = [(r["a"], r["b"]) for r in found.collect()]
        prints = [n.distinct(n.shingles(t)) for t in texts]
        alike = [(a, b) for a, b in combinations(range(len(texts)), 2)
                 if kinds[a] != kinds[b] and n.aligned(prints[a], prints[b]) >= n.SIMILARITY]
        own = [(i, k) for i, k in enumerate(kinds)]
        assert set(links) <= set(alike) and plain_classes(range(len(texts)), own + links) == plain_classes(range(len(texts)), own + alike)
        counts.append(sum(map(len, compared)))
        assert counts[-1] == len(set().union(*compared))  # no pair twice
    assert counts[1] < 6 * counts[0] and counts[1] < 300 * 30 / 3
