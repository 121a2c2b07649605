"""Language, quality and toxicity: held-out accuracy, exact neighbours, edges."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(1, None, "x"), (None, "", "y"), (2, "§ 12 ½!", "z"), (2, "§ 12 ½!", "z"), (3, "word " * 60_000, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, score string")


def held(rows, truth, label):
    joined = rows.toPandas().merge(truth.toPandas(), on="doc_id")
    return joined[joined["held_out"]], joined[joined["held_out"]][label]


def test_language(spark, docs):
    found, truth = held(queries.op2_language(spark, SF), docs.select("doc_id", "lang"), "lang")
    assert len(found) > 100 and (found["lang_pred"] == truth).mean() > 0.98
    assert found["score"].between(0, 1).all()


def test_language_edges(spark, docs, edges):
    model = language.train(docs)
    out = language.predict(edges, model).collect()
    by_text = {r["text"]: r["language"] for r in out}
    assert len(out) == 5 and all(by_text[t]["lang"] == "und" for t in (None, "", "§ 12 ½!"))
    assert by_text["word " * 60_000]["lang"] in {"en", "de", "fr", "es"}
    assert language.predict(edges.limit(0), model).count() == 0
    unknown = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["language"]["lang"] for r in language.predict(docs.limit(3), unknown).collect()} == {"und"}


def test_unseen_words_back_off():
    held_ = {"langs": ["a", "b"], "totals": [10, 10], "words": {"known": [9, 1]},
             "grams": {"x": [9, 1], "xy": [9, 0], "y": [5, 5], "^": [10, 10], "^x": [9, 1]}}
    scorer = language.Scorer(held_)
    assert scorer.predict("known")[0] == "a" and scorer.predict("xyx")[0] == "a"
    assert scorer.predict("日本")[1] == 0.5  # nothing is known of it
    assert scorer.predict("²")[0] == "und" and scorer.predict("² é")[0] != "und"


def test_quality(spark, labels):
    found, truth = held(queries.op3_quality(spark, SF), labels, "quality")
    assert len(found) > 80 and (found["predicted"] == truth).mean() > 0.95


def test_quality_edges(spark, docs, labels, edges):
    model = quality.train(docs, labels, F.lit(True))
    out = quality.score(edges, model, out="score").collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not r["text"]}) == 1
    one_kind = quality.train(docs, labels.filter("quality = 1"), F.lit(True))
    assert {r["score"] >= 0.5 for r in quality.score(edges, one_kind, out="score").collect()} == {True}
    none = quality.train(docs.limit(0), labels, F.lit(True))
    assert quality.score(edges, none, out="score").first()["score"] == pytest.approx(0.5)


def test_additive_model_learns_an_interaction():
    draw = np.random.default_rng(1)
    x = draw.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.margins(quality.fit(x, y), x) > 0) == (y > 0)).mean() > 0.95


def test_toxicity(spark, labels):
    found, truth = held(queries.op5_toxicity(spark, SF), labels, "toxic")
    score, y = found["score"].rank(), truth.to_numpy()
    ones = y.sum()
    assert (score[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)) > 0.7
    assert (found["predicted"] == truth).mean() > 0.9


def test_neighbours_are_exact():
    draw = np.random.default_rng(7)
    vectors = [toxicity.weighted({int(t): int(draw.integers(1, 4)) for t in draw.integers(0, 40, draw.integers(1, 9))}, [1.0] * 40)
               for _ in range(900)]
    index = toxicity.Index({"terms": [str(i) for i in range(40)], "idf": [1.0] * 40, "ids": list(range(900)),
                            "labels": [True] * 900, "vectors": vectors, "empty_rate": 0.0})
    for query in vectors[:60]:
        plain = sorted(((round(sum(w * v.get(t, 0) for t, w in query.items()), 12), -row) for row, v in enumerate(vectors)), reverse=True)
        plain = [(s, -row) for s, row in plain if s > 0][:toxicity.NEIGHBOURS]
        assert [row for _, row in index.nearest(query)] == [row for _, row in plain]


def test_toxicity_edges(spark, docs, labels, edges):
    model = toxicity.train(docs, labels, F.lit(True))
    out = toxicity.score(edges, model, out="score").collect()
    assert len(out) == 5 and all(0 <= r["score"]["score"] <= 1 for r in out)
    assert all(r["score"]["evidence"] == [] for r in out if not r["text"])
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r["toxicity"]["score"] for r in toxicity.score(docs.limit(5), none).collect()} == {0.0}
    repeated = toxicity.train(docs, labels.union(labels), F.lit(True))
    assert repeated.value["ids"] == model.value["ids"]


def test_every_example_finds_itself(spark, docs, labels):
    """All words of the examples are indexed: each example is its own nearest neighbour, as are texts of rare words."""
    rare = [(10_000_000 + i, f"zyq{chr(97 + i % 26)}{chr(97 + i // 26)} wumbro{chr(97 + i % 26)} lorp", 1) for i in range(40)]
    more = spark.createDataFrame(rare, "doc_id long, text string, toxic int")
    some = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    truth = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).unionByName(more.select("doc_id", "toxic"))
    model = toxicity.train(some, truth, F.lit(True))
    examples = some.join(truth.dropna(), "doc_id").filter("text rlike '[A-Za-z]'")
    rows = toxicity.score(examples, model).collect()
    assert len(rows) > 400
    for r in rows:
        best = r["toxicity"]["evidence"][0]["similarity"]
        itself = [e["similarity"] for e in r["toxicity"]["evidence"] if e["doc_id"] == r["doc_id"]]
        assert best == pytest.approx(1.0) and (itself == [] or itself[0] == pytest.approx(1.0))
    alone = [r for r in rows if r["doc_id"] >= 10_000_000]
    assert len(alone) == 40 and all(r["toxicity"]["evidence"][0]["doc_id"] == r["doc_id"] for r in alone)
    assert all(r["toxicity"]["score"] > 0.5 for r in alone)


def test_index_equals_plain_cosine_over_all_words(spark, docs, labels):
    model = toxicity.train(docs, labels, F.lit(True)).value
    index = toxicity.Index(model)
    vectors = [dict(zip(terms.tolist(), weights.tolist())) for terms, weights in model["vectors"]]
    for r in docs.select("text").dropna().limit(60).collect():
        at, weights = index.weigh(index.terms.counts(r["text"]))
        query = dict(zip(at.tolist(), weights.tolist()))
        plain = [(-round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12), row) for row, v in enumerate(vectors)]
        want = sorted(p for p in plain if p[0] < 0)[:toxicity.NEIGHBOURS]
        assert [s for s, _ in index.nearest(query)] == pytest.approx([-s for s, _ in want], abs=1e-9)


def test_a_rare_label_is_not_crowded_out(spark):
    from skyledger.llm.labels import labelled_sample

    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), (F.col("id") < 20).cast("int").alias("toxic"))
    sample = labelled_sample(rows, rows, "toxic", F.lit(True), 50, each=True)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {1: 20, 0: 50}


def test_an_index_takes_room_by_its_postings():
    """Fifty thousand words that stand in one example each: no room for words times blocks; what is sent has it all."""
    draw = np.random.default_rng(9)
    vectors = [(np.arange(i * 25, i * 25 + 25), draw.random(25)) for i in range(2000)] + [(np.zeros(0, int), np.zeros(0))]
    held = {"terms": [f"w{i}" for i in range(50_000)], "idf": [1.0] * 50_000, "ids": list(range(2001)), "labels": [True] * 2001,
            "vectors": vectors, "empty_rate": 0.0}
    index = toxicity.Index(held)
    assert sum(a.nbytes for a in vars(index).values() if isinstance(a, np.ndarray)) < 40 * 50_000
    sent = toxicity.Model({k: v for k, v in held.items() if k != "vectors"} | {"postings": index.postings, "terms": " ".join(held["terms"])})
    got = pickle.loads(pickle.dumps(sent))
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(vectors, got["vectors"], strict=True))
    again = toxicity.Index(got)
    assert again.terms.words == index.terms.words and again.nearest(vectors[7]) == index.nearest(vectors[7]) != []
