"""Every stage against a plain version of its rule over the documents it was given."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import bpe, decontamination, quality, toxicity
from skyledger.llm import near_dup
from skyledger.session import materialize

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "bpe"]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[:-1])
    counts = [s.count() for s in stages]
    assert counts[0] > counts[1] > counts[2] > counts[3] >= counts[4] == counts[5]
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.exceptAll(before).isEmpty()  # kept documents are unchanged


def test_classifier_stages(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    index = toxicity.Index(toxicity.train(stages[0], labels, F.lit(True)).value)
    want = {r["doc_id"] for r in stages[0].collect() if index.score(r["text"])[0] < 0.5}
    assert want == {r["doc_id"] for r in stages[1].collect()}
    model = quality.train(stages[1], labels, F.lit(True)).value
    want = {r["doc_id"] for r in stages[1].collect() if quality.margins(model, quality._feature_rows([r["text"]]))[0] >= 0}
    assert want == {r["doc_id"] for r in stages[2].collect()}


def test_one_document_of_each_group_stays(stages):
    prints = {r["doc_id"]: set(near_dup.shingles(r["text"]).tolist()) for r in stages[2].collect()}
    kept = {r["doc_id"] for r in stages[3].collect()}
    near = lambda a, b: a == b or len(prints[a] & prints[b]) >= 0.8 * len(prints[a] | prints[b])
    assert all(not near(a, b) for a in kept for b in kept if a < b)
    reached = set(kept)
    while more := {i for i in prints.keys() - reached if any(near(i, k) for k in reached)}:
        reached |= more
    assert reached == prints.keys()


def test_decontamination_stage(spark, stages):
    windows = decontamination.Windows({"width": 13, "items": [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]})
    want = set()
    for r in stages[3].collect():
        found = decontamination.words(r["text"])
        n_hit = len(windows.hits(found)[0]) if found else 0
        if not (n_hit and 20 * n_hit >= len(found)):
            want.add(r["doc_id"])
    assert want == {r["doc_id"] for r in stages[4].collect()}


def test_encoding_stage(stages):
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    for r in stages[5].collect():
        assert r["round_trip"] and memoryview(bytes(r["token_ids"])).cast("I").tolist() == library.encode_ordinary(texts[r["doc_id"]])


def test_odd_rows(spark):
    rows = [(None, "clean words of no id", "en", "a", 20), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0),
            (3, "tick " * 30_000, "en", "a", 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() <= 5
