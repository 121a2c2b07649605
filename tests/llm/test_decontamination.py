from conftest import SF_DIR

from skyledger.llm import decontamination as d

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def hits(spark, texts, items, monkeypatch=None):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: r["hits"] for r in d.find_hits(docs, benchmark).collect()}


def test_windows_short_items_and_edges(spark):
    items = [(7, ITEM), (7, ITEM), (9, "Only, THREE words"), (None, ITEM), (3, None), (4, "... !")]
    texts = [f"before {ITEM.upper()} after", ITEM.replace("seven", "7"), "xx only three-words yy only three words", None, "", "!!", ITEM]
    found = hits(spark, texts, items)
    assert found[0]["hit_words"] == list(range(1, 15)) and found[0]["items"] == [7] and found[0]["n_words"] == 16
    assert found[1]["hit_words"] == [] and found[2]["hit_words"] == [1, 2, 3, 5, 6, 7] and found[2]["items"] == [9]
    assert all(found[i]["n_words"] == 0 and found[i]["hit_words"] == [] for i in (3, 4, 5))
    assert len(found[6]["hit_words"]) == 14


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    whole = {tuple(map(str, r)) for r in d.find_hits(docs, items).collect()}
    monkeypatch.setattr(d, "BLOCK_CHARS", 2000)
    assert {tuple(map(str, r)) for r in d.find_hits(docs, items).collect()} == whole


def test_spans_and_documents(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"keep {ITEM}, this"), (2, "clean"), (3, None), (4, ITEM + " w" * 400), (2, "clean")],
                                 "doc_id long, text string")
    assert sorted((r["doc_id"] for r in d.remove_documents(docs, items).collect())) == [2, 2, 3, 4]
    cleaned = {r["doc_id"]: r["cleaned"] for r in d.remove_spans(docs, items).collect()}
    assert cleaned[1] == "keep , this" and cleaned[2] == "clean" and cleaned[3] is None
    assert d.remove_documents(docs.limit(0), items).count() == 0
    assert d.remove_documents(docs, items.limit(0)).count() == 5


def test_extra_columns_stay(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a", "mine", 5)], "doc_id long, text string, hits string, item_id int")
    row = d.find_hits(docs, items).first()
    assert row["item_id"] == 5 and row["hits"]["n_words"] == 1
