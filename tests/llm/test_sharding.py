import zlib

import numpy as np
import pytest
from conftest import SF_DIR

from skyledger.llm import queries, sharding


@pytest.mark.parametrize("count", [1, 2, 3, 7, 16, 100, 1001, 65_537])
def test_permutation(count):
    places = sharding.permute(np.arange(count), count, seed=3)
    assert sorted(places.tolist()) == list(range(count))
    assert places.tolist() == sharding.permute(np.arange(count), count, seed=3).tolist()
    if count > 100:
        assert (places != np.arange(count)).mean() > 0.9
        assert places.tolist() != sharding.permute(np.arange(count), count, seed=4).tolist()


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(None, 1), (5, 2), (5, 2), (-3, 0)] + [(i, i) for i in range(10, 300)], "id long, row_number long")
    out = sharding.number_rows(rows, ["id"]).orderBy("row_number").collect()
    assert [r["row_number"] for r in out] == list(range(294)) and [r["id"] for r in out][:4] == [None, -3, 5, 5]
    assert sharding.number_rows(rows.limit(0), ["id"]).count() == 0


def test_query_and_files(spark, tmp_path):
    out = queries.op6_feistel_shards(spark, SF_DIR).toPandas()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(out) == len(texts)
    assert all(out.loc[i, "text_crc32"] == zlib.crc32(texts[out.loc[i, "doc_id"]]) for i in out.index)
    assert all(out.loc[i, "size"] == len(texts[out.loc[i, "doc_id"]]) + 1 for i in out.index)
    sizes = out.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s))))
    assert sizes.all() and len(sizes) == 16 and np.ptp(out["shard"].value_counts()) <= 1
    assert set(out["law"]) == {"rows"} and out["grown_shard"].isna().all()
    placed = sharding.assign(spark.createDataFrame([(i,) for i in range(50)], "id long"), ["id"], 4)
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4
