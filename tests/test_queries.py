"""Every registered query against its check SQL, and the shape of its plan."""

import re

import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
import check
from skyledger.plans import catalog

QUERIES = {n: q for n, q in entry.queries().items() if n in catalog.QUERIES}
ORACLES = {n: q for n, q in entry.oracle_sql().items() if n in catalog.QUERIES}


@pytest.fixture(scope="session")
def con():
    return check.connect(SF_DIR)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def executed_plans(spark, after: int = -1) -> dict[int, str]:
    """Plans of everything that ran, also while a query was built: stores, sketches, streams."""
    store = spark._jsparkSession.sharedState().statusStore()
    known = store.executionsList(max(0, store.executionsCount() - 200), 200)
    every = [known.apply(i) for i in range(known.size())]
    return {e.executionId(): e.physicalPlanDescription() for e in every if e.executionId() > after}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    before = max(executed_plans(spark), default=-1)
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert check.difference(df, ORACLES[name], con) is None
    else:
        assert df.count() > 0
    for plan in [plan_of(df), *executed_plans(spark, before).values()]:
        for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert forbidden not in plan
        if not name.startswith(("j14", "j20", "j21")):  # Kendall's block scan is the one place for Python
            assert not re.search("EvalPython|InPandas|InArrow", plan)


def test_every_query_of_the_inventory_has_a_check():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["horizon_hours"] for r in sorted(rows)] == [1, 6, 24, 48]


def test_filters_and_columns_reach_the_scan(spark, tables):
    from skyledger.operators import filters

    plan = plan_of(filters.time_range(tables.raw("events").select("event_id", "ts"), "2024-01-05", "2024-01-06"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan.replace("timestamp_ntz", "")
    assert "props" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["d10_last_value", "d11_latest_wide", "h02_stream_latest"])
def test_latest_rows_combine_without_a_sort(spark, name):
    before = max(executed_plans(spark), default=-1)
    df = QUERIES[name](spark, SF_DIR)
    df.count()
    plans = [plan_of(df), *executed_plans(spark, before).values()]
    assert any("HashAggregate" in plan for plan in plans) and not any("SortAggregate" in plan for plan in plans)


def test_expired_points_are_deleted(spark, tables, tmp_path):
    from skyledger.sources import points

    path = str(tmp_path / "aging")
    points.write_points(tables.points, path)
    edge = "timestamp '2024-01-25 12:00:00'"
    left = points.read_points(spark, path).filter(f"ts >= {edge}").count()
    assert points.delete_expired(spark, path, 5, "2024-01-30 12:00:00") > 10
    stored = points.read_points(spark, path)
    assert stored.count() == left and stored.filter(f"ts < {edge}").isEmpty()
    assert points.delete_expired(spark, path, 5, "2024-01-30 12:00:00") == 0 and points.read_points(spark, path).count() == left


def test_stored_points_prune_partitions(spark, tables, tmp_path):
    from skyledger.sources import points

    path = str(tmp_path / "points")
    points.write_points(tables.points, path)
    stored = points.read_points(spark, path)
    recent = points.apply_retention(stored.filter("measurement = 'power'"), 3, "2024-01-31 00:00:00")
    partitions = plan_of(recent).split("PartitionFilters")[1].split("]")[0]
    assert "measurement" in partitions and "date" in partitions
