"""The registered queries of the training-data operators."""

import check
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from skyledger.llm import queries

NAMES = ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13", "pipeline"]


def test_every_operator_has_one_query():
    found = entry.queries()
    for name in NAMES:
        assert sum(q == name or q.startswith(f"{name}_") for q in found) == 1


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, name):
    assert check.difference(queries.QUERIES[name](spark, SF_DIR), queries.ORACLES[name], check.connect(SF_DIR)) is None


@pytest.mark.parametrize("name", ["op4_fingerprints", "op7_license_scan"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
