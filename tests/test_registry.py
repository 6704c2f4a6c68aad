"""Every registered query: runs, equals its SQL, and has no plan that cannot scale."""

import pytest

import __spark_entry__ as entry
from piitrace.registry import catalog
from tests.oracle_check import compare, connect

# The corpus queries have tests of their own in tests/llm.
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "CollectLimit"]


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    ok, text = compare(spark, con, name, folder, QUERIES, ORACLES)
    assert ok, text


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("x")))
def test_plan(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in FORBIDDEN if w in plan]


def test_headers_are_met(spark, folder):
    """Lines with a header, with and without a service, and lines without one."""
    rows = QUERIES["b12_parse_line"](spark, folder).collect()
    parsed = [r for r in rows if r.category is not None]
    assert len(rows) > len(parsed) > len(rows) // 3
    assert all(r.ts and r.message for r in parsed)
    assert {r.service is None for r in parsed} == {True, False}


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    df = entry.entry(spark)
    assert df.count() == 15 and "grade" in df.columns


def test_scans_are_narrow(spark, folder):
    """Filters and columns reach the scan."""
    from piitrace.registry.base import incident

    plan = QUERIES["a2_initial_visible"](spark, folder)._jdf.queryExecution().executedPlan()
    assert "EqualTo(layer,0)" in plan.toString()
    docs = QUERIES["e25_extract_documents"](spark, folder)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in (
        docs._jdf.queryExecution().executedPlan().toString())
    classes = incident(spark, folder).logs
    from piitrace.plans.replay import log_classes, live_actions

    text = log_classes(classes)._jdf.queryExecution().executedPlan().toString()
    assert "line:string" not in text
    i = incident(spark, folder)
    live = live_actions(i.actions, i.scenarios)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in live
