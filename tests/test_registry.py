"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from oracle import compare, connect

CORE = [n for n, f in entry.queries().items() if not getattr(f, "__module__", "").startswith("brindle.llm")]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        df.count()
    else:
        assert compare(df, con, sql) == ""


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_core_query_has_an_oracle():
    assert [n for n in CORE if n not in entry.oracle_sql()] == []


@pytest.mark.parametrize("name", [n for n in CORE if n[0] == "p" and n[1].isdigit()])
def test_plans_of_training_data_queries_compare_no_pairs(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
