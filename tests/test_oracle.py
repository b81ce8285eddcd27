"""Every registered query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as spark_entry
from check_oracle import duck_rows, multiset
from larder.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    columns, _, expected = duck_rows(SF, ORACLE[name])
    assert sorted(df.columns) == sorted(columns)
    assert multiset(df.columns, rows) == multiset(columns, expected)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
