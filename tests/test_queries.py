"""Every registered query against its SQL, and the shape of its plan."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from witspark.plans import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def plan_faults(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    faults = [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin") if n in plan]
    if re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan):
        faults.append("window without a partition")
    return faults


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    seen = {}

    def build(session, folder):
        seen["df"] = QUERIES[name](session, folder)
        return seen["df"]

    problem, count = compare(spark, con, SF_DIR, build, ORACLES.get(name))
    assert problem is None
    assert plan_faults(seen["df"]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rule_id", "grp", "ids"]
