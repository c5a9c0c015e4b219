"""Every registered query against its SQL on the smallest tables, and its plan."""

import os

import pytest

import __spark_entry__ as entry_file
import check
from palisade.workload import all_oracles, all_queries

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con(data):
    return check.connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    problem, _ = check.compare(spark, con, data, name, QUERIES[name], ORACLES.get(name))
    assert problem is None


def test_entry(spark):
    result = entry_file.entry(spark)
    assert result.columns[:3] == ["rule_id", "rule_type", "hit_count"] and result.count() > 0


def test_entry_file_has_all_queries():
    assert set(QUERIES) <= set(entry_file.queries()) and set(ORACLES) <= set(entry_file.oracle_sql())


def test_oracles_name_known_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) - len(ORACLES) <= 3


SLOW_WORDS = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"]


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("sink_", "stream_", "scan_"))))
def test_plan_has_no_nested_loops_and_no_python(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in SLOW_WORDS if w in plan]


def test_data_folder_is_given():
    assert os.path.isdir("/root/testdata") or os.environ.get("PALISADE_TEST_DATA")
