"""Plans stay small: no expression of a label is written out again and again, whatever comes after it."""

import pytest

from proofmark.jobs import field_queries  # noqa: F401  enters its queries
from proofmark.jobs.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_size(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 300_000
    assert plan.count("ATAN2") <= 1 and plan.count("PythonUDF") <= 4


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", ["verify_stream", "verify_batch", "audit_warnings", "find_close"])
def test_python_functions_have_their_own_steps(spark, name):
    """None is left inside another expression, where it can't be run."""
    spark.conf.set("spark.sql.maxPlanStringLength", "9000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "hits(" in line or "differing_phrases(" in line]
    assert steps and all("EvalPython" in line for line in steps)
