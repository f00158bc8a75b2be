"""Every registered query with SQL gives the rows DuckDB gives, from a plan without pairwise joins."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare
from tests.conftest import SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, SMALL, name) is None


@pytest.mark.parametrize("name", ["bootstrap_tables", "insertion_rank", "alpha_ranking", "q75_pool", "max_energy_crop",
                                  "official_split", "cross_split_duplicates", "linear_resample", "standardise"])
def test_plan_has_no_pairwise_join_and_no_python(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]


def test_filters_and_columns_reach_the_scan(spark):
    from cohortlens import views
    df = views.predictions(spark, SMALL).filter("y_true = 'Reject'").groupBy("method").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "o_orderkey" in line)
    assert "o_totalprice" not in scan and "IsNotNull(o_custkey)" in scan


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
