"""Plans that must hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from hearthpanel.operators import household, longitudinal, reports, transitions
from hearthpanel.plans.frames import analysis_frame, full_panel
from hearthpanel.sources.tables import order_panel


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def frames(spark, small):
    people = full_panel(order_panel(spark, small))
    return {"full": people, "lags": longitudinal.lagged_panel(people), "ana": analysis_frame(people)}


@pytest.mark.parametrize("build", [
    lambda f: f["lags"], lambda f: f["ana"],
    lambda f: transitions.transition_conditional(transitions.transition_by_sex_age(f["lags"])),
    lambda f: reports.percentile_ratios(f["ana"]), lambda f: reports.gini_by_year(f["ana"]),
    lambda f: reports.income_by_year(f["ana"]), lambda f: reports.status_by_subgroup(f["ana"]),
    lambda f: reports.error_histograms(f["ana"], ["standard", "ext"]),
    lambda f: longitudinal.first_year_cohort(f["full"])])
def test_no_python_and_no_cross_join(frames, build):
    plan = plan_of(build(frames))
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_lags_share_one_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 0.0, 0.0)],
                               "pid long, year int, retired int, working int, fulltime int, employment_status int, "
                               "hours double, gross_earnings double")
    assert plan_of(longitudinal.lagged_panel(df)).count("Exchange hashpartitioning") == 1


def test_scans_are_pruned(spark, small):
    plan = plan_of(order_panel(spark, small).select("pid", "year", "gross_earnings"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and not any("l_extendedprice" in s or "c_name" in s for s in schemas)


def test_household_values_reach_all_rows_with_one_group_by(spark, small):
    people = order_panel(spark, small)
    out = household.hh_vars(people)
    assert out.count() == people.count()
    assert out.filter(F.col("n_people") < 1).count() == 0
