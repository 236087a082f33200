"""Physical-plan shape: the properties the scale design relies on."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pipeline_weekly", "reindex_calendar", "corr_high_pairs", "metrics_compare",
                                  "shap_explain_rows"])
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _executed(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sample_is_window_group_limit(spark):
    plan = _executed(E.queries()["sample_test_rows"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_site_partition_pruning(spark):
    df = E.queries()["scan_by_site_period"](spark, SF_SMALL)
    plan = _executed(df)
    assert re.search(r"PartitionFilters: \[[^\]]*site#\d+ = O", plan)


def test_correlation_matrix_has_no_object_aggregate_per_pair(spark):
    plan = _executed(E.queries()["corr_matrix"](spark, SF_SMALL))
    assert plan.count("covar_pop") == 0          # one Summarizer buffer, not k^2/2 covariance aggregates


@pytest.fixture()
def unknown_sizes(spark):
    """Sizes as on a large table: no static broadcast; the adaptive planner may broadcast what it has measured."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["corr_matrix", "corr_high_pairs", "fn_standardise", "residual_histogram",
                                  "cv_group_folds", "metrics_overall"])
def test_raw_rows_are_not_shuffled_on_a_few_keys(spark, unknown_sizes, name):
    """Statistics per site reach the rows by a size-checked broadcast; only aggregates are dealt by site."""
    plan = _executed(E.queries()[name](spark, SF_SMALL))
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)
    keys = [tuple(re.sub(r"#\d+", "", k).split(", ")) for k in joins]
    assert ("site",) not in keys and ("site", "split") not in keys
    assert keys.count(("site", "Year")) <= plan.count("row_number() windowspecdefinition(site#")   # the split's own window


def test_distinct_suppliers_carry_nothing_else(spark):
    from panelspark.sources.panel import daily_panel
    plan = daily_panel(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "HashAggregate" in line and "l_suppkey" in line.split("functions=")[0]:
            assert "functions=[]" in line.replace(" ", ""), line


def test_weekly_pipeline_reads_the_rows_once(spark):
    plan = _executed(E.queries()["pipeline_weekly"](spark, SF_SMALL))
    assert "orders" not in plan and plan.count("Scan parquet") == 0      # all of it follows from the kept weekly sums


def test_session_settings_are_left_alone(spark):
    before = spark.conf.get("spark.sql.constraintPropagation.enabled", "true")
    E.queries()["dropna_subset"](spark, SF_SMALL).count()
    assert spark.conf.get("spark.sql.constraintPropagation.enabled", "true") == before == "true"
