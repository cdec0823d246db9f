"""Physical plans: no nested-loop or Cartesian join where one-row aggregates meet rows, with or without broadcasts."""

import pytest

from tidemark.plans import QUERIES

WITH_ONE_ROW = ["ridge_gate", "rolling_gate", "loss_diagnosis_report", "event_blend", "freshness_states", "observation_scope", "block_resample_members", "bootstrap_circular_block", "promotion_gate", "select_weight_grid"]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("name", WITH_ONE_ROW)
def test_no_product_of_rows(spark, sf, name, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
