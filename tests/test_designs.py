"""Weather designs, rows at execution and the freshness of books on hand-worked rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import features
from tidemark.operators import books, quality, windows

STATION = "observed boolean, observed_max double, observed_temperature double, observed_trend double, observation_age_hours double, local_day_hour double, lower double, upper double, gfs double, ecmwf double"


def test_open_brackets_are_as_far_as_the_bound(spark):
    rows = [(True, 70.0, 66.0, 2.0, 1.5, 12.0, None, 75.0, 72.0, 74.0), (True, 70.0, 66.0, 2.0, 1.5, 12.0, 75.0, None, 72.0, 74.0)]
    low, high = features.station_design(spark.createDataFrame(rows, STATION)).orderBy("lower").collect()
    assert (low.s_lower, low.s_upper, low.s_open_low, low.s_lower_mean) == (-3.0, 0.5, 1.0, -3.0)
    assert (high.s_lower, high.s_upper, high.s_open_high, high.s_upper_mean) == (0.5, 3.0, 1.0, 3.0)
    assert (low.s_drop, low.s_trend, low.s_age, low.s_hour, low.s_gap) == (0.4, 0.2, 0.5, 0.5, 0.2)


def test_unobserved_rows_take_the_stated_values(spark):
    r = features.station_design(spark.createDataFrame([(None, None, None, None, None, None, 60.0, 70.0, 65.0, 66.0)], STATION)).first()
    assert (r.s_observed, r.s_drop, r.s_trend, r.s_age, r.s_hour) == (0.0, 0.0, 0.0, 1.0, 0.0)
    assert (r.s_lower, r.s_upper, r.s_gfs, r.s_ecmwf) == (-0.5, 0.5, 0.0, 0.1)


def test_path_design_keeps_complete_rows_only(spark):
    columns = ["observation_innovation_f", "observed_trend", "observed_temperature", "observed_max", "gfs_remaining_max", "ecmwf_remaining_max", "remaining_forecast_max", "remaining_hours", "model_disagreement_f", "observation_age_hours"]
    full = (5.0, 1.0, 60.0, 62.0, 70.0, 65.0, 70.0, 12.0, 5.0, 3.0)
    rows = [full] + [tuple(None if i == j else x for i, x in enumerate(full)) for j in range(7)]
    out = features.path_design(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))).collect()
    assert len(out) == 1
    assert (out[0].j_innovation, out[0].j_now, out[0].j_models, out[0].j_hours) == (1.0, -1.0, 1.0, 0.5)


def test_regional_design_needs_a_median(spark):
    schema = "median_low double, median_high double, q25_low double, q75_high double, mean_spread double, remaining_forecast_max double"
    out = features.regional_design(spark.createDataFrame([(None, 70.0, 60.0, 80.0, 0.1, 66.0), (66.0, 70.0, None, 80.0, None, 66.0)], schema)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.r_center, r.r_width, r.r_spread, r.r_spread_missing, r.r_iqr, r.r_iqr_missing) == (0.4, 0.4, 0.0, 1.0, 0.0, 1.0)


def test_features_are_those_of_the_execution(spark):
    rows = [(1, 100, 0.50, 0.48, 0.52, 0.04, 1.0, 160, 0.54, 0.58, (2.0,)), (2, 100, 0.50, 0.48, 0.52, 0.04, 1.0, None, None, None, None), (3, 100, 0.50, 0.48, 0.52, 0.04, 1.0, 160, 0.0, 0.58, (2.0,))]
    d = spark.createDataFrame(rows, "id int, at long, p double, bid double, ask double, spread double, momentum double, execution_at long, execution_bid double, execution_ask double, later struct<momentum: double>")
    out = windows.execution_rows(d, refreshed="later").collect()
    assert [(r.id, r.at, r.bid, r.ask, r.momentum) for r in out] == [(1, 160, 0.54, 0.58, 2.0)]
    assert out[0].p == pytest.approx(0.56) and out[0].prior_move == pytest.approx(0.06) and out[0].spread == pytest.approx(0.04)
    assert "later" not in out[0].asDict()
    assert [r.momentum for r in windows.execution_rows(d).collect()] == [1.0]


@pytest.mark.parametrize("age, unpriced", [(0, 0), (180, 0), (181, 10), (-1, 10), (None, 10)])
def test_only_fresh_books_price_a_position(spark, age, unpriced):
    bids = spark.createDataFrame([("A", 0.5, 100, -50, age)], "ticker string, price double, size long, rank int, age int")
    pos = spark.createDataFrame([("A", 10, 0.07)], "ticker string, quantity long, fee_rate double")
    r = books.liquidation_value(pos, bids, ["ticker"], ["ticker"], "rank", "price", "size", fresh=F.col("age").between(0, 180)).first()
    assert r.unpriced == unpriced and (r.value > 0) == (unpriced == 0)


@pytest.mark.parametrize("index, row, reason", [
    (None, None, None), (0, ("e1", 1.0, "a" * 64, 5), "repeated_event"), (0, ("e0", 0.0, "a" * 64, 5), None),
    (0, ("e0", 0.0, "A" * 64, 5), "missing_source_hash"), (0, ("e0", 0.0, None, 5), "missing_source_hash"), (0, ("e0", 0.0, "a" * 64, None), "missing_settlement"), (0, ("e0", float("nan"), "a" * 64, 5), "invalid_scale"),
])
def test_calibration_names_its_fault(spark, index, row, reason):
    rows = [(f"e{i}", float(i % 7), "a" * 64, i) for i in range(80)]
    if index is not None:
        rows[index] = row
    df = spark.createDataFrame(rows, "event string, r double, hash string, settled long").withColumn("g", F.lit(1))
    out = quality.validate_calibration(df, ["g"], F.col("r"), source_hash="hash", settled="settled").first()
    assert out.reason == reason and out.latest_settled == 79


def test_equal_residuals_have_no_scale(spark):
    """Whatever the sizes of the partial aggregates, their merge shows no spread."""
    rows = [(g, f"e{g}-{i}", 1.0) for g in range(150, 260) for i in range(g)] + [(1, "one", 1.0), (2, "a", 0.0), (2, "b", 1.0)]
    df = spark.createDataFrame(rows, "g int, event string, r double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partial aggregates a group
    try:
        out = {r.g: r for r in quality.validate_calibration(df, ["g"], F.col("r")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(out[g].reason == "invalid_scale" and out[g].sigma == 0.0 for g in range(150, 260))
    assert out[1].sigma is None and out[2].sigma > 0.7


def test_only_the_named_source_is_accepted(spark):
    rows = [("hourly", False), ("hourly", True), ("hourly", None), ("other", False), (None, False)]
    d = spark.createDataFrame(rows, "source string, synthetic boolean").select("*", *[F.lit(0.5).alias(c) for c in ("p", "bid", "ask", "spread", "hours_left")], F.lit(1).alias("y"), *[F.lit(1).alias(c) for c in ("at", "feature_time", "close_t", "settled_t")])
    rules = quality.sample_rules(d.columns, origin="hourly")
    assert [r.ok for r in d.select(rules["source"].alias("ok")).collect()] == [True, False, False, False, False]
    assert "source" not in quality.sample_rules(d.columns)
