"""Ridge fits, parent blends and the delay axis of the rolling study."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.plans import studies


def test_ridge_solves_the_normal_equations_of_each_key(spark):
    rnd = np.random.default_rng(3)
    rows, want = [], {}
    for g, n in (("a", 80), ("b", 40)):
        x = rnd.normal(size=(n, 2)) * [1, 50] + [1000, -3]
        y = x @ [0.3, -0.02] + rnd.normal(size=n) * 0.1
        rows += [(g, float(a), float(b), float(t)) for (a, b), t in zip(x, y)]
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + 100 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
        want |= {(g, "u"): w[0], (g, "v"): w[1], (g, "intercept"): y.mean() - w @ x.mean(0)}
    bad = [("a", None, 1.0, 1.0), ("a", 1.0, math.nan, 1.0), ("b", 1.0, 1.0, None), ("c", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows + bad, "g string, u double, v double, y double")
    coef = models.fit_ridge(df, ["g"], ["u", "v"], "y", 100.0)
    got = {(r.g, r.feature): r.coef for r in coef.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-8) for k in want)
    scored = models.score_linear(df.limit(1), coef, ["g"], ["u", "v"]).first()
    assert scored.prediction == pytest.approx(want["a", "intercept"] + want["a", "u"] * scored.u + want["a", "v"] * scored.v)


def test_constant_feature_gets_no_weight(spark):
    df = spark.createDataFrame([(1.0, float(i), float(i % 3)) for i in range(30)], "u double, v double, y double")
    got = {r.feature: r.coef for r in models.fit_gate(df, ["u", "v"], target="y").collect()}
    assert got["u"] == 0.0 and set(got) == {"intercept", "u", "v"}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_no_usable_row_makes_no_model(spark, by):
    df = spark.createDataFrame([("a", None, 1.0)], "g string, u double, y double")
    assert models.fit_ridge(df, by, ["u"], "y", 1.0).collect() == []


LADDER = [("E", "low", None, 50.0), ("E", "mid", 50.0, 60.0), ("E", "high", 60.0, None)]


def _blend(spark, members, ladder=LADDER, event=("event",), weights=None):
    rows = spark.createDataFrame(ladder, "event string, ticker string, lower double, upper double")
    m = spark.createDataFrame(members, "event string, ticker string, parent string, member int, p double")
    return {r.ticker: r for r in models.parent_blend(rows, m, ["event", "ticker"], weights or {"a": 0.6, "b": 0.4}, event=list(event) if event else None).collect()}


def _members(a, b, tickers=("low", "mid", "high")):
    return [("E", t, parent, i, p) for parent, ps in (("a", a), ("b", b)) for t, p in zip(tickers, ps) for i in range(3)]


def test_event_blend_keeps_the_weights_of_parents_with_other_masses(spark):
    out = _blend(spark, _members((0.1, 0.2, 0.1), (0.8, 0.4, 0.4)))
    assert [out[t].reason for t in out] == [None] * 3
    assert out["low"].blend == pytest.approx(0.6 * 0.25 + 0.4 * 0.5)
    assert sum(r.blend for r in out.values()) == pytest.approx(1.0)
    plain = _blend(spark, _members((0.1, 0.2, 0.1), (0.8, 0.4, 0.4)), event=None)
    assert plain["low"].blend == pytest.approx(0.6 * 0.1 + 0.4 * 0.8)


def test_bad_members_leave_the_whole_event_without_a_blend(spark):
    good = _members((0.1, 0.2, 0.1), (0.8, 0.4, 0.4))
    missing = _blend(spark, good[1:])
    assert {t: r.reason for t, r in missing.items()} == {"low": "missing_member", "mid": "bad_member_in_event", "high": "bad_member_in_event"}
    repeated = _blend(spark, [*good[1:], good[1]])
    assert repeated["low"].reason == "missing_member"
    for value in (1.5, math.nan, None, -0.1):
        wrong = _blend(spark, [(*good[0][:4], value), *good[1:]])
        assert wrong["low"].reason in ("invalid_probability", "missing_member") and all(r.blend is None for r in wrong.values())
    assert {r.reason for r in _blend(spark, [m for m in good if m[1] != "high"], ladder=LADDER[:2]).values()} == {"incomplete_event"}
    assert {r.reason for r in _blend(spark, _members((0.0, 0.0, 0.0), (0.8, 0.4, 0.4))).values()} == {"no_mass"}
    alone = _blend(spark, _members((0.0, 0.0, 0.0), (0.8, 0.4, 0.4)), weights={"a": 0.0, "b": 1.0})
    assert alone["low"].blend == pytest.approx(0.5)


def test_blend_weights_must_be_shares(spark):
    for weights in ({"a": 0.6, "b": 0.5}, {"a": 1.5, "b": -0.5}, {"a": math.nan, "b": 1.0}):
        with pytest.raises(ValueError, match="shares"):
            _blend(spark, _members((0.1, 0.2, 0.1), (0.8, 0.4, 0.4)), weights=weights)


@pytest.fixture(scope="module")
def history(spark):
    rnd = np.random.default_rng(11)
    rows = []
    for i in range(1200):
        at, p, x = i * 10, float(rnd.uniform(0.2, 0.8)), float(rnd.normal())
        y = int(rnd.uniform() < 1 / (1 + math.exp(-(math.log(p / (1 - p)) + 0.2 * x))))
        rows.append((at, at + 5, at // 200, p, p - 0.01, p + 0.01, x, -x, y))
    return spark.createDataFrame(rows, "at long, settled_t long, day long, p double, bid double, ask double, x double, old_x double, y int")


def test_delayed_features_are_scored_by_the_models_of_current_ones(spark, history):
    folds = [(4000, 6000), (6000, 8000), (8000, 12000)]
    out = studies.rolling_study(history, folds, ["x"], {"full": ["x"], "none": []}, 0, reps=50, delays={"late": {"x": "old_x"}}, candidate="full")
    assert out["coefficients"].groupBy("fold", "variant").count().count() == 6
    loss = {(r.scenario, r.model): r.log_loss for r in out["pooled"].collect()}
    assert loss["current", "full"] < loss["current", "market"] < loss["late", "full"]
    assert loss["current", "none"] == pytest.approx(loss["late", "market"])
    assert {(r.scenario, r.model) for r in out["paired"].collect()} == {(s, m) for s in ("current", "late") for m in ("full", "none")}
    gate = out["gate"].collect()
    assert len(gate) == 1 and gate[0].fold_wins >= 2


def test_gate_of_a_candidate_without_trades_fails_and_is_one_row(spark, history):
    wide = history.withColumns({"bid": F.lit(0.01), "ask": F.lit(0.99)})
    gate = studies.rolling_study(wide, [(6000, 12000)], ["x"], {"full": ["x"]}, 0, reps=10, candidate="full")["gate"].collect()
    assert len(gate) == 1
    assert not gate[0].passed and {"positive_net", "enough_trades", "enough_days"} <= set(gate[0].failed.split(","))


def test_ablation_stands_beside_its_control_row_by_row(spark, history):
    rows = history.withColumn("id", F.col("at"))
    out = {r.variant: r for r in studies.ablation(rows, ["x"], {"full": ["x"], "none": []}, control="full", reps=50).collect()}
    assert out["full"].mean is None
    assert out["none"].mean == pytest.approx(out["none"].brier - out["full"].brier, abs=1e-9)
    assert out["none"].mean_low <= out["none"].mean <= out["none"].mean_high
