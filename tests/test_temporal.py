"""Temporal operators: hand-worked rows, leakage (mutate the future), hot keys and plan shape."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, books, brackets, ordered, quality, quantiles, ranges, resample, slicing, splits, temporal, windows

H, DAY = slicing.HOUR, slicing.DAY


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_asof(left, right, tol, allowance=0):
    out = []
    for i, k, t in left:
        ok = [(rt, v) for rk, rt, v in right if rk == k and rt + allowance <= t]
        best = max(ok) if ok else None
        out.append((i, best[1] if best and t - best[0] <= tol else None))
    return sorted(out, key=lambda r: r[0])


def few_rows(monkeypatch, rows):
    monkeypatch.setattr(ordered, "ROWS", rows)
    monkeypatch.setattr(ordered, "DRAWN", min(ordered.DRAWN, max(2, rows // 8)))
    monkeypatch.setattr(ordered, "BLOCK", 3)


@pytest.mark.parametrize("size", [20, 60, 1_000_000])
@pytest.mark.parametrize("allowance", [0, 3])
def test_asof_backward_brute_force_with_hot_key(spark, monkeypatch, size, allowance):
    few_rows(monkeypatch, size)
    rnd = random.Random(1)
    key = lambda: 0 if rnd.random() < 0.4 else rnd.randrange(1, 6)
    left = [(i, key(), rnd.randrange(0, 600)) for i in range(300)]
    right = [(key(), t, t * 10) for t in rnd.sample(range(0, 600), 250)]
    l, r = spark.createDataFrame(left, "i int, k int, t long"), spark.createDataFrame(right, "k int, t long, v long")
    out = temporal.asof_backward(l, r, ["k"], "t", "t", tolerance=20, allowance=allowance)
    got = sorted(((x.i, x.quote.v if x.quote else None) for x in out.select("i", "quote").collect()), key=lambda x: x[0])
    assert got == brute_asof(left, right, 20, allowance)


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_asof_forward_brute_force(spark, monkeypatch, size):
    few_rows(monkeypatch, size)
    rnd = random.Random(2)
    left = [(i, rnd.randrange(3), rnd.randrange(0, 500)) for i in range(200)]
    right = [(rnd.randrange(3), t, t) for t in rnd.sample(range(0, 500), 200)]
    l, r = spark.createDataFrame(left, "i int, k int, t long"), spark.createDataFrame(right, "k int, t long, v long")
    out = temporal.asof_forward(l, r, ["k"], "t", "t", max_gap=15, min_gap=2)
    got = {x.i: (x.later.v if x.later else None) for x in out.select("i", "later").collect()}
    for i, k, t in left:
        ok = [rt for rk, rt, _ in right if rk == k and t + 2 <= rt <= t + 15]
        assert got[i] == (min(ok) if ok else None)


def test_changing_the_future_changes_nothing(spark):
    l = spark.createDataFrame([(1, 100)], "k int, t long")
    base = [(1, 90, 1.0), (1, 100, 2.0)]
    for late in ([], [(1, 101, 9.0)], [(1, 101, -9.0), (1, 500, 3.0)]):
        r = spark.createDataFrame(base + late, "k int, t long, v double")
        q = temporal.asof_backward(l, r, ["k"], "t", "t", 60).first().quote
        assert q.v == 2.0
        strict = temporal.asof_backward(l, r, ["k"], "t", "t", 60, allow_equal=False).first().quote
        assert strict.v == 1.0


def test_equal_times_use_the_tie_column(spark):
    l = spark.createDataFrame([(1, 10)], "k int, t long")
    r = spark.createDataFrame([(1, 10, 1), (1, 10, 3), (1, 10, 2)], "k int, t long, id int")
    assert temporal.asof_backward(l, r, ["k"], "t", "t", 5, tie=["id"]).first().quote.id == 3
    assert temporal.asof_forward(l.withColumn("t", F.lit(9)), r, ["k"], "t", "t", 5, tie=["id"]).first().later.id == 1


def test_cut_keys_are_dealt_once(spark, monkeypatch):
    """The rows of a cut key are placed and scanned once, not again for the summaries of its parts."""
    from tidemark.operators import ordered

    few_rows(monkeypatch, 40)
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("t"), F.col("id").alias("v"))
    total = ordered.running(df, [], ["t"], {"v": F.col("v")}, {"m": F.col("v")})
    peak = ordered.running_peak(df, [], ["t"], F.when(F.col("v") % 2 == 0, F.col("v")).otherwise(-F.col("v")).cast("double"), 5.0)
    for out in (total, peak):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "inline" not in plan and "_blocks" not in plan
    seq, s, m, e, p = sorted((i * 7 % 300, i) for i in range(300)), 0, 0, 5.0, 5.0
    want, tops = [], []
    for t, v in seq:
        s, m, e = s + v, max(m, v), e + (v if v % 2 == 0 else -v)
        p = max(p, e)
        want.append((t, s, m))
        tops.append((t, e, p))
    assert sorted(tuple(r) for r in total.select("t", "v", "m").collect()) == want
    assert sorted(tuple(r) for r in peak.select("t", "total", "peak").collect()) == tops


@pytest.mark.parametrize("width", [5, 1000])
def test_previous_and_running_sums_do_not_depend_on_slices(spark, monkeypatch, width):
    few_rows(monkeypatch, 4 * width)
    rnd = random.Random(3)
    data = [(rnd.randrange(2), t, rnd.randrange(10)) for t in rnd.sample(range(200), 80)]
    df = spark.createDataFrame(data, "k int, t long, v long")
    prev = {(r.k, r.t): r.previous.v if r.previous else None for r in temporal.with_previous(df, ["k"], "t", ["v"], 30).collect()}
    sums = {(r.k, r.t): r.s for r in slicing.running_sums(df, ["k"], "t", [], width, {"s": F.col("v")}).collect()}
    peak = {(r.k, r.t): r.m for r in slicing.running_max(df, ["k"], "t", [], width, F.col("v"), "m").collect()}
    gap = {(r.k, r.t): r.previous_t for r in slicing.previous_time(df, ["k"], "t", width).collect()}
    for k in (0, 1):
        seq = sorted((t, v) for kk, t, v in data if kk == k)
        total, top = 0, 0
        for i, (t, v) in enumerate(seq):
            total, top = total + v, max(top, v)
            before = seq[i - 1] if i else None
            assert sums[k, t] == total and peak[k, t] == top and gap[k, t] == (before[0] if before else None)
            assert prev[k, t] == (before[1] if before and t - before[0] <= 30 else None)


def test_overlap_join_and_union_length_brute_force(spark):
    rnd = random.Random(4)
    iv = lambda n: [(i, rnd.randrange(2), a, a + rnd.randrange(0, 60)) for i, a in enumerate(rnd.sample(range(300), n))]
    A, B = iv(60), iv(60)
    a, b = spark.createDataFrame(A, "i int, k int, a long, b long"), spark.createDataFrame(B, "j int, k int, c long, d long")
    got = rows(temporal.overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"), width=16).select("i", "j", "overlap"))
    want = sorted((i, j, min(y, w) - max(x, z)) for i, k, x, y in A for j, l, z, w in B if k == l and min(y, w) > max(x, z))
    assert got == want
    cov = {r.k: r.covered for r in windows.covered_length(a, ["k"], "a", "b").collect()}
    for k in (0, 1):
        assert cov[k] == len({p for _, kk, x, y in A if kk == k for p in range(x, y)})


def test_no_cartesian_or_nested_loop_plans(spark):
    l = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("t"))
    r = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    plans = [
        temporal.asof_backward(l, r, ["k"], "t", "t", 5), temporal.asof_forward(l, r, ["k"], "t", "t", 5),
        temporal.overlap_join(l.withColumn("e", F.col("t") + 3), r.withColumn("f", F.col("t") + 3).withColumnRenamed("t", "c"), ["k"], ("t", "e"), ("c", "f"), 4),
    ]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text


def bars(spark, n=180):
    return spark.createDataFrame([(i * 60, 100.0, 102.0, 99.0, 100 + (i % 7) / 100, 10.0) for i in range(n)], "bar long, open double, high double, low double, close double, volume double")


def test_bars_that_touch_zero_count_without_the_rules(spark):
    """The bar's own range is infinite; others that look back on it are whole."""
    b = bars(spark).withColumn("low", F.when(F.col("bar") == 150 * 60, 0.0).otherwise(F.col("low")))
    kept = {r.bar: r for r in windows.bar_features(b, [], "bar", 60, valid=False).collect()}
    assert sorted(kept) == [i * 60 for i in range(119, 180)]
    assert [t for t, r in kept.items() if r.range_ratio == float("inf")] == [150 * 60]
    assert sorted(r.bar for r in windows.bar_features(b, [], "bar", 60).collect()) == [i * 60 for i in range(119, 150)]


def test_features_of_a_series_with_a_zero_match_the_sql(spark, tmp_path):
    import duckdb

    from tidemark.plans import ORACLES, QUERIES

    con = duckdb.connect()
    zero = "event_id = (SELECT event_id FROM e WHERE ts < (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR FROM e ORDER BY ts LIMIT 1 OFFSET 4000) ORDER BY ts DESC LIMIT 1 OFFSET 2)"
    con.execute("CREATE VIEW e AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN {zero} THEN 0.0 ELSE value END AS value) FROM e) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for q in ("spot_features", "decision_features"):
        df = QUERIES[q](spark, str(tmp_path))
        got = sorted(tuple(r) for r in df.collect())
        cur = con.execute(ORACLES[q])
        names = [d[0] for d in cur.description]
        want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
        assert [r[:1] for r in got] == [r[:1] for r in want]
        assert all(x == pytest.approx(y, abs=2e-5) for a, b in zip(got, want) for x, y in zip(a, b))


def test_spot_features_use_only_finished_bars(spark):
    d = spark.createDataFrame([(150 * 60, 155 * 60, 100.0)], "at long, close_t long, strike double")

    def run(b, at=150 * 60):
        f = windows.bar_features(b, [], "bar", 60)
        return windows.spot_features(d.withColumn("at", F.lit(at)), f, [], "at", "close_t", "strike", "bar", 60, 5).collect()

    base = run(bars(spark))
    assert len(base) == 1 and base[0].feature_time == 149 * 60 and base[0].feature_available_at == 149 * 60 + 5
    changed = bars(spark).withColumn("close", F.when(F.col("bar") >= 149 * 60, 101.5).otherwise(F.col("close")))
    assert run(changed)[0] == base[0]
    assert run(bars(spark), at=150 * 60 + 5)[0].feature_time == 150 * 60
    assert run(bars(spark).filter("bar <> 6000")) == []
    assert run(bars(spark).withColumn("high", F.when(F.col("bar") == 6000, 1.0).otherwise(F.col("high")))) == []


def test_bar_features_match_numpy(spark):
    import numpy as np

    rnd = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rnd.normal(0, 0.001, 200)))
    vol = rnd.uniform(1, 9, 200)
    data = [(i * 60, float(c), float(c) * 1.001, float(c) * 0.999, float(c), float(v)) for i, (c, v) in enumerate(zip(close, vol))]
    b = spark.createDataFrame(data, "bar long, open double, high double, low double, close double, volume double")
    got = windows.bar_features(b, [], "bar", 60, width=37 * 60).orderBy("bar").collect()
    assert len(got) == 81
    for r in (got[0], got[40], got[-1]):
        i = r.bar // 60
        ret = np.diff(np.log(close[i - 119 : i + 1]))
        w = 0.94 ** np.arange(59, -1, -1)
        sigma = np.sqrt(np.average(ret[-60:] ** 2, weights=w))
        assert r.sigma == pytest.approx(sigma, rel=1e-9)
        assert r.volatility_ratio == pytest.approx(ret[-15:].std() / sigma, rel=1e-9)
        assert r.return_60 == pytest.approx(np.log(close[i] / close[i - 60]) / (sigma * 60**0.5), rel=1e-9)
        assert r.volume_ratio == pytest.approx(vol[i - 4 : i + 1].mean() / vol[i - 119 : i + 1].mean(), rel=1e-9)


def test_flow_and_micro_features(spark):
    m = spark.createDataFrame([(i * 60, 100.0, 10.0, 8.0) for i in range(20)], "bar long, close double, volume double, buy double")
    r = {x.bar: x for x in windows.imbalance(m, [], "bar", 60, [5, 15]).collect()}
    assert r[19 * 60].imbalance_5 == pytest.approx(0.6) and r[19 * 60].imbalance_15 == pytest.approx(0.6) and r[13 * 60].imbalance_15 is None
    gap = {x.bar: x for x in windows.imbalance(m.filter("bar <> 600"), [], "bar", 60, [5, 15]).collect()}
    assert gap[12 * 60].imbalance_5 is None and gap[19 * 60].imbalance_15 is None and gap[19 * 60].imbalance_5 == pytest.approx(0.6)
    s = spark.createDataFrame([(i, 100.0, 10.0, 6.0, 2) for i in range(61)], "t long, close double, volume double, buy double, trades int")
    f = windows.micro_features(s, [], "t").collect()
    assert len(f) == 1 and (f[0].imbalance_mid, f[0].imbalance_shift, f[0].return_mid_bps, f[0].trades_long) == (pytest.approx(0.2), 0.0, 0.0, 120)
    quiet = windows.micro_features(s.withColumn("volume", F.lit(0.0)).withColumn("buy", F.lit(0.0)), [], "t").first()
    assert quiet.imbalance_mid == 0.0
    assert windows.micro_features(s.filter("t <> 30"), [], "t").collect() == []


def at(hhmm, day=0):
    h, m = hhmm.split(":")
    return (day * 24 * 60 + int(h) * 60 + int(m)) * 60_000_000


def test_running_max_of_a_station_day(spark):
    start = at("05:00")
    obs = spark.createDataFrame([("S", at("04:59"), 100.0, None), ("S", at("10:00"), 70.0, 99.0), ("S", at("11:00"), 72.0, 75.0), ("S", at("12:00"), 110.0, None)], "station string, t long, temperature double, max_6h double")

    def ask(when, delay):
        d = spark.createDataFrame([("S", when, start)], "station string, at long, day_start long")
        return windows.running_max_obs(d, obs, ["station"], "at", "day_start", "t", delay, offset=F.lit(start)).first()

    m30 = 30 * 60_000_000
    assert ask(at("10:30"), m30).observed_max == 70.0
    r = ask(at("11:30"), m30)
    assert (r.observed_max, r.observed_temperature, r.observation_count, r.observed_trend) == (75.0, 72.0, 2, 0.0)
    assert ask(at("10:29"), m30).reason == "no_observation"
    assert ask(at("17:00"), m30).reason == "stale_observation"
    assert ask(at("11:30"), 3 * m30).observed_temperature == 70.0


def forecast(spark, spikes=()):
    v = lambda m, h: 200.0 if h in spikes else (70.0 if m == "gfs" else 71.0)
    return spark.createDataFrame([("S", m, h * H, v(m, h), 6 * H) for m in ("gfs", "ecmwf") for h in range(6, 54)], "station string, model string, valid_at long, value double, initialized long")


def test_remaining_forecast(spark):
    d = lambda t: spark.createDataFrame([("S", t, 5 * H)], "station string, at long, day_start long")
    r = windows.remaining_max(d(15 * H), forecast(spark), ["station"], "at", "day_start", "initialized").first()
    assert (r.remaining_forecast_max, r.disagreement, r.remaining // H, r.forecast_available_at // H) == (70.5, 1.0, 14, 14)
    assert windows.remaining_max(d(14 * H - 60_000_000), forecast(spark), ["station"], "at", "day_start", "initialized").collect() == []
    spiky = windows.remaining_max(d(15 * H), forecast(spark, (14, 29)), ["station"], "at", "day_start", "initialized").collect()
    assert spiky[0].remaining_forecast_max == 70.5
    holes = forecast(spark).filter(F.col("valid_at") != 20 * H)
    assert windows.remaining_max(d(15 * H), holes, ["station"], "at", "day_start", "initialized").collect() == []
    with pytest.raises(ValueError):
        windows.remaining_max(d(15 * H), forecast(spark), ["station"], "at", "day_start", "initialized", allowance=7 * H)


def test_innovation(spark):
    hours = spark.createDataFrame([("S", m, 14 * H, 70.0, 0) for m in ("a", "b")] + [("S", m, 15 * H, 74.0, 0) for m in ("a", "b")], "station string, model string, valid_at long, value double, initialized long")
    o = spark.createDataFrame([("S", 14 * H + H // 2, 15 * H, 68.0, 0), ("S", 15 * H + 1, 16 * H, 68.0, 0)], "station string, t long, decision_at long, temp double, initialized long")
    r = windows.innovation(o, hours, ["station"], "t", "temp", "initialized").orderBy("t").collect()
    assert (r[0].forecast_at_observation, r[0].innovation) == (72.0, -4.0) and r[1].innovation is None


def test_partition_check_reasons(spark):
    cases = {
        "ok": [("a", None, 60.0), ("b", 60.0, 64.0), ("c", 64.0, None)], "gap_or_overlap": [("a", None, 60.0), ("b", 61.0, 64.0), ("c", 64.0, None)], "missing_tail": [("a", None, 60.0), ("b", 60.0, 64.0)],
        "duplicate_ticker": [("a", None, 60.0), ("a", 60.0, None)], "invalid_bounds": [("a", None, 60.0), ("b", 64.0, 60.0), ("c", 64.0, None)], "too_few_brackets": [("a", None, None)],
    }
    df = spark.createDataFrame([(k, t, lo, hi) for k, v in cases.items() for t, lo, hi in v], "e string, ticker string, lo double, hi double")
    got = {r.e: r.reason for r in brackets.partition_check(df, ["e"], "lo", "hi", "ticker").collect()}
    assert got == {k: (None if k == "ok" else k) for k in cases}


def test_cdf_bounds(spark):
    df = spark.createDataFrame([("x", None, 60.0, 0.0, 1.0), ("x", 60.0, 64.0, 0.8, 0.9), ("x", 64.0, None, 0.0, 1.0), ("y", None, 1.0, 0.8, 1.0), ("y", 1.0, None, 0.8, 1.0)], "e string, lo double, hi double, ql double, qh double")
    b = brackets.cdf_bounds(df, ["e"], "lo", "ql", "qh")
    assert b.filter("e = 'y' AND feasible").count() == 0
    q = brackets.quantile_bounds(b, ["e"], "lo", "hi", {"median": 0.5}).collect()
    assert [(r.e, r.median_low, r.median_high) for r in q] == [("x", 60.0, 64.0)]


def test_exact_quantiles_hot_group(spark):
    import numpy as np

    rnd = np.random.default_rng(6)
    data = [(0, float(x)) for x in rnd.normal(0, 3, 900)] + [(1, float(x)) for x in rnd.integers(-2, 3, 90)] + [(2, 5.0)]
    df = spark.createDataFrame(data, "g int, v double")
    got = {r.g: (r.a, r.b, r.c) for r in quantiles.exact_quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.975}).collect()}
    for g in (0, 1, 2):
        want = np.quantile([v for k, v in data if k == g], [0.05, 0.5, 0.975])
        assert got[g] == pytest.approx(tuple(want), abs=1e-12)


def test_liquidation_uses_a_tenth_of_depth(spark):
    pos = spark.createDataFrame([("T", "yes", 12, 0.07), ("U", "yes", 3, 0.07)], "ticker string, side string, quantity int, fee_rate double")
    bids = spark.createDataFrame([("T", "yes", 60, 0.60, 100.0), ("T", "yes", 50, 0.50, 55.0), ("T", "yes", 40, 0.40, 9.0)], "ticker string, side string, cents int, price double, size double")
    out = {r.ticker: r for r in books.liquidation_value(pos, bids.withColumn("rank", -F.col("cents")), ["ticker", "side"], ["ticker", "side"], "rank", "price", "size").collect()}
    fee = lambda p, q: -(-(p * q * 100 + 7 * q * p / 100 * (1 - p / 100) * 100) // 100) / 100 - p * q / 100
    assert out["T"].unpriced == 0 and out["T"].value == pytest.approx(6.0 - fee(60, 10) + 1.0 - fee(50, 2), abs=1e-6)
    assert (out["U"].value, out["U"].unpriced) == (0.0, 3)


def test_exposure_settles_before_entry(spark):
    e = spark.createDataFrame([("g", "a", 0, 10, 5.0), ("g", "b", 10, 20, 7.0), ("g", "c", 12, 30, 1.0)], "g string, ticker string, t long, s long, cost double")
    got = {r.ticker: r.open_cost for r in books.exposure(e, ["g"], "t", "s", "cost", "ticker").collect()}
    assert got == {"a": 5.0, "b": 7.0, "c": 8.0}


def test_chain_violations(spark):
    z = "0" * 64
    j = spark.createDataFrame([("r", 0, 1, z, "h0"), ("r", 1, 2, "h0", "h1"), ("r", 3, 3, "h1", "h3"), ("s", 0, 1, z, "a"), ("s", 1, 0, "a", "b"), ("s", 2, 2, "x", "c"), ("u", 0, 1, "1" * 64, "q")], "run string, seq long, clock long, previous string, sha string")
    got = {(r.run, r.seq): r.reason for r in quality.chain_links(j, ["run"], "seq", "clock", "previous", "sha", width=2).collect()}
    assert got == {("r", 0): None, ("r", 1): None, ("r", 3): "skipped_sequence", ("s", 0): None, ("s", 1): "clock_moved_back", ("s", 2): "broken_link", ("u", 0): "bad_start"}


def test_gap_longer_than_a_slice(spark):
    b = spark.createDataFrame([(0,), (60,), (100_000,)], "t long").withColumn("k", F.lit(1))
    assert [(r.t, r.gap) for r in quality.contiguity_gaps(b, ["k"], "t", 60, width=600).collect()] == [(100_000, 99_940)]


def samples(spark, days=100):
    d = [(f"s{i}-{d}", d, d * DAY, d * DAY + DAY, d * DAY + 30 * H, d % 2) for d in range(days) for i in range(2)]
    return spark.createDataFrame(d, "ticker string, day long, at long, close_t long, settled_t long, y int")


def test_fraction_split_is_disjoint_and_embargoed(spark):
    s = samples(spark)
    roles = splits.split_fraction_days(splits.day_table(s), 48 * H)
    r = splits.apply_day_roles(s, roles)
    part = {x.role: x for x in r.groupBy("role").agg(F.count_distinct("day").alias("d"), F.min("at").alias("a"), F.max("settled_t").alias("s")).collect()}
    assert part["test"].d == 20
    assert part["train"].s < part["validation"].a - 48 * H and part["validation"].s < part["test"].a - 48 * H
    assert r.groupBy("ticker").agg(F.count_distinct("role").alias("n")).filter("n > 1").count() == 0


def test_future_rows_do_not_change_folds(spark):
    s = samples(spark)
    f = splits.expanding_folds(s).filter("role <> 'purged'")
    bad = f.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("settled_t"))).alias("s"), F.min(F.when(F.col("role") == "validation", F.col("at"))).alias("a")).filter("s >= a - 48 * 3600000000L")
    assert bad.count() == 0 and f.select("fold").distinct().count() == 3
    flipped = s.withColumn("y", F.when(F.col("day") >= 80, 1 - F.col("y")).otherwise(F.col("y")))
    assert rows(splits.expanding_folds(flipped).select("fold", "ticker", "role", "y")) == rows(splits.expanding_folds(s).select("fold", "ticker", "role", "y"))


def test_bootstrap_identity_and_zero_trade_days(spark):
    d = spark.createDataFrame([(i // 3, 0.0) for i in range(30)], "day long, diff double")
    r = resample.cluster_bootstrap(d, [], "day", F.col("diff"), reps=200).first()
    assert (r.mean, r.mean_low, r.mean_high) == (0.0, 0.0, 0.0)
    led = spark.createDataFrame([(0, 1.0, 2, 1.0), (1, 0.0, 0, 0.0)], "day long, pnl double, q int, cost double")
    b = resample.ratio_bootstrap(led, [], "day", F.col("pnl"), F.col("q"), F.col("cost"), reps=300).first()
    assert (b.net_per_contract_low, b.net_per_contract_high, b.return_on_deployed_low, b.return_on_deployed_high) == (0.5, 0.5, 1.0, 1.0)
    assert 0 < b.net_per_contract_undefined < 300


@pytest.mark.parametrize("n", [4, 5, 8])
def test_expected_block_copies(spark, n):
    days = spark.createDataFrame([(i,) for i in range(n)], "day long")
    e = {r.day: r.expected for r in resample.expected_copies(days, "day").collect()}
    assert sum(e.values()) == pytest.approx(n)
    if n % 2 == 0:
        assert e[0] == pytest.approx(e[1] / 2)
    m = resample.block_members(days, "day", members=50).groupBy("member").agg(F.sum("copies").alias("n"))
    assert {r.n for r in m.collect()} == {n}


@pytest.fixture()
def one_instant(spark):
    """Ten thousand rows, nine tenths of them of one key and one instant, in values that tell them apart."""
    return spark.range(10_000).select(F.col("id"), F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 7).alias("k"),
                                      F.when(F.col("id") % 10 > 0, 500).otherwise(F.col("id") % 1000).alias("t"), (F.col("id") * 37 % 101 - 50).alias("v"))


def test_one_instant_is_cut_into_bounded_parts(one_instant, monkeypatch):
    few_rows(monkeypatch, 500)
    parts = ordered.deal(one_instant, ["k"], ["t"])
    sizes = [r["count"] for r in parts.rows.groupBy("k", "__part").count().collect()]
    assert parts.cut and sum(sizes) == 10_000 and max(sizes) < 1000 and len(sizes) > 12
    ranges = parts.rows.where("k = 0").groupBy("__part").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("__part").collect()
    assert all(x.b <= y.a for x, y in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("by", [["k"], []])
def test_scans_of_one_instant_match_whole_windows(one_instant, monkeypatch, by):
    from pyspark.sql import Window

    few_rows(monkeypatch, 500)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("v").over(w)
    whole = one_instant.withColumns({"s": total, "m": F.max("v").over(w)}).withColumn("equity", F.col("s") + 5.0).withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(5.0)))
    want = {r.id: (r.s, r.m, r.equity, r.peak - r.equity) for r in whole.collect()}
    run = ordered.running(one_instant, by, ["t", "id"], {"s": F.col("v")}, {"m": F.col("v")})
    eq = books.equity_curve(one_instant, "t", F.col("v"), 5.0, ["id"], by)
    got = {r.id: (r.s, r.m, r.equity, r.drawdown) for r in run.join(eq.select("id", "equity", "drawdown"), "id").collect()}
    assert got == want
    opened = ordered.running(one_instant, by, ["t", "id"], {"s": F.col("v")}, before=True)
    assert {r.id: r.s + r.v for r in opened.collect()} == {i: x[0] for i, x in want.items()}


def test_previous_and_asof_across_parts_of_one_instant(one_instant, monkeypatch):
    few_rows(monkeypatch, 500)
    got = {r.id: r.p for r in temporal.with_previous(one_instant, ["k"], "t", ["id"], None, tie=["id"]).select("id", F.col("previous.id").alias("p")).collect()}
    rows = sorted((r.k, r.t, r.id) for r in one_instant.collect())
    assert got == {b[2]: a[2] if a[0] == b[0] else None for a, b in zip([(-1, 0, 0), *rows], rows)}
    old = one_instant.where("id = 10 or id = 9990")  # before and after the crowded instant, keys 3 and 1
    found = temporal.asof_backward(one_instant, old.withColumn("k", F.lit(0)), ["k"], "t", "t", None).where("k = 0").groupBy("quote.id").count().collect()
    assert {r.id: r["count"] for r in found} == {i: sum(1 for k, t, _ in rows if k == 0 and (t >= 990 if i == 9990 else 10 <= t < 990 if i == 10 else t < 10)) for i in (None, 10, 9990) if i != 9990 or any(k == 0 and t >= 990 for k, t, _ in rows)}


def test_equity_has_few_exchanges(one_instant, monkeypatch, capsys):
    books.equity_curve(one_instant, "t", F.col("v"), 5.0, ["id"]).explain()
    whole = capsys.readouterr().out
    few_rows(monkeypatch, 500)
    books.equity_curve(one_instant, "t", F.col("v"), 5.0, ["id"]).explain()
    cut = capsys.readouterr().out
    count = lambda plan: sum("Exchange" in line and "Reused" not in line for line in plan.splitlines())
    assert count(whole) == 1 and count(cut) <= 4


def test_empty_tables_and_null_keys(spark, one_instant, monkeypatch):
    few_rows(monkeypatch, 500)
    none = one_instant.limit(0)
    assert temporal.asof_backward(none, one_instant, ["k"], "t", "t", 5).count() == 0
    assert temporal.asof_backward(one_instant, none, ["k"], "t", "t", 5).where("quote is null").count() == 10_000
    assert ordered.running(none, ["k"], ["t"], {"s": F.col("v")}).count() == 0
    blank = one_instant.withColumn("k", F.lit(None).cast("long"))
    assert ordered.running(blank, ["k"], ["t", "id"], {"s": F.lit(1)}).agg(F.max("s")).first()[0] == 10_000


@pytest.mark.parametrize("size", [40, 1_000_000])
def test_interval_max_brute_force(spark, monkeypatch, size):
    few_rows(monkeypatch, size)
    rnd = random.Random(9)
    points = [(rnd.choice([0, 0, 0, 1, None]), rnd.choice([None, *range(200)]), rnd.randrange(1000)) for _ in range(400)]
    asked = [(i, rnd.choice([0, 0, 1, 2, None]), a, a + rnd.choice([-3, 0, 1, 5, 60, 250])) for i, a in enumerate(rnd.choices(range(-20, 220), k=150))]
    p, i = spark.createDataFrame(points, "k int, t long, v long"), spark.createDataFrame(asked + asked[:5], "i int, k int, a long, b long")
    got = ranges.interval_max(i, p, ["k"], ("a", "b"), "t", {"top": "v"}, tie=["v"]).collect()
    hits = lambda k, a, b: [v for kk, t, v in points if kk == k and t is not None and a <= t < b]
    want = [(n, len(hits(k, a, b)), max(hits(k, a, b), default=-1)) for n, k, a, b in asked + asked[:5]]
    assert sorted((r.i, r.points, -1 if r.top is None else r.top) for r in got) == sorted(want)


def test_ranges_are_few_blocks(spark):
    levels = 11
    df = spark.createDataFrame([(a, b) for a in range(0, 60, 7) for b in (a, a + 1, a + 2, a + 31, a + 1000, a + 2047)], "a long, b long")
    for r in df.withColumn("x", blocks.blocks_of_range(F.col("a"), F.col("b"), levels)).collect():
        covered = sorted(n for x in r.x for n in range(x.node << x.level, (x.node + 1) << x.level))
        assert covered == list(range(r.a, r.b)) and len(r.x) <= 2 * levels
    one = spark.createDataFrame([(37,)], "n long").select(blocks.blocks_of_point(F.col("n"), 4).alias("x")).first().x
    assert [(x.level, x.node) for x in one] == [(0, 37), (1, 18), (2, 9), (3, 4)]


def test_remaining_max_asks_for_few_rows(spark):
    """A decision meets at most two blocks of each level per run and model, not every hour."""
    hours = spark.range(48).select(F.lit("S").alias("station"), F.lit(0).cast("long").alias("initialized"), F.explode(F.array(F.lit("gfs"), F.lit("ecmwf"))).alias("model"), (F.col("id") * H).alias("valid_at"), F.col("id").cast("double").alias("value"))
    d = spark.range(100).select(F.col("id"), F.lit("S").alias("station"), (F.lit(DAY) + F.col("id") * 60_000_000).alias("at"), F.lit(DAY).alias("day_start"))
    out = windows.remaining_max(d, hours, ["station"], "at", "day_start", "initialized").collect()
    assert len(out) == 100 and all(r.remaining_forecast_max == 47 for r in out)


@pytest.mark.parametrize("size", [300, 1_000_000])
def test_quantiles_of_values_that_hardly_differ(spark, monkeypatch, size):
    """All values within one part in a million, most in one group, one of them in half of the rows."""
    import numpy as np

    few_rows(monkeypatch, size)
    rng = np.random.default_rng(3)
    values = np.where(rng.random(4000) < 0.5, 1.0000004, 1 + rng.random(4000) * 1e-6)
    df = spark.createDataFrame([(int(i % 20 == 0), float(v)) for i, v in enumerate(values)] + [(None, 2.0), (0, None)], "g int, v double")
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}
    got = {r.g: r[1:] for r in quantiles.exact_quantiles(df, ["g"], "v", qs).collect()}
    for g in (0, 1):
        mine = [v for i, v in enumerate(values) if int(i % 20 == 0) == g]
        assert got[g] == pytest.approx(np.quantile(mine, list(qs.values())), abs=1e-12)
    assert got[None] == (2.0,) * 5
    every = quantiles.exact_quantiles(df, [], "v", qs).first()
    assert tuple(every) == pytest.approx(np.quantile([*values, 2.0], list(qs.values())), abs=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", qs).count() == 0


def test_positions_in_the_whole_order(spark, one_instant, monkeypatch):
    from tidemark.operators import ranking

    few_rows(monkeypatch, 500)
    df = one_instant.withColumn("kind", F.element_at(F.array(*map(F.lit, ["book", "market", "prediction", "outcome", "note"])), (F.pmod("v", F.lit(5)) + 1).cast("int")))
    got = {r.id: r.position for r in ranking.event_order(df, "t", "kind", ["id"]).collect()}
    place = {k: i for i, k in enumerate(["note", *ranking.KIND_PRIORITY])}
    assert got == {r.id: i + 1 for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.t, place[r.kind], r.id)))}


def test_a_long_interval_is_a_few_rows(spark):
    """A year on slices of an hour: at most two blocks a level, each pair found once."""
    year = 365 * DAY
    i = spark.createDataFrame([(1, 90_000_000, 90_000_000 + year), (2, 5, 6)], "k long, a long, b long")
    n = i.withColumn("x", F.explode(blocks.blocks_of_range(slicing.slice_of(F.col("a"), H), slicing.slice_of(F.col("b") - 1, H) + 1, 14))).groupBy("k").count()
    assert {r.k: r["count"] for r in n.collect()}[1] <= 28
    p = spark.range(0, 400).select(F.lit(1).cast("long").alias("k"), (F.col("id") * DAY).alias("t"))
    assert temporal.points_in_interval(i, p, ["k"], ("a", "b"), "t").count() == 365
    other = p.withColumn("u", F.col("t") + year)
    assert temporal.overlap_join(i, other, ["k"], ("a", "b"), ("t", "u")).count() == 366
    assert {r.k: r.covered for r in windows.covered_length(i.unionByName(i), ["k"], "a", "b").collect()} == {1: year, 2: 1}
    none = i.limit(0)
    assert temporal.overlap_join(none, other, ["k"], ("a", "b"), ("t", "u")).count() == 0 and windows.covered_length(none, ["k"], "a", "b").count() == 0


@pytest.mark.parametrize("size", [25, 1_000_000])
def test_observed_maxima_of_many_delays_brute_force(spark, monkeypatch, size):
    few_rows(monkeypatch, size)
    rnd = random.Random(12)
    minute = 60_000_000
    obs = [(rnd.choice("AAB"), t * minute, float(rnd.randrange(60)), rnd.choice([None, float(rnd.randrange(90))])) for t in rnd.sample(range(2 * 1440), 260)]
    asked = [(i, rnd.choice("AABC"), rnd.randrange(2 * 1440) * minute) for i in range(60)]
    o = spark.createDataFrame(obs, "station string, t long, temperature double, max_6h double")
    d = spark.createDataFrame(asked, "i int, station string, at long").withColumn("day_start", (F.floor(F.col("at") / DAY) * DAY).cast("long"))
    out = windows.running_max_obs(d, o, ["station"], "at", "day_start", "t", [30 * minute, 90 * minute])
    got = {(r.i, r.delay // minute): (r.observed_max, r.observed_temperature, r.observation_count, r.observed_trend, r.reason) for r in out.collect()}
    want = {}
    for i, k, at in asked:
        for delay in (30, 90):
            start = at // DAY * DAY
            ok = sorted((t, v, m) for kk, t, v, m in obs if kk == k and start <= t < start + DAY and t + delay * minute <= at)
            if not ok:
                want[i, delay] = (None, None, None, None, "no_observation")
                continue
            t, v, _ = ok[-1]
            old = [x for x in ok if x[0] <= t - 2 * H]
            top = max(max(y, m if m is not None and x - 6 * H >= start else y) for x, y, m in ok)
            want[i, delay] = (top, v, len(ok), v - old[-1][1] if old else 0.0, "stale_observation" if at - t > 3 * H else None)
    assert got == want


def test_station_join_is_one_scan(spark, capsys):
    from tidemark.plans import studies

    o = spark.createDataFrame([("A", 0, 1.0, None)], "station string, t long, temperature double, max_6h double")
    d = spark.createDataFrame([("A", H, 0)], "station string, at long, day_start long")
    studies.station_join(d, o, [30, 60, 90]).explain()
    plan = capsys.readouterr().out
    assert sum("Exchange" in x for x in plan.splitlines()) <= 3 and plan.count("Scan") == 2


def test_every_expanding_fold_is_kept_without_a_least_number_of_days(spark):
    """Folds with 4 to 9 days to train stay; the SQL of the query leaves none out either."""
    from tidemark.plans import ORACLES

    day = spark.range(20).select(F.col("id").alias("day"), (F.col("id") * DAY).alias("at"), (F.col("id") * DAY + H).alias("settled_t"))
    f = splits.expanding_folds(day, min_holdout=5, min_first=5, min_train_days=0)
    assert f.select("fold").distinct().count() == 3
    assert f.where("role = 'train'").groupBy("fold").count().agg(F.max("count")).first()[0] < 10
    assert "HAVING" not in ORACLES["expanding_folds"]


def test_splits_with_too_few_days_are_errors(spark):
    day = spark.range(60).select(F.col("id").alias("day"), (F.col("id") * DAY).alias("at"), (F.col("id") * DAY + H).alias("settled_t"))
    roles = splits.split_fraction_days(splits.day_table(day), 48 * H)
    assert splits.require_split(roles) is roles
    with pytest.raises(ValueError, match="at least 45"):
        splits.require_split(splits.split_fraction_days(splits.day_table(day.where("day < 44")), 48 * H))
    with pytest.raises(ValueError, match="Too few days"):
        splits.require_split(splits.split_fraction_days(splits.day_table(day), 48 * H, train=0.1))
    folds = splits.expanding_folds(day)
    assert splits.require_folds(folds) is folds
    assert folds.where("role = 'train'").groupBy("fold").count().agg(F.min("count")).first()[0] >= 10
    few = splits.expanding_folds(day.where("day < 45"), min_first=5)
    assert few.select("fold").distinct().count() == 2
    with pytest.raises(ValueError, match="Not enough"):
        splits.require_folds(few)
