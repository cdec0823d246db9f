"""Fits, gates, accounting identities and multi-batch streams."""

import math
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, models, pnl, ranking, resample
from tidemark.streaming import streams


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(7)
    n = 600
    p = rnd.uniform(0.1, 0.9, n)
    x = rnd.normal(0, 1, (n, 2))
    y = (rnd.uniform(0, 1, n) < 1 / (1 + np.exp(-(np.log(p / (1 - p)) + 0.8 * x[:, 0])))).astype(int)
    rows = [(int(i % 20), float(p[i]), float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "day long, p double, a double, b double, y int"), p, x, y


def gradient(p, x, y, c, l2, w=None):
    w = np.ones(len(p)) if w is None else w
    q = 1 / (1 + np.exp(-(np.log(p / (1 - p)) + x @ c)))
    return x.T @ (w * (q - y)) / w.sum() + 2 * l2 * c


def test_gradient_is_zero_at_the_free_solution(spark, data):
    df, p, x, y = data
    c = {r.feature: r.coef for r in models.fit_market_offset(df, [], ["a", "b"], bound=None).collect()}
    assert np.abs(gradient(p, x, y, np.array([c["a"], c["b"]]), 0.1)).max() < 1e-8


def test_box_is_respected_with_kkt_signs(spark, data):
    df, p, x, y = data
    c = {r.feature: r.coef for r in models.fit_market_offset(df, [], ["a", "b"], l2=0.01, bound=0.25).collect()}
    g = gradient(p, x, y, np.array([c["a"], c["b"]]), 0.01)
    assert c["a"] == 0.25 and g[0] < 0 and abs(g[1]) < 1e-8


def test_weights_equal_duplicated_rows(spark, data):
    df, *_ = data
    w = df.withColumn("w", F.when(F.col("day") < 5, 3.0).otherwise(1.0))
    dup = df.unionByName(df.filter("day < 5")).unionByName(df.filter("day < 5"))
    a = {r.feature: r.coef for r in models.fit_market_offset(w, [], ["a", "b"], weight="w").collect()}
    b = {r.feature: r.coef for r in models.fit_market_offset(dup, [], ["a", "b"]).collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_many_models_equal_single_fits(spark, data):
    df, *_ = data
    d = df.withColumn("g", F.col("day") % 3)
    many = {(r.g, r.feature): r.coef for r in models.fit_market_offset(d, ["g"], ["a", "b"], intercept=True).collect()}
    for g in range(3):
        one = {r.feature: r.coef for r in models.fit_market_offset(d.filter(F.col("g") == g), [], ["a", "b"], intercept=True).collect()}
        assert {k[1]: v for k, v in many.items() if k[0] == g} == pytest.approx(one, abs=1e-9)


def test_score_uses_stored_coefficients(spark, data):
    df, p, x, y = data
    coef = spark.createDataFrame([("a", 0.2), ("intercept", -0.1)], "feature string, coef double")
    got = [r.predicted for r in models.score_offset(df, coef, [], ["a"]).collect()]
    want = 1 / (1 + np.exp(-(np.log(p / (1 - p)) - 0.1 + 0.2 * x[:, 0])))
    assert sorted(got) == pytest.approx(sorted(want), abs=1e-12)


def test_standardize_uses_training_rows_only(spark, data):
    df, _, x, _ = data
    train = df.filter("day < 10")
    z = models.standardize(df, models.moments(train, [], ["a"]), [], ["a"])
    t = z.filter("day < 10").agg(F.avg("z_a").alias("m"), F.stddev_pop("z_a").alias("s")).first()
    assert abs(t.m) < 1e-9 and t.s == pytest.approx(1.0, abs=1e-6)
    assert models.standardize(df.withColumn("a", F.when(F.col("day") >= 10, 1e6).otherwise(F.col("a"))), models.moments(train, [], ["a"]), [], ["a"]).agg(F.max("z_a")).first()[0] == 5.0


def test_logistic_matches_closed_gradient(spark, data):
    df, p, x, y = data
    fit = models.fit_logistic(df, ["a", "b"])
    got = np.array([r.predicted for r in models.score_logistic(df, fit, ["a", "b"]).select("predicted", "day", "p").orderBy("p").collect()])
    order = np.argsort(p)
    xs = (x - x.mean(0)) / x.std(0, ddof=1)
    m = fit.stages[2]
    w = np.array(m.coefficients.toArray())
    q = 1 / (1 + np.exp(-(m.intercept + xs @ w)))
    assert got == pytest.approx(q[order], abs=1e-9)
    assert np.abs(xs.T @ (q - y) / len(y) + w / (0.1 * len(y))).max() < 1e-4


def test_select_weight_ties_go_to_the_market(spark):
    d = spark.createDataFrame([(1, 0.4, 0.4, 1), (1, 0.6, 0.6, 0), (2, 0.5, 0.5, 1)], "day long, q double, p double, y int")
    assert models.select_weight(d, [], "q", "p", "y", "day", [0.5, 1.0]).first().weight == 0.0
    better = d.withColumn("q", F.when(F.col("y") == 1, 0.9).otherwise(0.1))
    assert models.select_weight(better, [], "q", "p", "y", "day", [0.5, 1.0]).first().weight == 1.0


def test_larger_penalty_wins_ties(spark):
    s = spark.createDataFrame([(0.1, 0.5), (1.0, 0.5), (0.01, 0.6)], "penalty double, log_loss double")
    assert models.select_penalty(s, []).first().penalty == 1.0


def test_trade_attribution_reconciles(spark):
    t = spark.createDataFrame([(side, y) for side in ("yes", "no") for y in (0, 1)], "side string, y int").withColumns({"mid": F.lit(0.39), "bid": F.lit(0.38), "ask": F.lit(0.40), "quantity": F.lit(10)})
    yes = F.col("side") == "yes"
    price = F.when(yes, 0.42).otherwise(0.64)
    fee = F.lit(0.05)
    t = t.withColumn("fees", fee).withColumn("cost", price * 10 + fee).withColumn("pnl", F.when(yes, F.col("y")).otherwise(1 - F.col("y")) * 10 - (price * 10 + fee))
    a = pnl.trade_attribution(t)
    assert a.filter("unreconciled").count() == 0
    assert all(abs(r.equal_contract_net - r.pnl / 10) < 1e-12 for r in a.collect())
    assert pnl.trade_attribution(t.withColumn("cost", F.col("cost") + 1).withColumn("pnl", F.col("pnl") - 1)).filter("unreconciled").count() == 4


def test_one_opportunity_in_its_edge_bin(spark):
    out = []
    for y in (0, 1):
        d = spark.createDataFrame([(0.49, 0.51, 0.6, y)], "bid double, ask double, p double, y int")
        b = metrics.with_best_side(d)
        b = b.withColumn("pnl", metrics.one_contract_pnl(F.col("side"), F.col("y"), F.col("bid"), F.col("ask")))
        out.append(metrics.net_edge_bins(b, "edge", "pnl").first())
    assert [r.bin for r in out] == ["0.04-0.08"] * 2 and out[0].predicted == out[1].predicted and out[1].realized - out[0].realized == pytest.approx(1.0)


def test_calibration_bins_of_tenths(spark):
    d = spark.createDataFrame([(i / 10, i % 2) for i in range(11)], "p double, y int")
    bins = {r.bin: r for r in metrics.calibration(d, [], "p", "y", metrics.floor_bin(F.col("p"))).collect()}
    assert len(bins) == 10 and sum(r["count"] for r in bins.values()) == 11 and bins[6].predicted == pytest.approx(0.6)


def test_segment_contributions_add_up(spark):
    d = spark.createDataFrame([(i % 3, i % 2, 0.1 * i, 0.05 * i) for i in range(12)], "day long, s int, m double, k double")
    total = metrics.loss_contribution(d, [], F.col("m"), F.col("k"), "day").first().contribution
    parts = metrics.loss_contribution(metrics.segments(d, {"s": F.col("s")}), ["kind", "segment"], F.col("m"), F.col("k"), "day").agg(F.sum("contribution")).first()[0]
    assert total == pytest.approx(parts)


def test_sparse_intervals_are_suppressed(spark):
    d = spark.createDataFrame([(29, 20, 0.1), (30, 9, 0.1), (30, 10, 0.1)], "entries int, days_traded int, low double")
    assert [r.low for r in resample.suppress_sparse(d, ["low"]).orderBy("entries", "days_traded").collect()] == [None, None, 0.1]


def test_top_per_group_with_a_hot_group(spark):
    d = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5).alias("g"), "id")
    got = {(r.g, r.id) for r in ranking.top_per_group(d, ["g"], [F.desc("id")], 3).collect()}
    want = {(g, i) for g in range(5) for i in sorted([i for i in range(1000) if (0 if i < 700 else i % 5) == g])[-3:]}
    assert got == want


def test_user_model_scores_in_batches(spark):
    d = spark.range(5).select((F.col("id") / 10).alias("p"))
    assert [r.predicted for r in models.user_model(d, lambda p: p * 2, ["p"]).orderBy("p").collect()] == pytest.approx([0, 0.2, 0.4, 0.6, 0.8])


def stream_files(spark, folder, batches, schema):
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/tmp-{i}")
        part = [f for f in os.listdir(f"{folder}/tmp-{i}") if f.endswith(".parquet")][0]
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.link(f"{folder}/tmp-{i}/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_latest_book_over_several_batches(spark, tmp_path):
    s = stream_files(spark, str(tmp_path), [[(1, 10, "a")], [(1, 5, "late"), (2, 1, "b")], [(1, 10, "same"), (1, 11, "c")]], "k int, ts long, v string")
    out = streams.run_available(streams.latest_book(s, ["k"], ["ts"], ["v", "ts"]), "latest", "update")
    assert out.select("batch").distinct().count() >= 2
    assert {r.k: r.book.v for r in streams.latest_version(out, ["k"]).collect()} == {1: "c", 2: "b"}


def test_intents_over_batches_cancel_match_expire(spark, tmp_path):
    T = lambda s: s * 1000
    ev = lambda k, s, kind, i, q=True: (k, T(s), kind, i, T(s + 100), q)
    batches = [
        [ev(1, 10, "prediction", 1), ev(2, 10, "prediction", 2), ev(3, 10, "prediction", 3)],
        [ev(1, 20, "book", 11), ev(2, 20, "prediction", 12, False), ev(9, 30, "book", 13)],
        [ev(9, 400, "book", 14)], [ev(9, 800, "book", 15), ev(4, 50, "prediction", 16)],
    ]
    s = stream_files(spark, str(tmp_path), batches, "key long, ts_ms long, kind string, id long, expires_ms long, qualifies boolean")
    s = s.withColumn("ts", F.timestamp_millis("ts_ms"))
    out = streams.run_available(streams.intents_with_cancellation(s, "key", "ts", "10 seconds"), "intents", rocksdb=True)
    got = {(r.key, r.event, r.intent_id, r.other_id) for r in out.collect()}
    assert {(1, "matched", 1, 11), (2, "cancelled", 2, 12), (3, "expired", 3, -1)} <= got
    assert not any(k == 4 and e == "matched" for k, e, *_ in got)


def test_freshness_labels(spark):
    d = spark.createDataFrame([("a", 100), ("b", 900), ("c", None)], "k string, t long")
    f = streams.freshness(d, F.lit(1000), "t", 200, F.col("k") == "b", F.col("k") == "z")
    assert {r.k: r.state for r in f.collect()} == {"a": "collecting", "b": "forecast", "c": "collecting"}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Two runs over growing files close every window that the batch closes, each once."""
    rows = [(i, "a" if i % 2 else "b", f"2024-01-01T{i // 6:02d}:{i % 6 * 10:02d}:00", float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string, at string, price double").select("id", "k", F.to_timestamp("at").alias("ts"), "price")
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        return streams.run_available(streams.tumbling_bars(stream, ["k"], "ts", "price", F.lit(1.0), "id", "1 hour", "10 minutes"), "bars", out=out, checkpoint=checkpoint)

    df.filter("id < 25").coalesce(1).write.parquet(source)
    first = {(r.k, r.w.start): r.trades for r in run().collect()}
    df.filter("id >= 25").coalesce(1).write.mode("append").parquet(source)
    both = run().collect()
    assert first and len({(r.k, r.w.start) for r in both}) == len(both) > len(first)
    hand = {(r.k, r.w.start): (r.open, r.high, r.low, r.close, r.trades) for r in streams.tumbling_bars(df, ["k"], "ts", "price", F.lit(1.0), "id", "1 hour", "10 minutes").collect()}
    last = max(start for _, start in hand)
    assert {(r.k, r.w.start): (r.open, r.high, r.low, r.close, r.trades) for r in both} == {k: v for k, v in hand.items() if k[1] < last}


def test_newton_steps_descend_from_far_offsets(spark):
    """Offsets far from the labels make full Newton steps overshoot; the halved ones end where the gradient is zero."""
    rows = [(x / 10, 1 - 1e-6 if x < 0 else 1e-6, int(x >= 0)) for x in range(-20, 21)]
    df = spark.createDataFrame(rows, "x double, p double, y int")
    c = models.fit_market_offset(df, [], ["x"], l2=1e-4, bound=None, least_rows=41).first().coef
    g = sum(x * (1 / (1 + math.exp(-(math.log(p / (1 - p)) + c * x))) - y) for x, p, y in rows) / len(rows) + 2e-4 * c
    assert abs(g) < 1e-8


def test_first_answers_of_two_runs_equal_the_batch(spark, tmp_path):
    """Rows out of order within the watermark, in several files and two runs; the second run goes on from the first."""
    import random

    rng = random.Random(5)
    base = 1_700_000_000
    rows = [(i, rng.randrange(4), base + rng.randrange(0, 40_000), i % 3 == 0, rng.choice([600, 20_000])) for i in range(600)]
    rows.sort(key=lambda r: r[2] + rng.randrange(0, 500))
    frame = lambda part: spark.createDataFrame(part, "id long, key long, s long, answer boolean, life long").withColumn("ts", F.timestamp_seconds("s"))
    src, out, checkpoint = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "check")
    for run, half in enumerate((rows[:300], rows[300:])):
        for k in range(0, 300, 100):
            frame(half[k : k + 100]).coalesce(1).write.mode("append").parquet(src)
        t = spark.readStream.schema("id long, key long, s long, answer boolean, life long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
        signals = t.where("not answer").select("key", "ts", "id", (F.col("ts") + F.make_dt_interval(secs=F.col("life"))).alias("expires"))
        m = streams.match_intents(signals, t.where("answer").select("key", "ts", "id"), "30 SECONDS", "3 HOURS", "10 minutes")
        table = streams.run_available(m, "m", "update", rocksdb=True, out=out, checkpoint=checkpoint)
    want = {}
    for i, k, s, answer, life in rows:
        if not answer:
            ok = [(bs, b) for b, bk, bs, is_book, _ in rows if is_book and bk == k and s + 30 <= bs <= s + 10_800 and bs < s + life]
            if ok:
                want[i] = min(ok)[1]
    got = {r.id: r.answer_id for r in streams.latest_version(table, ["id"]).collect()}
    assert got == want and len(want) > 50
    assert table.count() <= 1.2 * len(want)  # found books, no candidates


def test_settlement_waits_without_a_horizon(spark, tmp_path):
    base = 1_700_000_000
    day = 86_400
    rows = [(1, 1, base, 0, None), (2, 1, base + 5, 0, day), (3, 2, base, 0, None), (4, 1, base + 400 * day, 1, None), (5, 2, base, 1, None), (6, 2, base + 500 * day, 1, None)]
    src, out, checkpoint = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "check")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "id long, key long, s long, kind int, life long").coalesce(1).write.mode("append").parquet(src)
        t = spark.readStream.schema("id long, key long, s long, kind int, life long").parquet(src).withColumn("ts", F.timestamp_seconds("s"))
        p = t.where("kind = 0").select("key", "ts", "id", F.timestamp_seconds(F.col("s") + F.col("life")).alias("close"))
        table = streams.run_available(streams.settle(p, t.where("kind = 1").select("key", "ts", "id"), "1 hour"), "s", "update", rocksdb=True, out=out, checkpoint=checkpoint)
    assert {r.id: r.answer_id for r in streams.latest_version(table, ["id"]).collect()} == {1: 4, 3: 6}


def state_slots(spark, checkpoint, name):
    """Slots with rows in a list state, and the keys in it."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select(F.col("key.slot").alias("slot"), "list_element.key").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return {r.slot for r in rows}, {k for r in rows for k in r.key}


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_many_keys_are_settled_a_slot_at_a_time(spark, tmp_path, monkeypatch, chunk):
    """Two runs of several files: keys of a slot keep their own answers, equal instants go by id, state is one entry a slot."""
    import random

    monkeypatch.setattr(streams, "CHUNK", chunk)
    rng = random.Random(7)
    base = 1_700_000_000
    rows = [(i, rng.randrange(120), base + rng.randrange(0, 400) * 100, rng.random() < 0.4, rng.choice([None, 500, 20_000])) for i in rng.sample(range(10_000), 900)]
    rows.sort(key=lambda r: r[2] + rng.randrange(0, 500))
    src, out, checkpoint = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "check")
    shape = "id long, key long, s long, answer boolean, life long"
    for half in (rows[:450], rows[450:]):
        for k in range(0, 450, 150):
            spark.createDataFrame(half[k : k + 150], shape).coalesce(1).write.mode("append").parquet(src)
        t = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_seconds("s"))
        p = t.where("not answer").select("key", "ts", "id", F.timestamp_seconds(F.col("s") + F.col("life")).alias("close"))
        table = streams.run_available(streams.settle(p, t.where("answer").select("key", "ts", "id"), "10 minutes", slots=8), "s", "update", rocksdb=True, out=out, checkpoint=checkpoint)
    want, unanswered = {}, set()
    for i, k, s, answer, life in rows:
        if not answer:
            later = [(bs, b) for b, bk, bs, is_answer, _ in rows if is_answer and bk == k and s < bs and (life is None or bs < s + life)]
            if later:
                want[i] = min(later)[1]
            elif life is None:
                unanswered.add(k)
    assert {r.id: r.answer_id for r in streams.latest_version(table, ["id"]).collect()} == want and len(want) > 200
    slots, keys = state_slots(spark, checkpoint, "waiting")
    assert slots <= set(range(8)) and unanswered <= keys and len(keys) > 40


def test_intents_of_one_slot_keep_to_their_key(spark, tmp_path):
    """All keys in one slot: borders of delay, latency and expiry, books at one instant, keys without a book or an intent."""
    base = 1_700_000_000
    intents = [(1, 1, 0, 900), (2, 1, 100, 900), (3, 2, 0, 60), (4, 3, 0, 900), (5, -4, 0, 900), (6, 5, 0, 30)]
    books = [(20, 1, 29), (22, 1, 30), (21, 1, 30), (23, 1, 400), (24, 2, 60), (25, -4, 100), (26, 6, 40), (27, 1, 401), (28, 5, 30), (29, 2, 59)]
    rows = [(i, k, s, life) for i, k, s, life in intents] + [(i, k, s, None) for i, k, s in books]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "id long, key long, s long, life long").coalesce(1).write.parquet(src)
    t = spark.readStream.schema("id long, key long, s long, life long").parquet(src).withColumn("ts", F.timestamp_seconds(F.col("s") + base))
    signals = t.where("life IS NOT NULL").select("key", "ts", "id", F.timestamp_seconds(F.col("s") + F.col("life") + base).alias("expires"))
    m = streams.match_intents(signals, t.where("life IS NULL").select("key", "ts", "id"), "30 SECONDS", "300 SECONDS", "10 minutes", slots=1)
    checkpoint = str(tmp_path / "check")
    table = streams.run_available(m, "m", "update", rocksdb=True, out=str(tmp_path / "out"), checkpoint=checkpoint)
    assert sorted((r.key, r.id, r.answer_id, (r.answer_ts_us - r.ts_us) // 1_000_000) for r in table.collect()) == [(-4, 5, 25, 100), (1, 1, 21, 30), (1, 2, 23, 300), (2, 3, 29, 59)]
    assert state_slots(spark, checkpoint, "waiting")[0] == {0}


def test_slots_grow_with_the_table():
    assert streams.slots_for(0) == streams.slots_for(100_000) == 64
    assert all(rows / streams.slots_for(rows) <= streams.SLOT_ROWS for rows in (10**6, 10**8, 10**12))


def test_sparse_and_one_class_models_are_left_out(spark, data):
    df, *_ = data
    g = df.withColumn("g", F.when(F.col("day") == 0, "few").when(F.col("day") < 6, "one").otherwise("good")).withColumn("y", F.when(F.col("g") == "one", 1).otherwise(F.col("y")))
    got = models.fit_market_offset(g, ["g"], ["a"])
    assert [r.g for r in got.select("g").distinct().collect()] == ["good"]
    assert {r.g: r.reason for r in models.training_state(g, ["g"], "y", models.LEAST_ROWS).collect()} == {"few": "few_rows", "one": "one_class", "good": None}
    with pytest.raises(ValueError, match="Insufficient"):
        models.fit_market_offset(df.limit(49), [], ["a"])


def test_many_keys_are_fitted_without_the_driver(spark, monkeypatch):
    """Ten thousand models by a shuffle join; the driver collects none of them."""
    from pyspark.sql import classic

    monkeypatch.setattr(models, "BROADCAST_MODELS", 10)
    x = F.xxhash64("id") % 1000 / 500.0
    df = spark.range(200_000).select((F.col("id") % 10_000).alias("g"), x.alias("x"), F.lit(0.5).alias("p"), (F.xxhash64("id", F.lit(1)) % 2 == 0).cast("int").alias("y"))
    collected = []
    collect = classic.dataframe.DataFrame.collect
    monkeypatch.setattr(classic.dataframe.DataFrame, "collect", lambda self: collected.append(collect(self)) or collected[-1])
    c = models.fit_market_offset(df, ["g"], ["x"], least_rows=2)
    assert max((len(r) for r in collected), default=0) <= 10
    assert c.select("g").distinct().count() >= 9_990


def test_settlement_verdicts_over_two_runs(spark, tmp_path):
    src, out, checkpoint = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "check")
    base = 1_700_000_000
    runs = [[(1, 1, base, 1), (2, 1, base + 5, 0), (3, 2, base, 0)], [(4, 1, base - 100, 1), (5, 1, base + 1, 1), (6, 2, base - 5, 1), (7, None, base, 1)]]
    for part in runs:
        spark.createDataFrame(part, "id long, key long, s long, payout long").coalesce(1).write.mode("append").parquet(src)
        t = spark.readStream.schema("id long, key long, s long, payout long").parquet(src).withColumn("ts", F.timestamp_seconds("s"))
        table = streams.run_available(streams.settlements(t, 10_000_000), "v", rocksdb=True, out=out, checkpoint=checkpoint)
    assert {r.id: (r.verdict, r.nth) for r in table.collect()} == {1: ("accepted", 1), 2: ("conflicting", 1), 3: ("accepted", 1), 4: ("late", 1), 5: ("repeated", 1), 6: ("conflicting", 1)}


def test_verdicts_of_many_keys_in_a_slot(spark, tmp_path, monkeypatch):
    """Three runs against a plain loop over each key's rows; state is one entry a slot, in chunks."""
    import random

    monkeypatch.setattr(streams, "CHUNK", 4)
    rng = random.Random(11)
    base = 1_700_000_000
    rows = [(i, rng.randrange(90), base + rng.randrange(0, 300), rng.randrange(3)) for i in rng.sample(range(10_000), 600)]
    runs = [rows[:200], rows[200:400], rows[400:]]
    src, out, checkpoint = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "check")
    want, held = {}, {}
    for part in runs:
        spark.createDataFrame(part, "id long, key long, s long, payout long").repartition(3).write.mode("append").parquet(src)
        t = spark.readStream.schema("id long, key long, s long, payout long").parquet(src).withColumn("ts", F.timestamp_seconds("s"))
        table = streams.run_available(streams.settlements(t, 100_000_000, slots=4), "v", rocksdb=True, out=out, checkpoint=checkpoint)
        edges = {k: newest - 100 for k, (_, newest, _) in held.items()}
        for i, k, s, payout in sorted(part, key=lambda r: (r[2], r[0])):
            first, newest, counts = held.get(k, (payout, s, {}))
            verdict = "late" if k in edges and s < edges[k] else "accepted" if k not in held else "repeated" if payout == first else "conflicting"
            counts[verdict] = counts.get(verdict, 0) + 1
            held[k] = (first, max(newest, s), counts)
            want[i] = (verdict, counts[verdict])
    assert {r.id: (r.verdict, r.nth) for r in table.collect()} == want and table.count() == 600
    assert {v for v, _ in want.values()} == {"accepted", "repeated", "conflicting", "late"}
    slots, keys = state_slots(spark, checkpoint, "settlements")
    assert slots <= set(range(4)) and keys == {r[1] for r in rows}


def test_settlement_files_are_written_by_many_tasks(spark, sf, monkeypatch):
    """The stand-in's files come from every task of the scan, and late ones still form a batch of their own."""
    from pyspark.sql import classic

    from tidemark.plans import QUERIES

    def gathered(*_):
        raise AssertionError("rows are gathered in few tasks")

    monkeypatch.setattr(classic.dataframe.DataFrame, "coalesce", gathered)
    got = {r.verdict: r.n for r in QUERIES["stream_settlements"](spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert sum(got.values()) == events.count() and got["accepted"] == events.select("user_id").distinct().count() and got["late"] > 0


def test_labels_change_without_new_input(spark, tmp_path):
    """Only the clock moves in the second run; a closed market leaves no state behind."""
    src, clock, out, checkpoint = (str(tmp_path / x) for x in ("src", "clock", "out", "check"))
    base = 1_700_000_000
    shape, clock_shape = "key long, s long, id long, kind string, life long, ts timestamp, close timestamp", "ts timestamp"
    rows = spark.createDataFrame([(1, base, 1, "book", None), (2, base, 2, "forecast", 50)], "key long, s long, id long, kind string, life long")
    rows = rows.withColumn("ts", F.timestamp_seconds("s")).withColumn("close", F.timestamp_seconds(F.col("s") + F.col("life")))
    rows.coalesce(1).write.parquet(src)
    seen = []
    for at in (base + 1, base + 5000):
        spark.createDataFrame([(at,)], "s long").select(F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(clock)
        t = streams.with_heartbeat(spark.readStream.schema(shape).parquet(src), spark.readStream.schema(clock_shape).parquet(clock), "ts")
        table = streams.run_available(streams.freshness_changes(t, 100_000_000, "1 second"), "f", rocksdb=True, out=out, checkpoint=checkpoint)
        seen.append({(r.key, r.at_us // 1_000_000 - base, r.state) for r in table.collect()})
    assert seen[0] == {(1, 0, "watching"), (2, 0, "forecast")}
    assert seen[1] - seen[0] == {(1, 100, "collecting"), (2, 50, "closed")}


def test_closed_markets_leave_no_state(spark, tmp_path):
    src, out, checkpoint = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "check")
    base = 1_700_000_000
    runs = [[(1, base, 1, 100), (1, base + 5, 2, 95), (2, base, 3, None)], [(2, base + 9, 4, None), (1, base + 7, 6, 93), (3, base + 5000, 5, None)], [(3, base + 9000, 7, None)]]
    for part in runs:
        spark.createDataFrame(part, "key long, s long, id long, life long").coalesce(1).write.mode("append").parquet(src)
        t = spark.readStream.schema("key long, s long, id long, life long").parquet(src)
        t = t.withColumn("ts", F.timestamp_seconds("s")).withColumn("close", F.timestamp_seconds(F.col("s") + F.col("life")))
        table = streams.run_available(streams.kept_until_close(t, True, "60 seconds"), "k", "update", rocksdb=True, out=out, checkpoint=checkpoint)
    assert {r.key: r.id for r in streams.latest_version(table, ["key"]).collect()} == {1: 6, 2: 4, 3: 7}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        state = spark.read.format("statestore").option("stateVarName", "kept").load(checkpoint).select("key.key").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(r.key for r in state) == [2, 3]


def test_few_keys_are_not_shuffled_by_key(spark, monkeypatch):
    """Rows of a few folds stay in their partitions; above the limit of models a shuffle gives the same rows."""
    df = spark.range(400).select((F.col("id") % 2).alias("fold"), (F.col("id") % 7 / 7.0).alias("a"), F.lit(0.4).alias("p"))
    coef = spark.createDataFrame([(0, "z_a", 0.1), (1, "z_a", -0.2)], "fold long, feature string, coef double")

    def run():
        z = models.standardize(df, models.moments(df, ["fold"], ["a"]), ["fold"], ["a"])
        out = models.score_offset(z, coef, ["fold"], ["z_a"])
        return out._jdf.queryExecution().executedPlan().toString(), sorted(tuple(r) for r in out.select("fold", "a", "predicted").collect())

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan, rows = run()
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
        monkeypatch.setattr(models, "BROADCAST_MODELS", 1)
        plan, other = run()
        assert "SortMergeJoin" in plan and other == rows and len(rows) == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
