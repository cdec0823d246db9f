"""Queries for the temporal joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import temporal as J
from tidemark.operators.ranges import interval_max
from tidemark.plans.registry import query
from tidemark.plans.standins import DAY, R, S, SAMPLES, TICKS, samples, table, ticks

H = 3600 * S


def _side(t, kind):
    return t.filter(F.col("event_type") == kind)


@query("asof_backward_quote", f"""
WITH {TICKS},
d AS (SELECT * FROM ticks WHERE event_type = 'error'), q AS (SELECT * FROM ticks WHERE event_type = 'purchase')
SELECT d.event_id, d.user_id, d.t AS at, CASE WHEN d.t - q.t <= 86400000000 THEN q.event_id END AS quote_id,
       CASE WHEN d.t - q.t <= 86400000000 THEN q.value END AS quote_value,
       CASE WHEN d.t - q.t <= 86400000000 THEN d.t - q.t END AS age_us
FROM d ASOF LEFT JOIN q ON d.user_id = q.user_id AND d.t >= q.t + 5000000""")
def asof_backward_quote(spark, sf):
    t = ticks(spark, sf)
    d = _side(t, "error").select("event_id", "user_id", F.col("t").alias("at"))
    q = _side(t, "purchase").select("user_id", "t", "event_id", "value")
    out = J.asof_backward(d, q, ["user_id"], "at", "t", tolerance=DAY, allowance=5 * S, tie=["event_id"])
    return out.select("event_id", "user_id", "at", F.col("quote.event_id").alias("quote_id"),
                      F.col("quote.value").alias("quote_value"), (F.col("at") - F.col("quote.t")).alias("age_us"))


@query("asof_forward_quote", f"""
WITH {TICKS},
d AS (SELECT * FROM ticks WHERE event_type = 'error'), q AS (SELECT * FROM ticks WHERE event_type = 'purchase')
SELECT d.event_id, d.user_id, d.t AS at, CASE WHEN q.t - d.t <= 86400000000 THEN q.event_id END AS later_id,
       CASE WHEN q.t - d.t <= 86400000000 THEN q.t - d.t END AS gap_us
FROM d ASOF LEFT JOIN q ON d.user_id = q.user_id AND d.t < q.t""")
def asof_forward_quote(spark, sf):
    t = ticks(spark, sf)
    d = _side(t, "error").select("event_id", "user_id", F.col("t").alias("at"))
    q = _side(t, "purchase").select("user_id", "t", "event_id")
    out = J.asof_forward(d, q, ["user_id"], "at", "t", max_gap=DAY, tie=["event_id"])
    return out.select("event_id", "user_id", "at", F.col("later.event_id").alias("later_id"),
                      (F.col("later.t") - F.col("at")).alias("gap_us"))


@query("asof_prior_move", f"""
WITH {TICKS}, m AS (
  SELECT event_id, user_id, t, k, lag(k) OVER w AS pk, lag(t) OVER w AS pt FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, user_id, t AS at, CASE WHEN t - pt <= 172800000000 THEN (k - pk) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS prior_move FROM m""")
def asof_prior_move(spark, sf):
    t = ticks(spark, sf).select("event_id", "user_id", "t", "k")
    out = J.with_previous(t, ["user_id"], "t", ["k"], tolerance=2 * DAY, tie=["event_id"])
    move = F.when(F.col("previous").isNotNull(), (F.col("k") - F.col("previous.k")) / F.lit(100.0)).otherwise(F.lit(0.0))
    return out.select("event_id", "user_id", F.col("t").alias("at"), move.alias("prior_move"))


@query("asof_horizons", f"""
WITH {TICKS}, closes AS (SELECT user_id, event_id, t AS close_t FROM ticks WHERE event_type = 'signup'),
d AS (SELECT *, close_t - h * 3600000000 AS at FROM closes, (VALUES (12), (18), (24)) v(h)),
q AS (SELECT * FROM ticks WHERE event_type <> 'signup')
SELECT d.event_id, CAST(d.h AS BIGINT) AS horizon_h, d.at, q.event_id AS quote_id, q.k AS quote_cents
FROM d ASOF JOIN q ON d.user_id = q.user_id AND d.at >= q.t WHERE d.at - q.t <= 21600000000""")
def asof_horizons(spark, sf):
    t = ticks(spark, sf)
    closes = _side(t, "signup").select("user_id", "event_id", F.col("t").alias("close_t"))
    d = J.fan_out(closes, "close_t", [12 * H, 18 * H, 24 * H])
    q = t.filter(F.col("event_type") != "signup").select("user_id", "t", "event_id", "k")
    out = J.asof_backward(d, q, ["user_id"], "at", "t", tolerance=6 * H, tie=["event_id"]).filter("quote IS NOT NULL")
    return out.select("event_id", (F.col("horizon") / H).cast("long").alias("horizon_h"), "at",
                      F.col("quote.event_id").alias("quote_id"), F.col("quote.k").alias("quote_cents"))


@query("exact_lag_join", f"""
WITH {TICKS}, bars AS (SELECT event_type, t // 3600000000 * 3600 AS bar, arg_max(value, (t, event_id)) AS close FROM ticks GROUP BY ALL)
SELECT b.event_type, b.bar, b.close, o.close AS opening, f.close AS prior
FROM bars b LEFT JOIN bars o ON o.event_type = b.event_type AND o.bar = b.bar - 14400
LEFT JOIN bars f ON f.event_type = b.event_type AND f.bar = b.bar - 3600""")
def exact_lag_join(spark, sf):
    from tidemark.operators.windows import ohlcv

    bars = ohlcv(ticks(spark, sf), ["event_type"], "t", "value", F.lit(1.0), 3600 * S, tie="event_id").select(
        "event_type", (F.col("bar") / S).cast("long").alias("bar"), "close")
    out = J.lag_join(bars, bars, ["event_type"], "bar", "bar", {"opening": 14400, "prior": 3600}, "close")
    return out.select("event_type", "bar", "close", "opening", "prior")


@query("left_fee_override", """
SELECT o_orderkey, CASE WHEN c_mktsegment IS NULL THEN 'missing_metadata' END AS reason,
       CASE c_mktsegment WHEN 'BUILDING' THEN 0.035::DOUBLE WHEN 'MACHINERY' THEN NULL ELSE 0.07::DOUBLE END AS fee_rate
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def left_fee_override(spark, sf):
    from tidemark.functions.contracts import effective_fee

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    j = J.left_with_reason(o, c, ["c_custkey"], "missing_metadata")
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "unknown")
    multiplier = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(0.5))
    return j.select("o_orderkey", "reason", effective_fee(F.lit("quadratic"), F.lit(1.0), kind, multiplier).cast("double").alias("fee_rate"))


@query("pending_minus_settled", f"""
WITH {TICKS} SELECT DISTINCT user_id, event_type || '' AS kind FROM ticks p WHERE event_type = 'view'
AND NOT EXISTS (SELECT 1 FROM ticks s WHERE s.user_id = p.user_id AND s.event_type = 'purchase' AND s.t > p.t)""")
def pending_minus_settled(spark, sf):
    t = ticks(spark, sf)
    # A view is pending while no later purchase settles it: compare with the key's last purchase, one row per key.
    last = _side(t, "purchase").groupBy("user_id").agg(F.max("t").alias("settled_t"))
    p = _side(t, "view").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.max("t").alias("t"))
    return p.join(last, (p.user_id == last.user_id) & (last.settled_t > p.t), "left_anti").select("user_id", "kind")


@query("cohort_semi", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN
 (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA')""")
def cohort_semi(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    o = table(spark, sf, "orders")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("interval_overlap_hours", f"""
WITH {TICKS}, a AS (SELECT event_id, user_id, t AS a0, t + (k + 1) * 60000000 AS a1 FROM ticks WHERE event_type = 'view'),
b AS (SELECT event_id, user_id, t AS b0, t + (k + 1) * 120000000 AS b1 FROM ticks WHERE event_type = 'click')
SELECT a.event_id AS view_id, b.event_id AS click_id, least(a1, b1) - greatest(a0, b0) AS overlap_us
FROM a JOIN b ON a.user_id = b.user_id AND a0 < b1 AND b0 < a1""")
def interval_overlap_hours(spark, sf):
    t = ticks(spark, sf)
    a = _side(t, "view").select(F.col("event_id").alias("view_id"), "user_id", F.col("t").alias("a0"), (F.col("t") + (F.col("k") + 1) * 60 * S).alias("a1"))
    b = _side(t, "click").select(F.col("event_id").alias("click_id"), "user_id", F.col("t").alias("b0"), (F.col("t") + (F.col("k") + 1) * 120 * S).alias("b1"))
    return J.overlap_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), width=H, name="overlap_us").select("view_id", "click_id", "overlap_us")


@query("point_in_interval_max", f"""
WITH {TICKS}, i AS (SELECT event_id, user_id, t AS a, t + 86400000000 AS b FROM ticks WHERE event_type = 'signup')
SELECT i.event_id, CAST(count(*) AS BIGINT) AS points, max(p.value) AS max_value, arg_max(p.value, (p.t, p.event_id)) AS last_value
FROM i JOIN ticks p ON p.user_id = i.user_id AND p.t >= i.a AND p.t < i.b AND p.event_type <> 'signup' GROUP BY i.event_id""")
def point_in_interval_max(spark, sf):
    t = ticks(spark, sf)
    i = _side(t, "signup").select(F.col("event_id").alias("interval_id"), "user_id", F.col("t").alias("a"), (F.col("t") + DAY).alias("b"))
    p = t.filter("event_type <> 'signup'").select("user_id", "t", "event_id", "value")
    found = interval_max(i, p.withColumn("_last", F.struct("t", "event_id", "value")), ["user_id"], ("a", "b"), "t", {"max_value": "value", "_last": "_last"}, tie=["event_id"])
    return found.where("points > 0").select(F.col("interval_id").alias("event_id"), "points", "max_value", F.col("_last.value").alias("last_value"))


@query("intent_to_book_match", f"""
WITH {TICKS}, sig AS (SELECT *, t + 3600000000 * 36 AS expires FROM ticks WHERE event_type = 'view'),
b AS (SELECT * FROM ticks WHERE event_type = 'purchase'),
m AS (SELECT sig.event_id, sig.t, sig.expires, b.event_id AS bid_, b.t AS bt,
      row_number() OVER (PARTITION BY sig.event_id ORDER BY b.t, b.event_id) AS rn
      FROM sig LEFT JOIN b ON b.user_id = sig.user_id AND b.t >= sig.t + 5000000 AND b.t <= sig.t + 172800000000)
SELECT event_id, CASE WHEN bt < expires THEN bid_ END AS book_id, CASE WHEN bt < expires THEN bt - t END AS latency_us FROM m WHERE rn = 1""")
def intent_to_book_match(spark, sf):
    t = ticks(spark, sf)
    s = _side(t, "view").select("event_id", "user_id", F.col("t").alias("signal_t"), (F.col("t") + 36 * H).alias("expires"))
    b = _side(t, "purchase").select("user_id", "t", "event_id")
    out = J.match_intent(s, b, ["user_id"], "signal_t", "t", "expires", delay=5 * S, max_latency=2 * DAY, tie=["event_id"])
    return out.select("event_id", F.col("book.event_id").alias("book_id"), (F.col("book.t") - F.col("signal_t")).alias("latency_us"))


@query("label_after_decision", f"""
WITH {TICKS}, lab AS (SELECT user_id, min(k % 3) AS lo, max(k % 3) AS hi, min(t) AS settled FROM ticks WHERE event_type = 'purchase' GROUP BY user_id, t // 86400000000),
oc AS (SELECT user_id, t // 86400000000 AS day, min(k % 3) AS lo, max(k % 3) AS hi, min(t) AS settled FROM ticks WHERE event_type = 'purchase' GROUP BY ALL),
j AS (SELECT CASE WHEN lo IS NULL THEN 'unsettled' WHEN lo <> hi THEN 'conflicting_settlement' WHEN lo NOT IN (0, 1) THEN 'nonbinary_settlement'
      WHEN settled <= d.t THEN 'already_closed' ELSE 'y=' || lo END AS status
      FROM ticks d LEFT JOIN oc ON oc.user_id = d.user_id AND oc.day = d.t // 86400000000 WHERE event_type = 'view')
SELECT status, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY status""")
def label_after_decision(spark, sf):
    t = ticks(spark, sf).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))
    d = _side(t, "view").select("user_id", "day", F.col("t").alias("at"))
    o = _side(t, "purchase").select("user_id", "day", F.col("t").alias("settled_t"), (F.col("k") % 3).alias("payout"))
    good, bad = J.label_after(d, o, ["user_id", "day"], "at", "settled_t", "payout")
    both = good.select(F.concat(F.lit("y="), F.col("y").cast("string")).alias("status")).unionByName(bad.select(F.col("reason").alias("status")))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("scenario_grid", f"""
WITH {SAMPLES}, g AS (SELECT s.*, slip, edge FROM samples s, (VALUES (0.0::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) a(slip), (VALUES (0.02::DOUBLE), (0.04::DOUBLE)) b(edge))
SELECT slip, edge, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN abs(q - p) - slip >= edge THEN 1 ELSE 0 END) AS BIGINT) AS passing FROM g GROUP BY ALL""")
def scenario_grid(spark, sf):
    g = J.scenario_grid(samples(spark, sf).select("p", "q"), slip=[0.0, 0.02, 0.05], edge=[0.02, 0.04])
    return g.groupBy("slip", "edge").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("q") - F.col("p")) - F.col("slip") >= F.col("edge")).alias("passing"))


@query("point_in_time_streams", f"""
WITH {TICKS}, d AS (SELECT * FROM ticks WHERE event_type = 'error'), m AS (SELECT * FROM ticks WHERE event_type = 'signup'), b AS (SELECT * FROM ticks WHERE event_type = 'click'),
j1 AS (SELECT d.event_id, d.user_id, d.t, m.event_id AS market_id FROM d ASOF LEFT JOIN m ON d.user_id = m.user_id AND d.t >= m.t),
j2 AS (SELECT j1.*, b.event_id AS book_id, j1.t - b.t AS age FROM j1 ASOF LEFT JOIN b ON j1.user_id = b.user_id AND j1.t >= b.t)
SELECT event_id, market_id, CASE WHEN age <= 43200000000 THEN book_id END AS book_id,
  CASE WHEN market_id IS NULL OR book_id IS NULL OR age > 43200000000 THEN 'missing_market_or_book' END AS reason FROM j2""")
def point_in_time_streams(spark, sf):
    t = ticks(spark, sf)
    d = _side(t, "error").select("event_id", "user_id", F.col("t").alias("at"))
    m = _side(t, "signup").select("user_id", "t", "event_id")
    b = _side(t, "click").select("user_id", "t", "event_id")
    j = J.asof_backward(d, m, ["user_id"], "at", "t", tolerance=None, tie=["event_id"], name="market")
    j = J.asof_backward(j, b, ["user_id"], "at", "t", tolerance=12 * H, tie=["event_id"], name="book")
    reason = F.when(F.col("market").isNull() | F.col("book").isNull(), "missing_market_or_book")
    return j.select("event_id", F.col("market.event_id").alias("market_id"), F.col("book.event_id").alias("book_id"), reason.alias("reason"))


@query("lead_fallback", f"""
WITH {TICKS}, leads AS (SELECT event_id, lead, value + lead AS forecast, t - lead * 86400000000 + (k * 1800000000) AS available_t, t FROM ticks, (VALUES (1), (2)) v(lead))
SELECT event_id, CAST(min(lead) AS INTEGER) AS lead, arg_min(forecast, lead) AS forecast FROM leads WHERE available_t <= t GROUP BY event_id""")
def lead_fallback(spark, sf):
    t = ticks(spark, sf).select("event_id", "t", "value", "k", F.explode(F.array(F.lit(1), F.lit(2))).alias("lead"))
    t = t.withColumn("forecast", F.col("value") + F.col("lead")).withColumn("available_t", F.col("t") - F.col("lead") * F.lit(DAY) + F.col("k") * F.lit(1800 * S))
    out = J.freshest_available(t, ["event_id"], "lead", F.col("available_t") <= F.col("t"))
    return out.select("event_id", "lead", "forecast")


@query("station_day_join", f"""
WITH {TICKS}, hours AS (SELECT event_type, t // 3600000000 AS hr, max(value) AS v FROM ticks GROUP BY ALL),
days AS (SELECT DISTINCT event_type, t // 86400000000 AS day FROM ticks)
SELECT d.event_type, d.day, CAST(count(h.v) AS BIGINT) AS hours, max(h.v) AS day_max
FROM days d LEFT JOIN hours h ON h.event_type = d.event_type AND h.hr >= d.day * 24 AND h.hr < d.day * 24 + 24 GROUP BY ALL""")
def station_day_join(spark, sf):
    t = ticks(spark, sf)
    hours = t.groupBy("event_type", F.floor(F.col("t") / H).cast("long").alias("hr")).agg(F.max("value").alias("v"))
    days = t.select("event_type", F.floor(F.col("t") / DAY).cast("long").alias("day")).distinct().withColumn("start", F.col("day") * 24)
    out = J.complete_days(days, hours, ["event_type"], "start", "hr", "v", step=1)
    return out.select("event_type", "day", "hours", "day_max")


@query("cross_basis", f"""
WITH {TICKS}, b AS (SELECT event_type, t // 3600000000 * 3600 AS bar, arg_max(value, (t, event_id)) AS close FROM ticks WHERE event_type IN ('click', 'view') GROUP BY ALL)
, j AS (SELECT a.bar, ln(a.close / c.close) * 10000 AS basis FROM b a JOIN b c ON a.bar = c.bar WHERE a.event_type = 'click' AND c.event_type = 'view')
SELECT j.bar, {R('j.basis', 4)} AS basis_bps, {R('j.basis - o.basis', 4)} AS change_bps FROM j LEFT JOIN j o ON o.bar = j.bar - 18000""")
def cross_basis(spark, sf):
    from tidemark.operators.windows import basis_change, ohlcv

    bars = ohlcv(ticks(spark, sf).filter(F.col("event_type").isin("click", "view")), ["event_type"], "t", "value", F.lit(1.0), 3600 * S, tie="event_id")
    bars = bars.withColumn("bar", (F.col("bar") / S).cast("long"))
    basis = J.cross_venue(_side(bars, "click"), _side(bars, "view"), "bar", "close", "close")
    out = basis_change(basis, [], "bar", 5 * 3600)
    return out.select("bar", rounded(F.col("basis_bps"), 4).alias("basis_bps"), rounded(F.col("change_bps"), 4).alias("change_bps"))
