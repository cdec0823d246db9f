"""Queries for data quality and chronological splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import quality as Q
from tidemark.operators import splits as C
from tidemark.operators import temporal as J
from tidemark.operators import windows as X
from tidemark.plans.registry import query
from tidemark.plans.standins import DAY, R, S, SAMPLES, TICKS, samples, table, ticks

H = 3600 * S
A, B_ = 19729 * DAY, 19735 * DAY  # 2024-01-07 and 2024-01-13
SPLIT = f"""sp AS (SELECT *, CASE WHEN settled_t < {A} THEN 'train' WHEN "at" >= {A + 48 * H} AND settled_t < {B_} THEN 'validation' WHEN "at" >= {B_ + 48 * H} THEN 'test' ELSE 'purged' END AS role FROM samples)"""


@query("validate_samples", f"""
WITH {SAMPLES}, d AS (SELECT *, CASE WHEN k % 17 = 0 THEN "at" + 1 ELSE "at" END AS feature_t, CASE WHEN k % 19 = 0 THEN spread + 0.01::DOUBLE ELSE spread END AS sp2,
   CASE WHEN k % 23 = 0 THEN 2 ELSE y END AS y2, day AS at_day FROM samples),
g AS (SELECT *, count(*) OVER (PARTITION BY user_id, day) AS copies, min(y2) OVER (PARTITION BY user_id) <> max(y2) OVER (PARTITION BY user_id) AS conflict FROM d),
v AS (SELECT unnest(list_filter([CASE WHEN NOT (feature_t <= "at" AND "at" < close_t AND "at" < settled_t) THEN 'leakage' END, CASE WHEN y2 NOT IN (0, 1) THEN 'label' END,
  CASE WHEN NOT abs(sp2 - (ask - bid)) <= 1e-8 THEN 'spread' END, CASE WHEN copies > 1 THEN 'duplicate' END, CASE WHEN conflict THEN 'conflicting_label' END], lambda x: x IS NOT NULL)) AS violation FROM g)
SELECT violation, count(*) AS n FROM v GROUP BY violation""")
def validate_samples(spark, sf):
    # The stand-in key (user, day) repeats on purpose, so the duplicate and label rules have something to find.
    k = F.col("k")
    d = samples(spark, sf).withColumns({
        "feature_t": F.when(k % 17 == 0, F.col("at") + 1).otherwise(F.col("at")), "spread": F.when(k % 19 == 0, F.col("spread") + 0.01).otherwise(F.col("spread")),
        "y": F.when(k % 23 == 0, 2).otherwise(F.col("y")), "decision_t": F.col("at"), "ticker": F.col("user_id")})
    t = Q.tag_samples(d, once=["ticker", "day"], feature="feature_t").select(F.explode("violations").alias("violation"))
    return t.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("accepted_samples", f"""
WITH {SAMPLES}, g AS (SELECT *, count(*) OVER (PARTITION BY event_id, "at") AS c FROM samples)
SELECT c = 1 AND bid <= ask AND "at" < close_t AS accepted, count(*) AS n FROM g GROUP BY 1""")
def accepted_samples(spark, sf):
    d = samples(spark, sf).withColumn("feature_t", F.col("at"))
    tagged = Q.tag_samples(d, ticker="event_id", feature="feature_t")
    return tagged.groupBy((F.size("violations") == 0).alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


@query("ohlcv_rules", f"""
WITH {TICKS}, b AS (SELECT event_type, t // 3600000000 AS hr, arg_min(value, (t, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (t, event_id)) AS c, CAST(sum(k) AS DOUBLE) AS v, CAST(sum(k - 40) AS DOUBLE) AS buy FROM ticks GROUP BY 1, 2),
v AS (SELECT unnest(list_filter([CASE WHEN buy < 0 OR buy > v THEN 'buy' END, CASE WHEN l - 5 <= 0 THEN 'positive' END, CASE WHEN NOT greatest(o, c) <= h - 0.5::DOUBLE THEN 'high' END], lambda x: x IS NOT NULL)) AS violation FROM b)
SELECT violation, count(*) AS n FROM v GROUP BY 1""")
def ohlcv_rules(spark, sf):
    b = X.ohlcv(ticks(spark, sf), ["event_type"], "t", "value", F.col("k").cast("double"), H, tie="event_id", buy=(F.col("k") - 40).cast("double"))
    b = b.withColumn("low", F.col("low") - 5).withColumn("high", F.col("high") - 0.5)
    v = b.select(F.explode(Q.violations(Q.ohlcv_rules())).alias("violation"))
    return v.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("exclusion_report", f"""
WITH {TICKS}, d AS (SELECT t AS decision, t - (k % 5) * 30000000 AS feature, value FROM ticks),
r AS (SELECT CASE WHEN feature + 5000000 > decision THEN 'future_input' WHEN decision - feature > 65000000 THEN 'stale_input' ELSE 'kept' END AS reason FROM d)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def exclusion_report(spark, sf):
    d = ticks(spark, sf).select(F.col("t").alias("at"), (F.col("t") - F.col("k") % 5 * 30 * S).alias("feature_t"), "value")
    g = Q.availability_gate(d.withColumn("available_t", F.col("feature_t") + 5 * S), "feature_t", "available_t", "at", 65 * S, ["value"])
    return Q.exclusion_report(g)


@query("conflicting_duplicates", f"""
WITH {TICKS} SELECT user_id, event_type, min(k // 50) <> max(k // 50) AS conflict, count(*) AS copies FROM ticks GROUP BY 1, 2""")
def conflicting_duplicates(spark, sf):
    t = ticks(spark, sf).withColumn("half", F.floor(F.col("k") / 50))
    good, bad = Q.conflicting_duplicates(t, ["user_id", "event_type"], ["half"])
    n = t.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("copies"))
    kept = good.join(n, ["user_id", "event_type"]).select("user_id", "event_type", F.lit(False).alias("conflict"), "copies")
    return kept.unionByName(bad.select("user_id", "event_type", F.lit(True).alias("conflict"), "copies"))


@query("hash_chain", """
WITH j AS (SELECT conv_id, turn, role, text, turn * 10 - CASE WHEN turn = 3 AND conv_id % 3 = 0 THEN 25 ELSE 0 END AS clock FROM conversations),
h AS (SELECT *, sha256(conv_id || '|' || turn || '|' || text) AS link FROM j),
p AS (SELECT *, CASE WHEN turn = 0 THEN repeat('0', 64) WHEN conv_id % 4 = 1 AND turn = 2 THEN repeat('f', 64) ELSE sha256(conv_id || '|' || (turn - 1) || '|' || coalesce(lag(text) OVER w, '')) END AS previous,
   lag(turn) OVER w AS pt, lag(link) OVER w AS pl, lag(clock) OVER w AS pc FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT CASE WHEN conv_id % 5 = 2 AND turn = 1 THEN 'altered' WHEN turn = 0 THEN NULL WHEN pt IS NULL OR pt <> turn - 1 THEN 'skipped_sequence' WHEN pl <> previous THEN 'broken_link' WHEN pc > clock THEN 'clock_moved_back' END AS reason FROM p)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def hash_chain(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations").withColumn("clock", F.col("turn") * 10 - F.when((F.col("turn") == 3) & (F.col("conv_id") % 3 == 0), 25).otherwise(0))
    # The journal under test: each turn stores the hash of its predecessor (one lookup by exact key), some links are forged.
    link = lambda t, x: F.sha2(F.concat_ws("|", "conv_id", t, x), 256)
    prior = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_p"))
    j = c.join(prior, ["conv_id", "turn"], "left")
    previous = F.when(F.col("turn") == 0, F.lit("0" * 64)).when((F.col("conv_id") % 4 == 1) & (F.col("turn") == 2), F.lit("f" * 64)).otherwise(
        link((F.col("turn") - 1), F.coalesce("_p", F.lit(""))))
    body = F.concat_ws("|", "conv_id", "turn", "text")
    altered = (F.col("conv_id") % 5 == 2) & (F.col("turn") == 1)
    j = j.withColumn("previous", previous).withColumn("sha256", F.sha2(body, 256)).withColumn("body", F.when(altered, F.concat(body, F.lit("x"))).otherwise(body))
    checked = Q.verify_chain(j, ["conv_id"], seq="turn", clock="clock")
    return Q.exclusion_report(checked)


@query("payload_hash", """
SELECT page_id FROM pages WHERE sha256(html) <> sha256(CASE WHEN page_id % 9 = 0 THEN html || 'x' ELSE html END)""")
def payload_hash(spark, sf):
    body = F.when(F.col("page_id") % 9 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    p = table(spark, sf, "pages").withColumn("sha256", F.sha2(body, 256))
    return Q.verify_payload_hash(p, "html", "sha256").select("page_id")


@query("bracket_partition_check", f"""
WITH {TICKS}, g AS (SELECT event_type, t // 86400000000 AS day, k // 10 AS b, count(*) AS c FROM ticks GROUP BY ALL),
br AS (SELECT *, CASE WHEN b = 0 THEN NULL ELSE b * 10.0::DOUBLE END AS lo, CASE WHEN b = 9 THEN NULL ELSE (b + 1) * 10.0::DOUBLE END AS hi, CAST(row_number() OVER (PARTITION BY event_type, day ORDER BY c DESC, b) = 1 AS INTEGER) AS y FROM g),
o AS (SELECT *, lead(coalesce(lo, -1e9)) OVER (PARTITION BY event_type, day ORDER BY b) AS nlo FROM br)
SELECT event_type, day, count(*) AS brackets, CASE WHEN count(*) < 2 THEN 'too_few_brackets' WHEN sum(CASE WHEN lo IS NULL THEN 1 ELSE 0 END) <> 1 OR sum(CASE WHEN hi IS NULL THEN 1 ELSE 0 END) <> 1 THEN 'missing_tail'
  WHEN bool_or(nlo IS NOT NULL AND nlo <> coalesce(hi, 1e9)) THEN 'gap_or_overlap' WHEN sum(y) <> 1 THEN 'not_one_winner' END AS reason FROM o GROUP BY 1, 2""")
def bracket_partition_check(spark, sf):
    from tidemark.operators.brackets import partition_check

    br = brackets(spark, sf)
    return partition_check(br, ["event_type", "day"], "lower", "upper", "ticker", "y")


def brackets(spark, sf):
    """Ten-cent brackets per series and day with the busiest one as winner; built by aggregates only."""
    g = ticks(spark, sf).groupBy("event_type", F.floor(F.col("t") / DAY).cast("long").alias("day"), F.floor(F.col("k") / 10).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = g.groupBy("event_type", "day").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("_w"))
    lo = F.when(F.col("b") != 0, F.col("b") * F.lit(10.0))
    hi = F.when(F.col("b") != 9, (F.col("b") + 1) * F.lit(10.0))
    return g.join(best, ["event_type", "day"]).select(
        "event_type", "day", "b", "c", F.concat_ws("-", "event_type", "day", "b").alias("ticker"), lo.alias("lower"), hi.alias("upper"), (F.col("b") == F.col("_w")).cast("int").alias("y"))


@query("supported_contracts", """
WITH r AS (SELECT o_orderkey, o_orderkey % 13 AS m FROM orders)
SELECT coalesce(CASE m WHEN 11 THEN 'series' WHEN 12 THEN 'opening_rule' WHEN 8 THEN 'rule_target' WHEN 9 THEN 'notional' WHEN 10 THEN 'payout_disagrees' WHEN 1 THEN 'unreadable_index' WHEN 2 THEN 'index_disagrees' WHEN 3 THEN 'rule_target' WHEN 4 THEN 'life' WHEN 5 THEN 'payout_disagrees' WHEN 6 THEN 'notional' END, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def supported_contracts(spark, sf):
    from tidemark.functions.contracts import OPENING_RULE, supported_contract

    m = F.col("o_orderkey") % 13
    strike = F.when(m == 8, "abc").otherwise("64000.5")
    ts = F.col("o_orderdate").cast("timestamp")
    raw = table(spark, sf, "orders").select(
        F.concat(F.when(m == 11, "OTHER-").otherwise("AVG15-"), F.col("o_orderkey").cast("string")).alias("ticker"),
        F.concat(F.when(m == 12, "If the average ").otherwise(OPENING_RULE), F.lit("close is at least "), F.when(m == 3, F.lit("1")).otherwise(strike), F.lit(", then the market resolves to Yes.")).alias("rules_primary"),
        strike.alias("floor_strike"), F.lit("greater_or_equal").alias("strike_type"), F.lit("yes").alias("result"), F.lit("settled").alias("status"),
        F.when(m == 8, None).when(m == 1, "n/a").when(m == 2, "63,999.99").when(m == 7, "").otherwise("64,000.50").alias("expiration_value"),
        F.when(m == 6, "100").when(m == 9, "one").otherwise("1").alias("notional_value_dollars"), ts.alias("open_time"),
        F.timestamp_micros(F.unix_micros(ts) + F.when(m == 4, 901 * S).otherwise(900 * S)).alias("close_time"),
        F.timestamp_micros(F.unix_micros(ts) + 1000 * S).alias("settlement_ts"), F.when(m == 5, "0").when(m == 10, "paid").otherwise("1.0").alias("settlement_value_dollars"))
    return Q.exclusion_report(raw.withColumn("reason", supported_contract(raw, "AVG15")))


@query("settled_filter", """
WITH r AS (SELECT *, o_orderkey % 6 AS m FROM orders)
SELECT o_orderstatus, count(*) AS n FROM r WHERE o_orderstatus IN ('F', 'O') AND m <> 1 AND m <> 2 AND m <> 3 GROUP BY 1""")
def settled_filter(spark, sf):
    from tidemark.functions.contracts import settled_sample_filter

    m = F.col("o_orderkey") % 6
    yes = F.col("o_orderstatus") == "F"
    raw = table(spark, sf, "orders").select(
        "o_orderstatus", F.when(yes, "yes").when(F.col("o_orderstatus") == "O", "no").alias("result"), F.lit("settled").alias("status"),
        F.when(m == 1, "scalar").otherwise("binary").alias("market_type"), F.when(m == 2, "10").when(m == 4, F.lit(None)).otherwise("1").alias("notional_value_dollars"),
        F.when(m == 3, F.lit("0.5")).when(m == 5, F.lit(None)).otherwise(yes.cast("int").cast("string")).alias("settlement_value_dollars"), F.col("o_orderdate").cast("timestamp").alias("settlement_ts"))
    return settled_sample_filter(raw).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("price_cohort", f"""
WITH {SAMPLES} SELECT horizon, count(*) AS n FROM (SELECT p, CAST(floor(hours_left) AS BIGINT) AS horizon FROM samples) WHERE horizon IN (12, 18, 24) AND p BETWEEN 0.05 AND 0.95 GROUP BY 1""")
def price_cohort(spark, sf):
    from tidemark.functions.contracts import price_cohort as cohort

    s = samples(spark, sf).withColumn("horizon", F.floor("hours_left").cast("long"))
    return s.filter(cohort(F.col("horizon"), F.col("p"))).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"))


@query("coverage_filter", f"""
WITH {SAMPLES}, sc AS (SELECT series, 2.0::DOUBLE AS lo, 12.0::DOUBLE AS hi FROM samples WHERE series <> 'error' GROUP BY series)
SELECT s.series, coalesce(CASE WHEN hi IS NULL THEN 'unsupported_series' WHEN hours_left > hi THEN 'too_early' WHEN hours_left < lo THEN 'too_late' END, 'kept') AS reason, count(*) AS n FROM samples s LEFT JOIN sc ON sc.series = s.series GROUP BY 1, 2""")
def coverage_filter(spark, sf):
    s = samples(spark, sf)
    scope = s.filter("series <> 'error'").groupBy("series").agg(F.lit(2.0).alias("min_hours"), F.lit(12.0).alias("max_hours"))
    out = Q.coverage_filter(s, scope, "series", "hours_left")
    return out.groupBy("series", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("observation_scope", f"""
WITH {SAMPLES}, cal AS (SELECT event, max(settled_t) AS settled FROM samples WHERE series = 'click' GROUP BY event), r AS (SELECT * FROM samples WHERE series IN ('click', 'view'))
SELECT count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.event = cal.event)) AS outside_events, max(settled) AS latest_settled, (SELECT min("at") FROM r) AS first_decision,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.event = cal.event)) = 0 OR max(settled) < (SELECT min("at") FROM r) AS allowed FROM cal""")
def observation_scope(spark, sf):
    s = samples(spark, sf)
    cal = s.filter("series = 'click'").groupBy("event").agg(F.max("settled_t").alias("settled_t"))
    return Q.observation_scope(cal, s.filter(F.col("series").isin("click", "view")))


@query("calibration_validity", f"""
WITH {SAMPLES} SELECT series, count(*) AS n, count(DISTINCT event) AS events, {R('avg(value - k)')} AS bias, {R('stddev_samp(value - k)', 4)} AS sigma,
 CASE WHEN count(DISTINCT event) <> count(*) THEN 'repeated_event' WHEN count(*) < 80 THEN 'too_few_events' END AS reason FROM samples GROUP BY series""")
def calibration_validity(spark, sf):
    c = Q.validate_calibration(samples(spark, sf), ["series"], F.col("value") - F.col("k"))
    return c.select("series", "n", "events", rounded(F.col("bias")).alias("bias"), rounded(F.col("sigma"), 4).alias("sigma"), "reason")


@query("cash_reconciliation", """
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 13 = 0 THEN -0.01 ELSE 0.25 END AS DOUBLE) AS difference FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 AND o_orderkey % 13 <> 0""")
def cash_reconciliation(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.lit(1000.0).alias("bankroll"), F.col("o_totalprice").alias("realized"), F.lit(250.25).alias("open_cost"),
        (F.col("o_totalprice").cast("decimal(18,2)") + F.lit(749.75).cast("decimal(9,2)") + F.when(k % 13 == 0, F.lit(0.01)).when(k % 7 == 0, F.lit(-0.25)).otherwise(F.lit(0.0)).cast("decimal(9,2)")).alias("cash"))
    return Q.reconcile_cash(o, "bankroll", "realized", "open_cost", "cash").select("o_orderkey", F.col("difference").cast("double").alias("difference"))


@query("split_fixed_embargo", f"""
WITH {SAMPLES}, {SPLIT} SELECT role, series, count(*) AS n, min("at") AS first_at, max(settled_t) AS last_settled FROM sp GROUP BY 1, 2""")
def split_fixed_embargo(spark, sf):
    s = C.split_fixed(samples(spark, sf), A, B_, 48 * H)
    return s.groupBy("role", "series").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("settled_t").alias("last_settled"))


@query("split_fraction_days", f"""
WITH {SAMPLES}, d AS (SELECT day, min("at") AS fa, max(settled_t) AS ls, count(*) AS c, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM samples GROUP BY day),
p AS (SELECT *, CASE WHEN i >= floor(n * 0.8) THEN 'test' WHEN i >= floor(n * 0.6) THEN 'validation' ELSE 'train' END AS part FROM d),
tc AS (SELECT min(fa) - {48 * H} AS cut FROM p WHERE part = 'test'), vd AS (SELECT p.* FROM p, tc WHERE part = 'validation' AND ls < cut), vc AS (SELECT min(fa) - {48 * H} AS cut FROM vd)
SELECT p.day, CASE WHEN part = 'test' THEN 'test' WHEN p.day IN (SELECT day FROM vd) THEN 'validation' WHEN part = 'train' AND p.ls < vc.cut THEN 'train' ELSE 'purged' END AS role, c AS rows FROM p, vc""")
def split_fraction_days(spark, sf):
    return C.split_fraction_days(C.day_table(samples(spark, sf)), 48 * H).select("day", "role", "rows")


@query("expanding_folds", f"""
WITH {SAMPLES}, d AS (SELECT day, min("at") AS fa, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM samples GROUP BY day),
td AS (SELECT * FROM d WHERE i >= n - greatest(5, ceil(n * 0.2))), bd AS (SELECT min(fa) - {24 * H} AS b FROM td),
dev AS (SELECT s.* FROM samples s, bd WHERE s.day NOT IN (SELECT day FROM td) AND s.settled_t < b),
u AS (SELECT day, min("at") AS fa, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM dev GROUP BY day),
f AS (SELECT u.*, fold, greatest(5, floor(n * 0.4)) AS fs FROM u, range(3) r(fold)),
e AS (SELECT *, floor(fs + (n - fs) * fold / 3.0::DOUBLE + 1e-9) AS a, floor(fs + (n - fs) * (fold + 1) / 3.0::DOUBLE + 1e-9) AS b FROM f),
c AS (SELECT fold, min(fa) FILTER (WHERE i >= a AND i < b) - {24 * H} AS cut FROM e GROUP BY fold),
r AS (SELECT e.fold, CASE WHEN e.i >= e.a THEN 'validation' WHEN dev.settled_t < c.cut THEN 'train' ELSE 'purged' END AS role, dev.* FROM dev JOIN e ON e.day = dev.day AND e.i < e.b JOIN c ON c.fold = e.fold)
SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n, count(DISTINCT day) AS days, {R('avg(y)')} AS yes_rate FROM r GROUP BY 1, 2""")
def expanding_folds(spark, sf):
    f = C.expanding_folds(samples(spark, sf), embargo=24 * H, min_holdout=5, min_first=5, min_train_days=0)
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("days"), rounded(F.avg("y")).alias("yes_rate"))


@query("rolling_folds", f"""
WITH {SAMPLES}, f AS (SELECT * FROM (VALUES (0, {A}, {A + 3 * DAY}), (1, {A + 3 * DAY}, {A + 6 * DAY}), (2, {A + 6 * DAY}, {A + 12 * DAY})) v(fold, a, b)),
r AS (SELECT fold, CASE WHEN settled_t < a - {2 * H} THEN 'train' WHEN "at" >= a AND "at" < b THEN 'validation' END AS role FROM samples, f)
SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY 1, 2""")
def rolling_folds(spark, sf):
    f = C.rolling_folds(samples(spark, sf), [(A, A + 3 * DAY), (A + 3 * DAY, A + 6 * DAY), (A + 6 * DAY, A + 12 * DAY)], 2 * H)
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("inner_split", f"""
WITH {SAMPLES}, d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM samples GROUP BY day), b AS (SELECT day * 86400000000 AS b FROM d WHERE i = n - greatest(2, n // 4))
SELECT CASE WHEN settled_t < b THEN 'fit' WHEN "at" >= b + {2 * H} THEN 'validation' ELSE 'purged' END AS role, count(*) AS n FROM samples, b GROUP BY 1""")
def inner_split(spark, sf):
    return C.inner_split(samples(spark, sf)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("oof_blocks", f"""
WITH {SAMPLES}, d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM samples GROUP BY day),
p AS (SELECT *, greatest(2, CAST(floor(n * 0.4) AS BIGINT)) AS st FROM d), q AS (SELECT *, (n - st) // 3 AS sz, (n - st) % 3 AS ex, block FROM p, range(3) r(block)),
e AS (SELECT *, st + sz * block + least(block, ex) AS a, st + sz * (block + 1) + least(block + 1, ex) AS b FROM q), c AS (SELECT block, min(day) FILTER (WHERE i = a) * 86400000000 AS cut FROM e GROUP BY block),
r AS (SELECT e.block, CASE WHEN e.i >= e.a AND s."at" >= c.cut + {2 * H} THEN 'score' WHEN s.settled_t < c.cut THEN 'fit' ELSE 'purged' END AS role FROM samples s JOIN e ON e.day = s.day AND e.i < e.b JOIN c ON c.block = e.block)
SELECT CAST(block AS INTEGER) AS block, role, count(*) AS n FROM r GROUP BY 1, 2""")
def oof_blocks(spark, sf):
    return C.oof_blocks(samples(spark, sf)).groupBy("block", "role").agg(F.count(F.lit(1)).alias("n"))


@query("split_violations", f"""
WITH {SAMPLES}, {SPLIT}, k AS (SELECT * FROM sp WHERE role <> 'purged'),
v AS (SELECT CASE role WHEN 'train' THEN 0 WHEN 'validation' THEN {A} ELSE {B_} END AS lo, CASE role WHEN 'train' THEN {A - DAY} WHEN 'validation' THEN {B_} ELSE {B_ + 5 * DAY} END AS hi, * FROM k)
SELECT 'outside_boundary' AS kind, count(*) AS n FROM v WHERE "at" < lo OR settled_t >= hi
UNION ALL SELECT 'missing_embargo', count(*) FROM v WHERE role <> 'train' AND "at" < lo + {72 * H} HAVING count(*) > 0
UNION ALL SELECT 'shared_contract', count(*) FROM (SELECT user_id FROM k GROUP BY 1 HAVING count(DISTINCT role) > 1) HAVING count(*) > 0""")
def split_violations(spark, sf):
    s = C.split_fixed(samples(spark, sf), A, B_, 48 * H).filter("role <> 'purged'")
    # Deliberately tighter limits than the split used, so that violations exist to be found.
    bounds = {"train": (0, A - DAY), "validation": (A, B_), "test": (B_, B_ + 5 * DAY)}
    return C.assert_split(s, "user_id", "role", bounds, 72 * H)


@query("partition_summary", f"""
WITH {SAMPLES}, {SPLIT} SELECT role, count(*) AS samples, count(DISTINCT user_id) AS markets, count(DISTINCT day) AS days, min(day) AS start, max(day) AS "end", {R('avg(y)')} AS yes_rate FROM sp GROUP BY role""")
def partition_summary(spark, sf):
    s = C.partition_summary(C.split_fixed(samples(spark, sf), A, B_, 48 * H), ["role"], "user_id")
    return s.withColumn("yes_rate", rounded(F.col("yes_rate")))


@query("scope_intersection", f"""
WITH {SAMPLES}, {SPLIT}, p AS (SELECT series, role, min(hours_left) AS lo, max(hours_left) AS hi FROM sp WHERE role IN ('train', 'validation', 'test') GROUP BY 1, 2)
SELECT series, {R('max(lo)')} AS min_hours, {R('min(hi)')} AS max_hours FROM p GROUP BY series HAVING count(*) = 3""")
def scope_intersection(spark, sf):
    s = C.scope_intersection(C.split_fixed(samples(spark, sf), A, B_, 48 * H), "role", "series", "hours_left", ["train", "validation", "test"])
    return s.select("series", rounded(F.col("min_hours")).alias("min_hours"), rounded(F.col("max_hours")).alias("max_hours"))


@query("whole_hour_cohort", f"""
WITH {TICKS} SELECT event_id, t // 1000000 // 900 * 900 AS close_s FROM ticks WHERE t // 1000000 // 900 * 900 % 3600 = 0""")
def whole_hour_cohort(spark, sf):
    t = ticks(spark, sf).select("event_id", (F.floor(F.col("t") / (900 * S)) * 900).cast("long").alias("close_s"))
    return C.whole_hours(t, "close_s", 3600)
