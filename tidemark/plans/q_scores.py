"""Queries for brackets, depth and equity, forecast scores and P&L accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import log_loss, rounded
from tidemark.operators import books as K
from tidemark.operators import brackets as L
from tidemark.operators import metrics as A
from tidemark.operators import pnl as P
from tidemark.operators import temporal as J
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.slicing import evaluated_once
from tidemark.plans.oracle_text import CLIP, LOGLOSS, PHI
from tidemark.plans.q_quality import brackets
from tidemark.plans.registry import query
from tidemark.session import written
from tidemark.plans.standins import DAY, LEDGER, R, S, SAMPLES, TICKS, debit_sql, ledger, samples, table, ticks

H = 3600 * S
SIDES = f"""sd AS (SELECT *, {debit_sql('ask', '1')} AS yc, {debit_sql('1 - bid', '1')} AS nc FROM samples),
ed0 AS (SELECT *, q - yc AS ey, 1 - q - nc AS en FROM sd),
ed AS (SELECT *, CASE WHEN {R('ey', 9)} >= {R('en', 9)} THEN 'yes' ELSE 'no' END AS side, greatest(ey, en) AS edge, {R('greatest(ey, en)', 9)} AS edge9 FROM ed0),
op AS (SELECT *, CASE WHEN side = 'yes' THEN y - yc ELSE 1 - y - nc END AS pnl FROM ed)"""
LADDER = """g AS (SELECT event_type, t // 86400000000 AS day, k // 10 AS b, count(*) AS c FROM ticks GROUP BY ALL),
br AS (SELECT *, CASE WHEN b = 0 THEN NULL ELSE b * 10.0::DOUBLE END AS lo, CASE WHEN b = 9 THEN NULL ELSE (b + 1) * 10.0::DOUBLE END AS hi, c / 100.0::DOUBLE AS p, count(*) OVER (PARTITION BY event_type, day) AS nb FROM g),
fu AS (SELECT * FROM br WHERE nb = 10)"""


def full_ladders(spark, sf):
    """Complete partitions only, as an inner join with the aggregate check."""
    br = brackets(spark, sf).withColumn("p", F.col("c") / F.lit(100.0))
    ok = L.partition_check(br, ["event_type", "day"], "lower", "upper", "ticker").filter("reason IS NULL").select("event_type", "day")
    return br.join(ok, ["event_type", "day"])


@query("ladder_quantiles", f"""
WITH {TICKS}, {LADDER}, m AS (SELECT *, CAST(sum(c) OVER (PARTITION BY event_type, day) AS DOUBLE) AS mass, CAST(sum(c) OVER (PARTITION BY event_type, day ORDER BY b) AS DOUBLE) AS cp FROM fu),
cu AS (SELECT *, cp / mass AS cum FROM m),
q AS (SELECT event_type, day, arg_min(b, b) FILTER (WHERE cum >= 0.25) AS b25, arg_min(b, b) FILTER (WHERE cum >= 0.5) AS b50, arg_min(b, b) FILTER (WHERE cum >= 0.75) AS b75 FROM cu GROUP BY 1, 2),
f AS (SELECT cu.*, CASE WHEN b50 IN (0, 9) THEN NULL ELSE b50 * 10.0 + 5 END AS med, CASE WHEN b25 = 0 OR b75 = 9 THEN NULL ELSE (b75 + 1) * 10.0 - b25 * 10.0 END AS iqr FROM cu JOIN q USING (event_type, day))
SELECT event_type, day, b, {R('mass')} AS mass, {R('coalesce((CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo ELSE (lo + hi) / 2 END - med) / 10, 0)')} AS distance, CAST(med IS NULL AS INTEGER) AS median_missing, {R('coalesce(iqr / 10, 0)')} AS iqr, CAST(iqr IS NULL AS INTEGER) AS iqr_missing FROM f""")
def ladder_quantiles(spark, sf):
    # Whole-number masses keep the cumulative shares exact, so quartile ties fall the same way in any engine.
    ladders = full_ladders(spark, sf).withColumn("share", F.col("c").cast("double"))
    out = L.ladder_features(ladders, ["event_type", "day"], "lower", "upper", "share")
    return out.select("event_type", "day", "b", rounded(F.col("ladder_mass")).alias("mass"), rounded(F.col("ladder_distance")).alias("distance"), F.col("ladder_median_missing").alias("median_missing"),
                      rounded(F.col("ladder_iqr")).alias("iqr"), F.col("ladder_iqr_missing").alias("iqr_missing"))


@query("event_normalised", f"""
WITH {SAMPLES} SELECT event_id, {R('CASE WHEN sum(p) OVER w > 0 THEN p / sum(p) OVER w END', 8)} AS p_norm FROM samples WINDOW w AS (PARTITION BY event)""")
def event_normalised(spark, sf):
    out = L.normalize_event(samples(spark, sf).select("event_id", "event", "p"), ["event"], "p")
    return out.select("event_id", rounded(F.col("p_norm"), 8).alias("p_norm"))


@query("cdf_bounds", f"""
WITH {TICKS}, {LADDER}, n AS (SELECT *, c / CAST(sum(c) OVER (PARTITION BY event_type, day) AS DOUBLE) AS s FROM fu), q AS (SELECT *, greatest(0, s - 0.03::DOUBLE) AS ql, least(1, s + 0.02::DOUBLE) AS qh FROM n),
w AS (SELECT *, sum(ql) OVER o AS pl, sum(qh) OVER o AS ph, sum(ql) OVER a AS tl, sum(qh) OVER a AS th FROM q WINDOW o AS (PARTITION BY event_type, day ORDER BY b), a AS (PARTITION BY event_type, day))
SELECT event_type, day, b, {R('greatest(pl, 1 - (th - ph))')} AS cdf_low, {R('least(ph, 1 - (tl - pl))')} AS cdf_high FROM w""")
def cdf_bounds(spark, sf):
    out = _bounds(spark, sf)
    return out.select("event_type", "day", "b", rounded(F.col("cdf_low")).alias("cdf_low"), rounded(F.col("cdf_high")).alias("cdf_high"))


def _bounds(spark, sf):
    f = L.normalize_event(full_ladders(spark, sf).withColumn("share", F.col("c").cast("double")), ["event_type", "day"], "share", "s")
    f = f.withColumn("ql", F.greatest(F.lit(0.0), F.col("s") - 0.03)).withColumn("qh", F.least(F.lit(1.0), F.col("s") + 0.02))
    return L.cdf_bounds(f, ["event_type", "day"], "lower", "ql", "qh")


@query("quantile_bracket_bounds", f"""
WITH {TICKS}, {LADDER}, n AS (SELECT *, c / CAST(sum(c) OVER (PARTITION BY event_type, day) AS DOUBLE) AS s FROM fu), q AS (SELECT *, greatest(0, s - 0.03::DOUBLE) AS ql, least(1, s + 0.02::DOUBLE) AS qh FROM n),
w AS (SELECT *, sum(ql) OVER o AS pl, sum(qh) OVER o AS ph, sum(ql) OVER a AS tl, sum(qh) OVER a AS th FROM q WINDOW o AS (PARTITION BY event_type, day ORDER BY b), a AS (PARTITION BY event_type, day)),
x AS (SELECT *, greatest(pl, 1 - (th - ph)) AS cl, least(ph, 1 - (tl - pl)) AS ch FROM w),
m AS (SELECT event_type, day, min(b) FILTER (WHERE ch >= 0.5 - 1e-8) AS bl, min(b) FILTER (WHERE cl >= 0.5 - 1e-8) AS bh FROM x GROUP BY 1, 2)
SELECT event_type, day, CASE WHEN bl > 0 THEN bl * 10.0::DOUBLE END AS median_low, CASE WHEN bh < 9 THEN (bh + 1) * 10.0::DOUBLE END AS median_high FROM m""")
def quantile_bracket_bounds(spark, sf):
    return L.quantile_bounds(_bounds(spark, sf), ["event_type", "day"], "lower", "upper", {"median": 0.5})


@query("period_union_bounds", f"""
WITH {TICKS}, p AS (SELECT user_id, t AS a, t + (k + 1) * 600000000 AS b, k / 200.0::DOUBLE AS p FROM ticks)
SELECT user_id, max(p) AS any_low, {R('least(1.0, sum(p))')} AS any_high, count(*) AS periods FROM p WHERE a < {19736 * DAY} AND b > {19735 * DAY} GROUP BY user_id""")
def period_union_bounds(spark, sf):
    p = ticks(spark, sf).select("user_id", F.col("t").alias("a"), (F.col("t") + (F.col("k") + 1) * 600 * S).alias("b"), (F.col("k") / 200.0).alias("p"))
    return L.cumulative_interval_bounds(p, ["user_id"], "a", "b", (19735 * DAY, 19736 * DAY), "p").withColumn("any_high", rounded(F.col("any_high")))


@query("equity_drawdown", f"""
WITH {LEDGER}, e AS (SELECT *, 100000 + sum(pnl) OVER (ORDER BY t, ticker ROWS UNBOUNDED PRECEDING) AS eq FROM ledger), p AS (SELECT *, greatest(100000, max(eq) OVER (ORDER BY t, ticker ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
SELECT day, {R('max(peak - eq)', 2)} AS max_drawdown, {R('arg_max(eq, (t, ticker))', 2)} AS closing_equity FROM p GROUP BY day""")
def equity_drawdown(spark, sf):
    led = written(ledger(spark, sf).select("t", "day", "ticker", "pnl"), "ledger")  # read more than once
    e = K.equity_curve(led, "t", F.col("pnl"), 100000.0, ["ticker"])
    return e.groupBy("day").agg(rounded(F.max("drawdown"), 2).alias("max_drawdown"), rounded(F.max_by("equity", F.struct("t", "ticker")), 2).alias("closing_equity"))


@query("exposure_curve", f"""
WITH {LEDGER}, d AS (SELECT series, ticker, t AS tt, 1 AS kind, cost AS delta FROM ledger UNION ALL SELECT series, ticker, t + quantity * 86400000000, 0, -cost FROM ledger),
c AS (SELECT *, sum(delta) OVER (PARTITION BY series ORDER BY tt, kind, ticker ROWS UNBOUNDED PRECEDING) AS oc FROM d)
SELECT series, tt // 86400000000 AS day, {R('max(oc)', 2)} AS max_open, count(*) AS entries FROM c WHERE kind = 1 GROUP BY 1, 2""")
def exposure_curve(spark, sf):
    led = ledger(spark, sf).select("series", "ticker", "t", "cost", (F.col("t") + F.col("quantity") * DAY).alias("settle_t"))
    led = written(led, "ledger")
    e = K.exposure(led, ["series"], "t", "settle_t", "cost", "ticker")
    return e.groupBy("series", F.floor(F.col("t") / DAY).cast("long").alias("day")).agg(rounded(F.max("open_cost"), 2).alias("max_open"), F.count(F.lit(1)).alias("entries"))


def _levels(spark, sf):
    li = table(spark, sf, "lineitem")
    cents = F.lit(1) + F.floor("l_extendedprice").cast("long") % 99
    return li.select("l_orderkey", cents.alias("cents"), (cents / F.lit(100.0)).alias("price"), F.col("l_quantity").cast("long").alias("qty"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("level"))


LEVELS = """lv AS (SELECT l_orderkey, 1 + CAST(floor(l_extendedprice) AS BIGINT) % 99 AS cents, CAST(l_quantity AS BIGINT) AS qty, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS level FROM lineitem)"""


@query("depth_walk", f"""
WITH {LEVELS}, c AS (SELECT *, sum(qty) OVER w AS cq, sum(qty * cents / 100.0::DOUBLE) OVER w AS cc FROM lv WINDOW w AS (PARTITION BY l_orderkey ORDER BY cents, level ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, CAST(sum(qty) AS BIGINT) AS quantity, {R('sum(qty * cents / 100.0::DOUBLE)')} AS cost, count(*) AS levels FROM c WHERE cents <= 60 AND cc <= 40 + 1e-9 GROUP BY 1""")
def depth_walk(spark, sf):
    curve = K.depth_curve(_levels(spark, sf), ["l_orderkey"], "cents", "price", "qty", 25, ["level"])
    return K.available_under(curve, ["l_orderkey"], "price", "qty", max_price=0.60, budget=40.0 + 1e-9).withColumn("cost", rounded(F.col("cost")))


@query("liquidation_value", f"""
WITH {LEVELS}, u AS (SELECT *, CAST(floor(qty * 0.1::DOUBLE) AS BIGINT) AS us FROM lv), v AS (SELECT *, coalesce(sum(us) OVER (PARTITION BY l_orderkey ORDER BY cents DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM u WHERE us > 0),
pos AS (SELECT o_orderkey, 1 + o_orderkey % 9 AS quantity FROM orders), j AS (SELECT o_orderkey, quantity, cents / 100.0::DOUBLE AS price, coalesce(least(us, greatest(0, quantity - bf)), 0) AS tk FROM pos LEFT JOIN v ON v.l_orderkey = o_orderkey),
f AS (SELECT *, CASE WHEN tk > 0 THEN greatest(0, price * tk - ({debit_sql('price', 'tk')} - price * tk)) ELSE 0 END AS worth FROM j)
SELECT o_orderkey, quantity, {R('sum(worth)')} AS value, CAST(max(quantity) - sum(tk) AS BIGINT) AS unpriced FROM f GROUP BY 1, 2""")
def liquidation_value(spark, sf):
    bids = _levels(spark, sf).withColumn("o_orderkey", F.col("l_orderkey")).withColumn("rank", -F.col("cents"))
    pos = table(spark, sf, "orders").select("o_orderkey", (F.lit(1) + F.col("o_orderkey") % 9).alias("quantity"), F.lit(0.07).alias("fee_rate"))
    out = K.liquidation_value(pos, bids.drop("l_orderkey"), ["o_orderkey"], ["o_orderkey"], "rank", "price", "qty", tie=["level"])
    return out.select("o_orderkey", "quantity", rounded(F.col("value")).alias("value"), "unpriced")


def _models(spark, sf):
    s = samples(spark, sf)
    pair = F.array(F.struct(F.lit("market").alias("model"), F.col("p").alias("f")), F.struct(F.lit("model").alias("model"), F.col("q").alias("f")))
    return s.withColumn("_m", F.explode(pair)).withColumn("model", F.col("_m.model")).withColumn("f", F.col("_m.f")).drop("_m")


MODELS = SAMPLES + """, mo AS (SELECT *, 'market' AS model, p AS f FROM samples UNION ALL SELECT *, 'model', q FROM samples)"""


@query("binary_metrics", f"""
WITH {MODELS} SELECT model, series, count(*) AS events, count(DISTINCT day) AS days, {R('avg(CASE WHEN (' + CLIP('f', 1e-6, 1 - 1e-6) + ' >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy, {R('avg(' + LOGLOSS('f', 'y') + ')')} AS log_loss,
 {R('avg(pow(' + CLIP('f', 1e-6, 1 - 1e-6) + ' - y, 2))')} AS brier FROM mo GROUP BY 1, 2""")
def binary_metrics(spark, sf):
    m = A.binary_metrics(_models(spark, sf), ["model", "series"], "f", "y", "day")
    return m.select("model", "series", "events", "days", *[rounded(F.col(c)).alias(c) for c in ("accuracy", "log_loss", "brier")])


@query("calibration_bins", f"""
WITH {MODELS}, h AS (SELECT model, f, y, i FROM mo, range(10) r(i) WHERE f >= i * 0.1::DOUBLE AND f < i * 0.1::DOUBLE + 0.1::DOUBLE),
u AS (SELECT 'half_open' AS rule, model, CAST(i AS INTEGER) AS bin, f, y FROM h UNION ALL SELECT 'floor', model, CAST(least(9, floor(f * 10)) AS INTEGER), f, y FROM mo)
SELECT rule, model, bin, count(*) AS count, {R('avg(f)')} AS predicted, {R('avg(y)')} AS observed FROM u GROUP BY 1, 2, 3""")
def calibration_bins(spark, sf):
    m = _models(spark, sf)
    one = A.calibration(m, ["model"], "f", "y", A.half_open_bin(F.col("f"))).withColumn("rule", F.lit("half_open"))
    two = A.calibration(m, ["model"], "f", "y", A.floor_bin(F.col("f"))).withColumn("rule", F.lit("floor"))
    return one.unionByName(two).select("rule", "model", "bin", "count", rounded(F.col("predicted")).alias("predicted"), rounded(F.col("observed")).alias("observed"))


@query("day_mean_score", f"""
WITH {MODELS}, d AS (SELECT model, day, avg({LOGLOSS('f', 'y', 1e-8)}) AS ll, avg(pow(f - y, 2)) AS b, count(*) AS n FROM mo GROUP BY 1, 2)
SELECT model, {R('avg(ll)')} AS log_loss, {R('avg(b)')} AS brier, CAST(sum(n) AS BIGINT) AS samples, count(*) AS days FROM d GROUP BY 1""")
def day_mean_score(spark, sf):
    m = A.day_mean_score(_models(spark, sf), ["model"], "f", "y", "day")
    return m.withColumns({c: rounded(F.col(c)) for c in ("log_loss", "brier")})


@query("event_date_weighted_ece", f"""
WITH {MODELS}, ev AS (SELECT model, day, event, count(*) AS ne FROM mo GROUP BY 1, 2, 3), dy AS (SELECT model, day, count(*) AS ed FROM ev GROUP BY 1, 2), dd AS (SELECT model, count(*) AS d FROM dy GROUP BY 1),
w AS (SELECT mo.model, f, y, least(9, floor(f * 10)) AS bin, 1.0::DOUBLE / (d * ed * ne) AS w FROM mo JOIN ev USING (model, day, event) JOIN dy USING (model, day) JOIN dd USING (model)),
b AS (SELECT model, bin, sum(w) AS wt, sum(w * f) / sum(w) AS pr, sum(w * y) / sum(w) AS ob, sum(w * pow(f - y, 2)) AS br, sum(w * {LOGLOSS('f', 'y', 1e-12)}) AS ll FROM w GROUP BY 1, 2)
SELECT model, {R('sum(wt * abs(pr - ob))')} AS ece, {R('sum(br)')} AS brier, {R('sum(ll)')} AS log_loss FROM b GROUP BY 1""")
def event_date_weighted_ece(spark, sf):
    s, _ = A.event_date_weighted(_models(spark, sf), ["model"], "f", "y", "day", "event")
    return s.withColumns({c: rounded(F.col(c)) for c in ("ece", "brier", "log_loss")})


@query("date_weights", f"""
WITH {SAMPLES}, n AS (SELECT day, count(*) AS c FROM samples GROUP BY 1) SELECT event_id, {R('(SELECT sum(c) FROM n) / ((SELECT count(*) FROM n) * c::DOUBLE)')} AS weight FROM samples JOIN n USING (day)""")
def date_weights(spark, sf):
    return A.date_weights(samples(spark, sf).select("event_id", "day"), "day").select("event_id", rounded(F.col("weight")).alias("weight"))


SEG = f"""sg AS (SELECT *, unnest(['series', 'horizon', 'price', 'horizon_price']) AS kind,
 unnest([series, CASE WHEN hours_left <= 6 THEN 'near' ELSE 'far' END, CASE WHEN p < 0.1 THEN '0-0.1' WHEN p < 0.3 THEN '0.1-0.3' WHEN p < 0.7 THEN '0.3-0.7' WHEN p < 0.9 THEN '0.7-0.9' ELSE '0.9-1' END,
  CASE WHEN hours_left <= 6 THEN 'near' ELSE 'far' END || '/' || CASE WHEN p < 0.1 THEN '0-0.1' WHEN p < 0.3 THEN '0.1-0.3' WHEN p < 0.7 THEN '0.3-0.7' WHEN p < 0.9 THEN '0.7-0.9' ELSE '0.9-1' END]) AS segment FROM samples)"""


def _segments(spark, sf):
    near = F.when(F.col("hours_left") <= 6, "near").otherwise("far")
    price = A.bucket(F.col("p"), A.PRICE_BUCKETS)
    return A.segments(samples(spark, sf), {"series": F.col("series"), "horizon": near, "price": price, "horizon_price": F.concat(near, F.lit("/"), price)})


@query("segment_scores", f"""
WITH {SAMPLES}, {SEG}, d AS (SELECT kind, segment, day, avg({LOGLOSS('q', 'y', 1e-8)}) AS ll, avg(pow(q - y, 2)) AS b, count(*) AS n FROM sg GROUP BY 1, 2, 3)
SELECT kind, segment, {R('avg(ll)')} AS log_loss, {R('avg(b)')} AS brier, CAST(sum(n) AS BIGINT) AS samples, count(*) AS days FROM d GROUP BY 1, 2""")
def segment_scores(spark, sf):
    m = A.day_mean_score(_segments(spark, sf), ["kind", "segment"], "q", "y", "day")
    return m.withColumns({c: rounded(F.col(c)) for c in ("log_loss", "brier")})


@query("loss_contribution", f"""
WITH {SAMPLES}, {SEG}, z AS (SELECT day, count(*) AS n FROM samples GROUP BY 1)
SELECT kind, segment, {R('sum((' + LOGLOSS('q', 'y', 1e-8) + ' - ' + LOGLOSS('p', 'y', 1e-8) + ') / n / (SELECT count(*) FROM z))', 5)} AS contribution, count(*) AS rows FROM sg JOIN z USING (day) GROUP BY 1, 2""")
def loss_contribution(spark, sf):
    ll = lambda c: log_loss(F.col(c), F.col("y"), 1e-8)
    out = A.loss_contribution(_segments(spark, sf), ["kind", "segment"], ll("q"), ll("p"), "day")
    return out.withColumn("contribution", rounded(F.col("contribution"), 5))


@query("event_nll", f"""
WITH {TICKS}, {LADDER}, s AS (SELECT *, p / sum(p) OVER (PARTITION BY event_type, day) AS pn, row_number() OVER (PARTITION BY event_type, day ORDER BY c DESC, b) AS rk FROM fu),
d AS (SELECT day, avg(-ln(greatest(pn, 1e-12))) AS l, count(*) AS n FROM s WHERE rk = 1 GROUP BY 1)
SELECT {R('avg(l)')} AS nll, CAST(sum(n) AS BIGINT) AS winners, count(*) AS days FROM d""")
def event_nll(spark, sf):
    f = L.normalize_event(full_ladders(spark, sf), ["event_type", "day"], "p", "pn")
    return A.event_nll(f, [], "pn", "y", "day").withColumn("nll", rounded(F.col("nll")))


@query("event_mass_error", f"""
WITH {TICKS}, {LADDER}, s AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY c DESC, b) AS rk, p * 1.1::DOUBLE + 0.01::DOUBLE AS m FROM fu),
e AS (SELECT event_type, day, sum(p) AS sp, sum(m) AS sm, sum(CASE WHEN rk = 1 THEN p END) AS wp, sum(CASE WHEN rk = 1 THEN m END) AS wm FROM s GROUP BY 1, 2)
SELECT count(*) AS complete_events, {R('avg(abs(sm - 1))')} AS mass_error, {R('avg(-ln(greatest(wm / sm, 1e-8)))')} AS model_loss, {R('avg(-ln(greatest(wp / sp, 1e-8)))')} AS market_loss FROM e""")
def event_mass_error(spark, sf):
    f = full_ladders(spark, sf).withColumn("m", F.col("p") * 1.1 + 0.01)
    out = A.event_mass_error(f, ["event_type", "day"], "m", "p", "y")
    return out.withColumns({c: rounded(F.col(c)) for c in ("mass_error", "model_loss", "market_loss")})


@query("edge_buckets", f"""
WITH {SAMPLES}, {SIDES}, x AS (SELECT *, lead("at") OVER w AS xt, lead(bid) OVER w AS xb, lead(ask) OVER w AS xa FROM op WINDOW w AS (PARTITION BY user_id ORDER BY "at", event_id)),
z AS (SELECT *, CASE WHEN xt - "at" <= 86400000000 THEN CASE WHEN side = 'yes' THEN y - {debit_sql('xa', '1')} ELSE 1 - y - {debit_sql('1 - xb', '1')} END END AS later FROM x)
SELECT CASE WHEN edge9 < 0 THEN 'negative' WHEN edge9 < 0.02 THEN '0-2 cents' WHEN edge9 < 0.04 THEN '2-4 cents' WHEN edge9 < 0.08 THEN '4-8 cents' ELSE '8+ cents' END AS bucket, count(*) AS rows, count(DISTINCT event) AS events,
 {R('avg(edge)')} AS claimed, {R('avg(pnl)')} AS realized, {R('avg(later)')} AS delayed, count(later) AS delayed_rows FROM z GROUP BY 1""")
def edge_buckets(spark, sf):
    s = samples(spark, sf).select("event_id", "user_id", "event", "at", "bid", "ask", "q", "y")
    nxt = s.select("user_id", F.col("at").alias("t"), F.col("event_id").alias("_e"), "bid", "ask")
    x = J.asof_forward(s, nxt, ["user_id"], "at", "t", max_gap=DAY, tie=["_e"])
    x = A.with_best_side(x, p="q")
    x = x.withColumn("pnl", A.one_contract_pnl(F.col("side"), F.col("y"), F.col("bid"), F.col("ask")))
    x = x.withColumn("delayed_pnl", F.when(F.col("later").isNotNull(), A.one_contract_pnl(F.col("side"), F.col("y"), F.col("later.bid"), F.col("later.ask"))))
    out = A.edge_buckets(x, "edge", "pnl", "event", "delayed_pnl")
    return out.withColumns({c: rounded(F.col(c)) for c in ("claimed", "realized", "delayed")})


@query("net_edge_bins", f"""
WITH {SAMPLES}, {SIDES} SELECT CASE WHEN edge9 < 0.08 THEN '0.04-0.08' WHEN edge9 < 0.15 THEN '0.08-0.15' ELSE '0.15-1.01' END AS bin, count(*) AS opportunities, {R('avg(edge)')} AS predicted, {R('avg(pnl)')} AS realized FROM op WHERE edge9 >= 0.04 GROUP BY 1""")
def net_edge_bins(spark, sf):
    x = A.with_best_side(samples(spark, sf), p="q")
    x = x.withColumn("pnl", A.one_contract_pnl(F.col("side"), F.col("y"), F.col("bid"), F.col("ask")))
    return A.net_edge_bins(x, "edge", "pnl").withColumns({c: rounded(F.col(c)) for c in ("predicted", "realized")})


@query("source_audit", f"""
WITH {TICKS}, b AS (SELECT t // 3600000000 AS hr, min(value) AS low, max(value) AS high, arg_max(value, (t, event_id)) AS close FROM ticks GROUP BY 1),
r AS (SELECT event_type, t // 3600000000 AS hr, value + 0.01::DOUBLE AS strike, CAST(k >= 50 AS INTEGER) AS y FROM ticks),
j AS (SELECT r.*, f.low AS fl, f.high AS fh, f.close AS fc, o.low AS ol, o.high AS oh, o.close AS oc, 10000 * (o.close / strike - 1) AS bps FROM r JOIN b f ON f.hr = r.hr JOIN b o ON o.hr = r.hr - 1)
SELECT event_type, count(*) AS matched, CAST(sum(CASE WHEN (fc >= strike) <> (y = 1) THEN 1 ELSE 0 END) AS BIGINT) AS label_disagreements, CAST(sum(CASE WHEN (y = 0 AND fl >= strike) OR (y = 1 AND fh < strike) THEN 1 ELSE 0 END) AS BIGINT) AS whole_range_opposes,
 CAST(sum(CASE WHEN NOT (ol <= strike AND strike <= oh) THEN 1 ELSE 0 END) AS BIGINT) AS target_outside_range, {R('avg(bps)', 2)} AS basis_mean, {R('quantile_cont(abs(bps), 0.5)', 3)} AS basis_median_abs, {R('quantile_cont(abs(bps), 0.95)', 2)} AS basis_p95_abs FROM j GROUP BY 1""")
def source_audit(spark, sf):
    t = ticks(spark, sf).withColumn("hr", F.floor(F.col("t") / H).cast("long"))
    b = t.groupBy("hr").agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", F.struct("t", "event_id")).alias("close")).alias("bar"))
    r = t.select("event_type", "hr", (F.col("value") + 0.01).alias("strike"), (F.col("k") >= 50).cast("int").alias("y"))
    r = r.join(b.withColumnRenamed("bar", "final"), "hr").join(b.select((F.col("hr") + 1).alias("hr"), F.col("bar").alias("opening")), "hr")
    out = A.source_audit(r, ["event_type"])
    return out.withColumns({"basis_mean": rounded(F.col("basis_mean"), 2), "basis_median_abs": rounded(F.col("basis_median_abs"), 3), "basis_p95_abs": rounded(F.col("basis_p95_abs"), 2)})


@query("residual_summary", f"""
WITH {TICKS}, one AS (SELECT any_value(event_type) AS event_type, any_value(value - k) AS r FROM ticks GROUP BY user_id, t // 3600000000 HAVING count(*) = 1)
SELECT event_type, count(*) AS n, {R('avg(r)')} AS bias, {R('stddev_samp(r)', 5)} AS sigma, {R('sqrt(avg(r * r))', 5)} AS rmse, {R('quantile_cont(r, 0.05)')} AS p05, {R('quantile_cont(r, 0.5)')} AS p50, {R('quantile_cont(r, 0.95)')} AS p95, count(*) >= 80 AS usable, grouping(event_type) = 1 AS pooled FROM one GROUP BY GROUPING SETS ((event_type), ())""")
def residual_summary(spark, sf):
    t = ticks(spark, sf).select("user_id", F.floor(F.col("t") / H).cast("long").alias("hr"), "event_type", (F.col("value") - F.col("k")).alias("res"))
    out = A.residual_summary(t, ["event_type"], "res", event=["user_id", "hr"])
    return out.select("event_type", "n", rounded(F.col("bias")).alias("bias"), rounded(F.col("sigma"), 5).alias("sigma"), rounded(F.col("rmse"), 5).alias("rmse"), *[rounded(F.col(c)).alias(c) for c in ("p05", "p50", "p95")], "usable", "pooled")


@query("station_bias_fit", f"""
WITH {TICKS} SELECT event_type, count(*) AS n, CASE WHEN count(*) >= 90 THEN {R('avg(value - k)')} END AS bias, CASE WHEN count(*) >= 90 THEN {R('greatest(0.5, sqrt(avg(pow(value - k, 2))))', 5)} END AS sigma_raw, CASE WHEN count(*) >= 90 THEN {R('greatest(0.5, stddev_pop(value - k))', 5)} END AS sigma_corrected FROM ticks GROUP BY 1""")
def station_bias_fit(spark, sf):
    out = A.station_bias_fit(ticks(spark, sf), "event_type", "value", "k")
    return out.select("event_type", "n", rounded(F.col("bias")).alias("bias"), rounded(F.col("sigma_raw"), 5).alias("sigma_raw"), rounded(F.col("sigma_corrected"), 5).alias("sigma_corrected"))


@query("gaussian_crps", f"""
WITH {TICKS}, g AS (SELECT event_type, value, (value - k) / 30.0::DOUBLE AS z, k - value AS e, 30.0::DOUBLE AS s FROM ticks), p AS (SELECT *, {PHI('z')} AS ph FROM g)
SELECT event_type, count(*) AS n, {R('avg(abs(e))')} AS mae, {R('avg(s * (z * (2 * ph - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))')} AS crps, {R('avg(ln(s) + 0.5 * z * z + 0.5 * ln(2 * pi()))')} AS nll, {R('avg(CASE WHEN abs(z) <= 1.6448536269514722::DOUBLE THEN 1.0 ELSE 0.0 END)')} AS coverage90,
 CAST(sum(CASE WHEN least(9, floor(ph * 10)) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pit_0, CAST(sum(CASE WHEN least(9, floor(ph * 10)) = 9 THEN 1 ELSE 0 END) AS BIGINT) AS pit_9 FROM p GROUP BY 1""")
def gaussian_crps(spark, sf):
    g = A.gaussian_rows(ticks(spark, sf), "value", F.col("k").cast("double"), F.lit(30.0))
    out = A.gaussian_summary(g, ["event_type"])
    return out.select("event_type", "n", *[rounded(F.col(c)).alias(c) for c in ("mae", "crps", "nll", "coverage90")], "pit_0", "pit_9")


@query("drift", f"""
WITH {SAMPLES}, l AS (SELECT day < 19738 AS tr, unnest(['p', 'q', 'spread', 'value']) AS feature, unnest([p, q, spread, value]) AS v FROM samples),
m AS (SELECT feature, avg(v) FILTER (WHERE tr) AS tm, avg(v) FILTER (WHERE NOT tr) AS sm, greatest(1e-6, stddev_pop(v) FILTER (WHERE tr)) AS sc, stddev_pop(v) FILTER (WHERE NOT tr) AS ts FROM l GROUP BY 1),
c AS (SELECT feature, avg(CASE WHEN abs((v - tm) / sc) > 5 THEN 1.0 ELSE 0.0 END) AS cs FROM l JOIN m USING (feature) WHERE NOT tr GROUP BY 1)
SELECT feature, {R('tm')} AS train_mean, {R('sm')} AS test_mean, {R('(sm - tm) / sc')} AS shift_sd, {R('ts / sc')} AS sd_ratio, {R('cs')} AS clipped_share FROM m JOIN c USING (feature)""")
def drift(spark, sf):
    out = A.drift(samples(spark, sf), ["p", "q", "spread", "value"], F.col("day") < 19738)
    return out.select("feature", *[rounded(F.col(c)).alias(c) for c in ("train_mean", "test_mean", "shift_sd", "sd_ratio", "clipped_share")])


@query("timing_audit", f"""
WITH {SAMPLES}, a AS (SELECT unnest(['to_close', 'to_settlement']) AS kind, unnest([(close_t - "at") / 1e6::DOUBLE, (settled_t - close_t) / 1e6::DOUBLE]) AS age FROM samples) SELECT kind, age, count(*) AS n FROM a GROUP BY 1, 2""")
def timing_audit(spark, sf):
    return A.timing_audit(samples(spark, sf), {"to_close": (F.col("close_t") - F.col("at")) / 1e6, "to_settlement": (F.col("settled_t") - F.col("close_t")) / 1e6})


@query("exclusive_counts", f"""
WITH {SAMPLES} SELECT count(*) AS rows, count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT event) AS distinct_event, count(DISTINCT day) AS distinct_day FROM samples""")
def exclusive_counts(spark, sf):
    return A.exclusive_counts(samples(spark, sf), ["user_id", "event", "day"])


@query("paired_cohort_scores", f"""
WITH {SAMPLES}, f AS (SELECT *, "at" = min("at") OVER (PARTITION BY user_id) AS first_, CASE WHEN k % 6 = 0 THEN NULL ELSE p END AS base FROM samples),
c AS (SELECT 'first_prediction' AS cohort, q AS m, base AS b, y, event FROM f WHERE first_ UNION ALL SELECT 'filled', q, base, y, event FROM f WHERE abs(q - p) >= 0.05 UNION ALL SELECT 'filled_vs_ask', q, ask, y, event FROM f WHERE abs(q - p) >= 0.05)
SELECT cohort, count(*) AS paired, count(DISTINCT event) AS event_groups, {R('avg(pow(m - y, 2))')} AS model_brier, {R('avg(pow(b - y, 2))')} AS market_brier, {R('avg(' + LOGLOSS('m', 'y', 1e-12) + ')')} AS model_log_loss, {R('avg(' + LOGLOSS('b', 'y', 1e-12) + ')')} AS market_log_loss FROM c WHERE b IS NOT NULL GROUP BY 1""")
def paired_cohort_scores(spark, sf):
    s = samples(spark, sf)
    first = s.groupBy("user_id").agg(F.min("at").alias("_first"))
    s = s.join(first, "user_id")
    base = F.when(F.col("k") % 6 != 0, F.col("p"))
    filled = F.abs(F.col("q") - F.col("p")) >= 0.05
    out = A.paired_cohort_scores(s, {"first_prediction": (F.col("at") == F.col("_first"), F.col("q"), base), "filled": (filled, F.col("q"), base), "filled_vs_ask": (filled, F.col("q"), F.col("ask"))}, F.col("y"), "event")
    return out.withColumns({c: rounded(F.col(c)) for c in ("model_brier", "market_brier", "model_log_loss", "market_log_loss")})


@query("quality_label_scores", f"""
WITH d AS (SELECT doc_id, lang, source, least(0.99::DOUBLE, greatest(0.01::DOUBLE, n_chars / 4000.0::DOUBLE)) AS p, quality AS y FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS events, count(DISTINCT source) AS days, {R('avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy, {R('avg(' + LOGLOSS('p', 'y') + ')')} AS log_loss, {R('avg(pow(p - y, 2))')} AS brier FROM d GROUP BY 1""")
def quality_label_scores(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / F.lit(4000.0))).alias("p"))
    m = A.binary_metrics(d.join(table(spark, sf, "labels"), "doc_id"), ["lang"], "p", "quality", "source")
    return m.withColumns({c: rounded(F.col(c)) for c in ("accuracy", "log_loss", "brier")})


@query("exact_group_quantiles", f"""
SELECT l_returnflag, {R('quantile_cont(l_extendedprice, 0.025)')} AS q025, {R('quantile_cont(l_extendedprice, 0.5)')} AS q500, {R('quantile_cont(l_extendedprice, 0.975)')} AS q975 FROM lineitem GROUP BY 1""")
def exact_group_quantiles(spark, sf):
    out = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q025": 0.025, "q500": 0.5, "q975": 0.975})
    return out.withColumns({c: rounded(F.col(c)) for c in ("q025", "q500", "q975")})


@query("ledger_summary", f"""
WITH {LEDGER} SELECT series, side, count(*) AS entries, CAST(sum(quantity) AS BIGINT) AS contracts, {R('sum(cost)', 2)} AS capital, {R('sum(fees)', 2)} AS fees, {R('sum(pnl)', 2)} AS pnl, {R('sum(pnl) / sum(quantity)')} AS net_per_contract, {R('sum(pnl) / sum(cost)')} AS return_on_deployed, max(cost) AS max_bet, count(DISTINCT day) AS days_traded FROM ledger GROUP BY 1, 2""")
def ledger_summary(spark, sf):
    out = P.ledger_summary(ledger(spark, sf), ["series", "side"])
    return out.withColumns({**{c: rounded(F.col(c), 2) for c in ("capital", "fees", "pnl")}, **{c: rounded(F.col(c)) for c in ("net_per_contract", "return_on_deployed")}})


@query("signal_funnel", f"""
WITH {SAMPLES}, {SIDES}, f AS (SELECT *, CASE WHEN side = 'yes' THEN q - {debit_sql('least(1.0::DOUBLE, ask + 0.02::DOUBLE)', '1')} ELSE 1 - q - {debit_sql('least(1.0::DOUBLE, 1 - bid + 0.02::DOUBLE)', '1')} END AS after FROM ed)
SELECT series, count(*) AS rows, count(*) FILTER (WHERE abs(q - (bid + ask) / 2.0::DOUBLE) >= 0.04) AS raw_edge, count(*) FILTER (WHERE greatest(q - ask, bid - q) >= 0.04) AS after_spread, count(*) FILTER (WHERE edge9 >= 0.04) AS after_fees, count(*) FILTER (WHERE edge9 >= 0.04 AND {R('after', 9)} >= 0.04) AS after_slippage FROM f GROUP BY 1""")
def signal_funnel(spark, sf):
    return P.signal_funnel(samples(spark, sf), ["series"])


TRADES = LEDGER + """, tr AS (SELECT *, CASE WHEN side = 'yes' THEN payout ELSE 1 - payout END AS y, CASE WHEN side = 'yes' THEN ask ELSE 1 - ask + 0.02::DOUBLE END AS a2, CASE WHEN side = 'yes' THEN mid ELSE 1 - mid END AS m2 FROM ledger)"""


def trades(spark, sf):
    """Ledger rows in YES terms: a NO fill at price x was a quote with bid 1 - x."""
    led = ledger(spark, sf)
    yes = F.col("side") == "yes"
    x = F.col("ask")
    return led.withColumns({
        "y": F.when(yes, F.col("payout")).otherwise(1 - F.col("payout")), "bid": F.when(yes, x - 0.02).otherwise(F.lit(1.0) - x),
        "mid": F.when(yes, F.col("mid")).otherwise(F.lit(1.0) - F.col("mid")), "ask": F.when(yes, x).otherwise(F.lit(1.0) - x + 0.02)})


@query("trade_attribution", f"""
WITH {LEDGER}, c AS (SELECT *, quantity * (payout - mid) AS gross, quantity * (ask - mid) AS sc, quantity * (least(1.0::DOUBLE, ask + 0.02::DOUBLE) - ask) AS sl FROM ledger)
SELECT series, CASE WHEN cents < 10 THEN '0-0.1' WHEN cents < 30 THEN '0.1-0.3' WHEN cents < 70 THEN '0.3-0.7' ELSE '0.7-1' END AS bucket, count(*) AS entries, CAST(sum(quantity) AS BIGINT) AS quantity, {R('sum(gross)', 3)} AS gross, {R('sum(sc)', 3)} AS spread_cost, {R('sum(sl)', 3)} AS slippage_cost, {R('sum(fees)', 3)} AS fees, {R('sum(pnl)', 3)} AS pnl,
 {R('sum(payout - cost / quantity)', 3)} AS equal_contract_net, count(*) FILTER (WHERE abs(gross - sc - sl - fees - pnl) > 1e-6) AS unreconciled FROM c GROUP BY 1, 2""")
def trade_attribution(spark, sf):
    # Prices are rebuilt from 1 - (1 - x); rounding to the tick keeps bucket edges exact.
    t = trades(spark, sf).withColumns({"bid": rounded(F.col("bid"), 4), "mid": rounded(F.col("mid"), 4), "ask": rounded(F.col("ask"), 4)})
    a = P.trade_attribution(t).withColumn("price", rounded(F.col("price"), 4))
    out = P.attribution_summary(a, ["series"])
    return out.withColumns({c: rounded(F.col(c), 3) for c in ("gross", "spread_cost", "slippage_cost", "fees", "pnl", "equal_contract_net")})


@query("fixed_cohort_reprice", f"""
WITH {LEDGER}, g AS (SELECT payout, quantity, slip, {debit_sql("least(1.0::DOUBLE, ask + CAST(slip AS DOUBLE))", "quantity")} AS c FROM ledger, (VALUES ('0.00'), ('0.005'), ('0.01'), ('0.02'), ('0.05')) v(slip))
SELECT slip AS slippage, count(*) AS entries, CAST(sum(quantity) AS BIGINT) AS contracts, {R('sum(c)', 2)} AS capital, {R('sum(payout * quantity - c)', 2)} AS pnl, {R('sum(payout * quantity - c) / sum(quantity)')} AS net_per_contract FROM g GROUP BY 1""")
def fixed_cohort_reprice(spark, sf):
    t = trades(spark, sf).withColumns({"bid": rounded(F.col("bid"), 4), "ask": rounded(F.col("ask"), 4)})
    out = P.fixed_cohort_reprice(t, ["0.00", "0.005", "0.01", "0.02", "0.05"])
    return out.withColumns({"capital": rounded(F.col("capital"), 2), "pnl": rounded(F.col("pnl"), 2), "net_per_contract": rounded(F.col("net_per_contract"))})


@query("fee_precision", f"""
WITH {LEDGER}, p AS (SELECT cents + 2 AS c, quantity AS q FROM ledger), f AS (SELECT c, q, c * q * 10000 + 7 * q * c * (100 - c) AS total, c * q * 10000 AS gross FROM p)
SELECT count(*) AS entries, {R('sum((total + 9999) // 10000 * 10000 - gross) / 1e6::DOUBLE', 4)} AS fees_cent, {R('sum((total + 99) // 100 * 100 - gross) / 1e6::DOUBLE', 4)} AS fees_fine, {R('(sum((total + 9999) // 10000 * 10000 - gross) - sum((total + 99) // 100 * 100 - gross)) / 1e6::DOUBLE', 4)} AS saving FROM f""")
def fee_precision(spark, sf):
    from tidemark.functions.money import slipped

    out = P.fee_precision(ledger(spark, sf), slipped(F.col("ask"), 0.02), F.col("quantity"))
    return out.select("entries", *[rounded(F.col(c), 4).alias(c) for c in ("fees_cent", "fees_fine", "saving")])


@query("opportunity_pnl", f"""
WITH {SAMPLES}, {SIDES} SELECT series, count(*) AS opportunities, {R('avg(edge)')} AS claimed, {R('sum(pnl)', 3)} AS pnl, {R('avg(pnl)')} AS pnl_per_contract FROM op WHERE edge9 >= 0.04 GROUP BY 1""")
def opportunity_pnl(spark, sf):
    out = P.opportunity_pnl(samples(spark, sf), ["series"])
    return out.select("series", "opportunities", rounded(F.col("claimed")).alias("claimed"), rounded(F.col("pnl"), 3).alias("pnl"), rounded(F.col("pnl_per_contract")).alias("pnl_per_contract"))


@query("promotion_gate", f"""
WITH {MODELS}, {SIDES}, f AS (SELECT day % 4 AS fold, model, avg(pow({CLIP('f', 1e-6, 1 - 1e-6)} - y, 2)) AS b, avg({LOGLOSS('f', 'y')}) AS l FROM mo GROUP BY 1, 2), a AS (SELECT model, avg(pow({CLIP('f', 1e-6, 1 - 1e-6)} - y, 2)) AS b, avg({LOGLOSS('f', 'y')}) AS l FROM mo GROUP BY 1),
w AS (SELECT count(*) FILTER (WHERE m.b < k.b AND m.l < k.l) AS fold_wins FROM f m JOIN f k ON k.fold = m.fold AND k.model = 'market' WHERE m.model = 'model'), pb AS (SELECT m.b < k.b AND m.l < k.l AS pooled_beats FROM a m, a k WHERE m.model = 'model' AND k.model = 'market'),
t AS (SELECT count(*) AS entries, count(DISTINCT day) AS dt, sum(pnl) AS pnl FROM op WHERE edge9 >= 0.04)
SELECT fold_wins, fold_wins >= 3 AS folds_beat, pooled_beats, pnl > 0 AS positive_net, entries >= 30 AS enough_trades, dt >= 10 AS enough_days,
 concat_ws(',', CASE WHEN fold_wins < 3 THEN 'folds_beat' END, CASE WHEN NOT pooled_beats THEN 'pooled_beats' END, CASE WHEN pnl <= 0 THEN 'positive_net' END, CASE WHEN entries < 30 THEN 'enough_trades' END, CASE WHEN dt < 10 THEN 'enough_days' END) AS failed,
 fold_wins >= 3 AND pooled_beats AND pnl > 0 AND entries >= 30 AND dt >= 10 AS passed FROM w, pb, t""")
def promotion_gate(spark, sf):
    from tidemark.functions.money import qualify_signal

    m = _models(spark, sf).withColumn("fold", F.col("day") % 4)
    folds, pooled = A.binary_metrics(m, ["fold", "model"], "f", "y", "day"), A.binary_metrics(m, ["model"], "f", "y", "day")
    s = evaluated_once(samples(spark, sf), _s=qualify_signal(F.col("q"), F.col("bid"), F.col("ask"))).filter("_s IS NOT NULL")
    s = s.withColumn("pnl", A.one_contract_pnl(F.col("_s.side"), F.col("y"), F.col("bid"), F.col("ask")))
    trades_ = s.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("day").alias("days_traded"), F.sum("pnl").alias("pnl"))
    return P.promotion_gate(folds, pooled, trades_, "model", ["market"])
