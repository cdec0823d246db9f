"""Queries for the larger composite studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.contracts import OPENING_RULE
from tidemark.functions.numeric import rounded
from tidemark.operators import windows as X
from tidemark.plans import studies as ST
from tidemark.plans.q_scores import trades
from tidemark.plans.q_windows import market_bars
from tidemark.plans.registry import query
from tidemark.plans.standins import DAY, R, S, SAMPLES, TICKS, debit_sql, samples, ticks

H = 3600 * S
CUT_A, CUT_B = 19735 * 86400, 19741 * 86400

# Hourly stand-in of the minute study: one contract per series and sixth hour, quotes from the hour's last tick.
CONTRACT_SQL = f"""{TICKS}, q0 AS (SELECT event_type, t // 3600000000 * 3600 + 3600 AS ts, arg_max(k, (t, event_id)) AS k FROM ticks GROUP BY 1, 2),
q AS (SELECT *, greatest(k - 1, 0) / 100.0::DOUBLE AS bid, least(k + 1, 100) / 100.0::DOUBLE AS ask, lag(k) OVER w AS pk, lag(ts) OVER w AS pt FROM q0 WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
b AS (SELECT t // 3600000000 * 3600 AS bar, arg_max(value, (t, event_id)) AS close FROM ticks GROUP BY 1),
c AS (SELECT event_type, ts AS cl, ts - 18000 AS "at" FROM q0 WHERE ts % 21600 = 0),
j AS (SELECT c.*, q.ts, q.k, q.bid, q.ask, q.pk, q.pt FROM c ASOF LEFT JOIN q ON c.event_type = q.event_type AND c."at" >= q.ts + 5),
ns AS (SELECT j.*, n.bid AS nb, n.ask AS na, CASE WHEN n.bid IS NOT NULL AND j.ts + 3605 < j.cl THEN j.ts + 3605 END AS ex FROM j LEFT JOIN q n ON n.event_type = j.event_type AND n.ts = j.ts + 3600),
r AS (SELECT ns.*, d.close AS spot,
  CASE WHEN ns.ts IS NULL THEN 'no_quote' WHEN ns."at" - ns.ts > 7200 THEN 'stale_quote' WHEN NOT (ns.bid > 0 AND ns.ask < 1) THEN 'no_two_sided_price' WHEN d.close IS NULL OR (ex IS NOT NULL AND e.close IS NULL) THEN 'missing_lookback' END AS reason
  FROM ns LEFT JOIN b d ON d.bar = (ns."at" - 5) // 3600 * 3600 - 3600 LEFT JOIN b e ON e.bar = (ns.ex - 5) // 3600 * 3600 - 3600)"""


def contract_rows(spark, sf):
    t = ticks(spark, sf)
    q = t.groupBy("event_type", (F.floor(F.col("t") / H) * 3600 + 3600).cast("long").alias("end_ts")).agg(F.max_by("k", F.struct("t", "event_id")).alias("k"))
    candles = q.select(F.col("event_type").alias("ticker"), "end_ts", (F.greatest(F.col("k") - 1, F.lit(0)) / 100.0).alias("bid"), (F.least(F.col("k") + 1, F.lit(100)) / 100.0).alias("ask"))
    close = F.timestamp_seconds("close_s")
    contracts = candles.filter("end_ts % 21600 = 0").select("ticker", F.col("end_ts").alias("close_s")).select(
        "*", (F.col("close_s") - 86400).alias("open_s"), F.lit(f"{OPENING_RULE}close is at least 5, then the market resolves to Yes.").alias("rules_primary"), F.lit("5").alias("floor_strike"), F.lit("greater_or_equal").alias("strike_type"),
        F.lit("yes").alias("result"), F.lit("settled").alias("status"), F.lit("").alias("expiration_value"), F.lit("1").alias("notional_value_dollars"), F.timestamp_seconds(F.col("close_s") - 900).alias("open_time"), close.alias("close_time"), close.alias("settlement_ts"), F.lit("1").alias("settlement_value_dollars"))
    spot = X.ohlcv(t, [], "t", "value", F.lit(1.0), H, tie="event_id").select((F.col("bar") / S).cast("long").alias("bar"), F.col("close").alias("price"))
    return ST.bar_contract_rows(contracts, candles, spot, before_close=18000, step=3600, allowance=5, max_age=7200)


@query("bar_contract_rows", f"""
WITH {CONTRACT_SQL}
SELECT event_type, cl AS close_s, {R('(bid + ask) / 2.0::DOUBLE')} AS p, {R('(bid + ask) / 2.0::DOUBLE - CASE WHEN pt IS NOT NULL THEN (greatest(pk - 1, 0) + least(pk + 1, 100)) / 200.0::DOUBLE ELSE (bid + ask) / 2.0::DOUBLE END')} AS prior_move, ex AS execution_at, CASE WHEN ex IS NOT NULL THEN na END AS execution_ask, spot FROM r WHERE reason IS NULL""")
def bar_contract_rows(spark, sf):
    rows, _ = contract_rows(spark, sf)
    return rows.select(F.col("ticker").alias("event_type"), "close_s", rounded(F.col("p")).alias("p"), rounded(F.col("prior_move")).alias("prior_move"), "execution_at",
                       F.when(F.col("execution_at").isNotNull(), F.col("execution_ask")).alias("execution_ask"), F.col("spot.price").alias("spot"))


@query("contract_exclusions", f"""
WITH {CONTRACT_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def contract_exclusions(spark, sf):
    return contract_rows(spark, sf)[1]


@query("flow_cohort", f"""
WITH {CONTRACT_SQL}, vb AS (SELECT t // 3600000000 * 3600 AS bar, CAST(sum(k) AS DOUBLE) AS volume, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN k ELSE 0 END)::DOUBLE AS buy FROM ticks GROUP BY 1),
f AS (SELECT bar, CASE WHEN bar - lag(bar, 4) OVER o = 14400 THEN 2 * sum(buy) OVER (ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / sum(volume) OVER (ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - 1 END AS i5,
  CASE WHEN bar - lag(bar, 14) OVER o = 50400 THEN 2 * sum(buy) OVER (ORDER BY bar ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) / sum(volume) OVER (ORDER BY bar ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) - 1 END AS i15 FROM vb WINDOW o AS (ORDER BY bar)),
x AS (SELECT r.*, (ex - 5) // 3600 * 3600 - 3600 AS fb, (ex - 3605) // 3600 * 3600 - 3600 AS lb FROM r WHERE reason IS NULL AND ex IS NOT NULL),
y AS (SELECT CASE WHEN cl < {CUT_A} THEN 'train' WHEN cl < {CUT_B} THEN 'validation' ELSE 'holdout' END AS role, CASE WHEN f.i5 IS NULL OR f.i15 IS NULL THEN 'missing_flow_window' WHEN cl >= {CUT_B} AND ex < {CUT_B + 7200} THEN 'embargo' WHEN cl >= {CUT_A} AND cl < {CUT_B} AND ex < {CUT_A + 7200} THEN 'embargo' ELSE 'kept' END AS reason, f.i5, g.i5 AS l5
  FROM x LEFT JOIN f ON f.bar = x.fb LEFT JOIN f g ON g.bar = x.lb)
SELECT role, reason, count(*) AS n, {R('sum(i5)', 5)} AS flow, {R('sum(l5)', 5)} AS lag_flow FROM y GROUP BY 1, 2""")
def flow_cohort(spark, sf):
    rows, _ = contract_rows(spark, sf)
    flow = X.imbalance(market_bars(spark, sf), [], "bar", H, [5, 15], width=7 * DAY)
    flow = flow.select((F.col("bar") / S).cast("long").alias("bar"), "imbalance_5", "imbalance_15", F.lit(0.0).alias("basis_bps"), F.lit(0.0).alias("change_bps"))
    out = ST.flow_cohort(rows, flow, (CUT_A, CUT_B), step=3600, lag=3600)
    return out.groupBy("role", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("imbalance_5"), 5).alias("flow"), rounded(F.sum("lag_imbalance_5"), 5).alias("lag_flow"))


def _slots(t):
    """Three-hour forecast values per station and provider, spread over their hours."""
    provider = F.when(F.col("event_type").isin("click", "view"), "gfs").otherwise("ecmwf")
    h = t.groupBy((F.col("user_id") % 4).alias("st"), provider.alias("provider"), F.floor(F.col("t") / (3 * H)).cast("long").alias("slot")).agg(F.max("k").cast("double").alias("v"))
    return h.withColumn("hour", F.explode(F.sequence(F.col("slot") * 3, F.col("slot") * 3 + 2)))


@query("weather_samples", f"""
WITH {TICKS}, h AS (SELECT user_id % 4 AS st, CASE WHEN event_type IN ('click', 'view') THEN 'gfs' ELSE 'ecmwf' END AS pv, t // 10800000000 AS sl, max(k) AS v FROM ticks GROUP BY ALL),
d AS (SELECT st, pv, sl // 8 AS day, max(v) AS m FROM h GROUP BY ALL HAVING count(*) = 8), w AS (SELECT st, day, max(m) FILTER (WHERE pv = 'gfs') AS g, max(m) FILTER (WHERE pv = 'ecmwf') AS e FROM d GROUP BY 1, 2 HAVING count(*) = 2),
s AS (SELECT event_id, user_id % 4 AS st, t, k, t // 86400000000 + k % 2 AS day FROM ticks WHERE event_type = 'error'),
j AS (SELECT s.event_id, lead, g + lead AS g, e + lead AS e FROM s JOIN w USING (st, day), (VALUES (1), (2)) v(lead) WHERE k % 25 <> 0 AND day * 86400000000 + (23 - lead * 24 + 6) * 3600000000 <= t)
SELECT event_id, CAST(min(lead) AS INTEGER) AS lead, CAST(arg_min(g, lead) AS DOUBLE) AS gfs, CAST(arg_min(e, lead) AS DOUBLE) AS ecmwf FROM j GROUP BY 1""")
def weather_samples(spark, sf):
    t = ticks(spark, sf)
    leads = _slots(t).withColumn("lead", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.col("st").alias("series"), "provider", "lead", (F.col("hour") * H).alias("valid_at"), (F.col("v") + F.col("lead")).alias("value"))
    e = t.filter("event_type = 'error'")
    s = e.select(F.col("event_id").alias("ticker"), (F.col("user_id") % 4).alias("series"), F.col("t").alias("at"), F.date_from_unix_date((F.floor(F.col("t") / DAY) + F.col("k") % 2).cast("int")).alias("event_day"))
    bounds = e.select(F.col("event_id").alias("ticker"), F.when(F.col("k") % 25 != 0, F.col("k") * 1.0).alias("lower"), F.lit(None).cast("double").alias("upper"))
    rows, _ = ST.weather_samples(s, bounds, leads, offset_hours=0)
    return rows.select(F.col("ticker").alias("event_id"), "lead", "gfs", "ecmwf")


def _observed_sql(delay: int) -> str:
    return f"""SELECT d.event_id, max(greatest(o.value, CASE WHEN o.k % 4 = 0 AND o.t - 21600000000 >= d.ds THEN o.value + o.k END)) AS mx, max(o.t) AS lt FROM dec d JOIN ob o ON o.st = d.st AND o.t >= d.ds AND o.t <= d.t - {delay} AND o.t < d.ds + 86400000000 GROUP BY 1"""


OBSERVED = f"""{TICKS}, dec AS (SELECT event_id, user_id % 20 AS st, t, k, t // 86400000000 * 86400000000 AS ds FROM ticks WHERE event_type = 'error'), ob AS (SELECT user_id % 20 AS st, t, value, k FROM ticks WHERE event_type <> 'error')"""


def _obs(t):
    return t.filter("event_type <> 'error'").select((F.col("user_id") % 20).alias("station"), "t", F.col("value").alias("temperature"), F.when(F.col("k") % 4 == 0, F.col("value") + F.col("k")).alias("max_6h"))


@query("station_join", f"""
WITH {OBSERVED}, a AS ({_observed_sql(1800 * S)}), b AS ({_observed_sql(5400 * S)}), u AS (SELECT 30 AS delay_minutes, dec.event_id, t, mx, lt FROM dec LEFT JOIN a USING (event_id) UNION ALL SELECT 90, dec.event_id, t, mx, lt FROM dec LEFT JOIN b USING (event_id))
SELECT delay_minutes, CASE WHEN mx IS NULL THEN 'no_observation' WHEN t - lt > 10800000000 THEN 'stale_observation' ELSE 'kept' END AS reason, count(*) AS n, {R('sum(mx)', 2)} AS total FROM u GROUP BY 1, 2""")
def station_join(spark, sf):
    t = ticks(spark, sf)
    d = t.filter("event_type = 'error'").select("event_id", (F.col("user_id") % 20).alias("station"), F.col("t").alias("at"), (F.floor(F.col("t") / DAY) * DAY).cast("long").alias("day_start"))
    out = ST.station_join(d, _obs(t))
    return out.groupBy("delay_minutes", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("observed_max"), 2).alias("total"))


@query("archive_join", f"""
WITH {OBSERVED}, a AS ({_observed_sql(1800 * S)}), h AS (SELECT user_id % 20 AS st, t // 86400000000 * 86400000000 AS init, CASE WHEN event_type IN ('click', 'view') THEN 'gfs' ELSE 'ecmwf' END AS model, max(k) AS v FROM ticks GROUP BY ALL),
r AS (SELECT st, init FROM h GROUP BY 1, 2 HAVING count(*) = 2),
dd AS (SELECT t // 86400000000 AS day, min(t) AS fa, max(t) + 21600000000 AS ls, row_number() OVER (ORDER BY t // 86400000000) - 1 AS i, count(*) OVER () AS n FROM dec GROUP BY 1),
p AS (SELECT *, CASE WHEN i >= floor(n * 0.8) THEN 'test' WHEN i >= floor(n * 0.6) THEN 'validation' ELSE 'train' END AS part FROM dd), tc AS (SELECT min(fa) - {24 * H} AS cut FROM p WHERE part = 'test'),
vd AS (SELECT p.* FROM p, tc WHERE part = 'validation' AND ls < cut), vc AS (SELECT min(fa) - {24 * H} AS cut FROM vd),
ro AS (SELECT p.day, CASE WHEN part = 'test' THEN 'test' WHEN p.day IN (SELECT day FROM vd) THEN 'validation' WHEN part = 'train' AND p.ls < vc.cut THEN 'train' ELSE 'purged' END AS role FROM p, vc)
SELECT role, CASE WHEN NOT EXISTS (SELECT 1 FROM r WHERE r.st = dec.st AND r.init = dec.ds - 86400000000) THEN 'no_complete_run' WHEN mx IS NULL THEN 'no_observation' WHEN dec.t - lt > 10800000000 THEN 'stale_observation' ELSE 'kept' END AS reason, count(*) AS n
FROM dec JOIN ro ON ro.day = dec.t // 86400000000 LEFT JOIN a USING (event_id) GROUP BY 1, 2""")
def archive_join(spark, sf):
    t = ticks(spark, sf)
    d = t.filter("event_type = 'error'").select(
        F.col("event_id").alias("ticker"), (F.col("user_id") % 20).alias("station"), F.col("t").alias("at"), (F.col("t") + 6 * H).alias("settled_t"), (F.floor(F.col("t") / DAY) * DAY).cast("long").alias("day_start"), F.floor(F.col("t") / DAY).cast("long").alias("day"))
    provider = F.when(F.col("event_type").isin("click", "view"), "gfs").otherwise("ecmwf")
    h = t.groupBy((F.col("user_id") % 20).alias("station"), (F.floor(F.col("t") / DAY) * DAY).cast("long").alias("initialized"), provider.alias("model")).agg(F.max("k").cast("double").alias("value"))
    # A run covers the 24 hours of the day after it was initialised.
    hours = h.withColumn("valid_at", F.explode(F.sequence(F.col("initialized") + DAY, F.col("initialized") + DAY + 23 * H, F.lit(H))))
    _, counts = ST.archive_join(d, hours, _obs(t), embargo=24 * H)
    return counts


@query("loss_diagnosis", f"""
WITH {SAMPLES}, sd AS (SELECT *, {debit_sql('ask', '1')} AS yc, {debit_sql('1 - bid', '1')} AS nc FROM samples), e AS (SELECT *, {R('greatest(q - yc, 1 - q - nc)', 9)} AS edge FROM sd)
SELECT count(*) AS signals, {R('avg(edge)')} AS mean_edge FROM e WHERE edge >= 0.04""")
def loss_diagnosis(spark, sf):
    s = samples(spark, sf)
    t = trades(spark, sf).withColumns({"bid": rounded(F.col("bid"), 4), "mid": rounded(F.col("mid"), 4), "ask": rounded(F.col("ask"), 4)})
    out = ST.loss_diagnosis(s, t, ["p", "q", "spread"], F.col("day") < 19738)
    return out["signals"].agg(F.count(F.lit(1)).alias("signals"), rounded(F.avg("edge")).alias("mean_edge"))
