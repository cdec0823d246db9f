"""Queries for whole audits: loss diagnosis, files against manifests, candle files, second bars, later quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import pnl as P
from tidemark.operators import quality as Q
from tidemark.operators import resample as B
from tidemark.operators import temporal as J
from tidemark.plans import studies as ST
from tidemark.plans.oracle_text import LOGLOSS
from tidemark.plans.q_resample import _boot_sql
from tidemark.plans.q_scores import SIDES, trades
from tidemark.plans.registry import query
from tidemark.plans.standins import DAY, LEDGER, R, S, SAMPLES, TICKS, debit_sql, samples, table, ticks
from tidemark.session import new_folder
from tidemark.sources import bars as SB
from tidemark.sources import market as SM
from tidemark.sources import sinks as K

H = 3600 * S
SLIPPAGES = ["0", "0.005", "0.01", "0.02", "0.05"]
SHIFTED = ["p", "q", "spread"]


@query("loss_diagnosis_report", f"""
WITH {SAMPLES}, {SIDES}, {LEDGER},
at_ AS (SELECT CASE WHEN cents < 10 THEN '0-0.1' WHEN cents < 30 THEN '0.1-0.3' WHEN cents < 70 THEN '0.3-0.7' ELSE '0.7-1' END AS item, count(*) AS n, {R('sum(pnl)', 2)} AS value FROM ledger GROUP BY 1),
eb AS (SELECT CASE WHEN edge9 < 0 THEN 'negative' WHEN edge9 < 0.02 THEN '0-2 cents' WHEN edge9 < 0.04 THEN '2-4 cents' WHEN edge9 < 0.08 THEN '4-8 cents' ELSE '8+ cents' END AS item, count(*) AS n, {R('avg(pnl)')} AS value FROM op GROUP BY 1),
rp AS (SELECT slip AS item, count(*) AS n, {R('sum(payout * quantity - ' + debit_sql('least(1.0::DOUBLE, ask + CAST(slip AS DOUBLE))', 'quantity') + ')', 2)} AS value FROM ledger, (VALUES {', '.join(f"('{s}')" for s in SLIPPAGES)}) v(slip) GROUP BY 1),
sc AS (SELECT model AS item, count(*) AS n, {R('avg(' + LOGLOSS('f', 'y') + ')')} AS value FROM (SELECT 'market' AS model, p AS f, y FROM samples UNION ALL SELECT 'model', q, y FROM samples) GROUP BY 1),
lo AS (SELECT day < 19738 AS tr, unnest(['p', 'q', 'spread']) AS item, unnest([p, q, spread]) AS v FROM samples), dr AS (SELECT item, CAST(NULL AS BIGINT) AS n, {R('(avg(v) FILTER (WHERE NOT tr) - avg(v) FILTER (WHERE tr)) / greatest(1e-6, stddev_pop(v) FILTER (WHERE tr))')} AS value FROM lo GROUP BY 1),
ti AS (SELECT 'to_close' AS item, count(*) AS n, CAST(count(DISTINCT close_t - "at") AS DOUBLE) AS value FROM samples),
hb AS (SELECT t // 3600000000 AS hr, min(value) AS low, max(value) AS high, arg_max(value, (t, event_id)) AS close FROM ticks GROUP BY 1), hr AS (SELECT event_type, t // 3600000000 AS hr, value + 0.01::DOUBLE AS strike, CAST(k >= 50 AS INTEGER) AS y FROM ticks),
so AS (SELECT event_type AS item, count(*) AS n, CAST(count(*) FILTER (WHERE (y = 0 AND f.low >= strike) OR (y = 1 AND f.high < strike)) AS DOUBLE) AS value FROM hr JOIN hb f ON f.hr = hr.hr JOIN hb o ON o.hr = hr.hr - 1 GROUP BY 1)
SELECT 'attribution' AS part, * FROM at_ UNION ALL SELECT 'edges', * FROM eb UNION ALL SELECT 'repriced', * FROM rp UNION ALL SELECT 'scores', * FROM sc UNION ALL SELECT 'drift', * FROM dr UNION ALL SELECT 'timing', * FROM ti UNION ALL SELECT 'source', * FROM so""")
def loss_diagnosis_report(spark, sf):
    """Every part of the diagnosis of one policy as (part, item, n, value)."""
    s = samples(spark, sf)
    fills = trades(spark, sf).withColumns({c: rounded(F.col(c), 4) for c in ("bid", "mid", "ask")})
    t = ticks(spark, sf).withColumn("hr", F.floor(F.col("t") / H).cast("long"))
    bar = t.groupBy("hr").agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", F.struct("t", "event_id")).alias("close")).alias("final"))
    proxy = t.select(F.col("event_type").alias("series"), "hr", (F.col("value") + 0.01).alias("strike"), (F.col("k") >= 50).cast("int").alias("y"))
    proxy = proxy.join(bar, "hr").join(bar.select((F.col("hr") + 1).alias("hr"), F.col("final").alias("opening")), "hr")
    out = ST.loss_diagnosis(s, fills, SHIFTED, F.col("day") < 19738, proxy)
    none = F.lit(None).cast("long")
    parts = [
        ("attribution", "bucket", F.col("entries"), rounded(F.col("pnl"), 2)), ("edges", "bucket", F.col("rows"), rounded(F.col("realized"))), ("repriced", "slippage", F.col("entries"), rounded(F.col("pnl"), 2)),
        ("scores", "model", F.col("events"), rounded(F.col("log_loss"))), ("drift", "feature", none, rounded(F.col("shift_sd"))), ("source", "series", F.col("matched"), F.col("whole_range_opposes").cast("double")),
    ]
    frames = [out[p].select(F.lit(p).alias("part"), F.col(i).alias("item"), n.alias("n"), v.alias("value")) for p, i, n, v in parts]
    frames.append(out["timing"].groupBy(F.lit("timing").alias("part"), F.col("kind").alias("item")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("value")))
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    return both


@query("validate_sources", f"""
WITH {SAMPLES}, v AS (SELECT CASE WHEN k % 8 = 0 THEN 'imported' WHEN k % 9 = 0 THEN NULL ELSE 'hourly_candle' END AS src, CASE WHEN k % 11 = 0 THEN true WHEN k % 13 = 0 THEN NULL ELSE false END AS syn FROM samples)
SELECT coalesce(src = 'hourly_candle' AND NOT syn, false) AS accepted, count(*) AS n FROM v GROUP BY 1""")
def validate_sources(spark, sf):
    k = F.col("k")
    d = samples(spark, sf).withColumns({
        "source": F.when(k % 8 == 0, "imported").when(k % 9 != 0, "hourly_candle"), "synthetic": F.when(k % 11 == 0, True).when(k % 13 != 0, False), "feature_time": F.col("at"), "ticker": F.col("event_id")})
    t = Q.tag_samples(d, origin="hourly_candle")
    return t.groupBy((~F.array_contains("violations", "source")).alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


SHARD = 32
SHARDS_SQL = f"SELECT page_id // {SHARD} AS shard, CAST(sum(octet_length(encode(coalesce(html, ''))) + 1) AS BIGINT) AS bytes, sha256(string_agg(coalesce(html, ''), chr(10) ORDER BY page_id) || chr(10)) AS sha256 FROM pages GROUP BY 1"


def _page_files(spark, sf):
    """Pages as text files of 32 each, and the manifest of those files."""
    folder = new_folder(spark, "page-files")
    p = table(spark, sf, "pages").select((F.floor(F.col("page_id") / SHARD)).cast("long").alias("shard"), "page_id", F.coalesce("html", F.lit("")).alias("value"))
    p.repartition("shard").sortWithinPartitions("shard", "page_id").select("shard", "value").write.partitionBy("shard").text(folder)
    return K.file_manifest(spark, folder, "*.txt", name=F.regexp_extract("path", r"shard=(\d+)/", 1))


@query("file_manifest", SHARDS_SQL)
def file_manifest(spark, sf):
    return _page_files(spark, sf).select(F.col("name").cast("long").alias("shard"), "bytes", "sha256")


@query("data_audit_files", f"""
WITH s AS (SELECT DISTINCT page_id // {SHARD} AS shard FROM pages) SELECT shard, CASE shard % 3 WHEN 0 THEN 'unexpected' ELSE 'different' END AS reason FROM s WHERE shard % 3 < 2""")
def data_audit_files(spark, sf):
    """The audit of a dataset whose manifest lacks every third file and states another size for the next."""
    found = _page_files(spark, sf)
    third = F.col("name").cast("long") % 3
    expected = found.filter(third != 0).withColumn("bytes", F.col("bytes") + F.when(third == 1, 1).otherwise(0))
    s = samples(spark, sf).withColumn("ticker", F.col("event_id")).withColumn("feature_time", F.col("at"))
    return ST.data_audit(s, found, expected, 24 * H)["files"].select(F.col("name").cast("long").alias("shard"), "reason")


@query("quote_candle_files", f"""
WITH {TICKS} SELECT event_type AS ticker, t // 1000000 AS end_ts, CASE WHEN k <= 95 THEN k / 100.0::DOUBLE END AS bid, CASE WHEN k <= 95 THEN (k + 2) / 100.0::DOUBLE END AS ask FROM ticks""")
def quote_candle_files(spark, sf):
    """Pages of at most 50 candles written as text and read back; crossed quotes are left empty."""
    dollars = lambda c: F.struct((c / 100).cast("decimal(6,4)").cast("string").alias("close_dollars"))
    t = ticks(spark, sf).select("event_type", (F.floor(F.col("event_id") / 50)).alias("page"), F.struct(
        F.floor(F.col("t") / S).cast("long").alias("end_period_ts"), dollars(F.col("k")).alias("yes_bid"), dollars(F.when(F.col("k") <= 95, F.col("k") + 2).otherwise(F.col("k") - 2)).alias("yes_ask")).alias("c"))
    market = F.struct(F.col("event_type").alias("market_ticker"), F.col("candlesticks"))
    pages = t.groupBy("page", "event_type").agg(F.collect_list("c").alias("candlesticks"))  # at most 50 rows a page
    folder = new_folder(spark, "candle-pages")
    pages.select(F.to_json(F.struct(F.array(market).alias("markets"))).alias("value")).write.text(folder)
    return SM.read_quote_candles(spark, folder).select("ticker", "end_ts", "bid", "ask")


@query("second_kline_days", f"""
WITH {TICKS}, d AS (SELECT DISTINCT t // 86400000000 AS day, t // 1000000 AS s FROM ticks WHERE t // 86400000000 % 10 <> 0 AND k % 13 <> 5 UNION ALL SELECT day, day * 86400 + i FROM (SELECT DISTINCT t // 86400000000 AS day FROM ticks WHERE t // 86400000000 % 10 = 0), range(86400) r(i))
SELECT strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS period, count(*) AS rows, min(s) AS "first", max(s) AS "last", count(*) = 86400 AND max(s) - min(s) = 86399 AS complete FROM d GROUP BY 1""")
def second_kline_days(spark, sf):
    """One-second bars in files of one day: every tenth day is whole, others have a bar only where a tick is."""
    t = ticks(spark, sf).withColumns({"day": F.floor(F.col("t") / DAY).cast("long"), "s": F.floor(F.col("t") / S).cast("long")})
    some = t.filter((F.col("day") % 10 != 0) & (F.col("k") % 13 != 5)).select("day", "s").distinct()
    whole = t.filter("day % 10 = 0").select("day").distinct().repartition("day").select("day", F.explode(F.sequence(F.col("day") * 86400, F.col("day") * 86400 + 86399)).alias("s"))
    late = t.filter((F.col("day") % 10 != 0) & (F.col("k") % 13 == 5)).join(some, ["day", "s"], "left_anti").select("day", "s").distinct()
    bars = some.unionByName(whole).withColumn("_end", F.lit(1)).unionByName(late.withColumn("_end", F.lit(2)))  # a bar that ends a second late is rejected
    value, unit = F.lit(50.0), F.when(F.col("s") % 2 == 0, F.lit(1000)).otherwise(F.lit(1_000_000))
    raw = bars.select(
        F.concat(F.lit("X-1s-"), F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd"), F.lit(".csv")).alias("file"), (F.col("s") * unit).alias("open_time"),
        value.alias("open"), value.alias("high"), value.alias("low"), value.alias("close"), F.lit(10.0).alias("volume"), ((F.col("s") + F.col("_end")) * unit - 1).alias("close_time"), F.lit(1).alias("trades"), F.lit(4.0).alias("taker_buy"))
    _, _, complete = SB.second_klines(raw)
    return complete.select("period", "rows", "first", "last", "complete")


@query("opportunity_later", f"""
WITH {SAMPLES}, {SIDES}, x AS (SELECT *, lead("at") OVER w AS xt, lead(bid) OVER w AS xb, lead(ask) OVER w AS xa FROM op WINDOW w AS (PARTITION BY user_id ORDER BY "at", event_id)),
z AS (SELECT *, CASE WHEN xt - "at" <= 86400000000 THEN CASE WHEN side = 'yes' THEN y - {debit_sql('xa', '1')} ELSE 1 - y - {debit_sql('1 - xb', '1')} END END AS later FROM x)
SELECT series, count(*) AS opportunities, count(DISTINCT day) AS days_traded, {R('avg(pnl)')} AS pnl_per_contract, count(later) AS later_rows, {R('avg(later)')} AS later_pnl_per_contract FROM z WHERE edge9 >= 0.04 GROUP BY 1""")
def opportunity_later(spark, sf):
    """Qualifying rows at their own quote and at the next quote within a day."""
    s = samples(spark, sf).select("event_id", "user_id", "series", "day", "at", "bid", "ask", "q", "y")
    nxt = s.select("user_id", F.col("at").alias("t"), F.col("event_id").alias("_e"), "bid", "ask")
    x = J.asof_forward(s, nxt, ["user_id"], "at", "t", max_gap=DAY, tie=["_e"]).withColumns({"later_bid": F.col("later.bid"), "later_ask": F.col("later.ask")})
    out = P.opportunity_pnl(x.drop("later"), ["series"], later=("later_bid", "later_ask"), day="day")
    return out.select("series", "opportunities", "days_traded", rounded(F.col("pnl_per_contract")).alias("pnl_per_contract"), "later_rows", rounded(F.col("later_pnl_per_contract")).alias("later_pnl_per_contract"))


@query("bootstrap_synchronized_month", f"""
WITH {_boot_sql("o0 AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS mth, o_totalprice / 1000.0::DOUBLE AS v FROM orders)", 'mth', '', {'s': 'sum(v)', 'q': 'sum(v * v)', 'm': 'count(*)'}, 1, 2000, 'o0')},
x AS (SELECT s / m AS mean, sqrt(greatest(0, (q - s * (s / m)) / (m - 1))) AS sd FROM rp)
SELECT {R('quantile_cont(mean, 0.025)', 5)} AS mean_low, {R('quantile_cont(mean, 0.975)', 5)} AS mean_high, {R('quantile_cont(sd, 0.025)', 5)} AS sd_low, {R('quantile_cont(sd, 0.975)', 5)} AS sd_high, {R('stddev_samp(sd)', 5)} AS sd_se FROM x""")
def bootstrap_synchronized_month(spark, sf):
    """Months drawn for all strata at once."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("st"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("mth"), (F.col("o_totalprice") / F.lit(1000.0)).alias("v"))
    out = B.stratified_bootstrap(o, "st", "mth", F.col("v"), synchronized=True)
    return out.select(*[rounded(F.col(c), 5).alias(c) for c in ("mean_low", "mean_high", "sd_low", "sd_high", "sd_se")])


@query("calibration_provenance", f"""
WITH {SAMPLES}, c AS (SELECT k, CASE WHEN k % 10 = 3 THEN user_id ELSE event_id END AS event, CASE WHEN k % 10 = 2 THEN 1.0::DOUBLE ELSE value END AS r, CASE WHEN k % 10 = 4 AND event_id % 5 = 0 THEN 'none' WHEN k % 10 <> 5 THEN sha256(CAST(event_id AS VARCHAR)) END AS h, CASE WHEN k % 10 <> 6 OR event_id % 7 <> 0 THEN settled_t END AS st FROM samples)
SELECT k, count(*) AS n, {R('avg(r)')} AS bias, max(st) AS latest_settled, CASE WHEN count(DISTINCT event) <> count(*) THEN 'repeated_event' WHEN count(*) < 80 THEN 'too_few_events' WHEN stddev_samp(r) <= 0 THEN 'invalid_scale'
 WHEN count(*) FILTER (WHERE h IS NULL OR h = 'none') > 0 THEN 'missing_source_hash' WHEN count(*) FILTER (WHERE st IS NULL) > 0 THEN 'missing_settlement' END AS reason FROM c GROUP BY 1""")
def calibration_provenance(spark, sf):
    """Calibrations of one group per price level, with each kind of fault in some of them."""
    m, e = F.col("k") % 10, F.col("event_id")
    pairs = samples(spark, sf).select(
        "k", F.when(m == 3, F.col("user_id")).otherwise(e).alias("event"), F.when(m == 2, 1.0).otherwise(F.col("value")).alias("r"),
        F.when((m == 4) & (e % 5 == 0), "none").when(m != 5, F.sha2(e.cast("string"), 256)).alias("hash"), F.when((m != 6) | (e % 7 != 0), F.col("settled_t")).alias("settled_t"))
    out = Q.validate_calibration(pairs, ["k"], F.col("r"), source_hash="hash", settled="settled_t")
    return out.select("k", "n", rounded(F.col("bias")).alias("bias"), "latest_settled", "reason")
