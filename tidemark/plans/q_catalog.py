"""Queries for sinks, catalogs, parsers over text columns, and the composite studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import temporal as J
from tidemark.operators import windows as X
from tidemark.plans import studies as ST
from tidemark.plans.oracle_text import CLIP, LOGLOSS, PHI
from tidemark.plans.q_quality import A, B_
from tidemark.plans.registry import query
from tidemark.plans.standins import DAY, LEDGER, R, S, SAMPLES, TICKS, ledger, micros, samples, table, ticks
from tidemark.session import new_folder
from tidemark.sources import bars as SB
from tidemark.sources import market as SM
from tidemark.sources import sinks as K
from tidemark.sources import weather as SW

H = 3600 * S


@query("append_dedup", """
SELECT 'first' AS step, count(*) AS added FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'error') UNION ALL SELECT 'second', count(*) FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type = 'error') UNION ALL SELECT 'stored', count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def append_dedup(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type")
    target = new_folder(spark, "append_dedup")
    first = K.append_dedup(e.filter("event_type <> 'error'"), target, "events")
    second = K.append_dedup(e, target, "events")
    stored = spark.read.parquet(target).agg(F.lit("stored").alias("step"), F.count(F.lit(1)).alias("added"))
    return stored.unionByName(spark.createDataFrame([("first", first), ("second", second)], "step string, added long"))


@query("upsert_last_write", f"""
WITH {TICKS} SELECT user_id, arg_max(value, (event_type <> 'error', t, event_id)) AS value FROM ticks GROUP BY 1""")
def upsert_last_write(spark, sf):
    t = ticks(spark, sf).select("user_id", "value", "t", "event_id", "event_type")
    root = new_folder(spark, "upsert")
    K.write_version(K.upsert(None, t.filter("event_type = 'error'"), ["user_id"], ["t", "event_id"]), root)
    K.write_version(K.upsert(K.read_latest(spark, root), t.filter("event_type <> 'error'"), ["user_id"], ["t", "event_id"]), root)
    return K.read_latest(spark, root).select("user_id", "value")


@query("partitioned_write", f"""
WITH {TICKS} SELECT CASE WHEN t < {A} THEN 'train' WHEN t < {B_} THEN 'validation' ELSE 'test' END AS role, count(*) AS n, {R('sum(value)', 2)} AS total FROM ticks GROUP BY 1""")
def partitioned_write(spark, sf):
    t = ticks(spark, sf).withColumn("role", F.when(F.col("t") < A, "train").when(F.col("t") < B_, "validation").otherwise("test"))
    path = new_folder(spark, "partitioned")
    K.write_partitions(t, path)
    return spark.read.parquet(path).groupBy("role").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total"))


@query("dataset_catalog", f"""
WITH {TICKS} SELECT event_type AS dataset, count(*) AS records, min(t) AS first, max(t) AS last FROM ticks GROUP BY 1""")
def dataset_catalog(spark, sf):
    return K.dataset_catalog(ticks(spark, sf).withColumnsRenamed({"event_type": "dataset", "t": "available_at"}))


@query("manifest_sha", """
SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages""")
def manifest_sha(spark, sf):
    """Each page is stored as a document of a text dataset; digest and size must survive the round trip."""
    path = new_folder(spark, "manifest")
    table(spark, sf, "pages").select("page_id", F.encode("html", "utf-8").alias("content")).write.parquet(path)
    d = spark.read.parquet(path)
    return d.select("page_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


@query("manifest_mismatch", """
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'missing' WHEN page_id % 10 = 1 THEN 'different' ELSE 'unexpected' END AS reason FROM pages WHERE page_id % 10 IN (0, 1, 2)""")
def manifest_mismatch(spark, sf):
    p = table(spark, sf, "pages").withColumn("m", F.col("page_id") % 10)
    row = lambda body: [F.col("page_id").cast("string").alias("name"), F.octet_length("html").cast("long").alias("bytes"), F.sha2(body, 256).alias("sha256")]
    found = p.filter("m <> 0").select(*row(F.col("html")))
    expected = p.filter("m <> 2").select(*row(F.when(F.col("m") == 1, F.concat(F.lit("x"), F.col("html"))).otherwise(F.col("html"))))
    return K.verify_manifest(found, expected).select(F.col("name").cast("long").alias("page_id"), "reason")


@query("experiment_catalog", """
SELECT o_orderkey AS id, o_orderpriority AS model, o_orderstatus AS status, o_totalprice AS test_log_loss FROM orders""")
def experiment_catalog(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("status"),
        F.struct(F.col("o_totalprice").alias("log_loss")).alias("test"))).alias("json"))
    return K.experiment_catalog(o).select("id", "model", "status", "test_log_loss")


@query("experiment_inventory", """
SELECT o_orderkey AS id, o_orderpriority AS cohort, unnest(['market', 'model']) AS model, unnest([o_totalprice, o_totalprice * 2]) AS log_loss FROM orders""")
def experiment_inventory(spark, sf):
    score = lambda x: F.struct(x.alias("log_loss"), F.lit(0.1).alias("brier"), F.lit(10).alias("events"))
    models = F.create_map(F.lit("market"), score(F.col("o_totalprice")), F.lit("model"), score(F.col("o_totalprice") * 2))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderpriority").alias("cohort"), models.alias("models"))).alias("json"))
    return K.experiment_inventory(o).select("id", "cohort", "model", "log_loss")


@query("data_fingerprint", """
WITH h AS (SELECT CAST('0x' || substr(md5(concat(length(o_orderkey::VARCHAR), ':', o_orderkey, length(o_custkey::VARCHAR), ':', o_custkey, length(o_orderstatus), ':', o_orderstatus, length(o_orderpriority), ':', o_orderpriority)), 1, 15) AS BIGINT) AS h FROM orders)
SELECT count(*) AS rows, CAST(sum(h) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM h""")
def data_fingerprint(spark, sf):
    return K.data_fingerprint(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


def _iso(us):
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def record_lines(spark, sf):
    """The tick stream as mixed-type JSON records, with broken lines mixed in."""
    t = ticks(spark, sf)
    k, iso, later = F.col("k"), _iso(F.col("t")), _iso(F.col("t") + H)
    none = F.lit(None).cast("string")
    lv = lambda p: F.array(F.array(p.cast("decimal(6,4)").cast("string"), F.lit("10")))
    is_ = lambda e: F.col("event_type") == e
    kind = F.when(is_("signup"), "market").when(is_("view"), "book").when(is_("click"), "prediction").when(is_("purchase"), "outcome").otherwise("mystery")
    rec = F.to_json(F.struct(
        kind.alias("type"), F.when(k != 7, F.concat(F.lit("T"), F.col("user_id").cast("string"))).alias("ticker"), F.when(k % 20 == 3, F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(iso).alias("available_at"),
        F.when(is_("signup"), F.lit("E1")).alias("event_ticker"), F.when(is_("signup"), later).alias("close_time"), F.when(is_("view"), F.when(k % 25 == 1, later).otherwise(iso)).alias("observed_at"),
        F.when(is_("view"), lv(k / 200)).alias("yes"), F.when(is_("view"), lv((130 - k) / 200)).alias("no"),
        F.when(is_("view") & (k % 9 == 0), F.struct(F.when(k % 2 == 0, F.lit(True)).alias("signal"), F.lit("m").alias("model_id"), iso.alias("made_at"), F.when(k % 27 == 0, "1.5").otherwise("0.5").alias("probability"))).alias("execution_check"),
        F.when(is_("click"), (k / 80).cast("string")).alias("probability"), F.when(is_("click"), iso).alias("made_at"), F.when(is_("click"), iso).alias("features_available_at"), F.when(is_("click"), later).alias("expires_at"), F.when(is_("click"), F.lit("m")).alias("model_id"),
        F.when(is_("purchase"), F.lit("1")).alias("yes_payout"), F.when(is_("purchase"), iso).alias("settled_at")))
    return t.select(F.when(k == 50, F.lit("{not json")).otherwise(rec).alias("value"))


@query("record_validation", f"""
WITH {TICKS}, v AS (SELECT CASE WHEN k = 50 THEN ['malformed'] ELSE list_filter([CASE WHEN event_type = 'error' THEN 'type' END, CASE WHEN k = 7 THEN 'ticker' END, CASE WHEN k % 20 = 3 THEN 'available_at' END,
  CASE WHEN event_type = 'view' AND (k % 25 = 1 OR k % 20 = 3) THEN 'observed_at' END,
  CASE WHEN event_type = 'view' AND k % 9 = 0 AND (k % 2 = 1 OR k % 27 = 0 OR k % 25 = 1 OR k % 20 = 3) THEN 'execution_check' END,
  CASE WHEN event_type = 'click' AND k > 80 THEN 'probability' END, CASE WHEN event_type = 'click' AND k % 20 = 3 THEN 'feature_time' END, CASE WHEN event_type = 'purchase' AND k % 20 = 3 THEN 'settled_at' END], lambda x: x IS NOT NULL) END AS v FROM ticks)
SELECT array_to_string(v, ',') AS violations, count(*) AS n FROM v GROUP BY 1""")
def record_validation(spark, sf):
    tagged = SM.tag_records(record_lines(spark, sf))
    return tagged.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("kline_parse", f"""
WITH {TICKS}, b AS (SELECT t // 60000000 * 60 AS t, arg_max(value, (t, event_id)) AS c, max(value) AS h, min(value) AS l, count(*) AS n, max(k) AS k FROM ticks GROUP BY 1)
SELECT CASE WHEN k = 5 THEN 'epoch_unit' WHEN k = 6 THEN 'close_time' WHEN l <= 0 THEN 'positive' ELSE 'bar' END AS status, count(*) AS n FROM b GROUP BY 1""")
def kline_parse(spark, sf):
    t = ticks(spark, sf)
    b = t.groupBy((F.floor(F.col("t") / (60 * S)) * 60).cast("long").alias("t")).agg(
        F.min_by("value", F.struct("t", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("t", "event_id")).alias("close"), F.count(F.lit(1)).alias("trades"), F.max("k").alias("k"))
    unit = F.when(F.col("t") % 120 == 0, F.lit(1000)).otherwise(F.lit(1_000_000))
    raw = b.select(
        F.lit("X-1m-2024-01.csv").alias("file"), F.when(F.col("k") == 5, F.col("t") * unit + 1).otherwise(F.col("t") * unit).alias("open_time"), "open", "high", "low", "close", F.lit(10.0).alias("volume"),
        ((F.col("t") + F.when(F.col("k") == 6, 120).otherwise(60)) * unit - 1).alias("close_time"), "trades", F.lit(4.0).alias("taker_buy"))
    good, bad = SB.minute_klines(raw)
    reason = F.when(F.array_contains("violations", "epoch_unit"), "epoch_unit").otherwise(F.col("violations")[0])
    both = good.select(F.lit("bar").alias("status")).unionByName(bad.select(reason.alias("status")))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("ohlc_array_parse", f"""
WITH {TICKS}, b AS (SELECT event_type, t // 3600000000 * 3600 AS t, min(value) AS low, max(value) AS high, arg_max(value, (t, event_id)) AS close FROM ticks GROUP BY 1, 2),
g AS (SELECT t, count(DISTINCT (low, high, close)) AS d, min(low) AS low FROM b GROUP BY 1) SELECT d > 1 AS conflict, count(*) AS n FROM g GROUP BY 1""")
def ohlc_array_parse(spark, sf):
    b = X.ohlcv(ticks(spark, sf), ["event_type"], "t", "value", F.lit(1.0), H, tie="event_id")
    # Five series share one clock: starts seen in several series with different bars are conflicts.
    line = F.to_json(F.array(F.array((F.col("bar") / S).cast("double"), "low", "high", F.lit(1.0), "close", F.lit(1.0))))
    good, bad = SB.parse_ohlc_arrays(b.select(line.alias("value")))
    return good.agg(F.lit(False).alias("conflict"), F.count(F.lit(1)).alias("n")).unionByName(bad.agg(F.lit(True).alias("conflict"), F.count(F.lit(1)).alias("n"))).filter("n > 0")


@query("quote_candle_parse", f"""
WITH {TICKS} SELECT event_id, CASE WHEN k % 5 = 0 OR k % 5 = 3 THEN NULL ELSE k / 100.0::DOUBLE END AS bid, CASE WHEN k % 5 = 0 OR k % 5 = 3 THEN NULL ELSE least(k + 2, 100) / 100.0::DOUBLE END AS ask FROM ticks""")
def quote_candle_parse(spark, sf):
    t = ticks(spark, sf)
    k = F.col("k")
    dollars = lambda c: c.cast("decimal(6,4)").cast("string")
    bid, ask = k / 100, F.least(k + 2, F.lit(100)) / 100
    side = lambda v, cents: F.when(k % 5 == 0, F.concat(F.lit('{"close":'), cents.cast("string"), F.lit("}"))).when(
        k % 5 == 3, F.concat(F.lit('{"close":"'), cents.cast("string"), F.lit('"}'))).when(k % 5 == 1, F.concat(F.lit('{"close_dollars":"'), dollars(v), F.lit('"}'))).otherwise(F.concat(F.lit('{"close":"'), dollars(v), F.lit('"}')))
    line = F.concat(F.lit('{"markets":[{"market_ticker":"T","candlesticks":[{"end_period_ts":'), F.floor(F.col("t") / S).cast("string"), F.lit(',"yes_bid":'), side(bid, k), F.lit(',"yes_ask":'), side(ask, k + 2), F.lit("}]}]}"))
    return SM.parse_candles(t.select("event_id", line.alias("value"))).select("event_id", "bid", "ask")


@query("journal_views", """
SELECT CASE role WHEN 'user' THEN 'market' WHEN 'assistant' THEN 'book' ELSE 'outcome' END AS kind, count(*) AS n, CAST(sum(turn) AS BIGINT) AS turns FROM conversations GROUP BY 1""")
def journal_views(spark, sf):
    c = table(spark, sf, "conversations")
    line = F.to_json(F.struct(F.col("turn").alias("sequence"), F.lit("2024-01-01T00:00:00Z").alias("recorded_at"), F.when(F.col("role") == "user", "market").when(F.col("role") == "assistant", "book").otherwise("outcome").alias("kind"),
                              F.to_json(F.struct(F.col("conv_id"), F.col("turn"))).alias("payload"), F.lit("").alias("previous"), F.lit("").alias("sha256")))
    j = SM.parse_journal(c.select(line.alias("value")))
    view = lambda k: SM.journal_view(j, k, "conv_id long, turn long").agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("turn").alias("turns"))
    return view("market").unionByName(view("book")).unionByName(view("outcome")).filter("n > 0")


@query("listing_pages", """
WITH p AS (SELECT p_partkey // 10 AS page, 'T' || (p_partkey % 1990) AS ticker FROM part), g AS (SELECT ticker, count(*) AS c FROM p GROUP BY 1) SELECT c > 1 AS duplicate, count(*) AS tickers FROM g GROUP BY 1""")
def listing_pages(spark, sf):
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 10).alias("page"), F.concat(F.lit("T"), (F.col("p_partkey") % 1990).cast("string")).alias("ticker"), F.col("p_name").alias("title"))
    pages = p.groupBy("page").agg(F.to_json(F.struct(F.collect_list(F.struct("ticker", "title")).alias("markets"))).alias("value"))  # ten rows a page
    good, bad = SM.parse_listings(pages)
    return good.agg(F.lit(False).alias("duplicate"), F.count(F.lit(1)).alias("tickers")).unionByName(bad.agg(F.lit(True).alias("duplicate"), F.count(F.lit(1)).alias("tickers"))).filter("tickers > 0")


@query("station_csv_parse", f"""
WITH {TICKS}, d AS (SELECT event_type AS station, t // 60000000 AS mi, value, k, k % 13 = 0 AS cor, k % 17 = 0 AS miss FROM ticks), g AS (SELECT station, mi, count(DISTINCT value) AS v FROM d WHERE NOT cor AND NOT miss AND value < 150 GROUP BY 1, 2)
SELECT station, 'rejected' AS reason, count(*) AS n FROM d WHERE cor OR miss OR value >= 150 GROUP BY 1 UNION ALL SELECT station, CASE WHEN v > 1 THEN 'conflicting_timestamp' ELSE 'usable' END, count(*) FROM g GROUP BY 1, 2""")
def station_csv_parse(spark, sf):
    t = ticks(spark, sf)
    k = F.col("k")
    raw = t.select(
        F.col("event_type").alias("station"), F.date_format(F.timestamp_micros((F.floor(F.col("t") / (60 * S)) * 60 * S).cast("long")), "yyyy-MM-dd HH:mm").alias("valid"),
        F.when(k % 17 == 0, F.lit("M")).otherwise(F.col("value").cast("string")).alias("tmpf"), F.when(k % 13 == 0, F.lit("KNYC COR 1/1 RMK AO2")).otherwise(F.lit("KNYC RMK AO2")).alias("metar"))
    _, counts = SW.parse_station_obs(raw)
    return counts


@query("forecast_run_long", f"""
WITH {TICKS}, h AS (SELECT t // 86400000000 AS day, t // 3600000000 AS hr, max(value) AS v, max(k)::DOUBLE AS k FROM ticks GROUP BY 1, 2)
SELECT model, day, count(*) AS hours, {R('sum(val)', 2)} AS total, min(hr) AS first_hour FROM (SELECT 'gfs' AS model, day, hr, v AS val FROM h UNION ALL SELECT 'ecmwf', day, hr, k FROM h) GROUP BY 1, 2""")
def forecast_run_long(spark, sf):
    t = ticks(spark, sf)
    h = t.groupBy(F.floor(F.col("t") / DAY).cast("long").alias("day"), F.floor(F.col("t") / H).cast("long").alias("hr")).agg(F.max("value").alias("v"), F.max("k").alias("k"))
    # One document per day: at most 24 hours per array.
    arr = F.array_sort(F.collect_list(F.struct("hr", "v", "k")))
    d = h.groupBy("day").agg(arr.alias("a"))
    hourly = F.create_map(
        F.lit("time"), F.transform("a", lambda x: F.date_format(F.timestamp_seconds(x["hr"] * 3600), "yyyy-MM-dd'T'HH:mm")), F.lit("temperature_2m_gfs"), F.transform("a", lambda x: x["v"].cast("string")),
        F.lit("temperature_2m_ecmwf"), F.transform("a", lambda x: x["k"].cast("string")))
    units = F.create_map(F.lit("temperature_2m_gfs"), F.lit("°F"), F.lit("temperature_2m_ecmwf"), F.lit("°F"))
    body = F.to_json(F.array(F.struct(F.lit(40.0).alias("latitude"), F.lit(-73.0).alias("longitude"), F.lit(0).alias("utc_offset_seconds"), hourly.alias("hourly"), units.alias("hourly_units"))))
    docs = d.select("day", body.alias("value")).withColumn("body", F.from_json("value", SW.T.FORECAST_BODY))
    long = SW.forecast_long(docs, F.col("body"), F.col("day") * DAY)
    return long.groupBy("model", "day").agg(F.count(F.lit(1)).alias("hours"), rounded(F.sum("value"), 2).alias("total"), (F.min("valid_at") / H).cast("long").alias("first_hour"))


@query("daily_target_parse", f"""
WITH o AS (SELECT DISTINCT o_orderpriority AS st, o_orderdate AS d FROM orders),
x AS (SELECT *, epoch_us(d) // 86400000000 AS day FROM o)
SELECT 'usable' AS reason, count(*) AS n FROM x WHERE day % 7 <> 0 AND day % 11 <> 0 UNION ALL SELECT 'missing_or_invalid_label', count(*) FROM x WHERE day % 7 = 0 OR day % 11 = 0 UNION ALL SELECT 'conflicting_day', 0""")
def daily_target_parse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderdate").distinct()
    day = F.floor(micros("o_orderdate") / DAY)
    issued = F.when(day % 11 == 0, F.date_format("o_orderdate", "yyyyMMdd0000")).otherwise(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"), "yyyyMMdd0630"))
    one = F.struct(F.col("o_orderpriority").alias("station"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid"), F.when(day % 7 == 0, F.lit("M")).otherwise(F.lit("71")).alias("high"), F.concat(issued, F.lit("-KXXX-CLI")).alias("product"))
    good, counts = SW.parse_daily_targets(o.select(F.to_json(F.struct(F.array(one).alias("results"))).alias("value")))
    return good.agg(F.lit("usable").alias("reason"), F.count(F.lit(1)).alias("n")).unionByName(counts)


@query("weather_snapshot_parse", f"""
WITH {TICKS}, v AS (SELECT 'period_temperature' AS kind, CASE k % 3 WHEN 0 THEN value WHEN 1 THEN value * 1.8::DOUBLE + 32 END AS val FROM ticks WHERE k % 3 <> 2 AND k % 10 <> 0 UNION ALL SELECT 'wind', k + 5 FROM ticks WHERE k % 10 <> 0 UNION ALL SELECT 'cloud', k FROM ticks WHERE k % 10 <> 0 UNION ALL SELECT 'observation', value * 1.8::DOUBLE + 32 FROM ticks)
SELECT kind, count(*) AS n, {R('sum(val)', 2)} AS total FROM v GROUP BY 1""")
def weather_snapshot_parse(spark, sf):
    t = ticks(spark, sf)
    k, at = F.col("k"), _iso(F.col("t"))
    later = _iso(F.col("t") + H)
    period = F.struct(at.alias("startTime"), later.alias("endTime"), F.col("value").alias("temperature"), F.when(k % 3 == 0, "F").when(k % 3 == 1, "C").otherwise("K").alias("temperatureUnit"),
                      F.concat(k.cast("string"), F.lit(" to "), (k + 5).cast("string"), F.lit(" mph")).alias("windSpeed"))
    props = F.struct(F.array(period).alias("periods"), F.when(k % 10 == 0, later).otherwise(at).alias("updateTime"), F.struct(F.array(F.struct(F.concat(at, F.lit("/PT3H")).alias("validTime"), k.alias("value"))).alias("values")).alias("skyCover"))
    obs = F.struct(F.struct(at.alias("timestamp"), F.struct(F.col("value").alias("value"), F.lit("wmoUnit:degC").alias("unitCode")).alias("temperature")).alias("properties"))
    src = F.struct(F.lit("nws").alias("source"), at.alias("received_at"), F.struct(props.alias("properties"), F.array(obs).alias("features")).alias("body"))
    line = F.to_json(F.struct(F.col("event_type").alias("series"), at.alias("captured_at"), F.array(src).alias("sources")))
    tall = SW.parse_snapshots(t.select(line.alias("value")))
    return tall.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total"))


@query("price_samples", f"""
WITH {TICKS}, q AS (SELECT user_id, event_id, t // 1000000 AS ts, k FROM ticks WHERE event_type <> 'signup'),
q1 AS (SELECT user_id, ts, max(k) AS k FROM q GROUP BY 1, 2), q2 AS (SELECT *, lag(k) OVER w AS pk, lag(ts) OVER w AS pt, lead(k) OVER w AS nk, lead(ts) OVER w AS nt FROM q1 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT event_id, user_id, t // 1000000 AS cl FROM ticks WHERE event_type = 'signup'), d AS (SELECT c.*, h, cl - h * 3600 AS cut FROM c, (VALUES (12), (18), (24)) v(h))
SELECT d.event_id, CAST(h AS INTEGER) AS horizon, q2.k / 100.0::DOUBLE AS p, CASE WHEN q2.ts - pt <= 7200 THEN {R('(q2.k - pk) / 100.0::DOUBLE')} ELSE 0.0 END AS prior_move, CASE WHEN nt - q2.ts <= 7200 THEN nt END AS execution_at, {R('(cl - q2.ts) / 3600.0::DOUBLE')} AS hours_left
FROM d ASOF JOIN q2 ON d.user_id = q2.user_id AND d.cut >= q2.ts WHERE d.cut - q2.ts <= 3600""")
def price_samples(spark, sf):
    t = ticks(spark, sf).withColumn("ts", F.floor(F.col("t") / S).cast("long"))
    # A contract's quotes are those of its user; each signup is one contract that closes at the signup time.
    sign = t.filter("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("close_s"))
    q = t.filter("event_type <> 'signup'").groupBy("user_id", "ts").agg(F.max("k").alias("k"))
    candles = q.select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").alias("end_ts"), (F.col("k") / 100.0).alias("bid"), (F.col("k") / 100.0).alias("ask"))
    markets = sign.select(
        F.col("user_id").cast("string").alias("ticker"), F.col("event_id").cast("string").alias("event_ticker"), "close_s", (F.col("close_s") + 7200).alias("settled_s"), F.lit("yes").alias("result"), F.lit("settled").alias("status"),
        F.lit("binary").alias("market_type"), F.lit("1").alias("notional_value_dollars"), F.lit("1").alias("settlement_value_dollars"), F.timestamp_seconds("close_s").alias("settlement_ts"))
    out = ST.price_samples(markets, candles)
    return out.select(F.col("event").cast("long").alias("event_id"), "horizon", "p", rounded(F.col("prior_move")).alias("prior_move"), "execution_at", rounded(F.col("hours_left")).alias("hours_left"))


@query("prospective_dataset", f"""
WITH {TICKS}, w AS (SELECT event_id, user_id, t, k FROM ticks WHERE event_type = 'error'), m AS (SELECT user_id, event_id, t, k FROM ticks WHERE event_type = 'signup'), b AS (SELECT user_id, event_id, t, k FROM ticks WHERE event_type = 'click'),
o AS (SELECT user_id, min(t) AS st, min(k % 2) AS lo, max(k % 2) AS hi FROM ticks WHERE event_type = 'purchase' GROUP BY 1),
j1 AS (SELECT w.*, m.event_id AS mid, m.t AS mt, m.k AS mk FROM w ASOF LEFT JOIN m ON w.user_id = m.user_id AND w.t >= m.t), j2 AS (SELECT j1.*, b.event_id AS bid_, b.t AS bt, b.k AS bk FROM j1 ASOF LEFT JOIN b ON j1.user_id = b.user_id AND j1.t >= b.t),
r AS (SELECT j2.*, CASE WHEN mid IS NULL OR bid_ IS NULL THEN 'missing_market_or_book' WHEN mk % 7 = 0 THEN 'unsupported_rules' WHEN j2.t - bt > 43200000000 THEN 'stale_book' WHEN bk > 90 THEN 'invalid_book' WHEN o.lo IS NULL THEN 'unsettled' WHEN o.lo <> o.hi THEN 'conflicting_settlement' WHEN o.lo NOT IN (0, 1) THEN 'nonbinary_settlement' WHEN o.st <= j2.t THEN 'already_closed' WHEN mt + 864000000000 <= j2.t THEN 'already_closed' WHEN k % 11 = 0 OR k % 15 > 12 THEN 'incomplete_or_stale_forecast' END AS reason FROM j2 LEFT JOIN o ON o.user_id = j2.user_id)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def prospective_dataset(spark, sf):
    t = ticks(spark, sf).withColumn("ticker", F.col("user_id").cast("string"))
    is_ = lambda e: t.filter(F.col("event_type") == e)
    w = is_("error").select("event_id", "ticker", F.col("t").alias("at"), (F.col("k") % 11 != 0).alias("forecast_complete"), (F.col("k") % 15).cast("double").alias("forecast_age_hours"))
    m = is_("signup").select("ticker", F.col("t").alias("available_t"), F.col("event_id").cast("string").alias("event"), (F.col("t") + 10 * DAY).alias("close_t"), (F.col("k") % 7 != 0).alias("supported"))
    b = is_("click").select("ticker", F.col("t").alias("available_t"), F.col("t").alias("observed_t"), (F.col("k") / 100.0).alias("bid"), F.when(F.col("k") > 90, 0.9).otherwise(F.col("k") / 100.0 + 0.01).alias("ask"))
    o = is_("purchase").select("ticker", F.col("t").alias("settled_t"), (F.col("k") % 2).alias("yes_payout"))
    _, counts = ST.prospective_dataset(w, m, b, o, max_book_age=12 * H)
    return counts


@query("market_board", """
WITH s AS (SELECT s_suppkey AS series, CASE WHEN s_nationkey % 3 = 0 THEN 'economics' WHEN s_nationkey % 3 = 1 THEN 'weather' ELSE 'mentions' END AS category, s_acctbal AS volume, CASE WHEN s_nationkey % 4 = 0 THEN NULL WHEN s_nationkey % 4 = 1 THEN 0.035 ELSE 0.07 END AS fee FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY volume DESC, 'S' || series) AS rk FROM s), m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 + CAST(floor(l_extendedprice) AS BIGINT) % 97 AS c, l_discount FROM lineitem WHERE l_linenumber <> 1),
f AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rk) AS place FROM r WHERE rk <= CASE category WHEN 'weather' THEN 4 ELSE 30 END AND series IN (SELECT l_suppkey FROM m))
SELECT category, series, count(*) AS cards, CAST(max(fee) AS DOUBLE) AS fee_rate, floor(max(l_discount) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS best_edge FROM m JOIN f ON f.series = m.l_suppkey AND place <= CASE category WHEN 'weather' THEN 4 ELSE 3 END GROUP BY 1, 2""")
def market_board(spark, sf):
    s = table(spark, sf, "supplier")
    m3, m4 = F.col("s_nationkey") % 3, F.col("s_nationkey") % 4
    series = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("series"), F.when(m3 == 0, "gas price").when(m3 == 1, "high").otherwise("who will say during").alias("title"), F.array().cast("array<string>").alias("tags"),
        F.when(m3 == 1, F.array(F.lit("Climate and Weather"))).alias("categories"), F.lit("daily").alias("frequency"), F.lit(0).alias("priority"), F.col("s_acctbal").alias("volume"),
        F.when(m4 == 0, "flat").otherwise("quadratic").alias("fee_type"), F.when(m4 == 1, 0.5).otherwise(1.0).alias("fee_multiplier"))
    c = F.lit(1) + F.floor("l_extendedprice").cast("long") % 97
    markets = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("series"), F.concat(F.lit("R"), (F.col("l_suppkey") % 5).cast("string")).alias("event"), (c / 100.0).alias("bid"), ((c + 1) / 100.0).alias("ask"), F.lit("active").alias("status"), F.when(F.col("l_linenumber") == 1, 0).otherwise(1).alias("close_t"), ((c + 1) / 100.0 + F.col("l_discount")).alias("model_p"))
    events = table(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("event"), F.lit(None).cast("string").alias("fee_type_override"), F.lit(None).cast("double").alias("fee_multiplier_override"))
    cards = ST.market_board(series, events, markets, F.lit(0))
    return cards.groupBy("category", F.substring("series", 2, 20).cast("long").alias("series")).agg(
        F.count(F.lit(1)).alias("cards"), F.max("fee_rate").cast("double").alias("fee_rate"), rounded(F.max("estimated_edge")).alias("best_edge"))


@query("data_audit", f"""
WITH {SAMPLES}, d AS (SELECT day, min("at") AS fa, max(settled_t) AS ls, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM samples GROUP BY day),
p AS (SELECT *, CASE WHEN i >= floor(n * 0.8) THEN 'test' WHEN i >= floor(n * 0.6) THEN 'validation' ELSE 'train' END AS part FROM d),
tc AS (SELECT min(fa) - {24 * H} AS cut FROM p WHERE part = 'test'), vd AS (SELECT p.* FROM p, tc WHERE part = 'validation' AND ls < cut), vc AS (SELECT min(fa) - {24 * H} AS cut FROM vd),
r AS (SELECT p.day, CASE WHEN part = 'test' THEN 'test' WHEN p.day IN (SELECT day FROM vd) THEN 'validation' WHEN part = 'train' AND p.ls < vc.cut THEN 'train' ELSE 'purged' END AS role FROM p, vc)
SELECT role, count(*) AS samples, count(DISTINCT day) AS days, {R('avg(y)')} AS yes_rate FROM samples JOIN r USING (day) GROUP BY 1""")
def data_audit(spark, sf):
    s = samples(spark, sf).withColumn("ticker", F.col("event_id")).withColumn("feature_time", F.col("at"))
    return ST.data_audit(s, None, None, 24 * H)["parts"].select("role", "samples", "days", rounded(F.col("yes_rate")).alias("yes_rate"))


@query("rejected_lines", f"""
WITH {TICKS}, l AS (SELECT user_id % 16 AS shard, k, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS line FROM ticks)
SELECT CAST(shard AS BIGINT) AS shard, line FROM l WHERE k % 10 = 0""")
def rejected_lines(spark, sf):
    """The ticks as record files of 16 shards; every tenth record has a probability above one."""
    from tidemark.session import new_folder
    from tidemark.sources.market import read_records

    t = ticks(spark, sf).withColumn("iso", F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    later = F.date_format(F.timestamp_micros(F.col("t") + 3600 * S), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    lines = t.select((F.col("user_id") % 16).alias("shard"), "event_id", F.to_json(F.struct(
        F.lit("prediction").alias("type"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), F.col("iso").alias("available_at"), F.col("iso").alias("made_at"),
        F.col("iso").alias("features_available_at"), later.alias("expires_at"), F.when(F.col("k") % 10 == 0, "1.5").otherwise("0.5").alias("probability"), F.lit("m1").alias("model_id"))).alias("value"))
    folder = new_folder(spark, "records")
    lines.repartition("shard").sortWithinPartitions("shard", "event_id").select("shard", "value").write.partitionBy("shard").text(folder)
    _, bad = read_records(spark, folder)
    return bad.select(F.regexp_extract("file", r"shard=(\d+)/", 1).cast("long").alias("shard"), "line")
