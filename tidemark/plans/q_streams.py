"""Streaming queries: the tables as file streams, drained with availableNow and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import ranking as D
from tidemark.plans.registry import query
from tidemark.plans.standins import DAY, R, S, TICKS, micros
from tidemark.streaming import streams as T

H = 3600 * S


def tick_stream(spark, sf):
    e = T.table_stream(spark, sf, "events.parquet")
    return e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def tick_slots(spark, sf):
    return T.slots_for(spark.read.parquet(f"{sf}/events.parquet").count())


def with_clock(spark, sf):
    """The ticks and a clock that is a day past the last of them, so that every window is over."""
    now = spark.read.parquet(f"{sf}/events.parquet").agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("ts"))
    return T.with_heartbeat(tick_stream(spark, sf), T.table_of(now, "clock"), "ts")


@query("stream_tumbling_bars", f"""
WITH {TICKS} SELECT event_type, t // 3600000000 * 3600 AS bar, arg_min(value, (t, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (t, event_id)) AS close, CAST(sum(k) AS DOUBLE) AS volume, count(*) AS trades
FROM ticks GROUP BY event_type, bar""")
def stream_tumbling_bars(spark, sf):
    b = T.tumbling_bars(with_clock(spark, sf), ["event_type"], "ts", "value", F.col("k").cast("double"), "event_id", "1 hour", "1 hour")
    out = T.run_available(b, "stream_tumbling_bars")
    return out.select("event_type", F.unix_seconds("w.start").alias("bar"), "open", "high", "low", "close", "volume", "trades")


@query("stream_sliding_imbalance", f"""
WITH {TICKS}, w AS (SELECT *, (t // 3600000000 - i) * 3600 AS st FROM ticks, range(3) r(i)), g AS (SELECT st, sum(k)::DOUBLE AS v, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN k ELSE 0 END)::DOUBLE AS b FROM w GROUP BY 1)
SELECT st AS start_s, CASE WHEN v > 0 THEN {R('2 * b / v - 1')} END AS imbalance FROM g""")
def stream_sliding_imbalance(spark, sf):
    k = F.col("k").cast("double")
    s = T.sliding_imbalance(with_clock(spark, sf), [], "ts", k, F.when(F.col("event_type").isin("purchase", "signup"), k).otherwise(0.0), "3 hours", "1 hour", "1 hour")
    out = T.run_available(s, "stream_sliding_imbalance")
    return out.select(F.unix_seconds("w.start").alias("start_s"), rounded(F.col("imbalance")).alias("imbalance"))


@query("stream_dedup", f"""
WITH {TICKS} SELECT event_id, user_id FROM ticks""")
def stream_dedup(spark, sf):
    # Every row arrives twice; one copy per content key survives.
    twice = tick_stream(spark, sf).unionByName(tick_stream(spark, sf))
    return T.run_available(T.dedup(twice, ["event_id"], "ts", "1 hour"), "stream_dedup").select("event_id", "user_id")


@query("stream_latest_book", f"""
WITH {TICKS} SELECT user_id, arg_max(event_id, (t, event_id)) AS event_id, max(t) AS t FROM ticks GROUP BY 1""")
def stream_latest_book(spark, sf):
    b = T.latest_book(tick_stream(spark, sf), ["user_id"], ["ts", "event_id"], ["event_id", "ts"])
    out = T.latest_version(T.run_available(b, "stream_latest_book", "update"), ["user_id"])
    return out.select("user_id", F.col("book.event_id").alias("event_id"), F.unix_micros("book.ts").alias("t"))


@query("stream_first_prediction", f"""
WITH {TICKS} SELECT user_id, arg_min(event_id, (t, event_id)) AS event_id FROM ticks WHERE event_type = 'view' GROUP BY 1""")
def stream_first_prediction(spark, sf):
    p = T.first_prediction(tick_stream(spark, sf).filter("event_type = 'view'"), ["user_id"], ["ts", "event_id"], ["event_id"])
    out = T.latest_version(T.run_available(p, "stream_first_prediction", "update"), ["user_id"])
    return out.select("user_id", F.col("prediction.event_id").alias("event_id"))


def _until_close(spark, sf, newest, name):
    first = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 15 DAYS")).cast("timestamp").alias("close"))
    rows = tick_stream(spark, sf).filter("event_type <> 'error'").join(first, "user_id").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), "close")
    out = T.latest_version(T.run_available(T.kept_until_close(rows, newest, "1 hour"), name, "update", rocksdb=True), ["key"])
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"))


_OPEN_SQL = f"""WITH {TICKS}, c AS (SELECT user_id, min(t) + 1296000000000 AS close FROM ticks GROUP BY 1)
SELECT user_id, PICK(event_id, (t, event_id)) AS event_id FROM ticks JOIN c USING (user_id) WHERE event_type <> 'error' AND t < close GROUP BY 1"""


@query("stream_open_latest", _OPEN_SQL.replace("PICK", "arg_max"))
def stream_open_latest(spark, sf):
    return _until_close(spark, sf, True, "stream_open_latest")


@query("stream_open_first", _OPEN_SQL.replace("PICK", "arg_min"))
def stream_open_first(spark, sf):
    return _until_close(spark, sf, False, "stream_open_first")


@query("stream_match_intents", f"""
WITH {TICKS}, m AS (SELECT s.event_id, arg_min(b.event_id, (b.t, b.event_id)) AS book_id FROM ticks s JOIN ticks b ON b.user_id = s.user_id AND b.event_type = 'purchase' AND b.t >= s.t + 5000000 AND b.t <= s.t + 86400000000 AND b.t < s.t + 43200000000 WHERE s.event_type = 'view' GROUP BY 1)
SELECT event_id, book_id FROM m""")
def stream_match_intents(spark, sf):
    t = tick_stream(spark, sf)
    s = t.filter("event_type = 'view'").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("expires"))
    b = tick_stream(spark, sf).filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    m = T.match_intents(s, b, "5 SECONDS", "24 HOURS", "1 hour", tick_slots(spark, sf))
    out = T.latest_version(T.run_available(m, "stream_match_intents", "update", rocksdb=True), ["id"])
    return out.select(F.col("id").alias("event_id"), F.col("answer_id").alias("book_id"))


@query("stream_settle", f"""
WITH {TICKS} SELECT p.event_id AS prediction_id, arg_min(o.event_id, (o.t, o.event_id)) AS outcome_id FROM ticks p JOIN ticks o ON o.user_id = p.user_id AND o.event_type = 'purchase' AND o.t > p.t WHERE p.event_type = 'click' GROUP BY 1""")
def stream_settle(spark, sf):
    p = tick_stream(spark, sf).filter("event_type = 'click'").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.lit(None).cast("timestamp").alias("close"))
    o = tick_stream(spark, sf).filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    out = T.latest_version(T.run_available(T.settle(p, o, "1 hour", tick_slots(spark, sf)), "stream_settle", "update", rocksdb=True), ["id"])
    return out.select(F.col("id").alias("prediction_id"), F.col("answer_id").alias("outcome_id"))


@query("stream_settlements", f"""
WITH {TICKS}, a AS (SELECT *, CAST(k % 10 = 0 AS INTEGER) AS late_file FROM ticks), m AS (SELECT user_id, max(t) AS newest FROM a WHERE late_file = 0 GROUP BY 1),
v AS (SELECT a.*, late_file = 1 AND newest IS NOT NULL AND t < newest - 86400000000 AS late FROM a LEFT JOIN m USING (user_id)),
f AS (SELECT user_id, arg_min(k % 3, (late_file, t, event_id)) AS first_payout, arg_min(event_id, (late_file, t, event_id)) AS first_id FROM v WHERE NOT late GROUP BY 1),
g AS (SELECT v.*, CASE WHEN late THEN 'late' WHEN event_id = first_id THEN 'accepted' WHEN k % 3 = first_payout THEN 'repeated' ELSE 'conflicting' END AS verdict FROM v LEFT JOIN f USING (user_id))
SELECT event_id, verdict, row_number() OVER (PARTITION BY user_id, verdict ORDER BY late_file, t, event_id) AS nth FROM g""")
def stream_settlements(spark, sf):
    """Outcomes of which every tenth arrives after the others were judged, some of them a day behind their key's newest."""
    from tidemark.session import new_folder

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), (F.col("k") % 3).alias("payout"), "k")
    folder, written, checkpoint = (new_folder(spark, f"stream_settlements-{n}") for n in ("outcomes", "verdicts", "checkpoint"))
    slots = tick_slots(spark, sf)
    # A run is one micro-batch of all new files, however many tasks wrote them.
    for late in (False, True):
        rows.where((F.col("k") % 10 == 0) == F.lit(late)).drop("k").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.drop("k").schema).parquet(folder)
        out = T.run_available(T.settlements(stream, DAY, slots), "stream_settlements", rocksdb=True, out=written, checkpoint=checkpoint)
    return out.select(F.col("id").alias("event_id"), "verdict", "nth")


@query("stream_freshness", f"""
WITH {TICKS}, x AS (SELECT user_id, t, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'forecast' ELSE 'watching' END AS label,
  min(t) OVER (PARTITION BY user_id) + 1296000000000 AS close FROM ticks),
o AS (SELECT *, lag(label) OVER w AS before, lag(t) OVER w AS pt, lead(t) OVER w AS nt FROM x WHERE t < close WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
c AS (SELECT (SELECT max(t) + 172800000000 - 3600000000 FROM ticks) AS mark),
s AS (SELECT user_id, t AS at_us, label AS state FROM o WHERE before IS NULL OR t - pt >= 21600000000 OR label <> before
  UNION ALL SELECT user_id, t + 21600000000, 'collecting' FROM o, c WHERE coalesce(nt, mark) >= t + 21600000000 AND t + 21600000000 < close
  UNION ALL SELECT DISTINCT user_id, close, 'closed' FROM o, c WHERE close <= mark)
SELECT state, count(*) AS n, CAST(sum(at_us // 1000000) AS BIGINT) AS at_s FROM s GROUP BY 1""")
def stream_freshness(spark, sf):
    first = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 15 DAYS")).cast("timestamp").alias("close"))
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "forecast").otherwise("book")
    rows = tick_stream(spark, sf).join(first, "user_id").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), kind.alias("kind"), "close")
    now = spark.read.parquet(f"{sf}/events.parquet").agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).cast("timestamp").alias("ts"))
    changes = T.freshness_changes(T.with_heartbeat(rows, T.table_of(now, "clock"), "ts"), 6 * H, "1 hour")
    out = T.run_available(changes, "stream_freshness", rocksdb=True)
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("at_us") / S).cast("long")).alias("at_s"))


@query("stream_record_validation", f"""
WITH {TICKS} SELECT CASE WHEN k % 10 = 0 THEN 'rejected' ELSE 'valid' END AS status, count(*) AS n FROM ticks GROUP BY 1""")
def stream_record_validation(spark, sf):
    from tidemark.session import new_folder

    t = tick_stream(spark, sf)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    lines = t.select(F.to_json(F.struct(
        F.lit("prediction").alias("type"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), iso.alias("available_at"), iso.alias("made_at"),
        iso.alias("features_available_at"), later.alias("expires_at"), F.when(F.col("k") % 10 == 0, "1.5").otherwise("0.5").alias("probability"), F.lit("m1").alias("model_id"))).alias("value"))
    good, bad, check = (new_folder(spark, f"stream_records-{n}") for n in ("good", "bad", "checkpoint"))
    T.split_records(lines, good, bad, check).awaitTermination()
    n = lambda path, s: spark.read.parquet(path).agg(F.lit(s).alias("status"), F.count(F.lit(1)).alias("n"))
    return n(good, "valid").unionByName(n(bad, "rejected"))


@query("stream_intent_lifecycle", f"""
WITH {TICKS}, e AS (SELECT user_id, event_id, event_type, k, t // 1000 AS ms FROM ticks WHERE event_type IN ('view', 'purchase')),
n AS (SELECT *, lead(ms) OVER w AS nms, lead(event_type) OVER w AS nt, lead(k) OVER w AS nk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
r AS (SELECT CASE WHEN coalesce(nms, (SELECT max(ms) - 3600000 FROM e)) >= ms + 43200000 THEN 'expired' WHEN nms IS NULL THEN NULL WHEN nt = 'purchase' THEN 'matched' WHEN nk < 30 THEN 'cancelled' END AS event FROM n WHERE event_type = 'view' AND k >= 30)
SELECT event, count(*) AS n FROM r WHERE event IS NOT NULL GROUP BY 1""")
def stream_intent_lifecycle(spark, sf):
    t = tick_stream(spark, sf).filter(F.col("event_type").isin("view", "purchase"))
    ms = F.unix_millis("ts")
    rows = t.select("user_id", "ts", ms.alias("ts_ms"), F.when(F.col("event_type") == "view", "prediction").otherwise("book").alias("kind"), F.col("event_id").alias("id"),
                    (ms + 12 * 3600 * 1000).alias("expires_ms"), (F.col("k") >= 30).alias("qualifies"))
    out = T.run_available(T.intents_with_cancellation(rows, "user_id", "ts", "1 hour"), "stream_intent_lifecycle", rocksdb=True)
    return out.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("freshness_states", f"""
WITH {TICKS}, l AS (SELECT user_id, max(t) AS t, count(*) AS n FROM ticks GROUP BY 1)
SELECT CASE WHEN 1736000000000000 - 1736000000000000 + (SELECT max(t) FROM ticks) - t > 21600000000 THEN 'collecting' WHEN n > 60 THEN 'forecast' ELSE 'watching' END AS state, count(*) AS markets FROM l GROUP BY 1""")
def freshness_states(spark, sf):
    from tidemark.operators.temporal import scalar_join
    from tidemark.plans.standins import ticks

    t = ticks(spark, sf)
    latest = t.groupBy("user_id").agg(F.max("t").alias("observed_t"), F.count(F.lit(1)).alias("n"))
    now = t.agg(F.max("t").alias("now_t"))
    f = T.freshness(scalar_join(latest, now), F.col("now_t"), "observed_t", 6 * H, F.col("n") > 60, F.lit(False))
    return f.groupBy("state").agg(F.count(F.lit(1)).alias("markets"))
