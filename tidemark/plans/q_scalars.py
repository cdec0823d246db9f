"""Queries for scalar functions: costs, signals, probabilities, books and contract text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import books as B
from tidemark.functions import contracts as C
from tidemark.functions import money as M
from tidemark.functions import numeric as N
from tidemark.functions.numeric import rounded
from tidemark.plans.oracle_text import CLIP, LOGIT, PHI
from tidemark.plans.registry import query
from tidemark.plans.standins import R, S, SAMPLES, TICKS, debit_sql, samples, table, ticks

CENTS = "(1 + CAST(floor(l_extendedprice) AS BIGINT) % 99)"
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SIDES = f"""sd AS (SELECT *, {debit_sql('ask', '1')} AS yc, {debit_sql('1 - bid', '1')} AS nc FROM samples),
ed AS (SELECT *, {R('q - yc', 9)} AS ey, {R('1 - q - nc', 9)} AS en FROM sd)"""


def _price():
    return (F.lit(1) + F.floor("l_extendedprice").cast("long") % 99) / F.lit(100.0)


@query("fee_and_cost", f"""
SELECT {KEY}, {debit_sql(CENTS + " / 100.0::DOUBLE", "l_quantity", "l_tax")} AS cost,
 {R(debit_sql(CENTS + " / 100.0::DOUBLE", "l_quantity", "l_tax") + f" - {CENTS} * l_quantity / 100.0::DOUBLE")} AS fee FROM lineitem""")
def fee_and_cost(spark, sf):
    f = M.fee_and_cost(_price(), F.col("l_quantity"), F.col("l_tax"))
    li = table(spark, sf, "lineitem").select(*KEYS, f.alias("f"))
    return li.select(*KEYS, F.col("f.cost").cast("double").alias("cost"), rounded(F.col("f.fee").cast("double")).alias("fee"))


def _fill_sql(step: int) -> str:
    """Whole-number form: price in cents, everything in millionths of a dollar, rounded up to ``step`` millionths."""
    total = f"({CENTS} * CAST(l_quantity AS BIGINT) * 10000 + 7 * CAST(l_quantity AS BIGINT) * {CENTS} * (100 - {CENTS}))"
    return f"(({total} + {step - 1}) // {step} / {10**6 // step}.0::DOUBLE)"


@query("single_fill_cost", f"""
SELECT {KEY}, {_fill_sql(10000)} AS cost_cent, {_fill_sql(100)} AS cost_fine FROM lineitem""")
def single_fill_cost(spark, sf):
    c = lambda g: M.single_fill_cost(_price(), F.col("l_quantity"), grid=g)["cost"].cast("double")
    return table(spark, sf, "lineitem").select(*KEYS, c("0.01").alias("cost_cent"), c("0.0001").alias("cost_fine"))


@query("qualify_signal", f"""
WITH {SAMPLES}, {SIDES}
SELECT event_id, CASE WHEN greatest(ey, en) >= 0.04 THEN CASE WHEN ey >= en THEN 'yes' ELSE 'no' END END AS side, CASE WHEN greatest(ey, en) >= 0.04 THEN {R('greatest(ey, en)')} END AS edge FROM ed""")
def qualify_signal(spark, sf):
    s = samples(spark, sf).select("event_id", M.qualify_signal(F.col("q"), F.col("bid"), F.col("ask")).alias("s"))
    return s.select("event_id", F.col("s.side").alias("side"), rounded(F.col("s.edge")).alias("edge"))


@query("side_features", f"""
WITH {SAMPLES}, x AS (SELECT *, unnest(['yes', 'no']) AS side FROM samples),
y AS (SELECT *, CASE WHEN side = 'yes' THEN q ELSE 1 - q END AS win, least(1.0::DOUBLE, CASE WHEN side = 'yes' THEN ask ELSE 1 - bid END + 0.02) AS paid FROM x)
SELECT event_id, side, {R('win')} AS win, {R('win - ' + debit_sql('paid', '1'))} AS edge, {debit_sql('paid', '1')} AS cost, abs(k - 50.0::DOUBLE) AS distance FROM y""")
def side_features(spark, sf):
    from tidemark.operators.models import gate_rows

    s = samples(spark, sf).withColumn("dist", F.col("k") - F.lit(50.0)).withColumn("vol", F.lit(1.0))
    g = gate_rows(s, "q", "dist", "vol")
    won = F.when(F.col("side") == "yes", F.col("y")).otherwise(1 - F.col("y"))
    return g.select("event_id", "side", rounded(F.col("win")).alias("win"), rounded(F.col("edge")).alias("edge"),
                    rounded(won - F.col("net"), 2).alias("cost"), F.col("gate_distance").alias("distance"))


@query("max_slippage", f"""
WITH {SAMPLES}, b AS (SELECT event_id, q, CAST(round(ask * 10000) AS BIGINT) AS t0 FROM samples)
SELECT event_id, (SELECT max(i) FROM range(0, 10001) r(i) WHERE b.t0 + i <= 10000 AND
  ((b.t0 + i) * 1000000 + 7 * (b.t0 + i) * (10000 - b.t0 - i) + 99999999) // 100000000 * 10000000 <= CAST(round(b.q * 1000000000) AS BIGINT) - 40000000) / 10000.0::DOUBLE AS slippage FROM b""")
def max_slippage(spark, sf):
    s = samples(spark, sf)
    return s.select("event_id", rounded(M.max_slippage(F.col("q"), F.col("ask")), 4).alias("slippage"))


@query("board_edge", f"""
WITH {SAMPLES}, m AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL ELSE q END AS mp FROM samples)
SELECT event_id, {R('greatest(coalesce(mp, (bid + ask) / 2) - ask, 1 - coalesce(mp, (bid + ask) / 2) - (1 - bid))')} AS edge FROM m""")
def board_edge(spark, sf):
    model = F.when(F.col("k") % 5 != 0, F.col("q"))
    return samples(spark, sf).select("event_id", rounded(M.board_edge(model, F.col("bid"), F.col("ask"))).alias("edge"))


@query("probability_blends", f"""
WITH {SAMPLES}, m AS (SELECT *, CASE WHEN k % 7 = 0 THEN NULL ELSE q END AS mp FROM samples)
SELECT event_id, {R('CASE WHEN mp IS NULL THEN p ELSE 0.25::DOUBLE * mp + 0.75::DOUBLE * p END')} AS linear,
 {R('CASE WHEN mp IS NULL THEN p ELSE 1 / (1 + exp(-(0.25::DOUBLE * ' + LOGIT('mp') + ' + 0.75::DOUBLE * ' + LOGIT('p') + '))) END')} AS logodds,
 {R('CASE WHEN mp IS NULL THEN p ELSE 1 / (1 + exp(-(' + LOGIT('p') + ' + 0.5::DOUBLE * ' + CLIP('(' + LOGIT('mp') + ' - ' + LOGIT('p') + ')', -4.0, 4.0) + '))) END')} AS anchored, {R('p')} AS zero FROM m""")
def probability_blends(spark, sf):
    model, p = F.when(F.col("k") % 7 != 0, F.col("q")), F.col("p")
    return samples(spark, sf).select(
        "event_id", rounded(N.blend_linear(model, p, 0.25)).alias("linear"), rounded(N.blend_logodds(model, p, 0.25)).alias("logodds"),
        rounded(N.anchored_logodds(model, p, 0.5)).alias("anchored"), rounded(N.blend_linear(model, p, 0)).alias("zero"))


@query("normal_interval_prob", f"""
WITH {TICKS}, x AS (SELECT event_id, value AS mu, 1.0::DOUBLE + k / 10.0::DOUBLE AS sd, CASE WHEN k % 10 = 0 THEN NULL ELSE k::DOUBLE END AS lo, CASE WHEN k % 10 = 9 THEN NULL ELSE k + 5.0::DOUBLE END AS hi FROM ticks)
SELECT event_id, {R('greatest(0, least(1, coalesce(' + PHI('((hi - mu) / sd)') + ', 1) - coalesce(' + PHI('((lo - mu) / sd)') + ', 0)))')} AS prob FROM x""")
def normal_interval_prob(spark, sf):
    k = F.col("k").cast("double")
    lo, hi = F.when(F.col("k") % 10 != 0, k), F.when(F.col("k") % 10 != 9, k + 5.0)
    return ticks(spark, sf).select("event_id", rounded(N.interval_prob(F.col("value"), F.lit(1.0) + k / 10.0, lo, hi)).alias("prob"))


@query("product_interval_prob", f"""
WITH {TICKS}, x AS (SELECT event_id, value AS mu, 4.0::DOUBLE AS sd, CASE WHEN k % 3 = 0 THEN NULL ELSE k::DOUBLE END AS ob, CASE WHEN k % 10 = 0 THEN NULL ELSE k - 4.0::DOUBLE END AS lo, CASE WHEN k % 10 = 9 THEN NULL ELSE k + 4.0::DOUBLE END AS hi FROM ticks),
c AS (SELECT event_id, CASE WHEN hi IS NULL THEN 1.0 ELSE {PHI('((hi - mu) / sd)')} * CASE WHEN ob IS NULL THEN 1.0 ELSE {PHI('((hi - (ob + 0.5)) / 1.5)')} END END AS ch,
 CASE WHEN lo IS NULL THEN 0.0 ELSE {PHI('((lo - mu) / sd)')} * CASE WHEN ob IS NULL THEN 1.0 ELSE {PHI('((lo - (ob + 0.5)) / 1.5)')} END END AS cl FROM x)
SELECT event_id, {R('greatest(0, least(1, ch - cl))')} AS prob FROM c""")
def product_interval_prob(spark, sf):
    k = F.col("k").cast("double")
    ob = F.when(F.col("k") % 3 != 0, k)
    lo, hi = F.when(F.col("k") % 10 != 0, k - 4.0), F.when(F.col("k") % 10 != 9, k + 4.0)
    d = N.with_product_interval_prob(ticks(spark, sf), F.col("value"), F.lit(4.0), ob, F.lit(0.5), F.lit(1.5), lo, hi)
    return d.select("event_id", rounded(F.col("prob")).alias("prob"))


@query("diffusion_prob", f"""
WITH part_ AS (SELECT p_partkey, p_retailprice AS spot, 900.0::DOUBLE + p_size AS strike, 0.01::DOUBLE + p_size / 5000.0::DOUBLE AS sg, 2.0::DOUBLE + p_size AS mins FROM part),
z AS (SELECT *, ln(spot / strike) / (sg * sqrt(mins)) AS z FROM part_)
SELECT p_partkey, {R(CLIP(PHI('z'), 1e-6, 1 - 1e-6))} AS prob, {R('z * sqrt(mins / (mins - 2.0::DOUBLE / 3.0::DOUBLE))')} AS average_z FROM z""")
def diffusion_prob(spark, sf):
    spot, size = F.col("p_retailprice"), F.col("p_size")
    strike, sigma, minutes = F.lit(900.0) + size, F.lit(0.01) + size / 5000.0, F.lit(2.0) + size
    z = F.log(spot / strike) / (sigma * F.sqrt(minutes))
    return table(spark, sf, "part").select("p_partkey", rounded(N.diffusion_prob(spot, strike, sigma, minutes)).alias("prob"), rounded(N.average_z(z, minutes)).alias("average_z"))


def _label():
    kind = F.col("p_size") % 4
    lo = F.col("p_size").cast("string")
    return (F.when(kind == 0, F.concat(lo, F.lit("°F or below"))).when(kind == 1, F.concat(lo, F.lit("–"), (F.col("p_size") + 1).cast("string"), F.lit("°F")))
            .when(kind == 2, F.concat(F.lit("−"), lo, F.lit("°F or higher"))).otherwise(F.concat(lo, F.lit(" degrees"))))


@query("bracket_parse", """
SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN p_size - 0.5::DOUBLE WHEN p_size % 4 = 2 THEN -p_size - 0.5::DOUBLE END AS lower,
 CASE WHEN p_size % 4 = 0 THEN p_size + 0.5::DOUBLE WHEN p_size % 4 = 1 THEN p_size + 1.5::DOUBLE END AS upper, p_size % 4 <> 3 AS parsed FROM part""")
def bracket_parse(spark, sf):
    b = table(spark, sf, "part").select("p_partkey", C.parse_bracket(_label()).alias("b"))
    return b.select("p_partkey", F.col("b.lower").alias("lower"), F.col("b.upper").alias("upper"), F.col("b").isNotNull().alias("parsed"))


@query("strike_bounds", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size - 0.5::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE END AS lower, CASE p_size % 4 WHEN 0 THEN p_size + 2.5::DOUBLE WHEN 2 THEN p_size + 1.5::DOUBLE END AS upper FROM part""")
def strike_bounds(spark, sf):
    i = F.col("p_size") % 4
    kind = F.when(i == 0, "between").when(i == 1, "greater").when(i == 2, "less").otherwise("custom")
    floor, cap = F.col("p_size").cast("double"), F.col("p_size") + F.lit(2.0)
    b = table(spark, sf, "part").select("p_partkey", C.strike_bounds(kind, floor, cap).alias("b"))
    return b.select("p_partkey", F.col("b.lower").alias("lower"), F.col("b.upper").alias("upper"))


@query("event_ticker_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS event_day, 'S' || (o_orderkey % 4) AS series, CAST(o_orderdate < TIMESTAMP '2000-01-01' AS BOOLEAN) AS before_2000 FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
UNION ALL SELECT o_orderkey, NULL, 'S' || (o_orderkey % 4), true FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'""")
def event_ticker_dates(spark, sf):
    o = table(spark, sf, "orders")
    before = F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    part = F.when(before, F.lit("nodate")).otherwise(F.upper(F.date_format("o_orderdate", "yyMMMdd")))
    ticker = F.concat(F.lit("S"), (F.col("o_orderkey") % 4).cast("string"), F.lit("-"), part, F.lit("-T70"))
    return o.select("o_orderkey", C.event_date(ticker).cast("string").alias("event_day"), C.series_of(ticker).alias("series"), before.alias("before_2000"))


@query("metar_parse", f"""
WITH {TICKS} SELECT event_id, CASE WHEN k % 5 <> 0 THEN {R("(CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END * (k * 3) / 10.0::DOUBLE) * 9 / 5 + 32")} END AS max_6h, k % 11 = 0 AS correction FROM ticks""")
def metar_parse(spark, sf):
    k = F.col("k")
    remark = F.when(k % 5 != 0, F.concat(F.lit(" RMK AO2 1"), (k % 2).cast("string"), F.lpad((k * 3).cast("string"), 3, "0"), F.lit(" 20011"))).otherwise(F.lit(" RMK AO2"))
    text = F.concat(F.lit("KNYC 011251Z "), F.when(k % 11 == 0, F.lit("COR ")).otherwise(F.lit("")), F.lit("10SM CLR"), remark)
    return ticks(spark, sf).select("event_id", rounded(C.metar_max6h(text)).alias("max_6h"), C.is_correction(text).alias("correction"))


@query("category_rules", """
WITH t AS (SELECT doc_id, lower(text || ' ' || 'D' || doc_id || ' ' || source) AS x, lang FROM documents)
SELECT doc_id, CASE WHEN lang = 'de' THEN NULL WHEN contains(x, 'mention') OR contains(x, 'say during') THEN 'mentions'
 WHEN contains(x, 'number of posts') OR contains(x, 'post count') OR contains(x, 'tweets') OR contains(x, 'how many posts') THEN 'posts'
 WHEN lang = 'fr' THEN CASE WHEN doc_id % 2 = 0 THEN 'weather' ELSE 'climate' END
 WHEN contains(x, 'tsa') OR contains(x, 'gas price') OR contains(x, 'inflation') OR contains(x, 'cpi') OR contains(x, 'gdp') OR contains(x, 'jobs report') THEN 'economics'
 WHEN contains(x, 'box office') OR contains(x, 'rotten tomatoes') OR contains(x, 'spotify') OR contains(x, 'billboard') THEN 'entertainment' END AS category FROM t""")
def category_rules(spark, sf):
    d = table(spark, sf, "documents")
    cats = F.when(F.col("lang") == "de", F.array(F.lit("Sports"))).when(F.col("lang") == "fr", F.array(F.lit("Climate and Weather")))
    freq = F.when(F.col("doc_id") % 2 == 0, "daily").otherwise("annual")
    ticker = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    return d.select("doc_id", C.category_of(F.col("text"), ticker, F.array("source"), cats, freq).alias("category"))


@query("reference_parse", r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/#?]+)', 1) AS host, string_split(trim(regexp_extract(url, '^https?://[^/#?]+(/[^?#]*)?', 1), '/'), '/') AS parts FROM pages)
SELECT page_id, CASE WHEN scheme = 'https' AND (host LIKE '%.example.com') AND len(parts) BETWEEN 2 AND 4 AND parts[1] = 'en' AND regexp_matches(upper(CASE WHEN len(parts) = 4 THEN parts[4] ELSE parts[2] END), '^[A-Z0-9][A-Z0-9_.-]{0,119}$')
  THEN upper(CASE WHEN len(parts) = 4 THEN parts[4] ELSE parts[2] END) END AS ticker FROM u""")
def reference_parse(spark, sf):
    p = table(spark, sf, "pages")
    # The allowed hosts are a parameter; here every .example.com host is allowed by rewriting it to one name first.
    url = F.regexp_replace("url", r"^(https?)://[^/#?]+\.example\.com", "$1://markets.example.com")
    return p.select("page_id", C.parse_reference(url, ["markets.example.com"], root="en").alias("ticker"))


@query("epoch_and_duration", f"""
WITH {TICKS} SELECT event_id, CASE k % 3 WHEN 0 THEN t // 1000000 WHEN 1 THEN t // 1000000 END AS seconds,
 CASE WHEN k % 4 = 3 THEN NULL ELSE (k % 3) * 86400 + (k % 24) * 3600 + CASE WHEN k % 4 = 1 THEN 1800 ELSE 0 END END AS duration FROM ticks""")
def epoch_and_duration(spark, sf):
    sec, k = F.floor(F.col("t") / S).cast("long"), F.col("k")
    raw = F.when(k % 3 == 0, sec * 1000).when(k % 3 == 1, sec * 1_000_000).otherwise(sec)
    text = F.when(k % 4 == 3, F.lit("one hour")).otherwise(F.concat(
        F.lit("P"), (k % 3).cast("string"), F.lit("DT"), (k % 24).cast("string"), F.lit("H"), F.when(k % 4 == 1, F.lit("30M")).otherwise(F.lit(""))))
    return ticks(spark, sf).select("event_id", C.epoch_seconds(raw).alias("seconds"), C.iso_duration_seconds(text).alias("duration"))


def _book_json(t):
    k = F.col("k")
    lv = lambda price, qty: F.array(price.cast("decimal(6,4)").cast("string"), qty.cast("string"))
    yes = F.when(k % 6 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(lv(k / 200, k % 13), lv(k / 200 - F.lit(0.0), F.lit(0)), lv(k / 250, k + 1)))
    no = F.when(k % 7 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(lv((100 - k) / 250, k % 5 + 1), lv((100 - k) / 200, k % 4)))
    return F.to_json(F.struct(yes.alias("yes"), no.alias("no")))


@query("book_from_json", f"""
WITH {TICKS}, b AS (SELECT event_id, k,
 CASE WHEN k % 6 = 0 THEN NULL WHEN k % 13 > 0 THEN k / 200.0::DOUBLE ELSE k / 250.0::DOUBLE END AS yb,
 CASE WHEN k % 7 = 0 THEN NULL WHEN k % 4 > 0 THEN (100 - k) / 200.0::DOUBLE ELSE (100 - k) / 250.0::DOUBLE END AS nb FROM ticks)
SELECT event_id, {R('(yb + 1 - nb) / 2', 4)} AS mid, {R('yb', 4)} AS bid, {R('1 - nb', 4)} AS ask FROM b""")
def book_from_json(spark, sf):
    from tidemark.sources.market import parse_books

    t = ticks(spark, sf)
    books = parse_books(t.select("event_id", _book_json(t).alias("value")), "value")
    q = books.select("event_id", B.book_mid(F.col("yes"), F.col("no")).cast("double").alias("mid"), B.best(F.col("yes")).cast("double").alias("bid"), (F.lit(1) - B.best(F.col("no"))).cast("double").alias("ask"))
    return q.select("event_id", *[rounded(F.col(c), 4).alias(c) for c in ("mid", "bid", "ask")])


@query("quote_bounds", f"""
WITH {TICKS}, b AS (SELECT event_id, k, CASE WHEN k % 3 = 0 THEN NULL ELSE k / 200.0::DOUBLE END AS bid, CASE WHEN k % 4 = 0 THEN NULL ELSE k / 100.0::DOUBLE END AS ask FROM ticks)
SELECT event_id, coalesce(bid, 0) AS bid, coalesce(ask, 1) AS ask, {R('(bid + ask) / 2')} AS p, CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN 'two_sided' WHEN bid IS NOT NULL OR ask IS NOT NULL THEN 'one_sided' ELSE 'empty' END AS quality FROM b""")
def quote_bounds(spark, sf):
    k = F.col("k")
    level = lambda p, q: F.struct(p.alias("price"), q.cast("double").alias("qty"))
    empty = F.array().cast("array<struct<price:double,qty:double>>")
    bids = F.when(k % 3 == 0, empty).otherwise(F.array(level(k / 200.0, F.lit(3)), level(k / 400.0, F.lit(9))))
    asks = F.when(k % 4 == 0, F.array(level(k / 100.0, F.lit(0)))).otherwise(F.array(level(k / 100.0, F.lit(5))))
    q = ticks(spark, sf).select("event_id", B.quote_bounds(bids, asks).alias("q"))
    return q.select("event_id", F.col("q.bid").alias("bid"), F.col("q.ask").alias("ask"), rounded(F.col("q.p")).alias("p"), F.col("q.quality").alias("quality"))


@query("complement_levels", f"""
WITH {TICKS}, l AS (SELECT event_id, unnest([k / 200.0::DOUBLE, k / 400.0::DOUBLE, k / 800.0::DOUBLE]) AS price, unnest([k / 10.0::DOUBLE, 2.5::DOUBLE, 0.5::DOUBLE]) AS qty FROM ticks),
a AS (SELECT event_id, 1 - price AS ask, CAST(floor(qty) AS BIGINT) AS qty FROM l WHERE qty >= 1)
SELECT event_id, {R('min(ask)')} AS best_ask, CAST(sum(qty) AS BIGINT) AS contracts, arg_min(qty, (ask, qty)) AS best_qty FROM a GROUP BY event_id""")
def complement_levels(spark, sf):
    k = F.col("k")
    level = lambda p, q: F.struct(p.alias("price"), q.alias("qty"))
    no = F.array(level(k / 200.0, k / 10.0), level(k / 400.0, F.lit(2.5)), level(k / 800.0, F.lit(0.5)))
    a = ticks(spark, sf).select("event_id", B.complement_levels(no).alias("a"))
    return a.select("event_id", rounded(F.col("a")[0]["price"]).alias("best_ask"),
                    F.aggregate("a", F.lit(0).cast("long"), lambda acc, x: acc + x["qty"]).alias("contracts"), F.col("a")[0]["qty"].alias("best_qty"))


@query("recommendation_labels", f"""
WITH {SAMPLES}, {SIDES}, r AS (SELECT *, k % 9 = 0 AS closed, CASE WHEN k % 8 = 0 THEN 400 ELSE 20 END AS age, k % 2 = 0 AS passed FROM ed)
SELECT event_id, CASE WHEN closed OR age > 180 THEN 'WATCH' WHEN greatest(ey, en) < 0.04 THEN 'PASS' WHEN NOT passed THEN 'WATCH' WHEN ey >= en THEN 'PAPER_YES' ELSE 'PAPER_NO' END AS action FROM r""")
def recommendation_labels(spark, sf):
    yes, no = M.side_edges(F.col("q"), F.col("bid"), F.col("ask"))
    k = F.col("k")
    a = C.recommendation(yes, no, k % 2 == 0, F.when(k % 8 == 0, 400).otherwise(20), k % 9 == 0)
    return samples(spark, sf).select("event_id", a.alias("action"))


@query("sensitivity_what_if", f"""
WITH {SAMPLES}, w AS (SELECT event_id, p, spread, hours_left, unnest(['odds_down', 'odds_up', 'tight', 'twelve_hours']) AS change FROM samples),
c AS (SELECT *, CASE change WHEN 'odds_down' THEN greatest(0.001::DOUBLE, p - 0.05::DOUBLE) WHEN 'odds_up' THEN least(0.999::DOUBLE, p + 0.05::DOUBLE) ELSE p END AS np, CASE WHEN change = 'tight' THEN 0.01::DOUBLE ELSE spread END AS ns, CASE WHEN change = 'twelve_hours' THEN 12.0::DOUBLE ELSE hours_left END AS nh FROM w)
SELECT change, count(*) AS n, {R("avg(1 / (1 + exp(-(1.05::DOUBLE * " + LOGIT('np') + " - 0.5::DOUBLE * ns + 0.01::DOUBLE * nh))) - 1 / (1 + exp(-(1.05::DOUBLE * " + LOGIT('p') + " - 0.5::DOUBLE * spread + 0.01::DOUBLE * hours_left))))")} AS mean_difference FROM c GROUP BY change""")
def sensitivity_what_if(spark, sf):
    from tidemark.functions.features import sensitivity

    model = lambda p, s, h: N.expit(F.lit(1.05) * N.logit(p) - F.lit(0.5) * s + F.lit(0.01) * h)
    out = sensitivity(samples(spark, sf).select("event_id", "p", "spread", "hours_left"), model)
    return out.groupBy("change").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("difference")).alias("mean_difference"))


@query("design_market", f"""
WITH {SAMPLES}, d AS (SELECT *, {LOGIT('p', 0.001)} AS z, {CLIP('p', 0.001, 0.999)} AS c, {LOGIT('p')} AS z6, {CLIP('p', 1e-6, 1 - 1e-6)} AS c6, hours_left / 24.0::DOUBLE AS h FROM samples)
SELECT event_id, {R('z')} AS logit, {R('c * (1 - c)')} AS variance, CAST(series = 'click' AS INTEGER)::DOUBLE AS series_click, {R('ln(c6)')} AS beta_yes, {R('-ln(1 - c6)')} AS beta_no,
 {R('h * h')} AS h2, {R('h * z6')} AS hz, {R('greatest(z6 + 4, 0)')} AS hinge_m4, {R('greatest(z6 - 2, 0)')} AS hinge_2 FROM d""")
def design_market(spark, sf):
    from tidemark.functions.features import market_design

    d = market_design(samples(spark, sf), ["click", "view", "error", "signup", "purchase"], kind="spline")
    cols = ["logit", "variance", "series_click", "beta_yes", "beta_no", "h2", "hz", "hinge_m4", "hinge_2"]
    return d.select("event_id", *[rounded(F.col(c)).alias(c) for c in cols])


@query("design_missing", f"""
WITH {TICKS}, d AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN NULL ELSE value END AS rev, CASE WHEN k % 3 = 0 THEN NULL ELSE k::DOUBLE END AS wind FROM ticks)
SELECT event_id, {R('coalesce(rev / 5.0::DOUBLE, 0)')} AS revision, CAST(rev IS NULL AS INTEGER)::DOUBLE AS revision_missing, {R('coalesce(wind / 30.0::DOUBLE, 0)')} AS wind, CAST(wind IS NULL AS INTEGER)::DOUBLE AS wind_missing FROM d""")
def design_missing(spark, sf):
    from tidemark.functions.features import with_missing

    k = F.col("k")
    d = ticks(spark, sf).select("event_id", F.when(k % 4 != 0, F.col("value")).alias("revision"), F.when(k % 3 != 0, k.cast("double")).alias("wind"))
    d = with_missing(d, {"revision": 5.0, "wind": 30.0})
    return d.select("event_id", *[rounded(F.col(c)).alias(c) for c in ("revision", "revision_missing", "wind", "wind_missing")])


@query("directional_interactions", f"""
WITH {TICKS}, d AS (SELECT event_id, (value - 50) / 50.0::DOUBLE AS a, (k - 50) / 25.0::DOUBLE AS b FROM ticks)
SELECT event_id, {R(CLIP('a * b', -5.0, 5.0))} AS product, {R(CLIP('a * (b - 1)', -5.0, 5.0))} AS signed FROM d""")
def directional_interactions(spark, sf):
    from tidemark.functions.features import product, sign_symmetric

    d = ticks(spark, sf).select("event_id", ((F.col("value") - 50) / F.lit(50.0)).alias("a"), ((F.col("k") - 50) / F.lit(25.0)).alias("b"))
    return d.select("event_id", rounded(product(F.col("a"), F.col("b"))).alias("product"), rounded(sign_symmetric(F.col("a"), F.col("b"))).alias("signed"))


@query("unit_gate", f"""
WITH {TICKS} SELECT event_id, CASE k % 3 WHEN 0 THEN {R('value')} WHEN 1 THEN {R('value * 1.8::DOUBLE + 32.0::DOUBLE')} END AS fahrenheit, CASE WHEN k % 2 = 0 THEN CAST(k + 5 AS DOUBLE) END AS max_wind FROM ticks""")
def unit_gate(spark, sf):
    k = F.col("k")
    unit = F.when(k % 3 == 0, "°F").when(k % 3 == 1, "wmoUnit:degC").otherwise("K")
    wind = F.concat(k.cast("string"), F.lit(" to "), (k + 5).cast("string"), F.when(k % 2 == 0, F.lit(" mph")).otherwise(F.lit(" km/h")))
    return ticks(spark, sf).select("event_id", rounded(C.fahrenheit(F.col("value"), unit)).alias("fahrenheit"), F.array_max(C.wind_mph(wind)).alias("max_wind"))


@query("normalized_records", """
WITH r AS (SELECT *, o_orderkey % 5 AS m FROM orders)
SELECT 'market' AS kind, CAST(sum(CASE WHEN m NOT IN (3, 4) THEN 1 ELSE 0 END) AS BIGINT) AS n, NULL::DOUBLE AS payout FROM r
UNION ALL SELECT 'market_rejected', CAST(sum(CASE WHEN m IN (3, 4) THEN 1 ELSE 0 END) AS BIGINT), NULL FROM r
UNION ALL SELECT 'outcome', CAST(count(*) AS BIGINT), CAST(sum(CASE WHEN m = 0 THEN 0.5 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) FROM r WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 7 <> 1
UNION ALL SELECT 'outcome_rejected', CAST(count(*) AS BIGINT), NULL FROM r WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 7 = 1""")
def normalized_records(spark, sf):
    o = table(spark, sf, "orders").withColumn("m", F.col("o_orderkey") % 5)
    raw = o.select(
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("ticker"), F.lit("E").alias("event_ticker"), F.lit(None).cast("string").alias("title"),
        F.when(F.col("m") == 3, "scalar").alias("market_type"), F.when((F.col("m") == 4) & (F.col("o_orderkey") % 2 == 0), "abc").when(F.col("m") == 4, "100").when(F.col("m") == 2, "1.0000").alias("notional_value_dollars"),
        F.col("o_orderdate").cast("timestamp").alias("close_time"), F.col("o_orderdate").cast("timestamp").alias("settlement_ts"),
        F.when(F.col("o_orderstatus").isin("F", "O"), "settled").otherwise("open").alias("status"), F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").alias("result"),
        F.when(F.col("o_orderkey") % 14 == 1, "7").when(F.col("o_orderkey") % 7 == 1, "n/a").when(F.col("m") == 0, "0.5000").alias("settlement_value_dollars"))
    good, bad = C.normalize_market(raw, F.col("close_time"), F.lit(None).cast("double"))
    out, unusable = C.normalize_outcome(raw, F.col("close_time"))
    row = lambda df, kind, v: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), v.alias("payout"))
    none = F.max(F.lit(None).cast("double"))
    return row(good, "market", none).unionByName(row(bad, "market_rejected", none)).unionByName(row(out, "outcome", F.sum("yes_payout"))).unionByName(row(unusable, "outcome_rejected", none))


@query("forecast_predictions", f"""
WITH {TICKS}, f AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'missing_required_field' WHEN k % 7 = 0 THEN 'invalid_distribution' END AS reason FROM ticks)
SELECT event_id, {R(PHI('((k + 5.0::DOUBLE - value) / 4.0::DOUBLE)'))} AS probability FROM f WHERE reason IS NULL""")
def forecast_predictions(spark, sf):
    k = F.col("k")
    ts = F.timestamp_micros("t")
    f = ticks(spark, sf).select(
        "event_id", F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), ts.alias("available_at"), ts.alias("made_at"), ts.alias("features_available_at"),
        (ts + F.expr("INTERVAL 1 HOUR")).alias("expires_at"), F.when(k % 10 == 0, "").otherwise("st").alias("station"), F.lit("rule").alias("rule_reference"), F.lit("m1").alias("model_id"),
        F.col("value").alias("mean"), F.when(k % 7 == 0, 0.0).otherwise(4.0).alias("std"), F.lit(None).cast("double").alias("lower"), (k + F.lit(5.0)).alias("upper"))
    good, _ = C.forecast_prediction(f)
    return good.select(F.col("provenance.event_id").alias("event_id"), rounded(F.col("probability")).alias("probability"))
