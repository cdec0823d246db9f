"""Queries for resampling, fits, ranking, sets, catalogs and composite studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import brier, clip, expit, log_loss, logit, rounded
from tidemark.operators import metrics as A
from tidemark.operators import models as M
from tidemark.operators import ranking as D
from tidemark.operators import resample as B
from tidemark.operators import sets as U
from tidemark.plans.oracle_text import CLIP, D as NUM, DRAW, LOGIT, LOGLOSS
from tidemark.plans.registry import query
from tidemark.plans.standins import DAY, LEDGER, R, S, SAMPLES, TICKS, ledger, micros, samples, table, ticks

H = 3600 * S
REPS = 1000


def _boot_sql(ctes: str, cluster: str, by: str, sums: dict[str, str], block: int, reps: int, source: str) -> str:
    """Clusters, slots and draws of the bootstrap as CTE text (by is '' or one column)."""
    b = f"{by}, " if by else ""
    agg = ", ".join(f"{v} AS {k}" for k, v in sums.items())
    part = f"PARTITION BY {by} " if by else ""
    tag = f"'1729|' || {'s.' + by + ' || ' if by else ''}{chr(39) + '|' + chr(39) + ' || ' if by else ''}r.rep || '|' || "
    if block == 1:
        idx = DRAW(tag + "s.i", "s.n")
    else:
        num = f"(s.i // least({block}, s.n))"
        idx = f"(({DRAW(tag + num, 's.n')} + s.i - {num} * least({block}, s.n)) % s.n)"
    on = f"c.{by} = d.{by} AND " if by else ""
    return f"""{ctes}, cl0 AS (SELECT {b}{cluster} AS cl, {agg} FROM {source} GROUP BY ALL),
cl AS (SELECT *, row_number() OVER ({part}ORDER BY cl) - 1 AS i, count(*) OVER ({part}) AS n FROM cl0),
dr AS (SELECT {'s.' + by + ', ' if by else ''}r.rep, {idx} AS j FROM cl s, range({reps}) r(rep)),
rp AS (SELECT {'d.' + by + ', ' if by else ''}d.rep, {', '.join(f'sum(c.{k}) AS {k}' for k in sums)} FROM dr d JOIN cl c ON {on}c.i = d.j GROUP BY ALL)"""


def _diff(sf_samples):
    return brier(clip(F.col("q"), 1e-6, 1 - 1e-6), F.col("y")) - brier(clip(F.col("p"), 1e-6, 1 - 1e-6), F.col("y"))


DIFF = f"(pow({CLIP('q', 1e-6, 1 - 1e-6)} - y, 2) - pow({CLIP('p', 1e-6, 1 - 1e-6)} - y, 2))"


@query("bootstrap_day_cluster", f"""
WITH {_boot_sql(SAMPLES, 'day', 'series', {'s': f'sum({DIFF})', 'm': 'count(*)'}, 1, 3000, 'samples')},
pt AS (SELECT series, sum(s) / sum(m) AS mean, count(*) AS clusters FROM cl GROUP BY 1), iv AS (SELECT series, quantile_cont(s / m, 0.025) AS lo, quantile_cont(s / m, 0.975) AS hi FROM rp GROUP BY 1)
SELECT series, clusters, {R('mean')} AS mean, {R('lo')} AS mean_low, {R('hi')} AS mean_high FROM pt JOIN iv USING (series)""")
def bootstrap_day_cluster(spark, sf):
    s = samples(spark, sf)
    out = B.cluster_bootstrap(s, ["series"], "day", _diff(s))
    return out.select("series", "clusters", *[rounded(F.col(c)).alias(c) for c in ("mean", "mean_low", "mean_high")])


@query("bootstrap_ratio", f"""
WITH {_boot_sql(LEDGER, 'day', '', {'s': "sum(CASE WHEN side = 'yes' AND quantity > 45 THEN pnl ELSE 0 END)", 'q': "sum(CASE WHEN side = 'yes' AND quantity > 45 THEN quantity ELSE 0 END)", 'c': "sum(CASE WHEN side = 'yes' AND quantity > 45 THEN cost ELSE 0 END)"}, 1, 3000, 'ledger')},
x AS (SELECT CASE WHEN q > 0 AND c > 0 THEN s / q END AS a, CASE WHEN q > 0 AND c > 0 THEN s / c END AS b FROM rp)
SELECT (SELECT count(*) FROM cl) AS clusters, (SELECT count(*) FROM cl WHERE q > 0) AS trade_days, {R('quantile_cont(a, 0.025)')} AS net_per_contract_low, {R('quantile_cont(a, 0.975)')} AS net_per_contract_high, {R('quantile_cont(b, 0.025)')} AS return_on_deployed_low, {R('quantile_cont(b, 0.975)')} AS return_on_deployed_high, count(*) FILTER (WHERE a IS NULL) AS undefined FROM x""")
def bootstrap_ratio(spark, sf):
    led = ledger(spark, sf)
    hit = (F.col("side") == "yes") & (F.col("quantity") > 45)
    z = lambda c: F.when(hit, F.col(c)).otherwise(F.lit(0))
    out = B.ratio_bootstrap(led, [], "day", z("pnl"), z("quantity"), z("cost"), reps=3000)
    cols = ["net_per_contract_low", "net_per_contract_high", "return_on_deployed_low", "return_on_deployed_high"]
    return out.select("clusters", "trade_days", *[rounded(F.col(c)).alias(c) for c in cols], F.col("net_per_contract_undefined").alias("undefined"))


@query("bootstrap_circular_block", f"""
WITH {_boot_sql("o0 AS (SELECT epoch_us(o_orderdate) // 86400000000 AS day, o_totalprice AS v FROM orders)", 'day', '', {'s': 'sum(v)', 'm': 'count(*)', 'v': 'sum(v) / count(*)', 'w': '1'}, 7, 2000, 'o0')}
SELECT (SELECT count(*) FROM cl) AS clusters, {R('(SELECT avg(v) FROM cl)', 3)} AS mean, {R('quantile_cont(v / w, 0.025)', 3)} AS mean_low, {R('quantile_cont(v / w, 0.975)', 3)} AS mean_high FROM rp""")
def bootstrap_circular_block(spark, sf):
    o = table(spark, sf, "orders").select(F.floor(micros("o_orderdate") / DAY).cast("long").alias("day"), "o_totalprice")
    out = B.day_mean_block_bootstrap(o, [], "day", F.col("o_totalprice"))
    return out.select("clusters", *[rounded(F.col(c), 3).alias(c) for c in ("mean", "mean_low", "mean_high")])


@query("bootstrap_bonferroni", f"""
WITH {_boot_sql(SAMPLES, 'day', '', {'s': f'sum({DIFF})', 'm': 'count(*)'}, 7, 2000, 'samples')}
SELECT {R('quantile_cont(s / m, 0.005)')} AS mean_low, {R('quantile_cont(s / m, 0.995)')} AS mean_high FROM rp""")
def bootstrap_bonferroni(spark, sf):
    s = samples(spark, sf)
    out = B.cluster_bootstrap(s, [], "day", _diff(s), reps=2000, block=7, comparisons=5)
    return out.select(*[rounded(F.col(c)).alias(c) for c in ("mean_low", "mean_high")])


@query("bootstrap_crps_blocks", f"""
WITH {_boot_sql(TICKS, 't // 86400000000', '', {'s': 'sum(abs(value - k))', 'm': 'count(*)', 'v': 'sum(abs(value - k)) / count(*)', 'w': '1'}, 7, 3000, 'ticks')}
SELECT (SELECT count(*) FROM cl) AS clusters, {R('(SELECT avg(v) FROM cl)')} AS mean, {R('quantile_cont(v / w, 0.025)')} AS mean_low, {R('quantile_cont(v / w, 0.975)')} AS mean_high FROM rp""")
def bootstrap_crps_blocks(spark, sf):
    t = ticks(spark, sf).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))
    out = B.day_mean_block_bootstrap(t, [], "day", F.abs(F.col("value") - F.col("k")), reps=3000)
    return out.select("clusters", *[rounded(F.col(c)).alias(c) for c in ("mean", "mean_low", "mean_high")])


@query("bootstrap_stratified_month", f"""
WITH {_boot_sql("o0 AS (SELECT o_orderpriority AS st, year(o_orderdate) * 12 + month(o_orderdate) AS mth, o_totalprice / 1000.0::DOUBLE AS v FROM orders)", 'mth', 'st', {'s': 'sum(v)', 'q': 'sum(v * v)', 'm': 'count(*)'}, 1, 2000, 'o0')},
al AS (SELECT st, s, q, m FROM rp UNION ALL SELECT NULL, sum(s), sum(q), sum(m) FROM rp GROUP BY rep), x AS (SELECT st, s / m AS mean, sqrt(greatest(0, (q - s * (s / m)) / (m - 1))) AS sd FROM al)
SELECT st, {R('quantile_cont(mean, 0.025)', 5)} AS mean_low, {R('quantile_cont(mean, 0.975)', 5)} AS mean_high, {R('quantile_cont(sd, 0.025)', 5)} AS sd_low, {R('quantile_cont(sd, 0.975)', 5)} AS sd_high, {R('stddev_samp(sd)', 5)} AS sd_se FROM x GROUP BY 1""")
def bootstrap_stratified_month(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("st"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("mth"), (F.col("o_totalprice") / F.lit(1000.0)).alias("v"))
    out = B.stratified_bootstrap(o, "st", "mth", F.col("v"))
    return out.select("st", *[rounded(F.col(c), 5).alias(c) for c in ("mean_low", "mean_high", "sd_low", "sd_high", "sd_se")])


MEMBERS = f"""dd AS (SELECT day, count(*) OVER () AS n, row_number() OVER (ORDER BY day) - 1 AS i, coalesce(lead(day) OVER (ORDER BY day) = day + 1, false) AS st FROM (SELECT DISTINCT day FROM samples)),
ss AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS ns FROM dd WHERE st),
sl AS (SELECT i, m AS member, {DRAW("'1729|' || m || '|' || (i // 2)", "(SELECT max(ns) FROM ss)")} AS k FROM dd, range(32) r(m)),
mb AS (SELECT CAST(member AS INTEGER) AS member, ss.day + i % 2 AS day, count(*) AS copies FROM sl JOIN ss USING (k) GROUP BY 1, 2)"""


@query("block_resample_members", f"""
WITH {SAMPLES}, {MEMBERS} SELECT member, day, copies FROM mb""")
def block_resample_members(spark, sf):
    return B.block_members(samples(spark, sf).select("day").distinct(), "day", members=32).select("member", "day", "copies")


@query("expected_block_copies", f"""
WITH {SAMPLES}, {MEMBERS}, x AS (SELECT day, n, CASE WHEN st THEN 1 ELSE 0 END AS s, coalesce(lag(CASE WHEN st THEN 1 ELSE 0 END) OVER (ORDER BY day), 0) AS p FROM dd)
SELECT day, {R('((s + p) * (n // 2) + s * (n % 2)) / (SELECT max(ns) FROM ss)::DOUBLE')} AS expected FROM x""")
def expected_block_copies(spark, sf):
    return B.expected_copies(samples(spark, sf).select("day"), "day").select("day", rounded(F.col("expected")).alias("expected"))


@query("sparse_suppression", f"""
WITH {LEDGER}, g AS (SELECT o_custkey, count(*) AS entries, count(DISTINCT day) AS days_traded, sum(pnl) AS pnl FROM ledger GROUP BY 1)
SELECT o_custkey, entries, days_traded, CASE WHEN entries >= 30 AND days_traded >= 10 THEN {R('pnl', 2)} END AS pnl_low, CASE WHEN entries < 30 OR days_traded < 10 THEN 'insufficient_trade_evidence' END AS status FROM g""")
def sparse_suppression(spark, sf):
    g = ledger(spark, sf).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("day").alias("days_traded"), F.sum("pnl").alias("pnl_low"))
    return B.suppress_sparse(g.withColumn("pnl_low", rounded(F.col("pnl_low"), 2)), ["pnl_low"])


def newton_sql(source: str, by: str, xs: list[str], l2: float, steps: int = 8, weight: str = "1.0::DOUBLE") -> str:
    """Unrolled two-coefficient Newton iteration of the offset model as CTE text: wN(by, a, b)."""
    x, z = xs
    out = [f"de AS (SELECT {by} AS g, {LOGIT('p')} AS o, CAST(y AS DOUBLE) AS y, {weight} AS w, {x} AS x1, {z} AS x2 FROM {source})",
           "w0 AS (SELECT DISTINCT g, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM de)"]
    for i in range(steps):
        out.append(f"""gs{i} AS (SELECT d.g, max(c.a) AS a, max(c.b) AS b, sum(w) AS n, sum(w * (q - y) * x1) AS g1, sum(w * (q - y) * x2) AS g2, sum(w * q * (1 - q) * x1 * x1) AS h11, sum(w * q * (1 - q) * x1 * x2) AS h12, sum(w * q * (1 - q) * x2 * x2) AS h22
 FROM (SELECT de.*, 1 / (1 + exp(-(o + c.a * x1 + c.b * x2))) AS q FROM de JOIN w{i} c ON c.g = de.g) d JOIN w{i} c ON c.g = d.g GROUP BY d.g),
t{i} AS (SELECT g, a, b, g1 / n + {NUM(2 * l2)} * a AS u, g2 / n + {NUM(2 * l2)} * b AS v, h11 / n + {NUM(2 * l2)} AS p, h12 / n AS q, h22 / n + {NUM(2 * l2)} AS r FROM gs{i}),
w{i + 1} AS (SELECT g, a - (r * u - q * v) / (p * r - q * q) AS a, b - (p * v - q * u) / (p * r - q * q) AS b FROM t{i})""")
    return ",\n".join(out)


ZS = "st AS (SELECT avg(value) AS mv, greatest(1e-6, stddev_pop(value)) AS sv, avg(spread) AS ms, greatest(1e-6, stddev_pop(spread)) AS ss FROM samples), zz AS (SELECT samples.*, greatest(-5.0::DOUBLE, least(5.0::DOUBLE, (value - mv) / sv)) AS z_value, greatest(-5.0::DOUBLE, least(5.0::DOUBLE, (spread - ms) / ss)) AS z_spread FROM samples, st)"


def _standardized(spark, sf):
    s = samples(spark, sf)
    return M.standardize(s, M.moments(s, [], ["value", "spread"]), [], ["value", "spread"])


@query("offset_logistic_fit", f"""
WITH {SAMPLES}, {ZS}, {newton_sql('zz', '0', ['z_value', 'z_spread'], 0.1)}
SELECT 'z_value' AS feature, {R('a', 5)} AS coef FROM w8 UNION ALL SELECT 'z_spread', {R('b', 5)} FROM w8""")
def offset_logistic_fit(spark, sf):
    c = M.fit_market_offset(_standardized(spark, sf), [], ["z_value", "z_spread"])
    return c.select("feature", rounded(F.col("coef"), 5).alias("coef"))


@query("market_recalibration_fit", f"""
WITH {SAMPLES}, im AS (SELECT *, 1.0::DOUBLE AS one, {LOGIT('p')} AS market FROM samples), {newton_sql('im', '0', ['one', 'market'], 0.1)}
SELECT 'intercept' AS feature, {R('a', 5)} AS coef FROM w8 UNION ALL SELECT 'market', {R('b', 5)} FROM w8""")
def market_recalibration_fit(spark, sf):
    """Intercept and slope on the market's own logit, no further features."""
    s = samples(spark, sf)
    c = M.fit_market_offset(s.withColumn("market", logit(F.col("p"), 1e-6)), [], ["market"], intercept=True)
    return c.select("feature", rounded(F.col("coef"), 5).alias("coef"))


@query("offset_logistic_many", f"""
WITH {SAMPLES}, {MEMBERS}, {ZS}, jn AS (SELECT zz.*, member, copies FROM zz JOIN mb USING (day)), {newton_sql('jn', 'member', ['z_value', 'z_spread'], 0.1, weight='CAST(copies AS DOUBLE)')}
SELECT g AS member, 'z_value' AS feature, {R('a', 5)} AS coef FROM w8 UNION ALL SELECT g, 'z_spread', {R('b', 5)} FROM w8""")
def offset_logistic_many(spark, sf):
    z = _standardized(spark, sf)
    members = B.block_members(z.select("day").distinct(), "day", members=32)
    c = M.fit_market_offset(z.join(members, "day"), ["member"], ["z_value", "z_spread"], weight="copies")
    return c.select("member", "feature", rounded(F.col("coef"), 5).alias("coef"))


@query("ensemble_quantiles", f"""
WITH {SAMPLES}, {MEMBERS}, {ZS}, jn AS (SELECT zz.*, member, copies FROM zz JOIN mb USING (day)), {newton_sql('jn', 'member', ['z_value', 'z_spread'], 0.1, weight='CAST(copies AS DOUBLE)')},
pr AS (SELECT event_id, p, {CLIP('1 / (1 + exp(-(' + LOGIT('p') + ' + a * z_value + b * z_spread)))', 1e-6, 1 - 1e-6)} AS f FROM zz, w8),
e AS (SELECT event_id, max(p) AS market, avg(f) AS m, quantile_cont(f, 0.05) AS lo, quantile_cont(f, 0.95) AS hi FROM pr GROUP BY 1)
SELECT event_id, {R('m', 4)} AS mean, {R('lo', 4)} AS low, {R('hi', 4)} AS high, {R('CASE WHEN m >= market THEN greatest(market, least(m, lo)) ELSE least(market, greatest(m, hi)) END', 4)} AS guarded FROM e""")
def ensemble_quantiles(spark, sf):
    z = _standardized(spark, sf).select("event_id", "day", "p", "y", "z_value", "z_spread")
    members = B.block_members(z.select("day").distinct(), "day", members=32)
    coef = M.fit_market_offset(z.join(members, "day"), ["member"], ["z_value", "z_spread"], weight="copies")
    # Members are a literal list: exploding them keeps the scoring join on one small keyed frame.
    rows = z.withColumn("member", F.explode(F.array(*[F.lit(i) for i in range(32)])))
    out = M.ensemble(M.score_offset(rows, coef, ["member"], ["z_value", "z_spread"]), ["event_id"], "predicted", "p")
    return out.select("event_id", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "low", "high", "guarded")])


@query("select_weight_grid", f"""
WITH {SAMPLES}, g AS (SELECT s.*, w, CASE WHEN w = 0 THEN p ELSE w * q + (1 - w) * p END AS f FROM samples s, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(w)),
d AS (SELECT series, w, day, avg({LOGLOSS('f', 'y', 1e-8)}) AS ll, avg(pow(f - y, 2)) AS b FROM g GROUP BY 1, 2, 3), s AS (SELECT series, w, avg(ll) AS ll, avg(b) AS b FROM d GROUP BY 1, 2),
z AS (SELECT s.*, m.ll AS l0, m.b AS b0 FROM s JOIN s m ON m.series = s.series AND m.w = 0), e AS (SELECT * FROM z WHERE w = 0 OR (ll < l0 - 1e-8 AND b <= b0))
SELECT series, arg_min(w, (CASE WHEN w = 0 THEN ll - 1e-8 ELSE ll END, w)) AS weight, {R('arg_min(ll, (CASE WHEN w = 0 THEN ll - 1e-8 ELSE ll END, w))')} AS log_loss FROM e GROUP BY 1""")
def select_weight_grid(spark, sf):
    out = M.select_weight(samples(spark, sf), ["series"], "q", "p", "y", "day", [0, 0.1, 0.25, 0.5, 0.75, 1])
    return out.select("series", "weight", rounded(F.col("log_loss")).alias("log_loss"))


@query("select_penalty", f"""
WITH {SAMPLES}, s AS (SELECT series, pen, avg(pow(y - p - (q - p) * pen, 2)) AS ll FROM samples, (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE)) v(pen) GROUP BY 1, 2)
SELECT series, arg_min(pen, (ll, -pen)) AS penalty FROM s GROUP BY 1""")
def select_penalty(spark, sf):
    from tidemark.operators.temporal import scenario_grid

    g = scenario_grid(samples(spark, sf).select("series", "y", "p", "q"), penalty=[0.01, 0.1, 1.0])
    err = F.col("y") - F.col("p") - (F.col("q") - F.col("p")) * F.col("penalty")
    return M.select_penalty(g.groupBy("series", "penalty").agg(F.avg(err * err).alias("log_loss")), ["series"])


@query("ablation_variants", f"""
WITH {SAMPLES}, {ZS}, v AS (SELECT zz.* EXCLUDE (z_value, z_spread), vr, CASE WHEN vr IN ('full', 'value') THEN z_value ELSE 0 END AS z_value, CASE WHEN vr IN ('full', 'spread') THEN z_spread ELSE 0 END AS z_spread FROM zz, (VALUES ('full'), ('value'), ('spread')) t(vr)),
{newton_sql('v', 'vr', ['z_value', 'z_spread'], 0.1)}, pr AS (SELECT vr, y, {CLIP('1 / (1 + exp(-(' + LOGIT('p') + ' + a * z_value + b * z_spread)))', 1e-6, 1 - 1e-6)} AS f FROM v JOIN w8 ON g = vr)
SELECT vr AS variant, {R('avg(' + LOGLOSS('f', 'y') + ')', 5)} AS log_loss, {R('avg(pow(f - y, 2))', 5)} AS brier, count(*) AS events FROM pr GROUP BY 1""")
def ablation_variants(spark, sf):
    from tidemark.plans.studies import ablation

    out = ablation(_standardized(spark, sf), ["z_value", "z_spread"], {"full": ["z_value", "z_spread"], "value": ["z_value"], "spread": ["z_spread"]})
    return out.select("variant", rounded(F.col("log_loss"), 5).alias("log_loss"), rounded(F.col("brier"), 5).alias("brier"), "events")


@query("tree_score")
def tree_score(spark, sf):
    s = samples(spark, sf)
    fit = M.fit_trees(s, ["p", "spread", "value", "hours_left"])
    from pyspark.ml.functions import vector_to_array

    out = fit.transform(s).withColumn("f", vector_to_array("probability")[1])
    return A.binary_metrics(out, ["series"], "f", "y", "day")


@query("first_per_key", f"""
WITH {TICKS} SELECT user_id, arg_min(event_id, (t, event_id)) AS event_id, min(t) AS t FROM ticks GROUP BY 1""")
def first_per_key(spark, sf):
    return D.first_per_key(ticks(spark, sf).select("user_id", "event_id", "t"), ["user_id"], ["t", "event_id"])


@query("latest_per_key", f"""
WITH {TICKS} SELECT user_id, event_type, arg_max(event_id, (t, event_id)) AS event_id, max(t) AS t FROM ticks GROUP BY 1, 2""")
def latest_per_key(spark, sf):
    return D.latest_per_key(ticks(spark, sf).select("user_id", "event_type", "event_id", "t"), ["user_id", "event_type"], ["t", "event_id"])


@query("topn_per_group", """
SELECT p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 4""")
def topn_per_group(spark, sf):
    out = D.top_per_group(table(spark, sf, "part"), ["p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")], 4)
    return out.select("p_type", "p_partkey", "rank")


@query("one_per_hour", f"""
WITH {TICKS} SELECT event_type, t // 3600000000 AS hour, arg_min(event_id, (t, event_id)) AS event_id FROM ticks GROUP BY 1, 2""")
def one_per_hour(spark, sf):
    return D.one_per_hour(ticks(spark, sf).select("event_type", "event_id", "t"), ["event_type"], "t", H, "event_id").select("event_type", "hour", "event_id")


@query("ranked_candidates", f"""
WITH {SAMPLES} SELECT event_id FROM samples WHERE series <> 'error' ORDER BY NOT (series IN ('click', 'view') AND hours_left BETWEEN 5 AND 25), NOT (bid > 0 AND bid <= ask AND ask < 1), spread, close_t, event_id LIMIT 24""")
def ranked_candidates(spark, sf):
    s = samples(spark, sf).filter("series <> 'error'")
    supported = F.col("series").isin("click", "view") & F.col("hours_left").between(5, 25)
    return D.candidates(s, supported, "bid", "ask", "spread", "close_t", "event_id").select("event_id")


@query("event_order", f"""
WITH {TICKS} SELECT event_id, row_number() OVER (ORDER BY t // 3600000000, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 0 END, event_id) AS position FROM ticks""")
def event_order(spark, sf):
    kind = F.create_map(*[x for p in (("signup", "market"), ("purchase", "outcome"), ("click", "book"), ("view", "prediction")) for x in (F.lit(p[0]), F.lit(p[1]))])
    t = ticks(spark, sf).select("event_id", F.floor(F.col("t") / H).cast("long").alias("hr"), kind[F.col("event_type")].alias("kind"))
    return D.event_order(t, "hr", "kind", ["event_id"]).select("event_id", "position")


@query("last_runs", """
SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def last_runs(spark, sf):
    return D.last_runs(table(spark, sf, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey")


@query("longest_copy", """
SELECT source, arg_max(doc_id, (n_chars, doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1""")
def longest_copy(spark, sf):
    return D.longest_copy(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id")


@query("union_sources", """
SELECT source, count(*) AS n FROM (SELECT 'customer' AS source, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY 1""")
def union_sources(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("k"))
    return U.union_sources(c, s).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("intersect_keys", """
SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def intersect_keys(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return U.key_intersection([o.filter(F.col("o_orderstatus") == x) for x in "FOP"], ["k"])


@query("except_keys", """
SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def except_keys(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return U.key_difference(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), o, ["k"])


@query("split_overlap", f"""
WITH {SAMPLES}, a AS (SELECT DISTINCT user_id FROM samples WHERE day < 19735), b AS (SELECT DISTINCT user_id FROM samples WHERE day >= 19740) SELECT count(*) AS shared FROM a JOIN b USING (user_id)""")
def split_overlap(spark, sf):
    s = samples(spark, sf)
    return U.overlap_count(s.filter("day < 19735"), s.filter("day >= 19740"), ["user_id"])
