"""Queries for fitted studies, with the fits restated in SQL as unrolled Newton steps and elimination."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import metrics as A
from tidemark.operators import models as M
from tidemark.plans import studies as ST
from tidemark.plans.oracle_text import CLIP, LOGIT, LOGLOSS, PHI
from tidemark.plans.oracle_text import D as NUM
from tidemark.plans.q_quality import A as START
from tidemark.plans.q_resample import ZS, _boot_sql, _standardized
from tidemark.plans.q_scores import LADDER, full_ladders
from tidemark.plans.registry import query
from tidemark.plans.standins import DAY, R, S, SAMPLES, TICKS, debit_sql, samples, ticks
from tidemark.session import written

H = 3600 * S


def solved_sql(name: str, source: str, keys: str, k: int) -> str:
    """CTE text that eliminates the k x k system (columns m_a_b, right side r_a) of each row of ``source``: ``name`` has
    r_a, the solution. Positive definite systems need no pivoting."""
    n = range(k)
    out, last = [], source
    for j in n:
        rows = [f"m_{a}_{b}" if a == j or b <= j else f"m_{a}_{b} - m_{a}_{j} * m_{j}_{b} / m_{j}_{j} AS m_{a}_{b}" for a in n for b in n if b > j or b == a]
        right = [f"r_{a}" if a == j else f"r_{a} - m_{a}_{j} * r_{j} / m_{j}_{j} AS r_{a}" for a in n]
        out.append(f"{name}_{j} AS (SELECT {keys}, {', '.join(rows + right)} FROM {last})")
        last = f"{name}_{j}"
    out.append(f"{name} AS (SELECT {keys}, {', '.join(f'r_{a} / m_{a}_{a} AS r_{a}' for a in n)} FROM {last})")
    return ", ".join(out)


def newton_steps_sql(source: str, by: str, xs: list[str], l2: list[str], offset: str = LOGIT("p"), steps: int = 8) -> str:
    """Newton iterations of the logistic model with an offset as CTE text: w<steps>(g, c_0, c_1, ...)."""
    k = len(xs)
    n = range(k)
    z = " + ".join(["o", *[f"c_{a} * x_{a}" for a in n]])
    sums = [f"sum((q - y) * x_{a}) / count(*) AS g_{a}" for a in n] + [f"sum(q * (1 - q) * x_{a} * x_{b}) / count(*) AS h_{a}_{b}" for a in n for b in n if b >= a]
    out = [f"de AS (SELECT {by} AS g, {offset} AS o, CAST(y AS DOUBLE) AS y, {', '.join(f'CAST({x} AS DOUBLE) AS x_{a}' for a, x in enumerate(xs))} FROM {source})",
           f"w0 AS (SELECT DISTINCT g, {', '.join(f'0.0::DOUBLE AS c_{a}' for a in n)} FROM de)"]
    for i in range(steps):
        out.append(f"nw{i} AS (SELECT g, {', '.join(f'any_value(c_{a}) AS c_{a}' for a in n)}, {', '.join(sums)} FROM (SELECT de.*, {', '.join(f'c_{a}' for a in n)}, 1 / (1 + exp(-({z}))) AS q FROM de JOIN w{i} USING (g)) GROUP BY g)")
        m = [f"h_{min(a, b)}_{max(a, b)}{f' + 2 * {l2[a]}' if a == b else ''} AS m_{a}_{b}" for a in n for b in n]
        r = [f"-(g_{a} + 2 * {l2[a]} * c_{a}) AS r_{a}" for a in n]
        c = ", ".join(f"c_{a}" for a in n)
        out.append(f"t{i} AS (SELECT g, {c}, {', '.join(m + r)} FROM nw{i})")
        out.append(solved_sql(f"e{i}", f"t{i}", f"g, {c}", k))
        out.append(f"w{i + 1} AS (SELECT g, {', '.join(f'c_{a} + r_{a} AS c_{a}' for a in n)} FROM e{i})")
    return ",\n".join(out)


def _z(x: str, mean: str, sd: str) -> str:
    return CLIP(f"(({x} - {mean}) / {sd})", -5.0, 5.0)


GATE = ["win", "edge", "spread", "distance", "vol"]
MOMENTS = ", ".join(f"avg({x}) AS m_{x}, greatest(1e-6, stddev_pop({x})) AS s_{x}" for x in GATE)
_NAMES = list(enumerate(GATE))


@query("ridge_gate", f"""
WITH {SAMPLES}, x AS (SELECT *, unnest(['yes', 'no']) AS side FROM samples), y0 AS (SELECT *, CASE WHEN side = 'yes' THEN q ELSE 1 - q END AS win, least(1.0::DOUBLE, CASE WHEN side = 'yes' THEN ask ELSE 1 - bid END + 0.02) AS paid FROM x),
ga AS (SELECT side, win, win - {debit_sql('paid', '1')} AS edge, spread, abs(k - 50.0::DOUBLE) AS distance, value / 50.0::DOUBLE AS vol, CASE WHEN side = 'yes' THEN y ELSE 1 - y END - {debit_sql('paid', '1')} AS net FROM y0),
mo AS (SELECT {MOMENTS}, avg(net) AS m_net FROM ga), zg AS (SELECT net, m_net, {', '.join(f'({x} - m_{x}) / s_{x} AS z_{i}' for i, x in _NAMES)} FROM ga, mo),
sm AS (SELECT 0 AS g, {', '.join(f"sum(z_{a} * z_{b}){' + 100' if a == b else ''} AS m_{a}_{b}" for a, _ in _NAMES for b, _ in _NAMES)}, {', '.join(f'sum(z_{a} * (net - m_net)) AS r_{a}' for a, _ in _NAMES)} FROM zg),
{solved_sql('co', 'sm', 'g', 5)}, pr AS (SELECT ga.*, m_net + {' + '.join(f'r_{i} * ({x} - m_{x}) / s_{x}' for i, x in _NAMES)} AS f FROM ga, mo, co),
ac AS (SELECT *, f > 0 AND edge >= 0.04 AS accepted FROM pr)
SELECT side, count(*) AS rows, count(*) FILTER (WHERE accepted) AS accepted, {R('avg(net) FILTER (WHERE accepted)')} AS accepted_net, {R('avg(f)', 7)} AS mean_prediction, {R('stddev_pop(f)', 7)} AS prediction_sd FROM ac GROUP BY 1""")
def ridge_gate(spark, sf):
    s = samples(spark, sf).withColumn("distance", F.col("k") - F.lit(50.0)).withColumn("vol", F.col("value") / 50.0)
    features = ["win", "edge", "spread", "gate_distance", "gate_vol"]
    rows = written(M.gate_rows(s, "q", "distance", "vol").select("side", "net", *features), "gate")  # read three times
    out = M.score_linear(rows, M.fit_gate(rows, features), [], features).withColumn("accepted", (F.col("prediction") > 0) & (F.col("edge") >= 0.04))
    return out.groupBy("side").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("accepted").alias("accepted"), rounded(F.avg(F.when(F.col("accepted"), F.col("net")))).alias("accepted_net"),
        rounded(F.avg("prediction"), 7).alias("mean_prediction"), rounded(F.stddev_pop("prediction"), 7).alias("prediction_sd"))


LOGISTIC = ["p", "spread", "value", "hours_left"]
_L2 = "(SELECT 5.0::DOUBLE / count(*) FROM samples)"


@query("logistic_score", f"""
WITH {SAMPLES}, ml AS (SELECT {', '.join(f'avg({x}) AS m_{x}, stddev_samp({x}) AS s_{x}' for x in LOGISTIC)} FROM samples),
zl AS (SELECT samples.*, 1.0::DOUBLE AS one, {', '.join(f'({x} - m_{x}) / s_{x} AS z_{x}' for x in LOGISTIC)} FROM samples, ml),
{newton_steps_sql('zl', '0', ['one', *[f'z_{x}' for x in LOGISTIC]], ['0.0::DOUBLE', *[_L2] * 4], offset='0.0::DOUBLE')},
pr AS (SELECT series, day, y, 1 / (1 + exp(-(c_0 + {' + '.join(f'c_{i + 1} * z_{x}' for i, x in enumerate(LOGISTIC))}))) AS f FROM zl, w8)
SELECT series, count(*) AS events, count(DISTINCT day) AS days, {R('avg(CASE WHEN (f >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy, {R('avg(' + LOGLOSS('f', 'y') + ')', 5)} AS log_loss, {R('avg(pow(f - y, 2))', 5)} AS brier FROM pr GROUP BY 1""")
def logistic_score(spark, sf):
    s = samples(spark, sf)
    out = A.binary_metrics(M.score_logistic(s, M.fit_logistic(s, LOGISTIC), LOGISTIC), ["series"], "predicted", "y", "day")
    return out.select("series", "events", "days", rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("log_loss"), 5).alias("log_loss"), rounded(F.col("brier"), 5).alias("brier"))


FOLDS = [(START, START + 4 * DAY), (START + 4 * DAY, START + 8 * DAY), (START + 8 * DAY, START + 12 * DAY)]
ROLLING = ["value", "spread", "hours_left"]
VARIANTS = {"full": ROLLING, "value_only": ["value"]}
ROLLING_SQL = f"""{SAMPLES}, fd AS (SELECT s.*, f AS fold, CASE WHEN settled_t < a - {2 * H} THEN 'train' WHEN "at" >= a AND "at" < b THEN 'validation' END AS role FROM samples s, (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(FOLDS))}) v(f, a, b)),
mf AS (SELECT fold, {', '.join(f'avg({x}) AS m_{x}, greatest(1e-6, stddev_pop({x})) AS s_{x}' for x in ROLLING)} FROM fd WHERE role = 'train' GROUP BY 1),
sc AS (SELECT fd.* EXCLUDE (value), scenario, CASE WHEN scenario = 'late' THEN value - k % 5 ELSE value END AS value FROM fd, (VALUES ('current'), ('late')) x(scenario) WHERE role = 'validation' OR (role = 'train' AND scenario = 'current')),
zq AS (SELECT sc.*, {', '.join(f'{_z(x, "m_" + x, "s_" + x)} AS z_{i}' for i, x in enumerate(ROLLING))} FROM sc JOIN mf USING (fold)),
va AS (SELECT zq.* EXCLUDE (z_1, z_2), vr, fold || '|' || vr AS fv, CASE WHEN vr = 'full' THEN z_1 ELSE 0 END AS z_1, CASE WHEN vr = 'full' THEN z_2 ELSE 0 END AS z_2 FROM zq, (VALUES ('full'), ('value_only')) y(vr)), tr AS (SELECT * FROM va WHERE role = 'train'),
{newton_steps_sql('tr', 'fv', ['z_0', 'z_1', 'z_2'], ['0.1::DOUBLE'] * 3)},
pr AS (SELECT scenario, vr AS model, fold, day, y, p, bid, ask, {CLIP('1 / (1 + exp(-(' + LOGIT('p') + ' + c_0 * z_0 + c_1 * z_1 + c_2 * z_2)))', 1e-6, 1 - 1e-6)} AS f FROM va JOIN w8 ON g = fv WHERE role = 'validation'),
al AS (SELECT * FROM pr UNION ALL SELECT scenario, 'market', fold, day, y, p, bid, ask, p FROM zq WHERE role = 'validation')"""
_SQUARED = lambda f, p: f"(pow({CLIP(f, 1e-6, 1 - 1e-6)} - y, 2) - pow({CLIP(p, 1e-6, 1 - 1e-6)} - y, 2))"
_SCORES = f"avg({LOGLOSS('f', 'y')}) AS ll, avg(pow({CLIP('f', 1e-6, 1 - 1e-6)} - y, 2)) AS br"


def _study(spark, sf):
    s = samples(spark, sf).withColumn("late_value", F.col("value") - F.col("k") % 5)
    return ST.rolling_study(s, FOLDS, ROLLING, VARIANTS, 2 * H, delays={"late": {"value": "late_value"}}, candidate="full", controls=["market", "value_only"])


@query("rolling_study", f"""
WITH {_boot_sql(ROLLING_SQL + f", df AS (SELECT scenario || '|' || model AS sm, day, {_SQUARED('f', 'p')} AS d FROM pr)", 'day', 'sm', {'s': 'sum(d)', 'm': 'count(*)'}, 1, 3000, 'df')},
pt AS (SELECT sm, sum(s) / sum(m) AS mean FROM cl GROUP BY 1), iv AS (SELECT sm, quantile_cont(s / m, 0.025) AS lo, quantile_cont(s / m, 0.975) AS hi FROM rp GROUP BY 1),
pl AS (SELECT scenario, model, count(*) AS events, count(DISTINCT day) AS days, {_SCORES} FROM al GROUP BY 1, 2)
SELECT scenario, model, events, days, {R('ll', 5)} AS log_loss, {R('br', 5)} AS brier, {R('mean', 5)} AS mean, {R('lo', 5)} AS mean_low, {R('hi', 5)} AS mean_high FROM pl LEFT JOIN pt ON pt.sm = scenario || '|' || model LEFT JOIN iv ON iv.sm = pt.sm""")
def rolling_study(spark, sf):
    out = _study(spark, sf)
    j = out["pooled"].join(out["paired"], ["scenario", "model"], "left")
    return j.select("scenario", "model", "events", "days", *[rounded(F.col(c), 5).alias(c) for c in ("log_loss", "brier", "mean", "mean_low", "mean_high")])


@query("rolling_gate", f"""
WITH {ROLLING_SQL}, fo AS (SELECT fold, model, {_SCORES} FROM al WHERE scenario = 'current' GROUP BY 1, 2), po AS (SELECT model, {_SCORES} FROM al WHERE scenario = 'current' GROUP BY 1),
wi AS (SELECT coalesce(sum(won), 0) AS fold_wins FROM (SELECT c.fold, CAST(bool_and(c.br < k.br AND c.ll < k.ll) AS INTEGER) AS won FROM fo c JOIN fo k ON k.fold = c.fold AND k.model <> 'full' WHERE c.model = 'full' GROUP BY 1)),
pb AS (SELECT bool_and(c.br < k.br AND c.ll < k.ll) AS pooled_beats FROM po c JOIN po k ON k.model <> 'full' WHERE c.model = 'full'),
sd AS (SELECT *, {debit_sql('ask', '1')} AS yc, {debit_sql('1 - bid', '1')} AS nc FROM pr WHERE scenario = 'current' AND model = 'full'), ed AS (SELECT *, {R('f - yc', 9)} AS ey, {R('1 - f - nc', 9)} AS en FROM sd),
op AS (SELECT day, CASE WHEN ey >= en THEN y - yc ELSE 1 - y - nc END AS pnl FROM ed WHERE greatest(ey, en) >= 0.04), t AS (SELECT count(*) AS entries, count(DISTINCT day) AS dt, coalesce(sum(pnl), 0) AS pnl FROM op)
SELECT CAST(fold_wins AS BIGINT) AS fold_wins, fold_wins >= 3 AS folds_beat, pooled_beats, pnl > 0 AS positive_net, entries >= 30 AS enough_trades, dt >= 10 AS enough_days,
 concat_ws(',', CASE WHEN fold_wins < 3 THEN 'folds_beat' END, CASE WHEN NOT pooled_beats THEN 'pooled_beats' END, CASE WHEN pnl <= 0 THEN 'positive_net' END, CASE WHEN entries < 30 THEN 'enough_trades' END, CASE WHEN dt < 10 THEN 'enough_days' END) AS failed,
 fold_wins >= 3 AND pooled_beats AND pnl > 0 AND entries >= 30 AND dt >= 10 AS passed FROM wi, pb, t""")
def rolling_gate(spark, sf):
    return _study(spark, sf)["gate"]


@query("ablation_paired", f"""
WITH {_boot_sql(f'''{SAMPLES}, {ZS}, va AS (SELECT zz.* EXCLUDE (z_value, z_spread), vr, CASE WHEN vr IN ('full', 'value') THEN z_value ELSE 0 END AS z_0, CASE WHEN vr IN ('full', 'spread') THEN z_spread ELSE 0 END AS z_1 FROM zz, (VALUES ('full'), ('value'), ('spread')) t(vr)),
{newton_steps_sql('va', 'vr', ['z_0', 'z_1'], ['0.1::DOUBLE'] * 2)}, pr AS (SELECT vr, event_id, day, y, {CLIP('1 / (1 + exp(-(' + LOGIT('p') + ' + c_0 * z_0 + c_1 * z_1)))', 1e-6, 1 - 1e-6)} AS f FROM va JOIN w8 ON g = vr),
df AS (SELECT a.vr, a.day, pow(a.f - a.y, 2) - pow(b.f - b.y, 2) AS d FROM pr a JOIN pr b ON b.event_id = a.event_id AND b.vr = 'full' WHERE a.vr <> 'full')''', 'day', 'vr', {'s': 'sum(d)', 'm': 'count(*)'}, 1, 3000, 'df')},
pt AS (SELECT vr, sum(s) / sum(m) AS mean FROM cl GROUP BY 1), iv AS (SELECT vr, quantile_cont(s / m, 0.025) AS lo, quantile_cont(s / m, 0.975) AS hi FROM rp GROUP BY 1), sc AS (SELECT vr, avg(pow(f - y, 2)) AS br FROM pr GROUP BY 1)
SELECT vr AS variant, {R('br', 5)} AS brier, {R('mean', 6)} AS mean, {R('lo', 6)} AS mean_low, {R('hi', 6)} AS mean_high FROM sc LEFT JOIN pt USING (vr) LEFT JOIN iv USING (vr)""")
def ablation_paired(spark, sf):
    """Each feature subset against the full model on the same rows, with its day-cluster interval."""
    z = _standardized(spark, sf).withColumnRenamed("event_id", "id")
    out = ST.ablation(z, ["z_value", "z_spread"], {"full": ["z_value", "z_spread"], "value": ["z_value"], "spread": ["z_spread"]}, control="full")
    return out.select("variant", rounded(F.col("brier"), 5).alias("brier"), *[rounded(F.col(c), 6).alias(c) for c in ("mean", "mean_low", "mean_high")])


ARMS = ["extra", "spread", "value"]
ARMS_SQL = f"""{SAMPLES}, us AS (SELECT *, k * 1.0::DOUBLE AS extra FROM samples WHERE k % 9 <> 0), dy AS (SELECT day, min("at") AS fa, max(settled_t) AS ls, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM us GROUP BY day),
dp AS (SELECT *, CASE WHEN i >= floor(n * 0.8) THEN 'test' WHEN i >= floor(n * 0.6) THEN 'validation' ELSE 'train' END AS part FROM dy), tc AS (SELECT min(fa) - {24 * H} AS cut FROM dp WHERE part = 'test'),
vd AS (SELECT dp.* FROM dp, tc WHERE part = 'validation' AND ls < cut), vc AS (SELECT min(fa) - {24 * H} AS cut FROM vd),
ro AS (SELECT dp.day, CASE WHEN part = 'test' THEN 'test' WHEN dp.day IN (SELECT day FROM vd) THEN 'validation' WHEN part = 'train' AND dp.ls < vc.cut THEN 'train' ELSE 'purged' END AS role FROM dp, vc),
ur AS (SELECT us.*, role FROM us JOIN ro USING (day)), mu AS (SELECT {', '.join(f'avg({x}) AS m_{x}, greatest(1e-6, stddev_pop({x})) AS s_{x}' for x in ARMS)} FROM ur WHERE role = 'train'),
zu AS (SELECT ur.*, arm, CASE WHEN arm = 'extended' THEN {_z('extra', 'm_extra', 's_extra')} ELSE 0 END AS z_0, {_z('spread', 'm_spread', 's_spread')} AS z_1, {_z('value', 'm_value', 's_value')} AS z_2 FROM ur, mu, (VALUES ('base'), ('extended')) a(arm)), tr AS (SELECT * FROM zu WHERE role = 'train'),
{newton_steps_sql('tr', 'arm', ['z_0', 'z_1', 'z_2'], ['0.1::DOUBLE'] * 3)},
pr AS (SELECT arm, event, day, y, p, {CLIP('1 / (1 + exp(-(' + LOGIT('p') + ' + c_0 * z_0 + c_1 * z_1 + c_2 * z_2)))', 1e-6, 1 - 1e-6)} AS f FROM zu JOIN w8 ON g = arm WHERE role = 'validation'),
gw AS (SELECT pr.*, w, CASE WHEN w = 0 THEN p ELSE w * f + (1 - w) * p END AS b FROM pr, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(w)), gd AS (SELECT arm, w, day, avg({LOGLOSS('b', 'y', 1e-8)}) AS ll, avg(pow(b - y, 2)) AS br FROM gw GROUP BY 1, 2, 3), gs AS (SELECT arm, w, avg(ll) AS ll, avg(br) AS br FROM gd GROUP BY 1, 2),
ge AS (SELECT s.*, m.ll AS l0, m.br AS b0 FROM gs s JOIN gs m ON m.arm = s.arm AND m.w = 0), ch AS (SELECT arm, arg_min(w, (CASE WHEN w = 0 THEN ll - 1e-8 ELSE ll END, w)) AS weight, arg_min(ll, (CASE WHEN w = 0 THEN ll - 1e-8 ELSE ll END, w)) AS log_loss FROM ge WHERE w = 0 OR (ll < l0 - 1e-8 AND br <= b0) GROUP BY 1),
en AS (SELECT arm, day, event, count(*) AS ne FROM pr GROUP BY 1, 2, 3), ed AS (SELECT arm, day, count(*) AS ed FROM en GROUP BY 1, 2), ea AS (SELECT arm, count(*) AS d FROM ed GROUP BY 1),
ew AS (SELECT pr.arm, f, y, least(9, floor(f * 10)) AS bin, 1.0::DOUBLE / (d * ed * ne) AS wt FROM pr JOIN en USING (arm, day, event) JOIN ed USING (arm, day) JOIN ea USING (arm)),
eb AS (SELECT arm, bin, sum(wt) AS wt, sum(wt * f) / sum(wt) AS pp, sum(wt * y) / sum(wt) AS oo, sum(wt * {LOGLOSS('f', 'y', 1e-12)}) AS ll FROM ew GROUP BY 1, 2), es AS (SELECT arm, sum(wt * abs(pp - oo)) AS ece, sum(ll) AS wl FROM eb GROUP BY 1),
df AS (SELECT arm, day, {LOGLOSS('f', 'y', 1e-8)} - {LOGLOSS('p', 'y', 1e-8)} AS d FROM pr)"""


@query("paired_arms", f"""
WITH {_boot_sql(ARMS_SQL, 'day', 'arm', {'v': 'sum(d) / count(*)', 'w': '1'}, 7, 2000, 'df')}, pt AS (SELECT arm, avg(v) AS mean, count(*) AS c FROM cl GROUP BY 1), iv AS (SELECT arm, quantile_cont(v / w, 0.025) AS lo, quantile_cont(v / w, 0.975) AS hi FROM rp GROUP BY 1)
SELECT arm, weight, {R('log_loss', 5)} AS log_loss, {R('ece', 5)} AS ece, {R('wl', 5)} AS weighted_log_loss, {R('mean', 5)} AS mean, CASE WHEN c >= 2 THEN {R('lo', 5)} END AS mean_low, CASE WHEN c >= 2 THEN {R('hi', 5)} END AS mean_high FROM ch JOIN es USING (arm) JOIN pt USING (arm) JOIN iv USING (arm)""")
def paired_arms(spark, sf):
    s = samples(spark, sf).withColumn("extra", F.when(F.col("k") % 9 != 0, F.col("k") * 1.0))
    out = ST.paired_arms(s, {"base": ["value", "spread"], "extended": ["value", "spread", "extra"]}, [0, 0.25, 0.5, 1], 24 * H)
    j = out["weights"].drop("brier").join(out["scores"].withColumnRenamed("log_loss", "weighted_log_loss").drop("brier"), "arm").join(out["interval"], "arm")
    return j.select("arm", "weight", *[rounded(F.col(c), 5).alias(c) for c in ("log_loss", "ece", "weighted_log_loss", "mean", "mean_low", "mean_high")])


CRPS = lambda s, z: f"({s} * ({z} * (2 * {PHI(z)} - 1) + 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))"


@query("station_pilot", f"""
WITH {TICKS}, h AS (SELECT event_type AS st, t // 10800000000 AS sl, max(value) AS v FROM ticks GROUP BY 1, 2), d AS (SELECT st, sl // 8 AS day, max(v) AS f FROM h GROUP BY 1, 2 HAVING count(*) = 8),
l AS (SELECT event_type AS st, t // 86400000000 AS day, avg(value) * 3 AS y FROM ticks GROUP BY 1, 2), r AS (SELECT * FROM d JOIN l USING (st, day) WHERE day % 9 <> 0),
m AS (SELECT st, avg(y - f) AS b, greatest(0.5, sqrt(avg(pow(y - f, 2)))) AS sr, greatest(0.5, stddev_pop(y - f)) AS sc FROM r WHERE day < 19738 AND (day <> 19737 OR day % 9 = 0) GROUP BY 1 HAVING count(*) >= 5),
v AS (SELECT r.*, b, sr, sc, (y - f) / sr AS zr, (y - f - b) / sc AS zc FROM r JOIN m USING (st) WHERE day >= 19738), e AS (SELECT st, day, 'raw' AS model, f - y AS err, {CRPS('sr', 'zr')} AS crps, abs(zr) <= 1.6448536269514722 AS covered FROM v UNION ALL SELECT st, day, 'corrected', f + b - y, {CRPS('sc', 'zc')}, abs(zc) <= 1.6448536269514722 FROM v),
g AS (SELECT *, unnest(['overall', 'station', 'quarter']) AS kind, unnest(['all', st, CAST(quarter(DATE '1970-01-01' + CAST(day AS INTEGER)) AS VARCHAR)]) AS segment FROM e)
SELECT model, kind, segment, count(*) AS n, {R('avg(abs(err))', 4)} AS mae, {R('avg(crps)', 4)} AS crps, {R('avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END)')} AS coverage90 FROM g GROUP BY 1, 2, 3""")
def station_pilot(spark, sf):
    """Eight three-hour values make a day; every ninth day's label is issued before the day is over, and the label of the
    last training day comes two days late."""
    t = ticks(spark, sf)
    slot = F.floor(F.col("t") / (3 * H)).cast("long") * F.lit(3 * H)
    hours = t.groupBy(F.col("event_type").alias("station"), slot.alias("valid_at")).agg(F.max("value").alias("value"))
    day = F.floor(F.col("t") / DAY).cast("long")
    found = t.groupBy(F.col("event_type").alias("station"), day.alias("day")).agg((F.avg("value") * 3).alias("target"))
    # Issued at the day's end, so the label of day n is known before day n + 1 + 1 microsecond; that of 19737 only at 19739.
    issued = F.when(F.col("day") % 9 == 0, F.col("day") * DAY + 12 * H).when(F.col("day") == 19737, F.lit(19739 * DAY)).otherwise((F.col("day") + 1) * DAY)
    days = found.select("station", "day", (F.col("day") * DAY).alias("start"))
    out = ST.station_pilot(days, hours, found.withColumn("issued_t", issued), 19738, step=3 * H, count=8, min_days=5)
    return out["scores"].select("model", "kind", "segment", "n", rounded(F.col("mae"), 4).alias("mae"), rounded(F.col("crps"), 4).alias("crps"), rounded(F.col("coverage90")).alias("coverage90"))


MEMBERS_SQL = """mb AS (SELECT event_type, day, b, par, mem, CASE WHEN par = 'weather' THEN least(1.0::DOUBLE, c * (mem + 1) / 100.0::DOUBLE) ELSE least(1.0::DOUBLE, (c + mem) / 50.0::DOUBLE) END AS mp FROM {rows}, (VALUES ('weather', 0), ('weather', 1), ('weather', 2), ('guard', 0), ('guard', 1), ('guard', 2)) x(par, mem)
  WHERE NOT (b = 4 AND day % 7 = 0 AND par = 'guard' AND mem = 2)), pm AS (SELECT event_type, day, b, avg(mp) FILTER (WHERE par = 'weather') AS pw, avg(mp) FILTER (WHERE par = 'guard') AS pg, count(*) AS nm FROM mb GROUP BY 1, 2, 3)"""
WEIGHTS = {"weather": 0.6, "guard": 0.4}


def _members(rows):
    """Three members of two parents per bracket; one guard member is missing in the fifth bracket of every seventh day."""
    who = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(m).alias("member")) for p in WEIGHTS for m in range(3)])
    m = rows.withColumn("_w", F.explode(who)).select("event_type", "day", "b", "c", "_w.*")
    m = m.filter(~((F.col("b") == 4) & (F.col("day") % 7 == 0) & (F.col("parent") == "guard") & (F.col("member") == 2)))
    p = F.when(F.col("parent") == "weather", F.col("c") * (F.col("member") + 1) / F.lit(100.0)).otherwise((F.col("c") + F.col("member")) / F.lit(50.0))
    return m.select("event_type", "day", "b", "parent", "member", F.least(F.lit(1.0), p).alias("p"))


@query("parent_blend", f"""
WITH {TICKS}, {LADDER}, {MEMBERS_SQL.format(rows='fu')} SELECT event_type, day, b, CASE WHEN nm = 6 THEN {R('0.6::DOUBLE * pw + 0.4::DOUBLE * pg')} END AS blend, CASE WHEN nm < 6 THEN 'missing_member' END AS reason FROM pm""")
def parent_blend(spark, sf):
    rows = full_ladders(spark, sf)
    out = M.parent_blend(rows, _members(rows), ["event_type", "day", "b"], WEIGHTS)
    return out.select("event_type", "day", "b", rounded(F.col("blend")).alias("blend"), "reason")


@query("event_blend", f"""
WITH {TICKS}, {LADDER}, {MEMBERS_SQL.format(rows='br')}, ev AS (SELECT *, sum(pw) OVER e AS mw, sum(pg) OVER e AS mg, count(*) OVER e AS nb, min(nm) OVER e AS low FROM pm WINDOW e AS (PARTITION BY event_type, day))
SELECT event_type, day, b, CASE WHEN nb = 10 AND low = 6 THEN {R('0.6::DOUBLE * pw / mw + 0.4::DOUBLE * pg / mg')} END AS blend,
 CASE WHEN nm < 6 THEN 'missing_member' WHEN nb < 10 THEN 'incomplete_event' WHEN low < 6 THEN 'bad_member_in_event' END AS reason FROM ev""")
def event_blend(spark, sf):
    """The blend with each parent divided by its mass over the event; events that are no partition stay without."""
    from tidemark.plans.q_scores import brackets

    rows = brackets(spark, sf)
    out = M.parent_blend(rows, _members(rows), ["event_type", "day", "b"], WEIGHTS, event=["event_type", "day"])
    return out.select("event_type", "day", "b", rounded(F.col("blend")).alias("blend"), "reason")
