"""Queries for the weather designs, forecast innovations and rows re-pointed at their execution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.numeric import rounded
from tidemark.operators import books as K
from tidemark.operators import windows as W
from tidemark.plans.oracle_text import CLIP
from tidemark.plans.q_scores import LEVELS, _levels
from tidemark.plans.q_studies import CONTRACT_SQL, contract_rows
from tidemark.plans.registry import query
from tidemark.plans.standins import DAY, R, S, TICKS, debit_sql, table, ticks

H = 3600 * S

# One weather row per tick; every fifth is unobserved, tails are open below 20 and above 80.
INPUTS = {
    "observed": "k % 5 <> 0", "observed_max": "CASE WHEN k % 5 <> 0 THEN value END", "observed_temperature": "CASE WHEN k % 5 <> 0 THEN value - k % 9 END",
    "observed_trend": "CASE WHEN k % 5 <> 0 THEN k % 7 - 3 END", "observation_age_hours": "CASE WHEN k % 5 <> 0 THEN k % 4 END", "local_day_hour": "k % 24",
    "lower": "CASE WHEN k >= 20 THEN k + 20 END", "upper": "CASE WHEN k <= 80 THEN k + 30 END", "gfs": "value + 2", "ecmwf": "value - k % 6",
    "remaining_forecast_max": "value + 1", "gfs_remaining_max": "CASE WHEN k % 6 <> 0 THEN value + k % 4 END", "ecmwf_remaining_max": "CASE WHEN k % 7 <> 0 THEN value - k % 3 END",
    "remaining_hours": "k % 24", "forecast_revision_f": "CASE WHEN k % 3 <> 0 THEN k % 8 - 4 END", "mean_relative_humidity": "k", "max_wind_mph": "CASE WHEN k % 4 <> 0 THEN k % 30 END",
    "mean_cloud_cover": "k", "model_disagreement_f": "k % 6", "observation_innovation_f": "CASE WHEN k % 5 <> 0 THEN k % 9 - 4 END",
    "median_low": "CASE WHEN k % 6 <> 0 THEN k + 40 END", "median_high": "k + 50", "q25_low": "CASE WHEN k % 8 <> 0 THEN k + 30 END", "q75_high": "k + 60", "mean_spread": "CASE WHEN k % 9 <> 0 THEN k / 100.0 END",
}
ROWS = f"{TICKS}, d AS (SELECT event_id, {', '.join(f'{v} AS {n}' if n == 'observed' else f'CAST({v} AS DOUBLE) AS {n}' for n, v in INPUTS.items())} FROM ticks)"


def _rows(spark, sf):
    t = ticks(spark, sf)
    return t.select("event_id", *[F.expr(v).alias(n) if n == "observed" else F.expr(v).cast("double").alias(n) for n, v in INPUTS.items()])


def _design_sql(columns: dict[str, str], where: str = "true") -> str:
    return f"WITH {ROWS} SELECT event_id, {', '.join(f'{R(v)} AS {n}' for n, v in columns.items())} FROM d WHERE {where}"


def _shown(df, columns):
    return df.select("event_id", *[rounded(F.col(c)).alias(c) for c in columns])


def _flag(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS DOUBLE)"


def _distance(end: str, x: str, open_: float) -> str:
    return f"(CASE WHEN {end} IS NULL THEN {open_!r}::DOUBLE ELSE {CLIP(f'(({end} - {x}) / 10.0::DOUBLE)', -3.0, 3.0)} END)"


PEAK, MEAN = "coalesce(observed_max, 65)", "((gfs + ecmwf) / 2.0::DOUBLE)"
STATION = {
    "s_observed": _flag("observed"), "s_lower": _distance("lower", PEAK, -3.0), "s_upper": _distance("upper", PEAK, 3.0), "s_open_low": _flag("lower IS NULL"), "s_open_high": _flag("upper IS NULL"),
    "s_drop": f"(({PEAK} - coalesce(observed_temperature, 65)) / 10.0::DOUBLE)", "s_trend": "(coalesce(observed_trend, 0) / 10.0::DOUBLE)", "s_age": "(coalesce(observation_age_hours, 3) / 3.0::DOUBLE)",
    "s_hour": "(local_day_hour / 24.0::DOUBLE)", "s_gfs": f"((gfs - {PEAK}) / 10.0::DOUBLE)", "s_ecmwf": f"((ecmwf - {PEAK}) / 10.0::DOUBLE)", "s_gap": "(abs(gfs - ecmwf) / 10.0::DOUBLE)",
    "s_lower_mean": _distance("lower", MEAN, -3.0), "s_upper_mean": _distance("upper", MEAN, 3.0),
}


@query("station_design", _design_sql(STATION))
def station_design(spark, sf):
    return _shown(X.station_design(_rows(spark, sf)), STATION)


SCALED = {
    "forecast_revision_f": ("forecast_revision_f", 5), "mean_relative_humidity": ("mean_relative_humidity", 100), "max_wind_mph": ("max_wind_mph", 30), "mean_cloud_cover": ("mean_cloud_cover", 100),
    "model_disagreement_f": ("model_disagreement_f", 5), "gfs_dev": ("(gfs_remaining_max - remaining_forecast_max)", 5), "ecmwf_dev": ("(ecmwf_remaining_max - remaining_forecast_max)", 5),
}
REMAINING = {n: f"coalesce({v} / {s}.0::DOUBLE, 0)" for n, (v, s) in SCALED.items()} | {f"{n}_missing": _flag(f"{v} IS NULL") for n, (v, _) in SCALED.items()} | {"h_remaining": "(remaining_hours / 24.0::DOUBLE)"}


@query("remaining_design", _design_sql(REMAINING))
def remaining_design(spark, sf):
    return _shown(X.remaining_design(_rows(spark, sf)), REMAINING)


PATH = {
    "j_innovation": "(observation_innovation_f / 5.0::DOUBLE)", "j_trend": "(observed_trend / 5.0::DOUBLE)", "j_now": "((observed_temperature - remaining_forecast_max) / 10.0::DOUBLE)",
    "j_peak": "((observed_max - remaining_forecast_max) / 10.0::DOUBLE)", "j_hours": "(remaining_hours / 24.0::DOUBLE)", "j_models": "((gfs_remaining_max - ecmwf_remaining_max) / 5.0::DOUBLE)",
    "j_gap": "(model_disagreement_f / 5.0::DOUBLE)", "j_age": "(observation_age_hours / 3.0::DOUBLE)",
}


@query("path_design", _design_sql(PATH, "observed AND gfs_remaining_max IS NOT NULL AND ecmwf_remaining_max IS NOT NULL"))
def path_design(spark, sf):
    return _shown(X.path_design(_rows(spark, sf)), PATH)


REGIONAL = {
    "r_center": "(((median_low + median_high) / 2.0::DOUBLE - remaining_forecast_max) / 5.0::DOUBLE)", "r_width": "((median_high - median_low) / 10.0::DOUBLE)", "r_spread": "coalesce(mean_spread, 0)",
    "r_spread_missing": _flag("mean_spread IS NULL"), "r_iqr": "coalesce((q75_high - q25_low) / 10.0::DOUBLE, 0)", "r_iqr_missing": _flag("q25_low IS NULL OR q75_high IS NULL"),
}


@query("regional_design", _design_sql(REGIONAL, "median_low IS NOT NULL"))
def regional_design(spark, sf):
    return _shown(X.regional_design(_rows(spark, sf)), REGIONAL)


@query("forecast_innovation", f"""
WITH {TICKS}, v AS (SELECT user_id % 20 AS st, t // 86400000000 * 86400000000 - 86400000000 AS ini, CASE WHEN event_type IN ('click', 'view') THEN 'gfs' ELSE 'ecmwf' END AS model, t // 10800000000 AS sl, max(value) AS v FROM ticks GROUP BY ALL),
g AS (SELECT st, ini, sl * 3 + i AS hr, avg(v) AS m FROM v, range(3) r(i) GROUP BY ALL HAVING count(*) = 2),
o AS (SELECT event_id, user_id % 20 AS st, t, t // 86400000000 * 86400000000 - 86400000000 AS ini, t // 3600000000 AS hr, value, t + k * 60000000 AS dt FROM ticks WHERE event_type = 'error')
SELECT event_id, CASE WHEN b.m IS NOT NULL THEN {R('value - (a.m + (b.m - a.m) * ((t - a.hr * 3600000000) / 3600000000.0::DOUBLE))')} END AS innovation
FROM o LEFT JOIN g a ON a.st = o.st AND a.ini = o.ini AND a.hr = o.hr LEFT JOIN g b ON b.st = a.st AND b.ini = a.ini AND b.hr = a.hr + 1""")
def forecast_innovation(spark, sf):
    """Observed less the forecast of the run of the day before, where both models cover both hours around it."""
    t = ticks(spark, sf)
    run = (F.floor(F.col("t") / DAY) * DAY - DAY).cast("long").alias("initialized")
    station = (F.col("user_id") % 20).alias("station")
    model = F.when(F.col("event_type").isin("click", "view"), "gfs").otherwise("ecmwf").alias("model")
    slots = t.groupBy(station, run, model, F.floor(F.col("t") / (3 * H)).cast("long").alias("slot")).agg(F.max("value").alias("value"))
    hours = slots.withColumn("valid_at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("slot") * 3 + i) * H)))
    seen = t.filter("event_type = 'error'").select("event_id", station, run, F.col("t").alias("at"), "value", (F.col("t") + F.col("k") * 60 * S).alias("decision_at"))
    out = W.innovation(seen, hours, ["station"], "at", "value", "initialized")
    return out.select("event_id", rounded(F.col("innovation")).alias("innovation"))


@query("execution_features", f"""
WITH {CONTRACT_SQL} SELECT event_type, cl AS close_s, ex AS "at", {R('(nb + na) / 2.0::DOUBLE')} AS p, {R('(nb + na) / 2.0::DOUBLE - (bid + ask) / 2.0::DOUBLE')} AS prior_move, CAST(e2.close AS DOUBLE) AS price
FROM r JOIN b e2 ON e2.bar = (ex - 5) // 3600 * 3600 - 3600 WHERE reason IS NULL AND ex IS NOT NULL AND nb > 0 AND nb <= na AND na < 1""")
def execution_features(spark, sf):
    """Contract rows at their execution quote with the spot features that were complete by then."""
    rows, _ = contract_rows(spark, sf)
    out = W.execution_rows(rows, refreshed="execution_spot")
    return out.select(F.col("ticker").alias("event_type"), "close_s", "at", rounded(F.col("p")).alias("p"), rounded(F.col("prior_move")).alias("prior_move"), "price")


@query("liquidation_fresh", f"""
WITH {LEVELS}, u AS (SELECT lv.*, CAST(floor(qty * 0.1::DOUBLE) AS BIGINT) AS us FROM lv WHERE l_orderkey % 300 <= 180 AND l_orderkey % 7 <> 0), v AS (SELECT *, coalesce(sum(us) OVER (PARTITION BY l_orderkey ORDER BY cents DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM u WHERE us > 0),
pos AS (SELECT o_orderkey, 1 + o_orderkey % 9 AS quantity FROM orders), j AS (SELECT o_orderkey, quantity, cents / 100.0::DOUBLE AS price, coalesce(least(us, greatest(0, quantity - bf)), 0) AS tk FROM pos LEFT JOIN v ON v.l_orderkey = o_orderkey),
f AS (SELECT *, CASE WHEN tk > 0 THEN greatest(0, price * tk - ({debit_sql('price', 'tk')} - price * tk)) ELSE 0 END AS worth FROM j)
SELECT o_orderkey, quantity, {R('sum(worth)')} AS value, CAST(max(quantity) - sum(tk) AS BIGINT) AS unpriced FROM f GROUP BY 1, 2""")
def liquidation_fresh(spark, sf):
    """Positions against books of which some are older than 180 seconds and some have no known age."""
    age = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey") % 300)
    bids = _levels(spark, sf).withColumns({"o_orderkey": F.col("l_orderkey"), "rank": -F.col("cents"), "age": age})
    pos = table(spark, sf, "orders").select("o_orderkey", (F.lit(1) + F.col("o_orderkey") % 9).alias("quantity"), F.lit(0.07).alias("fee_rate"))
    out = K.liquidation_value(pos, bids.drop("l_orderkey"), ["o_orderkey"], ["o_orderkey"], "rank", "price", "qty", tie=["level"], fresh=F.col("age").between(0, 180))
    return out.select("o_orderkey", "quantity", rounded(F.col("value")).alias("value"), "unpriced")
