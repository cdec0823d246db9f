"""Forecast scores: every metric is a tree of map-side combined sums, so a hot day or model never lands in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.money import side_edges, slipped, unit_cost
from tidemark.functions.numeric import brier, clip, log_loss, normal_cdf, normal_pdf
from tidemark.operators.ordered import same_key
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.slicing import evaluated_once
from tidemark.operators.temporal import scalar_join
from tidemark.session import written

# Bucket edges.
PRICE_BUCKETS = [(0.0, 0.1, "0-0.1"), (0.1, 0.3, "0.1-0.3"), (0.3, 0.7, "0.3-0.7"), (0.7, 0.9, "0.7-0.9"), (0.9, 1.01, "0.9-1")]
AUDIT_PRICE = [(0.02, "0-2%"), (0.1, "2-10%"), (0.3, "10-30%"), (0.7, "30-70%"), (0.9, "70-90%")]
EDGE_LABELS = [(0.0, "negative"), (0.02, "0-2 cents"), (0.04, "2-4 cents"), (0.08, "4-8 cents")]
NET_EDGE_BINS = [(0.04, 0.08), (0.08, 0.15), (0.15, 1.01)]
DISAGREEMENT = [(0.0, 2.0, "under_2"), (2.0, 5.0, "2_to_5"), (5.0, math.inf, "5_or_more")]
Z90 = 1.6448536269514722


def n() -> Column:
    return F.count(F.lit(1))


def bucket(x: Column, edges) -> Column:
    """Label of the half-open [low, high) bucket."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(edges):
        out = F.when((x >= low) & (x < high), label).otherwise(out)
    return out


def up_to(x: Column, limits, last: str) -> Column:
    """Label of the first limit that x is below."""
    out = F.lit(last)
    for limit, label in reversed(limits):
        out = F.when(x < limit, label).otherwise(out)
    return out


def binary_metrics(df: DataFrame, by: list[str], p: str, y: str, day: str) -> DataFrame:
    """Events, days, accuracy at one half, pooled log loss and Brier (probabilities clipped to 1e-6)."""
    q = clip(F.col(p), 1e-6, 1 - 1e-6)
    hit = (q >= 0.5) == (F.col(y) == 1)
    return df.groupBy(*by).agg(
        n().alias("events"), F.count_distinct(day).alias("days"), F.avg(hit.cast("double")).alias("accuracy"),
        F.avg(log_loss(F.col(p), F.col(y))).alias("log_loss"), F.avg(brier(q, F.col(y))).alias("brier"),
    )


def half_open_bin(p: Column) -> Column:
    """Bin i for i*0.1 <= p < i*0.1 + 0.1 in floating point; values on a rounding seam fall in no bin."""
    out = F.lit(None).cast("int")
    for i in range(9, -1, -1):
        out = F.when((p >= i * 0.1) & (p < i * 0.1 + 0.1), i).otherwise(out)
    return out


def floor_bin(p: Column) -> Column:
    """Bin min(9, floor(10 p)); every probability has one."""
    return F.least(F.lit(9), F.floor(p * F.lit(10.0)).cast("int"))


def calibration(df: DataFrame, by: list[str], p: str, y: str, bins: Column) -> DataFrame:
    return df.withColumn("bin", bins).filter("bin IS NOT NULL").groupBy(*by, "bin").agg(
        n().alias("count"), F.avg(p).alias("predicted"), F.avg(y).alias("observed")
    )


def day_mean_score(df: DataFrame, by: list[str], p: str, y: str, day: str) -> DataFrame:
    """Mean per day, then mean of days: a day counts once however many rows it has."""
    per_day = df.groupBy(*by, day).agg(
        F.avg(log_loss(F.col(p), F.col(y), 1e-8)).alias("_ll"), F.avg(brier(F.col(p), F.col(y))).alias("_b"), n().alias("_n")
    )
    return per_day.groupBy(*by).agg(F.avg("_ll").alias("log_loss"), F.avg("_b").alias("brier"), F.sum("_n").alias("samples"), n().alias("days"))


def event_date_weighted(df: DataFrame, by: list[str], p: str, y: str, day: str, event: str) -> tuple[DataFrame, DataFrame]:
    """(summary, reliability bins) with equal weight per day, then per event of the day, then per row.

    Rows are reduced to (day, event, bin) first; weights exist only on that reduced frame.
    """
    q, lab = F.col(p), F.col(y)
    ll = -(lab * F.log(clip(q, 1e-12, 1.0)) + (F.lit(1.0) - lab) * F.log(clip(F.lit(1.0) - q, 1e-12, 1.0)))
    cells = df.groupBy(*by, day, event, floor_bin(q).alias("bin")).agg(
        n().alias("_n"), F.sum(q).alias("_p"), F.sum(lab).alias("_y"), F.sum(brier(q, lab)).alias("_b"), F.sum(ll).alias("_l")
    )
    events = cells.groupBy(*by, day, event).agg(F.sum("_n").alias("_ne"))
    days = events.groupBy(*by, day).agg(n().alias("_ed"))
    days = days.withColumn("_d", F.count(F.lit(1)).over(W.partitionBy(*(by or [F.lit(0)]))))
    w = cells.join(events, [*by, day, event]).join(days, [*by, day])
    w = w.withColumn("_w", F.lit(1.0) / (F.col("_d") * F.col("_ed") * F.col("_ne")))
    bins = w.groupBy(*by, "bin").agg(
        F.sum(F.col("_w") * F.col("_n")).alias("weight"), F.sum("_n").alias("rows"),
        (F.sum(F.col("_w") * F.col("_p")) / F.sum(F.col("_w") * F.col("_n"))).alias("predicted"),
        (F.sum(F.col("_w") * F.col("_y")) / F.sum(F.col("_w") * F.col("_n"))).alias("observed"),
        F.sum(F.col("_w") * F.col("_b")).alias("_b"), F.sum(F.col("_w") * F.col("_l")).alias("_l"),
    )
    summary = bins.groupBy(*by).agg(
        F.sum(F.col("weight") * F.abs(F.col("predicted") - F.col("observed"))).alias("ece"),
        F.sum("_b").alias("brier"), F.sum("_l").alias("log_loss"),
    )
    return summary, bins.drop("_b", "_l")


def date_weights(df: DataFrame, day: str) -> DataFrame:
    """Row weight 1 / (rows of the day), scaled to mean 1 over all rows."""
    days = df.groupBy(day).agg(n().alias("_n"))
    one = W.partitionBy(F.lit(0))
    days = days.withColumn("weight", F.sum("_n").over(one) / (F.count(F.lit(1)).over(one) * F.col("_n")))
    return df.join(days.drop("_n"), day)


def event_nll(df: DataFrame, by: list[str], p: str, y: str, day: str) -> DataFrame:
    """-log p of the winning bracket, averaged inside the day and then over days."""
    won = df.filter(F.col(y) == 1).groupBy(*by, day).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("_l"), n().alias("_n"))
    return won.groupBy(*by).agg(F.avg("_l").alias("nll"), F.sum("_n").alias("winners"), n().alias("days"))


def event_mass_error(df: DataFrame, keys: list[str], p: str, market: str, y: str) -> DataFrame:
    """Over complete events: mass error of the raw model and categorical losses after normalisation."""
    e = df.groupBy(*keys).agg(
        F.sum(p).alias("_m"), F.sum(market).alias("_k"),
        F.sum(F.when(F.col(y) == 1, F.col(p))).alias("_wp"), F.sum(F.when(F.col(y) == 1, F.col(market))).alias("_wk"), F.sum(y).alias("_y"),
    ).filter("_y = 1 AND _m > 0 AND _k > 0")
    loss = lambda w, m: -F.log(F.greatest(F.col(w) / F.col(m), F.lit(1e-8)))
    return e.agg(
        n().alias("complete_events"), F.avg(F.abs(F.col("_m") - 1)).alias("mass_error"),
        F.avg(loss("_wp", "_m")).alias("model_loss"), F.avg(loss("_wk", "_k")).alias("market_loss"),
    )


def segments(df: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """Tall form: each row once per segmentation, with its segment name and label."""
    arr = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("segment")) for k, v in labels.items()])
    return df.withColumn("_g", F.explode(arr)).withColumn("kind", F.col("_g.kind")).withColumn("segment", F.col("_g.segment")).drop("_g")


def loss_contribution(df: DataFrame, by: list[str], model: Column, market: Column, day: str) -> DataFrame:
    """(model - market) / rows of the day / days: sums over any segmentation to the headline difference.

    Day sizes are joined onto day-level sums, not onto rows.
    """
    cells = df.groupBy(*by, day).agg(F.sum(model - market).alias("_s"), n().alias("_n"))
    sizes = df.select(day, *([F.col("kind")] if "kind" in by else [])).groupBy(day, *(["kind"] if "kind" in by else [])).agg(n().alias("_size"))
    if "kind" in by:
        days = sizes.groupBy("kind").agg(n().alias("_days"))
        j = cells.join(sizes, [day, "kind"]).join(days, "kind")
    else:
        j = cells.join(sizes.withColumn("_days", F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))), day)
    return j.groupBy(*by).agg(F.sum(F.col("_s") / F.col("_size") / F.col("_days")).alias("contribution"), F.sum("_n").alias("rows"))


def with_best_side(df: DataFrame, p="p", bid="bid", ask="ask", slippage=0.0) -> DataFrame:
    """Better side of one contract at the quote with its claimed net edge; YES wins ties."""
    yes, no = side_edges(F.col(p), F.col(bid), F.col(ask), slippage=slippage)
    d = evaluated_once(df, _yes=yes, _no=no)
    return evaluated_once(d, side=F.when(F.col("_yes") >= F.col("_no"), "yes").otherwise("no"), edge=F.greatest("_yes", "_no").cast("double")).drop("_yes", "_no")


def one_contract_pnl(side: Column, y: Column, bid: Column, ask: Column, slippage=0.0) -> Column:
    """Realised net of one contract bought on ``side`` at the given quote."""
    yes = side == "yes"
    from tidemark.functions.money import PRICE, price_of

    quoted = F.when(yes, price_of(ask)).otherwise((F.lit(1).cast(PRICE) - price_of(bid)).cast(PRICE))
    payout = F.when(yes, y).otherwise(F.lit(1) - y)
    return payout.cast("double") - unit_cost(slipped(quoted, slippage)).cast("double")


def edge_buckets(df: DataFrame, edge: str, pnl: str, event: str, later: str | None = None) -> DataFrame:
    """Claimed against realised net per contract in edge bins; the delayed mean uses only rows with a later quote."""
    d = df.withColumn("bucket", up_to(F.col(edge), EDGE_LABELS, "8+ cents"))
    aggs = [n().alias("rows"), F.count_distinct(event).alias("events"), F.avg(edge).alias("claimed"), F.avg(pnl).alias("realized")]
    if later:
        aggs += [F.avg(later).alias("delayed"), F.count(later).alias("delayed_rows")]
    return d.groupBy("bucket").agg(*aggs)


def net_edge_bins(df: DataFrame, edge: str, pnl: str) -> DataFrame:
    label = bucket(F.col(edge), [(a, b, f"{a:.2f}-{b:.2f}") for a, b in NET_EDGE_BINS])
    return df.withColumn("bin", label).filter("bin IS NOT NULL").groupBy("bin").agg(n().alias("opportunities"), F.avg(edge).alias("predicted"), F.avg(pnl).alias("realized"))


def source_audit(df: DataFrame, by: list[str]) -> DataFrame:
    """Disagreement of a proxy source with official labels.

    Needs y, strike and the final and opening bars as structs (low, high, close). A whole final range on the other
    side of the target cannot be reconciled by averaging inside the bar.
    """
    c = F.col
    rows = df.filter(c("final").isNotNull() & c("opening").isNotNull()).withColumn("_bps", F.lit(10000.0) * (c("opening.close") / c("strike") - 1))
    rows = rows.withColumn("_abs", F.abs(c("_bps")))
    proxy = (c("final.close") >= c("strike")).cast("int")
    opposite = ((c("y") == 0) & (c("final.low") >= c("strike"))) | ((c("y") == 1) & (c("final.high") < c("strike")))
    base = rows.groupBy(*by).agg(
        n().alias("matched"), F.count_if(proxy != c("y")).alias("label_disagreements"), F.count_if(opposite).alias("whole_range_opposes"),
        F.count_if(~((c("opening.low") <= c("strike")) & (c("strike") <= c("opening.high")))).alias("target_outside_range"), F.avg("_bps").alias("basis_mean"),
    )
    q = exact_quantiles(rows, by, "_abs", {"basis_median_abs": 0.5, "basis_p95_abs": 0.95})
    return base.join(q, by)


def one_pair_per_event(df: DataFrame, event: list[str]) -> DataFrame:
    """Rows of events that occur once: a repeated event would overweight its day, so none of its rows counts."""
    rest = [c for c in df.columns if c not in event]
    once = df.groupBy(*event).agg(n().alias("_n"), F.first(F.struct(*rest)).alias("_r")).filter("_n = 1")
    return once.select(*event, "_r.*")


def residual_summary(df: DataFrame, by: list[str], residual: str, min_n: int = 80, event: list[str] | None = None) -> DataFrame:
    """n, mean, sample sd, rmse and quantiles per group, and pooled over all (null keys, ``pooled``); few rows are marked unusable.

    With ``event``, only one pair per event counts (``one_pair_per_event``).
    """
    r = F.col(residual)
    rows = written((one_pair_per_event(df, event) if event else df).select(*by, r.alias(residual)), "residuals")

    def summary(keys: list[str]) -> DataFrame:
        base = rows.groupBy(*keys).agg(n().alias("n"), F.avg(r).alias("bias"), F.stddev_samp(r).alias("sigma"), F.sqrt(F.avg(r * r)).alias("rmse"))
        q = exact_quantiles(rows, keys, residual, {"p05": 0.05, "p50": 0.5, "p95": 0.95})
        both = base.alias("b").join(q.alias("q"), same_key(keys, "b", "q")).select("b.*", "p05", "p50", "p95") if keys else scalar_join(base, q)
        return both.withColumn("usable", F.col("n") >= min_n).withColumn("pooled", F.lit(not keys))

    return summary(by).unionByName(summary([]), allowMissingColumns=True)


def station_bias_fit(df: DataFrame, station: str, target: str, forecast: str, floor: float = 0.5, min_days: int = 90) -> DataFrame:
    """Bias, raw RMSE width and bias-corrected width per station, floored; NULL widths below ``min_days``."""
    e = F.col(target) - F.col(forecast)
    g = df.groupBy(station).agg(n().alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("_raw"), F.stddev_pop(e).alias("_cor"))
    enough = F.col("n") >= min_days
    return g.select(
        station, "n", F.when(enough, F.col("bias")).alias("bias"),
        F.when(enough, F.greatest(F.lit(floor), F.col("_raw"))).alias("sigma_raw"), F.when(enough, F.greatest(F.lit(floor), F.col("_cor"))).alias("sigma_corrected"),
    )


def gaussian_rows(df: DataFrame, y: str, mu: Column, sigma: Column) -> DataFrame:
    """Per-row error, CRPS, negative log likelihood, PIT and 90 percent coverage of a normal forecast."""
    z = (F.col(y) - mu) / sigma
    crps = sigma * (z * (F.lit(2.0) * normal_cdf(z) - 1) + F.lit(2.0) * normal_pdf(z) - F.lit(1 / math.sqrt(math.pi)))
    return df.withColumns({
        "error": mu - F.col(y), "crps": crps, "nll": F.log(sigma) + F.lit(0.5) * z * z + F.lit(0.5 * math.log(2 * math.pi)),
        "pit": normal_cdf(z), "covered90": (F.abs(z) <= Z90).cast("double"),
    })


def gaussian_summary(df: DataFrame, by: list[str]) -> DataFrame:
    e = F.col("error")
    pit = [F.count_if(F.least(F.lit(9), F.floor(F.col("pit") * 10)) == i).alias(f"pit_{i}") for i in range(10)]
    return df.groupBy(*by).agg(
        n().alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.avg("crps").alias("crps"), F.avg("nll").alias("nll"), F.avg("covered90").alias("coverage90"), *pit,
    )


def drift(df: DataFrame, features: list[str], is_train: Column, floor: float = 1e-6, limit: float = 5.0) -> DataFrame:
    """Shift of each feature from train to test in train standard deviations, sd ratio and clipped share.

    Long form, one aggregate for both roles; the clipped share needs the train moments, hence a second pass.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.select(is_train.alias("_train"), F.explode(pairs).alias("_f")).select("_train", "_f.*")
    side = lambda flag: F.when(F.col("_train") if flag else ~F.col("_train"), F.col("v"))
    m = long.groupBy("feature").agg(
        F.avg(side(True)).alias("train_mean"), F.stddev_pop(side(True)).alias("_sd"), F.avg(side(False)).alias("test_mean"), F.stddev_pop(side(False)).alias("_tsd")
    ).withColumn("_scale", F.greatest(F.col("_sd"), F.lit(floor)))
    shift = F.abs((F.col("v") - F.col("train_mean")) / F.col("_scale"))
    clipped = long.filter("NOT _train").join(m.select("feature", "train_mean", "_scale"), "feature").groupBy("feature").agg(
        F.avg((shift > limit).cast("double")).alias("clipped_share")
    )
    return m.join(clipped, "feature").select(
        "feature", "train_mean", "test_mean", ((F.col("test_mean") - F.col("train_mean")) / F.col("_scale")).alias("shift_sd"),
        (F.col("_tsd") / F.col("_scale")).alias("sd_ratio"), "clipped_share",
    )


def timing_audit(df: DataFrame, ages: dict[str, Column]) -> DataFrame:
    """Distinct values of each age with their counts."""
    arr = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("double").alias("age")) for k, v in ages.items()])
    return df.select(F.explode(arr).alias("_a")).select("_a.*").groupBy("kind", "age").agg(n().alias("n"))


def exclusive_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Distinct counts; Spark expands several exact distincts to one two-level aggregate."""
    f = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(n().alias("rows"), *[f(c).alias(f"distinct_{c}") for c in columns])


def paired_cohort_scores(df: DataFrame, cohorts: dict[str, tuple[Column, Column, Column]], y: Column, event: str) -> DataFrame:
    """Model against baseline where both exist, per cohort name -> (keep, model p, baseline p). One pass over the rows."""
    arr = F.array(*[F.struct(F.lit(k).alias("cohort"), keep.alias("keep"), m.alias("m"), b.alias("b")) for k, (keep, m, b) in cohorts.items()])
    rows = df.select(y.alias("_y"), event, F.explode(arr).alias("_c")).filter("_c.keep AND _c.m IS NOT NULL AND _c.b IS NOT NULL")
    s = lambda f, c: F.avg(f(F.col(f"_c.{c}"), F.col("_y")))
    ll = lambda p, y: log_loss(p, y, 1e-12)
    return rows.groupBy(F.col("_c.cohort").alias("cohort")).agg(
        n().alias("paired"), F.count_distinct(event).alias("event_groups"), s(brier, "m").alias("model_brier"), s(brier, "b").alias("market_brier"),
        s(ll, "m").alias("model_log_loss"), s(ll, "b").alias("market_log_loss"),
    )
