"""Composite studies: the jobs a user runs, built only from the operators.

Each study is a function of DataFrames. Long lineages are cut with ``written`` (a table in the shared folder) where a
frame is scanned more than twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import contracts as T
from tidemark.functions.numeric import brier, clip, log_loss, rounded
from tidemark.operators import brackets, metrics, models, pnl, quality, resample, splits, temporal, windows
from tidemark.operators.slicing import DAY, HOUR
from tidemark.session import written

MICRO = 1_000_000


def price_samples(markets: DataFrame, candles: DataFrame, horizons_hours: list[int] = (12, 18, 24)) -> DataFrame:
    """One row per contract and horizon: newest valid hourly quote at the cutoff (at most 1 h old), the previous quote
    (2 h), and the next quote (2 h) as execution scenario only. ``close_s``/``end_ts`` are epoch seconds."""
    q = candles.filter("bid IS NOT NULL").select("ticker", "end_ts", "bid", "ask")
    q = temporal.with_previous(q, ["ticker"], "end_ts", ["bid", "ask"], 7200, name="before")
    m = T.settled_sample_filter(markets)
    d = temporal.fan_out(m, "close_s", [h * 3600 for h in horizons_hours], at="cutoff", horizon="horizon_s")
    j = temporal.asof_backward(d, q, ["ticker"], "cutoff", "end_ts", 3600, name="quote").filter("quote IS NOT NULL")
    j = j.withColumn("at", F.col("quote.end_ts")).filter(F.col("at") < F.col("settled_s"))
    j = temporal.asof_forward(j, q.select("ticker", "end_ts", "bid", "ask"), ["ticker"], "at", "end_ts", 7200, name="next")
    mid = lambda s: (F.col(f"{s}.bid") + F.col(f"{s}.ask")) / F.lit(2.0)
    p = mid("quote")
    return j.select(
        "ticker", F.col("event_ticker").alias("event"), "at", F.col("at").alias("feature_time"), F.col("close_s").alias("close_t"), F.col("settled_s").alias("settled_t"),
        (F.col("horizon_s") / 3600).cast("int").alias("horizon"), ((F.col("close_s") - F.col("at")) / F.lit(3600.0)).alias("hours_left"),
        F.col("quote.bid").alias("bid"), F.col("quote.ask").alias("ask"), p.alias("p"), (F.col("quote.ask") - F.col("quote.bid")).alias("spread"),
        (p - F.coalesce(mid("quote.before"), p)).alias("prior_move"), (F.col("result") == "yes").cast("int").alias("y"),
        F.col("next.end_ts").alias("execution_at"), F.col("next.bid").alias("execution_bid"), F.col("next.ask").alias("execution_ask"),
        F.floor(F.col("close_s") / 86400).cast("long").alias("day"),
    )


def bar_contract_rows(contracts: DataFrame, candles: DataFrame, features: DataFrame, before_close: int = 300, step: int = 60, allowance: int = 5,
                      max_age: int = 65) -> tuple[DataFrame, DataFrame]:
    """Contract rows with spot features at decision and at execution. Returns (rows, counts by exclusion reason).

    The execution quote is used only if it ends exactly one step after the decision quote; its spot features must then
    exist too. The newest usable quote counts whatever its age: an old one is stale, the one before it gives the prior move.
    """
    q = candles.filter("bid IS NOT NULL").select("ticker", "end_ts", "bid", "ask")
    q = temporal.with_previous(q, ["ticker"], "end_ts", ["bid", "ask"], None, name="before")
    d = contracts.withColumn("reason", T.supported_contract(contracts)).withColumn("at", F.col("close_s") - F.lit(before_close))
    j = temporal.asof_backward(d, q, ["ticker"], "at", "end_ts", None, allowance=allowance, name="quote")
    two_sided = (F.col("quote.bid") > 0) & (F.col("quote.ask") < 1)
    fresh = (F.col("at") - F.col("quote.end_ts") <= max_age) & (F.col("quote.end_ts") > F.col("open_s"))
    j = j.withColumn("reason", F.coalesce("reason", F.when(F.col("quote").isNull(), "no_quote").when(~fresh, "stale_quote").when(~two_sided, "no_two_sided_price")))
    nxt = q.select("ticker", (F.col("end_ts") - F.lit(step)).alias("_e"), F.col("bid").alias("execution_bid"), F.col("ask").alias("execution_ask"))
    j = j.withColumn("_e", F.col("quote.end_ts")).join(nxt, ["ticker", "_e"], "left")
    j = j.withColumn("execution_at", F.when(F.col("execution_bid").isNotNull() & (F.col("_e") + step + allowance < F.col("close_s")), F.col("_e") + F.lit(step + allowance)))
    names = [c for c in features.columns if c != "bar"]

    def at_time(time: Column, prefix: str) -> tuple[Column, DataFrame]:
        return windows.last_complete_bar(time, step, allowance), features.select(F.col("bar").alias(f"_{prefix}bar"), F.struct(*names).alias(f"{prefix}spot"))

    for time, prefix in ((F.col("at"), ""), (F.col("execution_at"), "execution_")):
        key, f = at_time(time, prefix)
        j = j.withColumn(f"_{prefix}bar", key).join(f, f"_{prefix}bar", "left")
    j = j.withColumn("reason", F.coalesce("reason", F.when(F.col("spot").isNull() | (F.col("execution_at").isNotNull() & F.col("execution_spot").isNull()), "missing_lookback")))
    mid = (F.col("quote.bid") + F.col("quote.ask")) / F.lit(2.0)
    before = (F.col("quote.before.bid") + F.col("quote.before.ask")) / F.lit(2.0)
    rows = j.filter("reason IS NULL").withColumns({
        "bid": F.col("quote.bid"), "ask": F.col("quote.ask"), "p": mid, "spread": F.col("quote.ask") - F.col("quote.bid"), "prior_move": mid - F.coalesce(before, mid),
        "y": (F.col("result") == "yes").cast("int"), "quote_at": F.col("quote.end_ts"), "day": F.floor(F.col("close_s") / 86400).cast("long"),
    }).drop("quote", "reason", "_e", "_bar", "_execution_bar")
    return rows, quality.exclusion_report(j)


def flow_cohort(rows: DataFrame, flow: DataFrame, bounds: tuple[int, int], embargo: int = 7200, step: int = 60, allowance: int = 5, lag: int = 60) -> DataFrame:
    """Whole-hour cohort with flow features at execution and the same features one lag older, labelled by partition.

    ``flow`` has bar, imbalance_5, imbalance_15, basis_bps, change_bps; a row without a complete window keeps a reason.
    """
    base = splits.whole_hours(rows, "close_s", 3600).filter("execution_at IS NOT NULL")
    names = ["imbalance_5", "imbalance_15", "basis_bps", "change_bps"]
    for delay, prefix in ((0, ""), (lag, "lag_")):
        f = flow.select(F.col("bar").alias(f"_{prefix}b"), *[F.col(n).alias(prefix + n) for n in names])
        base = base.withColumn(f"_{prefix}b", windows.last_complete_bar(F.col("execution_at") - F.lit(delay), step, allowance)).join(f, f"_{prefix}b", "left").drop(f"_{prefix}b")
    missing = F.lit(False)
    for n in names:
        missing = missing | F.col(n).isNull()
    a, b = bounds
    part = F.when(F.col("close_s") < a, "train").when(F.col("close_s") < b, "validation").otherwise("holdout")
    start = F.when(part == "validation", a).when(part == "holdout", b)
    return base.withColumn("role", part).withColumn("reason", F.when(missing, "missing_flow_window").when(F.col("execution_at") < start + embargo, "embargo"))


def weather_samples(samples: DataFrame, bounds: DataFrame, lead_hours: DataFrame, offset_hours: int = 5) -> tuple[DataFrame, DataFrame]:
    """Samples with two providers at two leads, freshest eligible lead first. Returns (rows, counts by reason).

    ``lead_hours``: long (series, provider, lead, valid_at, value) on whole hours in microseconds. A fixed-lead day
    maximum is available from its last valid hour - 24 lead hours + 6 hours on, and needs all 24 hours.
    """
    s = samples.join(bounds, "ticker", "left")
    days = s.select("series", "event_day").distinct().withColumn("day_start", F.unix_micros(F.col("event_day").cast("timestamp")) + F.lit(offset_hours * HOUR))
    keys = ["series", "provider", "lead"]
    combos = days.join(lead_hours.select(*keys).distinct(), "series")
    full = temporal.complete_days(combos, lead_hours, keys, "day_start", "valid_at", "value", HOUR).filter("hours = 24")
    wide = full.groupBy("series", "event_day", "day_start", "lead").agg(
        F.max(F.when(F.col("provider") == "gfs", F.col("day_max"))).alias("gfs"), F.max(F.when(F.col("provider") == "ecmwf", F.col("day_max"))).alias("ecmwf")
    ).filter("gfs IS NOT NULL AND ecmwf IS NOT NULL")
    ready = F.col("day_start") + F.lit(23 * HOUR) - F.col("lead") * F.lit(24 * HOUR) + F.lit(6 * HOUR)
    j = s.join(wide, ["series", "event_day"]).withColumn("available_t", ready)
    best = temporal.freshest_available(j.select("ticker", "at", "lead", "gfs", "ecmwf", "available_t", "day_start"), ["ticker", "at"], "lead", F.col("available_t") <= F.col("at"))
    out = s.join(best, ["ticker", "at"], "left").withColumn(
        "reason", F.when(F.col("lower").isNull() & F.col("upper").isNull(), "unsupported_strike").when(F.col("gfs").isNull(), "no_available_forecast")
    )
    return out.filter("reason IS NULL").drop("reason"), quality.exclusion_report(out)


def station_join(rows: DataFrame, obs: DataFrame, delays_minutes: list[int] = (30, 90), offset: Column | None = None) -> DataFrame:
    """Weather rows with the station's observed features under each publication delay (tall by ``delay_minutes``), in one scan.

    ``offset`` is the station's fixed day start inside the UTC day, an expression over ``obs`` (default 0)."""
    found = windows.running_max_obs(rows, obs, ["station"], "at", "day_start", "t", [d * 60 * MICRO for d in delays_minutes], offset=offset)
    return found.withColumn("delay_minutes", (F.col("delay") / (60 * MICRO)).cast("int")).drop("delay")


def archive_join(rows: DataFrame, hours: DataFrame, obs: DataFrame, embargo: int = 48 * HOUR, offset: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Archived runs and observations attached after split membership is frozen. Returns (rows, counts by reason).

    The split is decided on all rows; rows that later lack an archive are dropped from their own part only.
    """
    roles = splits.split_fraction_days(splits.day_table(rows), embargo)
    frozen = splits.apply_day_roles(rows, roles)
    f = windows.remaining_max(frozen.select("ticker", "at", "station", "day_start"), hours, ["station"], "at", "day_start", "initialized")
    latest = f.groupBy("ticker", "at", "station", "day_start").agg(F.max_by(F.struct("remaining_forecast_max", "disagreement", "forecast_available_at"), "initialized").alias("forecast"))
    j = frozen.join(latest, ["ticker", "at", "station", "day_start"], "left")
    j = windows.running_max_obs(j, obs, ["station"], "at", "day_start", "t", 30 * 60 * MICRO, offset=offset)
    j = j.withColumn("reason", F.coalesce(F.when(F.col("forecast").isNull(), "no_complete_run"), F.col("reason")))
    return j.filter("reason IS NULL").drop("reason"), j.groupBy("role", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def prospective_dataset(weather: DataFrame, markets: DataFrame, books: DataFrame, outcomes: DataFrame, max_book_age: int = 180 * MICRO,
                        max_forecast_hours: float = 12.0) -> tuple[DataFrame, DataFrame]:
    """Point-in-time join of a journal's streams; labels are target-only. Returns (rows, counts by reason).

    weather(ticker, at, forecast_complete, forecast_age_hours, ...), markets(ticker, available_t, close_t, event, supported),
    books(ticker, available_t, observed_t, bid, ask), outcomes(ticker, settled_t, yes_payout). The newest market and book
    count however old; a market needs supported rules and must be open, a forecast complete and fresh. One row per contract
    and hour, the first seen.
    """
    from tidemark.operators.ranking import one_per_hour

    j = temporal.asof_backward(weather, markets, ["ticker"], "at", "available_t", None, name="market")
    j = temporal.asof_backward(j, books, ["ticker"], "at", "available_t", None, name="book")
    stale = F.col("at") - F.col("book.observed_t") > max_book_age
    bad = ~((F.col("book.bid") >= 0) & (F.col("book.bid") <= F.col("book.ask")) & (F.col("book.ask") <= 1))
    j = j.withColumn("reason", F.when(F.col("market").isNull() | F.col("book").isNull(), "missing_market_or_book").when(~F.coalesce(F.col("market.supported"), F.lit(False)), "unsupported_rules").when(stale, "stale_book").when(F.col("book.bid").isNull() | F.col("book.ask").isNull(), "empty_book").when(bad, "invalid_book"))
    ready = j.filter("reason IS NULL").drop("reason")
    good, rejected = temporal.label_after(ready, outcomes.select("ticker", "settled_t", "yes_payout"), ["ticker"], "at", "settled_t", "yes_payout")
    known = F.coalesce(F.col("forecast_complete"), F.lit(False)) & F.coalesce(F.col("forecast_age_hours") <= max_forecast_hours, F.lit(False))
    gated = good.withColumn("reason", F.when(F.col("market.close_t") <= F.col("at"), "already_closed").when(~known, "incomplete_or_stale_forecast"))
    good, late = gated.filter("reason IS NULL").drop("reason"), gated.filter("reason IS NOT NULL")
    rejected = rejected.select("reason").unionByName(late.select("reason"))
    counts = quality.exclusion_report(j.filter("reason IS NOT NULL").select("reason").unionByName(rejected.select("reason")).unionByName(good.select(F.lit(None).cast("string").alias("reason"))))
    return one_per_hour(good, ["ticker"], "at", HOUR, "at"), counts


# Series of a category that are looked at, and of these how many with an open quoted market are shown.
LISTED, SHOWN = {"weather": 4, "other": 30}, {"weather": 4, "other": 3}


def market_board(series: DataFrame, events: DataFrame, markets: DataFrame, now: Column) -> DataFrame:
    """Cards of open, two-sided markets: top series per category (LISTED, SHOWN), effective fee with event overrides, spread, status and edge."""
    from tidemark.operators.ranking import top_per_group

    limit = lambda n: F.when(F.col("category") == "weather", n["weather"]).otherwise(n["other"])

    s = series.withColumn("category", T.category_of(F.col("title"), F.col("series"), F.col("tags"), F.col("categories"), F.col("frequency"))).filter("category IS NOT NULL")
    top = top_per_group(s, ["category"], [F.desc("priority"), F.desc("volume"), F.asc("series")], max(LISTED.values())).filter(F.col("rank") <= limit(LISTED))
    quoted = markets.filter((F.col("close_t") > now) & (F.col("bid") >= 0) & (F.col("bid") <= F.col("ask")) & (F.col("ask") <= 1))
    found = top.withColumnRenamed("rank", "place").join(quoted.select("series").distinct(), "series", "left_semi")
    shown = top_per_group(found, ["category"], [F.asc("place")], max(SHOWN.values())).filter(F.col("rank") <= limit(SHOWN))
    m = quoted.join(shown.select("series", "category", "fee_type", "fee_multiplier"), "series")
    m = m.join(events.select("event", "fee_type_override", "fee_multiplier_override"), "event", "left")
    from tidemark.functions.money import board_edge

    return m.withColumns({
        "fee_rate": T.effective_fee(F.col("fee_type"), F.col("fee_multiplier"), F.col("fee_type_override"), F.col("fee_multiplier_override")),
        "spread": F.col("ask") - F.col("bid"), "tradeable": F.col("status").isin("active", "open"), "estimated_edge": board_edge(F.col("model_p"), F.col("bid"), F.col("ask")),
    })


def _variants(df: DataFrame, features: list[str], variants: dict[str, list[str]], name: str = "variant") -> DataFrame:
    """Every row once per variant; features that the variant leaves out are zero."""
    arr = F.array(*[F.struct(F.lit(v).alias(name), *[F.lit(float(f in keep)).alias(f"_k_{f}") for f in features]) for v, keep in variants.items()])
    tall = df.withColumn("_v", F.explode(arr))
    return tall.withColumns({name: F.col(f"_v.{name}"), **{f: F.col(f) * F.col(f"_v._k_{f}") for f in features}}).drop("_v")


def _squared_difference(p: str, base: str) -> Column:
    q, m = clip(F.col(p), 1e-6, 1 - 1e-6), clip(F.col(base), 1e-6, 1 - 1e-6)
    return brier(q, F.col("y")) - brier(m, F.col("y"))


def ablation(rows: DataFrame, features: list[str], variants: dict[str, list[str]], by: list[str] | None = None, control: str | None = None, reps: int = 3000, **fit) -> DataFrame:
    """Feature subsets fitted side by side as one many-model fit; excluded features are zero in their variant.

    With ``control`` (a variant; rows then need a unique ``id``) also the mean squared-error difference of each other
    variant from it on the same rows, with its day-cluster interval.
    """
    by = by or []
    tall = _variants(rows, features, variants)
    coef = models.fit_market_offset(tall, [*by, "variant"], features, **fit)
    scored = models.score_offset(tall, coef, [*by, "variant"], features)
    out = metrics.binary_metrics(scored, [*by, "variant"], "predicted", "y", "day")
    if control is None:
        return out
    # The control of a row stands beside its variants by one aggregate over the row's few predictions.
    one = F.struct("variant", "predicted")
    pairs = scored.groupBy(*by, "id", "day", "y").agg(F.collect_list(one).alias("_all"), F.max(F.when(F.col("variant") == control, F.col("predicted"))).alias("_control"))
    pairs = pairs.select(*by, "day", "y", "_control", F.inline("_all")).filter(F.col("variant") != control)
    paired = resample.cluster_bootstrap(pairs, [*by, "variant"], "day", _squared_difference("predicted", "_control"), reps=reps)
    return out.join(paired.drop("clusters"), [*by, "variant"], "left")


def rolling_study(rows: DataFrame, folds: list[tuple[int, int]], features: list[str], variants: dict[str, list[str]], embargo: int, reps: int = 3000,
                  delays: dict[str, dict[str, str]] | None = None, candidate: str | None = None, controls: list[str] | None = None) -> dict[str, DataFrame]:
    """Folds x variants x delays: train-only scaling, one many-model fit, validation scores, paired day intervals, gate.

    ``delays`` names scenarios and the columns that stand for a feature in them (its value when the input arrives late);
    models are fitted on current features only and scored in every scenario, ``current`` among them. With ``candidate``
    the promotion gate judges it against ``controls`` (default: the market) on the current scenario. Everything is keyed
    by (fold, scenario, variant), so the number of Spark jobs does not depend on how many there are.
    """
    f = splits.rolling_folds(rows, folds, embargo)
    train, val = f.filter("role = 'train'"), f.filter("role = 'validation'")
    stats = written(models.moments(train, ["fold"], features), "statistics")  # read more than once
    z = [f"z_{c}" for c in features]
    zvariants = {v: [f"z_{c}" for c in keep] for v, keep in variants.items()}
    coef = models.fit_market_offset(_variants(models.standardize(train, stats, ["fold"], features), z, zvariants), ["fold", "variant"], z)
    scenarios = {"current": {}, **(delays or {})}
    seen = F.array(*[F.struct(F.lit(s).alias("scenario"), *[F.col(late.get(c, c)).cast("double").alias(f"_s_{c}") for c in features]) for s, late in scenarios.items()])
    val = val.withColumn("_s", F.explode(seen)).withColumns({"scenario": F.col("_s.scenario"), **{c: F.col(f"_s._s_{c}") for c in features}}).drop("_s")
    scored = models.score_offset(_variants(models.standardize(val, stats, ["fold"], features), z, zvariants), coef, ["fold", "variant"], z)
    columns = ["fold", "scenario", "variant", "day", "p", "y", "predicted", "bid", "ask"]
    market = val.withColumns({"variant": F.lit("market"), "predicted": F.col("p")}).select(*columns)
    both = scored.select(*columns).unionByName(market).withColumnRenamed("variant", "model")
    fitted = both.filter("model <> 'market'")
    per_fold = metrics.binary_metrics(both, ["fold", "scenario", "model"], "predicted", "y", "day")
    pooled = metrics.binary_metrics(both, ["scenario", "model"], "predicted", "y", "day")
    paired = resample.cluster_bootstrap(fitted, ["scenario", "model"], "day", _squared_difference("predicted", "p"), reps=reps)
    trades = pnl.opportunity_pnl(fitted, ["scenario", "model"], p="predicted", day="day")
    out = {"coefficients": coef, "scored": both, "per_fold": per_fold, "pooled": pooled, "paired": paired, "opportunities": trades}
    if candidate:
        now = lambda d: d.filter("scenario = 'current'").drop("scenario")
        # An aggregate, so that a candidate without any trade is one row of zeros.
        traded = now(trades).filter(F.col("model") == candidate).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("opportunities", "entries"), ("days_traded", "days_traded"), ("pnl", "pnl"))]
        )
        out["gate"] = pnl.promotion_gate(now(per_fold), now(pooled), traded, candidate, controls or ["market"])
    return out


def paired_arms(rows: DataFrame, arms: dict[str, list[str]], weights: list[float], embargo: int) -> dict[str, DataFrame]:
    """Two feature sets on identical rows: rows missing any arm's inputs leave both arms; weight chosen on validation only."""
    every = sorted({f for fs in arms.values() for f in fs})
    usable = rows.dropna(subset=every)
    usable = splits.apply_day_roles(usable, splits.split_fraction_days(splits.day_table(usable), embargo))
    train = usable.filter("role = 'train'")
    stats = models.moments(train, [], every)
    z = models.standardize(usable, stats, [], every)
    names = [f"z_{f}" for f in every]
    tall = _variants(z, names, {a: [f"z_{f}" for f in fs] for a, fs in arms.items()}, name="arm")
    coef = models.fit_market_offset(tall.filter("role = 'train'"), ["arm"], names)
    scored = models.score_offset(tall.filter("role = 'validation'"), coef, ["arm"], names)
    chosen = models.select_weight(scored, ["arm"], "predicted", "p", "y", "day", weights)
    weighted, bins = metrics.event_date_weighted(scored, ["arm"], "predicted", "y", "day", "event")
    interval = resample.day_mean_block_bootstrap(scored, ["arm"], "day", log_loss(F.col("predicted"), F.col("y"), 1e-8) - log_loss(F.col("p"), F.col("y"), 1e-8))
    return {"weights": chosen, "scores": weighted, "reliability": bins, "interval": interval}


def station_pilot(days: DataFrame, hours: DataFrame, labels: DataFrame, train_before: int, step: int = HOUR, count: int = 24, min_days: int = 90) -> dict[str, DataFrame]:
    """Label join, bias fit, distribution scores with and without the bias, block interval of the CRPS difference.

    days(station, day, start), hours(station, valid_at, value), labels(station, day, target, issued_t); a day has
    ``count`` values ``step`` apart. A label issued before the station day ended is rejected; training uses days before
    ``train_before`` whose label precedes it too, and a station needs ``min_days`` of them.
    """
    full = temporal.complete_days(days, hours, ["station"], "start", "valid_at", "value", step, count=count).filter(F.col("hours") == count)
    rows = full.join(labels, ["station", "day"]).filter(F.col("issued_t") >= F.col("start") + F.lit(DAY))
    cut = F.lit(train_before)
    train = rows.filter((F.col("day") < cut) & (F.col("issued_t") < cut * F.lit(DAY)))
    model = metrics.station_bias_fit(train, "station", "target", "day_max", min_days=min_days)
    val = rows.filter(F.col("day") >= cut).join(model.drop("n"), "station").filter("bias IS NOT NULL")
    raw = metrics.gaussian_rows(val, "target", F.col("day_max"), F.col("sigma_raw")).withColumn("model", F.lit("raw"))
    cor = metrics.gaussian_rows(val, "target", F.col("day_max") + F.col("bias"), F.col("sigma_corrected")).withColumn("model", F.lit("corrected"))
    both = raw.unionByName(cor)
    seg = metrics.segments(both, {"overall": F.lit("all"), "station": F.col("station"), "quarter": F.quarter(F.date_from_unix_date(F.col("day").cast("int"))).cast("string")})
    diff = raw.select("station", "day", F.col("crps").alias("_r")).join(cor.select("station", "day", F.col("crps").alias("_c")), ["station", "day"])
    return {"model": model, "scores": metrics.gaussian_summary(seg, ["model", "kind", "segment"]), "interval": resample.day_mean_block_bootstrap(diff, [], "day", F.col("_c") - F.col("_r"), reps=3000)}


def loss_diagnosis(rows: DataFrame, trades: DataFrame, features: list[str], is_train: Column, proxy: DataFrame | None = None, proxy_by: str = "series") -> dict[str, DataFrame]:
    """Attribution, edge buckets, fixed-cohort repricing, slippage tolerance, scores, timing and feature shift of one policy.

    ``proxy`` (y, strike, final and opening bars, ``proxy_by``) adds how far the price source disagrees with the official
    labels (see ``metrics.source_audit``).
    """
    from tidemark.functions.money import max_slippage

    best = metrics.with_best_side(rows, p="q")
    best = best.withColumn("realized", metrics.one_contract_pnl(F.col("side"), F.col("y"), F.col("bid"), F.col("ask")))
    win = F.when(F.col("side") == "yes", F.col("q")).otherwise(F.lit(1.0) - F.col("q"))
    price = F.when(F.col("side") == "yes", F.col("ask")).otherwise(F.lit(1.0) - F.col("bid"))
    signals = best.filter("edge >= 0.04").withColumn("tolerance", max_slippage(win, price))
    forecasts = rows.select("day", "y", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("predicted")) for m, c in (("market", "p"), ("model", "q"))])))
    # Prices are rebuilt from 1 - bid; rounding to the tick keeps them on their side of a bucket's edge.
    attributed = pnl.trade_attribution(trades).withColumn("price", rounded(F.col("price"), 4))
    out = {
        "attribution": pnl.attribution_summary(attributed, []),
        "edges": metrics.edge_buckets(best, "edge", "realized", "event"),
        "repriced": pnl.fixed_cohort_reprice(trades, ["0", "0.005", "0.01", "0.02", "0.05"]),
        "signals": signals,
        "tolerance": signals.agg(F.count(F.lit(1)).alias("signals"), F.max("tolerance").alias("largest"), F.avg("tolerance").alias("mean")),
        "timing": metrics.timing_audit(rows, {"to_close": F.col("close_t") - F.col("at")}),
        "drift": metrics.drift(rows, features, is_train),
        "scores": metrics.binary_metrics(forecasts, ["model"], "predicted", "y", "day"),
    }
    if proxy is not None:
        out["source"] = metrics.source_audit(proxy, [proxy_by])
    return out


def data_audit(rows: DataFrame, manifest: DataFrame | None, expected: DataFrame | None, embargo: int) -> dict[str, DataFrame]:
    """Integrity of files, label/quote/leakage rules, and the sizes of the purged chronological parts."""
    from tidemark.sources.sinks import verify_manifest

    good, bad = quality.validate_samples(rows, settled="settled_t", close="close_t")
    roles = splits.split_fraction_days(splits.day_table(good), embargo)
    parts = splits.partition_summary(splits.apply_day_roles(good, roles), ["role"])
    out = {"rejected": bad.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n")), "parts": parts}
    if manifest is not None and expected is not None:
        out["files"] = verify_manifest(manifest, expected)
    return out
