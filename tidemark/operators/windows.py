"""Trailing-window features over bars, observations and forecasts; all windows are time-sliced (see ``slicing``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numeric import cyclic, normal_cdf, clip
from tidemark.operators.slicing import DAY, HOUR, halo, running, slice_of
from tidemark.operators.blocks import blocks_of_point, blocks_of_range
from tidemark.operators.ordered import deal
from tidemark.operators.ordered import running as running_ordered
from tidemark.operators.temporal import asof_backward

# Bar feature definition (minutes at the default step).
LOOKBACK, SIGMA_RETURNS, DECAY, SIGMA_FLOOR = 120, 60, 0.94, 1e-6
SHORT, RECENT = 15, 5
RETURNS = (1, 5, 15, 60)
PERIODS_PER_DAY = 86400


def ohlcv(df: DataFrame, by: list[str], t: str, price: str, size: Column, step: int, tie: str, buy: Column | None = None) -> DataFrame:
    """Bars from ticks: the bar start is ``floor(t / step) * step``. One map-side combined aggregate."""
    order = F.struct(t, tie)
    return (
        df.withColumn("_size", size)
        .withColumn("_buy", buy if buy is not None else F.lit(0.0))
        .groupBy(*by, (F.floor(F.col(t) / F.lit(step)) * F.lit(step)).cast("long").alias("bar"))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, order).alias("close"), F.sum("_size").alias("volume"), F.sum("_buy").alias("buy"),
            F.count(F.lit(1)).alias("trades"),
        )
    )


def rollup_bars(bars: DataFrame, by: list[str], bar: str, step: int) -> DataFrame:
    """Coarser bars from finer ones: first open, extreme high/low, last close, summed volume, buy and trades."""
    return bars.groupBy(*by, (F.floor(F.col(bar) / F.lit(step)) * F.lit(step)).cast("long").alias("_b")).agg(
        F.min_by("open", bar).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", bar).alias("close"), F.sum("volume").alias("volume"), F.sum("buy").alias("buy"),
        F.sum("trades").alias("trades"), F.count(F.lit(1)).alias("pieces"),
    ).withColumnRenamed("_b", bar)


def last_complete_bar(decision: Column, step: int, allowance: int) -> Column:
    """Start of the newest bar that is finished and published at ``decision`` (bar times are starts)."""
    return (F.floor((decision - F.lit(allowance)) / F.lit(step)) * F.lit(step) - F.lit(step)).cast("long")


def bar_features(bars: DataFrame, by: list[str], t: str, step: int, lookback: int = LOOKBACK, sigma_returns: int = SIGMA_RETURNS,
                 returns: tuple[int, ...] = RETURNS, short: int = SHORT, recent: int = RECENT, width: int | None = None, valid: bool = True) -> DataFrame:
    """Per-bar features that do not depend on a strike, only for bars ending ``lookback`` contiguous valid ones.

    sigma is a finite exponentially weighted root mean square of the last ``sigma_returns`` log returns, so it needs no
    recursion. Slices are many look-backs wide; only look-back rows are copied across a slice edge. Without ``valid`` bars
    only have to be contiguous; the range of a bar that went down to zero is infinite.
    """
    span = (lookback - 1) * step
    width = width or max(8 * lookback * step, span + step)
    rows = halo(bars, t, width, back=span)
    w = W.partitionBy(*by, "_slice").orderBy(t)
    frame = lambda n: w.rowsBetween(-(n - 1), 0)
    c, v = F.col("close"), F.col("volume")
    ok = F.lit(not valid) | (F.col("low") > 0) & (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high")) & (v >= 0)
    rows = rows.withColumn("_r", F.log(c / F.lag(c).over(w))).withColumn("_r2", F.col("_r") * F.col("_r"))
    weights = [DECAY**i for i in range(sigma_returns - 1, -1, -1)]
    weighted = F.aggregate(
        F.zip_with(F.collect_list("_r2").over(frame(sigma_returns)), F.array(*[F.lit(x) for x in weights]), lambda a, b: a * b),
        F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)),
    )
    rows = rows.select(
        "*",
        (F.col(t) - F.lag(t, lookback - 1).over(w) == F.lit(span)).alias("_whole"),
        F.min(ok.cast("int")).over(frame(lookback)).alias("_ok"),
        F.greatest(F.sqrt(weighted / F.lit(sum(weights))), F.lit(SIGMA_FLOOR)).alias("sigma"),
        F.stddev_pop("_r").over(frame(short)).alias("_sd"),
        (F.avg(v).over(frame(recent)) / F.greatest(F.avg(v).over(frame(lookback)), F.lit(1e-8))).alias("volume_ratio"),
        *[F.log(c / F.lag(c, k).over(w)).alias(f"_ret{k}") for k in returns],
    ).filter(F.col("_core") & F.col("_whole") & (F.col("_ok") == 1))
    sigma = F.col("sigma")
    return rows.select(
        *by, t, c.alias("spot"), "sigma",
        *[(F.col(f"_ret{k}") / (sigma * F.sqrt(F.lit(float(k))))).alias(f"return_{k}") for k in returns],
        (F.col("_sd") / sigma).alias("volatility_ratio"), "volume_ratio",
        (F.when(F.col("low") != 0, F.log(F.col("high") / F.col("low"))).when(F.col("high") > 0, F.lit(float("inf"))) / sigma).alias("range_ratio"),
    )


def spot_features(decisions: DataFrame, features: DataFrame, by: list[str], at: str, close: str, strike: str, bar: str, step: int,
                  allowance: int, unit_per_second: int = 1) -> DataFrame:
    """Decision features: the newest complete bar by exact key, sigma-scaled distance to the strike and hour of day.

    Point-in-time rule: feature_time = bar end <= feature_available_at = bar end + allowance <= decision.
    """
    d = decisions.withColumn(bar, last_complete_bar(F.col(at), step, allowance))
    j = d.join(features, [*by, bar])
    horizon = (F.col(close) - (F.col(bar) + F.lit(step))) / F.lit(float(step))
    z = F.log(F.col("spot") / F.col(strike)) / (F.col("sigma") * F.sqrt(horizon))
    seconds = F.pmod(F.floor(F.col(at) / F.lit(unit_per_second)), F.lit(PERIODS_PER_DAY))
    sin, cos = cyclic(seconds, PERIODS_PER_DAY)
    return (
        j.filter((horizon >= 2) & (F.col(strike) > 0))
        .withColumn("distance", z)
        .withColumn("diffusion", clip(normal_cdf(z), 1e-6, 1 - 1e-6))
        .withColumn("hour_sin", sin).withColumn("hour_cos", cos)
        .withColumn("feature_time", F.col(bar) + F.lit(step))
        .withColumn("feature_available_at", F.col(bar) + F.lit(step + allowance))
    )


def imbalance(bars: DataFrame, by: list[str], t: str, step: int, lengths: list[int], width: int | None = None) -> DataFrame:
    """Signed flow 2 * buy / volume - 1 over the last n contiguous bars; NULL on a gap or zero volume."""
    longest = max(lengths)
    rows = halo(bars, t, width or 64 * longest * step, back=(longest - 1) * step)
    w = W.partitionBy(*by, "_slice").orderBy(t)
    out = rows
    for n in lengths:
        frame = w.rowsBetween(-(n - 1), 0)
        volume, buy = F.sum("volume").over(frame), F.sum("buy").over(frame)
        whole = (F.col(t) - F.lag(t, n - 1).over(w) == F.lit((n - 1) * step)) if n > 1 else F.lit(True)
        out = out.withColumn(f"imbalance_{n}", F.when(whole & (volume > 0), F.lit(2.0) * buy / volume - F.lit(1.0)))
    return out.filter("_core").drop("_core", "_slice")


def basis_change(basis: DataFrame, by: list[str], t: str, lag: int) -> DataFrame:
    """Basis minus the basis exactly ``lag`` earlier (exact-key lookup, NULL when that bar is missing)."""
    old = basis.select(*by, (F.col(t) + F.lit(lag)).alias(t), F.col("basis_bps").alias("_old"))
    return basis.join(old, [*by, t], "left").withColumn("change_bps", F.col("basis_bps") - F.col("_old")).drop("_old")


def micro_features(bars: DataFrame, by: list[str], t: str, width: int | None = None, step: int = 1, lengths: tuple[int, int, int] = (5, 15, 60)) -> DataFrame:
    """Features of ``lengths[-1] + 1`` contiguous fine bars: short, middle and long flow imbalance, returns in bps, trades.

    Zero volume is a valid quiet period here and gives imbalance 0.
    """
    a, b, c = lengths
    rows = halo(bars, t, width or 3600 * step, back=c * step)
    w = W.partitionBy(*by, "_slice").orderBy(t)

    def flow(n: int) -> Column:
        volume, buy = F.sum("volume").over(w.rowsBetween(-(n - 1), 0)), F.sum("buy").over(w.rowsBetween(-(n - 1), 0))
        return F.when(volume > 0, F.lit(2.0) * buy / volume - F.lit(1.0)).otherwise(F.lit(0.0))

    move = lambda n: F.log(F.col("close") / F.lag("close", n).over(w)) * F.lit(10000.0)
    out = rows.select(
        *by, t, "_core", (F.col(t) - F.lag(t, c).over(w) == F.lit(c * step)).alias("_whole"),
        flow(b).alias("imbalance_mid"), move(b).alias("return_mid_bps"), (flow(a) - flow(c)).alias("imbalance_shift"),
        move(a).alias("return_short_bps"), F.sum("trades").over(w.rowsBetween(-(c - 1), 0)).alias("trades_long"),
    )
    return out.filter("_core AND _whole").drop("_core", "_whole")


def delayed_features(rows: DataFrame, features: DataFrame, by: list[str], at: str, t: str, delays: list[int], step: int, allowance: int) -> DataFrame:
    """The same features as of ``at - delay`` for each delay; label and quote columns stay untouched."""
    d = rows.withColumn("delay", F.explode(F.array(*[F.lit(x).cast("long") for x in delays])))
    d = d.withColumn(t, last_complete_bar(F.col(at) - F.col("delay"), step, allowance))
    return d.join(features, [*by, t], "left")


def execution_rows(df: DataFrame, refreshed: str | None = None) -> DataFrame:
    """Re-point each row at its execution quote; rows without a two-sided execution quote are dropped.

    ``refreshed`` names a struct of the features completed by the execution time: its fields take the place of the
    columns of those names, so that a forecast made from the row never mixes old inputs with a later quote.
    """
    bid, ask = F.col("execution_bid"), F.col("execution_ask")
    mid = (bid + ask) / F.lit(2.0)
    fields = df.schema[refreshed].dataType.names if refreshed else []
    out = df.filter(F.col("execution_at").isNotNull() & (bid > 0) & (bid <= ask) & (ask < 1)).withColumns(
        {"prior_move": mid - F.col("p"), "at": F.col("execution_at"), "bid": bid, "ask": ask, "p": mid, "spread": ask - bid, **{f: F.col(refreshed)[f] for f in fields}}
    )
    return out.drop(refreshed) if refreshed else out


def running_max_obs(decisions: DataFrame, obs: DataFrame, by: list[str], at: str, day_start: str, t: str, delay: int | list[int],
                    stale: int = 3 * HOUR, offset: Column | None = None) -> DataFrame:
    """Observed extremes of the station day at the decision.

    Point-in-time rule: an observation counts from ``t + delay`` on, only inside its own day; a six-hour maximum only
    if its whole window lies in the day; the newest usable observation must not be older than ``stale``. Several delays
    give a row each, told apart by a column ``delay``.

    Observations and the probes of all delays are read in one order per (station, day): running maximum, count and newest
    observation in one scan, linear in both. ``offset`` is the station's day start within the UTC day (default 0), an
    expression over ``obs``.
    """
    shift = offset if offset is not None else F.lit(0)
    start = (F.floor((F.col(t) - shift) / F.lit(DAY)) * F.lit(DAY) + shift).cast("long")
    keys, delays = [*by, "_day"], delay if isinstance(delay, list) else [delay]
    inside = F.when(F.col(t) - F.lit(6 * HOUR) >= start, F.col("max_6h"))
    readings = obs.select(*by, start.alias("_day"), F.col(t).alias("_t"), F.lit(0).alias("_side"), F.col("temperature").alias("_temp"), F.greatest("temperature", inside).alias("_high"))
    probe = F.explode(F.array(*[F.lit(d).cast("long") for d in delays])).alias("delay")
    probes = decisions.select(*by, F.col(day_start).alias("_day"), F.struct(*decisions.columns).alias("_d"), F.col(at).alias("_at"), probe)
    probes = probes.select(*keys, F.least(F.col("_at") - F.col("delay"), F.col("_day") + F.lit(DAY - 1)).alias("_t"), F.lit(1).alias("_side"), "_d", "delay")
    parts = deal(readings.unionByName(probes, allowMissingColumns=True), keys, ["_t", "_side"])
    if parts.cut:
        found = _observed_in_parts(readings, probes, keys)
    else:
        upto = parts.window("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
        hours_before = parts.window("_t").rangeBetween(W.unboundedPreceding, -2 * HOUR)
        rows = parts.rows.withColumn("_older", F.last("_temp", ignorenulls=True).over(hours_before))
        reading = F.when(F.col("_side") == 0, F.struct("_t", "_temp", "_older"))
        rows = rows.withColumns({"_max": F.max("_high").over(upto), "_count": F.sum(1 - F.col("_side")).over(upto), "_o": F.last(reading, ignorenulls=True).over(upto)})
        found = rows.filter("_side = 1").select("_d", "delay", "_max", "_count", "_o")
    age = F.col(f"_d.{at}") - F.col("_o._t")
    out = found.withColumns({
        "observed_max": F.when(F.col("_o").isNotNull(), F.col("_max")), "observed_temperature": F.col("_o._temp"), "observation_at": F.col("_o._t"),
        "observation_count": F.when(F.col("_o").isNotNull(), F.col("_count").cast("long")),
        "observed_trend": F.when(F.col("_o").isNotNull(), F.coalesce(F.col("_o._temp") - F.col("_o._older"), F.lit(0.0))), "observation_age": age,
        "reason": F.when(F.col("_o").isNull(), "no_observation").when(age > F.lit(stale), "stale_observation"),
    })
    names = ["observed_max", "observed_temperature", "observation_at", "observation_count", "observed_trend", "observation_age", "reason"]
    return out.select("_d.*", *(["delay"] if isinstance(delay, list) else []), *names)


def _observed_in_parts(readings: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """The same for a station day that is cut: running maximum and count by parts, then the newest reading of each probe."""
    run = running_ordered(readings, keys, ["_t", "_temp"], {"_count": F.lit(1)}, {"_max": F.col("_high")})
    older = readings.select(*keys, F.col("_t").alias("_ot"), F.col("_temp").alias("_otemp"))
    run = asof_backward(run.withColumn("_before", F.col("_t") - F.lit(2 * HOUR)), older, keys, "_before", "_ot", None, tie=["_otemp"], name="_old")
    right = run.select(*keys, F.col("_t").alias("_rt"), "_count", "_max", F.struct("_t", "_temp", F.col("_old._otemp").alias("_older")).alias("_o"))
    q = asof_backward(probes, right, keys, "_t", "_rt", None, tie=["_count"], name="_q")
    return q.select("_d", "delay", F.col("_q._max").alias("_max"), F.col("_q._count").alias("_count"), F.col("_q._o").alias("_o"))


#: A day and what an hour that began before it adds are at most 25 hours: blocks of up to 16.
DAY_LEVELS = 5


def remaining_max(decisions: DataFrame, hours: DataFrame, by: list[str], at: str, day_start: str, initialized: str,
                  allowance: int = 8 * HOUR, models: tuple[str, str] = ("gfs", "ecmwf")) -> DataFrame:
    """Per-model maximum of the forecast over the rest of the station day, only with full coverage of it.

    Point-in-time rule: a run is usable from initialisation + allowance (8 h or more). Hours before the decision or
    outside the day do not count. ``hours`` is long: (by..., initialized, model, valid_at, value). A run is kept as maxima
    of blocks of 1, 2, 4, 8 and 16 hours, of which a decision asks for two each at most.
    """
    if allowance < 8 * HOUR:
        raise ValueError("the publication allowance must be at least eight hours")
    ids, run = decisions.columns, [*by, "_init", "_phase"]
    phase = F.pmod(F.col("valid_at"), F.lit(HOUR))
    usable = hours.where((F.col("value") > -100) & (F.col("value") < 150) & (F.col("valid_at") >= F.col(initialized)))
    leaf = usable.groupBy(*by, F.col(initialized).alias("_init"), phase.alias("_phase"), "model", F.floor(F.col("valid_at") / HOUR).cast("long").alias("_hour")).agg(F.max("value").alias("_max"), F.count(F.lit(1)).alias("_rows"))
    table = leaf.withColumn("_block", F.explode(blocks_of_point(F.col("_hour"), DAY_LEVELS)))
    table = table.groupBy(*run, "model", "_block.level", "_block.node").agg(F.max("_max").alias("_max"), F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_hours"))
    # A run is paired with the decisions whose day ends in what it covers: those are the rows of the result, or nearly.
    spans = leaf.groupBy(*run).agg(F.min("_hour").alias("_first"), F.max("_hour").alias("_final"))
    days = lambda hour: F.floor(hour * HOUR / DAY).cast("long")
    spans = spans.withColumn("_day", F.explode(F.sequence(days(F.col("_first")), days(F.col("_final") + 1))))
    d = decisions.withColumn("_from", F.greatest(F.col(at), F.col(day_start))).withColumn("_to", F.col(day_start) + F.lit(DAY))
    d = d.withColumn("_day", F.floor((F.col("_to") - 1) / DAY).cast("long"))
    pair = d.join(spans, [*by, "_day"]).where(F.col("_init") + F.lit(allowance) <= F.col(at))
    pair = pair.withColumn("_lo", F.floor((F.col("_from") - F.col("_phase")) / HOUR).cast("long")).withColumn("_hi", F.ceil((F.col("_to") - F.col("_phase")) / HOUR).cast("long"))
    pair = pair.where((F.col("_first") <= F.col("_lo")) & (F.col("_hi") <= F.col("_final") + 1) & (F.col("_lo") < F.col("_hi")))
    asked = pair.withColumn("_block", F.explode(blocks_of_range(F.col("_lo"), F.col("_hi"), DAY_LEVELS))).select(*ids, "_init", "_phase", "_from", "_to", "_lo", "_hi", "_block.level", "_block.node")
    per_model = asked.join(table, [*run, "level", "node"]).groupBy(*ids, F.col("_init").alias(initialized), "_phase", "model", "_lo", "_hi", (F.col("_to") - F.col("_from")).alias("_need")).agg(
        F.max("_max").alias("_max"), F.sum("_hours").alias("_hours"), F.sum("_rows").alias("_rows")
    ).filter((F.col("_hours") == F.col("_hi") - F.col("_lo")) & (F.col("_rows") == F.col("_hours")))
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("_max")))
    a, b = models
    wide = per_model.groupBy(*ids, initialized, "_need").agg(one(a).alias(f"{a}_max"), one(b).alias(f"{b}_max"))
    return (
        wide.filter(F.col(f"{a}_max").isNotNull() & F.col(f"{b}_max").isNotNull())
        .withColumn("remaining_forecast_max", (F.col(f"{a}_max") + F.col(f"{b}_max")) / F.lit(2.0))
        .withColumn("disagreement", F.abs(F.col(f"{a}_max") - F.col(f"{b}_max")))
        .withColumn("remaining", F.col("_need"))
        .withColumn("forecast_available_at", F.col(initialized) + F.lit(allowance))
        .drop("_need")
    )


def interpolate_at(points: DataFrame, series: DataFrame, by: list[str], at: str, t: str, value: str, step: int, name: str = "interpolated") -> DataFrame:
    """Linear interpolation between the two grid values around ``at``; NULL unless they are exactly ``step`` apart."""
    nxt = series.select(*by, (F.col(t) - F.lit(step)).alias(t), F.col(value).alias("_next"))
    pairs = series.select(*by, t, F.col(value).alias("_this")).join(nxt, [*by, t])
    j = asof_backward(points, pairs, by, at, t, tolerance=step, name="_g")
    fraction = (F.col(at) - F.col(f"_g.{t}")) / F.lit(float(step))
    line = F.col("_g._this") + (F.col("_g._next") - F.col("_g._this")) * fraction
    inside = F.col(at) - F.col(f"_g.{t}") < F.lit(step)
    return j.withColumn(name, F.when(inside, line)).drop("_g")


def innovation(observed: DataFrame, hours: DataFrame, by: list[str], at: str, value: str, initialized: str, allowance: int = 8 * HOUR) -> DataFrame:
    """Observed minus the already issued forecast at the observation time, meaned over models that have both hours.

    NULL if the forecast was not yet available at the decision, predates nothing, or has a gap there.
    """
    n_models = F.count("model").alias("_n")
    grid = hours.groupBy(*by, initialized, F.col("valid_at")).agg(F.avg("value").alias("_mean"), n_models).filter("_n = 2")
    out = interpolate_at(observed, grid, [*by, initialized], at, "valid_at", "_mean", HOUR, name="forecast_at_observation")
    usable = (F.col(initialized) + F.lit(allowance) <= F.col("decision_at")) & (F.col(at) >= F.col(initialized))
    return out.withColumn("innovation", F.when(usable, F.col(value) - F.col("forecast_at_observation")))


def resample_path(spans: DataFrame, series: DataFrame, by: list[str], start: str, end: str, t: str, value: str, step: int, n: int = 16) -> DataFrame:
    """``n`` evenly spaced interpolated values from start to end (inclusive), as an ordered array."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    targets = spans.select(*spans.columns, i.alias("_i")).withColumn(
        "_at", F.col(start) + (F.col(end) - F.col(start)) * F.col("_i") / F.lit(float(n - 1))
    )
    # Targets fall between microseconds; the grid cell is found with the floored time, the line with the exact one.
    targets = targets.withColumn("_cell", (F.floor(F.col("_at") / F.lit(step)) * F.lit(step)).cast("long"))
    here = series.select(*by, F.col(t).alias("_cell"), F.col(value).alias("_v0"))
    nxt = series.select(*by, (F.col(t) - F.lit(step)).alias("_cell"), F.col(value).alias("_v1"))
    j = targets.join(here, [*by, "_cell"]).join(nxt, [*by, "_cell"], "left")
    f = (F.col("_at") - F.col("_cell")) / F.lit(float(step))
    v = F.when(f == 0.0, F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * f)
    path = F.transform(F.array_sort(F.collect_list(F.struct("_i", v.alias("_v")))), lambda x: x["_v"])
    return j.filter(v.isNotNull()).groupBy(*spans.columns).agg(path.alias("path")).filter(F.size("path") == n)


def covered_length(intervals: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Length of the union of intervals per key: one row an interval, however long it is.

    In the order of their starts, an interval adds what lies behind the furthest end before it: an ordered scan, then a sum.
    """
    # Copies of one interval add nothing: the longest of each start is enough.
    longest = intervals.filter(F.col(b) > F.col(a)).groupBy(*by, F.col(a).alias("_a")).agg(F.max(b).alias("_b"))
    run = running_ordered(longest, by, ["_a"], maxes={"_reached": F.col("_b")}, before=True)
    piece = F.greatest(F.lit(0), F.col("_b") - F.greatest(F.col("_a"), F.coalesce("_reached", "_a")))
    return run.groupBy(*by).agg(F.sum(piece).alias("covered"))


def revision(df: DataFrame, by: list[str], t: str, value: str, tolerance: int, tie: list[str] | None = None) -> DataFrame:
    """Difference from the previous snapshot of the same key within ``tolerance``; NULL for the first."""
    from tidemark.operators.temporal import with_previous

    out = with_previous(df, by, t, [value], tolerance, tie)
    return out.withColumn("revision", F.col(value) - F.col(f"previous.{value}")).drop("previous")


def proxy_labels(bars: DataFrame, by: list[str], t: str, period: int, step: int) -> DataFrame:
    """Rows on a regular grid: strike = close of the bar before the period, y = final close >= strike.

    ``close_time`` is each multiple of ``period``; the final bar starts at close - step, the opening at close - period - step.
    """
    b = bars.select(*by, F.col(t).alias("_t"), "close")
    final = b.withColumn("close_time", F.col("_t") + F.lit(step)).filter(F.pmod(F.col("close_time"), F.lit(period)) == 0)
    opening = b.select(*by, (F.col("_t") + F.lit(step + period)).alias("close_time"), F.col("close").alias("strike"))
    return final.join(opening, [*by, "close_time"]).select(
        *by, "close_time", "strike", F.col("close").alias("final"), (F.col("close") >= F.col("strike")).cast("int").alias("y")
    )
