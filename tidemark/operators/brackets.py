"""Mutually exclusive brackets of one event at one time; NULL bounds are unbounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def partition_check(df: DataFrame, keys: list[str], lower: str, upper: str, ticker: str, y: str | None = None) -> DataFrame:
    """One row per event with a reason when its brackets are not a complete partition of the line.

    A set of intervals with lower < upper, exactly one open lower and one open upper end tiles the line exactly when
    the finite lower bounds equal the finite upper bounds as multisets; both are compared as sorted lists, which are as
    long as the listing's ladder.
    """
    lo, hi = F.col(lower), F.col(upper)
    aggs = [
        F.count(F.lit(1)).alias("brackets"), F.count_distinct(ticker).alias("_tickers"),
        F.count_if(lo.isNull()).alias("_open_lo"), F.count_if(hi.isNull()).alias("_open_hi"),
        F.count_if(lo >= hi).alias("_bad"), F.array_sort(F.collect_list(lo.cast("double"))).alias("_lo"), F.array_sort(F.collect_list(hi.cast("double"))).alias("_hi"),
        (F.sum(y) if y else F.lit(1).cast("long")).alias("_winners") if y else F.max(F.lit(1)).alias("_winners"),
    ]
    return df.groupBy(*keys).agg(*aggs).select(
        *keys, "brackets",
        F.when(F.col("brackets") < 2, "too_few_brackets")
        .when(F.col("_tickers") != F.col("brackets"), "duplicate_ticker")
        .when(F.col("_bad") > 0, "invalid_bounds")
        .when((F.col("_open_lo") != 1) | (F.col("_open_hi") != 1), "missing_tail")
        .when(~F.col("_lo").eqNullSafe(F.col("_hi")), "gap_or_overlap")
        .when(F.col("_winners") != 1, "not_one_winner").alias("reason"),
    )


def normalize_event(df: DataFrame, keys: list[str], p: str, name: str = "p_norm") -> DataFrame:
    """p divided by the event's total; NULL when the total is zero. The totals are pre-aggregated and joined back."""
    mass = df.groupBy(*keys).agg(F.sum(p).alias("mass"))
    return df.join(mass, keys).withColumn(name, F.when(F.col("mass") > 0, F.col(p) / F.col("mass")))


def ladder_features(df: DataFrame, keys: list[str], lower: str, upper: str, p: str) -> DataFrame:
    """Median and quartile brackets by cumulative normalised mass, signed distance and missing flags.

    Input: complete partitions only (at most one row per bracket, so a group is as long as the listing's ladder).
    """
    order = W.partitionBy(*keys).orderBy(F.col(lower).asc_nulls_first())
    whole = W.partitionBy(*keys)
    cum = F.sum(F.col(p)).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = df.withColumn("ladder_mass", F.sum(p).over(whole)).withColumn("_cum", cum / F.col("ladder_mass")).filter("ladder_mass > 0")
    bounds = F.struct(F.col(lower).alias("lo"), F.col(upper).alias("hi"))
    for q, n in ((0.25, "_q25"), (0.5, "_q50"), (0.75, "_q75")):
        rows = rows.withColumn(n, F.min_by(F.when(F.col("_cum") >= q, bounds), F.when(F.col("_cum") >= q, F.col("_cum"))).over(whole))
    lo, hi = F.col(lower), F.col(upper)
    center = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / F.lit(2.0)).otherwise(F.coalesce(lo, hi))
    median = (F.col("_q50.lo") + F.col("_q50.hi")) / F.lit(2.0)
    iqr = F.col("_q75.hi") - F.col("_q25.lo")
    return rows.withColumns({
        "ladder_distance": F.coalesce((center - median) / F.lit(10.0), F.lit(0.0)),
        "ladder_median_missing": median.isNull().cast("int"),
        "ladder_iqr": F.coalesce(iqr / F.lit(10.0), F.lit(0.0)),
        "ladder_iqr_missing": iqr.isNull().cast("int"),
    }).drop("_cum", "_q25", "_q50", "_q75")


def cdf_bounds(df: DataFrame, keys: list[str], lower: str, low: str, high: str) -> DataFrame:
    """Feasible CDF bounds per bracket under unit mass, from quote bounds [low, high].

    Feasible when 0 <= low <= high <= 1 per bracket and sum(low) <= 1 <= sum(high); otherwise bounds are NULL.
    """
    order = W.partitionBy(*keys).orderBy(F.col(lower).asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    pl, ph = F.sum(low).over(order), F.sum(high).over(order)
    tl, th = F.sum(low).over(whole), F.sum(high).over(whole)
    bad = F.max(((F.col(low) < 0) | (F.col(low) > F.col(high)) | (F.col(high) > 1)).cast("int")).over(whole)
    ok = (bad == 0) & (tl <= 1 + 1e-8) & (th >= 1 - 1e-8)
    return df.withColumns({
        "feasible": ok,
        "cdf_low": F.when(ok, F.greatest(pl, F.lit(1.0) - (th - ph))),
        "cdf_high": F.when(ok, F.least(ph, F.lit(1.0) - (tl - pl))),
    })


def quantile_bounds(df: DataFrame, keys: list[str], lower: str, upper: str, qs: dict[str, float]) -> DataFrame:
    """Bracket bounds of quantiles from ``cdf_bounds`` rows: where the upper and the lower CDF bound first reach q."""
    aggs = []
    first = F.coalesce(F.col(lower), F.lit(float("-inf")))
    for name, q in qs.items():
        left, right = F.col("cdf_high") >= q - 1e-8, F.col("cdf_low") >= q - 1e-8
        aggs.append(F.min_by(F.when(left, F.struct(F.col(lower).alias("v"))), F.when(left, first))["v"].alias(f"{name}_low"))
        aggs.append(F.min_by(F.when(right, F.struct(F.col(upper).alias("v"))), F.when(right, first))["v"].alias(f"{name}_high"))
    return df.filter("feasible").groupBy(*keys).agg(*aggs)


def cumulative_interval_bounds(df: DataFrame, keys: list[str], start: str, end: str, window: tuple[int, int], p: str) -> DataFrame:
    """Bounds on P(any) over correlated periods overlapping a window: the largest p, and min(1, sum)."""
    a, b = window
    hit = df.filter((F.col(start) < F.lit(b)) & (F.col(end) > F.lit(a)) & F.col(p).between(0, 1))
    return hit.groupBy(*keys).agg(F.max(p).alias("any_low"), F.least(F.lit(1.0), F.sum(p)).alias("any_high"), F.count(F.lit(1)).alias("periods"))
