"""Order-book depth, exposure and equity from exploded levels and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import fee_and_cost
from tidemark.operators.ordered import running, running_peak
from tidemark.operators.slicing import running_sums


def depth_curve(levels: DataFrame, keys: list[str], rank: str, price: str, quantity: str, width: int, tie: list[str]) -> DataFrame:
    """Cumulative quantity and cost before and after each price level, best (lowest rank) first."""
    cost = F.col(price) * F.col(quantity)
    out = running_sums(levels, keys, rank, [F.col(c) for c in tie], width, {"cum_quantity": F.col(quantity), "cum_cost": cost})
    return out.withColumn("before_quantity", F.col("cum_quantity") - F.col(quantity))


def available_under(curve: DataFrame, keys: list[str], price: str, quantity: str, max_price: float | None = None, budget: float | None = None) -> DataFrame:
    """Whole levels that fit under a price limit and a budget: quantity, cost and levels per book side."""
    keep = curve
    if max_price is not None:
        keep = keep.filter(F.col(price) <= max_price)
    if budget is not None:
        keep = keep.filter(F.col("cum_cost") <= budget)
    return keep.groupBy(*keys).agg(
        F.sum(quantity).alias("quantity"), F.sum(F.col(price) * F.col(quantity)).alias("cost"), F.count(F.lit(1)).alias("levels")
    )


def liquidation_value(positions: DataFrame, bids: DataFrame, on: list[str], ids: list[str], rank: str, price: str, size: str,
                      usable: float = 0.10, width: int = 25, tie: list[str] | None = None, fresh: Column | None = None) -> DataFrame:
    """Value of open positions sold into the latest fresh bids, best price first.

    Only ``usable`` of each level counts, in whole contracts; each sale is worth its gross less the fee, never below
    zero. What finds no depth is worth zero and reported as unpriced. Positions carry (ids..., quantity, fee_rate).
    ``fresh`` is a condition over ``bids`` (age of the book, future books); levels without it, or unknown, price nothing.
    """
    levels = bids if fresh is None else bids.filter(F.coalesce(fresh, F.lit(False)))
    levels = levels.withColumn("_usable", F.floor(F.col(size) * F.lit(usable)).cast("long")).filter("_usable > 0")
    cum = running_sums(levels, on, rank, [F.col(c) for c in (tie or [])], width, {"_before": F.col("_usable")}, before=True)
    j = positions.join(cum, on, "left")
    take = F.least(F.col("_usable"), F.greatest(F.lit(0), F.col("quantity") - F.col("_before")))
    filled = j.withColumn("_take", F.coalesce(take, F.lit(0)))
    f = fee_and_cost(F.col(price), F.col("_take"), F.col("fee_rate"))
    worth = F.when(F.col("_take") > 0, F.greatest(F.lit(0.0), F.col(price) * F.col("_take") - f["fee"].cast("double"))).otherwise(0.0)
    return filled.withColumn("_worth", worth).groupBy(*ids, "quantity").agg(
        F.sum("_worth").alias("value"), (F.max("quantity") - F.sum("_take")).alias("unpriced")
    )


def exposure(entries: DataFrame, by: list[str], enter: str, settle: str, cost: str, ticker: str) -> DataFrame:
    """Open cost of the group right after each entry; a settlement at the same instant frees its cost first."""
    c = F.col(cost)
    plus = entries.select(*by, ticker, F.col(enter).alias("_t"), F.lit(1).alias("_kind"), c.alias("_delta"))
    minus = entries.select(*by, ticker, F.col(settle).alias("_t"), F.lit(0).alias("_kind"), (-c).alias("_delta"))
    run = running(plus.unionByName(minus), by, ["_t", "_kind", ticker], {"open_cost": F.col("_delta")})
    return run.filter("_kind = 1").select(*by, ticker, F.col("_t").alias(enter), "open_cost")


def equity_curve(ledger: DataFrame, t: str, pnl: Column, initial: float, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Running equity, running peak and drawdown of each ledger row, in one ordered scan."""
    e = running_peak(ledger, by or [], [t, *order], pnl, initial).withColumnRenamed("total", "equity")
    return e.withColumn("drawdown", F.col("peak") - F.col("equity"))
