"""Order books as arrays of structs: levels are ``array<struct<price, qty>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best(levels: Column) -> Column:
    """Highest price with a positive quantity; NULL for an empty side."""
    return F.array_max(F.transform(F.filter(levels, lambda l: l["qty"] > 0), lambda l: l["price"]))


def lowest(levels: Column) -> Column:
    return F.array_min(F.transform(F.filter(levels, lambda l: l["qty"] > 0), lambda l: l["price"]))


def book_mid(yes: Column, no: Column) -> Column:
    """Midpoint of the best YES bid and the complement of the best NO bid; NULL unless both sides are quoted."""
    return (best(yes) + F.lit(1) - best(no)) / F.lit(2)


def two_sided_quote(yes: Column, no: Column) -> Column:
    """struct(bid, ask) in YES terms; NULL unless both sides are quoted and not crossed."""
    bid, ask = best(yes), F.lit(1) - best(no)
    return F.when((bid >= 0) & (bid <= ask) & (ask <= 1), F.struct(bid.alias("bid"), ask.alias("ask")))


def quote_bounds(bids: Column, asks: Column) -> Column:
    """struct(bid, ask, p, spread, quality, error): a missing side widens the interval and never makes a midpoint."""
    b, a = best(bids), lowest(asks)
    bid, ask = F.coalesce(b, F.lit(0.0)), F.coalesce(a, F.lit(1.0))
    both = b.isNotNull() & a.isNotNull()
    bad = F.exists(
        F.concat(F.coalesce(bids, F.array()), F.coalesce(asks, F.array())),
        lambda l: F.isnan(l["price"]) | ~l["price"].between(0, 1) | (l["qty"] < 0),
    )
    return F.struct(
        bid.alias("bid"), ask.alias("ask"), F.when(both, (bid + ask) / F.lit(2.0)).alias("p"), (ask - bid).alias("spread"),
        F.when(both, "two_sided").when(b.isNotNull() | a.isNotNull(), "one_sided").otherwise("empty").alias("quality"),
        F.when(bad, "invalid_level").when(bid > ask, "crossed").alias("error"),
    )


def complement_levels(opposing: Column) -> Column:
    """Asks of one side from the bids of the other: price 1 - p, whole contracts only, cheapest first."""
    whole = F.filter(opposing, lambda l: l["qty"] >= 1)
    return F.array_sort(F.transform(whole, lambda l: F.struct((F.lit(1) - l["price"]).alias("price"), F.floor(l["qty"]).cast("long").alias("qty"))))


def level_violations(levels: Column) -> Column:
    """True when a side holds a price outside [0, 1], a negative quantity or a repeated price."""
    prices = F.transform(levels, lambda l: l["price"])
    out_of_range = F.exists(levels, lambda l: ~l["price"].between(0, 1) | (l["qty"] < 0) | l["price"].isNull() | l["qty"].isNull())
    return out_of_range | (F.size(F.array_distinct(prices)) != F.size(prices))
