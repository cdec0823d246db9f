"""Contract costs in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scenario defaults.
FEE_RATE = 0.07
MIN_EDGE = 0.04
SLIPPAGE = 0.02

# Wide enough that rate x price x (1 - price) x quantity, at most 38 digits, is exact.
PRICE = "decimal(7,6)"
QUANTITY = "decimal(14,4)"
RATE = "decimal(9,8)"
VARIANCE = "decimal(13,12)"


def price_of(x) -> Column:
    """The price as a decimal; NULL where it does not fit, so that a bad row has no cost instead of ending the job."""
    return (x if isinstance(x, Column) else F.lit(x)).try_cast(PRICE)


def _debit_parts(price: Column, quantity: Column, rate):
    p, q = price_of(price), quantity.try_cast(QUANTITY)
    r = (rate if isinstance(rate, Column) else F.lit(rate)).try_cast(RATE)
    one_minus = (F.lit(1).cast(PRICE) - p).try_cast(PRICE)
    return (p * q), (r * (p * one_minus).cast(VARIANCE) * q)


def debit(price: Column, quantity: Column, rate=FEE_RATE) -> Column:
    """Total paid for one fill: price and fee, rounded up to the cent."""
    gross, fee = _debit_parts(price, quantity, rate)
    return F.ceil(gross + fee, F.lit(2)).cast("decimal(18,2)")


def fee_and_cost(price: Column, quantity: Column, rate=FEE_RATE) -> Column:
    """struct(fee, cost): cost is the rounded-up debit and the fee is what it exceeds price x quantity by."""
    gross, _ = _debit_parts(price, quantity, rate)
    cost = debit(price, quantity, rate)
    return F.struct((cost - gross).cast("decimal(18,6)").alias("fee"), cost.alias("cost"))


def single_fill_cost(price: Column, quantity: Column, rate=FEE_RATE, grid: str = "0.01") -> Column:
    """struct(fee, cost) with the fee first rounded up to 6 decimals and the debit to the account grid.

    NULL for inputs outside the contract: price not in [0, 1], quantity not a positive whole number, negative rate.
    """
    digits = {"0.01": 2, "0.0001": 4}[grid]
    gross, fee = _debit_parts(F.when(price.between(0, 1), price), quantity, rate)
    fee6 = F.ceil(fee, F.lit(6)).cast("decimal(18,6)")
    cost = F.ceil(gross + fee6, F.lit(digits)).cast(f"decimal(18,{digits})")
    r = rate if isinstance(rate, Column) else F.lit(rate)
    number = quantity.cast("double")
    ok = (~F.isnan(price.cast("double"))) & price.between(0, 1) & (number > 0) & (number == F.floor(number)) & (r >= 0)
    return F.when(ok, F.struct((cost - gross).cast("decimal(18,6)").alias("fee"), cost.alias("cost")))


def unit_cost(price: Column, rate=FEE_RATE) -> Column:
    """Debit of one contract."""
    return debit(price, F.lit(1), rate)


def slipped(price: Column, slippage) -> Column:
    """Quoted price worsened by slippage, never above one dollar."""
    s = price_of(slippage)
    return F.least(F.lit(1).cast(PRICE), (price_of(price) + s).cast("decimal(9,6)")).cast(PRICE)


def side_edges(p: Column, bid: Column, ask: Column, rate=FEE_RATE, slippage=0.0) -> tuple[Column, Column]:
    """Net edges (yes, no) of one contract bought at the quote: win probability minus the debit."""
    prob = p.cast("decimal(18,12)")
    yes = prob - unit_cost(slipped(ask, slippage), rate)
    no = (F.lit(1) - prob) - unit_cost(slipped(F.lit(1) - price_of(bid), slippage), rate)
    return yes, no


def qualify_signal(p: Column, bid: Column, ask: Column, rate=FEE_RATE, min_edge=MIN_EDGE) -> Column:
    """struct(side, edge) of the better side, NULL below ``min_edge`` or with an unknown fee. YES wins ties."""
    yes, no = side_edges(p, bid, ask, rate)
    edge = F.greatest(yes, no)
    known = F.lit(True) if not isinstance(rate, Column) else rate.isNotNull()
    return F.when(
        known & (edge >= F.lit(min_edge).cast("decimal(9,6)")),
        F.struct(F.when(yes >= no, "yes").otherwise("no").alias("side"), edge.cast("double").alias("edge")),
    )


def max_slippage(win: Column, price: Column, rate: float = FEE_RATE, min_edge: float = MIN_EDGE, tick: str = "0.0001") -> Column:
    """Largest price rise, in whole ticks, that still leaves one contract with ``min_edge``; NULL if none does.

    One contract's debit passes a cent limit c exactly while p + r*p*(1-p) <= c. The root of that quadratic gives
    the tick to within rounding; its neighbours are then tested in exact decimals.
    """
    base = price_of(price)
    step = F.lit(tick).cast(PRICE)
    last = F.floor((F.lit(1).cast(PRICE) - base) / step).cast("int")
    target = win.cast("decimal(18,12)") - F.lit(min_edge).cast("decimal(9,6)")
    cents = F.least(F.lit(1.0), F.floor(target, F.lit(2)).cast("double"))
    if rate > 0:
        limit = (F.lit(1.0 + rate) - F.sqrt(F.lit((1.0 + rate) ** 2) - F.lit(4.0 * rate) * cents)) / F.lit(2.0 * rate)
    else:
        limit = cents
    guess = F.floor((limit - base.cast("double")) / step.cast("double")).cast("int")
    near = F.filter(
        F.array(*[guess + F.lit(k) for k in (-1, 0, 1)]),
        lambda i: i.between(F.lit(0), last)
        & (unit_cost((base + i.cast("decimal(6,0)") * step).cast(PRICE), rate) <= target),
    )
    return F.array_max(near) * step.cast("double")


def side_features(p: Column, bid: Column, ask: Column, spread: Column, distance: Column, vol_ratio: Column, side: Column) -> Column:
    """Features of one side at the quote plus two cents: win, net edge, spread, |distance|, volatility ratio, cost."""
    yes = side == F.lit("yes")
    win = F.when(yes, p).otherwise(F.lit(1.0) - p)
    quoted = F.when(yes, price_of(ask)).otherwise((F.lit(1).cast(PRICE) - price_of(bid)).cast(PRICE))
    cost = unit_cost(slipped(quoted, SLIPPAGE)).cast("double")
    return F.struct(
        win.alias("win"), (win - cost).alias("edge"), spread.alias("spread"),
        F.abs(distance).alias("distance"), vol_ratio.alias("vol_ratio"), cost.alias("cost"),
    )


def board_edge(p: Column, bid: Column, ask: Column) -> Column:
    """Larger gross edge of a model probability over the asks of both sides; the midpoint stands in when missing."""
    q = F.coalesce(p, (bid + ask) / F.lit(2.0))
    return F.greatest(q - ask, F.lit(1.0) - q - (F.lit(1.0) - bid))
