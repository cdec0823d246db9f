"""Accounting of simulated fills: summaries, funnels, attribution, repricing and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import MIN_EDGE, debit, price_of, qualify_signal, single_fill_cost, slipped
from tidemark.operators.metrics import bucket, n, one_contract_pnl
from tidemark.operators.slicing import evaluated_once
from tidemark.operators.temporal import scalar_join, scenario_grid

# Entry price buckets of the attribution and the promotion limits.
ENTRY_PRICE = [(0.0, 0.1, "0-0.1"), (0.1, 0.3, "0.1-0.3"), (0.3, 0.7, "0.3-0.7"), (0.7, 1.01, "0.7-1")]
MIN_FOLD_WINS, MIN_TRADES, MIN_TRADE_DAYS = 3, 30, 10


def ledger_summary(ledger: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    return ledger.groupBy(*by).agg(
        n().alias("entries"), F.sum("quantity").alias("contracts"), F.sum("cost").alias("capital"), F.sum("fees").alias("fees"), F.sum("pnl").alias("pnl"),
        F.try_divide(F.sum("pnl"), F.sum("quantity")).alias("net_per_contract"), F.try_divide(F.sum("pnl"), F.sum("cost")).alias("return_on_deployed"),
        F.max("cost").alias("max_bet"), F.count_distinct(day).alias("days_traded"),
    )


def signal_funnel(df: DataFrame, by: list[str], p="q", bid="bid", ask="ask", edge: float = MIN_EDGE, slippage=0.02) -> DataFrame:
    """Counts that survive raw edge, spread, fee and slippage, in that order; the side is fixed before slippage."""
    from tidemark.functions.money import PRICE, price_of, unit_cost

    q, b, a = F.col(p), F.col(bid), F.col(ask)
    signal = qualify_signal(q, b, a, min_edge=edge)
    rows = evaluated_once(df, _s=signal)
    yes = F.col("_s.side") == "yes"
    quoted = F.when(yes, price_of(a)).otherwise((F.lit(1).cast(PRICE) - price_of(b)).cast(PRICE))
    prob = q.cast("decimal(18,12)")
    win = F.when(yes, prob).otherwise(F.lit(1) - prob)
    after = win - unit_cost(slipped(quoted, slippage)) >= F.lit(edge).cast("decimal(9,6)")
    mid = (b + a) / F.lit(2.0)
    return rows.groupBy(*by).agg(
        n().alias("rows"), F.count_if(F.abs(q - mid) >= edge).alias("raw_edge"), F.count_if(F.greatest(q - a, b - q) >= edge).alias("after_spread"),
        F.count_if(F.col("_s").isNotNull()).alias("after_fees"), F.count_if(F.col("_s").isNotNull() & after).alias("after_slippage"),
    )


def trade_attribution(trades: DataFrame, slippage: float = 0.02) -> DataFrame:
    """Per trade: midpoint gross - spread - slippage - fees = net, and the difference that must be zero.

    Needs side, y, mid, bid, ask, quantity, fees, cost, pnl.
    """
    yes = F.col("side") == "yes"
    price = F.when(yes, F.col("ask")).otherwise(F.lit(1.0) - F.col("bid"))
    mid = F.when(yes, F.col("mid")).otherwise(F.lit(1.0) - F.col("mid"))
    win = F.when(yes, F.col("y")).otherwise(F.lit(1) - F.col("y"))
    q = F.col("quantity")
    paid = F.least(F.lit(1.0), price + F.lit(slippage))
    t = trades.withColumns({
        "price": price, "win": win, "gross": q * (win - mid), "spread_cost": q * (price - mid), "slippage_cost": q * (paid - price),
        "equal_contract_net": win - F.col("cost") / q,
    })
    return t.withColumn("unreconciled", F.abs(F.col("gross") - F.col("spread_cost") - F.col("slippage_cost") - F.col("fees") - F.col("pnl")) > 1e-6)


def attribution_summary(attributed: DataFrame, by: list[str]) -> DataFrame:
    s = lambda c: F.sum(c).alias(c)
    return attributed.withColumn("bucket", bucket(F.col("price"), ENTRY_PRICE)).groupBy(*by, "bucket").agg(
        n().alias("entries"), s("quantity"), s("gross"), s("spread_cost"), s("slippage_cost"), s("fees"), s("pnl"), s("equal_contract_net"),
        F.count_if("unreconciled").alias("unreconciled"),
    )


def fixed_cohort_reprice(trades: DataFrame, slippages: list[str]) -> DataFrame:
    """The same fills and quantities under each slippage; not a re-run of the selection.

    A fill's cost depends on (price, quantity) alone and prices move on a tick grid, so fills are first counted by
    (price, quantity, win), map-side combined; each distinct fill is then priced once per slippage.
    """
    yes = F.col("side") == "yes"
    quoted = F.when(yes, F.col("ask")).otherwise(F.lit(1.0) - F.col("bid"))
    won = F.when(yes, F.col("y")).otherwise(F.lit(1) - F.col("y"))
    kinds = trades.groupBy(price_of(quoted).alias("_p"), F.col("quantity"), won.alias("_w")).agg(n().alias("_n"))
    g = scenario_grid(kinds, slippage=slippages)
    g = evaluated_once(g, _c=debit(slipped(F.col("_p"), F.col("slippage")), F.col("quantity")))
    q = F.col("quantity") * F.col("_n")
    net = (F.col("_w") * F.col("quantity") - F.col("_c")) * F.col("_n")
    return g.groupBy("slippage").agg(
        F.sum("_n").alias("entries"), F.sum(q).alias("contracts"), F.sum(F.col("_c") * F.col("_n")).cast("double").alias("capital"), F.sum(net).cast("double").alias("pnl"),
        F.try_divide(F.sum(net).cast("double"), F.sum(q)).alias("net_per_contract"),
    )


def fee_precision(trades: DataFrame, price: Column, quantity: Column) -> DataFrame:
    """Total fees of the same fills on a cent and on a hundredth-of-a-cent account grid, priced once per distinct fill."""
    kinds = trades.groupBy(price.alias("_p"), quantity.alias("_q")).agg(n().alias("_n"))
    fee = lambda grid: single_fill_cost(F.col("_p"), F.col("_q"), grid=grid)["fee"] * F.col("_n")
    sums = [F.sum(fee(g)).cast("double").alias(name) for g, name in (("0.01", "fees_cent"), ("0.0001", "fees_fine"))]
    return kinds.agg(F.sum("_n").alias("entries"), *sums).withColumn("saving", F.col("fees_cent") - F.col("fees_fine"))


def opportunity_pnl(df: DataFrame, by: list[str], p="q", bid="bid", ask="ask", y="y", slippage=0.0, later: tuple[str, str] | None = None, day: str | None = None) -> DataFrame:
    """One contract of every qualifying row, no bankroll: pnl at the decision quote and, if given, at the later quote;
    with ``day`` also the number of days that have one."""
    rows = evaluated_once(df, _s=qualify_signal(F.col(p), F.col(bid), F.col(ask))).filter("_s IS NOT NULL")
    rows = rows.withColumn("_now", one_contract_pnl(F.col("_s.side"), F.col(y), F.col(bid), F.col(ask), slippage))
    aggs = [n().alias("opportunities"), F.avg("_s.edge").alias("claimed"), F.sum("_now").alias("pnl"), F.avg("_now").alias("pnl_per_contract")]
    if day:
        aggs.append(F.count_distinct(day).alias("days_traded"))
    if later:
        b, a = later
        rows = rows.withColumn("_later", F.when(F.col(a).isNotNull(), one_contract_pnl(F.col("_s.side"), F.col(y), F.col(b), F.col(a), slippage)))
        aggs += [F.count("_later").alias("later_rows"), F.avg("_later").alias("later_pnl_per_contract")]
    return rows.groupBy(*by).agg(*aggs)


def promotion_gate(fold_scores: DataFrame, pooled: DataFrame, trades: DataFrame, candidate: str, controls: list[str]) -> DataFrame:
    """One row of booleans: beats every control on both scores in enough folds and pooled, enough trades, positive net.

    ``fold_scores``/``pooled``: (fold,) model, brier, log_loss; ``trades``: one row (entries, days_traded, pnl).
    """
    def beats(df: DataFrame, keys: list[str]) -> DataFrame:
        score = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
        wide = df.groupBy(*keys).agg(*[score(m, c).alias(f"{m}_{c}") for m in [candidate, *controls] for c in ("brier", "log_loss")])
        ok = F.lit(True)
        for k in controls:
            for c in ("brier", "log_loss"):
                ok = ok & (F.col(f"{candidate}_{c}") < F.col(f"{k}_{c}"))
        return wide.withColumn("_win", ok)

    wins = beats(fold_scores, ["fold"]).agg(F.count_if("_win").alias("fold_wins"))
    all_ = beats(pooled, []).select(F.col("_win").alias("pooled_beats"))
    g = scalar_join(wins, all_, trades.select("entries", "days_traded", "pnl"))
    g = g.withColumns({
        "folds_beat": F.col("fold_wins") >= MIN_FOLD_WINS, "positive_net": F.col("pnl") > 0,
        "enough_trades": F.col("entries") >= MIN_TRADES, "enough_days": F.col("days_traded") >= MIN_TRADE_DAYS,
    })
    checks = ["folds_beat", "pooled_beats", "positive_net", "enough_trades", "enough_days"]
    reasons = F.filter(F.array(*[F.when(~F.col(c), F.lit(c)) for c in checks]), lambda x: x.isNotNull())
    return g.select("fold_wins", *checks, F.array_join(reasons, ",").alias("failed"), (F.size(reasons) == 0).alias("passed"))
