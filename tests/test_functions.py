"""Hand-worked values of scalar functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import books as B
from tidemark.functions import contracts as C
from tidemark.functions import money as M
from tidemark.functions import numeric as N


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_normal_cdf_against_erfc(spark):
    zs = [i / 7 for i in range(-60, 61)] + [-40.0, 40.0, 7.0710678, 7.0710679]
    rows = spark.createDataFrame([(float(z),) for z in zs], "z double").select("z", N.normal_cdf(F.col("z")).alias("p")).collect()
    for r in rows:
        assert abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-14


def test_bracket_probabilities_sum_to_one(spark):
    b = [(None, 68.5), (68.5, 72.5), (72.5, 76.5), (76.5, None)]
    df = spark.createDataFrame(b, "lo double, hi double")
    total = df.agg(F.sum(N.interval_prob(F.lit(72.0), F.lit(4.0), F.col("lo"), F.col("hi")))).first()[0]
    assert abs(total - 1) < 1e-12


def test_interval_prob_rejects_bad_input(spark):
    r = one(spark, a=N.interval_prob(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), b=N.interval_prob(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(1.0)))
    assert r.a is None and r.b is None


@pytest.mark.parametrize("price,qty,fee,cost", [(0.50, 100, 1.75, 51.75), (0.4055, 1, 0.0245, 0.43)])
def test_fee_and_cost(spark, price, qty, fee, cost):
    f = one(spark, f=M.fee_and_cost(F.lit(price), F.lit(qty))).f
    assert (float(f.fee), float(f.cost)) == (fee, cost)


@pytest.mark.parametrize("qty,grid,want", [(1, "0.01", (0.02, 0.52)), (1, "0.0001", (0.0175, 0.5175)), (100, "0.01", (1.75, 51.75))])
def test_single_fill_cost(spark, qty, grid, want):
    f = one(spark, f=M.single_fill_cost(F.lit(0.5), F.lit(qty), grid=grid)).f
    assert (float(f.fee), float(f.cost)) == want


def test_single_fill_cost_rejects(spark):
    bad = [(0.5, 0.0), (0.5, 1.5), (2.0, 1.0), (0.5, -1.0)]
    df = spark.createDataFrame(bad, "p double, q double")
    assert all(r.f is None for r in df.select(M.single_fill_cost(F.col("p"), F.col("q")).alias("f")).collect())


@pytest.mark.parametrize("win,price", [(0.6, 0.5), (0.55, 0.51), (0.9, 0.1), (1.0, 0.5), (0.3, 0.5)])
def test_max_slippage_is_the_last_passing_tick(spark, win, price):
    from decimal import ROUND_CEILING, Decimal as D

    def passes(i):
        p = D(str(price)) + D(i) / 10000
        cost = (p + D("0.07") * p * (1 - p)).quantize(D("0.01"), rounding=ROUND_CEILING)
        return D(str(win)) - cost >= D("0.04")

    ok = [i for i in range(0, int((1 - price) * 10000) + 1) if passes(i)]
    got = one(spark, s=M.max_slippage(F.lit(win), F.lit(price))).s
    assert (got is None and not ok) or abs(got - max(ok) / 10000) < 1e-9


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 99)), min_size=20, max_size=20))
def test_max_slippage_property(spark, pairs):
    rows = [(w / 100, p / 100) for w, p in pairs]
    df = spark.createDataFrame(rows, "w double, p double").select("w", "p", M.max_slippage(F.col("w"), F.col("p")).alias("s"))
    for r in df.collect():
        cost = lambda t: -(-(t * 1_000_000 + 7 * t * (10000 - t)) // 100_000_000)
        t0, cap = round(r.p * 10000), round(r.w * 100) - 4
        ok = [t - t0 for t in range(t0, 10001) if cost(t) <= cap]
        assert (r.s is None) == (not ok) and (r.s is None or round(r.s * 10000) == max(ok))


def test_yes_wins_ties(spark):
    r = one(spark, s=M.qualify_signal(F.lit(0.5), F.lit(0.6), F.lit(0.4), min_edge=0.0)).s
    assert r.side == "yes"


def test_unknown_fee_gives_no_signal(spark):
    assert one(spark, s=M.qualify_signal(F.lit(0.9), F.lit(0.1), F.lit(0.2), rate=F.lit(None).cast("double"))).s is None


def test_blend_zero_weight_is_exactly_market(spark):
    r = one(spark, a=N.blend_logodds(F.lit(0.9), F.lit(0.123456789), 0), b=N.anchored_logodds(F.lit(None).cast("double"), F.lit(0.3), 0.5))
    assert r.a == 0.123456789 and r.b == 0.3


def test_guard_never_crosses_market(spark):
    r = one(spark, a=N.guarded_probability(F.lit(0.6), F.lit(0.4), F.lit(0.7), F.lit(0.5)), b=N.guarded_probability(F.lit(0.4), F.lit(0.3), F.lit(0.45), F.lit(0.5)))
    assert r.a == 0.5 and r.b == 0.45


def book(spark, yes, no):
    t = "array<struct<price:double,qty:double>>"
    return spark.createDataFrame([(yes, no)], f"a {t}, b {t}")


def test_book_mid_ignores_zero_levels(spark):
    df = book(spark, [(0.45, 0.0), (0.39, 1000.0)], [(0.60, 1000.0), (0.9, 0.0)])
    assert df.select(B.book_mid(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.395)
    assert book(spark, [(0.4, 0.0)], [(0.6, 5.0)]).select(B.book_mid(F.col("a"), F.col("b"))).first()[0] is None


def test_quote_bounds_sides(spark):
    q = book(spark, [], [(0.01, 5.0)]).select(B.quote_bounds(F.col("a"), F.col("b")).alias("q")).first().q
    assert (q.bid, q.ask, q.p, q.quality) == (0.0, 0.01, None, "one_sided")
    assert book(spark, [], []).select(B.quote_bounds(F.col("a"), F.col("b")).alias("q")).first().q.quality == "empty"
    assert book(spark, [(0.6, 1.0)], [(0.5, 1.0)]).select(B.quote_bounds(F.col("a"), F.col("b")).alias("q")).first().q.error == "crossed"


@pytest.mark.parametrize("text,want", [
    ("70-71°F", (69.5, 71.5)), ("60°F or below", (None, 60.5)), ("80°F or higher", (79.5, None)), ("80°F or above", (79.5, None)), ("−5–−3°F", (-5.5, -2.5)), ("70", None), ("72-70°F", None), ("warm°F", None),
])
def test_parse_bracket(spark, text, want):
    b = one(spark, b=C.parse_bracket(F.lit(text))).b
    assert (b is None and want is None) or (b.lower, b.upper) == want


def test_metar(spark):
    r = one(
        spark, a=C.metar_max6h(F.lit("KNYC 011251Z 10SM RMK AO2 10250 20011")), b=C.metar_max6h(F.lit("KNYC RMK AO2 11050")), c=C.metar_max6h(F.lit("KNYC 10250 10SM")),
        d=C.is_correction(F.lit("KNYC COR 1")), e=C.is_correction(F.lit("CORN")),
    )
    assert r.a == pytest.approx(77.0) and r.b == pytest.approx(23.0) and r.c is None and r.d and not r.e


@pytest.mark.parametrize("text,seconds", [("PT1H", 3600), ("P1DT2H30M", 95400), ("P2D", 172800), ("1 hour", None)])
def test_duration(spark, text, seconds):
    assert one(spark, s=C.iso_duration_seconds(F.lit(text))).s == seconds


@pytest.mark.parametrize("x,s", [(1_700_000_000_000, 1_700_000_000), (1_700_000_000_000_000, 1_700_000_000), (1_700_000_000, None), (1_700_000_000_001, None)])
def test_epoch(spark, x, s):
    assert one(spark, s=C.epoch_seconds(F.lit(x))).s == s


@pytest.mark.parametrize("text,ok", [("2025-01-01T00:00:00Z", True), ("2025-01-01T00:00Z", True), ("2025-01-01T00:00:00+02:00", True), ("2025-01-01T00:00:00", False), ("soon", False)])
def test_timestamps_need_an_offset(spark, text, ok):
    assert (one(spark, t=C.zoned_timestamp(F.lit(text))).t is not None) == ok


@pytest.mark.parametrize("value,want", [
    ("https://m.example/markets/abc/x/abc-24jan01-t70", "ABC-24JAN01-T70"), ("m.example/markets/kx", "KX"), ("kx-1", "KX-1"), ("http://m.example/markets/kx", None), ("https://evil.example/markets/kx", None), ("https://m.example/other/kx", None), ("bad ticker", None),
])
def test_reference(spark, value, want):
    assert one(spark, t=C.parse_reference(F.lit(value), ["m.example"])).t == want


def test_event_date(spark):
    r = one(spark, a=C.event_date(F.lit("S-25JAN07-B70")).cast("string"), b=C.event_date(F.lit("S-XX")), c=C.event_date(F.lit("S-25FOO01")))
    assert (r.a, r.b, r.c) == ("2025-01-07", None, None)


def test_fee_overrides(spark):
    q = F.lit("quadratic")
    none = F.lit(None)
    r = one(spark, a=C.effective_fee(q, F.lit(1.0), none, none), b=C.effective_fee(q, F.lit(1.0), none, F.lit(0.5)), c=C.effective_fee(q, F.lit(1.0), F.lit("flat"), none), d=C.effective_fee(q, none, none, none))
    assert (float(r.a), float(r.b), r.c, r.d) == (0.07, 0.035, None, None)


def test_costs_keep_the_digits_of_rate_and_quantity(spark):
    d = lambda v, kind: F.lit(v).cast(kind)
    r = one(
        spark,
        small=M.debit(d("0.5", "decimal(4,2)"), F.lit(100_000), d("0.0233331", "decimal(12,8)")),
        part=M.debit(d("0.5", "decimal(4,2)"), d("1.5", "decimal(6,2)")),
        tiny=M.debit(d("0.5", "decimal(4,2)"), F.lit(1), d("0.00000001", "decimal(12,8)")),
    )
    assert (str(r.small), str(r.part), str(r.tiny)) == ("50583.33", "0.78", "0.51")


def test_empty_fee_override_falls_back_to_the_series(spark):
    r = one(spark, a=C.effective_fee(F.lit("quadratic"), F.lit(1.0), F.lit(""), F.lit(None)))
    assert float(r.a) == 0.07


def test_malformed_money_is_rejected_with_a_reason(spark):
    rows = [("A", "binary", "abc", "E", None, None, None, "settled", "yes", None), ("B", "binary", "1", "E", None, None, None, "settled", "yes", "7"), ("C", "binary", None, "E", None, None, None, "settled", "no", "n/a"), ("D", None, "1.00", "E", None, None, None, "settled", "no", None), ("F", None, "1", "E", None, None, None, "open", None, None)]
    raw = spark.createDataFrame(rows, "ticker string, market_type string, notional_value_dollars string, event_ticker string, title string, close_time timestamp, settlement_ts timestamp, status string, result string, settlement_value_dollars string")
    good, bad = C.normalize_market(raw, F.col("close_time"), F.lit(None).cast("double"))
    assert {r.ticker for r in good.collect()} == {"B", "C", "D", "F"} and {(r.ticker, r.reason) for r in bad.collect()} == {("A", "not_one_dollar")}
    paid, unusable = C.normalize_outcome(raw, F.col("close_time"))
    assert {(r.ticker, r.yes_payout) for r in paid.collect()} == {("A", 1.0), ("D", 0.0)}
    assert {(r.ticker, r.reason) for r in unusable.collect()} == {("B", "payout_out_of_range"), ("C", "malformed_settlement")}
