"""Temporal joins that never use a row before it was available."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.blocks import blocks_of_point, blocks_of_range
from tidemark.operators.ordered import carried, deal
from tidemark.operators.slicing import HOUR, slice_of


def _all(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def _nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: Column, right_time: Column, right_side: int, tie: list[str], forward: bool) -> DataFrame:
    """Left rows (``_l``) with the nearest right row in time (``_q``): one union, dealt to ordered parts, one window.

    The left side is used once, so chained joins do not repeat each other's work. A part begins with the nearest right row
    of the parts before it.
    """
    rank = F.struct(*[F.col(c) for c in tie]) if tie else F.lit(0)
    rank_type = right.select(rank.alias("r")).schema["r"].dataType
    r = right.select(*by, right_time.alias("_t"), F.lit(right_side).alias("_side"), rank.alias("_tie"), _all(right).alias("_r"))
    l = left.select(*by, left_time.alias("_t"), F.lit(1 - right_side).alias("_side"), F.lit(None).cast(rank_type).alias("_tie"), _all(left).alias("_l"))
    order = ["_t", "_side", "_tie"]
    parts = deal(l.unionByName(r, allowMissingColumns=True), by, order)
    rows, more = parts.rows, carried(parts, F.col("_r").isNotNull(), [*order, "_r"], order, forward)
    if more is not None:
        rows = rows.unionByName(more, allowMissingColumns=True)
    direction = order if forward else [F.desc(c) for c in order]
    w = parts.window(*direction).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_q", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    tolerance: int | None,
    allowance: int = 0,
    allow_equal: bool = True,
    tie: list[str] | None = None,
    name: str = "quote",
) -> DataFrame:
    """Latest right row that was usable at the left time and is not older than ``tolerance`` (None: however old).

    Point-in-time rule: a right row is usable from ``right_time + allowance`` on. Age is measured from ``right_time``.
    Among right rows of equal time the greatest ``tie`` columns win. Adds the struct column ``name`` (NULL if none).
    """
    usable = F.col(right_time) + F.lit(allowance)
    found = _nearest(left, right, by, F.col(left_time), usable, 0 if allow_equal else 1, tie or [], forward=True)
    if tolerance is None:
        return found.select("_l.*", F.col("_q").alias(name))
    fresh = F.col("_t") - F.col(f"_q.{right_time}") <= F.lit(tolerance)
    return found.select("_l.*", F.when(fresh, F.col("_q")).alias(name))


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    max_gap: int,
    min_gap: int = 1,
    tie: list[str] | None = None,
    name: str = "later",
) -> DataFrame:
    """First right row in [left + min_gap, left + max_gap]; min_gap 1 means strictly after on integer times.

    Both sides are read in descending time so that the frame stays unbounded-preceding, which Spark evaluates in linear
    time.
    """
    start = F.col(left_time) + F.lit(min_gap)
    found = _nearest(left, right, by, start, F.col(right_time), 1, tie or [], forward=False)
    near = F.col(f"_q.{right_time}") - F.col(f"_l.{left_time}") <= F.lit(max_gap)
    return found.select("_l.*", F.when(near, F.col("_q")).alias(name))


def with_previous(df: DataFrame, by: list[str], t: str, columns: list[str], tolerance: int | None, tie: list[str] | None = None, name: str = "previous") -> DataFrame:
    """Attach the preceding row of the same key (as a struct) when it is not older than ``tolerance`` (None: however old)."""
    order = [t, *(tie or [])]
    parts = deal(df, by, order)
    needed = list(dict.fromkeys([*order, *columns]))
    rows, more = parts.rows.withColumn("_own", F.lit(True)), carried(parts, F.lit(True), needed, order)
    if more is not None:
        rows = rows.unionByName(more, allowMissingColumns=True)
    prior = F.lag(F.struct(*columns, F.col(t).alias("_pt"))).over(parts.window(*order))
    out = rows.withColumn("_p", prior).filter("_own")
    previous = F.col("_p").dropFields("_pt")
    fresh = F.lit(True) if tolerance is None else F.col(t) - F.col("_p._pt") <= F.lit(tolerance)
    return out.withColumn(name, F.when(F.col("_p").isNotNull() & fresh, previous)).drop("_p", "__part", "__last", "_own")


def fan_out(df: DataFrame, close: str, horizons: list[int], at: str = "at", horizon: str = "horizon") -> DataFrame:
    """One decision per row and horizon: ``at = close - horizon``."""
    return df.withColumn(horizon, F.explode(F.array(*[F.lit(h).cast("long") for h in horizons]))).withColumn(
        at, F.col(close) - F.col(horizon)
    )


def lag_join(df: DataFrame, bars: DataFrame, by: list[str], at: str, bar_time: str, offsets: dict[str, int], value: str) -> DataFrame:
    """Exact-key lookups ``bars[at - offset]`` for several offsets in ONE equi-join.

    Each bar is shifted to the times that will ask for it and the shifted values are folded to one row per
    (key, time); the fold and the join share one partitioning, so the left side is shuffled once.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(o).cast("long").alias("o")) for n, o in offsets.items()])
    shifted = bars.select(*by, F.col(bar_time).alias("_bt"), F.col(value).alias("_bv"), F.explode(pairs).alias("_o"))
    wide = shifted.groupBy(*by, (F.col("_bt") + F.col("_o.o")).alias(at)).agg(
        *[F.max(F.when(F.col("_o.n") == n, F.col("_bv"))).alias(n) for n in offsets]
    )
    return df.join(wide, [*by, at], "left")


def left_with_reason(left: DataFrame, right: DataFrame, on: list[str], reason: str, name: str = "reason") -> DataFrame:
    """Left join that says why a row found nothing instead of dropping it."""
    out = left.join(right.withColumn("_hit", F.lit(True)), on, "left")
    return out.withColumn(name, F.when(F.col("_hit").isNull(), F.lit(reason))).drop("_hit")


def _levels(spans: DataFrame, first: Column, last: Column) -> int:
    """How many levels of blocks the longest of the intervals needs."""
    return int(spans.agg(F.max(last - first + 1)).first()[0] or 0).bit_length()


def points_in_interval(intervals: DataFrame, points: DataFrame, by: list[str], span: tuple[str, str], t: str, width: int = HOUR) -> DataFrame:
    """Points with start <= t < end, as an equi-join on (key, level, block) plus a residual range test.

    An interval is stored at the few power-of-two blocks of slices that make it up, at most two a level; a point asks for
    the block it lies in at each level, and finds an interval once.
    """
    a, b = span
    valid = intervals.filter(F.col(b) > F.col(a))
    first, last = slice_of(F.col(a), width), slice_of(F.col(b) - F.lit(1), width)
    levels = _levels(valid, first, last)
    i = valid.withColumn("_block", F.explode(blocks_of_range(first, last + 1, levels)))
    p = points.withColumn("_block", F.explode(blocks_of_point(slice_of(F.col(t), width), levels)))
    return i.join(p, [*by, "_block"]).filter((F.col(t) >= F.col(a)) & (F.col(t) < F.col(b))).drop("_block")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
                 width: int = HOUR, name: str = "overlap") -> DataFrame:
    """Interval-overlap join: left [a, b) and right [c, d) with a < d and c < b, and the length of the overlap.

    Two intervals overlap where the later start lies in the other one: starts of the right in the left, and starts of the
    left inside the right, each a join of points and intervals. A pair is found once, however many slices it shares.
    """
    (a, b), (c, d) = left_span, right_span
    l, r = left.filter(F.col(b) > F.col(a)), right.filter(F.col(d) > F.col(c))
    columns = [*by, *[x for x in left.columns if x not in by], *[x for x in right.columns if x not in by]]
    inner = points_in_interval(l, r, by, (a, b), c, width).select(*columns)
    outer = points_in_interval(r, l, by, (c, d), a, width).filter(F.col(a) > F.col(c)).select(*columns)
    begin = F.greatest(F.col(a), F.col(c))
    return inner.unionByName(outer).withColumn(name, F.least(F.col(b), F.col(d)) - begin)


def freshest_available(df: DataFrame, keys: list[str], lead: str, available: Column) -> DataFrame:
    """Fallback join: keep the smallest lead that is available for each key."""
    names = [c for c in df.columns if c not in keys]
    best = df.filter(available).groupBy(*keys).agg(F.min_by(F.struct(*names), F.col(lead)).alias("_b"))
    return best.select(*keys, "_b.*")


def label_after(decisions: DataFrame, outcomes: DataFrame, on: list[str], at: str, settled: str, payout: str) -> tuple[DataFrame, DataFrame]:
    """Attach the label settled strictly after the decision. Returns (labelled, rejected with reason).

    A key with two different payouts is rejected as conflicting; non-binary, unsettled and already settled rows too.
    """
    label = outcomes.groupBy(*on).agg(F.min(payout).alias("_lo"), F.max(payout).alias("_hi"), F.min(settled).alias(settled))
    joined = decisions.join(label, on, "left").withColumn(
        "reason",
        F.when(F.col("_lo").isNull(), "unsettled")
        .when(F.col("_lo") != F.col("_hi"), "conflicting_settlement")
        .when(~F.col("_lo").isin(0, 1), "nonbinary_settlement")
        .when(F.col(settled) <= F.col(at), "already_closed"),
    )
    good = joined.filter("reason IS NULL").withColumn("y", F.col("_lo").cast("int")).drop("_lo", "_hi", "reason")
    return good, joined.filter("reason IS NOT NULL").drop("_lo", "_hi")


def scenario_grid(df: DataFrame, **axes: list) -> DataFrame:
    """Cross every row with a small literal parameter grid, as nested explodes (no join, no broadcast)."""
    out = df
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def match_intent(signals: DataFrame, books: DataFrame, by: list[str], signal_time: str, book_time: str, expires: str,
                 delay: int, max_latency: int, tie: list[str] | None = None) -> DataFrame:
    """First book at least ``delay`` after each signal, not later than ``max_latency`` nor at or past expiry."""
    m = asof_forward(signals, books, by, signal_time, book_time, max_gap=max_latency, min_gap=delay, tie=tie, name="book")
    in_time = F.col(f"book.{book_time}") < F.col(expires)
    return m.withColumn("book", F.when(in_time, F.col("book")))


def complete_days(days: DataFrame, hours: DataFrame, by: list[str], start: str, hour_time: str, value: str, step: int, count: int = 24) -> DataFrame:
    """Station-day join: the day's ``count`` hourly values looked up exactly; keeps the count so gaps can be rejected."""
    expected = days.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn(
        "_ht", F.col(start) + F.col("_i") * F.lit(step)
    )
    h = hours.select(*by, F.col(hour_time).alias("_ht"), F.col(value).alias("_hv"))
    return (
        expected.join(h, [*by, "_ht"], "left")
        .groupBy(*days.columns)
        .agg(F.max("_hv").alias("day_max"), F.count("_hv").alias("hours"))
    )


def cross_venue(left: DataFrame, right: DataFrame, t: str, left_value: str, right_value: str, by: list[str] | None = None) -> DataFrame:
    """Same-time join of two venues with the log basis in basis points."""
    keys = [*(by or []), t]
    j = left.select(*keys, F.col(left_value).alias("_a")).join(right.select(*keys, F.col(right_value).alias("_b")), keys)
    return j.select(*keys, (F.log(F.col("_a") / F.col("_b")) * F.lit(10000.0)).alias("basis_bps"))


def scalar_join(*frames: DataFrame) -> DataFrame:
    """The first frame's rows with the columns of single-row global aggregates, each read as a scalar subquery."""
    out = frames[0]
    for i, f in enumerate(frames[1:]):
        name = f"_one{i}"
        out = out.withColumn(name, f.select(F.struct(*f.columns)).scalar()).select(*(F.col(c) for c in out.columns), f"{name}.*")
    return out
