"""Time slices: keep every window task bounded although one key may hold a third of all rows.

A window partitioned by key alone puts the whole history of a hot key into one task. Every time window here is
partitioned by (key, slice) instead. What a row needs from other slices arrives in one of two ways:

* ``halo`` and ``visible_copies``: bounded look-back or look-ahead. A row is copied into the other slices that can still
  see it: with slices wider than the look-back only rows near an edge, otherwise one extreme row per (key, slice).
  One exchange, one window, no join.
* ``running``: unbounded sums and maxima. Each (key, slice) is first reduced to one row by a map-side combined aggregate;
  a second, small window over those summaries gives each slice its opening state.

Slice widths are a parameter: choose them so that one slice of the busiest key fits a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MICRO = 1_000_000
HOUR = 3600 * MICRO
DAY = 24 * HOUR


def slice_of(t: Column, width: int) -> Column:
    """Slice number of an integer time (any unit, the same as ``width``)."""
    return F.floor(t / F.lit(width)).cast("long")


def halo(df: DataFrame, t: str, width: int, back: int = 0, ahead: int = 0, sl: str = "_slice", core: str = "_core") -> DataFrame:
    """Copy rows into every slice that may look at them.

    A row at time t can be seen by rows in [t, t + back] (it is in their past) and in [t - ahead, t] (in their future).
    ``core`` marks the one copy in the row's own slice; drop the others after the window is computed.
    """
    first, last = slice_of(F.col(t) - F.lit(ahead), width), slice_of(F.col(t) + F.lit(back), width)
    return df.withColumn(sl, F.explode(F.sequence(first, last))).withColumn(core, F.col(sl) == slice_of(F.col(t), width))


def sliced(df: DataFrame, by: list[str], t: str, width: int) -> DataFrame:
    """Rows with their ``_slice``."""
    return df.withColumn("_slice", slice_of(F.col(t), width))


def visible_copies(df: DataFrame, by: list[str], t: str, order: list[str], width: int, nearest: int, farthest: int, forward: bool) -> DataFrame:
    """Copies of rows for the other slices whose rows may need them as their nearest neighbour in time.

    ``forward``: a row at t serves decisions in [t + nearest, t + farthest]; otherwise decisions in
    [t - farthest, t - nearest]. Adds ``_slice``; the row's own slice is included when it can be served there.

    With ``farthest`` within one slice width only rows close to a slice edge are copied, once. Beyond that, only the
    extreme row of each (key, slice) can be anyone's neighbour across an edge: a map-side combined aggregate keeps that
    one row, and it is repeated up to the next slice of the key that has a row of its own.
    """
    own = slice_of(F.col(t), width)
    sign = 1 if forward else -1
    a, z = slice_of(F.col(t) + F.lit(sign * nearest), width), slice_of(F.col(t) + F.lit(sign * farthest), width)
    first, last = (a, z) if forward else (z, a)
    if farthest <= width:
        return df.withColumn("_slice", F.explode(F.sequence(F.least(own, first), F.greatest(own, last))))
    here = df.withColumn("_slice", own)
    pick = F.max_by if forward else F.min_by
    rest = [c for c in df.columns if c not in by]
    edge = here.groupBy(*by, "_slice").agg(pick(F.struct(*rest), F.struct(t, *order)).alias("_e"))
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.asc("_slice") if forward else F.desc("_slice"))
    edge = edge.withColumn("_stop", F.lead("_slice").over(w)).withColumn("_far", slice_of(F.col(f"_e.{t}") + F.lit(sign * farthest), width))
    if forward:
        begin, end = F.col("_slice") + 1, F.least(F.coalesce("_stop", "_far"), F.col("_far"))
    else:
        begin, end = F.greatest(F.coalesce("_stop", "_far"), F.col("_far")), F.col("_slice") - 1
    reach = edge.filter(begin <= end).select(*by, "_e", F.explode(F.sequence(begin, end)).alias("_slice"))
    return here.unionByName(reach.select(*by, "_e.*", "_slice"))


def before_slice(by: list[str]):
    """Window over slice summaries: all earlier slices of the key."""
    return W.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)


def running(
    df: DataFrame, by: list[str], t: str, order: list[Column], width: int, sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None, before: bool = False, keep_slice: bool = False,
) -> DataFrame:
    """Unbounded running sums and maxima, in two levels: slice summaries, their prefix, then a window inside the slice.

    ``before=True`` leaves the row itself out of the sums. Order inside a slice is (t, *order) and must be total for
    exact results. A frame that still has its ``_slice`` (``keep_slice``) is not shuffled again.
    """
    sums, maxes = sums or {}, maxes or {}
    keys = by + ["_slice"]
    rows = df if "_slice" in df.columns else sliced(df, by, t, width)
    rows = rows.withColumns({f"_v_{n}": v for n, v in (sums | maxes).items()})
    totals = rows.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_s_{n}") for n in maxes])
    prior = before_slice(by)
    opening = totals.select(
        *keys, *[F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.max(f"_s_{n}").over(prior).alias(f"_o_{n}") for n in maxes]
    )
    inside = W.partitionBy(*keys).orderBy(F.col(t), *order)
    upto, past = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1 if before else 0)
    out = rows.withColumns(
        {f"_c_{n}": F.coalesce(F.sum(f"_v_{n}").over(past), F.lit(0)) for n in sums} | {f"_c_{n}": F.max(f"_v_{n}").over(upto) for n in maxes}
    ).join(opening, keys)
    out = out.withColumns({n: F.col(f"_o_{n}") + F.col(f"_c_{n}") for n in sums} | {n: F.greatest(f"_o_{n}", f"_c_{n}") for n in maxes})
    drop = [f"_{k}_{n}" for n in sums | maxes for k in "vco"]
    return out.drop(*drop, *([] if keep_slice else ["_slice"]))


def running_sums(df: DataFrame, by: list[str], t: str, order: list[Column], width: int, sums: dict[str, Column], before: bool = False) -> DataFrame:
    return running(df, by, t, order, width, sums=sums, before=before)


def running_max(df: DataFrame, by: list[str], t: str, order: list[Column], width: int, value: Column, name: str) -> DataFrame:
    return running(df, by, t, order, width, maxes={name: value})


def previous_time(df: DataFrame, by: list[str], t: str, width: int, name: str = "previous_t") -> DataFrame:
    """Time of the previous row of the same key however long ago: inside the slice, else the newest earlier slice's last."""
    keys = by + ["_slice"]
    rows = sliced(df, by, t, width)
    opening = rows.groupBy(*keys).agg(F.max(t).alias("_m")).select(*keys, F.max("_m").over(before_slice(by)).alias("_o"))
    inside = F.lag(t).over(W.partitionBy(*keys).orderBy(t))
    return rows.withColumn("_p", inside).join(opening, keys).withColumn(name, F.coalesce("_p", "_o")).drop("_slice", "_p", "_o")


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of re-computing.

    The optimizer substitutes a projected expression into every place that uses it, also into filters it pushes down.
    For a parsed document that is read by dozens of rules this multiplies the parsing. A one-row generator is a barrier
    it does not look through, and it stays inside code generation.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
