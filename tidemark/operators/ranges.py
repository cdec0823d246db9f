"""Range maxima: maxima of power-of-two blocks, so that an interval asks for a few blocks instead of every point in it.

Points of a key are numbered in time order. Block (level, node) holds the points node * 2**level up to the next node's. An
interval [lo, hi) of numbers is cut into at most two blocks of each level, as in a segment tree; its maximum is the maximum
of theirs. Rows into the last aggregate: at most 2 * levels for an interval, however many points lie in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import blocks_of_point, blocks_of_range
from tidemark.operators.ordered import running, same_key
from tidemark.operators.temporal import asof_backward
from tidemark.session import written


def interval_max(intervals: DataFrame, points: DataFrame, by: list[str], span: tuple[str, str], t: str, values: dict[str, str], tie: list[str] | None = None) -> DataFrame:
    """intervals with `points`, the number of points with start <= t < end, and the maximum of each value column under its new name.

    An interval without points, or that ends before it starts, has 0 points and null maxima. Null keys are a key; a point
    without time counts nowhere. Repeated intervals are answered once.
    """
    a, b = span
    order = [t, *(tie or [])]
    numbered = running(points.where(F.col(t).isNotNull()).select(*dict.fromkeys([*by, *order, *values.values()])), by, order, {"_number": F.lit(1).cast("long")}, before=True)
    numbered = written(numbered, "numbered")
    ends = numbered.select(*by, t, "_number")
    found = asof_backward(intervals, ends, by, a, t, None, allow_equal=False, tie=["_number"], name="_a")
    found = asof_backward(found, ends, by, b, t, None, allow_equal=False, tie=["_number"], name="_b")
    past = lambda q: F.coalesce(F.col(f"{q}._number") + 1, F.lit(0).cast("long"))
    located = written(found.withColumns({"_lo": past("_a"), "_hi": F.greatest(past("_a"), past("_b"))}).drop("_a", "_b"), "located")
    longest = located.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 0
    levels = int(longest).bit_length()
    table = numbered.select(*by, *[F.col(c).alias(n) for n, c in values.items()], F.explode(blocks_of_point(F.col("_number"), levels)).alias("_block"))
    table = table.groupBy(*by, "_block.level", "_block.node").agg(*[F.max(n).alias(n) for n in values])
    asked = located.where("_lo < _hi").select(*by, "_lo", "_hi").distinct().withColumn("_block", F.explode(blocks_of_range(F.col("_lo"), F.col("_hi"), levels)))
    asked = asked.select(*by, "_lo", "_hi", "_block.level", "_block.node")
    hit = asked.alias("i").join(table.alias("p"), same_key([*by, "level", "node"], "i", "p"))
    answer = hit.groupBy(*[F.col(f"i.{c}").alias(c) for c in [*by, "_lo", "_hi"]]).agg(*[F.max(f"p.{n}").alias(n) for n in values])
    out = located.alias("l").join(answer.alias("m"), same_key([*by, "_lo", "_hi"], "l", "m"), "left")
    return out.select(*[F.col(f"l.`{c}`") for c in intervals.columns], (F.col("l._hi") - F.col("l._lo")).alias("points"), *[F.col(f"m.{n}").alias(n) for n in values])
