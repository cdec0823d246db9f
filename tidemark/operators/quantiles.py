"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task. Here values are counted by (group, value),
and an ordered scan gives each value its first and last rank: a large group is cut at sampled splitters of its own values,
whose ranks are exact because the counts below them are. No value range is fixed in advance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import running, same_key
from tidemark.session import written

#: Totals of at most so many groups are broadcast.
BROADCAST_GROUPS = 50_000


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, one row per group and one column per name in ``qs``; null keys are a group."""
    v = F.col(value).cast("double")
    counts = written(df.filter(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "counts")
    ranked = running(counts, by, ["_v"], {"_end": F.col("_c")})
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("_total"))
    if by:
        few = totals.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
        joined = ranked.alias("r").join((F.broadcast(totals) if few else totals).alias("t"), same_key(by, "r", "t"))
        ranked = joined.select(*[F.col(f"r.{c}").alias(c) for c in by], "_v", "_c", "_end", "_total")
    else:
        ranked = ranked.withColumn("_total", totals.scalar())
    start = F.col("_end") - F.col("_c")
    holds = lambda rank: (start <= rank) & (rank < F.col("_end"))

    def place(name: str, q: float):
        at = F.lit(float(q)) * (F.col("_total") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("_total") - 1)
        return F.struct(F.lit(name).alias("name"), (at - low).alias("f"), holds(low).alias("low"), holds(high).alias("high"))

    wanted = F.filter(F.array(*[place(n, q) for n, q in qs.items()]), lambda w: w["low"] | w["high"])
    hit = ranked.select(*by, "_v", F.explode(wanted).alias("_w"))
    one = lambda n, side: F.max(F.when((F.col("_w.name") == n) & F.col(f"_w.{side}"), F.col("_v")))
    part = lambda n: F.max(F.when(F.col("_w.name") == n, F.col("_w.f")))
    return hit.groupBy(*by).agg(*[(one(n, "low") + (one(n, "high") - one(n, "low")) * part(n)).alias(n) for n in qs])
