"""First/latest per key, top-n and ranked candidates: reductions first, ordered windows only over what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordered import running

# Record kinds in replay order at equal times.
KIND_PRIORITY = ["market", "outcome", "book", "prediction"]


def event_order(df: DataFrame, t: str, kind: str, tie: list[str], name: str = "position") -> DataFrame:
    """Each record's place, from 1, in the whole order by (time, kind priority, tie); an unknown kind comes first.

    One range of the order a task and the counts of the ranges before it, so no task sorts the whole table.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_PRIORITY]), F.col(kind))
    placed = running(df.withColumn("_rank", F.coalesce(rank, F.lit(0))), [], [t, "_rank", *tie], {name: F.lit(1).cast("long")})
    return placed.drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Earliest row per key as a map-side combined aggregate (a hot key is one row per task before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group. The rank limit also runs below the shuffle, so a group gets n rows from each task at most."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def candidates(df: DataFrame, supported: Column, bid: str, ask: str, spread: str, close: str, tie: str, n: int = 24) -> DataFrame:
    """The n best open markets: supported first, then two-sided quotes, tighter spreads, earlier closes (top-k report)."""
    liquid = (F.col(bid) > 0) & (F.col(bid) <= F.col(ask)) & (F.col(ask) < 1)
    return df.orderBy(~supported, ~liquid, F.col(spread), F.col(close), F.col(tie)).limit(n)


def last_runs(df: DataFrame, at: str, tie: str, n: int = 50) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(tie)).limit(n)


def one_per_hour(df: DataFrame, keys: list[str], t: str, hour: int, tie: str) -> DataFrame:
    """First row per key and UTC hour."""
    d = df.withColumn("hour", F.floor(F.col(t) / F.lit(hour)).cast("long"))
    return first_per_key(d, [*keys, "hour"], [t, tie])


def longest_copy(df: DataFrame, keys: list[str], size: str, tie: str) -> DataFrame:
    """Largest cached copy per key."""
    return latest_per_key(df, keys, [size, tie])
