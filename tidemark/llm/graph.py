"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.session import written

MAX_ROUNDS = 60


def _to_least(edges: DataFrame, by: str, other: str) -> DataFrame:
    """edges with `least`, the smallest end seen from `by` (itself included); a hot `by` meets one row of the aggregate."""
    least = edges.groupBy(by).agg(F.min(other).alias("_m")).select(F.col(by).alias("_k"), F.least(F.col(by), "_m").alias("least"))
    return edges.join(least, F.col(by) == F.col("_k")).drop("_k")


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges, written, with their number and a hash of them all, noted while they were written."""
    note = Observation()
    out = written(edges.observe(note, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("mark")), "edges")
    got = note.get
    return out, (got.get("n") or 0, got.get("mark") or 0)


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id that is reachable) of every id in edges (a, b).

    Alternating stars: each round ties the larger neighbours of every node to its smallest one, then the smaller ones;
    the rounds grow with the logarithm of the longest path. Each is written to the shared folder; nothing is collected.
    """
    now, seen = _marked(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("v"), F.col("lo").alias("u")).unionByName(now.select(F.col("lo").alias("v"), F.col("hi").alias("u")))
        large = _to_least(both, "v", "u").where("u > v").select(F.col("u").alias("hi"), F.col("least").alias("lo")).where("hi > lo").distinct()
        small = _to_least(large, "hi", "lo")
        now, new = _marked(small.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).unionByName(small.select("hi", F.col("least").alias("lo"))).where("hi > lo").distinct())
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component")).distinct()
