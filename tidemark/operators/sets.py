"""Set operations on sources and key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def key_intersection(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys present in every frame: one tagged union and one aggregate instead of a chain of joins."""
    tagged = [f.select(*keys, F.lit(i).alias("_i")) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.count_distinct("_i").alias("_n")).filter(F.col("_n") == len(frames)).drop("_n")


def overlap_count(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return key_intersection([a, b], keys).agg(F.count(F.lit(1)).alias("shared"))
