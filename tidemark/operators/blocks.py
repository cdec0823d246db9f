"""Power-of-two blocks of whole numbers: block (level, node) holds the numbers node * 2**level up to the next node's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def _floored(number: Column, level: Column) -> Column:
    return F.call_function("shiftright", number, level)


def blocks_of_range(lo: Column, hi: Column, levels: int) -> Column:
    """Array of (level, node): the blocks of level < levels that make up [lo, hi); hi - lo must be below 2**levels."""

    def of_level(level: Column) -> Column:
        size = _power(level)
        first, past = _floored(lo + size - 1, level), _floored(hi, level)
        left = F.when((first < past) & (F.pmod(first, F.lit(2)) == 1), first)
        right = F.when((F.pmod(past, F.lit(2)) == 1) & (first + F.pmod(first, F.lit(2)) < past), past - 1)
        block = lambda node: F.when(node.isNotNull(), F.struct(level.cast("int").alias("level"), node.alias("node")))
        return F.array_compact(F.array(block(left), block(right)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max(levels - 1, 0))), of_level))


def blocks_of_point(number: Column, levels: int) -> Column:
    """Array of (level, node): the blocks of level < levels that hold the number."""
    return F.transform(F.sequence(F.lit(0), F.lit(max(levels - 1, 0))), lambda level: F.struct(level.cast("int").alias("level"), _floored(number.cast("long"), level).alias("node")))
