"""Ordered scans: rows in the order of (key, time, tie), one range of that order a task, whatever the width of time.

A window over a whole key would put a key's whole history into one task. Rows are dealt to parts instead: a key of at most
ROWS rows is one part, a larger one is cut at splitters, rows of a sample of its order. The order ends in a hash of the row,
so that rows of one instant are cut as well. What a part needs from earlier ones is a summary of one row per part, carried
over by a window over those summaries. The parts never change a result.

Small tables cost one count of their keys; the data itself goes through one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.slicing import evaluated_once
from tidemark.session import written

#: Rows of one key that one task is given.
ROWS = 1_000_000
#: Sampled rows of a key for each part it is cut into: parts differ from ROWS by about a part in the root of this.
DRAWN = 64
#: Splitters stand in blocks of so many: a row looks through two short lists.
BLOCK = 64
#: Splitters of at most so many keys are broadcast.
BROADCAST_KEYS = 10_000


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns that can be hashed; a table without any has one hash."""
    return F.xxhash64(F.lit(7), *[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)])


def same_key(by: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by], F.lit(True))


@dataclass
class Parts:
    """rows with `__part` and `__last`, the number of the key's last part; `cut` if any key has more than one."""

    rows: DataFrame
    by: list[str]
    cut: bool

    @property
    def keys(self) -> list[str]:
        return [*self.by, "__part"]

    def window(self, *order) -> W:
        return W.partitionBy(*self.keys).orderBy(*order)


def _splitters(df: DataFrame, by: list[str], hot: DataFrame, value: Column) -> DataFrame:
    """by, blocks: each hot key's splitters in blocks, from a sample that is the same whenever it is drawn."""
    drawn = df.select(*by, value.alias("_v")).where(F.pmod(F.xxhash64(F.lit(11), "_v"), F.lit(ROWS)) < DRAWN)
    if by:
        drawn = drawn.alias("d").join(hot.alias("h"), same_key(by, "d", "h"), "left_semi")
    # One row in ROWS / DRAWN of a key: its place in the sample is found by one window over the sample.
    key = W.partitionBy(*(by or [F.lit(0)]))
    placed = drawn.withColumn("_n", F.row_number().over(key.orderBy("_v"))).where(F.col("_n") % DRAWN == 0)
    numbered = placed.withColumn("_b", F.expr(f"(_n div {DRAWN} - 1) div {BLOCK}"))
    blocks = numbered.groupBy(*by, "_b").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    return blocks.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_vs"))), lambda b: b["_vs"]).alias("_blocks"))


def deal(df: DataFrame, by: list[str], order: list[str]) -> Parts:
    """Parts of df, cut in the order of `order` and a hash of the row; null keys are a key."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS)
    whole = Parts(df.withColumns({"__part": F.lit(0), "__last": F.lit(0)}), by, False)
    if not counts.limit(1).count():
        return whole
    hot = written(counts.select(*by) if by else counts, "hot-keys")
    rows = evaluated_once(df, _value=F.struct(*order, row_hash(df).alias("_hash")))
    splitters = written(_splitters(rows, by, hot, F.col("_value")), "splitters")
    if by:
        few = splitters.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        named = splitters.withColumnsRenamed({c: f"_k_{c}" for c in by})
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
        rows = rows.join(F.broadcast(named) if few else named, on, "left").drop(*[f"_k_{c}" for c in by])
    else:
        rows = rows.withColumn("_blocks", splitters.select("_blocks").scalar())
    # The number of splitters at or below the row: whole blocks, then those of the last block that begins at or below it.
    begun = F.size(F.filter("_blocks", lambda b: F.get(b, F.lit(0)) <= F.col("_value")))
    rows = evaluated_once(rows, _begun=F.greatest(F.coalesce(begun, F.lit(0)), F.lit(0)))
    inside = F.size(F.filter(F.get("_blocks", F.col("_begun") - 1), lambda s: s <= F.col("_value")))
    last = F.coalesce((F.size("_blocks") - 1) * BLOCK + F.size(F.element_at("_blocks", -1)), F.lit(0))
    part = F.when(F.col("_begun") > 0, (F.col("_begun") - 1) * BLOCK + inside).otherwise(0)
    return Parts(evaluated_once(rows, __part=part, __last=F.when(F.size("_blocks") > 0, last).otherwise(0)).drop("_value", "_blocks", "_begun"), by, True)


def carried(parts: Parts, wanted: Column, columns: list[str], order: list[str], forward: bool = True) -> DataFrame | None:
    """For each part, the nearest row of an earlier part (a later one if not `forward`) for which `wanted` holds.

    Columns: by, __part, columns. One row per part that has wanted rows is repeated up to the next such part; None if no
    key is cut.
    """
    if not parts.cut:
        return None
    pick = F.max_by if forward else F.min_by
    edge = parts.rows.where(wanted).where("__last > 0").groupBy(*parts.keys).agg(pick(F.struct(*columns), F.struct(*order)).alias("_e"), F.max("__last").alias("__last"))
    w = W.partitionBy(*(parts.by or [F.lit(0)])).orderBy(F.asc("__part") if forward else F.desc("__part"))
    stop = F.lead("__part").over(w)
    begin, end = (F.col("__part") + 1, F.coalesce(stop, F.col("__last"))) if forward else (F.coalesce(stop, F.lit(0)), F.col("__part") - 1)
    reach = edge.select(*parts.keys, "_e", begin.alias("_from"), end.alias("_to")).where("_from <= _to")
    return reach.select(*parts.by, F.explode(F.sequence("_from", "_to")).alias("__part"), "_e.*")


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """df with unbounded running sums and maxima in the order of `order`; `before` leaves the row itself out.

    Inside a part by a window; the parts before by their sums and maxima. The order must be total for exact results.
    """
    sums, maxes = sums or {}, maxes or {}
    parts = deal(df, by, order)
    inside = parts.window(*order)
    past = inside.rowsBetween(W.unboundedPreceding, -1 if before else 0)
    local = {n: F.coalesce(F.sum(v).over(past), F.lit(0)) for n, v in sums.items()} | {n: F.max(v).over(past) for n, v in maxes.items()}
    if not parts.cut:
        return parts.rows.withColumns(local).drop("__part", "__last")
    # Placing a row and its window cost most: both are done once, for the rows and for the summaries.
    rows = written(parts.rows.withColumns({f"_in_{n}": v for n, v in local.items()}), "dealt")
    totals = rows.groupBy(*parts.keys).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()], *[F.max(v).alias(f"_s_{n}") for n, v in maxes.items()])
    prior = W.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    opening = totals.select(*parts.keys, *[F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.max(f"_s_{n}").over(prior).alias(f"_o_{n}") for n in maxes])
    out = rows.alias("r").join(opening.alias("o"), same_key(parts.keys, "r", "o"))
    whole = {n: F.col(f"r._in_{n}") + F.col(f"_o_{n}") for n in sums} | {n: F.greatest(f"r._in_{n}", f"_o_{n}") for n in maxes}
    return out.select(*[F.col(f"r.`{c}`") for c in df.columns if c not in whole], *[c.alias(n) for n, c in whole.items()])


def running_peak(df: DataFrame, by: list[str], order: list[str], delta: Column, initial: float) -> DataFrame:
    """df with `total`, the running sum from `initial` on, and `peak`, its running maximum from `initial` on, in one scan.

    The summary of a part is its sum and the greatest running sum inside it; the parts before give both their openings.
    """
    parts = deal(df, by, order)
    inside = parts.window(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = parts.rows.withColumn("_sum", F.sum(delta).over(inside)).withColumn("_top", F.max("_sum").over(inside))
    if not parts.cut:
        total, peak = F.col("_sum") + F.lit(initial), F.greatest(F.col("_top") + F.lit(initial), F.lit(initial))
        return rows.withColumns({"total": total, "peak": peak}).drop("_sum", "_top", "__part", "__last")
    rows = written(rows, "dealt")  # placed and summed once, read twice
    ends = rows.groupBy(*parts.keys).agg(F.sum(delta).alias("_s"), F.max("_top").alias("_m"))
    prior = W.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    opened = ends.withColumn("_open", F.coalesce(F.sum("_s").over(prior), F.lit(0.0)) + F.lit(initial))
    opened = opened.select(*parts.keys, "_open", F.greatest(F.max(F.col("_m") + F.col("_open")).over(prior), F.lit(initial)).alias("_peak"))
    out = rows.alias("r").join(opened.alias("o"), same_key(parts.keys, "r", "o"))
    total = F.col("_sum") + F.col("_open")
    return out.select(*[F.col(f"r.`{c}`") for c in df.columns], total.alias("total"), F.greatest(F.col("_top") + F.col("_open"), "_peak").alias("peak"))
