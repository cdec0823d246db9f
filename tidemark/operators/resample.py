"""Distributed bootstrap over pre-aggregated clusters.

Rows are reduced to one row per cluster (a day, a month) first. Only clusters x repetitions rows are ever made, and
they do not grow with the data. Draws come from a counter-based hash, so any task can be re-run anywhere with the same
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Seed, interval and evidence limits.
SEED = 1729
TAIL = 0.025
MIN_ENTRIES, MIN_DAYS = 30, 10


def draw(*parts: Column, n: Column) -> Column:
    """Uniform index in [0, n) from the first 32 bits of an MD5 counter."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n).cast("long")


def clusters(df: DataFrame, by: list[str], cluster: str, sums: dict[str, Column]) -> DataFrame:
    """One row per cluster with its sums, its position ``i`` and the number of clusters ``n`` in the group."""
    g = df.groupBy(*by, cluster).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    group = W.partitionBy(*(by or [F.lit(0)]))
    return g.withColumn("i", (F.row_number().over(group.orderBy(cluster)) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(group))


def _repeated(c: DataFrame, reps: int) -> DataFrame:
    """Every row once per repetition, spread over all tasks before it is multiplied."""
    return c.repartition(c.sparkSession.sparkContext.defaultParallelism).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def resampled_sums(c: DataFrame, by: list[str], sums: list[str], reps: int, block: int = 1, seed: int = SEED) -> DataFrame:
    """Sums per repetition. ``block`` 1 draws clusters independently; larger blocks are circular and truncated to n.

    Blocks are summed once per possible start; a repetition then looks up n / block starts instead of n clusters. The
    last, cut block of a repetition uses a second sum over its shorter length.
    """
    tag = [F.lit(seed), *[F.col(b) for b in by], F.col("rep")]
    if block == 1:
        s = _repeated(c.select(*by, F.col("i").alias("slot"), "n"), reps).withColumn("i", draw(*tag, F.col("slot"), n=F.col("n")))
        hit = s.join(c.select(*by, "i", *sums), [*by, "i"])
        return hit.groupBy(*by, "rep").agg(*[F.sum(x).alias(x) for x in sums])
    c = c.withColumn("_len", F.least(F.lit(block).cast("long"), F.col("n")))
    part = c.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).filter(F.col("_k") < F.col("_len"))
    part = part.withColumn("start", F.pmod(F.col("i") - F.col("_k"), F.col("n")))
    short = F.col("_k") < F.col("n") % F.col("_len")
    starts = part.groupBy(*by, "start").agg(*[F.sum(x).alias(f"_full_{x}") for x in sums], *[F.sum(F.when(short, F.col(x)).otherwise(F.lit(0))).alias(f"_cut_{x}") for x in sums])
    heads = c.filter(F.col("i") % F.col("_len") == 0).select(*by, "n", "_len", F.floor(F.col("i") / F.col("_len")).cast("long").alias("block"))
    s = _repeated(heads, reps).withColumn("start", draw(*tag, F.col("block"), n=F.col("n")))
    cut = F.col("block") == F.floor(F.col("n") / F.col("_len"))
    hit = s.join(starts, [*by, "start"])
    return hit.groupBy(*by, "rep").agg(*[F.sum(F.when(cut, F.col(f"_cut_{x}")).otherwise(F.col(f"_full_{x}"))).alias(x) for x in sums])


def interval(draws: DataFrame, by: list[str], stats: dict[str, Column], comparisons: int = 1) -> DataFrame:
    """Percentile interval per statistic; undefined draws (NULL) are left out and counted. ``comparisons`` narrows the
    tails (Bonferroni). A group has at most ``reps`` draws, so the exact percentile is bounded here."""
    a = TAIL / comparisons
    d = draws.select(*by, *[v.alias(k) for k, v in stats.items()])
    aggs = []
    for k in stats:
        aggs += [
            F.percentile(k, F.lit(a)).alias(f"{k}_low"), F.percentile(k, F.lit(1 - a)).alias(f"{k}_high"),
            F.count_if(F.col(k).isNull()).alias(f"{k}_undefined"),
        ]
    return d.groupBy(*by).agg(*aggs)


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: Column, reps: int = 3000, seed: int = SEED, block: int = 1, comparisons: int = 1) -> DataFrame:
    """Interval of the pooled mean when whole clusters are resampled."""
    c = clusters(df, by, cluster, {"s": value, "m": F.lit(1)})
    draws = resampled_sums(c, by, ["s", "m"], reps, block, seed)
    out = interval(draws, by, {"mean": F.col("s") / F.col("m")}, comparisons)
    point = c.groupBy(*by).agg((F.sum("s") / F.sum("m")).alias("mean"), F.count(F.lit(1)).alias("clusters"))
    return _beside(point, out, by)


def day_mean_block_bootstrap(df: DataFrame, by: list[str], day: str, value: Column, reps: int = 2000, block: int = 7, seed: int = SEED, comparisons: int = 1) -> DataFrame:
    """Interval of the mean of daily means under circular blocks of days; needs two days, else NULL bounds."""
    c = clusters(df, by, day, {"s": value, "m": F.lit(1)}).withColumn("v", F.col("s") / F.col("m")).withColumn("w", F.lit(1.0))
    draws = resampled_sums(c, by, ["v", "w"], reps, block, seed)
    out = interval(draws, by, {"mean": F.col("v") / F.col("w")}, comparisons)
    point = c.groupBy(*by).agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("clusters"))
    joined = _beside(point, out, by)
    return joined.withColumns({k: F.when(F.col("clusters") >= 2, F.col(k)) for k in ("mean_low", "mean_high")})


def ratio_bootstrap(df: DataFrame, by: list[str], day: str, pnl: Column, quantity: Column, cost: Column, reps: int = 3000, block: int = 1,
                    seed: int = SEED, comparisons: int = 1) -> DataFrame:
    """Intervals of pnl / quantity and pnl / cost. Days without a trade are clusters too; draws without any trade have
    no ratio and are counted in ``*_undefined``."""
    c = clusters(df, by, day, {"s": pnl, "q": quantity, "c": cost})
    draws = resampled_sums(c, by, ["s", "q", "c"], reps, block, seed)
    traded = (F.col("q") > 0) & (F.col("c") > 0)
    stats = {"net_per_contract": F.when(traded, F.col("s") / F.col("q")), "return_on_deployed": F.when(traded, F.col("s") / F.col("c"))}
    out = interval(draws, by, stats, comparisons)
    point = c.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("q") > 0).alias("trade_days"))
    return _beside(point, out, by)


def stratified_bootstrap(df: DataFrame, stratum: str, cluster: str, value: Column, reps: int = 2000, seed: int = SEED, synchronized: bool = False) -> DataFrame:
    """Mean and sample sd under cluster resampling inside each stratum, per stratum and pooled (stratum NULL).

    ``synchronized`` draws calendar clusters jointly for all strata instead, which keeps cross-stratum dependence.
    """
    sums = {"s": value, "q": value * value, "m": F.lit(1)}
    if synchronized:
        c = clusters(df, [], cluster, sums)
        per = resampled_sums(c, [], ["s", "q", "m"], reps, 1, seed).withColumn(stratum, F.lit(None).cast("string"))
    else:
        c = clusters(df, [stratum], cluster, sums)
        own = resampled_sums(c, [stratum], ["s", "q", "m"], reps, 1, seed)
        pooled = own.groupBy("rep").agg(*[F.sum(x).alias(x) for x in ("s", "q", "m")]).withColumn(stratum, F.lit(None).cast("string"))
        per = own.unionByName(pooled)
    mean = F.col("s") / F.col("m")
    sd = F.when(F.col("m") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * mean) / (F.col("m") - 1))))
    draws = per.select(stratum, mean.alias("mean"), sd.alias("sd"))
    return draws.groupBy(stratum).agg(
        F.percentile("mean", F.lit(TAIL)).alias("mean_low"), F.percentile("mean", F.lit(1 - TAIL)).alias("mean_high"),
        F.percentile("sd", F.lit(TAIL)).alias("sd_low"), F.percentile("sd", F.lit(1 - TAIL)).alias("sd_high"), F.stddev_samp("sd").alias("sd_se"),
    )


def block_members(days: DataFrame, day: str, members: int = 32, seed: int = SEED, by: list[str] | None = None) -> DataFrame:
    """(by, member, day, copies): each member resamples calendar-adjacent two-day blocks until the day count is reached.

    Only days whose next calendar day exists may start a block; the last block is cut to fit. Join the result to rows
    by day and use ``copies`` as a weight: rows are never duplicated.
    """
    by = by or []
    group = W.partitionBy(*(by or [F.lit(0)]))
    d = days.select(*by, day).distinct()
    d = d.withColumn("n", F.count(F.lit(1)).over(group)).withColumn("i", F.row_number().over(group.orderBy(day)) - 1)
    start = F.lead(day).over(group.orderBy(day)) == F.col(day) + 1
    d = d.withColumn("_s", F.coalesce(start, F.lit(False)))
    starts = d.filter("_s").withColumn("k", (F.row_number().over(group.orderBy(day)) - 1).cast("long")).withColumn("ns", F.count(F.lit(1)).over(group))
    slots = d.select(*by, "i", "n").join(starts.select(*by, "ns").distinct(), by) if by else _attach(d.select("i", "n"), starts.select("ns").distinct())
    slots = slots.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).withColumn("block", F.floor(F.col("i") / 2).cast("long"))
    slots = slots.withColumn("k", draw(F.lit(seed), *[F.col(b) for b in by], F.col("member"), F.col("block"), n=F.col("ns")))
    picked = slots.join(starts.select(*by, "k", F.col(day).alias("_d")), [*by, "k"])
    return picked.withColumn(day, F.col("_d") + (F.col("i") % 2)).groupBy(*by, "member", day).agg(F.count(F.lit(1)).alias("copies"))


def expected_copies(days: DataFrame, day: str) -> DataFrame:
    """Expected multiplicity of each day under ``block_members``; its inverse weights repair the boundary days."""
    one = W.partitionBy(F.lit(0))
    d = days.select(day).distinct().withColumn("n", F.count(F.lit(1)).over(one))
    starts = F.coalesce((F.lead(day).over(one.orderBy(day)) == F.col(day) + 1).cast("int"), F.lit(0))
    d = d.withColumn("_s", starts)
    d = d.withColumn("_ns", F.sum("_s").over(one)).withColumn("_p", F.coalesce(F.lag("_s").over(one.orderBy(day)), F.lit(0)))
    whole = F.floor(F.col("n") / 2)
    odd = F.col("n") % 2
    return d.select(day, (((F.col("_s") + F.col("_p")) * whole + F.col("_s") * odd) / F.col("_ns")).alias("expected"))


def suppress_sparse(df: DataFrame, bounds: list[str], entries: str = "entries", days: str = "days_traded") -> DataFrame:
    """NULL bounds and a status where the evidence is too thin to resample honestly."""
    thin = (F.col(entries) < MIN_ENTRIES) | (F.col(days) < MIN_DAYS)
    return df.withColumns({b: F.when(~thin, F.col(b)) for b in bounds}).withColumn("status", F.when(thin, "insufficient_trade_evidence"))


def _attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    from tidemark.operators.temporal import scalar_join

    return scalar_join(df, one_row)


def _beside(point: DataFrame, out: DataFrame, by: list[str]) -> DataFrame:
    return point.join(out, by) if by else _attach(point, out)
