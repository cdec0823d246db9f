"""Chronological splits with embargoes. Times are integers in one unit; purged rows stay visible with role 'purged'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.slicing import HOUR


def split_fixed(df: DataFrame, a: int, b: int, embargo: int, at: str = "at", settled: str = "settled_t") -> DataFrame:
    """train: settled < a; validation: at >= a + embargo and settled < b; test: at >= b + embargo; else purged."""
    t, s = F.col(at), F.col(settled)
    return df.withColumn(
        "role",
        F.when(s < a, "train").when((t >= a + embargo) & (s < b), "validation").when(t >= b + embargo, "test").otherwise("purged"),
    )


def day_table(df: DataFrame, day: str = "day", at: str = "at", settled: str = "settled_t") -> DataFrame:
    """One row per day with its index, first decision and last settlement.

    Days are bounded by the calendar (a century is 36 525 rows), which is what makes an unpartitioned window here and
    the driver-free joins below safe at any data size.
    """
    days = df.groupBy(day).agg(F.min(at).alias("first_at"), F.max(settled).alias("last_settled"), F.count(F.lit(1)).alias("rows"))
    one = W.partitionBy(F.lit(0))
    return days.withColumn("i", F.row_number().over(one.orderBy(day)) - 1).withColumn("n", F.count(F.lit(1)).over(one))


def split_fraction_days(days: DataFrame, embargo: int, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Role per day: by position 60/20/20, dropping whole days whose slowest settlement crosses the next part's embargo.

    Cut points are whole-calendar scalars, computed as windows over the day table.
    """
    one = W.partitionBy(F.lit(0))
    v = F.floor(F.col("n") * F.lit(train)).cast("int")
    t = F.floor(F.col("n") * F.lit(train + validation)).cast("int")
    d = days.withColumn("part", F.when(F.col("i") >= t, "test").when(F.col("i") >= v, "validation").otherwise("train"))
    test_cut = F.min(F.when(F.col("part") == "test", F.col("first_at"))).over(one) - F.lit(embargo)
    d = d.withColumn("_test_cut", test_cut)
    d = d.withColumn("_val", (F.col("part") == "validation") & (F.col("last_settled") < F.col("_test_cut")))
    val_cut = F.min(F.when(F.col("_val"), F.col("first_at"))).over(one) - F.lit(embargo)
    d = d.withColumn("_val_cut", val_cut)
    return d.withColumn(
        "role",
        F.when(F.col("part") == "test", "test").when(F.col("_val"), "validation")
        .when((F.col("part") == "train") & (F.col("last_settled") < F.col("_val_cut")), "train").otherwise("purged"),
    ).drop("_test_cut", "_val", "_val_cut")


# The least days of a usable split and of its parts, and of the folds.
LEAST_DAYS, LEAST_TRAIN, LEAST_VALIDATION, LEAST_FOLDS = 45, 10, 5, 3


def require_split(roles: DataFrame, least_days: int = LEAST_DAYS, least_train: int = LEAST_TRAIN, least_validation: int = LEAST_VALIDATION) -> DataFrame:
    """The day roles themselves, or an error if there are too few days in all, in training or in validation."""
    have = roles.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "validation").alias("validation")).first()
    if have["all"] < least_days:
        raise ValueError(f"Training needs at least {least_days} days, there are {have['all']}")
    if have["train"] < least_train or have["validation"] < least_validation:
        raise ValueError(f"Too few days after the embargo: {have['train']} to train, {have['validation']} to validate")
    return roles


def require_folds(rows: DataFrame, least: int = LEAST_FOLDS) -> DataFrame:
    """The fold rows themselves, or an error if fewer than ``least`` folds are left."""
    if rows.select("fold").distinct().count() < least:
        raise ValueError(f"Not enough data for {least} purged chronological folds")
    return rows


def apply_day_roles(df: DataFrame, roles: DataFrame, day: str = "day") -> DataFrame:
    """Row-level roles from the small day table (an equi-join that AQE turns into a broadcast by measured size)."""
    return df.join(roles.select(day, "role"), day)


def expanding_folds(df: DataFrame, k: int = 3, embargo: int = 48 * HOUR, holdout: float = 0.2, min_holdout: int = 14,
                    first_share: float = 0.4, min_first: int = 15, min_train_days: int = LEAST_TRAIN, day: str = "day", at: str = "at", settled: str = "settled_t") -> DataFrame:
    """(fold, role) rows: the last days are held out, then k expanding folds purged by the embargo.

    A row appears once per fold it serves; a fold with fewer than ``min_train_days`` training days is left out, none at 0. Every threshold lives in day-sized frames; rows are read twice and never
    sorted globally.
    """
    one = W.partitionBy(F.lit(0))
    days = day_table(df, day, at, settled)
    hold = F.greatest(F.lit(min_holdout), F.ceil(F.col("n") * F.lit(holdout)).cast("int"))
    days = days.withColumn("_test", F.col("i") >= F.col("n") - hold)
    days = days.withColumn("_boundary", F.min(F.when(F.col("_test"), F.col("first_at"))).over(one) - F.lit(embargo))
    info = days.select(day, "_test", "_boundary")
    dev = df.join(info, day).filter(~F.col("_test") & (F.col(settled) < F.col("_boundary"))).drop("_test", "_boundary")
    usable = day_table(dev, day, at, settled)
    first = F.greatest(F.lit(min_first), F.floor(F.col("n") * F.lit(first_share)).cast("int"))
    edge = lambda j: F.floor(first + (F.col("n") - first) * F.lit(j / k) + F.lit(1e-9)).cast("int")
    fold = F.explode(F.array(*[F.struct(F.lit(j).alias("fold"), edge(j).alias("a"), edge(j + 1).alias("b")) for j in range(k)]))
    plan = usable.select(day, "i", "first_at", fold.alias("f")).select(day, "i", "first_at", "f.*")
    per_fold = W.partitionBy("fold")
    cut = F.min(F.when((F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")), F.col("first_at"))).over(per_fold) - F.lit(embargo)
    plan = plan.withColumn("cut", cut).filter(F.col("i") < F.col("b")).withColumn("_v", F.col("i") >= F.col("a"))
    rows = dev.join(plan.select(day, "fold", "_v", "cut"), day)
    role = F.when(F.col("_v"), "validation").when(F.col(settled) < F.col("cut"), "train").otherwise("purged")
    rows = rows.withColumn("role", role).drop("_v", "cut")
    if not min_train_days:
        return rows
    enough = rows.filter("role = 'train'").groupBy("fold").agg(F.count_distinct(day).alias("_days")).filter(F.col("_days") >= min_train_days)
    return rows.join(enough.select("fold"), "fold", "left_semi")


def rolling_folds(df: DataFrame, folds: list[tuple[int, int]], embargo: int, at: str = "at", settled: str = "settled_t") -> DataFrame:
    """Given [start, end) folds: train settled before start - embargo, score decisions inside the fold."""
    spec = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(folds)]))
    x = df.select("*", spec.alias("_f"))
    role = F.when(F.col(settled) < F.col("_f.a") - F.lit(embargo), "train").when(
        (F.col(at) >= F.col("_f.a")) & (F.col(at) < F.col("_f.b")), "validation"
    )
    return x.withColumn("role", role).withColumn("fold", F.col("_f.fold")).filter("role IS NOT NULL").drop("_f")


def inner_split(df: DataFrame, embargo: int = 2 * HOUR, day: str = "day", day_unit: int = 24 * HOUR, at: str = "at", settled: str = "settled_t") -> DataFrame:
    """The last max(2, n // 4) training days validate; fitting rows settle before that boundary."""
    one = W.partitionBy(F.lit(0))
    d = day_table(df, day, at, settled)
    tail = F.greatest(F.lit(2), F.floor(F.col("n") / 4).cast("int"))
    boundary = F.min(F.when(F.col("i") == F.col("n") - tail, F.col(day))).over(one) * F.lit(day_unit)
    j = df.join(d.select(day, boundary.alias("_b")), day)
    role = F.when(F.col(settled) < F.col("_b"), "fit").when(F.col(at) >= F.col("_b") + F.lit(embargo), "validation").otherwise("purged")
    return j.withColumn("role", role).drop("_b")


def oof_blocks(df: DataFrame, blocks: int = 3, warmup: float = 0.4, embargo: int = 2 * HOUR, day: str = "day", day_unit: int = 24 * HOUR,
               at: str = "at", settled: str = "settled_t") -> DataFrame:
    """Out-of-fold blocks after a warm-up; each block is scored by rows settled before its first day.

    Block sizes differ by at most one, larger blocks first.
    """
    d = day_table(df, day, at, settled)
    start = F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(warmup)).cast("int"))
    rest = F.col("n") - start
    size, extra = F.floor(rest / blocks).cast("int"), (rest % blocks).cast("int")
    edge = lambda j: start + size * F.lit(j) + F.least(F.lit(j), extra)
    spec = F.explode(F.array(*[F.struct(F.lit(j).alias("block"), edge(j).alias("a"), edge(j + 1).alias("b")) for j in range(blocks)]))
    plan = d.select(day, "i", spec.alias("f")).select(day, "i", "f.*")
    cut = F.min(F.when(F.col("i") == F.col("a"), F.col(day))).over(W.partitionBy("block")) * F.lit(day_unit)
    plan = plan.withColumn("_cut", cut).filter(F.col("i") < F.col("b")).withColumn("_s", F.col("i") >= F.col("a"))
    rows = df.join(plan.select(day, "block", "_cut", "_s"), day)
    role = F.when(F.col("_s") & (F.col(at) >= F.col("_cut") + F.lit(embargo)), "score").when(F.col(settled) < F.col("_cut"), "fit").otherwise("purged")
    return rows.withColumn("role", role).drop("_cut", "_s")


def assert_split(df: DataFrame, ticker: str, role: str, bounds: dict[str, tuple[int, int]], embargo: int, at: str = "at", close: str = "close_t", settled: str = "settled_t") -> DataFrame:
    """Violations of a finished split, by kind: boundary, embargo, chronology, and contracts in several parts."""
    lo = F.coalesce(*[F.when(F.col(role) == r, F.lit(a)) for r, (a, _) in bounds.items()])
    hi = F.coalesce(*[F.when(F.col(role) == r, F.lit(b)) for r, (_, b) in bounds.items()])
    first = min(bounds, key=lambda r: bounds[r][0])
    rows = df.select(
        F.explode(F.filter(F.array(
            F.when((F.col(at) < lo) | (F.col(settled) >= hi), "outside_boundary"),
            F.when((F.col(role) != first) & (F.col(at) < lo + embargo), "missing_embargo"),
            F.when(~((F.col(at) < F.col(close)) & (F.col(close) <= F.col(settled))), "chronology"),
        ), lambda x: x.isNotNull())).alias("kind")
    )
    shared = df.groupBy(ticker).agg(F.count_distinct(role).alias("parts"), F.count(F.lit(1)).alias("copies"))
    overlap = shared.filter("parts > 1").select(F.lit("shared_contract").alias("kind"))
    return rows.unionByName(overlap).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def partition_summary(df: DataFrame, by: list[str], ticker: str = "ticker", day: str = "day", y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct(ticker).alias("markets"), F.count_distinct(day).alias("days"),
        F.min(day).alias("start"), F.max(day).alias("end"), F.avg(y).alias("yes_rate"),
    )


def scope_intersection(df: DataFrame, role: str, series: str, hours: str, parts: list[str]) -> DataFrame:
    """Series present in every part with the common window: the largest minimum and smallest maximum of hours."""
    per = df.filter(F.col(role).isin(*parts)).groupBy(series, role).agg(F.min(hours).alias("lo"), F.max(hours).alias("hi"))
    return per.groupBy(series).agg(F.count(F.lit(1)).alias("_parts"), F.max("lo").alias("min_hours"), F.min("hi").alias("max_hours")).filter(
        F.col("_parts") == len(parts)
    ).drop("_parts")


def whole_hours(df: DataFrame, close: str, hour: int = HOUR) -> DataFrame:
    """Contracts that close exactly on the hour."""
    return df.filter(F.col(close) % F.lit(hour) == 0)
