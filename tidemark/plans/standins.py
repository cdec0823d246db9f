"""The driver tables seen as ticks, quotes, samples and ledgers, once in Spark and once as SQL text for the oracle.

``events`` is the tick stream: ``user_id`` the contract, ``event_type`` the series, the integer ``k`` in ``props`` the
quoted mid in cents and ``value`` the traded size. Times are epoch microseconds (``t``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators.slicing import DAY, evaluated_once

S = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    """Epoch microseconds of a timestamp_ntz column that is declared UTC at load."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = evaluated_once(e, t=micros("ts"), k=F.get_json_object("props", "$.k").cast("long"))
    return e.select("event_id", "user_id", "event_type", "value", "t", "k")


TICKS = """ticks AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature row per tick: quote around the mid, model probability, label and the point-in-time columns."""
    half = F.lit(1) + F.floor("value").cast("long") % 3
    e = ticks(spark, sf_dir)
    bid, ask = F.greatest(F.col("k") - half, F.lit(0)), F.least(F.col("k") + half, F.lit(100))
    day = F.floor(F.col("t") / DAY).cast("long")
    return e.select(
        F.col("event_id"), F.col("user_id"), F.col("event_type").alias("series"), day.alias("day"),
        F.concat_ws("-", F.col("event_type"), day.cast("string")).alias("event"),
        F.col("t").alias("at"),
        (F.col("t") + (F.col("k") + 1) * F.lit(600 * S)).alias("close_t"),
        (F.col("t") + (F.col("k") + 1) * F.lit(600 * S) + F.lit(3600 * S)).alias("settled_t"),
        "k", "value",
        (bid / F.lit(100.0)).alias("bid"), (ask / F.lit(100.0)).alias("ask"),
        ((bid + ask) / F.lit(200.0)).alias("p"), ((ask - bid) / F.lit(100.0)).alias("spread"),
        (F.col("event_id") * 7919 % 100 < F.col("k")).cast("int").alias("y"),
        F.least(F.lit(0.99), F.greatest(F.lit(0.01), (F.col("k") * 9 + 50) / F.lit(1000.0)
                + F.when(F.col("value") > 70, F.lit(0.05)).otherwise(F.lit(-0.02)))).alias("q"),
        ((F.col("k") + 1) / F.lit(6.0)).alias("hours_left"),
    )


SAMPLES = TICKS + """, s0 AS (
  SELECT *, 1 + CAST(floor(value) AS BIGINT) % 3 AS half, t // 86400000000 AS day FROM ticks),
s1 AS (SELECT *, greatest(k - half, 0) AS bc, least(k + half, 100) AS ac FROM s0),
samples AS (
  SELECT event_id, user_id, event_type AS series, day, event_type || '-' || CAST(day AS VARCHAR) AS event, t AS "at",
         t + (k + 1) * 600000000 AS close_t, t + (k + 1) * 600000000 + 3600000000 AS settled_t, k, value,
         bc / 100.0::DOUBLE AS bid, ac / 100.0::DOUBLE AS ask, (bc + ac) / 200.0::DOUBLE AS p,
         (ac - bc) / 100.0::DOUBLE AS spread,
         CAST(event_id * 7919 % 100 < k AS INTEGER) AS y,
         least(0.99::DOUBLE, greatest(0.01::DOUBLE, (k * 9 + 50) / 1000.0::DOUBLE
           + CASE WHEN value > 70 THEN 0.05::DOUBLE ELSE -0.02::DOUBLE END)) AS q,
         (k + 1) / 6.0::DOUBLE AS hours_left
  FROM s1)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One simulated fill per order line: side, quote, quantity, payout, cost and fee, dated by the order."""
    from tidemark.functions.money import debit, slipped

    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cents = F.lit(1) + F.floor("l_extendedprice").cast("long") % 97
    rows = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_extendedprice").cast("long").cast("string")).alias("ticker"),
        "l_orderkey", F.col("l_quantity").cast("long").alias("quantity"),
        (cents / F.lit(100.0)).alias("ask"), (cents / F.lit(100.0) - F.lit(0.01)).alias("mid"),
        F.least(F.lit(0.99), cents / F.lit(100.0) + F.col("l_discount")).alias("p"),
        F.when(F.col("l_linestatus") == "O", F.lit("yes")).otherwise(F.lit("no")).alias("side"),
        (F.col("l_returnflag") == "R").cast("int").alias("payout"),
    )
    orders = o.select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey"), F.col("o_orderpriority").alias("series"),
        F.floor(micros("o_orderdate") / DAY).cast("long").alias("day"), micros("o_orderdate").alias("t"),
    )
    # The slipped price feeds three places of the debit and the debit three columns: each is computed once.
    rows = evaluated_once(rows, _p=slipped(F.col("ask"), 0.02))
    rows = evaluated_once(rows, _c=debit(F.col("_p"), F.col("quantity")))
    return (
        rows.join(orders, "l_orderkey")
        .withColumn("fees", (F.col("_c") - F.col("_p") * F.col("quantity")).cast("double"))
        .withColumn("cost", F.col("_c").cast("double"))
        .withColumn("pnl", (F.col("payout") * F.col("quantity") - F.col("_c")).cast("double"))
        .drop("_p", "_c")
    )


def debit_sql(price: str, quantity: str, rate: str = "0.07") -> str:
    """SQL text of the exact cent-ceiling debit, as DOUBLE."""
    p, q, r = f"CAST({price} AS DECIMAL(7,6))", f"CAST({quantity} AS DECIMAL(10,0))", f"CAST({rate} AS DECIMAL(5,4))"
    one = f"CAST(1 - {p} AS DECIMAL(7,6))"
    return f"(CAST(ceil(({p} * {q} + {r} * {q} * {p} * {one}) * 100) AS DOUBLE) / 100)"


LEDGER = f"""l0 AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice) AS BIGINT) AS ticker, l_orderkey,
         CAST(l_quantity AS BIGINT) AS quantity, 1 + CAST(floor(l_extendedprice) AS BIGINT) % 97 AS cents,
         l_discount, CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS side,
         CAST(l_returnflag = 'R' AS INTEGER) AS payout FROM lineitem),
l1 AS (
  SELECT l0.*, o_custkey, o_orderpriority AS series, epoch_us(o_orderdate) // 86400000000 AS day, epoch_us(o_orderdate) AS t,
         cents / 100.0::DOUBLE AS ask, cents / 100.0::DOUBLE - 0.01::DOUBLE AS mid,
         least(0.99::DOUBLE, cents / 100.0::DOUBLE + l_discount) AS p,
         CAST(cents + 2 AS DOUBLE) / 100.0::DOUBLE AS exec_price
  FROM l0 JOIN orders ON o_orderkey = l_orderkey),
l2 AS (SELECT *, {debit_sql('least(exec_price, 1.0::DOUBLE)', 'quantity')} AS cost FROM l1),
ledger AS (
  SELECT *, cost - CAST(CAST(least(exec_price, 1.0::DOUBLE) AS DECIMAL(7,6)) * quantity AS DOUBLE) AS fees,
         payout * quantity - cost AS pnl FROM l2)"""


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``functions.numeric.rounded``."""
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale}::DOUBLE + 0.5::DOUBLE) / {scale}::DOUBLE)"


__all__ = ["table", "ticks", "samples", "ledger", "micros", "rounded", "R", "TICKS", "SAMPLES", "LEDGER", "debit_sql", "S", "DAY"]
