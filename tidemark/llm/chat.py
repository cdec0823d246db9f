"""Chat formatting: collapse cumulative snapshots of conversations, then render the maximal ones. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Turns of one conversation that are numbered and hashed together; longer conversations are split into blocks of that many.
BLOCK = 512
TEMPLATE = {"open": "<|im_start|>", "after_role": "\n", "close": "<|im_end|>\n"}


def _block(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / BLOCK), F.lit(-1)).cast("long")


def _same(name: str) -> list[Column]:
    return [F.col(f"{name}.conv_id").eqNullSafe(F.col("t.conv_id")), F.col(f"{name}.block") == F.col("t.block")]


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, block, role, text, position (from 1), n_turns; order: turn (nulls first), role, text.

    A window numbers one block; the sizes of the blocks before are added, one row per block.
    """
    source = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).withColumn("block", _block(F.col("turn")))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    sizes = source.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy("conv_id")).alias("n_turns"))
    numbered = source.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)))
    return numbered.alias("t").join(sizes.alias("s"), _same("s")).select("t.conv_id", "t.block", "role", "text", (F.col("rn") + F.col("before")).alias("position"), "n_turns")


def prefix_hashed(turns: DataFrame) -> DataFrame:
    """conv_id, position, n_turns, h1, h2: rolling hashes of each conversation's turns up to each position.

    The hash of a prefix is the exclusive or of its turns' hashes, each taken with its position, so prefixes roll over
    blocks: a window covers one block, and one row per block is carried over.
    """
    content = [F.col("position"), F.coalesce(F.col("role"), F.lit("")), F.col("role").isNull(), F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()]
    hashed = placed(turns).select("conv_id", "block", "position", "n_turns", F.xxhash64(*content).alias("x1"), F.xxhash64(F.lit(0x5DEECE66D), *content, F.length("text")).alias("x2"))
    blocks = hashed.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("b1"), F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("b2"))
    upto = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.withColumn("r1", F.bit_xor("x1").over(upto)).withColumn("r2", F.bit_xor("x2").over(upto)).alias("t").join(blocks.alias("b"), _same("b"))
    return rolled.select("t.conv_id", "position", "n_turns", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id of conversations that are no prefix of a longer one; of equal ones the smallest conv_id (null last).

    One row per different prefix says how long a conversation through it gets; whole conversations are looked up there.
    """
    longest = prefixes.groupBy("h1", "h2", "position").agg(F.max("n_turns").alias("longest"))
    whole = prefixes.where(F.col("position") == F.col("n_turns")).groupBy("h1", "h2", F.col("n_turns").alias("position")).agg(F.min("conv_id").alias("conv_id"))
    return whole.join(longest.where(F.col("longest") > F.col("position")), ["h1", "h2", "position"], "left_anti").select("conv_id")


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template; a null role or text is empty."""
    return F.concat(F.lit(TEMPLATE["open"]), F.coalesce(role, F.lit("")), F.lit(TEMPLATE["after_role"]), F.coalesce(text, F.lit("")), F.lit(TEMPLATE["close"]))


def chat_format(turns: DataFrame) -> DataFrame:
    """conv_id, position, n_turns, rendered: the turns of every maximal conversation in the chat template, one row per turn.

    A conversation's text is its rendered turns in the order of position; rows stay apart so that no conversation has to
    fit in one task. Conversations equal in all turns are one. Null turn numbers come first; equal ones are ordered by role
    and text; a null conv_id is a conversation of its own. An empty table gives no row; other columns are ignored.
    """
    keep = maximal(written(prefix_hashed(turns), "prefixes")).withColumnRenamed("conv_id", "_keep")
    kept = placed(turns.join(keep, turns["conv_id"].cast("long").eqNullSafe(F.col("_keep")), "left_semi"))
    return kept.select("conv_id", F.col("position").cast("long").alias("position"), "n_turns", render(F.col("role"), F.col("text")).alias("rendered"))


#: The same rows: a conversation is dropped when its rendered turns begin another one's, longer or with a smaller conv_id.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
    count(*) OVER (PARTITION BY conv_id) AS n_turns,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
  FROM conversations),
p AS (
  SELECT conv_id, position, n_turns, string_agg(rendered, '') OVER (PARTITION BY conv_id ORDER BY position) AS so_far FROM t),
gone AS (
  SELECT DISTINCT a.conv_id FROM p a JOIN p b ON a.so_far = b.so_far AND a.position = b.position AND a.conv_id <> b.conv_id
  WHERE a.position = a.n_turns AND (b.n_turns > a.n_turns OR (b.n_turns = a.n_turns AND b.conv_id < a.conv_id)))
SELECT conv_id, position, n_turns, rendered FROM t WHERE conv_id NOT IN (SELECT conv_id FROM gone)
"""
