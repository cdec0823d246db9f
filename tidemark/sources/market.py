"""Readers for market listings, order books, quote candles, records, journals and samples.

Every reader is ``read_x(spark, path)`` = ``parse_x(text frame)``; the parsers take any DataFrame with a text column, so
the same code serves batch files, streams and columns of other tables. Nothing is inferred: schemas are explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schemas as T
from tidemark.functions.contracts import zoned_timestamp
from tidemark.operators.quality import record_rules
from tidemark.functions.books import level_violations
from tidemark.operators.slicing import evaluated_once


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file name; blank lines are dropped."""
    return spark.read.text(path).select("value", F.input_file_name().alias("file")).filter(F.trim("value") != "")


def _levels(x: Column) -> Column:
    """[[price, quantity], ...] decimal strings to array<struct<price, qty>>; a missing side is an empty array.

    Text that is no number, or has more decimals than a price or quantity may have, gives NULL, which the level rule rejects.
    """
    exact = lambda x, kind: F.when(x.try_cast("decimal(38,18)") == x.try_cast(kind), x.try_cast(kind))
    level = lambda l: F.struct(exact(F.get(l, F.lit(0)), "decimal(9,4)").alias("price"), exact(F.get(l, F.lit(1)), "decimal(18,2)").alias("qty"))
    return F.transform(F.coalesce(x, F.array().cast("array<array<string>>")), level)


def parse_books(df: DataFrame, column: str) -> DataFrame:
    """Books given as {"yes": [[p, q]], "no": [[p, q]]} or in the second venue's {"bids": [{price, size}], "asks": [...]}."""
    b = F.from_json(F.col(column), T.RAW_BOOK)
    venue = lambda x: F.transform(F.coalesce(x, F.array().cast(T.VENUE_LEVELS)), lambda l: F.struct(l["price"].try_cast("double").alias("price"), l["size"].try_cast("double").alias("qty")))
    out = df.withColumn("_b", b)
    return out.withColumns({
        "yes": _levels(F.col("_b.yes")), "no": _levels(F.col("_b.no")), "bids": venue(F.col("_b.bids")), "asks": venue(F.col("_b.asks")),
    }).drop("_b")


def split_books(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(books, rejected lines): a book with a malformed level is rejected as a whole."""
    books = parse_books(df, column)
    sides = [level_violations(F.col(c)) for c in ("yes", "no", "bids", "asks")]
    bad = F.coalesce(sides[0] | sides[1] | sides[2] | sides[3], F.lit(True))
    return books.filter(~bad), books.filter(bad).select(*df.columns)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return parse_books(read_lines(spark, path), "value").drop("value")


def tag_records(df: DataFrame, column: str = "value") -> DataFrame:
    """Typed records from JSON lines with the rules that each violates (none: an empty array), parsed once.

    Timestamps must carry an offset. A line that is not JSON, or has a field of another type, is ``malformed``.
    """
    d = evaluated_once(df, _j=F.from_json(F.col(column), T.RECORD_TEXT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    fields = {f: F.col(f"_j.{f}") for f in T.RECORD_TEXT.fieldNames()}
    for f in T.RECORD_TIMES:
        fields[f] = zoned_timestamp(fields[f])
    for side in ("yes", "no"):
        fields[side] = F.when(F.col(f"_j.{side}").isNotNull(), _levels(F.col(f"_j.{side}")))
    for f in ("fee_rate", "probability", "yes_payout"):
        fields[f] = F.expr(f"try_cast(_j.{f} AS double)")
    check = F.col("_j.execution_check")
    fields["execution_check"] = F.when(check.isNotNull(), F.struct(check["signal"].alias("signal"), check["model_id"].alias("model_id"), zoned_timestamp(check["made_at"]).alias("made_at"), check["probability"].try_cast("double").alias("probability")))
    rows = evaluated_once(d, **fields).drop("_j")
    malformed = F.col("_corrupt").isNotNull() | F.col("type").isNull()
    return evaluated_once(rows, violations=F.when(malformed, F.array(F.lit("malformed"))).otherwise(record_rules())).drop("_corrupt")


def parse_records(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected lines with the violated rules), two views of ``tag_records``."""
    rows = tag_records(df, column)
    keep = [c for c in df.columns if c != column]
    good = rows.filter(F.size("violations") == 0).drop("violations", column)
    return good, rows.filter(F.size("violations") > 0).select(*keep, column, "violations")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """All text lines with where they were read: file, _block (offset of the split in its file) and _id, which grows along a split."""
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    return spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("_id"))


def with_line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows (of ``placed_lines``) with ``line``, from 1: the lines of the file's splits before, and the place in its own.

    Splits count their lines and add up the counts before them, one row a split; no text is shuffled but that of ``rows``.
    """
    splits = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select(F.col("file").alias("_file"), F.col("_block").alias("_at"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    found = rows.join(splits, (F.col("file") == F.col("_file")) & (F.col("_block") == F.col("_at")))
    return found.withColumn("line", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_file", "_at", "_first", "_before", "_block", "_id")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Mixed-type JSON lines; a rejected line is identified by its file and line number. An empty dataset is an error."""
    lines = placed_lines(spark, path)
    filled = lines.filter(F.trim("value") != "")
    if filled.isEmpty():
        raise ValueError("dataset has no records")
    good, bad = parse_records(filled)
    return good.drop("_block", "_id"), with_line_numbers(bad, lines)


# Fixed value: a decimal-dollar string in the older field; numbers and whole cents do not match.
OLD_CLOSE = r'"close"\s*:\s*"(-?\d*\.\d+)"'


def _close(side: Column) -> Column:
    """Closing quote text of one candle side (JSON text): ``close_dollars``, else a decimal string in ``close``."""
    old = F.regexp_extract(side, OLD_CLOSE, 1)
    return F.coalesce(F.get_json_object(side, "$.close_dollars"), F.when(old != "", old))


def parse_candles(df: DataFrame, column: str = "value") -> DataFrame:
    """Quote candles, one row per candle; ``bid``/``ask`` are NULL unless 0 <= bid <= ask <= 1.

    Two encodings: dollar strings in ``close_dollars``; or decimal strings in ``close`` (numbers and whole cents there
    are refused, not guessed).
    """
    page = F.from_json(F.col(column), T.CANDLE_PAGE)
    m = df.select(*[c for c in df.columns if c != column], F.explode(page["markets"]).alias("_m"))
    c = m.select(*[x for x in m.columns if x != "_m"], F.col("_m.market_ticker").alias("ticker"), F.explode("_m.candlesticks").alias("_c"))
    c = c.withColumn("_bid", _close(F.col("_c.yes_bid"))).withColumn("_ask", _close(F.col("_c.yes_ask")))
    c = c.withColumn("_b", F.expr("try_cast(_bid AS double)")).withColumn("_a", F.expr("try_cast(_ask AS double)"))
    ok = (F.col("_b") >= 0) & (F.col("_b") <= F.col("_a")) & (F.col("_a") <= 1)
    return c.select(
        *[x for x in m.columns if x != "_m"], "ticker", F.col("_c.end_period_ts").alias("end_ts"), F.when(ok, F.col("_b")).alias("bid"), F.when(ok, F.col("_a")).alias("ask"),
    )


def read_quote_candles(spark: SparkSession, path: str) -> DataFrame:
    return parse_candles(read_lines(spark, path))


def parse_journal(df: DataFrame, column: str = "value") -> DataFrame:
    """Journal envelope; the payload stays JSON text so that each kind can be typed by its own view."""
    e = F.from_json(F.col(column), T.JOURNAL)
    return df.select(*[c for c in df.columns if c != column], e.alias("_e")).select("*", "_e.*").drop("_e").withColumn("recorded_at", zoned_timestamp(F.col("recorded_at")))


def journal_view(journal: DataFrame, kind: str, schema) -> DataFrame:
    """Typed view of one kind of journal record."""
    return journal.filter(F.col("kind") == kind).select("sequence", "recorded_at", F.from_json("payload", schema).alias("_p")).select("sequence", "recorded_at", "_p.*")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return parse_journal(read_lines(spark, path))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows as JSON lines; NULL lower/upper mean an open end and stay NULL."""
    return spark.read.schema(T.SAMPLE).json(path)


def parse_listings(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Saved listing pages to (one row per contract, tickers that occur more than once)."""
    page = F.from_json(F.col(column), T.LISTING_PAGE)
    m = df.select(F.explode(page["markets"]).alias("_m")).select("_m.*")
    rest = [c for c in m.columns if c != "ticker"]
    g = m.groupBy("ticker").agg(F.count(F.lit(1)).alias("copies"), F.min_by(F.struct(*rest), F.struct(*rest)).alias("_r"))
    return g.filter("copies = 1").select("ticker", "_r.*"), g.filter("copies > 1").select("ticker", "copies")


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """All pages of a folder; a duplicate ticker is an error."""
    good, bad = parse_listings(read_lines(spark, path))
    if not bad.isEmpty():
        raise ValueError("duplicate tickers in listing pages")
    return good
