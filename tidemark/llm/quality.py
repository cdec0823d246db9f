"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source replace fixed cutoffs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.codes import text_bytes, word_bounds, word_hashes
from tidemark.session import written
from tidemark.llm.tasks import of_batches

WINDOW = 5
#: Groups of fewer documents take their language's sketch, and languages of fewer the sketch of all.
LEAST_DOCS = 100
#: A value is out when it lies more than SPREADS times the spread of the middle half outside that half, and SLACK more.
SPREADS = 3
#: In thousandths: of a code point a word, a symbol a word, a line, a word, a word.
SLACK = {"mean_chars": 1500, "symbols": 100, "dup_lines": 400, "repeats": 200, "stutter": 200}
#: The slack grows for short texts, whose rates are uncertain: by this many words over the text's own.
SHORT_WORDS = 15
#: Values below this are counted exactly, larger ones with so many steps a doubling (a relative error below 1 / STEPS).
STEPS = 64
#: At most so many (language, source) groups are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000
SYMBOLS = b"#*$%&|<>"

_BASE = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_stutter long"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def repeated_words(words: np.ndarray, n: int = WINDOW) -> int:
    """Words that lie in windows of n words found twice or more in one text, the first one included."""
    if len(words) <= n:
        return 0
    window = words[: len(words) - n + 1].copy()
    for j in range(1, n):  # pairs of numbers stand for the runs: equal numbers, equal runs
        _, left = np.unique(window, return_inverse=True)
        _, right = np.unique(words[j : j + len(window)], return_inverse=True)
        window = left.astype(np.int64) * (int(right.max()) + 1) + right
    _, at, size = np.unique(window, return_inverse=True, return_counts=True)
    start = np.flatnonzero(size[at] > 1)
    if not len(start):
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    change[start] += 1
    change[start + n] -= 1
    return int((np.cumsum(change[:-1]) > 0).sum())


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines), len(lines) - len(set(lines))


def base_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stutter (words equal to the one before)."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    chars = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8)))))[offsets]
    symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[data])))[offsets]
    raw = data.tobytes()
    lines = np.array([_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64).reshape(-1, 2)
    repeats = np.array([repeated_words(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
    same = np.concatenate((words[1:] == words[:-1], [False])) if len(words) else np.zeros(0, bool)
    same[first[1:][first[1:] > 0] - 1] = False
    stutter = np.concatenate(([0], np.cumsum(same)))[first]
    return {"n_words": np.diff(first), "word_chars": np.diff(chars), "n_symbols": np.diff(symbols), "n_lines": lines[:, 0], "n_dup_lines": lines[:, 1], "n_repeat_words": repeats, "n_stutter": np.diff(stutter)}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            base = base_of(*text_bytes(part.column(part.schema.get_field_index("_text"))))
            keep = part.schema.names
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *(pa.array(x.astype(np.int64)) for x in base.values())], [*keep, *base])


def measured(docs: DataFrame, text: str) -> DataFrame:
    """docs with the counts of its column `text` added; null counts as empty."""
    source = docs.withColumnRenamed(text, "_text").withColumn("_text", F.col("_text").cast("string"))
    schema = T.StructType([*source.schema.fields, *T._parse_datatype_string(_BASE).fields])
    return source.mapInArrow(of_batches(_measure), schema).withColumnRenamed("_text", text)


def step(value: Column) -> Column:
    """Lower end of the sketch's step that holds a whole number from 0 on: exact below 2 * STEPS, then STEPS steps a doubling."""
    bits = F.greatest(F.length(F.bin(value)) - F.lit(STEPS.bit_length()), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def rates() -> dict[str, Column]:
    """What the thresholds are for, in thousandths; documents without words count as 0."""
    per = lambda a, b: F.expr(f"coalesce({a} * 1000 div nullif({b}, 0), 0)")
    return {"mean_chars": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "stutter": per("n_stutter", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def sketches(measures: DataFrame) -> DataFrame:
    """lang, source, rate, step, n: one sketch per group and rate, over documents that pass the base rules.

    A sketch is a count per step; sketches of parts merge by adding counts, so tasks combine before the shuffle, any
    grouping gives the same sketch, and its size is bounded by the range of a long.
    """
    long = measures.where(~base_failed()).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), step(v).alias("step")) for k, v in rates().items()))).alias("r"))
    return long.groupBy("lang", "source", "r.rate", "r.step").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and low_<rate>, high_<rate> for each rate, from the sketch of the group, or of what it belongs to if that is small."""
    levels = {"own": ["lang", "source"], "lang": ["lang"], "all": []}
    quartiles = []
    for name, by in levels.items():
        merged = sketch.groupBy(*by, "rate", "step").agg(F.sum("n").alias("n"))
        # one row per step of a sketch: a bounded number
        cells = merged.groupBy(*by, "rate").agg(F.sort_array(F.collect_list(F.struct("step", "n"))).alias("cells"), F.sum("n").alias("docs"))
        rank = lambda q: F.aggregate("cells", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")), lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["at"], F.when((s["seen"] + x["n"]) * 4 >= F.col("docs") * q, x["step"])).alias("at")))["at"]  # noqa: B023, E731
        q = cells.select(*by, "rate", F.struct("docs", rank(1).alias("q1"), rank(3).alias("q3")).alias(f"of_{name}"))
        quartiles.append((by, q))
    own, lang, everything = (q for _, q in quartiles)
    out = own.join(lang.withColumnRenamed("lang", "_lang").withColumnRenamed("rate", "_rate"), F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rate") == F.col("_rate"))).drop("_lang", "_rate").join(everything, "rate")
    pick = lambda f: F.when(F.col("of_own.docs") >= LEAST_DOCS, F.col(f"of_own.{f}")).when(F.col("of_lang.docs") >= LEAST_DOCS, F.col(f"of_lang.{f}")).otherwise(F.col(f"of_all.{f}"))
    slack = F.create_map(*(x for k, v in SLACK.items() for x in (F.lit(k), F.lit(v))))[F.col("rate")]
    fence = out.select("lang", "source", "rate", pick("q1").alias("q1"), pick("q3").alias("q3"), slack.alias("slack")).withColumn("reach", (F.col("q3") - F.col("q1")) * SPREADS + F.col("slack"))
    at = lambda name, value, k: F.max(F.when(F.col("rate") == k, value)).alias(f"{name}_{k}")
    return fence.groupBy("lang", "source").agg(*(at("low", F.col("q1") - F.col("reach"), k) for k in SLACK), *(at("high", F.col("q3") + F.col("reach"), k) for k in SLACK))


def judged(measures: DataFrame) -> DataFrame:
    """measures with base_failed and kept. A group all of whose documents fail the base rules has no sketch and none kept."""
    sketch = written(sketches(measures.select("lang", "source", *(f.name for f in T._parse_datatype_string(_BASE)))), "sketch")
    limits = thresholds(sketch).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    if sketch.select("lang", "source").distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    out = measures.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for k, v in rates().items():
        more = F.expr(f"coalesce({SLACK[k] * SHORT_WORDS} div nullif(n_words, 0), 0)")
        inside = inside & (v <= F.col(f"high_{k}") + more) & (v >= F.col(f"low_{k}") - more if k == "mean_chars" else F.lit(True))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(False)))).drop("_lang", "_source", *(f"{a}_{k}" for a in ("low", "high") for k in SLACK))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document.

    Null texts have no words and fail the base rules; null languages and sources are groups of their own; repeated rows
    count each; an empty table gives no row.
    """
    measures = measured(docs.select(F.col("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")), "text").drop("text")
    return judged(measures).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text is kept by the rules."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in ("lang", "source", "text")}
    source = docs.toDF(*names)
    source = source.withColumns({"lang": F.col(at["lang"]).cast("string"), "source": F.col(at["source"]).cast("string")})
    return judged(measured(source, at["text"])).where("kept").select(*names).toDF(*docs.columns)


#: The digest over all documents, with the same whole-number sketches.
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
five AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM (
    SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS x FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d))),
again AS (
  SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, {WINDOW})) AS j FROM five WHERE n > 1) GROUP BY r),
m AS (
  SELECT d.r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS n_lines,
    len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_different,
    coalesce(again.n, 0) AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
  FROM d LEFT JOIN again ON d.r = again.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_lines - n_different AS n_dup_lines FROM m),
v AS (
  SELECT r, lang, source, n_words, base_failed, unnest([
    {{'rate': 'mean_chars', 'v': coalesce(word_chars * 1000 // nullif(n_words, 0), 0)}}, {{'rate': 'symbols', 'v': coalesce(n_symbols * 1000 // nullif(n_words, 0), 0)}},
    {{'rate': 'dup_lines', 'v': coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0)}}, {{'rate': 'repeats', 'v': coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0)}},
    {{'rate': 'stutter', 'v': coalesce(n_stutter * 1000 // nullif(n_words, 0), 0)}}], recursive := true) FROM b),
c AS (
  SELECT lang, source, rate, (v >> bits) << bits AS step, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - {STEPS.bit_length()}, 0)::BIGINT AS bits FROM v WHERE NOT base_failed) GROUP BY ALL),
q AS (
  SELECT level, lang, source, rate, max(seen) AS docs, min(step) FILTER (seen * 4 >= docs_) AS q1, min(step) FILTER (seen * 4 >= docs_ * 3) AS q3 FROM (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY step) AS seen, sum(n) OVER (PARTITION BY level, lang, source, rate) AS docs_ FROM (
      SELECT 1 AS level, lang, source, rate, step, sum(n) AS n FROM c GROUP BY ALL UNION ALL
      SELECT 2, lang, NULL, rate, step, sum(n) FROM c GROUP BY ALL UNION ALL
      SELECT 3, NULL, NULL, rate, step, sum(n) FROM c GROUP BY ALL)) GROUP BY ALL),
f AS (
  SELECT lang, source, rate, slack, a - reach AS low, z + reach AS high FROM (
    SELECT *, (z - a) * {SPREADS} + slack AS reach FROM (
      SELECT o.lang, o.source, o.rate, CASE o.rate {" ".join(f"WHEN '{k}' THEN {x}" for k, x in SLACK.items())} END AS slack,
        CASE WHEN o.docs >= {LEAST_DOCS} THEN o.q1 WHEN l.docs >= {LEAST_DOCS} THEN l.q1 ELSE e.q1 END AS a,
        CASE WHEN o.docs >= {LEAST_DOCS} THEN o.q3 WHEN l.docs >= {LEAST_DOCS} THEN l.q3 ELSE e.q3 END AS z
      FROM q o JOIN q l ON o.level = 1 AND l.level = 2 AND o.rate = l.rate AND o.lang IS NOT DISTINCT FROM l.lang JOIN q e ON e.level = 3 AND e.rate = o.rate))),
verdict AS (
  SELECT v.r, bool_and(coalesce(v.v <= f.high + more AND (v.rate <> 'mean_chars' OR v.v >= f.low - more), false)) AS inside FROM (
    SELECT v.*, coalesce((CASE rate {" ".join(f"WHEN '{k}' THEN {x}" for k, x in SLACK.items())} END * {SHORT_WORDS}) // nullif(n_words, 0), 0) AS more FROM v) v
  LEFT JOIN f ON v.rate = f.rate AND v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept
FROM b JOIN verdict USING (r)
"""
