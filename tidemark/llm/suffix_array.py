"""Suffix-array deduplication: a depth-limited radix sort of suffixes by passes over their most significant digits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.codes import ranges
from tidemark.llm.repeats import Rule, without_repeats
from tidemark.llm.tasks import of_batches

WIDTH, ANCHOR, CROWD = 50, 22, 4096
DIGIT = 8


def radix_groups(digits: list, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows within `group` by digit after digit; a row alone in its group leaves the sort at once.

    digits: functions (rows) -> digit of each row, most significant first. Returns the rows that are left after the last
    digit and their groups: two rows share a group if and only if all their digits are equal.
    """
    rows = np.arange(len(group))
    for digit in [None, *digits]:
        if digit is not None:
            value = digit(rows)
            order = np.lexsort((value, group))
            rows, group, value = rows[order], group[order], value[order]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])))[: len(rows)]
        else:
            order = np.argsort(group, kind="stable")
            rows, group = rows[order], group[order]
            new = np.concatenate(([True], group[1:] != group[:-1]))[: len(rows)]
        group = np.cumsum(new) - 1
        size = np.bincount(group, minlength=1)
        more = size[group] > 1
        rows, group = rows[more], group[more]
    return rows, group


def sort_windows(key: np.ndarray, syms: np.ndarray, lens: np.ndarray, doc: np.ndarray, pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of byte contexts that stand in an earlier place as well: (context, window, window + 1).

    The suffixes start at each window of each context and are sorted to a depth of `width` bytes; digit 0 is the anchor
    that they share, the others are DIGIT bytes each, the last one overlapping the one before.
    """
    n = lens - width + 1
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    owner = np.repeat(np.arange(len(n)), n)
    at = ranges(starts, n)
    long = np.zeros(len(syms), np.uint64)
    for j in range(DIGIT):
        long[: len(syms) - j] |= syms[j:].astype(np.uint64) << np.uint64(8 * (DIGIT - 1 - j))
    offsets = [min(j, width - DIGIT) for j in range(0, width, DIGIT)]
    rows, group = radix_groups([lambda r, o=o: long[at[r] + o] for o in offsets], key[owner].astype(np.int64))
    if not len(rows):
        return rows, rows, rows
    order = np.lexsort((pos[owner[rows]], doc[owner[rows]], group))
    rows, group = rows[order], group[order]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    late = doc[owner[rows]] > doc[owner[rows[lead]]]
    rows = rows[late]
    window = at[rows] - starts[owner[rows]]
    return owner[rows], window, window + 1


RULE = Rule(WIDTH, ANCHOR, words=False, within=False, crowd=CROWD, sorter=sort_windows)


def suffix_dedup(docs: DataFrame, width: int = WIDTH, carry: bool = False) -> DataFrame:
    """Remove each byte covered by a string of `width` bytes that also starts in a document with a smaller doc_id.

    Returns doc_id, n_symbols (bytes), n_removed, spans, kept (binary: the bytes that are left). Strings are judged on the
    input, overlaps count, and matches never cross documents. Nulls, ties and empty input: see without_repeats.
    """
    rule = RULE if width == WIDTH else Rule(width, max(1, width // 2), words=False, within=False, crowd=CROWD, sorter=sort_windows)
    return without_repeats(docs, rule, carry)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = batch.schema.get_field_index("kept")
        text = pa.array([x.decode("utf-8", "ignore") for x in batch.column(i).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([text if k == i else c for k, c in enumerate(batch.columns)], batch.schema.names)


def without_passages(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, all columns, with the repeated strings cut out of text and n_chars counted anew; rows of which nothing is left go.

    A character of which a cut leaves some bytes goes as a whole. A text without a repeat is unchanged; a null one becomes empty.
    """
    out = suffix_dedup(docs, width, carry=True)
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "kept" else f for f in out.schema])
    out = out.mapInArrow(of_batches(_decode), schema).where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(new.get(c, F.col(f"_c{i}")).cast(kind).alias(f"o{i}") for i, (c, kind) in enumerate(docs.dtypes))).toDF(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = suffix_dedup(docs)
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The digest by windows as hexadecimal text, two digits a byte.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, {2 * WIDTH}) AS x FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - {WIDTH - 1})) AS i FROM d)),
late AS (SELECT r, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY x) < doc_id),
runs AS (SELECT r, min(i) AS a, max(i) + {WIDTH} AS b FROM (
  SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (
    SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {WIDTH} THEN 1 ELSE 0 END AS new FROM late)) GROUP BY r, run),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM runs),
kept AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
