"""Periodic runs of words: window minima at several scales seed them, scans at each short lag find the short periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.codes import BASES, U64, covered, mix, prefix_sums, run_hash, text_bytes, word_bounds, word_hashes
from tidemark.llm.tasks import of_batches

#: A run has at least LEAST words and TIMES times its period.
LEAST, TIMES = 6, 4
#: Periods below this are found by comparing words at that distance; a scale w covers the periods from w to below 3/2 w.
DIRECT = 16
#: Words examined together, whole texts at a time: the arrays of one scale stay in the processor's cache.
CHUNK = 1 << 15
ROWS = 256

_RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
_Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def least_length(period):
    return np.maximum(LEAST, TIMES * period)


def lag_scan(codes: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest stretches whose words equal those `lag` further on, if long enough for a run."""
    bounds = np.concatenate(([-1], np.flatnonzero(codes[lag:] != codes[:-lag]), [max(len(codes) - lag, 0)]))
    long = np.flatnonzero(np.diff(bounds) - 1 >= least_length(lag) - lag)
    return bounds[long] + 1, bounds[long + 1] + lag


def window_minima(x: np.ndarray, m: int) -> np.ndarray:
    """min(x[j : j + m]) for every j."""
    padded = np.full(-(-len(x) // m) * m, ~U64(0))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, m)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    n = len(x) - m + 1
    return np.minimum(left[:n], right[m - 1 : m - 1 + n])


def minimizers(x: np.ndarray, m: int) -> np.ndarray:
    """Places i with x[i] = min(x[j : j + m]) for some j <= i < j + m; ties all count."""
    edge = np.full(m - 1, ~U64(0))
    best = ~window_minima(np.concatenate((edge, ~window_minima(x, m), edge)), m)
    return np.flatnonzero(best == x)


def seeds(sums: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of equal minimizers w <= lag < 3/2 w apart, each with the first one at least w further on.

    x are the hashes of runs of w words, the windows hold 3/2 w of them. In a run of period q in [w, 3/2 w) every window
    holds a whole period, so its minima are all occurrences of one string u of w words. The follower of an occurrence is q
    away unless another occurrence lies at most q - w < w / 2 before that; if this held for all, the distances of
    neighbouring occurrences would be periods of u, any two with a sum of at most w, and their greatest common divisor
    a period of the run, against q being the smallest. So every run gets a seed.
    """
    last, m = w + w // 2, w + w // 2
    n = len(sums) - w
    if n < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    x = run_hash(sums, at, at + w, BASES[0])
    place = minimizers(x, m)
    order = np.argsort(x[place], kind="stable")
    place = place[order]
    value = x[place]
    group = np.cumsum(np.concatenate(([True], value[1:] != value[:-1])))
    key = group * (n + last) + place
    follower = np.minimum(np.searchsorted(key, key + w), len(key) - 1)
    lag = place[follower] - place
    found = (group[follower] == group) & (lag >= w) & (lag < last)
    return place[found], lag[found]


def _reach(sums: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, forward: bool) -> np.ndarray:
    """How many words the strings from a and b (up to a and b) have in common, at most `limit`."""
    low, high = np.zeros(len(a), np.int64), limit.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        if forward:
            same = run_hash(sums, a, a + mid, BASES[0]) == run_hash(sums, b, b + mid, BASES[0])
        else:
            same = run_hash(sums, a - mid, a, BASES[0]) == run_hash(sums, b - mid, b, BASES[0])
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def extended(codes: np.ndarray, sums: np.ndarray, place: np.ndarray, lag: np.ndarray) -> _Found:
    """(start, end, lag) of the stretches around the seeds that keep the lag, long enough for a run."""
    start = place - _reach(sums, place, place + lag, place, False)
    end = place + lag + _reach(sums, place, place + lag, len(codes) - place - lag, True)
    long = end - start >= least_length(lag)
    return start[long], end[long], lag[long]


def _prime_factors(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + [q] if q > 1 else out


def smallest_period(sums: np.ndarray, start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Flags of stretches without a period that divides the lag; a smaller period of a run always does."""
    keep = np.ones(len(lag), bool)
    for q in np.unique(lag):
        rows = np.flatnonzero(lag == q)
        for r in _prime_factors(int(q)):
            g = int(q) // r
            keep[rows] &= run_hash(sums, start[rows], end[rows] - g, BASES[0]) != run_hash(sums, start[rows] + g, end[rows], BASES[0])
    return keep


def find_runs(codes: np.ndarray, longest: int) -> _Found:
    """start, length, period of every run in codes, whose texts have at most `longest` words each, by start, then period.

    Texts are told apart by a code that occurs once between them, which no run can hold.
    """
    sums = prefix_sums(codes, BASES[0])
    parts: list[_Found] = []
    for q in range(1, min(DIRECT, longest // TIMES + 1)):
        start, end = lag_scan(codes, q)
        parts.append((start, end, np.full(len(start), q)))
    w = DIRECT
    while w * TIMES <= longest:
        place, lag = seeds(sums, w)
        if len(place):
            parts.append(extended(codes, sums, place, lag))
        w += w // 2
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    found = np.unique(np.stack([np.concatenate(x) for x in zip(*parts, strict=True)], axis=1), axis=0)
    # Equal hashes are checked on the words; the lag of a stretch that fails is scanned word by word.
    exact = np.array([np.array_equal(codes[s : e - q], codes[s + q : e]) for s, e, q in found], bool)
    if not exact.all():
        again = [np.stack([*stretch, np.full(len(stretch[0]), q)], axis=1) for q in np.unique(found[~exact, 2]) for stretch in [lag_scan(codes, int(q))]]
        found = np.unique(np.concatenate([found[exact], *again]), axis=0)
    start, end, period = found.T
    keep = smallest_period(sums, start, end, period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def planted(h: int, n: int) -> np.ndarray:
    """Which word of the text each word becomes: from word a on, the p words there over and over."""
    i, g = np.arange(n), h // 10
    if h % 10 or not n:
        return i
    a = g % n
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def runs_of_texts(data: np.ndarray, offsets: np.ndarray, marks: list) -> tuple[list[_Found], list[bytes]]:
    """The runs of each text, and its words outside of their repetitions, joined by one space."""
    starts, ends, first = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    size = np.diff(first)
    source = [None if h is None or h % 10 else planted(h, int(n)) for h, n in zip(marks, size, strict=True)]
    codes = [hashes[a:b] if s is None else hashes[a:b][s] for a, b, s in zip(first[:-1], first[1:], source, strict=True)]
    none = (np.zeros(0, np.int64),) * 3
    found: list[_Found] = [none] * len(size)
    todo = np.flatnonzero(size >= LEAST)
    todo = todo[np.argsort(size[todo], kind="stable")]
    i = 0
    while i < len(todo):
        j, total = i, 0
        while j < len(todo) and (j == i or total + size[todo[j]] <= CHUNK):
            total += int(size[todo[j]]) + 1
            j += 1
        group = todo[i:j]
        edges = mix(np.arange(1, len(group) + 1).astype(U64) << U64(40))
        joined = np.concatenate([x for k, t in enumerate(group) for x in (codes[t], edges[k : k + 1])])
        begin = np.concatenate(([0], np.cumsum(size[group] + 1)))
        s, length, q = find_runs(joined, int(size[group[-1]]))
        cut = np.searchsorted(s, begin)
        for k, t in enumerate(group):
            if cut[k] < cut[k + 1]:
                at = slice(cut[k], cut[k + 1])
                found[t] = (s[at] - begin[k], length[at], q[at])
        i = j
    raw = data.tobytes()
    kept = []
    for t, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        words = raw[a:b].split()
        if len(found[t][0]):
            s, length, q = found[t]
            keep = np.flatnonzero(~covered(s + q, s + length, len(words)))
            words = [words[w] for w in (keep if source[t] is None else source[t][keep])]
        elif source[t] is not None:
            words = [words[w] for w in source[t]]
        kept.append(b" ".join(words))
    return found, kept


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = part.column(part.schema.get_field_index("_text"))
            data, offsets = text_bytes(texts)
            found, kept = runs_of_texts(data, offsets, part.column(part.schema.get_field_index("_mark")).to_pylist())
            first = np.concatenate(([0], np.cumsum([len(f[0]) for f in found])))
            fields = [pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)) for k in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"])).cast(kind)
            keep = [c for c in part.schema.names if c not in ("_text", "_mark")]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), runs, pa.array(kept, pa.binary())], [*keep, "runs", "kept"])


def periodic_runs(docs: DataFrame, text: str = "text", mark: Column | None = None) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), kept (binary) of each text.

    Words are runs without the characters 20 and 09 to 0D. A run is a stretch of words that its neighbours do not extend,
    with smallest period q and at least max(6, 4 q) words. kept are the words that are in no run, or only among the first
    q words of their runs, joined by one space. Rows are judged each on its own, whatever their doc_id; a null, empty or
    blank text has no words; an empty table gives no row; other columns are ignored. One text is examined in one
    task, in time n log n; nothing is shuffled.

    mark: a number per row, or null; if it divides by 10, a run is planted first (see `planted`).
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"), (F.lit(None).cast("long") if mark is None else mark.cast("long")).alias("_mark"))
    schema = T.StructType([source.schema["doc_id"], *T._parse_datatype_string(f"runs {_RUN}, kept binary").fields])
    return source.mapInArrow(of_batches(_scan), schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first of equal ones; null without runs."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the kept words; runs are planted by crc32 of doc_id."""
    found = periodic_runs(docs, mark=F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")))
    best = found.withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
