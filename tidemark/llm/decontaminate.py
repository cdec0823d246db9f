"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact similarity to verify."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.codes import FOLDED_CODES, U64, covered, mix, prefix_sums, run_hash, text_bytes, word_bounds
from tidemark.llm.tasks import of_batches

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of 64 bits within RADIUS are all found: of BLOCKS blocks one differs in at most one bit.
RADIUS, BLOCKS = 20, 11
#: Items that one pass over the documents compares; more items take more passes.
ITEMS = 20_000

_BASE = 0x9E3779B97F4A7C15
_CODES = FOLDED_CODES.copy()
_CODES[np.frombuffer(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", np.uint8)] = 0  # at the end of a word they change nothing
_CUTS = np.linspace(0, 64, BLOCKS + 1).astype(int)


def normal_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word hashes with A-Z as a-z and without punctuation at a word's end."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 17), "right")))
        at = starts[i]
        out[i:j] = run_hash(prefix_sums(_CODES[data[at : ends[j - 1]]], _BASE), starts[i:j] - at, ends[i:j] - at, _BASE)
        i = j
    return mix(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - k + 1), U64)
    for j in range(k):
        out = out * U64(0xD1342543DE82EF95) + words[j : len(words) - k + 1 + j]
    return mix(out)


def fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of `size` shingles: a bit is set when more of them have it than not."""
    if len(hashes) < size:
        return np.zeros(0, U64)
    out = np.zeros(len(hashes) - size + 1, U64)
    for bit in range(64):
        sums = np.concatenate(([0], np.cumsum(((hashes >> U64(bit)) & U64(1)).astype(np.int32))))
        out |= (2 * (sums[size:] - sums[:-size]) > size).astype(U64) << U64(bit)
    return out


def weighted_similarity(a: np.ndarray, b: Counter) -> float:
    """Shingles in common over shingles in either, each counted as often as it stands there."""
    mine = Counter(a.tolist())
    common = sum(min(n, b[s]) for s, n in mine.items() if s in b)
    return common / (sum(mine.values()) + sum(b.values()) - common)


class Index:
    """The items by their number of words, and per block the fingerprints within one bit."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.groups: dict[int, dict] = {}
        by_size = defaultdict(list)
        for item, text in items:
            data, offsets = text_bytes(pa.array([text], pa.string()))
            starts, ends, _ = word_bounds(data, offsets)
            if len(starts):
                by_size[len(starts)].append((item, normal_words(data, starts, ends)))
        for n, group in by_size.items():
            k = min(SHINGLE, n)
            hashes = [shingles(w, k) for _, w in group]
            prints = np.array([fingerprints(h, n - k + 1)[0] for h in hashes], U64)
            tables = []
            for a, b in zip(_CUTS[:-1], _CUTS[1:], strict=True):
                part = ((prints >> U64(a)) & U64((1 << (b - a)) - 1)).astype(np.int64)
                table = np.zeros((1 << (b - a), len(group)), bool)
                for flip in [0, *(1 << i for i in range(b - a))]:
                    table[part ^ flip, np.arange(len(group))] = True
                tables.append(table)
            self.groups[n] = {"k": k, "ids": [i for i, _ in group], "counts": [Counter(h.tolist()) for h in hashes], "prints": prints, "tables": tables, "set": np.unique(np.concatenate(hashes))}
        self.by_k = {k: np.unique(np.concatenate([g["set"] for g in self.groups.values() if g["k"] == k])) for k in {g["k"] for g in self.groups.values()}}

    def matches(self, words: np.ndarray, hits: dict[int, np.ndarray]) -> dict[int | None, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of the best window of one text; hits: where shingles of any item start."""
        best: dict[int | None, tuple[float, int, int]] = {}
        for n, g in self.groups.items():
            k = g["k"]
            size = n - k + 1
            if len(words) < n or not len(hits[k]):
                continue
            own = shingles(words, k)
            at = hits[k][np.isin(own[hits[k]], g["set"])]
            if not len(at):
                continue
            near = np.flatnonzero(covered(np.maximum(at - size + 1, 0), np.minimum(at + 1, len(own) - size + 1), len(own) - size + 1) if len(own) >= size else np.zeros(0, bool))  # elsewhere nothing is shared
            for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
                prints = fingerprints(own[run[0] : run[-1] + size], size)
                candidate = np.zeros((len(run), len(g["ids"])), bool)
                for a, b, table in zip(_CUTS[:-1], _CUTS[1:], g["tables"], strict=True):
                    candidate |= table[((prints >> U64(a)) & U64((1 << (b - a)) - 1)).astype(np.int64)]
                w, i = np.nonzero(candidate)
                close = np.bitwise_count(prints[w] ^ g["prints"][i]) <= RADIUS
                for w_, i_ in zip(w[close].tolist(), i[close].tolist(), strict=True):
                    start = int(run[w_])
                    s = weighted_similarity(own[start : start + size], g["counts"][i_])
                    item = g["ids"][i_]
                    if s >= SIMILARITY and (item not in best or (-s, start) < (-best[item][0], best[item][1])):
                        best[item] = (s, start, n)
        return best


def _batch_matches(index: Index, column: pa.Array) -> list[dict]:
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    words = normal_words(data, starts, ends)
    hits = {k: np.flatnonzero(known[np.minimum(np.searchsorted(known, h := shingles(words, k)), len(known) - 1)] == h) if len(words) >= k else np.zeros(0, np.int64) for k, known in index.by_k.items()}
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        mine = {k: h[np.searchsorted(h, a) : np.searchsorted(h, max(a, b - k + 1))] - a for k, h in hits.items()}
        out.append(index.matches(words[a:b], mine) if any(map(len, mine.values())) else {})
    return out


def _find(items: list):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(d, i, *m) for d, found in zip(part.column(0).to_pylist(), _batch_matches(index, part.column(1)), strict=True) for i, m in sorted(found.items(), key=lambda x: (x[0] is None, x[0]))]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return find


def _clean(items: list, text: str):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = _batch_matches(index, part.column(part.schema.get_field_index(text)))
                yield part.filter(pa.array([not x for x in found]))

    return clean


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items, at most about ITEMS at a time, as the query set of one pass."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, ceil(items.count() / ITEMS))
    for b in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: documents with a window similar to a benchmark item, best window each.

    A window has as many words as the item; similarity is that of their multisets of 5-word shingles (fewer words: of all
    words as one) and must be 0.8 or more. A-Z count as a-z, punctuation after a word not at all, inside it as one sign. Windows that share no shingle with any
    item have similarity 0 and get no fingerprint. Null or blank texts and items match nothing; null ids are kept as they
    are; repeated rows are matched each; without items or documents there is no row.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [source.mapInArrow(of_batches(_find(items)), "doc_id long, item_id long, similarity double, start_word long, n_words long") for items in item_blocks(benchmark)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that match no benchmark item."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names)
    for items in item_blocks(benchmark):
        out = out.mapInArrow(of_batches(_clean(items, names[docs.columns.index("text")])), out.schema)
    return out.toDF(*docs.columns)
