"""Numpy helpers that run inside tasks on one batch of texts: words, hashes of words and of runs of symbols.

Hashes are polynomial sums modulo 2**64 over random symbol codes, so the hash of any run of symbols is a difference of
prefix sums. A text is its UTF-8 bytes; words are runs without the bytes 20 and 09 to 0D.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes or symbols hashed at once: the working arrays stay in the processor's cache.
CHUNK = 1 << 17
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
FOLDED_CODES = BYTE_CODES.copy()
FOLDED_CODES[65:91] = BYTE_CODES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(18, int(n).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all 64 bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(codes: np.ndarray, base: int) -> np.ndarray:
    """s[i] = sum of codes[j] * base**j for j < i."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(base, len(codes))[0][: len(codes)], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of codes[start:end], the same wherever the run stands."""
    return (sums[end] - sums[start]) * powers(base, len(sums))[1][start]


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and where each begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return flat, bounds - bounds[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False, base: int = BASES[0]) -> np.ndarray:
    """One 64-bit hash per word; folded: A-Z count as a-z."""
    codes = FOLDED_CODES if folded else BYTE_CODES
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        at = starts[i]
        sums = prefix_sums(codes[data[at : ends[j - 1]]], base)
        out[i:j] = run_hash(sums, starts[i:j] - at, ends[i:j] - at, base)
        i = j
    return mix(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words of one text; with fewer words, one hash of them all; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, U64)
    for j in range(k):
        out *= U64(BASES[1])
        out += words[j : n - k + 1 + j]
    return mix(out)


def to_planes(values: np.ndarray) -> bytes:
    """Bytes of a numeric array, all first bytes before all second ones, which the shuffle compresses better."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(dtype).ravel()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(starts - shift, lengths) + np.arange(total)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the positions 0..n-1 that some [start, end) covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0
