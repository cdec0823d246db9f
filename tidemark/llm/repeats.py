"""Exact removal of long repeated runs, shared by the two substring operators; what sorts the suffixes is theirs.

A window is `width` consecutive symbols (bytes or words) of one text. Every window names one anchor in itself, the
leftmost of its runs of `anchor` symbols with the least hash, so equal windows have equal anchors and only about one
suffix in (width - anchor) / 2 has to be ordered. An anchor's context is all windows that name it, as one run.

1. Documents are dealt to batches of about BATCH_BYTES. A batch sends each different (anchor, context) once, with its first place.
2. Anchors are dealt to buckets by their leading bits. Equal contexts with an earlier first place go back to the batches that
   hold later ones; that settles copies of any number. An anchor seen once is done. Contexts that share an anchor but differ are asked for.
3. Only their first holders send the symbols of these contexts; the operator's own sorter orders the windows' suffixes in
   each bucket and returns windows that stand earlier elsewhere. An anchor with more than `crowd` contexts would not fit in
   one group: its windows are sent by the hash of all their symbols instead, each once per batch.
4. Each batch removes what is covered.

A key of any number of rows thus sends one row per batch, no group grows with the number of documents that share a run, and
no pair of documents is ever formed. The batch of text is shuffled once; the four steps read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.codes import BASES, BYTE_CODES, CHUNK, U64, covered, from_planes, mix, powers, prefix_sums, ranges, run_hash, text_bytes, to_planes, word_bounds, word_hashes
from tidemark.llm.tasks import of_group, of_groups

BATCH_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
LAST = np.iinfo(np.int64).max
_IDX = U64((1 << 18) - 1)
#: Contexts are told apart by 56 bits next to the anchor's own: 7 bytes each in the shuffle.
_CTX = U64((1 << 56) - 1)

_SENT = "bucket long, batch long, kind int, key binary, ctx binary, doc binary, pos binary, syms binary, lens binary, offs binary"
_REPLY = "batch long, kind int, key binary, ctx binary, doc binary, pos binary, lens binary"
_SENT_ARROW = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32())] + [(c, pa.binary()) for c in ("key", "ctx", "doc", "pos", "syms", "lens", "offs")])
_REPLY_ARROW = pa.schema([("batch", pa.int64()), ("kind", pa.int32())] + [(c, pa.binary()) for c in ("key", "ctx", "doc", "pos", "lens")])
SAME, ASK, CROWDED, WINDOW, SPAN = range(5)


@dataclass(frozen=True)
class Rule:
    """What counts as a repeat. within: an earlier start in the same document counts too (else only a smaller doc_id)."""

    width: int
    anchor: int
    words: bool
    within: bool
    crowd: int
    #: (symbols, lengths, doc, pos of each context's first window) -> (context, first window, past the last window) of windows that stand earlier elsewhere
    sorter: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


class Batch:
    """The documents of one batch in a fixed order, their symbols and anchors."""

    def __init__(self, table: pa.Table, rule: Rule):
        if table.num_rows:
            order = sorted(range(table.num_rows), key=list(zip(table["_null"].to_pylist(), table["_id"].to_pylist(), table["_digest"].to_pylist(), strict=True)).__getitem__)
            table = table.take(order)
        self.table, self.rule = table, rule
        ids = table["_id"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
        self.ids = ids
        self.data, self.offsets = text_bytes(table["_text"])
        if rule.words:
            self.starts, self.ends, self.bounds = word_bounds(self.data, self.offsets)
            self.symbols = word_hashes(self.data, self.starts, self.ends)
        else:
            self.bounds, self.symbols = self.offsets, self.data

    def codes(self, a: int, b: int) -> np.ndarray:
        return self.symbols[a:b] if self.rule.words else BYTE_CODES[self.symbols[a:b]]

    def anchors(self) -> dict[str, np.ndarray]:
        """key, ctx, row, doc, pos, lo, hi: windows lo..hi (flat places of their first symbols) name the anchor."""
        rule, w = self.rule, self.rule.width
        got: list[tuple[np.ndarray, ...]] = []
        total, span = int(self.bounds[-1]), w - rule.anchor + 1
        for c in range(0, total, CHUNK):
            d0, d1 = np.searchsorted(self.bounds, c, "right") - 1, np.searchsorted(self.bounds, min(total, c + CHUNK), "left")
            first = np.maximum(self.bounds[d0:d1], c)
            n = np.minimum(self.bounds[d0 + 1 : d1 + 1] - w + 1, c + CHUNK) - first
            has = n > 0
            if not has.any():
                continue
            rows = np.repeat(np.arange(d0, d1)[has], n[has])
            at = ranges(first[has] - c, n[has])
            codes = self.codes(c, min(total, c + CHUNK + w - 1))
            sums = prefix_sums(codes, BASES[0])
            m = len(codes) - rule.anchor + 1
            hashes = (sums[rule.anchor :] - sums[: m]) * powers(BASES[0], m)[1][:m]
            least = (hashes & ~_IDX) | np.arange(m, dtype=U64)
            step = 1
            while step * 2 <= span:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            if span > step:
                least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
            mine = (least[at] & _IDX).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1) | (rows[1:] != rows[:-1]))))
            lo, hi, p, row = at[new], at[np.concatenate((new[1:] - 1, [len(at) - 1]))], mine[new], rows[new]
            other = prefix_sums(codes, BASES[1])
            ctx = run_hash(other, lo, hi + w, BASES[1]) + (hi - lo).astype(U64) * U64(0xA0761D6478BD642F) + (p - lo).astype(U64) * U64(0xE7037ED1A0B428DB)
            got.append((mix(hashes[p]), mix(ctx) & _CTX, row, p + c, lo + c, hi + c))
        key, ctx, row, p, lo, hi = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(4)))
        row = row.astype(np.int64)
        return {"key": key, "ctx": ctx, "row": row, "doc": self.ids[row], "pos": (p - self.bounds[row]) if rule.within else np.zeros(len(p), np.int64), "lo": lo, "hi": hi}


def _dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key, by its leading bits, and the bits that tell keys of a bucket apart."""
    return ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.uint32)


def _first(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, ctx, doc, pos), and flags of each (key, ctx)'s first place in that order."""
    order = np.lexsort((pos, doc, ctx, key))
    k, c = key[order], ctx[order]
    return order, np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))) if len(order) else np.zeros(0, bool)


def _cut(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    if len(sorted_values):
        new = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
        for a, b in zip(new, [*new[1:], len(sorted_values)], strict=True):
            yield int(sorted_values[a]), int(a), int(b)


def _gather(table: pa.Table, *columns: tuple[str, type]) -> list[np.ndarray]:
    """The named packed columns of all rows, one after the other."""
    return [np.concatenate([from_planes(x, kind) for x in table[name].to_pylist()] or [np.zeros(0, kind)]) for name, kind in columns]


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _hashed(batch: Batch, lo: np.ndarray, hi: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two hashes, doc, pos and place of each window of these contexts."""
    w = batch.rule.width
    n = hi - lo + 1
    at, owner = ranges(lo, n), np.repeat(row, n)
    one, two = np.zeros(len(at), U64), np.zeros(len(at), U64)
    for j in range(w):
        codes = batch.symbols[at + j] if batch.rule.words else BYTE_CODES[batch.symbols[at + j]]
        one, two = one * U64(BASES[0]) + codes, (two ^ codes) * U64(BASES[1])
        two ^= two >> U64(29)
    pos = at - batch.bounds[owner] if batch.rule.within else np.zeros(len(at), np.int64)
    return mix(one), mix(two), batch.ids[owner], pos, at


def _later(d: np.ndarray, p: np.ndarray, d0: np.ndarray, p0: np.ndarray) -> np.ndarray:
    return (d > d0) | (d == d0) & (p > p0)


def _least(key, ctx, doc, pos, k1, c1, d1, p1) -> tuple[np.ndarray, np.ndarray]:
    """First place of each own (key, ctx) among the own places and the told ones."""
    ids = np.concatenate((key, k1)), np.concatenate((ctx, c1))
    d, p = np.concatenate((doc, d1)), np.concatenate((pos, p1))
    order, first = _first(*ids, d, p)
    at = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else np.zeros(0, np.int64)
    best_d, best_p = np.empty_like(d), np.empty_like(p)
    best_d[order], best_p[order] = d[order][at], p[order][at]
    return best_d[: len(key)], best_p[: len(key)]


def _packed(bucket: int, batch: int, kind: int, **arrays) -> dict:
    return {"bucket": bucket, "batch": batch, "kind": kind} | {k: to_planes(v) for k, v in arrays.items()}


def _send_anchors(rule: Rule, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        x, at = Batch(table, rule).anchors(), table["_batch"][0].as_py()
        bucket, key = _dealt(x["key"], buckets)
        order, first = _first(x["key"], x["ctx"], x["doc"], x["pos"])
        keep = order[first]
        bucket, key = bucket[keep], key[keep]  # ordered by key, thus by bucket
        rows = []
        for b, i, j in _cut(bucket):
            s = keep[i:j]
            rows.append(_packed(b, at, SAME, key=key[i:j], ctx=x["ctx"][s], doc=x["doc"][s], pos=x["pos"][s].astype(np.int32) if rule.within and int(x["pos"][s].max()) < 1 << 31 else x["pos"][s] if rule.within else np.zeros(0, np.int64)))
        return _table(rows, _SENT_ARROW)

    return send


def _places(table: pa.Table, n: list[int]) -> np.ndarray:
    """pos of all rows, stored as 4 or 8 bytes each or left out."""
    out = [np.zeros(k, np.int64) if not x else from_planes(x, np.int32 if len(x) == 4 * k else np.int64).astype(np.int64) for x, k in zip(table["pos"].to_pylist(), n, strict=True)]
    return np.concatenate(out or [np.zeros(0, np.int64)])


def _compare_anchors(rule: Rule):
    def compare(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        n = [len(x) // 4 for x in table["key"].to_pylist()]
        key, ctx, doc = _gather(table, ("key", np.uint32), ("ctx", U64), ("doc", np.int64))
        pos, batch = _places(table, n), np.repeat(table["batch"].to_numpy(), n)
        order = np.argsort(key)
        k = key[order]
        same = np.concatenate(([False], k[1:] == k[:-1]))
        again = order[same | np.concatenate((same[1:], [False]))]
        key, ctx, doc, pos, batch = key[again], ctx[again], doc[again], pos[again], batch[again]
        order, first = _first(key, ctx, doc, pos)
        key, ctx, doc, pos, batch = key[order], ctx[order], doc[order], pos[order], batch[order]
        lead = np.flatnonzero(first)
        d0, p0 = doc[lead][np.cumsum(first) - 1], pos[lead][np.cumsum(first) - 1]
        kind = np.full(len(key), SAME)
        new_key = np.concatenate(([True], key[lead][1:] != key[lead][:-1])) if len(lead) else np.zeros(0, bool)
        group = np.cumsum(new_key) - 1
        contexts = np.bincount(group) if len(lead) else np.zeros(0, np.int64)
        ask = contexts[group] > 1
        if len(lead) and not rule.within:  # a run repeated in one document alone is none
            low, high = np.minimum.reduceat(doc[lead], np.flatnonzero(new_key)), np.maximum.reduceat(doc[lead], np.flatnonzero(new_key))
            ask &= (low != high)[group]
        # Rows that share an id may be dealt to several batches; each of them holds a first place.
        late, of = _later(doc, pos, d0, p0), np.cumsum(first) - 1
        kind[~late] = np.where(contexts[group] > rule.crowd, CROWDED, ASK)[of[~late]]
        send = np.flatnonzero(late | ask[of]) if len(lead) else np.flatnonzero(late)
        send = send[np.lexsort((kind[send], batch[send]))]
        rows = []
        for b, i, j in _cut(batch[send] * 8 + kind[send]):
            s = send[i:j]
            rows.append({"batch": b // 8, "kind": b % 8, "lens": to_planes(np.array([bucket])), "key": to_planes(key[s]), "ctx": to_planes(ctx[s]), "doc": to_planes(d0[s]), "pos": to_planes(p0[s])})
        return _table(rows, _REPLY_ARROW)

    return compare


def _told(table: pa.Table, kind: int, wide: type = np.uint32) -> tuple[np.ndarray, ...]:
    """bucket-qualified key, ctx, doc, pos of the replies of a kind."""
    part = table.filter(pc.equal(table["kind"], kind))
    key, ctx, doc, pos = _gather(part, ("key", wide), ("ctx", U64), ("doc", np.int64), ("pos", np.int64))
    if wide is np.uint32:
        size = [len(x) // 4 for x in part["key"].to_pylist()]
        bucket = np.concatenate([from_planes(x, np.int64) for x in part["lens"].to_pylist()] or [np.zeros(0, np.int64)])
        key = np.repeat(bucket.astype(U64), size) << U64(32) | key.astype(U64)
    return key.astype(U64), ctx, doc, pos


def _qualified(key: np.ndarray, buckets: int) -> np.ndarray:
    bucket, low = _dealt(key, buckets)
    return bucket.astype(U64) << U64(32) | low.astype(U64)


def _asked(x: dict, key: np.ndarray, told: tuple[np.ndarray, ...]) -> np.ndarray:
    """Own contexts, first places alone, that stand among the told ones."""
    order, first = _first(key, x["ctx"], x["doc"], x["pos"])
    mine = order[first]
    if not len(told[0]) or not len(mine):
        return mine[:0]
    left = np.rec.fromarrays((told[0], told[1]))
    mark = np.zeros(len(mine) + len(left), bool)
    both = np.lexsort((np.concatenate((np.ones(len(left)), np.zeros(len(mine)))), np.concatenate((told[1], x["ctx"][mine])), np.concatenate((told[0], key[mine]))))
    k, c = np.concatenate((told[0], key[mine]))[both], np.concatenate((told[1], x["ctx"][mine]))[both]
    equal = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    mark[both[:-1][equal]] = True
    return mine[mark[len(left) :]]


def _send_contexts(rule: Rule, buckets: int):
    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows or not pc.any(pc.is_in(replies["kind"], pa.array([ASK, CROWDED], pa.int32()))).as_py():
            return _table([], _SENT_ARROW)
        batch, at = Batch(table, rule), table["_batch"][0].as_py()
        x = batch.anchors()
        key, rows = _qualified(x["key"], buckets), []
        s = _asked(x, key, _told(replies, ASK))
        s = s[np.argsort(key[s], kind="stable")]
        for b, i, j in _cut((key[s] >> U64(32)).astype(np.int64)):
            t = s[i:j]
            n = x["hi"][t] - x["lo"][t] + rule.width
            start = x["lo"][t] - batch.bounds[x["row"][t]]
            syms = batch.symbols[ranges(x["lo"][t], n)]
            rows.append({"bucket": b, "batch": at, "kind": ASK, "key": to_planes((key[t] & U64(0xFFFFFFFF)).astype(np.uint32)), "doc": to_planes(x["doc"][t]), "pos": to_planes(start), "syms": syms.tobytes(), "lens": to_planes(n), "offs": to_planes(x["row"][t])})
        s = _asked(x, key, _told(replies, CROWDED))
        one, two, doc, pos, _ = _hashed(batch, x["lo"][s], x["hi"][s], x["row"][s])
        order, first = _first(one, two, doc, pos)
        keep = order[first]
        for b, i, j in _cut(_dealt(one[keep], buckets)[0]):
            t = keep[i:j]
            rows.append(_packed(b, at, WINDOW, key=one[t], ctx=two[t], doc=doc[t], pos=pos[t]))
        return _table(rows, _SENT_ARROW)

    return send


def _compare_contexts(rule: Rule):
    kind_of = U64 if rule.words else np.uint8

    def compare(table: pa.Table) -> pa.Table:
        rows = []
        part = table.filter(pc.equal(table["kind"], ASK))
        if part.num_rows:
            key, doc, pos, lens, row = _gather(part, ("key", np.uint32), ("doc", np.int64), ("pos", np.int64), ("lens", np.int64), ("offs", np.int64))
            syms = np.concatenate([np.frombuffer(s, kind_of) for s in part["syms"].to_pylist()])
            batch = np.repeat(part["batch"].to_numpy(), [len(x) // 4 for x in part["key"].to_pylist()])
            starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
            order = np.argsort(key, kind="stable")
            todo, group = [], []
            for _, i, j in _cut(key[order]):  # whole anchors together, a bounded number of symbols at a time
                group.append(order[i:j])
                if sum(map(len, group)) > 20_000:
                    todo.append(np.concatenate(group))
                    group = []
            for t in [*todo, *([np.concatenate(group)] if group else [])]:
                c, a, b = rule.sorter(key[t], syms[ranges(starts[t], lens[t])], lens[t], doc[t], pos[t] if rule.within else np.zeros(len(t), np.int64), rule.width)
                t, a, b = t[c], a + pos[t[c]], b + pos[t[c]]
                t, a, b = (v[np.argsort(batch[t], kind="stable")] for v in (t, a, b))
                for at, i, j in _cut(batch[t]):
                    rows.append({"batch": at, "kind": SPAN, "key": to_planes(row[t[i:j]]), "pos": to_planes(a[i:j]), "lens": to_planes(b[i:j])})
        part = table.filter(pc.equal(table["kind"], WINDOW))
        if part.num_rows:
            key, ctx, doc, pos = _gather(part, ("key", U64), ("ctx", U64), ("doc", np.int64), ("pos", np.int64))
            batch = np.repeat(part["batch"].to_numpy(), [len(x) // 8 for x in part["key"].to_pylist()])
            order, first = _first(key, ctx, doc, pos)
            lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
            s, lead = order[~first], lead[~first]
            by = np.argsort(batch[s], kind="stable")
            s, lead = s[by], lead[by]
            for at, i, j in _cut(batch[s]):
                rows.append({"batch": at, "kind": WINDOW, "key": to_planes(key[s[i:j]]), "ctx": to_planes(ctx[s[i:j]]), "doc": to_planes(doc[lead[i:j]]), "pos": to_planes(pos[lead[i:j]])})
        return _table(rows, _REPLY_ARROW)

    return compare


def _twins(x: dict, key: np.ndarray, late: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lead, twin): other places, not later themselves, that have the key and context of these leads (one a context)."""
    open_ = np.flatnonzero(~late)
    at = open_[np.isin(key[open_], key[leads])]
    at = at[np.lexsort((x["ctx"][at], key[at]))]
    k, c = key[at], x["ctx"][at]
    group = np.cumsum(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))) - 1 if len(at) else at
    size, number = np.bincount(group, minlength=1), np.full(len(key), -1)
    number[at] = group
    lead = np.full(len(size), -1)
    lead[number[leads]] = leads
    one = lead[group]
    other = (one >= 0) & (one != at)
    return one[other], at[other]


def _removed(batch: Batch, replies: pa.Table, buckets: int) -> np.ndarray:
    """Flags of the batch's symbols that repeats cover."""
    rule, x, total = batch.rule, batch.anchors(), int(batch.bounds[-1])
    key = _qualified(x["key"], buckets)
    d0, p0 = _least(key, x["ctx"], x["doc"], x["pos"], *_told(replies, SAME))
    late = _later(x["doc"], x["pos"], d0, p0)
    row, a, b = _gather(replies.filter(pc.equal(replies["kind"], SPAN)), ("key", np.int64), ("pos", np.int64), ("lens", np.int64))
    a, b = a + batch.bounds[row], b + batch.bounds[row]
    # Flags of the windows that stand earlier: those of a context settled by its hash, those that the sorter found.
    window = covered(np.concatenate((x["lo"][late], a)), np.concatenate((x["hi"][late] + 1, b)), total)
    leads = np.searchsorted(x["lo"], a, "right") - 1
    s = _asked(x, key, _told(replies, CROWDED))
    if len(s):
        one, two, doc, pos, at = _hashed(batch, x["lo"][s], x["hi"][s], x["row"][s])
        window[at[_later(doc, pos, *_least(one, two, doc, pos, *_told(replies, WINDOW, U64)))]] = True
        leads = np.concatenate((leads, s))
    if len(leads):
        # Only one place of a context was compared; its document may hold the context again, with the same windows.
        lead, twin = _twins(x, key, late, np.unique(leads))
        for j in range(int((x["hi"] - x["lo"])[twin].max(initial=-1)) + 1):
            has = x["lo"][twin] + j <= x["hi"][twin]
            window[x["lo"][twin[has]] + j] |= window[x["lo"][lead[has]] + j]
    first, last = window.copy(), window.copy()
    first[1:] &= ~window[:-1]
    last[:-1] &= ~window[1:]
    return covered(np.flatnonzero(first), np.flatnonzero(last) + rule.width, total)


def _kept_bytes(batch: Batch, keep: np.ndarray) -> pa.Array:
    n = np.add.reduceat(np.concatenate((keep, [False])), batch.offsets[:-1], dtype=np.int64) * (np.diff(batch.offsets) > 0) if len(keep) else np.zeros(len(batch.ids), np.int64)
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(batch.ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(batch.data[keep].tobytes())])


def _kept_words(batch: Batch, keep: np.ndarray) -> pa.Array:
    """Kept words of each text, joined by one space."""
    n = np.concatenate((batch.ends - batch.starts, [])).astype(np.int64)[keep] + 1
    flat = np.concatenate((batch.data, np.zeros(1, np.uint8)))[ranges(batch.starts[keep], n)]
    ends = np.cumsum(n)
    flat[ends - 1] = 32
    words = np.concatenate(([0], np.cumsum(keep)))[batch.bounds]
    size = np.concatenate(([0], ends))[words]
    last = size[1:][words[1:] > words[:-1]] - 1
    drop = np.ones(len(flat), bool)
    drop[last] = False
    offsets = size - np.concatenate(([0], np.cumsum(words[1:] > words[:-1])))
    return pa.Array.from_buffers(pa.large_binary(), len(batch.ids), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat[drop].tobytes())])


def _spans(batch: Batch, gone: np.ndarray) -> pa.Array:
    """Maximal removed runs of each text, in symbols."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[batch.bounds] = True
    before, after = np.concatenate(([False], gone[:-1])), np.concatenate((gone[1:], [False]))
    start, end = np.flatnonzero(gone & (~before | edge[:-1])), np.flatnonzero(gone & (~after | edge[1:]))
    row = np.searchsorted(batch.bounds, start, "right") - 1
    at = np.searchsorted(start, batch.bounds)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(start - batch.bounds[row]), pa.array(end + 1 - batch.bounds[row])], fields=list(kind)))


def _clean(rule: Rule, buckets: int, carried: list[str]):
    def clean(table: pa.Table, replies: pa.Table) -> pa.Table:
        batch = Batch(table, rule)
        gone = _removed(batch, replies, buckets) if batch.table.num_rows else np.zeros(0, bool)
        sums = np.concatenate(([0], np.cumsum(gone)))[batch.bounds]
        kept = _kept_words(batch, ~gone) if rule.words else _kept_bytes(batch, ~gone)
        new = [pa.array(np.diff(batch.bounds)), pa.array(np.diff(sums)), _spans(batch, gone), kept.cast(pa.binary())]
        return pa.Table.from_arrays([*(batch.table[c] for c in carried), *new], names=[*carried, "_n", "_removed", "_spans", "_kept"])

    return clean


def without_repeats(docs: DataFrame, rule: Rule, carry: bool = False, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_symbols, n_removed, spans (maximal removed runs, in symbols), kept (binary).

    carry: all other columns of docs follow under `_c0`, `_c1`, ... in their order. A null text is empty; a null id counts
    as larger than every other; rows that share an id are one document that has several texts; an empty table stays empty.
    """
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text).cast("string")))).first()
    total = max(1, size[1] or 0)
    batches, buckets = max(1, ceil(total / BATCH_BYTES)), max(1, ceil(total / BUCKET_BYTES))
    names = [f"_c{i}" for i in range(len(docs.columns))] if carry else []
    source = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at, words = docs.columns.index(id_column), docs.columns.index(text)
    body = F.col(f"_c{words}").cast("string")
    source = source.select(*(c for c in names if c != f"_c{words}"), F.coalesce(F.col(f"_c{at}").cast("long"), F.lit(LAST)).alias("_id"), F.col(f"_c{at}").isNull().alias("_null"), body.alias("_text"), F.xxhash64(body).alias("_digest"))
    source = source.withColumn("_batch", F.pmod(F.xxhash64("_id", "_digest"), F.lit(batches)))
    by_batch = source.groupBy("_batch")
    sent = by_batch.applyInArrow(of_group(_send_anchors(rule, buckets)), _SENT)
    first = sent.groupBy("bucket").applyInArrow(of_group(_compare_anchors(rule)), _REPLY)
    asked = by_batch.cogroup(first.groupBy("batch")).applyInArrow(of_groups(_send_contexts(rule, buckets)), _SENT)
    second = asked.groupBy("bucket").applyInArrow(of_group(_compare_contexts(rule)), _REPLY)
    carried = ["_id", "_null", *(c for c in names if c != f"_c{words}")]
    kinds = dict(source.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", _n long, _removed long, _spans array<struct<start:long,end:long>>, _kept binary"
    out = by_batch.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(of_groups(_clean(rule, buckets, carried)), schema)
    return out.select(F.when(~F.col("_null"), F.col("_id")).alias(id_column), F.col("_n").alias("n_symbols"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("spans"), F.col("_kept").alias("kept"), *(c for c in names if c != f"_c{words}"))
