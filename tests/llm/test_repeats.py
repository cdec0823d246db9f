"""Both substring operators against brute force over every window."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import repeats, substring, suffix_array

NEVER = 1 << 62


def bytes_by_hand(rows, width=50):
    first = {}
    for d, x in rows:
        b = (x or "").encode()
        for s in range(len(b) - width + 1):
            first[b[s : s + width]] = min(d, first.get(b[s : s + width], d))
    out = []
    for d, x in rows:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < d:
                gone[s : s + width] = b"\1" * width
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def words_by_hand(rows, width=20):
    first = {}
    split = [(d, (x or "").encode().split()) for d, x in rows]
    for d, w in split:
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            first[key] = min((d, s), first.get(key, (d, s)))
    out = []
    for d, w in split:
        gone = bytearray(len(w))
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (d, s):
                gone[s : s + width] = b"\1" * width
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def pairs(df):
    return [(NEVER if r.doc_id is None else r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def got_bytes(df):
    return sorted((NEVER if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.digest(df).collect())


def got_words(df):
    return sorted((NEVER if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(df).collect())


def test_bytes_match_brute_force(documents):
    assert got_bytes(documents) == bytes_by_hand(pairs(documents))


def test_words_match_brute_force(documents):
    assert got_words(documents) == words_by_hand(pairs(documents))


@pytest.fixture()
def tangled(spark):
    """Few symbols, so that anchors repeat in many contexts, and one passage in very many documents."""
    rng = random.Random(5)
    passage = " ".join(rng.choice(["red", "blue", "green", "tea"]) for _ in range(28))
    rows = []
    for i in range(240):
        words = [rng.choice(["red", "blue", "green", "tea"]) for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(words))
        rows.append((i, " ".join([*words[:at], *(passage.split()[rng.randint(0, 4) :] if i % 3 else []), *words[at:]])))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("crowd", [1, 3, 4096])
def test_crowded_anchors_and_many_batches(tangled, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 9_000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 15_000)
    for module in (suffix_array, substring):
        monkeypatch.setattr(module, "RULE", repeats.Rule(**{**vars(module.RULE), "crowd": crowd}))
    assert got_bytes(tangled) == bytes_by_hand(pairs(tangled))
    assert got_words(tangled) == words_by_hand(pairs(tangled))


@pytest.mark.parametrize("crowd", [1, 4096])
def test_context_repeated_in_its_own_document(spark, monkeypatch, crowd):
    """A line that a document holds many times, partly in an earlier document with other text around it, goes everywhere."""
    rng = random.Random(11)
    line = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(10, 99)}" for _ in range(n))
    lines = [line(24) for _ in range(30)]
    rows = []
    for i in range(120):
        some = rng.choices(lines, k=rng.randint(1, 4))
        text = "\n".join(x for part in some for x in [part] * rng.randint(1, 4) + [line(3)] * rng.randint(0, 2))
        rows.append((i if i % 10 else i // 20, text[rng.randint(0, 70) :]))
    df = spark.createDataFrame([(1, "-" + lines[0]), (3, "\n".join([lines[0]] * 4)), *[(i + 5, t) for i, t in rows]], "doc_id long, text string")
    monkeypatch.setattr(suffix_array, "RULE", repeats.Rule(**{**vars(suffix_array.RULE), "crowd": crowd}))
    assert got_bytes(df.where("doc_id < 5")) == bytes_by_hand(pairs(df.where("doc_id < 5")))
    monkeypatch.setattr(repeats, "BATCH_BYTES", 4_000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 9_000)
    assert got_bytes(df) == bytes_by_hand(pairs(df))


def test_odd_rows(odd):
    assert got_bytes(odd) == bytes_by_hand(pairs(odd))
    got, hand = got_words(odd.where("doc_id <> 6 and doc_id <> 5 or doc_id is null")), words_by_hand(pairs(odd.where("doc_id <> 6 and doc_id <> 5 or doc_id is null")))
    assert got == hand


def test_empty(none):
    assert got_bytes(none) == [] and got_words(none) == []
    assert suffix_array.without_passages(none).columns == none.columns


def test_without_passages(odd, spark):
    out = suffix_array.without_passages(odd)
    assert out.columns == odd.columns and [t for _, t in out.dtypes] == [t for _, t in odd.dtypes]
    kept = {r.doc_id: r.text for r in out.where("doc_id in (4, 5, 7, 8)").collect()}
    assert set(kept) == {4, 7, 8} and kept[7] == "é" * 120 + " ü" and kept[8] == "x"


def test_spans_are_maximal_runs(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghij") for _ in range(300))
    df = spark.createDataFrame([(1, a), (2, "ZZ" + a[20:100] + "YY" + a[150:260])], "doc_id long, text string")
    r = suffix_array.suffix_dedup(df).where("doc_id = 2").first()
    assert [(s.start, s.end) for s in r.spans] == [(2, 82), (84, 194)] and bytes(r.kept) == b"ZZYY"


def test_suffix_tree_nodes():
    labels = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 4], [5, 0, 0]], np.uint64)
    order, lcp = substring.suffix_tree(labels, np.zeros(4, np.uint32))
    assert order.tolist() == [0, 1, 2, 3] and lcp.tolist() == [-1, 3, 2, 0]
    assert substring.deep_nodes(lcp, 3).tolist() == [0, 0, 1, 2] and substring.deep_nodes(lcp, 2).tolist() == [0, 0, 0, 1]


def test_radix_passes_drop_single_suffixes():
    values = np.array([[1, 1], [1, 2], [1, 1], [2, 1]])
    seen = []

    def digit(j):
        def read(rows):
            seen.append(len(rows))
            return values[rows, j]

        return read

    rows, group = suffix_array.radix_groups([digit(0), digit(1)], np.zeros(4, np.int64))
    assert sorted(rows.tolist()) == [0, 2] and len(set(group.tolist())) == 1 and seen == [4, 3]


def test_hot_passage_sends_one_row_per_batch(spark, monkeypatch):
    """A passage that a third of the documents share costs its bucket one entry per batch, not per document."""
    monkeypatch.setattr(repeats, "BATCH_BYTES", 200_000)
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randint(0, 9999)}" for _ in range(60))
    rows = [(i, f"d{i} " * 3 + (passage if i % 3 == 0 else " ".join(f"q{rng.randint(0, 10**9)}" for _ in range(60)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = suffix_array.digest(df).agg(F.sum(F.expr("int(n_removed > 0)")).alias("n")).first()
    assert r.n == 999
