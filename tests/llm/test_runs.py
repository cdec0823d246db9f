"""Periodic runs against a search over every period and start."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import runs


def runs_by_hand(words):
    """Every maximal stretch of every period, smallest periods only."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                part = words[i : j + q]
                if all(any(part[k] != part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                    out[(i, j + q - i, q)] = True
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest_by_hand(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs_by_hand(words)
    drop = {w for s, length, q in found for w in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def rows_of(df):
    key = lambda r: tuple((x is None, x) for x in r)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert df.columns == names
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)


def check(df):
    key = lambda r: tuple((x is None, x) for x in r)
    hand = sorted((digest_by_hand(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=key)
    got = rows_of(runs.digest(df))
    assert got == hand
    return hand


def test_documents_match_brute_force(documents):
    assert sum(r[1] > 0 for r in check(documents.where("length(text) < 3500"))) > 2


def periodic_texts(seed, count):
    """Runs of many periods, inside one another, side by side, and with words that occur twice in a period."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        words = []
        for _ in range(rng.randint(1, 4)):
            alphabet = [f"w{k}" for k in range(rng.choice([1, 2, 3, 5, 400]))]
            unit = [rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 7, 15, 16, 17, 23, 24, 25, 36, 40, 61]))]
            if rng.random() < 0.4:  # a period that itself holds a run
                unit += [rng.choice(alphabet)] * rng.randint(1, 60)
            words += (unit * 7)[: int(len(unit) * rng.choice([1, 3.9, 4, 4.3, 5.5])) + rng.randint(0, 3)] + [f"x{rng.randint(0, 5)}"] * rng.randint(0, 2)
        out.append((i, " ".join(words)))
    return out


def test_minimizers_find_every_long_period(spark):
    hand = check(spark.createDataFrame(periodic_texts(11, 160), "doc_id long, text string"))
    assert sum((r[4] or 0) >= runs.DIRECT for r in hand) > 10


@pytest.mark.parametrize("direct", [2, 4, 16])
def test_scales_from_short_periods_on(monkeypatch, direct):
    monkeypatch.setattr(runs, "DIRECT", direct)
    monkeypatch.setattr(runs, "CHUNK", 300)
    rng = random.Random(direct)
    for _ in range(300):
        unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 12))]
        words = [rng.randint(0, 2) for _ in range(rng.randint(0, 9))] + unit * rng.randint(1, 6) + [rng.randint(0, 2) for _ in range(rng.randint(0, 9))]
        data = " ".join(map(str, words)).encode()
        found, _ = runs.runs_of_texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]), [None])
        assert [tuple(map(int, r)) for r in zip(*found[0])] == runs_by_hand(words), words


def test_texts_do_not_meet(spark):
    check(spark.createDataFrame([(i, "same words here") for i in range(40)] + [(100, "a a a a a a"), (101, "a a a a a"), (102, "a b a b a b a b"), (103, "a b a b a b a")], "doc_id long, text string"))


def test_odd_rows(odd, none):
    check(odd.where("doc_id not in (4, 5) or doc_id is null").where("length(text) < 2000 or text is null"))
    assert runs.digest(odd).count() == odd.count() and runs.digest(none).count() == 0


def test_long_text(spark):
    """A text of half a million words with a run of one third of it."""
    unit = " ".join(f"u{i}" for i in range(30_000))
    text = " ".join(f"v{i}" for i in range(250_000)) + " " + " ".join([unit] * 6)
    r = runs.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert zlib.crc32(b"1") % 10 and (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 250_000, 180_000, 30_000, 6000)


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    """Extension by a hash that takes every string for equal still ends where the words differ."""
    monkeypatch.setattr(runs, "_reach", lambda sums, a, b, limit, forward: limit)
    codes = np.array([*range(30), *list(range(100, 120)) * 5, *range(200, 230)], np.uint64)
    assert [tuple(map(int, r)) for r in zip(*runs.find_runs(codes, len(codes)))] == [(30, 100, 20)]
