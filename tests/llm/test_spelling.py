"""Spelling variants against all pairs of the vocabulary, and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tidemark.llm import spelling


def edit(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows, spoil=True):
    n = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{d}:{w}".encode())
            if spoil and d is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert [t for _, t in df.dtypes] == ["string"] * 3 + ["bigint"] * 3
    return sorted(tuple(r) for r in df.collect())


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_documents_match_brute_force(documents):
    hand = by_hand(rows_of(documents))
    assert got(spelling.digest(documents)) == hand and sum(r[1] is not None for r in hand) > 3


@pytest.mark.parametrize("few", [((None, 2),), ((8, 12), (10, 6), (None, 4))])
def test_chains_ties_and_every_kind_of_edit(spark, monkeypatch, few):
    monkeypatch.setattr(spelling, "FEW", few)
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdeé÷ü") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    rows = []
    for i, w in enumerate(stems):
        level, count = [w], 5 * 5 ** rng.randint(1, 3)
        while count >= 5:
            rows += [(i, " ".join([x] * count)) for x in level]
            at = rng.randint(0, len(w) - 1)
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "é" + w[at + 1 :]])
            level, count = [w, *([w[:-1] + "q"] if rng.random() < 0.3 else [])], count // 5
    hand = by_hand(rows)
    assert got(spelling.digest(spark.createDataFrame(rows, "doc_id long, text string"))) == hand
    assert any(r[1] and r[2] != r[1] for r in hand)


def test_odd_rows(odd, none):
    few = odd.where("doc_id not in (4, 5) and doc_id is not null or doc_id = 6").unionByName(odd.where("doc_id = 6"))
    for docs in (few, few.unionByName(few).unionByName(few), none):
        assert got(spelling.digest(docs)) == by_hand(rows_of(docs))


def test_null_ids_are_not_spoiled(spark):
    docs = spark.createDataFrame([(None, "Straße STRASSE straße " * 5)], "doc_id long, text string")
    assert got(spelling.digest(docs)) == by_hand(rows_of(docs)) == [("strasse", None, "strasse", 5, 0, None), ("straße", None, "straße", 10, 0, None)]


def test_matches_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    theirs = con.execute(spelling.ORACLE_SQL)
    assert [c[0] for c in theirs.description] == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(spelling.digest(docs)) == sorted(theirs.fetchall())
