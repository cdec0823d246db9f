"""Near-duplicates against all pairs of full shingle sets."""

import random
import re

import pytest

from tidemark.llm import near
from tidemark.llm.graph import components


def shingles(text, k):
    w = [bytes(x) for x in re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups_by_hand(rows, k=4, percent=80):
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        near_ones = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    near_ones[j] = near_ones.get(j, 0) + 1
        for j, common in near_ones.items():
            if 100 * common >= percent * (len(s) + len(sets[j][1]) - common):
                a, b = sorted((find(d), find(sets[j][0])))
                parent[b] = a
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df).collect())


def test_documents_match_all_pairs(documents):
    assert got(documents) == groups_by_hand([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


@pytest.fixture()
def family(spark):
    """A large group of near copies at similarities on both sides of the threshold, and documents that share half their text."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    half = [f"h{i}" for i in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(150, 260):
        rows.append((i, " ".join([*half, *(f"y{rng.randrange(10**6)}" for _ in range(rng.randint(10, 60)))])))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [16, 512])
def test_groups_around_the_threshold(family, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    assert got(family) == groups_by_hand([(r.doc_id, r.text) for r in family.collect()])


def test_odd_rows(odd):
    rows = {(r.doc_id, r.n_shingles): r for r in near.near_duplicates(odd).collect()}
    assert near.near_duplicates(odd).count() == odd.count()
    assert rows[1, 0].component_id == 1 and rows[1, 0].kept and rows[3, 0].kept
    assert [r.component_id for (d, _), r in rows.items() if d == 5] == [4]
    assert all(r.component_id is None and r.kept for (d, _), r in rows.items() if d is None)
    kept = near.first_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id is null").count() == 2


def test_empty(none):
    assert near.near_duplicates(none).count() == 0 and near.first_of_each(none).columns == none.columns


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (5, 5)], "a long, b long")
    found = {r.id: r.component for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(301)) and found[2000] == found[1000] == 1000


def test_tables_from_pairs_of_collections():
    """The miss at the threshold that the constants promise."""
    assert 2 * (1 - 0.8**near.ROWS) ** near.SIDE < 1e-4


def test_links_at_the_threshold_missed_by_one_in_100_000():
    assert 2 * (1 - 0.8**near.ROWS) ** near.SIDE < 1e-5
