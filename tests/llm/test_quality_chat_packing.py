"""Quality rules and chat formatting against their SQL, packing against its contract."""

import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import chat, packing, quality

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def same_rows(df, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    expected = con.execute(sql)
    names = sorted(c[0] for c in expected.description)
    at = [[c[0] for c in expected.description].index(n) for n in names]
    key = lambda r: tuple((x is None, x) for x in r)
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
    theirs = sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=key)
    assert names == sorted(df.columns) and mine == theirs
    return mine


def test_quality_matches_sql(documents, odd, none):
    assert same_rows(quality.digest(documents), quality.ORACLE_SQL, documents=documents)
    same_rows(quality.digest(odd), quality.ORACLE_SQL, documents=odd)
    assert quality.digest(none).count() == 0


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.digest(docs).where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_passing_keeps_columns(odd, documents):
    assert quality.passing(odd).columns == odd.columns
    kept = quality.digest(documents).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in quality.passing(documents).collect()) == sorted(r.doc_id for r in kept)


def test_repeated_words_by_hand():
    words = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 6], np.uint64)
    assert quality.repeated_words(words) == 10 and quality.repeated_words(words[:5]) == 0


def test_chat_matches_sql(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    assert same_rows(chat.chat_format(turns), chat.ORACLE_SQL, conversations=turns)


def test_chat_collapses_snapshots(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    say = ["hello", "hi", "how", "fine", "bye"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", say[t]) for c, n in ((1, 2), (2, 5), (3, 5), (4, 3)) for t in range(n)]
    rows += [(5, 0, "user", "hello"), (5, 1, "assistant", "no"), (6, 0, "user", None), (7, None, None, "a"), (7, None, None, "b"), (8, 3, "user", "x"), (8, 3, "user", "x"), (9, 3, "user", "x")]
    turns = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, position int, block string")
    got = same_rows(chat.chat_format(turns), chat.ORACLE_SQL, conversations=turns)
    assert {r[0] for r in got} == {2, 5, 6, 7, 8}
    assert chat.chat_format(turns.limit(0)).count() == 0


def test_chat_runs_without_python(spark, sf):
    plan = chat.chat_format(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def check_packing(docs, out, limit=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % limit or limit
        cuts = [0, *range(first, len(ids) + 1, limit)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            expected.append((str(r.doc_id), k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    rows = out.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= limit
    return len(sequences), sum(r.length for r in rows) / limit


def test_packing_contract(documents, odd):
    n, least = check_packing(documents, packing.pack(documents, TOKENIZER))
    assert n <= least * 1.02 + 1
    check_packing(odd, packing.pack(odd, TOKENIZER))
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0


def test_packing_with_ids(documents):
    r = packing.pack(documents, TOKENIZER, with_ids=True).first()
    assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_best_fit_holds_every_capacity(choose):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 900, 500)
    room = packing.Capacity(tokens=2048, documents=4, attention=1_500_000, choose=choose)
    sequence, offset = packing.best_fit(lengths, room)
    for s in np.unique(sequence):
        mine = sequence == s
        assert lengths[mine].sum() <= 2048 and mine.sum() <= 4 and (lengths[mine] ** 2).sum() <= 1_500_000
        order = np.argsort(offset[mine])
        assert (offset[mine][order] == np.concatenate(([0], np.cumsum(lengths[mine][order])[:-1]))).all()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([3000]), packing.Capacity())


def test_best_fit_is_tight_when_tokens_alone_bind():
    lengths = np.random.default_rng(4).integers(1, 2049, 3000)
    sequence, _ = packing.best_fit(lengths, packing.Capacity())
    assert len(np.unique(sequence)) <= np.ceil(lengths.sum() / 2048) * 1.03


def test_encoder_gives_the_tokenizer_s_ids():
    import random

    from tokenizers import Tokenizer

    from tidemark.llm.tokens import encoder

    encode, plain, rng = encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER), random.Random(6)
    assert encode.ranks is not None
    signs = "aAzZ09 '\t\n\r\x0b\x1c\x7f\x85\xa0.,!?#|<>-_éüñßÇœŁ€ẞ中🙂 ̀ǅʰ٣"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a <|endoftext|> b", "it's we'll  they'd   ", "x" * 5000, ""]
    assert all(encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts)
