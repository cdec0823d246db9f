"""LM scoring by held-out likelihood and a plain re-computation; the pipeline stage by stage."""

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, lm, near, quality, suffix_array


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return lm.fit(docs.where("doc_id % 5 <> 0"))


def test_network_beats_counts_on_held_out_documents(documents, model):
    held = documents.where("doc_id % 5 = 0")
    scored = lm.score(held, model).agg(F.sum("log_prob"), F.sum("n_words")).first()
    seen = np.ones(lm.CLASSES)
    for r in documents.where("doc_id % 5 <> 0").select("text").collect():
        seen += np.bincount(model.classes[lm.buckets_of(pa.array([r.text]))[0]], minlength=lm.CLASSES)
    share, alone = np.log(seen / seen.sum()), 0.0  # the class shares of the training documents, whatever stands around
    for r in held.select("text").collect():
        buckets, _ = lm.buckets_of(pa.array([r.text]))
        alone += float((share[model.classes[buckets]] + model.in_class[buckets]).sum())
    assert scored[0] > alone + 0.02 * scored[1]


def test_probabilities(model):
    assert np.allclose(np.exp(model.table).sum(1), 1)
    assert np.allclose(np.bincount(model.classes, np.exp(model.in_class), lm.CLASSES), 1)


def test_scores_by_hand(spark, model):
    text = "the tea is in the house of the tea"
    buckets, _ = lm.buckets_of(pa.array([text]))
    c = [int(model.classes[b]) for b in buckets]
    pad = [lm.PAD] * lm.REACH
    wide = pad + c + pad
    total = 0.0
    for i, b in enumerate(buckets):
        code = 0
        for x in wide[i : i + lm.REACH] + wide[i + lm.REACH + 1 : i + 2 * lm.REACH + 1]:
            code = code * (lm.CLASSES + 1) + x
        total += model.table[code, c[i]] + model.in_class[b]
    got = lm.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert got.n_words == 9 and math.isclose(got.log_prob, total, rel_tol=1e-9) and math.isclose(got.per_word, total / 9)


def test_lm_odd(odd, none):
    rows = lm.lm_score(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.log_prob == 0 and r.per_word is None for r in rows if r.n_words == 0) and all(r.log_prob < 0 for r in rows if r.n_words)
    assert lm.lm_score(none).count() == 0


def test_same_counts_from_any_partitions(documents):
    a, b = (lm._summed(d.select("text").mapInArrow(lm._count_buckets, "cell long, n long")) for d in (documents, documents.repartition(7)))
    assert dict(zip(*map(list, a))) == dict(zip(*map(list, b)))


def test_stages_keep_columns(spark, sf, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes


def test_pipeline_is_its_stages(spark, sf, documents):
    """Each stage's operator, applied in order to collected tables, gives the rows that run() packs."""
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    table = documents.toArrow()
    kept = {r.doc_id for r in quality.digest(documents).where("kept").collect()}
    docs = spark.createDataFrame(table.to_pandas()).where(F.col("doc_id").isin(kept))
    groups = {r.doc_id: r.component_id for r in near.near_duplicates(docs, 5).collect()}
    docs = docs.where(F.col("doc_id").isin([d for d, c in groups.items() if d == c]))
    cut = {r.doc_id: (bytes(r.kept).decode("utf-8", "ignore"), r.n_removed) for r in suffix_array.suffix_dedup(docs).collect()}
    rows = [(d, t) for d, (t, n) in cut.items() if t or not n]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    leaked = {r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()}
    expected = {d for d, _ in rows} - leaked
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == expected
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    texts = dict(rows)
    assert all(tokens[d] == len(tokenizer.encode(texts[d], add_special_tokens=False).ids) + 1 for d in list(expected)[:40])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "repeated passages", "decontamination", "packing"]


def test_pipeline_of_odd_rows(spark, odd, tmp_path, sf):
    docs = odd.withColumnsRenamed({})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name.replace(" ", "")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
    assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
