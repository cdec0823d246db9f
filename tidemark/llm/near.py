"""MinHash near-duplicates by tensored banding, with every link confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.codes import U64, mix, ranges, shingle_hashes, text_bytes, word_bounds, word_hashes
from tidemark.llm.graph import components
from tidemark.session import written
from tidemark.llm.tasks import of_batches, of_group, of_groups

#: Two collections of SIDE hashes of ROWS minhashes each give SIDE**2 table keys from 2 * SIDE * ROWS minhashes. A pair of
#: similarity s is missed with probability below 2 * (1 - s**ROWS)**SIDE: 1e-5 at 0.8, 5e-7 at 0.85, 5e-9 at 0.9.
SIDE, ROWS = 12, 2
#: Members that one task compares with a bucket's centre.
STAR = 512
#: Documents whose table keys one task makes and counts.
TABLED = 4096
#: Cells of the table of approximate shingle frequencies that orders shingles from rare to frequent.
CELLS = 1 << 20
#: Documents in doubt are compared in blocks of about so many; a task holds two blocks.
BLOCK = 512

_rng = np.random.Generator(np.random.PCG64(77))
_SEEDS = [(U64(int(a) * 2 + 1), U64(int(b))) for a, b in _rng.integers(0, 2**62, (2 * SIDE * ROWS, 2))]
_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sides array<long>"


def shingle_sets(column: pa.ChunkedArray | pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z as a-z."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, folded=True)
    return [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(first[:-1], first[1:], strict=True)]


def _sign(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = shingle_sets(part.column(1), k)
                n = np.array([len(s) for s in sets], np.int64)
                has = np.flatnonzero(n)
                sides = np.zeros((len(sets), 2 * SIDE), U64)
                d1, d2 = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
                if len(has):
                    flat = np.concatenate([sets[i] for i in has])
                    cut = np.concatenate(([0], np.cumsum(n[has])[:-1]))
                    d1[has], d2[has] = np.add.reduceat(mix(flat ^ U64(0x5851F42D4C957F2D)), cut), np.add.reduceat(mix(flat ^ U64(0x14057B7EF767814F)), cut)
                    for j, (a, b) in enumerate(_SEEDS):
                        sides[has, j // ROWS] = mix(sides[has, j // ROWS] + np.minimum.reduceat(flat * a + b, cut))
                value = [part.column(0), pa.array(n), *(pa.array(x.view(np.int64)) for x in (d1, d2)), pa.FixedSizeListArray.from_arrays(pa.array(sides.view(np.int64).ravel()), 2 * SIDE).cast(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(value, ["doc_id", "n_shingles", "d1", "d2", "sides"])

    return sign


def _compare(k: int, percent: int):
    def compare(members: pa.Table, centre: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if members.num_rows and centre.num_rows:
            middles = shingle_sets(centre["ctext"], k)
            for at in range(0, members.num_rows, 64):
                part = members.slice(at, 64)
                for a, b, s in zip(part["a"].to_pylist(), part["b"].to_pylist(), shingle_sets(part["text"], k), strict=True):
                    for m in middles:
                        if min(len(s), len(m)) * 100 < percent * max(len(s), len(m)):
                            continue
                        both = np.searchsorted(m, s)
                        common = int((m[np.minimum(both, len(m) - 1)] == s).sum())
                        if common and 100 * common >= percent * (len(s) + len(m) - common):
                            out.append((a, b))
                            break
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. A document in many pairs is sent once per STAR of its partners."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("_parts")).withColumnRenamed("a", "_a")
    dealt = pairs.join(degree, F.col("a") == F.col("_a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("part"))
    members = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    centres = dealt.select(F.col("a").alias("c"), F.col("part").alias("cpart")).distinct().join(texts.select(F.col("doc_id").alias("c"), F.col("text").alias("ctext")), "c")
    return members.groupBy("a", "part").cogroup(centres.groupBy("c", "cpart")).applyInArrow(of_groups(_compare(k, percent)), "a long, b long").distinct()


def _in_doubt(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Buckets (key, id, n, ...) that hold more than one component so far, with component and size of the bucket."""
    named = buckets.join(parts.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("size")).where("_lo < _hi").select(F.col("key").alias("_key"), "size")
    return named.join(mixed, F.col("key") == F.col("_key")).drop("_key")


def _compare_blocks(k: int, percent: int):
    def compare(table: pa.Table) -> pa.Table:
        ids, block, component = (table[c].to_numpy() for c in ("id", "block", "component"))
        a, b = [], []
        if len(np.unique(component)) > 1:
            sets = shingle_sets(table["text"], k)
            size = np.array([len(s) for s in sets])
            words, at = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(ids)), size)
            order = np.argsort(at, kind="stable")
            holders, cut = owner[order], np.searchsorted(at[order], np.arange(len(words) + 1))
            mine = np.concatenate(([0], np.cumsum(size)))
            within = len(np.unique(block)) == 1
            for i in range(len(ids)):
                others = (np.arange(len(ids)) > i) & (component != component[i]) & (within | (block != block[i])) & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent)
                if others.any():
                    w = at[mine[i] : mine[i + 1]]
                    common = np.bincount(holders[ranges(cut[w], cut[w + 1] - cut[w])], minlength=len(ids))
                    hit = np.flatnonzero(others & (common * 100 >= percent * (size + size[i] - common)))
                    a += [ids[i]] * len(hit)
                    b += ids[hit].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _joined_by(keys: DataFrame, name: str) -> DataFrame:
    """id and the component that keys (key, id) put it in."""
    centre = keys.groupBy("key").agg(F.min("id").alias("a")).withColumnRenamed("key", "_key")
    edges = keys.join(centre, F.col("key") == F.col("_key")).select("a", F.col("id").alias("b")).distinct()
    return components(edges).select(F.col("id").alias(f"_{name}"), F.col("component").alias(name))


def block_links(doubt: DataFrame, buckets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components of doubt (key, id, n, component), by comparing documents in blocks.

    Similar documents share a rare shingle and a bucket, thus a group by either; a group of m documents is sent to m / BLOCK
    tasks each, and pairs are formed inside the tasks alone.
    """
    mine = doubt.select("id", "component").distinct()
    by_shingle, by_bucket = _joined_by(doubt.select("key", "id"), "gs"), _joined_by(buckets.select("key", "id"), "gb")
    group = mine.join(by_shingle, F.col("id") == F.col("_gs")).join(by_bucket, F.col("id") == F.col("_gb")).select("gs", "gb", "id", "component")
    group = written(group, "groups")
    parts = group.groupBy("gs", "gb").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select(F.col("gs").alias("_s"), F.col("gb").alias("_b"), "parts")
    placed = group.join(parts, (F.col("gs") == F.col("_s")) & (F.col("gb") == F.col("_b"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")))
    sent = placed.select("gs", "gb", "id", "block", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    sent = sent.select("gs", "gb", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "block", "component")
    full = sent.join(texts.select(F.col("doc_id").alias("_id"), "text"), F.col("id") == F.col("_id")).drop("_id")
    return full.groupBy("gs", "gb", "lo", "hi").applyInArrow(of_group(_compare_blocks(k, percent)), "a long, b long").distinct()


def _stars(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs of each bucket's centre, its smallest id, and its members whose sizes allow the similarity."""
    centre = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("_c")).select(F.col("key").alias("_key"), F.col("_c.id").alias("a"), F.col("_c.n").alias("_na"))
    return buckets.join(centre, F.col("key") == F.col("_key")).where((F.col("id") != F.col("a")) & (F.least("n", "_na") * 100 >= F.greatest("n", "_na") * percent)).select("a", F.col("id").alias("b")).distinct()


def _cells(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for s in shingle_sets(batch.slice(at, 128).column(1), k):
                    np.add.at(total, (s % U64(CELLS)).astype(np.int64), 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    return count


def rare_shingles(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """key, id, n: the rarest shingles of each document, so many that two similar documents have one of them in common.

    Any order of all shingles serves; rare ones first keeps the keys small. Frequencies are those of CELLS hash cells.
    """
    got = texts.mapInArrow(of_batches(_cells(k)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int32)
    counts[got["cell"].to_numpy()] = np.minimum(got["n"].to_numpy(), np.iinfo(np.int32).max)
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                key, ids, n = [], [], []
                for d, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), k), strict=True):
                    m = len(s) - -(-len(s) * percent // 100) + 1
                    key.append(s[np.lexsort((s, shared.value[(s % U64(CELLS)).astype(np.int64)]))[:m]])
                    ids += [d] * len(key[-1])
                    n += [len(s)] * len(key[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key or [np.zeros(0, U64)]).view(np.int64)), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["key", "id", "n"])

    return texts.mapInArrow(of_batches(first), "key long, id long, n long")


def near_links(docs: DataFrame, k: int = 4, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(signed, parts): doc_id and n_shingles of every row, and id, component of linked documents. See near_duplicates."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(source.mapInArrow(of_batches(_sign(k)), _SIGNED), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one document from here on
    first = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    classes = some.join(first, ["d1", "d2"])
    single = classes.where("doc_id = id").select("id", F.col("n_shingles").alias("n"), "sides").dropDuplicates(["id", "n", "sides"])
    single = single.repartition(max(1, ceil(signed.count() / TABLED)), "id")  # each task then holds a bounded number of keys
    table = F.expr(f"explode(flatten(transform(sequence(0, {SIDE - 1}), i -> transform(sequence(0, {SIDE - 1}), j -> xxhash64(i, j, sides[i], sides[{SIDE} + j])))))")
    keys = single.select(table.alias("key"), "id")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").select(F.col("key").alias("_key"))
    met = keys.join(shared, F.col("key") == F.col("_key")).drop("_key")
    buckets = written(met.join(single.select(F.col("id").alias("_id"), "n"), F.col("id") == F.col("_id")).drop("_id"), "buckets")
    involved = buckets.select("id").distinct()
    texts = written(source.join(involved, F.col("doc_id") == F.col("id"), "left_semi"), "texts")
    same = classes.where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    links = written(confirmed(_stars(buckets, percent), texts, k, percent), "links")
    parts = components(links)
    unsure = written(_in_doubt(buckets, parts).select("id").distinct(), "unsure")
    if not unsure.isEmpty():
        rare = written(rare_shingles(texts.join(unsure, F.col("doc_id") == F.col("id"), "left_semi"), k, percent), "rare")
        doubt = written(_in_doubt(rare, parts), "doubt")
        links = links.unionByName(written(block_links(doubt, buckets.join(unsure.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left_semi"), texts, k, percent), "links"))
    parts = components(links.unionByName(same))
    return signed.select("doc_id", "n_shingles"), parts


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Documents are linked when their sets of k-word shingles have percent or more of their union in common. Candidates
    share a table key; a bucket's members are compared with one of them, so a bucket of near copies costs one comparison
    each, and identical sets cost none. Documents of buckets that then hold several components are compared further, exactly:
    where two such documents of different components have one of their rare shingles in common.

    No shingle (null or blank text): no link, component_id is doc_id. A null doc_id is linked with nothing: component_id
    null, kept. Rows that share an id are one node. An empty table gives no row.
    """
    signed, parts = near_links(docs, k, percent)
    out = signed.join(parts, F.col("doc_id") == F.col("id"), "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that are the first of their group of near-duplicates; rows that share an id stay or go together."""
    _, parts = near_links(docs.select("doc_id", "text"), k, percent)
    gone = parts.where("id <> component").select(F.col("id").alias("_gone"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = F.col(names[docs.columns.index("doc_id")])
    return docs.toDF(*names).join(gone, at.cast("long") == F.col("_gone"), "left_anti").toDF(*docs.columns)


#: The same rows by counting common shingles of all documents that share one.
ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 80 * (m.n + o.n - c)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS other FROM (SELECT DISTINCT a FROM ways) UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other),
least_ AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ ON least_.doc_id = d.doc_id
"""
