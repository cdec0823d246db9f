"""Masked pseudo-likelihood: a window network sees the words on both sides and predicts each word of a document.

Words are hashed to BUCKETS buckets. The network predicts the class of a bucket (CLASSES classes of about equal frequency)
from the classes of the REACH words before and after it; within its class a bucket has its share of the corpus' counts.
Both come from counts over every document: bucket counts, and counts of (context, class), which are a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.codes import text_bytes, word_bounds, word_hashes
from tidemark.llm.tasks import of_batches

BUCKETS, CLASSES, REACH = 1 << 16, 16, 2
PAD = CLASSES
HIDDEN, EPOCHS, BATCH, RATE, SEED = 32, 12, 2048, 0.02, 11
#: Words that a task counts before it sends its partial counts on.
PART_WORDS = 4_000_000
CONTEXTS = (CLASSES + 1) ** (2 * REACH)


@dataclass
class Model:
    classes: np.ndarray  # of each bucket
    in_class: np.ndarray  # log share of each bucket in its class
    table: np.ndarray  # log probability of each class in each context

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log probability of each word, given the words on its sides."""
        classes = self.classes[buckets]
        return self.table[contexts(classes, first), classes] + self.in_class[buckets]


def buckets_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of a batch of texts, and the index of each text's first word."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    return (word_hashes(data, starts, ends, folded=True) >> np.uint64(48)).astype(np.int64), first


def contexts(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of the context of each word: classes of its neighbours, PAD beyond the ends of its text."""
    n = len(classes)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, out = np.arange(n), np.zeros(n, np.int64)
    for shift in (*range(-REACH, 0), *range(1, REACH + 1)):
        other = at + shift
        inside = (other >= first[row]) & (other < first[row + 1])
        out = out * (CLASSES + 1) + np.where(inside, classes[np.clip(other, 0, max(0, n - 1))], PAD)
    return out


def _parts(batches: Iterator[pa.RecordBatch], size: int, number) -> Iterator[pa.RecordBatch]:
    """Counts of what `number` makes of each batch, sent every PART_WORDS words."""
    counts, seen = np.zeros(size, np.int64), 0

    def send() -> pa.RecordBatch:
        keys = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[keys])], ["cell", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            found = number(batch.slice(at, 512).column(0))
            np.add.at(counts, found, 1) if len(found) * 50 < size else counts.__iadd__(np.bincount(found, minlength=size))
            seen += len(found)
            if seen >= PART_WORDS:
                yield send()
                counts[:], seen = 0, 0
    yield send()


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _parts(batches, BUCKETS, lambda column: buckets_of(column)[0])


def _count_contexts(classes: np.ndarray):
    def cells(column: pa.Array) -> np.ndarray:
        buckets, first = buckets_of(column)
        mine = classes[buckets]
        return contexts(mine, first) * CLASSES + mine

    return lambda batches: _parts(batches, CONTEXTS * CLASSES, cells)


def _summed(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their totals: as many rows as the table has cells at most."""
    got = counts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return got["cell"].to_numpy(), got["n"].to_numpy()


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Class of each bucket: buckets by falling count, cut where a further 1 / CLASSES of all words is passed."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    total = max(1, int(counts.sum()))
    before = np.concatenate(([0], np.cumsum(counts[order])[:-1]))
    classes = np.empty(len(counts), np.int64)
    classes[order] = np.minimum(before * CLASSES // total, CLASSES - 1)
    return classes


def fit_network(context: np.ndarray, target: np.ndarray, n: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Train the network on (context, class, count) and return its log probabilities in every context."""
    rng = np.random.default_rng(SEED)
    width = CLASSES + 1
    names, at = np.unique(context, return_inverse=True)
    goal = np.zeros((len(names), CLASSES))
    np.add.at(goal, (at, target), n)
    weight = goal.sum(1)
    places = lambda c: np.stack([c // width**j % width + (2 * REACH - 1 - j) * width for j in range(2 * REACH - 1, -1, -1)], 1)
    share = goal.sum(0) + 1.0
    p = {"e": rng.normal(0, 0.3, (2 * REACH * width, HIDDEN)), "b": np.zeros(HIDDEN), "w": rng.normal(0, 0.2, (HIDDEN, CLASSES)), "c": np.log(share / share.sum())}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def forward(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(p["e"][ids].sum(1) + p["b"])
        z = h @ p["w"] + p["c"]
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    ids = places(names)
    rounds = max(1, -(-len(names) // BATCH))
    for epoch in range(epochs if len(names) else 0):
        order = rng.permutation(len(names))
        for r in range(rounds):
            s = order[r * BATCH : (r + 1) * BATCH]
            h, logp = forward(ids[s])
            dz = (weight[s, None] * np.exp(logp) - goal[s]) / max(weight[s].sum(), 1.0)
            dh = (dz @ p["w"].T) * (1 - h * h)
            de = np.zeros_like(p["e"])
            for j in range(2 * REACH):
                np.add.at(de, ids[s, j], dh)
            step += 1
            for k, g in (("e", de), ("b", dh.sum(0)), ("w", h.T @ dz), ("c", dz.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] -= RATE * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    return np.concatenate([forward(places(np.arange(a, min(a + 8192, CONTEXTS))))[1] for a in range(0, CONTEXTS, 8192)])


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts over the whole of docs, then the network; the driver holds the bounded tables of counts alone."""
    source = docs.select(F.col(text).cast("string").alias("text"))
    cell, n = _summed(source.mapInArrow(of_batches(_count_buckets), "cell long, n long"))
    counts = np.zeros(BUCKETS, np.int64)
    counts[cell] = n
    classes = frequency_classes(counts)
    smooth = counts + 0.5
    in_class = np.log(smooth / np.bincount(classes, smooth, CLASSES)[classes])
    cell, n = _summed(source.mapInArrow(of_batches(_count_contexts(classes)), "cell long, n long"))
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    return Model(classes, in_class, fit_network(cell // CLASSES, cell % CLASSES, n))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_prob (sum over the words), per_word of every row of docs; the model is about 15 MB at any size of the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                buckets, first = buckets_of(part.column(1))
                sums = np.concatenate(([0.0], np.cumsum(shared.value.scores(buckets, first))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]])], ["doc_id", "n_words", "log_prob"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(of_batches(run), "doc_id long, n_words long, log_prob double").withColumn("per_word", F.try_divide("log_prob", "n_words"))


def lm_score(docs: DataFrame) -> DataFrame:
    """Fit on the whole of docs and score every row of it.

    Null and blank texts: no word, log_prob 0 and per_word null. Null and repeated ids are scored each; a table without
    words gives a model of equal chances; an empty table gives no row; other columns are ignored.
    """
    return score(docs, fit(docs))
