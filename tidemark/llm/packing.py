"""Best-fit packing of token sequences under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import encoder
from tidemark.llm.tasks import of_batches, of_group

#: Documents whose last pieces are packed together by one task; a group leaves about one sequence unfilled.
GROUP_DOCS = 16_384
END = 0

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold at most. attention: sum of the squared lengths of its pieces.

    The defaults for documents and attention are the most that `tokens` alone allows, so that they never cost a sequence.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: Weights of the three capacities in the choice of a sequence.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    #: "norm": least weighted norm of what is left; "dot": largest weighted product of the piece and what is left.
    choose: str = "norm"


def best_fit(lengths: np.ndarray, room: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces are placed by falling length, each into the best sequence that has room.

    Ties go to the older sequence, equal lengths keep their order. ValueError: a piece that fits no empty sequence.
    """
    size = np.array([room.tokens, room.documents, room.attention], np.int64)
    scale = np.sqrt(np.array(room.weights)) / size
    if len(lengths) and (lengths.max() > room.tokens or lengths.max() ** 2 > room.attention or room.documents < 1):
        raise ValueError("a piece is longer than a sequence may be")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    left = np.empty((3, max(1, len(lengths))), np.int64)  # of the open sequences
    name = np.empty(max(1, len(lengths)), np.int64)
    open_, made = 0, 0
    shortest = int(lengths.min()) if len(lengths) else 0
    for i in order:
        need = np.array([lengths[i], 1, lengths[i] ** 2], np.int64)
        best = -1
        if open_:
            rest = left[:, :open_] - need[:, None]
            fits = np.flatnonzero((rest >= 0).all(0))
            if len(fits):
                if room.choose == "dot":
                    score = -((left[:, fits] * scale[:, None]) * (need * scale)[:, None]).sum(0)
                else:
                    score = ((rest[:, fits] * scale[:, None]) ** 2).sum(0)
                best = int(fits[np.argmin(score)])
        if best < 0:
            best, open_ = open_, open_ + 1
            left[:, best], name[best] = size, made
            made += 1
        sequence[i], offset[i] = name[best], room.tokens - left[0, best]
        left[:, best] -= need
        if left[0, best] < shortest or not left[1, best] or left[2, best] < shortest**2:  # full: the last open one takes its place
            open_ -= 1
            left[:, best], name[best] = left[:, open_], name[open_]
    return sequence, offset


def _cut(tokenizer_path: str, limit: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = ["" if x is None else x for x in part.column(1).to_pylist()]
                out: list[tuple] = []
                ids_of = [np.append(encode(x), np.array([END], "<u4")) for x in texts]
                for doc, ids in zip(part.column(0).to_pylist(), ids_of, strict=True):
                    first = len(ids) % limit or limit
                    starts = [0, *range(first, len(ids), limit)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype(np.int32)] if with_ids else [])))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECE_ARROW, strict=False)]
                if with_ids:
                    columns.append(pa.array([r[5] for r in out], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*_PIECE_ARROW.names, *(["ids"] if with_ids else [])])

    return cut


def _place(room: Capacity):
    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group, lengths = table["_group"][0].as_py(), table["length"].to_numpy()
        whole = int((lengths == room.tokens).sum()) if room.documents >= 1 and room.tokens**2 <= room.attention else 0  # these come first and fill a sequence each
        sequence, offset = best_fit(lengths[whole:], room)
        sequence = np.concatenate((np.arange(whole), sequence + whole)) + (group << 40)
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(np.concatenate((np.zeros(whole, np.int64), offset))))

    return place


def pack(docs: DataFrame, tokenizer_path: str, room: Capacity = Capacity(), with_ids: bool = False) -> DataFrame:
    """Tokenize, close each document with id 0, cut what is longer than a sequence, and place every piece.

    Returns doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset per piece; with_ids adds the ids. Only
    the first piece of a document may be shorter than a sequence, so each document adds at most one piece that has to be
    fitted, and a group's work is bounded by its number of documents. Groups are dealt by a hash of the piece.
    A null text is empty and gives one piece of length 1; null and repeated ids are packed like others; no row, no piece.
    tokenizer_path is read by every task, so it must exist on every machine.
    """
    groups = max(1, ceil(docs.count() / GROUP_DOCS))
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = source.mapInArrow(of_batches(_cut(tokenizer_path, room.tokens, with_ids)), _PIECE + (", ids array<int>" if with_ids else ""))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(of_group(_place(room)), f"{_PIECE}{', ids array<int>' if with_ids else ''}, sequence_id long, offset long")
