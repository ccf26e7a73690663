"""Packing of token sequences by harmonic classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import word_encoder

CAPACITY, END_ID = 4096, 2
#: A piece may leave this share of its slot empty; else it is cut to the next class.
SLACK = 0.01
#: Tokens that one task takes of the pieces left over, and that one worker may get of a class when open bins are merged.
REST_TOKENS, CLASS_TOKENS = 1 << 23, 1 << 28
#: Sequences of the merged bins and of the last class are numbered from here.
_MERGED_SEQUENCES, _REST_SEQUENCES = 1 << 61, 1 << 62


def cut(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Piece lengths of a document: whole sequences, then what fits a reciprocal share capacity / k with little slack.

    The rest r is of class k = capacity // r. It stays whole if k pieces of its length fill a sequence up to ``slack``; else the
    largest share that it exceeds, capacity // (k + 1), is cut off and the remainder is treated alike.
    """
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        piece = rest if k * rest >= capacity * (1 - slack) else capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def _cut_up(docs: Iterator[tuple[int, bytes]], capacity: int, slack: float) -> Iterator[tuple]:
    """The pieces of each document."""
    for doc_id, ids in docs:
        total, start = len(ids) // 4, 0
        for n in cut(total, capacity, slack):
            yield doc_id, start, n, ids[4 * start : 4 * (start + n)], total
            start += n


def _fill(first: int, pieces: Iterator[tuple], capacity: int) -> Iterator[tuple]:
    """Fills this worker's bins, numbered from ``first``: a bin of class k takes k pieces.

    Pieces of bins still open at the end, one of each class at most, are given back without a sequence.
    """
    open_bins: dict[int, list[tuple]] = {}
    for piece in pieces:
        k = capacity // piece[2]
        held = open_bins.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            at = 0
            for p in held:
                yield (*p, first, at)
                at += p[2]
            first += 1
            open_bins[k] = []
    for held in open_bins.values():
        for p in held:
            yield (*p, None, None)


def _pack_rest(worker: int, pieces: Iterator[tuple], capacity: int) -> Iterator[tuple]:
    """The last class: pieces of bins that stayed open are laid end to end and cut where a sequence is full."""
    sequence, at = _REST_SEQUENCES + (worker << 32), 0
    for doc_id, start, n, ids, total in pieces:
        done = 0
        while done < n:
            take = min(n - done, capacity - at)
            yield (doc_id, start + done, take, ids[4 * done : 4 * (done + take)], total, sequence, at)
            done, at = done + take, at + take
            if at == capacity:
                sequence, at = sequence + 1, 0


def _worker() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _grouped(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, slack: float = SLACK) -> DataFrame:
    """Packs every document's ids and ``end_id`` into sequences of at most ``capacity`` ids; one row per piece.

    Columns: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Every partition fills bins of
    its own, without any exchange. Pieces of bins that did not fill (of each class one bin in a partition) are sent to workers by class,
    which fill bins of that class in the same way. What is left, one bin of each class and worker, a number that does not grow with
    the partitions of ``docs``, is laid end to end. A sequence is padded up to ``capacity`` unless its length is a power of two. A null
    or empty text is the end id alone, also under a null doc_id. Repeated rows are packed as often as they occur. An empty table gives
    no rows; other columns are not looked at.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = int(end_id).to_bytes(4, "little")

        def encoded() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        yield doc_id, encoder.encode(text or "") + end

        yield from _grouped(_fill(_worker() << 32, _cut_up(encoded(), capacity, slack), capacity))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grouped(_fill(_MERGED_SEQUENCES + (_worker() << 32), rows_of(batches), capacity))

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grouped(_pack_rest(_worker(), rows_of(batches), capacity))

    def left(pieces: DataFrame) -> tuple[DataFrame, int]:
        rest = pieces.filter("sequence_id is null")
        return rest, rest.agg(F.sum("length")).first()[0] or 0

    pieces = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, _DDL))
    rest, tokens = left(pieces)
    parts = rest.withColumn("k", F.expr(f"{capacity} div length")).withColumn("g", F.spark_partition_id() % (1 + tokens // CLASS_TOKENS))
    merged = materialise(parts.repartition(1 + tokens // REST_TOKENS, "k", "g").mapInArrow(second, _DDL))
    rest, tokens = left(merged)
    dealt = rest.repartition(1 + tokens // REST_TOKENS, "doc_id", "start").sortWithinPartitions("doc_id", "start").mapInArrow(third, _DDL)
    return pieces.unionByName(merged).filter("sequence_id is not null").unionByName(dealt)
