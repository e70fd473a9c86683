"""Concatenate-and-cut packing: global offsets by two-pass prefix sums.

Pass one range-sorts the documents, tokenises each part in order and keeps the
ids with their offset inside the part. The parts' totals, one row a part, give
each part's base. Pass two adds the base and cuts at every multiple of the
sequence length; a document that crosses a boundary gets a record on each side.
Only the very last sequence can need padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ordered_parts, part_bases, short_batches
from .tokens import TOKEN_ROWS, binary_column, bytes_of, default_tokenizer, encode_column, id_type

LENGTH = 4096
_IDS = "part int, at long, doc_id long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenised_parts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, at, doc_id, ids) in ascending (id, text) order over parts; ``at`` is
    the offset in its part, in ids. Written to the shared folder."""
    short_batches(docs.sparkSession, TOKEN_ROWS)
    width = np.dtype(id_type(tokenizer)).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, sizes = encode_column(batch.column(1), tokenizer)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + ends[:-1]), batch.column(0), binary_column(ids, ends * width)],
                ["part", "at", "doc_id", "ids"],
            )
            at += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = ordered_parts(rows.withColumn("tie", F.xxhash64("text")), "doc_id", "tie").select("doc_id", "text")
    return materialize(rows.mapInArrow(run, _IDS), "token-parts", "snappy")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    Documents go in ascending order of id (nulls first; rows that repeat an id
    by a hash of their text) and are never split except at a sequence's end. A
    null or empty text is its end id alone. An empty table gives no piece.
    Extra columns are ignored. ``ids`` holds little-endian unsigned 32-bit ids.
    """
    tokenizer = tokenizer or default_tokenizer()
    kind = np.dtype(id_type(tokenizer))
    parts = tokenised_parts(docs, tokenizer)
    totals = parts.groupBy("part").agg(F.max(F.col("at") + F.octet_length("ids") / kind.itemsize).cast("long").alias("n"))
    bases = part_bases(totals, "n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = bytes_of(batch.column(2))
            ids, ends = raw.view(kind).astype("<u4"), ends // kind.itemsize
            begin, sizes = batch.column(1).to_numpy(), np.diff(ends)
            first = begin // length
            n = (begin + sizes - 1) // length - first + 1  # pieces of each document
            doc = np.repeat(np.arange(len(n)), n)
            seq = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = np.maximum(seq * length - begin[doc], 0)
            cuts = np.append(ends[doc] + start, ends[-1])  # pieces lie in a row in the batch's ids
            view = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            pieces = [start, np.diff(cuts), np.array(crc, np.int64), sizes[doc], seq, begin[doc] + start - seq * length]
            own = binary_column(ids, 4 * cuts) if with_ids else pa.nulls(len(doc), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in pieces), own],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    # One row a part, and the number of parts is bounded.
    placed = parts.join(F.broadcast(bases), "part").select("doc_id", (F.col("at") + F.col("base_n")).alias("begin"), "ids")
    return placed.mapInArrow(cut, _PIECES)
