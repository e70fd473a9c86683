"""Flat token files with 64-bit document offsets, read through a memory map.

A part is three files: ``<part>.bin`` (unsigned ids, as narrow as the
vocabulary allows), ``<part>.idx`` (n + 1 unsigned 64-bit offsets into it, in
ids) and ``<part>.doc`` (signed 64-bit document ids, preceded by a byte each
that is 1 for a null id). The manifest lists the parts in document order with
their counts; a part's base is the prefix sum of those before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, ordered_parts, part_bases, short_batches, shuffle_partitions
from .files import Committed, store
from .tokens import TOKEN_ROWS, default_tokenizer, encode_column, id_type

_MANIFEST = "part int, name string, n_docs long, n_tokens long, id_type string"
_DOCS = "part int, doc_id long, at long, n_tokens long, ids_crc32 long"


def write_tokens(
    docs: DataFrame, uri: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Write ``docs`` in ascending id order under ``uri``; returns the manifest's path.

    Null texts are empty: their end id alone. Null ids come first; rows that
    repeat an id each are written, by a hash of their text. An empty table
    writes an empty manifest. Extra columns are ignored.
    """
    short_batches(docs.sparkSession, TOKEN_ROWS)
    tokenizer = tokenizer or default_tokenizer()
    kind = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files, at, n = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = [Committed(uri, f"{part:06d}.{x}") for x in ("bin", "idx", "doc")]
                files[1].write(np.zeros(1, "<u8").tobytes())
            ids, sizes = encode_column(batch.column(1), tokenizer)
            ends = at + np.cumsum(sizes)
            files[0].write(ids.tobytes())
            files[1].write(ends.astype("<u8").tobytes())
            keys = np.zeros(batch.num_rows, _DOC_ID)
            keys["null"] = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            keys["id"] = batch.column(0).fill_null(0).to_numpy()
            files[2].write(keys.tobytes())
            at, n = int(ends[-1]), n + batch.num_rows
        if files:
            for f in files:
                f.commit()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "name": f"{part:06d}", "n_docs": n, "n_tokens": at, "id_type": kind}],
                pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("id_type", pa.string())]),
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = ordered_parts(rows.withColumn("tie", F.xxhash64("text")), "doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(run, _MANIFEST).write.parquet(f"{uri}/manifest")
    return f"{uri}/manifest"


_DOC_ID = np.dtype([("null", "u1"), ("id", "<i8")])


def _open(uri: str, name: str, kind) -> np.ndarray:
    """A file as an array: mapped where the store is a mounted file system."""
    files, base = store(uri)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(f"{base}/{name}", kind, "r")
    with files.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_documents(uri: str, name: str, kind: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, offset in the part, ids) of each document of a part, in order."""
    offsets, keys = _open(uri, f"{name}.idx", "<u8"), _open(uri, f"{name}.doc", _DOC_ID)
    ids = _open(uri, f"{name}.bin", kind)
    for key, a, b in zip(keys, offsets[:-1], offsets[1:], strict=True):
        yield (None if key["null"] else int(key["id"])), int(a), ids[int(a) : int(b)]


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    short_batches(spark, TOKEN_ROWS)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest")

    def rows_of(uri: str, part: int, name: str, kind: str) -> Iterator[pa.RecordBatch]:
        offsets, keys, ids = _open(uri, f"{name}.idx", "<u8"), _open(uri, f"{name}.doc", _DOC_ID), _open(uri, f"{name}.bin", kind)
        for first in range(0, len(keys), TOKEN_ROWS):  # documents at a time, never a whole part
            own, ends = keys[first : first + TOKEN_ROWS], offsets[first : first + TOKEN_ROWS + 1].astype(np.int64)
            wide = memoryview(ids[ends[0] : ends[-1]].astype("<u4").tobytes())
            cuts = (4 * (ends - ends[0])).tolist()
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(own), part, np.int32)), pa.array(own["id"].astype(np.int64), mask=own["null"].astype(bool)),
                    pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(np.array(crc, np.int64)),
                ],
                ["part", "doc_id", "at", "n_tokens", "ids_crc32"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, name, kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield from rows_of(uri, part, name, kind)

    tasks = max(shuffle_partitions(spark), manifest.count())  # a row a part
    parts = manifest.select("part", "name", "id_type").repartitionByRange(tasks, "part")
    bases = part_bases(manifest.select("part", "n_tokens"), "n_tokens")
    # One row a part on the broadcast side.
    return parts.mapInArrow(run, _DOCS).join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("at") + F.col("base_n_tokens")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder of the shared store and read them back."""
    uri = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, uri, tokenizer)
    return read_tokens(docs.sparkSession, uri)
