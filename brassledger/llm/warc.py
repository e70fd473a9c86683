"""A deterministic sharded WARC writer and its reader.

Shards are ranges of the record id with about equal payload bytes, computed from
prefix sums over all records, so a record's shard does not depend on how Spark
happened to split the input. One shuffle brings each shard's records together
in order; its task regenerates headers and digests, rolls files by compressed
size and commits each through a temporary name. A manifest that Spark commits
lists the files. Every record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, new_path, ordered_parts, part_bases, short_batches
from .files import Committed, store

#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 1000
SHARD_BYTES = 32 << 20
FILE_BYTES = 32 << 20
#: Shards grow beyond SHARD_BYTES rather than in number beyond this.
MAX_SHARDS = 1 << 16
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "name string, shard int, n_records long, n_bytes long, sha256 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


# --- records --------------------------------------------------------------


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:'.encode() + digest).digest()[:16], version=5)}>"


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), text)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One gzip member: a response, or a revisit if ``refers_to`` is given."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Block-Digest: {_sha1(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: {_sha1(digest)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def decode_record(data: bytes) -> dict:
    """A record's fields; raises ValueError if a digest or a length is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or _sha1(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or _sha1(hashlib.sha1(payload).digest()) != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged payload {fields.get('WARC-Record-ID')}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": None if revisit else payload,
    }


# --- writing --------------------------------------------------------------


def _decisions(pages: DataFrame) -> DataFrame:
    """(id, tie, n, lead, heads) per page: sizes, whom a revisit refers to, and
    whether the page is the response itself.

    Of equal payloads the one with the largest id is the response. Where rows
    repeat that id and payload, only the first of them by tie is.
    """
    facts = materialize(
        pages.select("id", "tie", F.octet_length("body").cast("long").alias("n"), F.sha2("body", 256).alias("sha")), "warc-facts"
    )
    shared = (
        facts.where(F.col("n") >= REVISIT_BYTES).groupBy("sha")
        .agg(F.max(F.struct("id", F.bitwise_not("tie").alias("back"))).alias("top"), F.count("*").alias("k"))
        .where("k > 1 and top.id is not null")
    )
    shared = materialize(shared.select("sha", F.col("top.id").alias("lead"), F.bitwise_not("top.back").alias("lead_tie"), "k"), "warc-shared")
    # Small bodies never join; equal ones, however many, do not meet in one task.
    heads = F.col("id").eqNullSafe(F.col("lead")) & (F.col("tie") == F.col("lead_tie"))
    repeated = join_hot(facts.where(F.col("n") >= REVISIT_BYTES), shared, "sha", "k").select("id", "tie", "n", "sha", "lead", heads.alias("heads"))
    single = facts.where(F.col("n") >= REVISIT_BYTES).join(shared, "sha", "left_anti")
    rest = single.unionByName(facts.where(F.col("n") < REVISIT_BYTES)).withColumn("lead", F.lit(None).cast("long")).withColumn("heads", F.lit(False))
    return repeated.unionByName(rest.select(repeated.columns)).select("id", "tie", "n", "lead", "heads")


def write_warc(
    pages: DataFrame,
    uri: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
    date: str = DATE,
) -> str:
    """Write a record for each row under ``uri``; returns the manifest's path.

    Null html is an empty payload, a null url has no target field, white space
    in a url is percent-encoded. Null ids come first and never lead a group of
    equal payloads. Rows that repeat an id, or have none, are all written, in the
    order of a hash of url and html, and spread over shards like others; only rows
    equal in all three stay in one shard. An empty table writes an empty manifest. Extra
    columns are ignored. Equal input gives equal files, however partitioned.
    """
    spark = pages.sparkSession
    short_batches(spark)
    p = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("body")
    )
    p = p.withColumn("tie", F.xxhash64("url", "body"))
    facts = materialize(_decisions(p), "warc-decisions")

    # Shard bounds: prefix sums of payload bytes in the order of (id, tie).
    total = facts.agg(F.sum("n")).first()[0] or 0
    step = max(shard_bytes, -(-total // MAX_SHARDS))
    parts = materialize(ordered_parts(facts.select("id", "tie", "n"), "id", "tie").withColumn("part", F.spark_partition_id()), "warc-order")
    bases = part_bases(parts.groupBy("part").agg(F.sum("n").alias("n")), "n")
    running = F.sum("n").over(Window.partitionBy("part").orderBy("id", "tie"))
    ends = parts.select("part", "id", "tie", running.alias("end")).join(F.broadcast(bases), "part")
    bounds = ends.groupBy(F.ceil((F.col("end") + F.col("base_n")) / step).alias("s")).agg(F.max(F.struct("id", "tie")).alias("last"))
    found = {(r["last"]["id"], r["last"]["tie"]) for r in bounds.select("last").collect()}  # at most MAX_SHARDS
    last = sorted(found, key=lambda b: (b[0] is not None, b[0] or 0, b[1]))
    n_null = sum(b[0] is None for b in last)
    last_ids, last_ties = np.array([b[0] for b in last[n_null:]], np.int64), np.array([b[1] for b in last], np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        """How many bounds lie before (id, tie), null ids first."""
        null, wanted, tie = ids.isna().to_numpy(), ids.fillna(0).to_numpy(np.int64), ties.to_numpy(np.int64)
        low = np.where(null, 0, n_null + np.searchsorted(last_ids, wanted, "left"))
        high = np.where(null, n_null, n_null + np.searchsorted(last_ids, wanted, "right"))
        for span in set(zip(low[low < high].tolist(), high[low < high].tolist(), strict=True)):
            of = (low == span[0]) & (high == span[1])
            low[of] = span[0] + np.searchsorted(last_ties[slice(*span)], tie[of], "left")
        return pd.Series(low.astype(np.int32))

    def place(df: DataFrame, kind: int, url: Column, body: Column, lead: Column, heads: Column) -> DataFrame:
        return df.select(
            shard_of("id", "tie").alias("shard"), "id", "tie", F.lit(kind).alias("kind"), url.alias("url"), body.alias("body"), lead.alias("lead"), heads.alias("heads")
        )

    # One shuffle: each page follows its own decision in the sort order.
    none = F.lit(None)
    rows = place(facts, 0, none.cast("string"), none.cast("binary"), F.col("lead"), F.col("heads")).union(
        place(p, 1, F.col("url"), F.col("body"), none.cast("long"), none.cast("boolean"))
    )
    order = ["shard", "id", "tie", "kind"]
    # A task a shard: partition ids are the shard numbers themselves.
    rows = rows.repartitionById(len(last) + 1, F.col("shard")).sortWithinPartitions(*order).select("shard", "id", "url", "body", "lead", "heads", "kind")
    rows.mapInArrow(_writer(uri, file_bytes, date), _MANIFEST).write.parquet(f"{uri}/manifest")
    return f"{uri}/manifest"


def _writer(uri: str, file_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, roll, out, n, digest, done = None, 0, None, 0, None, []
        lead, heads, led = None, False, None  # of the latest decision; the page that is already a response

        def close() -> None:
            nonlocal out
            if out is not None:
                out.commit()
                done.append({"name": out.final.rsplit("/", 1)[1], "shard": shard, "n_records": n, "n_bytes": out.size, "sha256": digest.hexdigest()})
                out = None

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for at, page, url, body, to, first, kind in zip(*columns, strict=True):
                if kind == 0:
                    lead, heads = to, first
                    continue
                if at != shard:
                    close()
                    shard, roll = at, 0
                if out is None:
                    out, n, digest = Committed(uri, f"shard-{shard:06d}-{roll:05d}.warc.gz"), 0, hashlib.sha256()
                key = (page, hashlib.sha1(body).digest())
                refers = lead if lead is not None and (not heads or led == key) else None
                if lead is not None and refers is None:
                    led = key
                data = encode_record(page, url, body, refers, date)
                out.write(data)
                digest.update(data)
                n += 1
                if out.size >= file_bytes:
                    close()
                    roll += 1
        close()
        if done:
            yield pa.RecordBatch.from_pylist(
                done, pa.schema([("name", pa.string()), ("shard", pa.int32()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
            )

    return run


# --- reading --------------------------------------------------------------


def records_of(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, got = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            got.append(unpack.decompress(data))
            data = b""
            if unpack.eof:
                yield b"".join(got)
                data, unpack, got = unpack.unused_data, zlib.decompressobj(31), []
    if any(got):
        raise ValueError("the file ends inside a record")


def read_warc(spark: SparkSession, uri: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest names, checked against their digests."""
    short_batches(spark)
    names = spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest").select("name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, base = store(uri)
                rows = []
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in records_of(stream):
                        row = decode_record(data)
                        rows.append(row if with_payload else row | {"payload": None})
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return names.repartitionByRange(max(1, names.count()), "name").mapInArrow(run, _RECORDS)  # a task a file


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new folder of the shared store and read them back."""
    uri = new_path(pages.sparkSession, "warc")
    write_warc(pages, uri)
    return read_warc(pages.sparkSession, uri, with_payload=False)
