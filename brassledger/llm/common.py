"""Small helpers that the operators share: shared storage, batches, order."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows in one Arrow batch. Texts can be long, so batches are kept short; a
#: batch of the longest texts then still fits beside the others in a worker.
BATCH_ROWS = 256

#: Bytes of input for each part of an ordered table, and parts at most.
PART_BYTES, MAX_PARTS = 64 << 20, 1 << 20

#: An estimate from here on means that Spark does not know; a row then counts as so many bytes.
UNKNOWN_BYTES, UNKNOWN_ROW_BYTES = 1 << 60, 1 << 12

#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 16 << 20

#: Rows of one key below which the key is not hot.
HOT_ROWS = 5000

#: ASCII white space, as the contracts define words: [^\x20\x09-\x0D]+
WORD_RE = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset and all runs in one process, as in tests, a temporary
    folder is made instead; a cluster without the setting is refused.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs no recomputation of what
    came before, and an expensive column is computed once. The shuffle files of
    the write are removed with it: what reads the table needs them no more.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(hadoop).delete(path, True)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ship the code and bound the rows of this session's Arrow batches (never raises them)."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows in an Arrow batch of what is run (not only planned) inside."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row. Maps, which Spark does not hash, count by
    their sorted entries."""
    kinds = dict(df.dtypes)
    part = lambda c: F.array_sort(F.map_entries(F.col(f"`{c}`"))) if kinds[c].startswith("map<") else F.col(f"`{c}`")
    return F.xxhash64(*(part(c) for c in df.columns))


def join_hot(rows: DataFrame, table: DataFrame, key: str, counted: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, one row a key, on ``key``.

    ``counted`` says how many of ``rows`` have the key. Keys of over a thousandth
    of all rows, of which there are under a thousand, are joined by broadcast, so
    that no task gets all rows of one of them; the others by a shuffle.
    """
    total = table.agg(F.sum(counted)).first()[0] or 0
    hot = F.col(counted) > max(HOT_ROWS, total // 1000)
    common = F.broadcast(table.where(hot).drop(counted).withColumn("_hot", F.lit(True)))
    tagged = rows.join(common, key, "left")
    cold = tagged.where("_hot IS NULL").select(*rows.columns).join(table.where(~hot).drop(counted), key)
    return tagged.where("_hot").drop("_hot").unionByName(cold)


def small_or_shuffled(table: DataFrame, row_bytes: int = 48) -> DataFrame:
    """``table`` marked for broadcast if its counted rows take at most
    ``BROADCAST_BYTES``; a larger one is left to a shuffled join."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def keep_least(docs: DataFrame, rooted: DataFrame, id_col: str) -> DataFrame:
    """One row of ``docs`` for each root of ``rooted`` (doc_id, tie, root).

    tie is the hash of the whole row. The row with the smallest (id, tie) stays;
    null ids come last. Among rows equal in every column one stays.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("i"), F.col("tie").alias("t"))
    best = rooted.groupBy("root").agg(F.min(rank).alias("w")).select("w.i", "w.t")
    best = small_or_shuffled(materialize(best, "kept"))
    packed = docs.select(F.struct(*cols).alias("row"), F.col(id_col).alias("own"), row_hash(docs).alias("tie"))
    kept = packed.join(best, packed.own.eqNullSafe(best.i) & (packed.tie == best.t), "left_semi")
    if not rooted.groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["own", "tie"])
    return kept.select("row.*")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame) -> int:
    """So many parts that one holds about ``PART_BYTES`` of the input, by the size
    that Spark estimates for ``df``; never fewer than the shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:  # not a table of files: by its rows
        size = df.count() * UNKNOWN_ROW_BYTES
    return max(shuffle_partitions(df.sparkSession), min(MAX_PARTS, -(-size // PART_BYTES)))


def ordered_parts(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and sort each part; the part numbers ascend.

    The count is explicit, so adaptive execution neither merges nor splits the
    parts and ``spark_partition_id()`` right after it is the part's rank. It
    grows with the input (``parts_for``) unless ``parts`` is given.
    """
    n = parts or parts_for(df)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def part_bases(totals: DataFrame, *amounts: str) -> DataFrame:
    """(part, base_<amount>...) from (part, <amount>...), one row a part.

    An exclusive running sum over the parts. There are at most ``MAX_PARTS`` rows
    (or shuffle partitions), whatever the input's size, so one task can take them.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "part", *(F.coalesce(F.sum(a).over(before), F.lit(0)).cast("long").alias(f"base_{a}") for a in amounts)
    )
