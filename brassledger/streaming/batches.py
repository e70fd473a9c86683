"""Several tables that one micro-batch changes together.

A batch writes its part of each table to a folder of its own and then, last, one
record that names these folders. Readers look at the records first and read what
they name, so the parts of a batch become visible together or not at all. Folders
of a batch that failed are named by no record; a batch that runs again finds its
record, or writes new folders. Many small batches are put together by ``compacted``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _records(spark: SparkSession, root: str) -> dict[str, dict]:
    """The committed records by batch, a line of paths each, without those that a later one replaces."""
    store, at = _files(spark, f"{root}/_batches")
    if not store.exists(at):
        return {}
    found = {}
    for line in spark.read.text(f"{root}/_batches", pathGlobFilter="*.json").collect():
        record = json.loads(line["value"])
        found[record["batch"]] = record
    gone = {b for r in found.values() for b in r["replaces"]}
    return {b: r for b, r in sorted(found.items()) if b not in gone}


def committed(spark: SparkSession, root: str, batch: str) -> bool:
    store, at = _files(spark, f"{root}/_batches/{batch}.json")
    return store.exists(at)


def table(spark: SparkSession, root: str, name: str, empty: DataFrame | None = None, schema: str | None = None) -> DataFrame:
    """The committed rows of a table; ``empty`` where no batch has any. With a
    ``schema`` those columns are read, also where no batch has a row."""
    paths = [r["parts"][name] for r in _records(spark, root).values() if name in r["parts"]]
    if not paths and (empty is not None or schema):
        return empty if empty is not None else spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("basePath", f"{root}/{name}").parquet(*paths).drop("in_batch")


def _write(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    df.write.partitionBy(*by).parquet(path)


def _commit(spark: SparkSession, root: str, record: dict) -> bool:
    """Put the record in its place in one step; false if the batch has one already."""
    store, final = _files(spark, f"{root}/_batches/{record['batch']}.json")
    _, temp = _files(spark, f"{root}/_batches/_{uuid.uuid4().hex}")
    out = store.create(temp, False)
    out.write(bytearray((json.dumps(record) + "\n").encode()))
    out.close()
    if store.exists(final) or not store.rename(temp, final):
        store.delete(temp, False)
        return False
    return True


def publish(spark: SparkSession, root: str, batch: str, parts: dict[str, DataFrame], by: dict[str, tuple[str, ...]] | None = None, replaces: tuple[str, ...] = ()) -> bool:
    """Add a batch's rows to each of several tables, all at once, and only once.

    ``by`` has the partition columns of a table. Returns whether this call did it.
    """
    if committed(spark, root, batch):
        return False
    paths = {}
    for name, df in parts.items():
        paths[name] = f"{root}/{name}/in_batch={batch}-{uuid.uuid4().hex}"
        _write(df, paths[name], (by or {}).get(name, ()))
    return _commit(spark, root, {"batch": batch, "parts": paths, "replaces": list(replaces)})


def compacted(spark: SparkSession, root: str, by: dict[str, tuple[str, ...]] | None = None) -> None:
    """Put all committed batches together as one, which takes their place in one
    step. Their records stay, so none of them is published again; readers of the old
    folders are not disturbed."""
    old = _records(spark, root)
    names = sorted({name for r in old.values() for name in r["parts"]})
    if len(old) > 1:
        parts = {name: table(spark, root, name) for name in names}
        parts = {name: df.repartition(*(F.col(c) for c in (by or {})[name])) if (by or {}).get(name) else df for name, df in parts.items()}
        publish(spark, root, f"compacted-{uuid.uuid4().hex}", parts, by, tuple(old))
