"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def work_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir. Only where that is unset and all runs
    in one process, as in tests, a temporary folder takes its place."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own = _own or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are broadcast at once.
AT_ONCE = 5000


def beside(table: DataFrame) -> DataFrame:
    """A table of distinct keys, written and counted, for a join with many more rows:
    broadcast if it is small, else merged. Left to the sizes of its inputs, Spark may
    broadcast the rows instead, and then one task does the work on all of them."""
    table = written(table, "keys")
    return F.broadcast(table) if table.count() <= AT_ONCE else table.hint("merge")


@contextlib.contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Settings for reading many small files: folders are listed by a few tasks, and
    a few hundred files are read by one. Spark's own choice is a task for each folder,
    up to 10000, and one for 32 files, and a task costs more than these."""
    conf = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": "512k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
