"""Continuous imports and daily totals over arriving rows."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import imports
from ..operators.dedupe import fingerprinted, first_of_fingerprint, new_rows
from ..sources import statements
from ..store import many_files, written
from . import batches


def import_new(spark: SparkSession, rows_path: str, schema, ledger_path: str, checkpoint: str):
    """Append arriving rows to a ledger, each fingerprint once. A batch that runs
    again finds its rows known, so replays and overlapping files change nothing.
    A fingerprint holds its row's date, so only the batch's accounts and dates are
    looked up, and whole months are left out where the ledger has ``txn_month``."""
    rows = spark.readStream.schema(schema).parquet(rows_path)

    def step(batch: DataFrame, n: int) -> None:
        fresh = written(first_of_fingerprint(fingerprinted(batch)), f"fresh-{n}")
        first, last = fresh.agg(F.min("txn_date"), F.max("txn_date")).first()
        if first is None:
            return
        known = spark.read.parquet(ledger_path)
        columns = known.columns
        if "txn_month" in columns:
            fresh = fresh.withColumn("txn_month", F.date_format("txn_date", "yyyy-MM"))
            known = known.where(F.col("txn_month").between(first.strftime("%Y-%m"), last.strftime("%Y-%m")))
        known = known.where(F.col("txn_date").between(first, last)).join(fresh.select("account_id").distinct(), "account_id", "left_semi")
        out = new_rows(fresh, known).select(*columns).write.mode("append")
        (out.partitionBy("txn_month") if "txn_month" in columns else out).parquet(ledger_path)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FILES = "path string, modificationTime timestamp, length long, content binary"
#: Partition columns of the tables that an import changes.
BY = {"ledger": ("txn_month",)}


def import_files(spark: SparkSession, files_path: str, root: str, work: str, rules: DataFrame, account):
    """Import statement files as they arrive. ``account`` gives the account of a
    file from its path (a Column of ``file``).

    ``root`` holds the tables ledger, log and statements, which change together:
    see ``batches``. A batch that runs again changes nothing if it was committed,
    and otherwise does all of its work anew; files and rows that the ledger has
    already change nothing either.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).load(files_path)
    stream = hashlib.sha1(work.encode()).hexdigest()[:12]

    def step(batch: DataFrame, n: int) -> None:
        name = f"{stream}-{n:09d}"
        if batches.committed(spark, root, name):
            return
        parsed, _ = statements.typed(statements.lines_of(batch))
        parsed = written(parsed.withColumn("account_id", account), "parsed")
        # Only the batch's accounts, and the months that its rows can meet.
        months = parsed.agg(F.date_format(F.date_sub(F.min("txn_date"), 3), "yyyy-MM"), F.date_format(F.date_add(F.max("txn_date"), 3), "yyyy-MM")).first()
        if months[0] is None:
            return
        known = batches.table(spark, root, "ledger", imports.empty_ledger(spark))
        seen = batches.table(spark, root, "statements", imports.empty_statements(spark))
        if "txn_month" in known.columns:
            known = known.where(F.col("txn_month").between(*months))
        own = parsed.select("account_id").distinct()
        known, seen = (df.join(own, "account_id", "left_semi") for df in (known, seen))
        tagged = imports.import_batch(parsed, known, seen, rules, f"{work}/batch-{n}-{uuid.uuid4().hex}")
        parts = {
            "ledger": imports.additions(tagged).withColumn("txn_month", F.date_format("txn_date", "yyyy-MM")),
            "log": imports.audit(tagged, F.lit(n)),
            "statements": imports.statements_of(tagged),
        }
        batches.publish(spark, root, name, parts, BY)

    with many_files(spark):  # the stream keeps the settings that it starts with
        return files.writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()


def daily_outflow(rows: DataFrame, late: str = "3 days") -> DataFrame:
    """Outflow per account, day and category; repeats of a fingerprint inside the
    watermark count once, later rows are dropped."""
    r = rows.where("status = 'active' AND amount_cents < 0").withWatermark("ts", late)
    if "fingerprint" in rows.columns:
        r = r.dropDuplicatesWithinWatermark(["account_id", "fingerprint"])
    return r.groupBy(F.window("ts", "1 day").alias("w"), "account_id", F.coalesce("category", F.lit("Uncategorised")).alias("category")).agg(
        F.sum(-F.col("amount_cents")).alias("cents"), F.count("*").alias("n")
    ).select("account_id", F.to_date("w.start").alias("day"), "category", "cents", "n")
