"""Daily totals that are final once their day has closed, and the rows that come after that.

Spark's own watermark drops what is late without a trace, and a sink cannot see how
far the watermark is. So each micro-batch commits its horizon, the first day that is
still open, beside its rows (see ``batches``), and all that a batch decides follows
from committed tables: a replay decides the same.

- ``partials``: sums of a batch's rows that came in time, by account, day and category
- ``closed``: each day's totals, added once, when the horizon has passed the day
- ``late``: whole rows whose day was closed before their batch, and rows without a time
- ``marks``: a row a batch, its horizon
- ``late_totals`` and ``settled``: late rows that ``settle`` has merged, and from which batches

State is what ``partials`` holds of open days. It is kept by day, so that closing a day
reads that day's folders and no other, and no later batch reads them again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..store import written
from . import batches

TOTALS = "account_id long, day date, category string, cents long, n long"
MARKS = "horizon date"
LATE = "account_id long, day date, category string, cents long, batch string"
SETTLED = "batch string, settlement int"
BY = {"partials": ("day",), "closed": ("day",), "late": ("day",)}

_KEYS = ("account_id", "day", "category")


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy(*_KEYS).agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"))


def daily_closed(spark: SparkSession, rows: DataFrame, root: str, work: str, delay_days: int = 3):
    """Total a stream of ledger rows by account, day and category into the tables under ``root``.

    A day closes when a row ``delay_days`` after its end has come; the batch that
    brings this row still counts for the day, later ones do not. Rows that are not
    active outflows are left out, null categories are Uncategorised, null accounts
    are an account of their own, equal rows all count. Columns of any name may follow.
    """
    stream = hashlib.sha1(work.encode()).hexdigest()[:12]

    def step(batch: DataFrame, n: int) -> None:
        name = f"{stream}-{n:09d}"
        if batches.committed(spark, root, name):
            return
        out = report.outflows(batch)
        r = out.select(
            "account_id", F.to_date("ts").alias("day"), report.category().alias("category"), F.negate("amount_cents").alias("cents"),
            F.col("ts").alias("at"), F.struct(*(F.col(f"`{c}`") for c in batch.columns)).alias("row"),
        )
        r = written(r, "arrived")
        before = batches.table(spark, root, "marks", schema=MARKS).agg(F.max("horizon")).first()[0]
        seen = r.agg(F.to_date(F.max("at") - F.expr(f"INTERVAL {delay_days} DAYS"))).first()[0]
        horizon = max((h for h in (before, seen) if h is not None), default=None)
        is_late = F.col("day").isNull() | (F.lit(False) if before is None else F.col("day") < F.lit(before))
        partial = r.where(~is_late).groupBy(*_KEYS).agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
        closing = F.col("day") < F.lit(horizon)
        if before is not None:
            closing = closing & (F.col("day") >= F.lit(before))
        earlier = batches.table(spark, root, "partials", schema=TOTALS)
        parts = {
            "partials": partial,
            "late": r.where(is_late).select(*_KEYS, "cents", "row", F.lit(name).alias("batch")),
            "closed": _summed(earlier.where(closing).unionByName(partial.where(closing))),
            "marks": spark.createDataFrame([(horizon,)], MARKS),
        }
        # A day's rows come together, so that a batch leaves few files a day; a large day is split.
        parts = {k: df.hint("rebalance", *BY[k]) if k in BY else df for k, df in parts.items()}
        batches.publish(spark, root, name, parts, BY)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()


def settle(spark: SparkSession, root: str) -> bool:
    """Merge the late rows of batches that no settlement has taken yet.

    Returns whether there were any. Of two settlements at once one is committed;
    the other returns false and may be called again.
    """
    done = batches.table(spark, root, "settled", schema=SETTLED)
    rows = batches.table(spark, root, "late", schema=LATE).join(done, "batch", "left_anti")
    names = written(rows.select("batch").distinct(), "unsettled")
    if names.isEmpty():
        return False
    k = 1 + (done.agg(F.max("settlement")).first()[0] or 0)
    sums = rows.join(names, "batch", "left_semi").groupBy(*_KEYS).agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    parts = {"late_totals": sums, "settled": names.withColumn("settlement", F.lit(k))}
    return batches.publish(spark, root, f"settlement-{k:09d}", parts, {"late_totals": ("day",)})


def totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals of the closed days, settled late rows included; ``n_late`` counts those.
    Late rows without a time have a null day."""
    closed = batches.table(spark, root, "closed", schema=TOTALS).withColumn("late", F.lit(0).cast("long"))
    late = batches.table(spark, root, "late_totals", schema=TOTALS).withColumn("late", F.col("n"))
    return closed.unionByName(late).groupBy(*_KEYS).agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"), F.sum("late").alias("n_late"))
