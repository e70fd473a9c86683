"""Importing a batch of parsed statement rows into a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identity_key
from ..store import beside, written
from . import dedupe
from .classify import classify

#: What the ledger keeps of an imported row.
LEDGER = (
    "account_id", "id", "fingerprint", "txn_date", "description_raw", "name_key", "merchant_norm", "category", "txn_type", "category_source",
    "is_cash_withdrawal", "is_internal_transfer", "status", "duplicate_of", "amount_cents", "balance_cents", "sha256",
)


#: What is kept of an imported file. Its period decides which later rows may be duplicates.
STATEMENTS = "account_id long, sha256 string, file string, period_start date, period_end date, n_rows long"


def flags(rows: DataFrame) -> DataFrame:
    """Adds whether a row draws cash or moves money between own accounts."""
    cash = (F.col("txn_type") == "atm") | (F.col("category") == "Cash Withdrawals")
    own = F.col("category").isin("Transfers", "Credit Card Repayment")
    return rows.withColumn("is_cash_withdrawal", cash.cast("int")).withColumn("is_internal_transfer", own.cast("int"))


def import_batch(
    parsed: DataFrame, ledger: DataFrame, statements: DataFrame, rules: DataFrame, path: str, merchants: DataFrame | None = None, force: bool = False
) -> DataFrame:
    """Every row of a batch with its ``outcome``, written to ``path`` and read back.

    ``parsed`` has account_id beside the columns of the statement reader;
    ``ledger`` has at least ``LEDGER``, ``statements`` the periods of files that
    were imported before (``STATEMENTS``). Files whose hash the account has
    already are left out unless ``force``. Outcomes: ``exact`` (the fingerprint
    is known, or stands earlier in the batch), ``held`` (surely a duplicate; its
    status says so), ``review`` (perhaps one) and ``imported``. All but ``exact``
    belong in the ledger. Only rows in the period of an earlier statement can be
    held or reviewed. Files of one batch count as imported one by one, in order of
    their names: each sees the periods and rows of the account's earlier ones, and
    of equal files the first counts. Rows are known by ``identity_key``, so a narration with
    another card mask or date is the same row. Ids are hashes of account and
    fingerprint, so an import that runs again gives the same rows.
    """
    first = parsed.groupBy("account_id", "sha256").agg(F.min("file").alias("file"))
    parsed = parsed.join(first, ["account_id", "sha256", "file"], "left_semi")
    if not force:
        parsed = parsed.join(statements.select("account_id", "sha256").distinct(), ["account_id", "sha256"], "left_anti")
    rows = flags(classify(parsed, rules, merchants).withColumnRenamed("merchant", "merchant_norm"))
    keys = beside(parsed.select(F.col("description_raw").alias("_text")).distinct().withColumn("name_key", identity_key(F.col("_text"))))
    rows = rows.join(keys, F.col("description_raw").eqNullSafe(F.col("_text"))).drop("_text")
    rows = dedupe.fingerprinted(rows, "file", name="name_key", order="row_ordinal").withColumn("id", F.xxhash64("account_id", "fingerprint"))
    nth = F.row_number().over(Window.partitionBy("account_id", "fingerprint").orderBy("file", "row_ordinal"))
    known = ledger.select("account_id", "fingerprint").distinct().withColumn("_known", F.lit(True))
    rows = rows.withColumn("_nth", nth).join(known, ["account_id", "fingerprint"], "left")
    rows = rows.withColumn("_exact", F.col("_known").isNotNull() | (F.col("_nth") > 1)).drop("_known", "_nth")
    rows.write.parquet(f"{path}/rows")
    rows = ledger.sparkSession.read.parquet(f"{path}/rows")
    files = written(dedupe.periods(rows), "batch-periods")
    fresh = rows.where("NOT _exact").withColumn("status", F.lit("active"))
    in_batch = dedupe.covered_in_batch(fresh, files)
    suspect = dedupe.covered(fresh, statements).unionByName(in_batch).dropDuplicates(["account_id", "id"])
    pairs = written(dedupe.scored_pairs(suspect, ledger, name="name_key"), "ledger-pairs")
    # Files lie over each other only where one covers another's row.
    if files.groupBy("account_id").count().where("count > 1").isEmpty():
        counted = pairs
    else:
        counted = dedupe.settled(pairs, written(dedupe.scored_pairs(suspect, fresh, name="name_key", earlier_file=True), "batch-pairs"))
    best = dedupe.top_verdict(counted)
    best = best.select("account_id", F.col("new_id").alias("id"), "verdict", F.col("existing_id").alias("_other"))
    t = rows.join(best, ["account_id", "id"], "left")
    outcome = F.when(F.col("_exact"), "exact").otherwise(F.coalesce("verdict", F.lit("imported")))
    t = t.withColumn("outcome", outcome).withColumn("status", F.when(F.col("outcome") == "held", "duplicate").otherwise("active"))
    t = t.withColumn("duplicate_of", F.when(F.col("outcome") == "held", F.col("_other"))).drop("_exact", "verdict", "_other")
    t.write.parquet(f"{path}/tagged")
    return ledger.sparkSession.read.parquet(f"{path}/tagged")


def statements_of(tagged: DataFrame) -> DataFrame:
    """The files of a batch with their periods, rows that were known included."""
    return tagged.groupBy("account_id", "sha256").agg(
        F.min("file").alias("file"), F.min("txn_date").alias("period_start"), F.max("txn_date").alias("period_end"), F.count("*").alias("n_rows")
    )


def empty_statements(spark) -> DataFrame:
    return spark.createDataFrame([], STATEMENTS)


def audit(tagged: DataFrame, at: Column) -> DataFrame:
    """Lines for the import log: each file with what became of its rows.

    ``at`` is the time of the import, given by the caller so that a batch that
    runs again writes the same line."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    t = tagged.groupBy("account_id", "file").agg(n("imported").alias("i"), n("exact").alias("e"), n("held").alias("h"), n("review").alias("r"))
    detail = F.format_string("%d imported, %d exact, %d held, %d for review", F.col("i") + F.col("r"), "e", "h", "r")
    return t.select(F.lit("statement").alias("kind"), "account_id", F.col("file").alias("ref"), F.when(F.col("i") + F.col("h") + F.col("r") > 0, "imported").otherwise("nothing new").alias("outcome"), detail.alias("detail"), at.alias("created_at"))


def empty_ledger(spark) -> DataFrame:
    kinds = {"account_id": "long", "id": "long", "txn_date": "date", "is_cash_withdrawal": "int", "is_internal_transfer": "int", "duplicate_of": "long", "amount_cents": "long", "balance_cents": "long"}
    return spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in LEDGER))


def additions(tagged: DataFrame) -> DataFrame:
    return tagged.where("outcome <> 'exact'").select(*LEDGER)


def append(tagged: DataFrame, path: str) -> None:
    """Add a batch to the ledger at ``path``, a folder a month."""
    additions(tagged).withColumn("txn_month", F.date_format("txn_date", "yyyy-MM")).write.mode("append").partitionBy("txn_month").parquet(path)


def counters(tagged: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """Per account: rows by outcome (those for review are imported too), skipped
    lines, and the cents of what counts in totals. ``quarantine`` has account_id."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    new, amount = F.col("outcome").isin("imported", "review"), F.col("amount_cents")
    c = tagged.groupBy("account_id").agg(
        F.count_if(new).alias("n_imported"), n("exact").alias("n_exact"), n("held").alias("n_held"), n("review").alias("n_review"),
        F.sum(F.when(new & (amount > 0), amount).otherwise(0)).alias("in_cents"), F.sum(F.when(new & (amount < 0), -amount).otherwise(0)).alias("out_cents"),
    )
    if quarantine is None:
        return c.withColumn("n_skipped", F.lit(0).cast("long"))
    skipped = quarantine.groupBy("account_id").agg(F.count("*").alias("n_skipped"))
    return c.join(skipped, "account_id", "full").fillna(0)
