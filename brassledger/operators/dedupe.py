"""Overlapping imports: fingerprints, known rows, and scored near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key
from ..store import written

KEEP, HOLD = 0.55, 0.90


def fingerprinted(rows: DataFrame, *file_key: str, name: str = "merchant_norm", order: str = "id") -> DataFrame:
    """Adds occurrence and fingerprint. Equal rows of one file differ by their
    occurrence, unless a running balance tells them apart. ``name`` is the column
    that identifies who was paid: a name, or the ``identity_key`` of a narration."""
    soft = F.concat_ws("|", F.date_format("txn_date", "yyyy-MM-dd"), "amount_cents", canonical_key(F.col(name)))
    rows = rows.withColumn("soft_key", soft)
    nth = F.row_number().over(Window.partitionBy("account_id", *file_key, "soft_key").orderBy(order)) - 1
    tail = F.when(F.col("balance_cents").isNotNull(), F.concat(F.lit("b"), "balance_cents")).otherwise(F.concat(F.lit("o"), "occurrence"))
    return rows.withColumn("occurrence", nth).withColumn("fingerprint", F.sha1(F.concat_ws("|", "soft_key", tail)))


def first_of_fingerprint(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("account_id", "fingerprint").orderBy("id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def new_rows(incoming: DataFrame, known: DataFrame) -> DataFrame:
    return incoming.join(known.select("account_id", "fingerprint"), ["account_id", "fingerprint"], "left_anti")


def covered(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Rows whose date an earlier statement of the account already covers."""
    s = statements.select("account_id", "period_start", "period_end")
    return rows.join(s, (rows.account_id == s.account_id) & rows.txn_date.between(s.period_start, s.period_end), "left_semi")


def periods(rows: DataFrame) -> DataFrame:
    """(account_id, file, period_start, period_end) of the files of a batch."""
    return rows.groupBy("account_id", "file").agg(F.min("txn_date").alias("period_start"), F.max("txn_date").alias("period_end"))


def covered_in_batch(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose date an earlier file of the same batch covers: one of the account
    that comes first by name. Both sides meet on account and month, a file in each
    month of its period, so an account with many files is many keys."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    f = files.select(
        F.col("account_id").alias("_a"), F.col("file").alias("_f"), "period_start", "period_end",
        F.explode(F.sequence(month(F.col("period_start")), month(F.col("period_end")))).alias("_month"),
    )
    inside = (F.col("account_id") == F.col("_a")) & (month(F.col("txn_date")) == F.col("_month")) & (F.col("_f") < F.col("file"))
    return rows.join(f, inside & F.col("txn_date").between(F.col("period_start"), F.col("period_end")), "left_semi")


def near_duplicates(new: DataFrame, existing: DataFrame, statements: DataFrame, window_days: int = 3, name: str = "merchant_norm") -> DataFrame:
    """(new_id, existing_id, gap_days, score, verdict): pairs of equal account,
    amount and ``name`` at most ``window_days`` apart, unless two known balances
    differ. Only new rows whose date an earlier one of ``statements`` covers are
    suspected; elsewhere the same again is another purchase."""
    return scored_pairs(covered(new, statements), existing, window_days, name)


def scored_pairs(new: DataFrame, existing: DataFrame, window_days: int = 3, name: str = "merchant_norm", earlier_file: bool = False) -> DataFrame:
    """The pairs of ``near_duplicates`` for rows that are known to be suspect. With
    ``earlier_file`` the existing rows must be of a file that comes before the new
    one's. Equal-amount keys carry the join; the date range is its residual."""
    n, e = new.alias("n"), existing.where("status <> 'duplicate'").alias("e")
    gap = F.abs(F.datediff("n.txn_date", "e.txn_date"))
    meet = (
        (F.col("n.account_id") == F.col("e.account_id"))
        & (F.col("n.amount_cents") == F.col("e.amount_cents"))
        & F.col("e.txn_date").between(F.date_sub("n.txn_date", window_days), F.date_add("n.txn_date", window_days))
    )
    pair = n.join(e, meet & (F.col("e.file") < F.col("n.file")) if earlier_file else meet)
    same_name = canonical_key(F.col(f"n.{name}")) == canonical_key(F.col(f"e.{name}"))
    both = F.col("n.balance_cents").isNotNull() & F.col("e.balance_cents").isNotNull()
    score = (
        F.when(~same_name | (both & (F.col("n.balance_cents") != F.col("e.balance_cents"))), 0.0)
        .when(gap == 0, F.when(both, 0.97).otherwise(0.93))
        .when(gap == 1, 0.72)
        .otherwise(0.58)
    )
    pair = pair.select("n.account_id", F.col("n.id").alias("new_id"), F.col("e.id").alias("existing_id"), gap.alias("gap_days"), score.alias("score"))
    return pair.where(F.col("score") >= KEEP).withColumn("verdict", F.when(F.col("score") >= HOLD, "held").otherwise("review"))


def top_verdict(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("account_id", "new_id").orderBy(F.desc("score"), "existing_id")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def settled(pairs: DataFrame, inside: DataFrame) -> DataFrame:
    """``pairs`` with ledger rows and those of ``inside`` pairs (rows of earlier files
    of the batch) that count: an existing row that is itself held does not.

    A row is held if a pair of at least ``HOLD`` is left to it. Whether its partner
    in the batch is held depends on earlier files only, so repeating the rule until
    nothing changes ends after as many rounds as files lie one behind the other;
    only pairs inside the batch take part.
    """
    key = ["account_id", "new_id"]
    by_ledger = written(pairs.where("verdict = 'held'").select(*key).distinct(), "held-by-ledger")
    sure = written(inside.where("verdict = 'held'").select(*key, "existing_id"), "sure-pairs")
    held, n_held = by_ledger, -1
    while True:
        off = held.select("account_id", F.col("new_id").alias("existing_id"))
        now = sure.join(off, ["account_id", "existing_id"], "left_anti").select(*key).unionByName(by_ledger).distinct()
        now = written(now, "held")
        n_now = now.count()
        same = n_now == n_held and now.join(held, key, "left_anti").isEmpty()
        held, n_held = now, n_now
        if same:
            break
    off = held.select("account_id", F.col("new_id").alias("existing_id"))
    return pairs.unionByName(inside.join(off, ["account_id", "existing_id"], "left_anti"))
