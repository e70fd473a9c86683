"""Changes to tables, each as a new version of the table.

Plain Parquet has no MERGE: an update is a join with ``when``, a delete an
anti-join, an upsert an anti-join and a union. ``versions`` keeps tables by month
and applies these changes to the months that they touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_key


def resolve_candidates(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply decisions (id, resolution 'duplicate' or 'distinct') to statuses; reversible."""
    d = decisions.select("id", "resolution")
    status = F.when(F.col("resolution") == "duplicate", "duplicate").when(F.col("resolution") == "distinct", "active").otherwise(F.col("status"))
    return ledger.join(d, "id", "left").withColumn("status", status).drop("resolution")


def undo_plan(ledger: DataFrame, receipts: DataFrame, allocations: DataFrame, candidates: DataFrame, by: str = "statement_id") -> DataFrame:
    """What undoing each statement would remove and unlink: its rows, receipts
    linked to them (txn_id), cash drawn on them (withdrawal_id) and suspected
    duplicates among them that wait for a decision (new_id). A statement with
    receipts or allocations is ``blocked``."""
    rows = ledger.select("id", by)
    count = lambda df, c, name: df.where(F.col(c).isNotNull()).select(F.col(c).alias("id")).join(rows, "id").groupBy(by).agg(F.count("*").alias(name))
    plan = ledger.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("amount_cents") < 0, -F.col("amount_cents"))), F.lit(0)).alias("out_cents"),
        F.coalesce(F.sum(F.when(F.col("amount_cents") > 0, F.col("amount_cents"))), F.lit(0)).alias("in_cents"),
    )
    for df, c, name in ((receipts, "txn_id", "n_receipts"), (allocations, "withdrawal_id", "n_allocations"), (candidates, "new_id", "n_pending")):
        plan = plan.join(count(df, c, name), by, "left")
    plan = plan.fillna(0, ["n_receipts", "n_allocations", "n_pending"])
    return plan.withColumn("blocked", (F.col("n_receipts") > 0) | (F.col("n_allocations") > 0))


def undo(tables: dict[str, DataFrame], statements: DataFrame, force: bool = False) -> dict[str, DataFrame]:
    """New versions of statements, transactions, receipts, allocations and
    candidates without the given statements. Statements with linked receipts or
    allocations stay unless ``force``."""
    t = tables["transactions"]
    gone = statements.select("statement_id").distinct()
    tx = t.join(gone, "statement_id", "left_semi").select("id", "statement_id")
    if not force:
        used = tables["receipts"].select(F.col("txn_id").alias("id")).union(tables["allocations"].select(F.col("withdrawal_id").alias("id")))
        blocked = tx.join(used, "id", "left_semi").select("statement_id").distinct()
        gone = gone.join(blocked, "statement_id", "left_anti")
        tx = tx.join(gone, "statement_id", "left_semi")
    ids = tx.select("id")
    cut = ids.select(F.col("id").alias("_gone"))
    receipts = tables["receipts"].join(cut, F.col("txn_id") == F.col("_gone"), "left")
    receipts = receipts.withColumn("txn_id", F.when(F.col("_gone").isNull(), F.col("txn_id"))).withColumn(
        "link_status", F.when(F.col("_gone").isNotNull(), "unmatched").otherwise(F.col("link_status"))
    ).drop("_gone")
    drop = lambda df, c: df.join(ids.withColumnRenamed("id", c), c, "left_anti")
    return {
        "statements": tables["statements"].join(gone, "statement_id", "left_anti"),
        "transactions": t.join(gone, "statement_id", "left_anti"),
        "receipts": receipts,
        "allocations": drop(tables["allocations"], "withdrawal_id"),
        "candidates": drop(drop(tables["candidates"], "new_id"), "existing_id"),
    }


def upsert_merchants(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Insert new canonical names; fill a default category only where there is none."""
    e, f = existing.alias("e"), found.alias("f")
    j = e.join(f, F.col("e.canonical") == F.col("f.canonical"), "full")
    return j.select(
        F.coalesce("e.canonical", "f.canonical").alias("canonical"),
        F.coalesce("e.merchant", "f.merchant").alias("merchant"),
        F.coalesce("e.default_category", "f.default_category").alias("default_category"),
    )


def accounts_with(existing: DataFrame, names: DataFrame) -> DataFrame:
    fresh = names.join(existing, "name", "left_anti").select("name").distinct()
    return existing.unionByName(fresh.withColumn("account_id", F.xxhash64("name")), allowMissingColumns=True)


def set_category(ledger: DataFrame, changes: DataFrame, rules: DataFrame, merchants: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Apply a user's categories (id, new_category): new versions of ledger, rules
    and merchants.

    The rows' category_source becomes 'user', so that no later run changes them.
    Each named merchant gives the account a rule of the highest priority, in place
    of its earlier one, and is the merchant's default category from now on
    (``merchants``: account_id, canonical, default_category).
    """
    old = F.col("category_source") if "category_source" in ledger.columns else F.lit("default")
    c = changes.select("id", "new_category")
    l = ledger.join(c, "id", "left").withColumn("category_source", F.when(F.col("new_category").isNotNull(), "user").otherwise(old))
    named = l.where("new_category IS NOT NULL AND merchant_norm IS NOT NULL AND merchant_norm NOT IN ('', 'Unknown')")
    l = l.withColumn("category", F.coalesce("new_category", "category")).drop("new_category")
    learned = named.groupBy("account_id", F.lower("merchant_norm").alias("pattern")).agg(
        F.max_by("new_category", "id").alias("category"), F.max_by("merchant_norm", "id").alias("merchant")
    )
    learned = learned.select(
        "account_id", F.xxhash64("account_id", "pattern").alias("rule_id"), F.lit(5).alias("priority"), F.lit("merchant").alias("field"),
        F.lit("contains").alias("match_type"), "pattern", "category", "merchant", F.lit("user").alias("source"),
    )
    if "account_id" not in rules.columns:
        rules = rules.withColumn("account_id", F.lit(None).cast("long"))
    kept = rules.join(learned.select("account_id", "pattern", "source"), ["account_id", "pattern", "source"], "left_anti").withColumn("rule_id", F.col("rule_id").cast("long"))
    if merchants is not None:
        mine = learned.select("account_id", canonical_key(F.col("merchant")).alias("canonical"), F.col("category").alias("_new")).dropDuplicates(["account_id", "canonical"])
        shared = merchants.where("account_id IS NULL").select("canonical").distinct()
        added = mine.join(shared, "canonical", "left_semi").join(merchants.where("account_id IS NOT NULL"), ["account_id", "canonical"], "left_anti")
        merchants = merchants.join(mine, ["account_id", "canonical"], "left").withColumn("default_category", F.coalesce("_new", "default_category")).drop("_new")
        merchants = merchants.unionByName(added.withColumnRenamed("_new", "default_category"), allowMissingColumns=True)
    return l, kept.unionByName(learned, allowMissingColumns=True), merchants


def ignore_receipts(receipts: DataFrame, allocations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    mark = ids.select("receipt_id", F.lit(True).alias("_off"))
    r = receipts.join(mark, "receipt_id", "left").withColumn("link_status", F.when(F.col("_off"), "ignored").otherwise(F.col("link_status"))).drop("_off")
    return r, allocations.join(ids.select("receipt_id"), "receipt_id", "left_anti")


def enrich(ledger: DataFrame, receipts: DataFrame) -> DataFrame:
    """Category and merchant from a matched receipt, where nobody and no rule has
    set the category (category_source unset or default) and where the merchant is
    unknown; amounts never change."""
    r = receipts.where("link_status = 'matched'").groupBy(F.col("txn_id").alias("id")).agg(
        F.min_by("merchant_norm", "receipt_id").alias("_m"), (F.min_by("category", "receipt_id") if "category" in receipts.columns else F.lit(None).cast("string")).alias("_c")
    )
    if "category_source" not in ledger.columns:
        known = F.coalesce("category", F.lit("Uncategorised")) != "Uncategorised"
        ledger = ledger.withColumn("category_source", F.when(known, "rule").otherwise("default"))
    take = F.col("_c").isNotNull() & F.coalesce("category_source", F.lit("unset")).isin("unset", "default")
    missing = F.col("merchant_norm").isNull() | F.col("merchant_norm").isin("", "Unknown")
    l = ledger.join(r, "id", "left").withColumn("_take", take)
    l = l.withColumn("category", F.when(F.col("_take"), F.col("_c")).otherwise(F.col("category")))
    l = l.withColumn("category_source", F.when(F.col("_take"), "receipt").otherwise(F.col("category_source")))
    return l.withColumn("merchant_norm", F.when(missing & F.col("_m").isNotNull(), F.col("_m")).otherwise(F.col("merchant_norm"))).drop("_m", "_c", "_take")


def correct_receipts(receipts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected fields (nulls leave the old value) make a receipt certain and
    unmatched, so that it is linked again."""
    fields = [c for c in corrections.columns if c != "receipt_id"]
    c = corrections.select("receipt_id", *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_changed"))
    j = receipts.join(c, "receipt_id", "left")
    for f in fields:
        j = j.withColumn(f, F.coalesce(f"_{f}", f))
    j = j.withColumn("link_status", F.when(F.col("_changed"), "unmatched").otherwise(F.col("link_status")))
    j = j.withColumn("confidence", F.when(F.col("_changed"), 1.0).otherwise(F.col("confidence")))
    return j.drop("_changed", *(f"_{f}" for f in fields))
