"""Reconciled period reports, always keyed by account.

Outflows are reported as positive cents. ``ledger`` has account_id, id, txn_date,
merchant_norm, category, is_cash_withdrawal, status, amount_cents and
balance_cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dims import type_label, with_category_facts


def merchant() -> Column:
    return F.coalesce(F.nullif("merchant_norm", F.lit("")), F.lit("Unknown"))


def category() -> Column:
    return F.coalesce("category", F.lit("Uncategorised"))


def outflows(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'active' AND amount_cents < 0")


def in_periods(ledger: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows of each account's periods; a row is in every period that holds it."""
    return ledger.join(periods, "account_id").where(F.col("txn_date").between(F.col("start"), F.col("end")))


def totals(ledger: DataFrame, *keys: str) -> DataFrame:
    active = F.col("status") == "active"
    amount = F.col("amount_cents")
    return ledger.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(active & (amount < 0), -amount)), F.lit(0)).alias("outflow_cents"),
        F.coalesce(F.sum(F.when(active & (amount > 0), amount)), F.lit(0)).alias("inflow_cents"),
        F.count(F.when(active, 1)).alias("n_rows"),
    )


def category_breakdown(ledger: DataFrame) -> DataFrame:
    """Per account and category: sum, count, largest, average and per-month
    amounts (truncated), and the share of the account's spend."""
    by = outflows(ledger).groupBy("account_id", category().alias("category")).agg(
        F.sum(-F.col("amount_cents")).alias("cents"), F.count("*").alias("n"), F.max(-F.col("amount_cents")).alias("largest_cents")
    )
    extent = ledger.groupBy("account_id").agg(((F.datediff(F.max("txn_date"), F.min("txn_date")) + 1) / 30.44).alias("months"))
    b = with_category_facts(by).join(extent, "account_id")
    spend = F.sum(F.when(~F.col("kind").isin("excluded", "income"), F.col("cents")).otherwise(0)).over(Window.partitionBy("account_id"))
    return b.select(
        "account_id", "category", "kind", "cents", "n", "largest_cents",
        (F.col("cents") / F.col("n")).cast("long").alias("average_cents"),
        (F.col("cents") / F.col("months")).cast("long").alias("monthly_cents"),
        F.round(F.when(spend > 0, F.col("cents") / spend).otherwise(0.0), 6).alias("share"),
    )


def reconciliation(ledger: DataFrame, allocations: DataFrame | None = None) -> DataFrame:
    """One row per account: spend split, cash, uncategorised, the residual of
    the breakdown against the ledger (0 if all is well) and warning codes."""
    o = with_category_facts(outflows(ledger).withColumn("category", category()))
    cents = -F.col("amount_cents")
    of = lambda cond: F.coalesce(F.sum(F.when(cond, cents)), F.lit(0))
    split = o.groupBy("account_id").agg(
        of(F.col("kind").isin("excluded", "income")).alias("excluded_cents"),
        of(F.col("kind") == "essential").alias("essential_cents"),
        of(F.col("kind").isin("discretionary", "cash")).alias("discretionary_cents"),
        of(F.col("is_cash_withdrawal") == 1).alias("cash_cents"),
        of(F.col("category") == "Uncategorised").alias("uncategorised_cents"),
    )
    held = ledger.where("status = 'duplicate'").groupBy("account_id").agg(
        F.count("*").alias("n_held"), F.sum(F.abs("amount_cents")).alias("held_cents")
    )
    t = totals(ledger, "account_id").join(split, "account_id", "left").join(held, "account_id", "left")
    if allocations is not None:
        t = t.join(allocations.groupBy("account_id").agg(F.sum("amount_cents").alias("explained_cents")), "account_id", "left")
    else:
        t = t.withColumn("explained_cents", F.lit(0).cast("long"))
    t = t.fillna(0)
    unexplained = F.greatest(F.lit(0), F.col("cash_cents") - F.col("explained_cents"))
    spend = F.col("outflow_cents") - F.col("excluded_cents")
    t = t.withColumn("spend_cents", spend).withColumn("unexplained_cash_cents", unexplained)
    t = t.withColumn(
        "residual_cents", F.col("excluded_cents") + F.col("essential_cents") + F.col("discretionary_cents") - F.col("outflow_cents")
    )
    explained = 1 - (F.col("unexplained_cash_cents") + F.col("uncategorised_cents")) / F.col("outflow_cents")
    codes = F.array_compact(
        F.array(
            F.when(F.col("residual_cents") != 0, "residual"),
            F.when(F.col("unexplained_cash_cents") > 0, "unexplained_cash"),
            F.when(F.col("uncategorised_cents") > 0.05 * F.col("outflow_cents"), "uncategorised"),
        )
    )
    return t.select(
        "account_id", "outflow_cents", "inflow_cents", (F.col("inflow_cents") - F.col("outflow_cents")).alias("net_cents"), "n_rows",
        "excluded_cents", "spend_cents", "essential_cents", "discretionary_cents", "cash_cents", "unexplained_cash_cents",
        "uncategorised_cents", "n_held", "held_cents", "residual_cents",
        F.round(F.when(F.col("outflow_cents") > 0, F.greatest(F.lit(0.0), explained)).otherwise(1.0), 6).alias("explained_share"),
        F.concat_ws(",", codes).alias("warnings"),
    )


def top_merchants(ledger: DataFrame, k: int = 40) -> DataFrame:
    """Each account's merchants by total, with the category of the largest row."""
    m = outflows(ledger).groupBy("account_id", merchant().alias("merchant")).agg(
        F.sum(-F.col("amount_cents")).alias("cents"),
        F.count("*").alias("n"),
        F.max(-F.col("amount_cents")).alias("largest_cents"),
        F.max_by(category(), F.struct(-F.col("amount_cents"), -F.col("id"))).alias("category"),
    )
    rank = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("cents"), "merchant"))
    return m.withColumn("rank", rank).where(F.col("rank") <= k)


def category_rollup(ledger: DataFrame, k: int = 3) -> DataFrame:
    """Each account's k largest categories, the rest as one, and each relative to the largest."""
    c = outflows(ledger).groupBy("account_id", category().alias("category")).agg(F.sum(-F.col("amount_cents")).alias("cents"))
    rank = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("cents"), "category"))
    c = c.withColumn("category", F.when(rank <= k, F.col("category")).otherwise("Everything else"))
    c = c.groupBy("account_id", "category").agg(F.sum("cents").alias("cents"))
    return c.withColumn("relative", F.round(F.col("cents") / F.max("cents").over(Window.partitionBy("account_id")), 6))


def type_breakdown(ledger: DataFrame) -> DataFrame:
    return (
        outflows(ledger)
        .groupBy("account_id", F.coalesce("txn_type", F.lit("other")).alias("txn_type"))
        .agg(F.sum(-F.col("amount_cents")).alias("cents"), F.count("*").alias("n"))
        .withColumn("label", type_label(F.col("txn_type")))
    )


def daily_series(ledger: DataFrame) -> DataFrame:
    return outflows(ledger).groupBy("account_id", "txn_date").agg(F.sum(-F.col("amount_cents")).alias("cents"), F.count("*").alias("n"))


def busy_days(ledger: DataFrame) -> DataFrame:
    part = Window.partitionBy("account_id")
    d = daily_series(ledger).withColumn("k", F.row_number().over(part.orderBy("cents"))).withColumn("m", F.count("*").over(part))
    upper = F.col("k") == F.floor(F.col("m") / 2) + 1  # the upper one of an even number
    return d.groupBy("account_id").agg(
        F.max_by("txn_date", F.struct("cents", F.negate(F.unix_date("txn_date")))).alias("busiest_day"),
        F.max("cents").alias("busiest_cents"),
        F.max(F.when(upper, F.col("cents"))).alias("typical_cents"),
    )


def monthly_trend(ledger: DataFrame, months: int = 6) -> DataFrame:
    """Each account's last calendar months to its data's end, in one pass; months
    without rows are 0."""
    l = with_category_facts(ledger.where("status = 'active'").withColumn("category", category()))
    out, amount = F.col("amount_cents") < 0, F.col("amount_cents")
    s = l.groupBy("account_id", F.trunc("txn_date", "month").alias("month")).agg(
        F.sum(F.when(out, -amount).otherwise(0)).alias("outflow_cents"),
        F.sum(F.when(~out, amount).otherwise(0)).alias("inflow_cents"),
        F.sum(F.when(out & ~F.col("kind").isin("excluded", "income"), -amount).otherwise(0)).alias("spend_cents"),
        F.sum(F.when(out & (F.col("kind") == "essential"), -amount).otherwise(0)).alias("essential_cents"),
    )
    last = l.groupBy("account_id").agg(F.trunc(F.max("txn_date"), "month").alias("last"))
    grid = last.select("account_id", F.explode(F.sequence(F.add_months("last", 1 - months), F.col("last"), F.expr("interval 1 month"))).alias("month"))
    return grid.join(s, ["account_id", "month"], "left").fillna(0)


def balance_check(ledger: DataFrame) -> DataFrame:
    """Do the running balances agree with the amounts, to 2 cents? Null if an
    account has fewer than two active rows with a balance."""
    b = ledger.where("status = 'active' AND balance_cents IS NOT NULL")
    order = F.struct("txn_date", "id")
    b = b.groupBy("account_id").agg(
        F.count("*").alias("n"),
        (F.min_by("balance_cents", order) - F.min_by("amount_cents", order)).alias("opening_cents"),
        F.max_by("balance_cents", order).alias("closing_cents"),
        F.sum("amount_cents").alias("moved_cents"),
    )
    diff = F.col("opening_cents") + F.col("moved_cents") - F.col("closing_cents")
    return b.withColumn("agrees", F.when(F.col("n") >= 2, F.abs(diff) <= 2))


def coverage(statements: DataFrame, periods: DataFrame) -> DataFrame:
    """Covered days and gaps of each account's period by its statements, which
    may overlap; ranges at most a day apart count as one."""
    s = statements.join(periods, "account_id").select(
        "account_id", "start", "end", F.greatest("period_start", "start").alias("a"), F.least("period_end", "end").alias("b")
    ).where("a <= b")
    w = Window.partitionBy("account_id", "start", "end").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("a") > F.date_add(reach, 1)), 1).otherwise(0)).over(w)
    merged = s.withColumn("island", island).groupBy("account_id", "start", "end", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    found = merged.groupBy("account_id", "start", "end").agg(
        F.sum(F.datediff("b", "a") + 1).alias("covered_days"), F.count("*").alias("n_ranges"), F.min("a").alias("first"), F.max("b").alias("last")
    )
    gaps = F.col("n_ranges") - 1 + (F.col("first") > F.col("start")).cast("long") + (F.col("last") < F.col("end")).cast("long")
    return found.select("account_id", "start", "end", "covered_days", (F.datediff("end", "start") + 1).cast("long").alias("total_days"), gaps.alias("n_gaps"))


def uncategorised_merchants(ledger: DataFrame) -> DataFrame:
    """Merchants whose outflows have no category, or are marked Uncategorised, with
    the first row's id and narration (where the ledger has narrations)."""
    o = outflows(ledger).where(category() == "Uncategorised")
    sample = [F.min_by("description_raw", "id").alias("sample")] if "description_raw" in ledger.columns else []
    return o.groupBy("account_id", merchant().alias("merchant")).agg(
        F.count("*").alias("n"), F.sum(-F.col("amount_cents")).alias("cents"), F.min("id").alias("example_id"), *sample
    )


def cash_revealed(allocations: DataFrame, receipts: DataFrame, ledger: DataFrame) -> DataFrame:
    """(account_id, category, cents): what cash slips say that withdrawals of the
    ledger (active ones) went on. Receipts without a category are Uncategorised."""
    drawn = ledger.where("status = 'active'").select(F.col("id").alias("withdrawal_id"))
    a = allocations.join(drawn, "withdrawal_id").join(receipts.select("receipt_id", category().alias("category")), "receipt_id")
    return a.groupBy("account_id", "category").agg(F.sum("amount_cents").alias("cents"))


def receipts_list(receipts: DataFrame, ledger: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Receipts of a link status (or all), newest first, with the row that paid."""
    r = receipts if status is None else receipts.where(F.col("link_status") == status)
    rows = ledger.select(F.col("id").alias("txn_id"), F.col("txn_date").alias("paid_date"), F.negate("amount_cents").alias("paid_cents"))
    found = r.join(rows, "txn_id", "left").orderBy(F.desc("receipt_date"), F.desc("receipt_id"))
    return found if limit is None else found.limit(limit)


def receipt_details(receipts: DataFrame, allocations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Receipts with their items as they stand, the ledger row that paid, and the
    withdrawals that they draw on, by date, as an array (some few a receipt)."""
    rows = ledger.select("id", "txn_date", F.negate("amount_cents").alias("cents"))
    drawn = allocations.join(rows.withColumnsRenamed({"id": "withdrawal_id", "txn_date": "drawn_on"}).drop("cents"), "withdrawal_id")
    drawn = drawn.groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("drawn_on", "withdrawal_id", "amount_cents"))).alias("allocations"))
    paid = rows.withColumnsRenamed({"id": "txn_id", "txn_date": "paid_date", "cents": "paid_cents"})
    return receipts.join(paid, "txn_id", "left").join(drawn, "receipt_id", "left")


def relative(found: DataFrame, value: str, by: str = "account_id") -> DataFrame:
    """Adds ``relative``: a row's value as a share of the largest one beside it, as
    bars of a chart show it; 0 where nothing is above 0."""
    most = F.max(value).over(Window.partitionBy(by))
    return found.withColumn("relative", F.when(most > 0, F.round(F.greatest(F.col(value), F.lit(0)) / most, 6)).otherwise(0.0))


def store_status(ledger: DataFrame, statements: DataFrame, receipts: DataFrame, pending: DataFrame) -> DataFrame:
    """One row an account: statements and their extent, rows by status, receipts,
    and suspected duplicates that wait for a decision."""
    st = statements.groupBy("account_id").agg(F.count("*").alias("n_statements"), F.min("period_start").alias("first_day"), F.max("period_end").alias("last_day"))
    of = lambda s: F.count_if(F.col("status") == s)
    l = ledger.groupBy("account_id").agg(of("active").alias("n_active"), of("duplicate").alias("n_duplicate"))
    n = lambda df, name: df.groupBy("account_id").agg(F.count("*").alias(name))
    t = l.join(st, "account_id", "full").join(n(receipts, "n_receipts"), "account_id", "full").join(n(pending, "n_pending"), "account_id", "full")
    return t.fillna(0, ["n_statements", "n_active", "n_duplicate", "n_receipts", "n_pending"])


def search(
    ledger: DataFrame, text: str = "", status: str = "active", direction: str = "out", limit: int = 250,
    category_is: str | None = None, merchant_is: str | None = None, start=None, end=None,
) -> DataFrame:
    """The newest rows that match, as a page of a ledger shows them."""
    l = ledger.where(F.col("status") == status)
    if direction in ("out", "in"):
        l = l.where(F.col("amount_cents") < 0 if direction == "out" else F.col("amount_cents") > 0)
    if text:
        names = [c for c in ("merchant_norm", "description_raw") if c in ledger.columns]
        hits = [F.contains(F.lower(c), F.lit(text.lower())) for c in names]
        l = l.where(F.greatest(*(F.coalesce(h, F.lit(False)) for h in hits)) if len(hits) > 1 else hits[0])
    if category_is is not None:
        l = l.where(category() == category_is)
    if merchant_is is not None:
        l = l.where(merchant() == merchant_is)
    if start is not None:
        l = l.where(F.col("txn_date").between(start, end))
    return l.orderBy(F.desc("txn_date"), F.desc("id")).limit(limit)


def default_period(ledger: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested period (account_id, start, end) where it has rows, else the data's extent."""
    used = in_periods(ledger, requested).select("account_id").distinct().withColumn("_used", F.lit(True))
    extent = ledger.groupBy("account_id").agg(F.min("txn_date").alias("first"), F.max("txn_date").alias("last"))
    j = extent.join(requested, "account_id", "left").join(used, "account_id", "left")
    return j.select("account_id", F.when(F.col("_used"), F.col("start")).otherwise(F.col("first")).alias("start"), F.when(F.col("_used"), F.col("end")).otherwise(F.col("last")).alias("end"))


def drill_down(ledger: DataFrame, name: str, receipts: DataFrame) -> DataFrame:
    """All outflows of one merchant, with how many receipts (txn_id) each has."""
    n = receipts.where("txn_id IS NOT NULL").groupBy(F.col("txn_id").alias("id")).agg(F.count("*").alias("n_receipts"))
    return outflows(ledger).where(merchant() == name).join(n, "id", "left").fillna(0, ["n_receipts"])


def completeness(ledger: DataFrame, statements: DataFrame, receipts: DataFrame, allocations: DataFrame, pending: DataFrame) -> DataFrame:
    """One row per account: does the ledger reconcile, do balances agree, which
    days are covered, what of the cash and the receipts is explained, and the
    codes of everything that is not. ``receipts`` are linked ones, ``pending``
    are duplicate candidates that nobody has decided on."""
    r = reconciliation(ledger, allocations).select("account_id", "residual_cents", "cash_cents", "unexplained_cash_cents", "explained_share", F.col("warnings").alias("base"))
    extent = ledger.groupBy("account_id").agg(F.min("txn_date").alias("start"), F.max("txn_date").alias("end"))
    days = coverage(statements, extent).select("account_id", "covered_days", "total_days", "n_gaps")
    of = lambda s: F.count_if(F.col("link_status") == s)
    slips = receipts.groupBy("account_id").agg(of("matched").alias("n_matched"), of("cash_allocated").alias("n_cash"), of("unmatched").alias("n_unmatched"))
    held = pending.groupBy("account_id").agg(F.count("*").alias("n_pending"))
    t = r.join(balance_check(ledger).select("account_id", "agrees"), "account_id", "left").join(days, "account_id", "left")
    t = t.join(slips, "account_id", "left").join(held, "account_id", "left").fillna(0, ["covered_days", "n_gaps", "n_matched", "n_cash", "n_unmatched", "n_pending"])
    codes = F.concat_ws(
        ",", F.nullif(F.col("base"), F.lit("")), F.when((F.col("n_gaps") > 0) | F.col("total_days").isNull(), "coverage_gaps"), F.when(~F.col("agrees"), "balances"),
        F.when(F.col("n_pending") > 0, "pending_duplicates"), F.when(F.col("n_unmatched") > 0, "unmatched_receipts"),
    )
    return t.select(
        "account_id", (F.col("residual_cents") == 0).alias("reconciles"), F.col("agrees").alias("balances_agree"), "covered_days", "total_days", "cash_cents",
        (F.col("cash_cents") - F.col("unexplained_cash_cents")).alias("cash_explained_cents"), "n_matched", "n_cash", "n_unmatched", "n_pending", "explained_share", codes.alias("warnings"),
    )


def cash_reclassified(ledger: DataFrame, revealed: DataFrame) -> DataFrame:
    """Category totals after cash slips (account_id, category, cents) move their
    part out of Cash Withdrawals; an account's total does not change."""
    c = outflows(ledger).groupBy("account_id", category().alias("category")).agg(F.sum(-F.col("amount_cents")).alias("cents"))
    cash = c.where("category = 'Cash Withdrawals'").select("account_id", F.col("cents").alias("cash"))
    r = revealed.join(cash, "account_id")
    total = F.sum("cents").over(Window.partitionBy("account_id"))
    r = r.withColumn("moved", F.floor(F.col("cents") * F.least(F.lit(1.0), F.col("cash") / total)).cast("long"))
    plus = r.select("account_id", "category", F.col("moved").alias("cents"))
    minus = r.groupBy("account_id").agg((-F.sum("moved")).alias("cents")).select("account_id", F.lit("Cash Withdrawals").alias("category"), "cents")
    return c.unionByName(plus).unionByName(minus).groupBy("account_id", "category").agg(F.sum("cents").alias("cents")).where("NOT (category = 'Cash Withdrawals' AND cents <= 0)")


def report_json(breakdown: DataFrame, reconciled: DataFrame) -> DataFrame:
    """(account_id, report): each account's reconciliation row with its category
    lines, largest first, as one JSON text; amounts stay in cents."""
    line = F.struct(F.negate("cents").alias("_order"), "category", "kind", "cents", "n", "share")
    lines = breakdown.groupBy("account_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # some 40 categories
    lines = lines.withColumn("categories", F.transform("lines", lambda x: x.dropFields("_order"))).drop("lines")
    j = reconciled.join(lines, "account_id", "left")
    return j.select("account_id", F.to_json(F.struct(*reconciled.columns, "categories")).alias("report"))
