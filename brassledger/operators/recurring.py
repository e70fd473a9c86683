"""Recurring charges, price creep and category spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: cadence | days from | days to | times a year ---
CADENCES = (("weekly", 5, 9, 52), ("fortnightly", 11, 18, 26), ("monthly", 25, 36, 12), ("quarterly", 80, 100, 4), ("annual", 350, 380, 1))


def cadence(gap: Column) -> Column:
    out = F.lit("irregular")
    for name, a, b, _ in CADENCES:
        out = F.when(gap.between(a, b), name).otherwise(out)
    return out


def recurring(ledger: DataFrame, min_count: int = 3) -> DataFrame:
    """Charges of a regular cadence per (account, merchant), over active rows.

    The gap is the true median of the days between charges (same-day repeats
    dropped), the typical amount the upper median. The newest active row of the
    account, of whatever kind, decides what looks cancelled. ``rank`` orders an
    account's charges by what they cost a year.
    """
    active = ledger.where("status = 'active'")
    newest = active.groupBy("account_id").agg(F.max("txn_date").alias("newest"))
    l = active.where("amount_cents < 0 AND merchant_norm IS NOT NULL").withColumn("cents", -F.col("amount_cents"))
    part = Window.partitionBy("account_id", "merchant_norm")
    l = l.withColumn("gap", F.datediff("txn_date", F.lag("txn_date").over(part.orderBy("txn_date", "id"))))
    g = l.groupBy("account_id", "merchant_norm").agg(
        F.count("*").alias("n"),
        F.sum("cents").alias("total_cents"),
        F.min("txn_date").alias("first_date"),
        F.max("txn_date").alias("last_date"),
        F.count(F.when(F.col("gap") > 0, 1)).alias("n_gaps"),
        F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("gap"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY cents DESC)").cast("long").alias("typical_cents"),  # the upper median
        (F.max("cents") - F.min("cents")).alias("range_cents"),
        F.coalesce(F.min_by("category", F.struct("txn_date", "id")), F.lit("Uncategorised")).alias("category"),
    )
    g = g.where((F.col("n") >= min_count) & (F.col("n_gaps") >= min_count - 1)).withColumn("cadence", cadence(F.col("gap")))
    g = g.where("cadence <> 'irregular'").join(newest, "account_id")
    g = g.withColumn("active", F.datediff("newest", "last_date") / F.col("gap") <= 1.6)
    per_year = F.lit(0)
    for name, _, _, times in CADENCES:
        per_year = F.when(F.col("cadence") == name, times).otherwise(per_year)
    spread = F.col("range_cents") / F.col("typical_cents")
    tight = F.col("cadence").isin("monthly", "quarterly")
    varies = spread > F.when(tight, 0.35).otherwise(0.6)
    annual = (F.col("typical_cents") * per_year).cast("long")
    g = g.select(
        "account_id", "merchant_norm", "category", "n", "total_cents", "first_date", "last_date", F.round("gap", 6).alias("gap_days"),
        "typical_cents", "cadence", "active", varies.alias("varies"), annual.alias("annual_cents"),
        F.floor(annual / 12).cast("long").alias("monthly_cents"),
        (F.col("cadence").isin("monthly", "quarterly", "annual") & ~varies).alias("subscription"),
    )
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("annual_cents"), "merchant_norm")))


def commitments(found: DataFrame) -> DataFrame:
    on = F.col("active")
    return found.groupBy("account_id").agg(
        F.count(F.when(on, 1)).alias("n_active"),
        F.count(F.when(~on, 1)).alias("n_cancelled"),
        F.coalesce(F.sum(F.when(on, F.col("monthly_cents"))), F.lit(0)).alias("monthly_cents"),
        F.coalesce(F.sum(F.when(on, F.col("annual_cents"))), F.lit(0)).alias("annual_cents"),
    )


def price_creep(ledger: DataFrame, min_rise_share: float = 0.10, min_rise: int = 1000) -> DataFrame:
    """Merchants whose later half of active charges costs at least a tenth more."""
    part = Window.partitionBy("account_id", "merchant_norm")
    l = ledger.where("status = 'active' AND amount_cents < 0").withColumn("cents", -F.col("amount_cents"))
    l = l.withColumn("k", F.row_number().over(part.orderBy("txn_date", "id"))).withColumn("n", F.count("*").over(part))
    early = F.col("k") <= F.floor(F.col("n") / 2)
    g = l.where("n >= 4").groupBy("account_id", "merchant_norm").agg(
        F.count("*").alias("n"), F.avg(F.when(early, F.col("cents"))).alias("old"), F.avg(F.when(~early, F.col("cents"))).alias("new")
    )
    rise = F.col("new") - F.col("old")
    g = g.where((rise / F.col("old") >= min_rise_share) & (rise >= min_rise))
    return g.select("account_id", "merchant_norm", "n", F.round("old", 4).alias("old_cents"), F.round("new", 4).alias("new_cents"))


def spikes(ledger: DataFrame, ratio: float = 1.4, least: int = 20000, months: int = 6) -> DataFrame:
    """Categories whose latest month is well above the mean of the earlier ones of
    the account's last ``months`` calendar months, counted from the category's first
    month there; months without rows are 0."""
    l = ledger.where("status = 'active' AND amount_cents < 0").withColumn("category", F.coalesce("category", F.lit("Uncategorised")))
    m = l.groupBy("account_id", "category", F.trunc("txn_date", "month").alias("month")).agg(F.sum(-F.col("amount_cents")).alias("cents"))
    m = m.withColumn("last", F.max("month").over(Window.partitionBy("account_id"))).where(F.col("month") > F.add_months("last", -months))
    ends = m.groupBy("account_id", "category").agg(F.min("month").alias("first"), F.max("last").alias("last"))
    grid = ends.select("account_id", "category", "last", F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month"))
    s = grid.join(m.drop("last"), ["account_id", "category", "month"], "left").fillna(0, ["cents"])
    now = F.col("month") == F.col("last")
    s = s.groupBy("account_id", "category").agg(
        F.count("*").alias("n_months"), F.sum(F.when(now, F.col("cents"))).alias("latest_cents"), F.avg(F.when(~now, F.col("cents"))).alias("mean")
    )
    s = s.where((F.col("n_months") >= 3) & (F.col("mean") > 0) & (F.col("latest_cents") > ratio * F.col("mean")) & (F.col("latest_cents") - F.col("mean") >= least))
    return s.select("account_id", "category", "n_months", "latest_cents", F.round("mean", 4).alias("mean_cents"))
