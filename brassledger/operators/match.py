"""Receipts and the ledger rows that paid for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..store import written

ACCEPT = 0.62


#: Outflows of one bucket or its neighbours hold all that the amount tolerance
#: (5 %, at least 200 cents) lets through: ln(c + 4000) then moves by under 0.06.
_STEP, _SHIFT = 0.06, 4000


def card_candidates(receipts: DataFrame, ledger: DataFrame, window: int = 4, tolerance: int = 200, claimed: DataFrame | None = None) -> DataFrame:
    """Scored (receipt, row) edges. Both sides meet on account and week, a receipt
    in each week that its window touches, or on account and amount bucket where
    the receipt has no date, so that busy accounts split. Receipts without a
    total have none. Rows that other receipts hold (``claimed``: txn_id) are left out.
    A card number on both sides that is the same adds to the score."""
    l = ledger.where("status = 'active' AND amount_cents < 0 AND is_cash_withdrawal = 0")
    if claimed is not None:
        l = l.join(claimed.where("txn_id IS NOT NULL").select(F.col("txn_id").alias("id")), "id", "left_anti")
    card = lambda df: F.col("card_last4") if "card_last4" in df.columns else F.lit(None).cast("string")
    l = l.select("account_id", F.col("id").alias("txn_id"), "txn_date", F.col("merchant_norm").alias("l_name"), (-F.col("amount_cents")).alias("cents"), card(ledger).alias("l_card"))
    r = receipts.where("total_cents > 0").select("account_id", "receipt_id", "receipt_date", "tender_type", "total_cents", "merchant_norm", card(receipts).alias("r_card"))
    week = lambda c: F.floor(F.unix_date(c) / 7)
    weeks = F.sequence(week(F.date_sub("receipt_date", 2)), week(F.date_add("receipt_date", window)))
    bucket = lambda c: F.floor(F.ln(F.col(c) + _SHIFT) / _STEP)
    buckets = F.sequence(bucket("total_cents") - 1, bucket("total_cents") + 1)
    dated = r.where("receipt_date IS NOT NULL").withColumn("at", F.explode(weeks)).join(l.withColumn("at", week("txn_date")), ["account_id", "at"])
    undated = r.where("receipt_date IS NULL").withColumn("at", F.explode(buckets)).join(l.withColumn("at", bucket("cents")), ["account_id", "at"])
    gap = F.datediff("txn_date", "receipt_date")
    off = F.abs(F.col("cents") - F.col("total_cents"))
    amount = F.when(off == 0, 0.55).when(off <= 100, 0.45).when(off <= F.greatest(F.lit(tolerance), 0.05 * F.col("total_cents")), 0.30)
    date = F.when(gap.isNull(), 0.05).when(gap == 0, 0.30).when(gap.between(1, window), 0.24 - 0.03 * gap).when(gap.between(-2, -1), 0.12)
    named = (F.coalesce("merchant_norm", F.lit("")) != "") & (F.coalesce("l_name", F.lit("")) != "")
    same_card = F.when(F.col("r_card") == F.col("l_card"), 0.15).otherwise(0.0)
    e = dated.unionByName(undated).withColumn("a", amount).withColumn("d", date).where("a IS NOT NULL AND d IS NOT NULL")
    e = e.withColumn("s", similarity(F.col("merchant_norm"), F.col("l_name"))).where(~named | (F.col("s") >= 0.25))
    score = F.round(F.least(F.lit(1.0), F.col("a") + F.col("d") + 0.3 * F.col("s") + same_card), 6)
    return e.select("account_id", "receipt_id", "receipt_date", "tender_type", "txn_id", score.alias("score")).where(F.col("score") >= ACCEPT)


def cash_candidates(receipts: DataFrame, ledger: DataFrame, look_back: int = 21) -> DataFrame:
    """(receipt, withdrawal) edges: withdrawals of the days before a receipt. The
    sides meet on account and week, as the busiest account may have many of both."""
    week = lambda c: F.floor(F.unix_date(c) / 7)
    w = ledger.where("status = 'active' AND is_cash_withdrawal = 1 AND amount_cents < 0").select(
        "account_id", F.col("id").alias("withdrawal_id"), "txn_date", (-F.col("amount_cents")).alias("withdrawn"), week("txn_date").alias("week")
    )
    r = receipts.select("account_id", "receipt_id", "receipt_date", "total_cents")
    r = r.withColumn("week", F.explode(F.sequence(week(F.date_sub("receipt_date", look_back)), week(F.col("receipt_date")))))
    e = r.join(w, ["account_id", "week"]).where(F.col("txn_date").between(F.date_sub("receipt_date", look_back), F.col("receipt_date")))
    return e.select("account_id", "receipt_id", "receipt_date", "total_cents", "withdrawal_id", "withdrawn", F.datediff("receipt_date", "txn_date").alias("days_before"))


def _mark(c: DataFrame, d: DataFrame) -> tuple:
    """What a round decided and left free, as sums: equal rounds have equal ones."""
    of = lambda df, *k: tuple(df.agg(F.sum(F.xxhash64(*k).cast("decimal(38,0)"))).first())
    return of(c, "receipt_id", "txn_id", "holder", "picked"), of(d, "receipt_id", "withdrawal_id", "cap", "amount_cents")


def assign(cards: DataFrame, cash: DataFrame, tenders: DataFrame) -> DataFrame:
    """Ledger rows and withdrawals for receipts, taken by (date, id), null dates first:
    (account_id, receipt_id, txn_id, withdrawal_id, score, amount_cents).

    A cash receipt draws on earlier withdrawals, nearest first, and looks for a
    card row if there is nothing to draw; one of unknown or voucher tender does
    it the other way round; all others take card rows only. A row is taken once
    and a withdrawal never beyond its amount.

    Nobody walks an account. In each round every receipt takes what it would take
    if earlier receipts took what they did in the round before: its best row that
    no earlier one has, and of each withdrawal what earlier ones leave. A receipt
    is right as soon as the earlier ones that it competes with are, so rounds end
    when nothing changes, after as many as the longest chain of competitors; what
    is unlike the walk before that is put right by then. Only edges take part, by
    receipt, row and withdrawal, never by account.
    """
    place = F.struct(F.coalesce(F.col("receipt_date").cast("string"), F.lit("")).alias("day"), F.col("receipt_id").alias("r"))
    c = cards.select("account_id", "receipt_id", place.alias("place"), F.coalesce("tender_type", F.lit("")).alias("tender"), "txn_id", "score")
    t = tenders.select("receipt_id", F.coalesce("tender_type", F.lit("")).alias("tender"))
    d = cash.join(t, "receipt_id").select("account_id", "receipt_id", place.alias("place"), "tender", "withdrawal_id", "total_cents", "withdrawn", "days_before")
    c = c.withColumn("holder", F.lit(None).cast("struct<day:string,r:bigint>")).withColumn("picked", F.lit(False))
    c = written(c, "card-round")
    d = written(d.withColumn("cap", F.col("withdrawn")).withColumn("amount_cents", F.lit(0).cast("long")), "cash-round")
    before = lambda by, *order: Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    mark, last = None, ()
    while mark != last:
        last = mark
        drawn = d.where("amount_cents > 0").select("receipt_id", F.lit(True).alias("drawn")).distinct()
        may = ((F.col("tender") != "cash") | F.col("drawn").isNull()) & (F.col("holder").isNull() | (F.col("place") <= F.col("holder")))
        first = F.row_number().over(Window.partitionBy("receipt_id").orderBy(F.desc("may"), F.desc("score"), "txn_id")) == 1
        asked = c.join(drawn, "receipt_id", "left").withColumn("may", may).withColumn("picked", first & F.col("may"))
        holder = F.min(F.when(F.col("picked"), F.col("place"))).over(Window.partitionBy("txn_id"))
        c = written(asked.withColumn("holder", holder).select(*c.columns), "card-round")
        carded = c.where("picked").select("receipt_id", F.lit(True).alias("carded"))
        draws = (F.col("tender") == "cash") | (F.col("tender").isin("unknown", "voucher") & F.col("carded").isNull())
        earlier = F.coalesce(F.sum("cap").over(before("receipt_id", "days_before", "withdrawal_id")), F.lit(0))
        take = F.when(F.col("draws"), F.greatest(F.lit(0), F.least(F.col("cap"), F.col("total_cents") - F.col("earlier")))).otherwise(0)
        taken = d.join(carded, "receipt_id", "left").withColumn("draws", draws).withColumn("earlier", earlier).withColumn("amount_cents", take)
        # What earlier receipts leave of each withdrawal, also for those that do not draw now.
        gone = F.coalesce(F.sum("amount_cents").over(before("withdrawal_id", "place")), F.lit(0))
        d = written(taken.withColumn("cap", F.greatest(F.lit(0), F.col("withdrawn") - gone)).select(*d.columns), "cash-round")
        mark = _mark(c, d)
    none = lambda kind: F.lit(None).cast(kind)
    by_card = c.where("picked").select("account_id", "receipt_id", "txn_id", none("long").alias("withdrawal_id"), "score", none("long").alias("amount_cents"))
    by_cash = d.where("amount_cents > 0").select("account_id", "receipt_id", none("long").alias("txn_id"), "withdrawal_id", none("double").alias("score"), "amount_cents")
    return by_card.unionByName(by_cash)


def link_receipts(receipts: DataFrame, ledger: DataFrame, claimed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(receipts with link_status, match_score and txn_id; cash allocations)."""
    tender = F.coalesce("tender_type", F.lit("unknown"))
    receipts = receipts.withColumn("tender_type", tender)
    columns = ["account_id", "id", "txn_date", "merchant_norm", "status", "is_cash_withdrawal", "amount_cents", *(["card_last4"] if "card_last4" in ledger.columns else [])]
    ledger, receipts = written(ledger.where("status = 'active' AND amount_cents < 0").select(*columns), "match-ledger"), written(receipts, "match-receipts")
    cash = cash_candidates(receipts.where("total_cents > 0 AND tender_type IN ('cash', 'unknown', 'voucher')"), ledger)
    found = written(assign(card_candidates(receipts, ledger, claimed=claimed), cash, receipts), "match-links")
    links = found.groupBy("receipt_id").agg(F.max("txn_id").alias("txn_id"), F.max("score").alias("score"), F.sum("amount_cents").alias("drawn"))
    r = receipts.join(links, "receipt_id", "left")
    status = F.when(F.col("txn_id").isNotNull(), "matched").when(F.col("drawn") > 0, "cash_allocated").otherwise("unmatched")
    score = F.coalesce("score", F.when(F.col("drawn") >= F.col("total_cents"), 0.8), F.when(F.col("drawn") > 0, 0.5))
    linked = r.select("account_id", "receipt_id", "receipt_date", "merchant_norm", "total_cents", "tender_type", status.alias("link_status"), "txn_id", score.alias("match_score"))
    return linked, found.where("amount_cents IS NOT NULL").select("account_id", "receipt_id", "withdrawal_id", "amount_cents")


def rematch(linked: DataFrame, ledger: DataFrame) -> DataFrame:
    """Links again what is not matched to a row; matched receipts keep their rows
    and ignored ones stay as they are."""
    again = linked.where("link_status IN ('unmatched', 'cash_allocated')")
    kept = linked.where("link_status NOT IN ('unmatched', 'cash_allocated')")
    new, _ = link_receipts(again.select("account_id", "receipt_id", "receipt_date", "merchant_norm", "total_cents", "tender_type"), ledger, kept)
    return kept.unionByName(new)


def same_slips(receipts: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of an account's receipts of one date and total with similar names:
    one slip that was stored twice. Ignored receipts do not count."""
    r = receipts.where("link_status <> 'ignored'") if "link_status" in receipts.columns else receipts
    a = r.select("account_id", "receipt_date", "total_cents", F.col("receipt_id").alias("first_id"), F.col("merchant_norm").alias("_a"))
    b = r.select("account_id", "receipt_date", "total_cents", F.col("receipt_id").alias("second_id"), F.col("merchant_norm").alias("_b"))
    p = a.join(b, ["account_id", "receipt_date", "total_cents"]).where("first_id < second_id")
    return p.where(similarity(F.col("_a"), F.col("_b")) >= least).drop("_a", "_b")


#: How near the best row came, by the number of its rank: what keeps it from being linked.
MISSES = ("nothing_near", "amount", "date", "name", "claimed")


def near_misses(linked: DataFrame, ledger: DataFrame, window: int = 4, tolerance: int = 200, reach: int = 31) -> DataFrame:
    """(receipt_id, reason, txn_id, off_cents, gap_days): why receipts stayed unmatched.

    ``linked`` holds all receipts with their link_status and txn_id. A receipt
    without a total has the reason ``no_total``. For each other one the best row
    that failed tells which test it failed: ``claimed`` (it would do, but another
    receipt has it), ``name`` (amount and date fit, but the names differ or the
    score stays too low), ``date`` (amount and name fit, up to ``reach`` days away),
    ``amount`` (the same name on a fitting day); else ``nothing_near``. Of several
    rows the nearest in amount, then in date, counts. Rows are found by account,
    amount bucket and month-long span, or by account, week and name, so that busy
    accounts split.
    """
    claimed = linked.where("link_status = 'matched' AND txn_id IS NOT NULL").select("txn_id", F.lit(True).alias("taken")).distinct()
    l = ledger.where("status = 'active' AND amount_cents < 0 AND is_cash_withdrawal = 0")
    l = l.select("account_id", F.col("id").alias("txn_id"), "txn_date", F.coalesce("merchant_norm", F.lit("")).alias("l_name"), (-F.col("amount_cents")).alias("cents"))
    l = l.join(claimed, "txn_id", "left")
    open_ = linked.where("link_status = 'unmatched'").select("account_id", "receipt_id", "receipt_date", "total_cents", F.coalesce("merchant_norm", F.lit("")).alias("r_name"))
    r = open_.where("total_cents > 0")
    bucket = lambda c: F.floor(F.ln(F.col(c) + _SHIFT) / _STEP)
    span = lambda c: F.floor(F.unix_date(c) / reach)
    week = lambda c: F.floor(F.unix_date(c) / 7)
    near = r.withColumn("b", F.explode(F.sequence(bucket("total_cents") - 1, bucket("total_cents") + 1)))
    rows = l.withColumn("b", bucket("cents"))
    spans = F.sequence(span(F.date_sub("receipt_date", reach)), span(F.date_add("receipt_date", reach)))
    dated = near.where("receipt_date IS NOT NULL").withColumn("s", F.explode(spans)).join(rows.withColumn("s", span("txn_date")), ["account_id", "b", "s"])
    undated = near.where("receipt_date IS NULL").join(rows, ["account_id", "b"])
    weeks = F.sequence(week(F.date_sub("receipt_date", 2)), week(F.date_add("receipt_date", window)))
    named = r.where("receipt_date IS NOT NULL AND r_name <> ''").withColumn("w", F.explode(weeks))
    named = named.join(l.withColumn("w", week("txn_date")).withColumn("r_name", F.col("l_name")), ["account_id", "w", "r_name"])
    columns = ["receipt_id", "receipt_date", "total_cents", "r_name", "txn_id", "txn_date", "l_name", "cents", "taken"]
    e = dated.select(columns).unionByName(undated.select(columns)).unionByName(named.select(columns))
    gap, off = F.datediff("txn_date", "receipt_date"), F.abs(F.col("cents") - F.col("total_cents"))
    e = e.withColumn("gap_days", gap).withColumn("off_cents", off)
    amount_fits = F.col("off_cents") <= F.greatest(F.lit(tolerance), 0.05 * F.col("total_cents"))
    date_fits = F.col("gap_days").isNull() | F.col("gap_days").between(-2, window)
    name_fits = (F.col("r_name") == "") | (F.col("l_name") == "") | (similarity(F.col("r_name"), F.col("l_name")) >= 0.25)
    e = e.withColumn("a", amount_fits).withColumn("d", date_fits).withColumn("n", name_fits)
    rank = (
        F.when(F.col("a") & F.col("d") & F.col("n") & F.coalesce("taken", F.lit(False)), 4)
        .when(F.col("a") & F.col("d"), 3)
        .when(F.col("a") & F.col("n") & (F.abs("gap_days") <= reach), 2)
        .when(F.col("d") & (F.col("r_name") == F.col("l_name")) & (F.col("r_name") != ""), 1)
    )
    e = e.withColumn("rank", rank).where("rank IS NOT NULL")
    better = F.struct("rank", -F.col("off_cents"), -F.coalesce(F.abs("gap_days"), F.lit(reach)), -F.col("txn_id"))
    best = e.groupBy("receipt_id").agg(F.max_by(F.struct("rank", "txn_id", "off_cents", "gap_days"), better).alias("m"))
    code = F.element_at(F.array(*map(F.lit, MISSES)), F.coalesce("m.rank", F.lit(0)) + 1)
    reason = F.when(F.col("total_cents").isNull() | (F.col("total_cents") <= 0), "no_total").otherwise(code)
    return open_.join(best, "receipt_id", "left").select("receipt_id", reason.alias("reason"), "m.txn_id", F.col("m.off_cents"), F.col("m.gap_days"))
