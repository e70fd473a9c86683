"""Receipts from structured payloads and from plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.money import parse_amount, to_cents
from ..functions.text import canonical_key
from ..operators.match import same_slips
from ..operators.mutate import upsert_merchants
from ..store import written

PAYLOAD = (
    "merchant string, date string, time string, total string, vat string, tender_type string, card_last4 string, confidence string, "
    "items array<struct<description string, quantity string, unit_price string, line_total string>>"
)
# --- fixed values ---
TENDERS = ("cash", "card", "eft", "voucher", "unknown")
TOTAL_LABELS = ("amount due", "balance due", "total due", "grand total", "total incl", "total inc", "total amount", "total", "te betaal", "verskuldig")
DECOYS = ("subtotal", "sub total", "sub-total", "tendered", "cash", "change", "rounding", "vat", "tax", "discount", "saving", "balance", "loyalty", "points")
AMOUNT = r"(?<![\d.,])(\d{1,3}(?:[ ,]\d{3})*[.,]\d{2}|\d+[.,]\d{2})(?!\d)"
DATE = r"\b(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}[/.-]\d{1,2}[/.-]\d{1,2})\b"


def from_payload(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Typed receipts; items without a description are dropped, and a total
    that differs from its lines by more than 200 cents is flagged."""
    p = rows.withColumn("p", F.from_json(column, PAYLOAD))
    cents = lambda c: to_cents(parse_amount(c))
    items = F.transform(
        F.filter(F.col("p.items"), lambda i: F.trim(F.coalesce(i["description"], F.lit(""))) != ""),
        lambda i: F.struct(
            F.trim(i["description"]).alias("description"), i["quantity"].try_cast("double").alias("quantity"),
            cents(i["unit_price"]).alias("unit_price_cents"), cents(i["line_total"]).alias("line_total_cents"),
        ),
    )
    tender = F.lower(F.trim("p.tender_type"))
    last4 = F.regexp_replace("p.card_last4", r"\D", "")
    sure = F.lower(F.trim("p.confidence"))
    r = p.select(
        *rows.columns,
        F.nullif(F.trim("p.merchant"), F.lit("")).alias("merchant"),
        parse_date(F.col("p.date"), F.lit(True)).alias("receipt_date"),
        cents(F.col("p.total")).alias("total_cents"),
        cents(F.col("p.vat")).alias("vat_cents"),
        F.when(tender.isin(*TENDERS), tender).otherwise("unknown").alias("tender_type"),
        F.when(F.length(last4) >= 4, F.right(last4, F.lit(4))).alias("card_last4"),
        F.when(sure == "high", 0.9).when(sure == "medium", 0.65).when(sure == "low", 0.35).otherwise(0.5).alias("confidence"),
        F.coalesce(items, F.array()).alias("items"),
    )
    lines = F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + F.coalesce(i["line_total_cents"], F.lit(0)))
    return r.withColumn("inconsistent", (F.size("items") > 0) & (F.abs(F.col("total_cents") - lines) > 200))


def from_text(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Merchant, date, time, total and tender of each text, by its lines."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    low = F.lower("line")
    label = F.lit(None).cast("int")
    for i, w in reversed(list(enumerate(TOTAL_LABELS))):
        label = F.when(F.contains(low, F.lit(w)), i).otherwise(label)
    decoy = F.lit(False)
    for w in DECOYS:
        decoy = decoy | F.contains(low, F.lit(w))
    clear = F.lit(False)
    for w in TOTAL_LABELS[:7]:
        clear = clear | F.contains(low, F.lit(w))
    found = F.transform(F.regexp_extract_all("line", F.lit(AMOUNT)), lambda a: to_cents(parse_amount(a)))
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    dated = F.regexp_extract("line", DATE, 1)
    lines = lines.select(
        "id", "n", "line", F.when(~decoy | clear, label).alias("label"), F.array_max(found).alias("most"), F.nullif(dated, F.lit("")).alias("dated"),
        F.nullif(F.regexp_extract("line", r"\b((?:[01]?\d|2[0-3]):[0-5]\d)\b", 1), F.lit("")).alias("clock"),
        F.when(low.rlike(r"\b(visa|mastercard|debit|credit|card)\b"), "card").when(low.rlike(r"\bcash\b"), "cash").alias("tender"),
        ((F.col("n") < 8) & (letters >= 0.5 * F.length("line")) & (letters > 0) & (F.size(found) == 0) & (dated == "")).alias("name"),
    )
    labelled = F.when(F.col("label").isNotNull() & F.col("most").isNotNull(), F.struct("label", "n"))
    r = lines.groupBy("id").agg(
        F.min_by("line", F.when(F.col("name"), F.col("n"))).alias("merchant"),
        F.min_by("dated", F.when(F.col("dated").isNotNull(), F.col("n"))).alias("dated"),
        F.min_by("clock", F.when(F.col("clock").isNotNull(), F.col("n"))).alias("receipt_time"),
        F.min_by("tender", F.when(F.col("tender").isNotNull(), F.col("n"))).alias("tender_type"),
        F.min_by("most", labelled).alias("total"),
        F.max("most").alias("largest"),
    )
    return r.select(
        "id", F.trim("merchant").alias("merchant"), parse_date(F.col("dated"), F.lit(True)).alias("receipt_date"), "receipt_time",
        F.coalesce("tender_type", F.lit("unknown")).alias("tender_type"), F.coalesce("total", "largest").alias("total_cents"),
        F.when(F.col("total").isNotNull(), 0.6).when(F.col("largest").isNotNull(), 0.25).alias("confidence"),
    )


def stored(new: DataFrame, known: DataFrame, merchants: DataFrame) -> DataFrame:
    """Receipts of ``new`` (from_payload's columns, account_id, sha256 of the image)
    that no receipt of ``known`` has the image of, each image once, with the
    default category of its merchant and the codes of what looks wrong."""
    fresh = new.join(known.select("sha256").distinct(), "sha256", "left_anti")
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("receipt_id"))
    fresh = fresh.withColumn("_n", first).where("_n = 1 OR sha256 IS NULL").drop("_n")
    fresh = fresh.withColumn("canonical", canonical_key(F.col("merchant"))).join(merchants.select("canonical", F.col("default_category").alias("category")), "canonical", "left")
    shape = lambda df: df.select("account_id", "receipt_id", "receipt_date", "total_cents", F.col("merchant").alias("merchant_norm"))
    twice = same_slips(shape(fresh).union(shape(known)))
    twice = twice.select(F.explode(F.array("first_id", "second_id")).alias("receipt_id")).distinct().withColumn("_twice", F.lit(True))
    codes = F.concat_ws(
        ",", F.when(F.col("total_cents").isNull(), "no_total"), F.when(F.col("inconsistent"), "lines_differ"), F.when(F.col("confidence") < 0.5, "low_confidence"),
        F.when(F.col("_twice"), "same_slip"),
    )
    return fresh.join(twice, "receipt_id", "left").withColumn("warnings", codes).drop("_twice", "canonical")


def items_of(receipts: DataFrame) -> DataFrame:
    """The receipts' lines as a table of their own, numbered from 0."""
    lines = receipts.select("receipt_id", F.posexplode("items").alias("line_no", "i"))
    return lines.select("receipt_id", "line_no", "i.description", "i.quantity", "i.unit_price_cents", "i.line_total_cents")


def store(new: DataFrame, known: DataFrame, merchants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(receipts, their items, merchants) that a batch of ``new`` ones leaves behind:
    what ``stored`` keeps, and the merchants (canonical, merchant, default_category)
    with the names that are new; a known merchant stays as it is."""
    kept = written(stored(new, known, merchants), "stored-receipts")
    named = kept.where("merchant IS NOT NULL").select(canonical_key(F.col("merchant")).alias("canonical"), "merchant", "receipt_id").where("canonical <> ''")
    named = named.groupBy("canonical").agg(F.min_by("merchant", "receipt_id").alias("merchant")).withColumn("default_category", F.lit(None).cast("string"))
    return kept, items_of(kept), upsert_merchants(merchants, named)
