"""Statement files: text to grid to layout to typed rows and a quarantine."""

from __future__ import annotations

import csv
import io
import itertools
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.money import parse_amount, to_cents
from ..shipping import ship
from ..store import beside, many_files, written

# --- fixed values: header words of each column role, most specific first ---
ROLES = {
    "balance": ("runningbalance", "closingbalance", "balanceafter", "availablebalance", "balance", "saldo"),
    "debit": ("debitamount", "debitszar", "moneyout", "amountout", "withdrawal", "withdrawals", "paidout", "payments", "debits", "debit", "dr"),
    "credit": ("creditamount", "creditszar", "moneyin", "amountin", "deposit", "deposits", "paidin", "receipts", "credits", "credit", "cr"),
    "amount": ("transactionamount", "amountzar", "amountinzar", "amount", "value", "bedrag", "trnamount", "signedamount"),
    "txn_date": (
        "transactiondate", "transdate", "txndate", "valuedate", "effectivedate", "dateprocessed", "processdate", "postingdate", "posteddate",
        "actiondate", "date", "datum", "trndate", "bookingdate",
    ),
    "posted_date": ("postingdate", "posteddate", "processdate", "captureddate"),
    "direction": ("debitcredit", "drcr", "type", "transactiontype", "indicator", "sign"),
    "card": ("cardnumber", "cardlast4", "card"),
    "description": (
        "transactiondescription", "transactiondetails", "transactionremarks", "description1", "description2", "description3", "description",
        "narrative", "narration", "details", "detail", "particulars", "reference", "yourreference", "theirreference", "memo", "payee",
        "beneficiary", "merchant", "transaction", "remarks", "beskrywing",
    ),
}
FEES = ("fee", "servicefee", "charge", "charges")
DELIMITERS = (",", ";", "\t", "|")
OUT_WORDS, IN_WORDS = ("d", "dr", "debit", "db", "withdrawal", "payment", "out", "-"), ("c", "cr", "credit", "deposit", "in", "+")
# --- end of fixed values ---

#: The characters in which the two 8-bit encodings differ.
_C1 = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_LATIN, _WINDOWS = _C1.decode("latin-1"), _C1.decode("cp1252")

HEAD_LINES, HEADER_ROWS, SAMPLE_ROWS = 60, 30, 50
#: Rows of a file whose dates tell whether the day comes first.
DATE_ROWS = 200
#: Characters of a line that the choice of a delimiter looks at.
HEAD_CHARS = 2000
#: Records of one batch that leaves a Python worker.
BATCH = 2000

_RECORDS = "file string, sha256 string, line_no int, line string, cells array<string>"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, line_no, line, cells) of every record of the files under ``path``.

    UTF-8 with or without a mark, else Windows-1252, or ISO-8859-1 where a byte
    has no meaning there.
    """
    with many_files(spark):
        return lines_of(spark.read.format("binaryFile").load(path))


def lines_of(raw: DataFrame) -> DataFrame:
    """The same for files that are read already (path, content), written once, as
    headers, layouts and rows all look at it. A record is a line, or several where
    quotes hold line breaks; ``line`` is its text as it stands in the file."""
    ship(raw.sparkSession)
    latin = F.decode("content", "ISO-8859-1")
    windows = F.when(latin.rlike("[\x81\x8d\x8f\x90\x9d]"), latin).otherwise(F.translate(latin, _LATIN, _WINDOWS))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(windows)
    texts = raw.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.regexp_replace(text, "^\ufeff", "").alias("text"))
    return written(texts.mapInArrow(_records, _RECORDS), "statement-records")


def delimiter_of(text: str) -> str:
    """The delimiter that a sniffer finds in the first lines, else the one that gives
    the most of them one count, a frequent count being worth more."""
    head = [line[:HEAD_CHARS] for line in itertools.islice(io.StringIO(text, newline=None), HEAD_LINES)]
    try:
        return csv.Sniffer().sniff("".join(head), delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        pass
    scores = {}
    for d in DELIMITERS:
        counts = Counter(line.count(d) for line in head if line.strip())
        usual = min(counts, key=lambda k: (-counts[k], -k), default=0)
        scores[d] = counts[usual] * usual
    return max(DELIMITERS, key=lambda d: scores[d])  # the first one, should none occur


def records(text: str) -> Iterator[tuple[str, list[str]]]:
    """(line, trimmed cells) of each record of a file, one after the other."""
    csv.field_size_limit(sys.maxsize)
    read: list[str] = []

    def lines() -> Iterator[str]:
        for line in io.StringIO(text, newline=""):
            read.append(line)
            yield line

    for cells in csv.reader(lines(), delimiter=delimiter_of(text)):
        yield "".join(read).rstrip("\r\n"), [c.strip() for c in cells]
        read.clear()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema({"file": pa.string(), "sha256": pa.string(), "line_no": pa.int32(), "line": pa.string(), "cells": pa.list_(pa.string())}.items())
    # Files are short, and a batch costs as much as many records: one holds those of many files.
    found = (
        (file, digest, n, line, cells)
        for batch in batches
        for file, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for n, (line, cells) in enumerate(records(text or ""))
    )
    while some := list(itertools.islice(found, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds.types, strict=True)], schema=kinds)


def header_rows(g: DataFrame, spark: SparkSession) -> DataFrame:
    """(file, header_line): the best-scoring of a file's first rows, if it scores."""
    words = spark.createDataFrame([(r, w) for r, ws in (*ROLES.items(), ("fees", FEES)) for w in ws], "role string, word string")
    lines = g.where((F.col("line_no") < HEADER_ROWS) & (F.size("cells") >= 2)).select("file", "line_no", "cells")
    cells = lines.select("file", "line_no", F.explode(F.transform("cells", lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))).alias("key"))
    # Each key with a letter, as every word has one, meets the words once, however many cells hold it.
    cells = cells.where(F.col("key").rlike("[a-z]"))
    hit = cells.select("key").distinct().join(F.broadcast(words), (F.col("key") == F.col("word")) | ((F.length("word") > 3) & F.contains("key", F.col("word"))))
    by_key = hit.groupBy("key").agg(
        F.max(F.when(F.col("key") == F.col("word"), 2).otherwise(1)).alias("points"),
        F.max((F.col("role") == "txn_date").cast("int")).alias("date"),
        F.max(F.col("role").isin("amount", "debit", "credit").cast("int")).alias("money"),
    )
    # A line without a word cannot score.
    by_line = cells.join(beside(by_key), "key").groupBy("file", "line_no").agg(F.sum("points").alias("points"), F.max("date").alias("date"), F.max("money").alias("money"))
    number = lambda c: ~c.rlike("[A-Za-z]") & parse_amount(c).isNotNull()
    score = F.col("points") - 1.5 * F.size(F.filter("cells", number)) - 3 * (1 - F.col("date")) - 3 * (1 - F.col("money"))
    rows = lines.join(by_line, ["file", "line_no"]).select("file", "line_no", score.alias("score")).where("score > 0.5")
    return written(rows.groupBy("file").agg(F.max_by("line_no", F.struct("score", -F.col("line_no"))).alias("header_line")), "header-lines")


_ROLE_COLUMNS = tuple(r for r in ROLES if r != "description")


def _assign(keys: list[str]) -> dict:
    """Roles claim columns of one header in a fixed order, exact words first."""
    cells = {p: k for p, k in enumerate(keys) if k}
    taken, got = set(), {}
    for role, words in ROLES.items():
        for exact in (True, False):
            if role in got:
                break
            for w in words:
                found = [p for p, k in sorted(cells.items()) if p not in taken and (k == w if exact else len(w) >= 4 and w in k)]
                if found and (role == "description" or role not in got):
                    got.setdefault(role, []).extend(found if role == "description" else found[:1])
                    taken.update(got[role])
    row = {"descriptions": sorted(got.get("description", []))} | {r: got[r][0] if r in got else None for r in _ROLE_COLUMNS}
    return row | {"confidence": min(1.0, len(got.keys() & {"txn_date", "amount", "debit", "credit", "balance", "description"}) / 4)}


_LAYOUT = "file string, descriptions array<int>, " + ", ".join(f"{r} int" for r in _ROLE_COLUMNS) + ", confidence double, header_line int"


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The layout of each header (file, header_line, keys)."""
    kinds = {"file": pa.string(), "descriptions": pa.list_(pa.int32())} | dict.fromkeys(_ROLE_COLUMNS, pa.int32()) | {"confidence": pa.float64(), "header_line": pa.int32()}
    for batch in batches:
        rows = [{"file": r["file"], "header_line": r["header_line"]} | _assign(r["keys"]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))


def layouts(g: DataFrame, spark: SparkSession) -> DataFrame:
    """Column roles per file, from its header or, without one, from its values."""
    ship(spark)
    heads = header_rows(g, spark)
    top = g.where(F.col("line_no") < HEADER_ROWS).select("file", F.col("line_no").alias("header_line"), "cells").join(heads, ["file", "header_line"])
    keys = F.transform("cells", lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))
    found = top.select("file", "header_line", keys.alias("keys")).mapInArrow(_assigned, _LAYOUT)
    bare = g.join(heads, "file", "left_anti").where((F.col("line_no") < SAMPLE_ROWS) & (F.size("cells") >= 2))
    v = bare.select("file", F.posexplode("cells").alias("pos", "cell"))
    date, number = parse_date(F.col("cell"), F.lit(True)).isNotNull(), parse_amount(F.col("cell")).isNotNull() & ~F.col("cell").rlike("[A-Za-z]")
    v = v.groupBy("file", "pos").agg(F.count("*").alias("n"), F.count_if(date).alias("d"), F.count_if(number).alias("m"), F.avg(F.length("cell")).alias("w"))
    enough = F.greatest(F.lit(2), 0.8 * F.col("n"))
    is_date, is_num = F.col("d") >= enough, (F.col("m") >= enough) & (F.col("d") < enough)
    v = v.groupBy("file").agg(
        F.array_sort(F.collect_list(F.when(is_date, F.col("pos")))).alias("dates"),
        F.array_sort(F.collect_list(F.when(is_num, F.col("pos")))).alias("nums"),
        F.max_by("pos", F.when(~is_date & ~is_num, F.col("w"))).alias("text"),
    )
    k = F.size("nums")
    v = v.where("size(dates) > 0 AND size(nums) > 0").select(
        "file", F.array("text").alias("descriptions"), F.when(k > 1, F.element_at("nums", -1)).alias("balance"), F.lit(None).cast("int").alias("debit"),
        F.lit(None).cast("int").alias("credit"), F.element_at("nums", F.when(k > 1, -2).otherwise(-1)).alias("amount"),
        F.element_at("dates", 1).alias("txn_date"), F.try_element_at("dates", F.lit(2)).alias("posted_date"),
        F.lit(None).cast("int").alias("direction"), F.lit(None).cast("int").alias("card"), F.lit(0.4).alias("confidence"), F.lit(-1).alias("header_line"),
    )
    return found.unionByName(v)


PROFILE = (
    "profile string, txn_date int, posted_date int, amount int, debit int, credit int, balance int, direction int, card_last4 int, description array<int>, "
    "outflow_is_negative boolean, dayfirst boolean"
)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Named profiles (``PROFILE``) from a JSON file: an object of profiles by name,
    alone or under ``profiles``. What is not JSON holds none."""
    whole = spark.read.text(path, wholetext=True)
    outer = F.from_json("value", "map<string,string>")
    inner = F.from_json(F.coalesce(F.try_element_at(outer, F.lit("profiles")), F.col("value")), "map<string,map<string,string>>")
    p = whole.select(F.explode(inner).alias("profile", "p")).where("p IS NOT NULL")
    at = lambda key: F.try_element_at("p", F.lit(key))
    columns = F.transform(F.regexp_extract_all(F.coalesce(at("description"), F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("int"))
    flag = lambda key: F.coalesce(at(key).try_cast("boolean"), F.lit(True)).alias(key)
    roles = ("txn_date", "posted_date", "amount", "debit", "credit", "balance", "direction", "card_last4")
    return p.select("profile", *(at(c).try_cast("int").alias(c) for c in roles), columns.alias("description"), flag("outflow_is_negative"), flag("dayfirst"))


def profile_layouts(g: DataFrame, chosen: DataFrame, profiles: DataFrame) -> DataFrame:
    """Layouts of files (file, profile) by named profiles (``PROFILE``): columns by
    position from 0, whether an outflow is negative, whether dates are day-first.
    They take the place of what a file's header says."""
    heads = header_rows(g, g.sparkSession)
    p = chosen.join(F.broadcast(profiles), "profile").join(heads, "file", "left")  # profiles are written by hand
    roles = {r: "card_last4" if r == "card" else r for r in ROLES if r != "description"}
    return p.select(
        "file", F.coalesce("description", F.array().cast("array<int>")).alias("descriptions"), *(F.col(c).alias(r) for r, c in roles.items()), F.lit(1.0).alias("confidence"),
        F.coalesce("header_line", F.lit(-1)).alias("header_line"), F.coalesce("outflow_is_negative", F.lit(True)).alias("negative_out"), F.coalesce("dayfirst", F.lit(True)).alias("day_first_set"),
    )


def typed_rows(g: DataFrame, layout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine). Dates are day-first unless the file's own say not;
    signs are flipped for a file whose balances say so, and a file of positive
    amounts without balances is all outflow."""
    cell = lambda role: F.try_element_at("cells", F.col(role) + 1)
    r = g.join(layout, "file").where((F.col("line_no") > F.col("header_line")) & (F.trim("line") != ""))
    # Reading a row is far more work than its bytes tell, so its partitions are not put together by size.
    r = r.repartition(int(g.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    r = r.withColumn("date_text", cell("txn_date"))
    parts = lambda i: F.regexp_extract("date_text", r"^(\d{1,2})[/.-](\d{1,2})[/.-]", i).try_cast("int")
    whole = Window.partitionBy("file")
    if "day_first_set" not in layout.columns:
        r = r.withColumn("day_first_set", F.lit(None).cast("boolean")).withColumn("negative_out", F.lit(True))
    early = F.row_number().over(whole.orderBy("line_no")) <= DATE_ROWS
    r = r.withColumn("_early", early)
    votes = F.count_if((parts(2) > 12) & F.col("_early")).over(whole) <= F.count_if((parts(1) > 12) & F.col("_early")).over(whole)
    # Inside arrays, as generated code of so many expressions is too long to be compiled to machine code.
    r = r.withColumn("amounts", F.transform(F.array(*(cell(c) for c in ("amount", "debit", "credit", "balance"))), parse_amount))
    amount, debit, credit, balance = (F.col("amounts")[i] for i in range(4))
    sign = F.lower(F.trim(cell("direction")))
    signed = F.when(sign.isin(*OUT_WORDS), -F.abs(amount)).when(sign.isin(*IN_WORDS), F.abs(amount)).otherwise(F.when(F.col("negative_out"), amount).otherwise(-amount))
    debit, credit = (F.nullif(F.abs(x), F.lit(0).cast("decimal(18,6)")) for x in (debit, credit))
    r = r.withColumn("day_first", F.coalesce("day_first_set", votes))
    r = r.withColumn("dates", F.transform(F.array("date_text", cell("posted_date")), lambda t: parse_date(t, F.col("day_first")))).withColumn("txn_date_", F.col("dates")[0])
    r = r.withColumn("amount_cents", to_cents(F.coalesce(-debit, credit, signed))).withColumn("balance_cents", to_cents(balance))
    words = F.transform("descriptions", lambda p: F.coalesce(F.try_element_at("cells", p + 1), F.lit("")))
    r = r.withColumn("description_raw", F.trim(F.regexp_replace(F.array_join(words, " "), r"\s+", " ")))
    reason = F.when(F.col("txn_date_").isNull(), "unparseable date").when(F.col("amount_cents").isNull(), "no amount value")
    r = r.withColumn("reason", reason)
    bad = r.where("reason IS NOT NULL").select("file", "line_no", "reason", F.substring("line", 1, 300).alias("raw"))
    r = r.where("reason IS NULL").select(
        "file", "sha256", "line_no", F.col("txn_date_").alias("txn_date"), F.col("dates")[1].alias("posted_date"), "description_raw", "amount_cents", "balance_cents", "day_first", "confidence",
        (F.col("debit").isNull() & F.col("credit").isNull()).alias("single"), F.right(F.regexp_replace(F.coalesce(cell("card"), F.lit("")), r"\D", ""), F.lit(4)).alias("card_last4"),
    )
    order = Window.partitionBy("file").orderBy("line_no")
    delta = F.col("balance_cents") - F.lag("balance_cents").over(order)
    r = r.withColumn("row_ordinal", F.row_number().over(order) - 1).withColumn("delta", delta)
    share = lambda x: F.avg(F.when(F.col("delta").isNotNull(), (F.abs(F.col("delta") - x) <= 2).cast("int"))).over(whole)
    as_is, flipped = share(F.col("amount_cents")), share(-F.col("amount_cents"))
    n_balances = F.count("balance_cents").over(whole)
    flip = (n_balances >= 3) & (flipped > as_is) & (flipped >= 0.7)
    outward = F.col("single") & (n_balances < 3) & (F.min("amount_cents").over(whole) >= 0)
    r = r.withColumn("flip", flip | outward)
    rows = r.withColumn("amount_cents", F.when(F.col("flip"), -F.col("amount_cents")).otherwise(F.col("amount_cents"))).drop("flip", "delta", "single")
    return rows, bad


def read_statements(spark: SparkSession, path: str, chosen: DataFrame | None = None, profiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return typed(scan(spark, path), chosen, profiles)


def typed(lines: DataFrame, chosen: DataFrame | None = None, profiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of the records of files, each with its own layout; files of
    ``chosen`` (file, profile) have that of their named profile."""
    found = layouts(lines, lines.sparkSession)
    if chosen is not None:
        named = profile_layouts(lines, chosen, profiles)
        found = found.join(chosen.select("file"), "file", "left_anti").unionByName(named, allowMissingColumns=True).withColumn("negative_out", F.coalesce("negative_out", F.lit(True)))
    return typed_rows(lines, written(found, "layouts"))  # rows and quarantine both need them


def file_report(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """Bookends, counters and concerns of each file."""
    order = F.col("row_ordinal")
    a = rows.groupBy("file").agg(
        F.count("*").alias("n_rows"), F.min("txn_date").alias("period_start"), F.max("txn_date").alias("period_end"),
        (F.min_by("balance_cents", order) - F.min_by("amount_cents", order)).alias("opening_cents"), F.max_by("balance_cents", order).alias("closing_cents"),
        F.sum(F.when(F.col("amount_cents") < 0, -F.col("amount_cents")).otherwise(0)).alias("out_cents"),
        F.sum(F.when(F.col("amount_cents") > 0, F.col("amount_cents")).otherwise(0)).alias("in_cents"),
        F.count("balance_cents").alias("n_balances"), F.max("confidence").alias("confidence"),
        F.max(F.dayofmonth("txn_date")).alias("last_day"),
    )
    a = a.join(bad.groupBy("file").agg(F.count("*").alias("n_skipped")), "file", "left").fillna(0, ["n_skipped"])
    concerns = F.array_compact(
        F.array(
            F.when(F.col("confidence") < 0.5, "layout"), F.when(F.col("out_cents") == 0, "inflow only"), F.when(F.col("n_balances") == 0, "no balance"),
            F.when(F.col("n_skipped") > 0.1 * (F.col("n_rows") + F.col("n_skipped")), "many skipped"),
            F.when((F.datediff("period_end", "period_start") > 20) & (F.col("last_day") <= 12), "ambiguous dates"),
        )
    )
    return a.withColumn("concerns", F.concat_ws(",", concerns)).drop("last_day")
