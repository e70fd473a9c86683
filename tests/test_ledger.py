"""Golden values and invariants of ledger operators on small tables."""

import datetime as dt

import pytest
from brassledger.functions import dates, money, text
from brassledger.operators import advice, classify, dedupe, dims, imports, match, mutate, recurring, report
from brassledger.sources import receipts as receipt_sources
from brassledger.sources import statements as files
from brassledger.streaming import jobs
from pyspark.sql import functions as F

LEDGER = "id long, account_id long, txn_date date, merchant_norm string, category string, is_cash_withdrawal int, status string, amount_cents long, balance_cents long"


def day(m, d, y=2025):
    return dt.date(y, m, d)


def march(spark):
    rows = [
        (1, "Salary", "Income", 4000000), (2, "Home Loan", "Housing", -1285000), (3, "Checkers", "Groceries", -100000), (4, "Checkers", "Groceries", -85000),
        (5, "Hollywoodbets", "Gambling & Betting", -80000), (6, "AARTO", "Fines & Penalties", -75000), (7, "Bank", "Bank Fees", -12500),
        (8, "Savings", "Savings & Investment", -500000), (9, "ATM", "Cash Withdrawals", -200000),
    ]
    return spark.createDataFrame([(i, 1, day(3, i), m, c, int(m == "ATM"), "active", a, None) for i, m, c, a in rows], LEDGER)


def test_march_ledger_reconciles(spark):
    by = {r.category: r.cents for r in report.category_breakdown(march(spark)).collect()}
    assert by["Housing"] == 1285000 and by["Groceries"] == 185000 and by["Fines & Penalties"] == 75000 and by["Bank Fees"] == 12500
    r = report.reconciliation(march(spark)).first()
    assert r.residual_cents == 0 and r.excluded_cents == 500000 and r.cash_cents == r.unexplained_cash_cents == 200000
    assert sum(by.values()) == r.outflow_cents


def test_card_repayment_switch(spark):
    rows = spark.createDataFrame([("Credit Card Repayment",), ("Groceries",)], "category string")
    kinds = lambda flag: {r.category: r.kind for r in dims.with_category_facts(rows, card_statements=flag).collect()}
    assert kinds(False)["Credit Card Repayment"] == "essential" and kinds(True)["Credit Card Repayment"] == "excluded"


def test_amount_texts(spark):
    cases = {
        "1 234.56": 123456, "R1,234.56": 123456, "1.234,56": 123456, "(160.96)": -16096, "-50": -5000, "50.00-": -5000, "12,5": 1250, "1,234": 123400,
        "1.234.567": 123456700, "0.005": 1, "": None, "abc": None, "1234": 123400, "12.345": 1235,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", money.to_cents(money.parse_amount(F.col("t"))).alias("c")).collect()} == cases


def test_dates(spark):
    cases = [("25/03/2026", True, day(3, 25, 2026)), ("03/25/2026", False, day(3, 25, 2026)), ("02/03/2026", False, day(2, 3, 2026)), ("2 Mar 2026", True, day(3, 2, 2026)), ("March 2 2026", True, day(3, 2, 2026)), ("2-March-2026", True, day(3, 2, 2026)), ("March 2, 2026", True, day(3, 2, 2026)), ("nope!!", True, None), ("1/2", True, None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "t string, f boolean")
    assert [r.d for r in df.select(dates.parse_date(F.col("t"), F.col("f")).alias("d")).collect()] == [c for *_, c in cases]


def test_narrations_and_rules(spark):
    rows = spark.createDataFrame(
        [("CARD PURCHASE 4067****1234 CHECKERS HYPER SANDTON ZA", -100), ("POS PURCHASE QWERTY TRADING 12/03", -100), ("SALARY ACME", 5000), ("TRANSFER TO SAVINGS", 700), (None, -5)],
        "description_raw string, amount_cents long",
    )
    got = {r.description_raw: r for r in classify.classify(rows, dims.rules(spark)).collect()}
    assert got["CARD PURCHASE 4067****1234 CHECKERS HYPER SANDTON ZA"].merchant == "Checkers"
    assert got["POS PURCHASE QWERTY TRADING 12/03"].merchant == "Qwerty Trading" and got["POS PURCHASE QWERTY TRADING 12/03"].category == "Uncategorised"
    assert got["SALARY ACME"].category == "Income" and got["SALARY ACME"].category_source == "rule"
    assert got["TRANSFER TO SAVINGS"].category == "Savings & Investment" and got[None].merchant == "Unknown"
    bad = dims.rules(spark).limit(1).withColumn("match_type", F.lit("regex")).withColumn("pattern", F.lit("("))
    assert classify.valid_rules(bad).count() == 0


def test_similarity(spark):
    df = spark.createDataFrame([("Checkers", "checkers!"), ("Checkers", "Checkers Hyper"), ("", "x"), ("big red shop", "big blue shop"), ("ab", "zz")], "a string, b string")
    s = [r.s for r in df.select(text.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert s[0] == 1 and s[1] == 0.85 and s[2] == 0 and abs(s[3] - 0.6) < 1e-9 and s[4] == 0


def test_overlapping_import_is_a_no_op(spark):
    cols = "id long, account_id long, txn_date date, merchant_norm string, amount_cents long, balance_cents long"
    first = [(1, 1, day(1, 1), "a", -100, None), (2, 1, day(1, 1), "a", -100, None), (3, 1, day(1, 2), "b", -500, 90)]
    a = dedupe.fingerprinted(spark.createDataFrame(first, cols))
    assert a.select("fingerprint").distinct().count() == 3  # equal same-day purchases both survive
    again = dedupe.fingerprinted(spark.createDataFrame([(i + 10, *r) for i, *r in first] + [(20, 1, day(1, 3), "c", -7, None)], cols))
    fresh = dedupe.new_rows(again, a)
    assert [r.id for r in fresh.collect()] == [20]


def test_duplicate_scores(spark):
    cols = "id long, account_id long, txn_date date, merchant_norm string, amount_cents long, balance_cents long, status string"
    old = spark.createDataFrame([(1, 1, day(1, 5), "a", -100, 50, "active"), (2, 1, day(1, 5), "b", -200, None, "active"), (3, 1, day(1, 5), "c", -300, 10, "active")], cols)
    new = spark.createDataFrame([(11, 1, day(1, 5), "a", -100, 50, ""), (12, 1, day(1, 6), "b", -200, None, ""), (13, 1, day(1, 5), "c", -300, 11, ""), (14, 1, day(1, 9), "b", -200, None, "")], cols)
    covered = spark.createDataFrame([(1, day(1, 1), day(1, 31))], "account_id long, period_start date, period_end date")
    got = {r.new_id: (r.score, r.verdict) for r in dedupe.near_duplicates(new, old, covered).collect()}
    assert got == {11: (0.97, "held"), 12: (0.72, "review")}
    assert dedupe.near_duplicates(new, old, covered.limit(0)).count() == 0  # outside coverage the same again is another purchase


def test_cash_is_never_overdrawn(spark):
    l = march(spark)
    r = spark.createDataFrame([(1, 1, day(3, 10), "x", 150000, "cash"), (2, 1, day(3, 11), "y", 300000, "cash"), (3, 1, day(3, 3), "Checkers", 100000, "card")], "receipt_id long, account_id long, receipt_date date, merchant_norm string, total_cents long, tender_type string")
    linked, cash = match.link_receipts(r, l)
    got = {x.receipt_id: (x.link_status, x.match_score, x.txn_id) for x in linked.collect()}
    assert got[1] == ("cash_allocated", 0.8, None) and got[2] == ("cash_allocated", 0.5, None) and got[3][0] == "matched" and got[3][2] == 3
    assert cash.agg(F.sum("amount_cents")).first()[0] == 200000
    moved = report.cash_reclassified(l, spark.createDataFrame([(1, "Groceries", 45000)], "account_id long, category string, cents long"))
    by = {x.category: x.cents for x in moved.collect()}
    assert by["Groceries"] == 230000 and by["Cash Withdrawals"] == 155000
    assert sum(by.values()) == report.totals(l, "account_id").first().outflow_cents


def test_tenders_cards_and_undated_receipts(spark):
    rows = [(1, 1, day(3, 1), "ATM", "Cash Withdrawals", 1, "active", -50000, None), (2, 1, day(3, 4), "Corner Shop", None, 0, "active", -10000, None), (3, 1, day(3, 4), "Cafe", None, 0, "active", -700, None)]
    l = spark.createDataFrame(rows, LEDGER).withColumn("card_last4", F.lit("1234"))
    cols = "receipt_id long, account_id long, receipt_date date, merchant_norm string, total_cents long, tender_type string, card_last4 string"
    r = spark.createDataFrame(
        [
            (1, 1, day(3, 4), "Corner Shop", 10000, "unknown", None),  # the card row comes first
            (2, 1, day(3, 5), "Kiosk", 3000, None, None),  # no row: cash
            (3, 1, day(3, 6), "Nowhere", 4000, "card", None),  # a card slip never draws cash
            (4, 1, None, "Cafe", 700, "card", "1234"),  # no date: amount, name and card decide
            (5, 1, day(3, 6), "Cafe", None, "cash", None),
        ],
        cols,
    )
    got = {x.receipt_id: (x.link_status, x.txn_id) for x in match.link_receipts(r, l)[0].collect()}
    assert got == {1: ("matched", 2), 2: ("cash_allocated", None), 3: ("unmatched", None), 4: ("matched", 3), 5: ("unmatched", None)}
    kept = spark.createDataFrame([(2,)], "txn_id long")
    assert {x.txn_id for x in match.link_receipts(r, l, kept)[0].collect()} == {3, None}


def test_import_twice_and_known_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Date,Description,Amount,Balance\n13/03/2025,Checkers,-350.00,650.00\n14/03/2025,ATM,-100.00,550.00\n14/03/2025,ATM,-100.00,450.00\n")
    rows, bad = files.read_statements(spark, str(tmp_path / "one.csv"))
    rows = rows.withColumn("account_id", F.lit(1).cast("long"))
    tagged = imports.import_batch(rows, imports.empty_ledger(spark), imports.empty_statements(spark), dims.rules(spark), str(tmp_path / "w1"))
    assert [r.n_imported for r in imports.counters(tagged, bad.withColumn("account_id", F.lit(1).cast("long"))).collect()] == [3]
    ledger, seen = imports.additions(tagged), imports.statements_of(tagged)
    assert [(str(r.period_start), str(r.period_end), r.n_rows) for r in seen.collect()] == [("2025-03-13", "2025-03-14", 3)]
    assert sum(r.is_cash_withdrawal for r in ledger.collect()) == 2
    assert imports.import_batch(rows, ledger, seen, dims.rules(spark), str(tmp_path / "w2")).count() == 0  # the file is known
    again = imports.import_batch(rows, ledger, seen, dims.rules(spark), str(tmp_path / "w3"), force=True)
    assert {r.outcome for r in again.collect()} == {"exact"}
    (tmp_path / "two.csv").write_text("Date,Description,Amount\n13/03/2025,Checkers,-350.00\n15/03/2025,Checkers,-350.00\n16/03/2025,Engen,-1.00\n")
    more = files.read_statements(spark, str(tmp_path / "two.csv"))[0].withColumn("account_id", F.lit(1).cast("long"))
    got = imports.import_batch(more, ledger, seen, dims.rules(spark), str(tmp_path / "w4"))
    assert [(r.outcome, r.status) for r in got.orderBy("row_ordinal").collect()] == [("held", "duplicate"), ("imported", "active"), ("imported", "active")]
    assert [(r.outcome, r.detail) for r in imports.audit(got, F.lit(None)).collect()] == [("imported", "2 imported, 0 exact, 1 held, 0 for review")]


def _import(spark, tmp_path, name, lines, ledger=None, seen=None, head="Date,Description,Amount,Balance"):
    (tmp_path / f"{name}.csv").write_text("\n".join([head, *lines]) + "\n")
    rows = files.read_statements(spark, str(tmp_path / f"{name}.csv"))[0].withColumn("account_id", F.lit(1).cast("long"))
    ledger = imports.empty_ledger(spark) if ledger is None else ledger
    return imports.import_batch(rows, ledger, imports.empty_statements(spark) if seen is None else seen, dims.rules(spark), str(tmp_path / f"w-{name}"))


def test_repeat_outside_coverage_is_no_duplicate(spark, tmp_path):
    head = "Date,Description,Amount"
    first = _import(spark, tmp_path, "a", ["13/03/2025,Vida e Caffe,-45.00", "14/03/2025,Monthly fee,-69.00"], head=head)
    then = _import(spark, tmp_path, "b", ["15/03/2025,Vida e Caffe,-45.00", "17/03/2025,Account fee,-69.00"], imports.additions(first), imports.statements_of(first), head)
    assert {r.outcome for r in then.collect()} == {"imported"}


def test_fees_of_one_name_are_not_one_row(spark, tmp_path):
    head = "Date,Description,Amount"
    first = _import(spark, tmp_path, "a", ["13/03/2025,Monthly fee,-69.00", "16/03/2025,Engen,-1.00"], head=head)
    then = _import(spark, tmp_path, "b", ["14/03/2025,Account fee,-69.00", "14/03/2025,Monthly fee,-69.00"], imports.additions(first), imports.statements_of(first), head)
    assert [r.outcome for r in then.orderBy("row_ordinal").collect()] == ["imported", "review"]


def test_another_card_mask_is_the_same_row(spark, tmp_path):
    first = _import(spark, tmp_path, "a", ["13/03/2025,CARD PURCHASE 4067****1234 CHECKERS SANDTON ZA,-350.00,650.00", "14/03/2025,Engen,-1.00,649.00"])
    then = _import(spark, tmp_path, "b", ["13/03/2025,POS PURCHASE 5599****9876 CHECKERS 13/03,-350.00,650.00", "14/03/2025,Engen,-1.00,649.00"], imports.additions(first), imports.statements_of(first))
    assert {r.outcome for r in then.collect()} == {"exact"}


def test_equal_purchases_of_a_day_survive_and_overlap_is_known(spark, tmp_path):
    lines = ["13/03/2025,Kiosk,-10.00", "13/03/2025,Kiosk,-10.00", "14/03/2025,Bakery,-20.00"]
    first = _import(spark, tmp_path, "a", lines, head="Date,Description,Amount")
    assert [r.outcome for r in first.collect()] == ["imported"] * 3
    then = _import(spark, tmp_path, "b", [*lines, "15/03/2025,Bakery,-5.00"], imports.additions(first), imports.statements_of(first), "Date,Description,Amount")
    assert [r.outcome for r in then.orderBy("row_ordinal").collect()] == ["exact", "exact", "exact", "imported"]


def test_user_choice_survives_reclassification(spark):
    rows = [(1, 1, "QWERTY TRADING", -100), (2, 1, "QWERTY TRADING", -200), (3, 2, "QWERTY TRADING", -300)]
    l = classify.classify(spark.createDataFrame(rows, "id long, account_id long, description_raw string, amount_cents long"), dims.rules(spark)).withColumnRenamed("merchant", "merchant_norm")
    m = spark.createDataFrame([(1, "qwertytrading", None), (2, "qwertytrading", None)], "account_id long, canonical string, default_category string")
    l, rules, m = mutate.set_category(l, spark.createDataFrame([(1, "Gifts & Donations")], "id long, new_category string"), dims.rules(spark), m)
    assert {(r.account_id, r.default_category) for r in m.collect()} == {(1, "Gifts & Donations"), (2, None)}
    again = classify.reclassified(l.withColumnRenamed("merchant_norm", "merchant"), rules, all_but_user=True)
    got = {r.id: (r.category, r.category_source) for r in again.collect()}
    assert got == {1: ("Gifts & Donations", "user"), 2: ("Gifts & Donations", "rule"), 3: ("Uncategorised", "default")}


def test_receipt_beats_a_default_but_nothing_else(spark):
    rows = [(1, "Uncategorised", "default", "Shop"), (2, "Groceries", "rule", "Shop"), (3, "Pets", "user", "Shop"), (4, None, "unset", "Unknown")]
    l = spark.createDataFrame(rows, "id long, category string, category_source string, merchant_norm string")
    r = spark.createDataFrame([(10 + i, i, "matched", "Cafe", "Coffee & Snacks") for i in range(1, 5)], "receipt_id long, txn_id long, link_status string, merchant_norm string, category string")
    got = {x.id: (x.category, x.category_source, x.merchant_norm) for x in mutate.enrich(l, r).collect()}
    assert got == {1: ("Coffee & Snacks", "receipt", "Shop"), 2: ("Groceries", "rule", "Shop"), 3: ("Pets", "user", "Shop"), 4: ("Coffee & Snacks", "receipt", "Cafe")}


def test_profile_overrides_the_header(spark, tmp_path):
    (tmp_path / "p.csv").write_text("A;B;C;D\nx;1.00;25.00;03/04/2025\ny;2.00;-5.00;03/25/2025\n")
    lines = files.scan(spark, str(tmp_path / "p.csv"))
    profiles = spark.createDataFrame([("own", 3, None, 2, None, None, None, None, None, [0], False, False)], files.PROFILE)
    rows, _ = files.typed(lines, lines.select("file").distinct().withColumn("profile", F.lit("own")), profiles)
    assert [(r.description_raw, str(r.txn_date), r.amount_cents) for r in rows.orderBy("line_no").collect()] == [("x", "2025-03-04", -2500), ("y", "2025-03-25", 500)]


def test_windows_bytes_and_posting_dates(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("Transaction Date,Posting Date,Description,Amount\n01/03/2025,03/03/2025,Price €5 – Café,-5.00\n".encode("cp1252"))
    r = files.read_statements(spark, str(tmp_path / "w.csv"))[0].first()
    assert r.description_raw == "Price €5 – Café" and str(r.posted_date) == "2025-03-03" and str(r.txn_date) == "2025-03-01"


def test_recurring_ignores_held_rows_and_sees_newer_one_offs(spark):
    charge = lambda i, d, status: (i, 1, d, "Netflix", "Subscriptions & Streaming", 0, status, -19900, None)
    rows = [charge(m, day(m, 5), "active") for m in (1, 2, 3)] + [charge(10 + m, day(m, 6), "duplicate") for m in (1, 2, 3)]
    rows.append((99, 1, day(9, 1), "Once", None, 0, "active", -100, None))
    r = recurring.recurring(spark.createDataFrame(rows, LEDGER)).first()
    assert (r.n, r.total_cents, r.active) == (3, 59700, False)


def test_cash_slips_reveal_their_own_categories(spark):
    l = march(spark)
    slips = spark.createDataFrame([(1, "Groceries"), (2, None)], "receipt_id long, category string")
    drawn = spark.createDataFrame([(1, 1, 9, 45000), (1, 2, 9, 5000), (1, 1, 777, 1)], "account_id long, receipt_id long, withdrawal_id long, amount_cents long")
    assert {(r.category, r.cents) for r in report.cash_revealed(drawn, slips, l).collect()} == {("Groceries", 45000), ("Uncategorised", 5000)}


def test_findings_are_ranked_and_valid(spark):
    l = march(spark)
    found = advice.ranked(advice.advice(l)).orderBy("rank").collect()
    assert [r.saving for r in found] == sorted((r.saving for r in found), reverse=True) and {r.difficulty for r in found} <= {"easy", "moderate", "hard"}
    t = advice.advice_totals(advice.advice(l), l).first()
    assert t.valid and t.easy_cents + t.moderate_cents + t.hard_cents == t.monthly_cents


def test_cluster_without_shared_folder_is_refused(monkeypatch):
    import types

    import pytest
    from brassledger import store

    spark = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: d), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        store.work_path(spark, "x")


def test_monthly_subscription(spark):
    rows = [(i, 1, day(m, 5), "Netflix", "Subscriptions & Streaming", 0, "active", -19900, None) for i, m in enumerate((1, 2, 3))]
    r = recurring.recurring(spark.createDataFrame(rows, LEDGER)).first()
    assert (r.cadence, r.subscription, r.annual_cents, r.active) == ("monthly", True, 19900 * 12, True)


def test_savings_stay_under_headroom(spark):
    l = march(spark)
    total = advice.advice_totals(advice.advice(l), l).first()
    room = advice.headroom(l).agg(F.sum("ceiling")).first()[0]
    assert 0 < total.monthly_cents <= room


def test_undo_and_resolve(spark):
    l = march(spark).withColumn("statement_id", F.when(F.col("id") < 5, 1).otherwise(2))
    receipts = spark.createDataFrame([(1, 3, "matched")], "receipt_id long, txn_id long, link_status string")
    none = spark.createDataFrame([], "withdrawal_id long, receipt_id long")
    pairs = spark.createDataFrame([(3, 4)], "new_id long, existing_id long")
    tables = {"statements": l.select("statement_id").distinct(), "transactions": l, "receipts": receipts, "allocations": none, "candidates": pairs}
    one = spark.createDataFrame([(1,)], "statement_id int")
    assert mutate.undo(tables, one)["transactions"].count() == 9  # a linked receipt refuses
    out = mutate.undo(tables, one, force=True)
    assert out["transactions"].count() == 5 and out["candidates"].count() == 0 and out["receipts"].first().link_status == "unmatched"


def test_statement_files(spark, tmp_path):
    (tmp_path / "signed.csv").write_text("My Bank\nAccount 1\nDate,Description,Amount,Balance\n01/03/2025,A,-350.00,650.00\n02/03/2025,\"B, C\",-199.00,451.00\n13/03/2025,D,25000.00,25451.00\nClosing Balance,,,25451.00\n")
    (tmp_path / "inverted.csv").write_text("Date,Description,Amount,Balance\n01/03/2025,A,350.00,650.00\n02/03/2025,B,199.00,451.00\n03/03/2025,C,800.00,-349.00\n04/03/2025,D,-25000.00,24651.00\n")
    (tmp_path / "debits.csv").write_bytes("Transaction Date;Narrative;Debit Amount;Credit Amount;Running Balance\n2025-03-01;Caf\xe9;1 200.50;;10.00\n2025-03-02;Pay;;2 000.00;2010.00\n".encode("latin-1"))
    (tmp_path / "month.csv").write_text("Posting Date,Details,Amount\n03/25/2026,A,10\n03/02/2026,B,20\n")
    (tmp_path / "bare.csv").write_text("2025-03-01,Shop one,-10.00,90.00\n2025-03-02,Shop two,-20.00,70.00\n2025-03-03,Shop three,-5.00,65.00\n")
    rows, bad = files.read_statements(spark, str(tmp_path))
    got = {}
    for r in rows.orderBy("file", "row_ordinal").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((str(r.txn_date), r.description_raw, r.amount_cents))
    assert [x[2] for x in got["signed.csv"]] == [-35000, -19900, 2500000] and got["signed.csv"][1][1] == "B, C"
    assert [x[2] for x in got["inverted.csv"]] == [-35000, -19900, -80000, 2500000]
    assert got["debits.csv"] == [("2025-03-01", "Café", -120050), ("2025-03-02", "Pay", 200000)]
    assert got["month.csv"] == [("2026-03-25", "A", -1000), ("2026-03-02", "B", -2000)]
    assert [x[2] for x in got["bare.csv"]] == [-1000, -2000, -500]
    assert [(r.reason, r.line_no) for r in bad.collect()] == [("unparseable date", 6)]
    assert files.file_report(rows, bad).count() == 5


def test_receipt_text(spark):
    slip = "CORNER SHOP\n12/03/2025 14:05\nMilk 47.04\nSubtotal 152.96\nTotal 152.96\nCash tendered 200.00\nChange 47.04"
    r = receipt_sources.from_text(spark.createDataFrame([(1, slip), (2, None), (3, "")], "i long, t string"), "i", "t").where("id = 1").first()
    assert (r.merchant, r.total_cents, r.tender_type, r.receipt_time, str(r.receipt_date)) == ("CORNER SHOP", 15296, "cash", "14:05", "2025-03-12")


def test_stream_import_is_idempotent(spark, tmp_path):
    l = march(spark)
    ledger, rows = str(tmp_path / "ledger"), str(tmp_path / "rows")
    known = dedupe.fingerprinted(l)
    known.where("id < 4").write.parquet(ledger)
    l.write.parquet(rows)
    jobs.import_new(spark, rows, l.schema, ledger, str(tmp_path / "c1")).awaitTermination()
    jobs.import_new(spark, rows, l.schema, ledger, str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(ledger).count() == 9


def test_corrected_receipt_is_linked_again(spark):
    r = spark.createDataFrame([(1, "a", 100, "matched", 0.5), (2, "b", 200, "matched", 0.5)], "receipt_id long, merchant_norm string, total_cents long, link_status string, confidence double")
    c = spark.createDataFrame([(1, None, 150)], "receipt_id long, merchant_norm string, total_cents long")
    got = {x.receipt_id: (x.merchant_norm, x.total_cents, x.link_status, x.confidence) for x in mutate.correct_receipts(r, c).collect()}
    assert got == {1: ("a", 150, "unmatched", 1.0), 2: ("b", 200, "matched", 0.5)}


def test_json_report_sums_to_the_ledger(spark):
    import json

    l = march(spark)
    one = json.loads(report.report_json(report.category_breakdown(l), report.reconciliation(l)).first().report)
    assert sum(x["cents"] for x in one["categories"]) == one["outflow_cents"] and one["categories"][0]["category"] == "Housing"


def _plain_rules(rows, rules):
    """First rule of each field for each narration, every rule tried on every one."""
    out = {}
    for i, text, name in rows:
        hits = []
        for rule_id, priority, field, kind, pattern, category in rules:
            subject, p = (name if field == "merchant" else text).lower(), pattern.lower()
            hit = {"contains": p in subject, "exact": subject.strip(" ") == p.strip(" "), "startswith": subject.startswith(p)}[kind]
            if hit and subject:
                hits.append((priority, rule_id, category))
        out[i] = min(hits)[2] if hits else "Uncategorised"
    return out


def test_rules_by_their_rarest_trigram(spark):
    """All kinds of text rules at once, patterns under three characters among them."""
    import random

    rng = random.Random(4)
    words = ["shop", "cafe", "ab", "abc", "bcd", "zz top", "pharmacy", "fuel", "a", "", "éclair", "müller", "shop cafe"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))).strip()) for i in range(300)]
    rules = [(k, rng.randrange(5), "description", rng.choice(["contains", "exact", "startswith"]), rng.choice(words[:9] + words[10:]) + rng.choice(["", " ", " c", "x"]), f"c{k}") for k in range(120)]
    table = spark.createDataFrame([(*r, None, None, "default") for r in rules], "rule_id long, priority int, field string, match_type string, pattern string, category string, merchant string, txn_type string, source string")
    df = spark.createDataFrame([(i, t, -100) for i, t in rows], "id long, description_raw string, amount_cents long")
    out = classify.classify(df, table)
    assert {r.id: r.category for r in out.collect()} == _plain_rules([(i, t, "") for i, t in rows], rules)


def test_a_large_rule_pack_is_not_met_by_nested_loops(spark):
    pack = spark.range(100000).select(
        (F.col("id") % 4 * 1000000 + F.col("id")).alias("rule_id"), F.lit(5).alias("priority"), F.lit("description").alias("field"), F.lit("contains").alias("match_type"),
        F.concat(F.lit("vendor "), F.col("id"), F.lit(" ltd")).alias("pattern"), F.concat(F.lit("c"), F.col("id")).alias("category"),
        F.lit(None).cast("string").alias("merchant"), F.lit(None).cast("string").alias("txn_type"), F.lit("default").alias("source"),
    )
    rows = spark.range(0, 200000, 997).select("id", F.concat(F.lit("Payment to VENDOR "), F.col("id"), F.lit(" LTD thanks")).alias("description_raw"), F.lit(-5).cast("long").alias("amount_cents"))
    out = classify.classify(rows, pack)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.id: r.category for r in out.collect()} == {i: f"c{i}" if i < 100000 else "Uncategorised" for i in range(0, 200000, 997)}


def test_bad_regexes_are_listed_and_match_nothing(spark):
    named = [(1, "regex", "(vida) E"), (2, "regex", "("), (3, "regex", "(?P<n>vida)"), (4, "contains", "shop"), (5, "regex", None), (6, "regex", "\\p{L}"), (7, "regex", "(?(1)a|b)")]
    rules = spark.createDataFrame([(i, 1, "description", k, p, f"c{i}", None, None, "default") for i, k, p in named], dims.rules(spark).schema)
    assert {r.rule_id for r in classify.rejected_rules(rules).collect()} == {2, 3, 6, 7}
    rows = spark.createDataFrame([(1, "VIDA E CAFFE", -5), (2, "a shop", -5), (3, None, -5), (4, "", -5)], "id long, description_raw string, amount_cents long")
    assert {r.id: r.category for r in classify.classify(rows, rules).collect()} == {1: "c1", 2: "c4", 3: "Uncategorised", 4: "Uncategorised"}


def test_defaults_of_accounts_come_before_shared_ones(spark):
    rows = spark.createDataFrame([(i, a, "QWERTY TRADING", -5) for i, a in enumerate([1, 2, 3, 1])], "id long, account_id long, description_raw string, amount_cents long")
    key = "qwertytrading"
    merchants = spark.createDataFrame([(1, key, "Pets"), (2, key, "Fuel"), (None, key, "Gifts"), (2, key, "Home"), (9, key, "Fees"), (1, None, "Fees")], "account_id long, canonical string, default_category string")
    got = sorted((r.id, r.category, r.category_source) for r in classify.classify(rows, dims.rules(spark), merchants).collect())
    assert got == [(0, "Pets", "merchant"), (1, "Fuel", "merchant"), (2, "Gifts", "merchant"), (3, "Pets", "merchant")]
    # What a correction returns can be given back: an account's choice is its own.
    ledger = classify.classify(rows, dims.rules(spark), merchants.where("account_id IS NULL")).withColumnRenamed("merchant", "merchant_norm")
    change = spark.createDataFrame([(1, "Travel")], "id long, new_category string")
    ledger, rules, known = mutate.set_category(ledger, change, dims.rules(spark), merchants.where("account_id IS NULL"))
    assert sorted((r.account_id or 0, r.default_category) for r in known.collect()) == [(0, "Gifts"), (2, "Travel")]
    again = classify.classify(rows, dims.rules(spark), known).collect()
    assert sorted((r.id, r.category) for r in again) == [(0, "Gifts"), (1, "Travel"), (2, "Gifts"), (3, "Gifts")]


def test_files_of_one_batch_are_imported_one_by_one(spark, tmp_path):
    """Three files an account, which lie over each other, with and without balances:
    one batch gives what three give, chains of held rows among them."""
    import random

    rng = random.Random(11)
    account = F.regexp_extract("file", r"account_id=(\d+)", 1).cast("long")
    for a in range(12):
        for k in range(3):
            balances = rng.random() < 0.5
            lines = ["Date,Description,Amount" + (",Balance" if balances else "")]
            total = 5000
            for day in sorted(rng.randrange(1, 9) for _ in range(rng.randrange(2, 8))):
                cents = rng.choice([1000, 1000, 2500])
                total -= cents
                lines.append(f"{day + 12}/03/2025,{rng.choice(['Engen', 'Engen', 'Shoprite'])},-{cents / 100:.2f}" + (f",{total / 100:.2f}" if balances else ""))
            for root in ("all", f"one{k}"):
                folder = tmp_path / root / f"account_id={a}"
                folder.mkdir(parents=True, exist_ok=True)
                (folder / f"{k}.csv").write_text("\n".join(lines) + "\n")

    def tagged(root, ledger, seen):
        rows = files.read_statements(spark, f"{tmp_path}/{root}/account_id=*")[0].withColumn("account_id", account)
        return imports.import_batch(rows, ledger, seen, dims.rules(spark), str(tmp_path / f"work-{root}"))

    shown = lambda df: sorted((r.account_id, r.file.rsplit("/", 1)[1], r.row_ordinal, r.outcome, r.status, r.duplicate_of or 0) for r in df.collect())
    ledger, seen, want = imports.empty_ledger(spark), imports.empty_statements(spark), []
    for k in range(3):
        one = tagged(f"one{k}", ledger, seen)
        want += shown(one)
        ledger, seen = ledger.unionByName(imports.additions(one)), seen.unionByName(imports.statements_of(one).select(*seen.columns))
    got = shown(tagged("all", imports.empty_ledger(spark), imports.empty_statements(spark)))
    assert got == sorted(want)
    assert {"exact", "held", "review", "imported"} == {r[3] for r in got}


def test_equal_files_of_a_batch_count_once(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("Date,Description,Amount\n13/03/2025,Engen,-10.00\n14/03/2025,Engen,-10.00\n")
    rows = files.read_statements(spark, str(tmp_path / "*.csv"))[0].withColumn("account_id", F.lit(1).cast("long"))
    tagged = imports.import_batch(rows, imports.empty_ledger(spark), imports.empty_statements(spark), dims.rules(spark), str(tmp_path / "w"))
    assert [(r.file[-5:], r.outcome) for r in tagged.collect()] == [("a.csv", "imported")] * 2


def test_held_rows_hold_no_others(spark):
    """settled: b is held by a; c is near b only, so c stays; d is held by c."""
    pair = "account_id long, new_id long, existing_id long, gap_days int, score double, verdict string"
    ledger = spark.createDataFrame([], pair)
    inside = spark.createDataFrame([(1, 2, 1, 0, 0.93, "held"), (1, 3, 2, 0, 0.93, "held"), (1, 4, 3, 0, 0.93, "held"), (1, 5, 2, 1, 0.72, "review"), (1, 5, 3, 1, 0.72, "review")], pair)
    assert sorted((r.new_id, r.existing_id) for r in dedupe.settled(ledger, inside).collect()) == [(2, 1), (4, 3), (5, 3)]


def test_records_equal_those_of_a_csv_reader(spark, tmp_path):
    """Line breaks, delimiters and doubled quotes inside quotes, quotes inside plain
    cells, an open quote at the end, lines of 100000 quotes, CR and CRLF."""
    import csv
    import io

    texts = {
        "a": 'Date,Description,Amount\n13/03/2025,"Shop\nround the ""corner""\r\n, upstairs",-5.00\n14/03/2025,12" pipe,-6.00\n\n15/03/2025," x ",-7.00\n',
        "b": "Date;Text;Amount\r\n1/1/2025;'a;1,5\r\n\r\n2/1/2025;\"b;c\";2,5\r\n3/1/2025;\"open;3,5\n4/1/2025;d;4,5",
        "c": "Date,Description,Amount\n1/1/2025," + '""' * 50000 + ",1\n2/1/2025," + '"' * 100001 + ",2\n3/1/2025,plain,3\n",
        "d": "Date|Text|Amount\r1/1/2025|x|1\r2/1/2025|y|2\r", "e": "", "f": "\n\n", "g": "one cell\nanother\n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    got = {}
    for r in files.scan(spark, str(tmp_path / "*.csv")).orderBy("file", "line_no").collect():
        got.setdefault(r.file[-5:-4], []).append(r.cells)
    for name, text in texts.items():
        want = [[c.strip() for c in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter={"b": ";", "d": "|"}.get(name, ","))]
        assert got.get(name, []) == want, name


def test_a_quoted_line_break_loses_no_row(spark, tmp_path):
    text = 'Date,Description,Amount,Balance\n13/03/2025,"Checkers\nHyper ""Four\nways""",-350.00,650.00\nnonsense,"a\nb",,\n14/03/2025,ATM,-100.00,550.00\n'
    (tmp_path / "q.csv").write_text(text)
    rows, bad = files.read_statements(spark, str(tmp_path / "q.csv"))
    assert [(r.description_raw, r.amount_cents, r.line_no) for r in rows.orderBy("line_no").collect()] == [('Checkers Hyper "Four ways"', -35000, 1), ("ATM", -10000, 3)]
    assert [(r.line_no, r.reason, r.raw) for r in bad.collect()] == [(2, "unparseable date", 'nonsense,"a\nb",,')]


def test_delimiters():
    assert files.delimiter_of("a;b;c\n1;2,5;4\n5;6,5;8\n") == ";" and files.delimiter_of("x\ty\n1\t2\n") == "\t"
    assert files.delimiter_of("") == "," == files.delimiter_of("word\nmore words\n")


def _walked(cards, draws, tenders):
    """The same receipt by receipt, in plain Python."""
    rows, slips, who, left, out, taken = {}, {}, {}, {}, [], set()
    for a, r, day, tender, txn, score in sorted(cards, key=lambda e: (e[1], -e[5], e[4])):
        rows.setdefault(r, []).append((a, txn, score))
        who[r] = (day or "", r)
    for a, r, day, total, w, withdrawn, gap in sorted(draws, key=lambda e: (e[1], e[6], e[4])):
        slips.setdefault(r, []).append((a, w, total))
        left[w] = withdrawn
        who[r] = (day or "", r)

    def by_card(r):
        for a, txn, score in rows.get(r, ()):
            if txn not in taken:
                taken.add(txn)
                out.append((a, r, txn, None, score, None))
                return True
        return False

    def by_cash(r):
        n, need = len(out), slips.get(r, [(0, 0, 0)])[0][2]
        for a, w, _ in slips.get(r, ()):
            take = min(left[w], need)
            if take > 0:
                left[w] -= take
                need -= take
                out.append((a, r, None, w, None, take))
        return len(out) > n

    for r in sorted(who, key=who.get):
        if tenders[r] == "cash":
            by_cash(r) or by_card(r)
        else:
            by_card(r) or (tenders[r] in ("unknown", "voucher") and by_cash(r))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_of_claims_equal_a_walk(spark, seed):
    """One busy account: chains of competitors for rows and withdrawals, ties, all tenders, undated receipts."""
    import random

    rng = random.Random(seed)
    tenders = {r: rng.choice(["cash", "cash", "card", "unknown", "voucher", ""]) for r in range(120)}
    days = {r: None if rng.random() < 0.1 else f"2025-03-{1 + r % 28:02d}" for r in tenders}
    totals, withdrawn = {r: rng.randrange(1, 60) for r in tenders}, {w: rng.randrange(1, 90) for w in range(900, 930)}
    cards = [(1, r, days[r], tenders[r], 500 + t, rng.choice([0.7, 0.8, 0.9])) for r in tenders for t in rng.sample(range(60), rng.randrange(0, 4))]
    draws = [(1, r, days[r], totals[r], w, withdrawn[w], rng.randrange(3)) for r in tenders if tenders[r] in ("cash", "unknown", "voucher") for w in rng.sample(sorted(withdrawn), rng.randrange(0, 4))]
    c = spark.createDataFrame(cards, "account_id long, receipt_id long, day string, tender_type string, txn_id long, score double").withColumn("receipt_date", F.to_date("day"))
    d = spark.createDataFrame(draws, "account_id long, receipt_id long, day string, total_cents long, withdrawal_id long, withdrawn long, days_before int").withColumn("receipt_date", F.to_date("day"))
    t = spark.createDataFrame(list(tenders.items()), "receipt_id long, tender_type string")
    got = match.assign(c.drop("day"), d.drop("day"), t).collect()
    assert sorted((tuple(r) for r in got), key=str) == _walked(cards, draws, tenders)


def test_claims_are_granted_in_order(spark):
    """The fold against a walk in plain Python: spills, caps of granted findings, trims, categories without room."""
    import random

    rng = random.Random(21)
    names = [f"c{k}" for k in range(9)]
    claims, rooms = [], []
    for account in range(25):
        for n in rng.sample(names, rng.randrange(0, 9)):
            rooms.append((account, n, rng.choice([0, 4000, 5000, 30000, rng.randrange(60000)]), rng.choice(["discretionary", "cash", "essential"]), rng.randrange(4), rng.choice([5000, 10000, 90000])))
        for _ in range(rng.randrange(0, 40)):
            claims.append((account, rng.randrange(1, 10), f"k{rng.randrange(30)}", rng.sample(names, rng.randrange(1, 4)), rng.randrange(1, 9000)))
    claims = list({(a, s, k, w): (a, s, k, c, w) for a, s, k, c, w in claims}.values())

    def walk(account):
        room = {n: (c, kind, f, m) for a, n, c, kind, f, m in rooms if a == account}
        left, used, out = {n: v[0] for n, v in room.items()}, {5: 0, 9: 0}, []
        for _, seq, key, categories, want in sorted((c for c in claims if c[0] == account), key=lambda c: (c[1], -c[4], c[2])):
            if used.get(seq, -1) >= {5: 6, 9: 3}.get(seq, 0):
                continue
            saving = 0
            for n in categories:
                part = max(0, min(want - saving, left.get(n, 0)))
                saving += part
                if n in left:
                    left[n] -= part
            if saving:
                out.append((account, seq, key, saving))
                if seq in used:
                    used[seq] += 1
        rest = sorted((-left[n], n) for n, (_, kind, f, m) in room.items() if kind in ("discretionary", "cash") and f >= 2 and m >= 10000 and left[n] >= 5000)
        return out + [(account, 10, n, -x) for x, n in rest[:5]]

    c = spark.createDataFrame(claims, "account_id long, seq int, key string, categories array<string>, want long").repartition(3)
    r = spark.createDataFrame(rooms, "account_id long, category string, ceiling long, kind string, frivolity int, monthly long").repartition(3)
    out = advice.walked(c, r)
    assert not [w for w in ("Python", "Pandas", "Arrow") if w in out._jdf.queryExecution().optimizedPlan().toString()]
    # Accounts without a category have no room, so nothing is granted to them.
    want = [f for a in range(25) if any(x[0] == a for x in rooms) for f in walk(a)]
    assert sorted(tuple(x) for x in out.collect()) == sorted(want)


def _plain_wants(rows, facts, groups, hints):
    """What each of the ten kinds of finding but the trim asks for, row by row in plain Python."""
    out = set()
    for account in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == account]
        days = (max(r[2] for r in mine) - min(r[2] for r in mine)).days + 1
        months = days / 30.44
        spent = [(i, d, m or "Unknown", c or "Uncategorised", -x, m) for i, _, d, m, c, s, x in mine if s == "active" and x < 0]
        by_cat, by_merchant = {}, {}
        for i, d, m, c, x, raw in spent:
            by_cat[c] = by_cat.get(c, 0) + x
            by_merchant.setdefault(raw, []).append((d, i, x, c))
        monthly = {c: int(x / months) for c, x in by_cat.items()}
        fact = lambda c: facts.get(c, ("discretionary", 1))
        wanted = lambda c: fact(c)[0] not in ("excluded", "income") and fact(c)[1] >= 2

        def add(seq, key, categories, want):
            if int(want) > 0:
                out.add((account, seq, key, tuple(categories), int(want)))

        for c in ("Fines & Penalties", "Interest & Penalties"):
            add(1, c, [c], monthly.get(c, 0) * 0.9)
        if monthly.get("Bank Fees", 0) >= 2000:
            add(2, "bank fees", ["Bank Fees"], monthly["Bank Fees"] * 0.45)
        add(6, "gambling", ["Gambling & Betting"], monthly.get("Gambling & Betting", 0) * 0.95)
        # habits
        groups_of = {}
        for _, _, m, c, x, _ in spent:
            groups_of.setdefault((m, c), []).append(x)
        for (m, c), xs in groups_of.items():
            if len(xs) >= 6 and sum(xs) / len(xs) <= 20000 and wanted(c) and len(xs) / months >= 4:
                add(5, m, [c], sum(xs) / months * 0.5)
        # deliveries
        orders = {}
        for _, _, m, _, x, raw in spent:
            if raw and any(w in raw.lower() for w in hints):
                orders.setdefault(m, []).append(x)
        cents = sum(sum(xs) for xs in orders.values() if len(xs) >= 3)
        add(4, "delivery", ["Delivery Fees & Convenience", "Eating Out & Takeaways", "Groceries"], cents / months * 0.25)
        # recurring charges
        newest, subs = max(r[2] for r in mine if r[5] == "active"), []
        for m, xs in by_merchant.items():
            if m is None or len(xs) < 3:
                continue
            xs.sort()
            gaps = sorted(g for a, b in zip(xs, xs[1:]) if (g := (b[0] - a[0]).days) > 0)
            if len(gaps) < 2:
                continue
            gap = (gaps[len(gaps) // 2] + gaps[(len(gaps) - 1) // 2]) / 2
            cadence = next((k for k in recurring.CADENCES if k[1] <= gap <= k[2]), None)
            if not cadence or (newest - xs[-1][0]).days / gap > 1.6:
                continue
            amounts = sorted(x[2] for x in xs)
            typical = amounts[len(amounts) // 2]
            varies = (amounts[-1] - amounts[0]) / typical > (0.35 if cadence[0] in ("monthly", "quarterly") else 0.6)
            annual = typical * cadence[3]
            if cadence[0] in ("monthly", "quarterly", "annual") and not varies:
                subs.append((-annual, m, xs[0][3], annual // 12))
        subs.sort()
        for service in {g for g, _ in groups}:
            hit = sorted((-s[3], s[1], s[2]) for s in subs if any(w in s[1].lower() for g, w in groups if g == service))
            if len(hit) > 1:
                add(3, service, list(dict.fromkeys(c for _, _, c in hit[1:])), sum(-x for x, _, _ in hit[1:]))
        small = [s for s in subs if s[3] <= 30000 and wanted(s[2])]
        if len(small) >= 3:
            add(7, "small subscriptions", list(dict.fromkeys(s[2] for s in small)), sum(s[3] for s in small) * 0.4)
        rises, crept = 0, []
        for _, m, c, _ in subs:
            xs = by_merchant[m]
            half = len(xs) // 2
            if len(xs) >= 4:
                old, new = sum(x[2] for x in xs[:half]) / half, sum(x[2] for x in xs[half:]) / (len(xs) - half)
                if (new - old) / old >= 0.1 and new - old >= 1000:
                    rises += int(new) - int(old)
                    crept.append(c)
        add(8, "price creep", list(dict.fromkeys(crept)), rises)
        # spikes
        months_of = {}
        for _, d, _, c, x, _ in spent:
            months_of.setdefault(c, {}).setdefault(d.year * 12 + d.month, []).append(x)
        if spent:
            last = max(max(v) for v in months_of.values())
            for c, v in months_of.items():
                v = {k: sum(x) for k, x in v.items() if k > last - 6}
                if v and last - min(v) >= 2 and wanted(c):
                    earlier = [v.get(k, 0) for k in range(min(v), last)]
                    mean, now = sum(earlier) / len(earlier), v.get(last, 0)
                    if mean > 0 and now > 1.4 * mean and now - mean >= 20000:
                        add(9, c, [c], (now - round(mean, 4)) * 0.6)
    return out


def test_every_kind_of_finding_against_plain_python(spark):
    import random

    rng = random.Random(5)
    facts = {r.category: (r.kind, r.frivolity) for r in dims.categories(spark).collect()}
    groups = [(r.service, r.word) for r in dims.service_groups(spark).collect()]
    words = sorted({w for _, w in groups})
    cats = ["Fines & Penalties", "Interest & Penalties", "Bank Fees", "Gambling & Betting", "Subscriptions & Streaming", "Coffee & Snacks", "Eating Out & Takeaways", "Groceries", None, "Transfers"]
    rows, start = [], dt.date(2025, 1, 3)
    for account in range(1, 13):
        subs = [(rng.choice(words).title() + f" {k}", rng.choice([4, 8]), rng.choice(cats[4:7]), rng.randrange(900, 29000), rng.random() < 0.4) for k in range(rng.randrange(2, 7))]
        for name, _, c, price, creeps in subs:
            for k in range(6):
                rows.append((account, start + dt.timedelta(30 * k + rng.randrange(2)), name, c, "active", -(price + (5000 if creeps and k > 2 else 0))))
        for k in range(40 if account % 3 == 0 else 0):
            rows.append((account, start + dt.timedelta(4 * k), "Daily Cup", "Coffee & Snacks", "active", -rng.randrange(2000, 5000)))
        for _ in range(120):
            c = rng.choice(cats)
            name = rng.choice(["Vida Cafe", "Uber Eats", "Mr D Food", "Shop A", "Shop B", None, ""]) if c != "Bank Fees" else "Bank"
            when = start + dt.timedelta(rng.randrange(170) if rng.random() < 0.7 else 150 + rng.randrange(20))
            rows.append((account, when, name, c, rng.choice(["active"] * 9 + ["duplicate"]), rng.choice([-1, -1, -1, 1]) * rng.randrange(500, 20000)))
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, account_id long, txn_date date, merchant_norm string, category string, status string, amount_cents long")
    got = {(r.account_id, r.seq, r.key, tuple(r.categories), r.want) for r in advice.wants(df).collect()}
    want = _plain_wants(rows, facts, groups, [w.lower() for w in dims.DELIVERY_WORDS])
    assert got == want
    assert {r[1] for r in got} == set(range(1, 10))


@pytest.mark.parametrize("after", range(5))
def test_a_batch_that_fails_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch, after):
    """The stream dies after so many writes (4: behind the commit, 3: before it) and runs again."""
    from brassledger.streaming import batches

    folder = tmp_path / "in" / "account_id=1"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("Date,Description,Amount\n13/03/2025,Engen,-10.00\n14/04/2025,Vida,-20.00\n")
    root, left = str(tmp_path / "store"), [after]
    real_write, real_commit = batches._write, batches._commit

    def tripped(real, late):
        def run(*a):
            if left[0] == 0 and not late:
                left[0] = -1
                raise OSError("lost")
            done = real(*a)
            left[0] -= left[0] > 0
            if left[0] == 0 and late:
                left[0] = -1
                raise OSError("lost behind the commit")
            return done

        return run

    monkeypatch.setattr(batches, "_write", tripped(real_write, False))
    monkeypatch.setattr(batches, "_commit", tripped(real_commit, after == 4))
    run = lambda: jobs.import_files(spark, str(tmp_path / "in" / "account_id=*"), root, str(tmp_path / "work"), dims.rules(spark), F.lit(1).cast("long")).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    visible = {t: batches.table(spark, root, t, spark.range(0)).count() for t in ("ledger", "log", "statements")}
    assert set(visible.values()) == ({0} if after < 4 else {1, 2})
    monkeypatch.undo()
    run()
    run()
    assert {t: batches.table(spark, root, t).count() for t in ("ledger", "log", "statements")} == {"ledger": 2, "log": 1, "statements": 1}
    assert [r.outcome for r in batches.table(spark, root, "log").collect()] == ["imported"]


def test_compaction_replaces_batches_in_one_step(spark, tmp_path):
    from brassledger.streaming import batches

    root, by = str(tmp_path), {"t": ("m",)}
    rows = lambda k: spark.createDataFrame([(k, "x"), (k, "y")], "k int, m string")
    assert [batches.publish(spark, root, f"b{k}", {"t": rows(k), "u": rows(k)}, by) for k in (1, 2, 1)] == [True, True, False]
    old = batches.table(spark, root, "t")
    batches.compacted(spark, root, by)
    assert sorted(tuple(r) for r in batches.table(spark, root, "t").select("k", "m").collect()) == sorted(tuple(r) for r in old.select("k", "m").collect()) == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
    assert len(batches._records(spark, root)) == 1 and not batches.publish(spark, root, "b2", {"t": rows(2)}, by)
    batches.publish(spark, root, "b3", {"t": rows(3)}, by)
    assert batches.table(spark, root, "t").where("m = 'x'").count() == 3 and batches.table(spark, root, "u").count() == 4


def test_stored_receipts_bring_their_merchants_and_items(spark):
    body = '{"merchant": "%s", "date": "13/03/2025", "total": "10.00", "items": [{"description": " a ", "line_total": "4"}, {"description": " "}, {"description": "b", "line_total": "6"}]}'
    rows = [(1, 1, body % "Corner Shop"), (1, 2, body % "corner SHOP!"), (1, 3, body % "Engen"), (1, 4, body % ""), (1, 3, body % "Engen")]
    new = receipt_sources.from_payload(spark.createDataFrame(rows, "account_id long, receipt_id long, payload string")).withColumn("sha256", F.sha2("payload", 256))
    merchants = spark.createDataFrame([("engen", "Engen Garage", "Fuel")], "canonical string, merchant string, default_category string")
    kept, items, known = receipt_sources.store(new, new.limit(0), merchants)
    assert sorted(r.receipt_id for r in kept.collect()) == [1, 2, 3, 4]
    assert sorted((r.receipt_id, r.line_no, r.description, r.line_total_cents) for r in items.collect())[:2] == [(1, 0, "a", 400), (1, 1, "b", 600)]
    assert sorted(tuple(r) for r in known.collect()) == [("cornershop", "Corner Shop", None), ("engen", "Engen Garage", "Fuel")]


def test_near_misses(spark):
    day = dt.date(2025, 3, 13)
    ledger = [(10, 1, day, "Engen", -10000), (11, 1, day, "Shoprite", -5000), (12, 1, dt.date(2025, 3, 30), "Vida", -700), (13, 1, day, "Pharmacy", -4000), (14, 2, day, "Engen", -10000)]
    l = spark.createDataFrame([(i, a, d, m, None, 0, "active", c, None) for i, a, d, m, c in ledger], LEDGER)
    slips = [
        (1, 1, day, "Engen", 10000, "matched", 10), (2, 1, day, "Engen", 10050, "unmatched", None), (3, 1, day, "Zz", 5000, "unmatched", None), (4, 1, day, "Vida", 700, "unmatched", None),
        (5, 1, day, "Pharmacy", 9000, "unmatched", None), (6, 1, day, "Zz", 1, "unmatched", None), (7, 1, day, "Engen", None, "unmatched", None), (8, 1, None, None, 5100, "unmatched", None), (9, 3, day, "Engen", 10000, "unmatched", None),
    ]
    r = spark.createDataFrame(slips, "receipt_id long, account_id long, receipt_date date, merchant_norm string, total_cents long, link_status string, txn_id long")
    got = {x.receipt_id: (x.reason, x.txn_id) for x in match.near_misses(r, l).collect()}
    assert got == {
        2: ("claimed", 10), 3: ("name", 11), 4: ("date", 12), 5: ("amount", 13), 6: ("nothing_near", None), 7: ("no_total", None), 8: ("name", 11), 9: ("nothing_near", None),
    }


def test_profiles_of_a_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"one": {"txn_date": 0, "debit": "3", "description": 2, "name": "x"}, "two": {"description": [1, 4], "dayfirst": false}}')
    got = {r.profile: r for r in files.load_profiles(spark, str(tmp_path / "p.json")).collect()}
    assert (got["one"].txn_date, got["one"].debit, got["one"].description, got["one"].dayfirst, got["one"].amount) == (0, 3, [2], True, None)
    assert got["two"].description == [1, 4] and not got["two"].dayfirst and got["two"].outflow_is_negative
    (tmp_path / "bad.json").write_text("no json")
    assert files.load_profiles(spark, str(tmp_path / "bad.json")).count() == 0


def test_the_first_dates_of_a_file_decide_the_order(spark, tmp_path):
    lines = ["Date,Description,Amount", *(["03/25/2025,Shop,-1.00"] + ["03/04/2025,Shop,-1.00"] * 199), *["25/03/2025,Shop,-1.00"] * 5]
    (tmp_path / "d.csv").write_text("\n".join(lines) + "\n")
    rows, bad = files.read_statements(spark, str(tmp_path / "d.csv"))
    assert {str(r.txn_date) for r in rows.collect()} == {"2025-03-25", "2025-03-04"} and bad.count() == 0
