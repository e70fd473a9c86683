"""Queries over the store of imports, receipts and user decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import versions
from ..functions import money, text
from ..operators import advice, classify, dedupe, dims, imports, match, mutate, recurring, report
from ..shipping import ship
from ..sources import receipts as receipt_sources
from ..sources import statements as statement_files
from ..sources.fixtures import sql_views, view, write_files
from ..store import written
from ..streaming import batches, jobs
from . import links_sql
from .ledger_queries import _BOUGHT, _PAIRS, LINKED, ORACLE_SQL, OUT, L, _pairs, _work, query, with_categories

_RULED = ORACLE_SQL["rule_classification"]

# --- files: two batches of statements that overlap from the 12th to the 18th ---

_BATCHES = {"a": (1, 18), "b": (12, 31)}


def _account() -> Column:
    return F.regexp_extract("file", r"account_id=(\d+)", 1).cast("long")


def _write_files(s: SparkSession, d: str, batch: str, base: str) -> str:
    """A statement file for each account and batch, written from the ledger."""
    first, last = _BATCHES[batch]
    l = L(s, d).where(f"status = 'active' AND dayofmonth(txn_date) BETWEEN {first} AND {last}")
    shown = lambda c: (F.col(c).cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit('"'), "merchant_norm", F.lit('\n"'))).otherwise(F.col("merchant_norm"))  # some break the line inside quotes
    line = F.concat_ws(",", F.date_format("txn_date", "dd/MM/yyyy"), name, shown("amount_cents"), shown("balance_cents"))
    write_files(l, line, base, "Date,Description,Amount,Balance", "Closing balance,,,0.00")  # the last line is no row of the account
    return f"{base}/account_id=*"


#: The rows of each batch as the reader sees them: a file of fewer than three
#: balances whose amounts are all inflows is taken as outflows.
_FILES = (
    f"{sql_views('ledger')}, "
    + ", ".join(
        f"{b} AS (SELECT account_id, id, ts, txn_date, lower(merchant_norm) AS name, balance_cents, "
        f"CASE WHEN count(*) OVER p < 3 AND min(amount_cents) OVER p >= 0 THEN -amount_cents ELSE amount_cents END AS amount_cents "
        f"FROM ledger WHERE status = 'active' AND EXTRACT(DAY FROM txn_date) BETWEEN {x} AND {y} WINDOW p AS (PARTITION BY account_id))"
        for b, (x, y) in _BATCHES.items()
    )
)
_KEY = "account_id, txn_date, name, amount_cents, balance_cents"


@query(f"""{_FILES}, u AS (SELECT 'a' AS batch, * FROM a UNION ALL SELECT 'b', * FROM b), o AS (SELECT *, row_number() OVER w AS k, row_number() OVER v AS z FROM u WINDOW w AS (PARTITION BY batch, account_id ORDER BY ts, id), v AS (PARTITION BY batch, account_id ORDER BY ts DESC, id DESC))
SELECT batch, account_id, count(*) AS n_rows, min(txn_date) AS period_start, max(txn_date) AS period_end, max(balance_cents - amount_cents) FILTER (WHERE k = 1) AS opening_cents, max(balance_cents) FILTER (WHERE z = 1) AS closing_cents,
 coalesce(sum(-amount_cents) FILTER (WHERE amount_cents < 0), 0)::BIGINT AS out_cents, coalesce(sum(amount_cents) FILTER (WHERE amount_cents > 0), 0)::BIGINT AS in_cents, count(balance_cents) AS n_balances,
 1.0::DOUBLE AS confidence, 1::BIGINT AS n_skipped, concat_ws(',', CASE WHEN coalesce(sum(-amount_cents) FILTER (WHERE amount_cents < 0), 0) = 0 THEN 'inflow only' END, CASE WHEN 1 > 0.1 * (count(*) + 1) THEN 'many skipped' END) AS concerns FROM o GROUP BY 1, 2""")
def file_reports(s, d):
    """Reports on the files of both batches; each has a line that is no row."""
    ship(s)
    work = _work(s, "statement-files")
    for batch in _BATCHES:
        _write_files(s, d, batch, f"{work}/batch={batch}")
    report = statement_files.file_report(*statement_files.read_statements(s, f"{work}/batch=*/account_id=*"))
    return report.withColumn("account_id", _account()).withColumn("batch", F.regexp_extract("file", "/batch=([ab])/", 1)).drop("file")


_IMPORTED = f"""{_FILES}, u AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY ts, id) AS nth FROM b), old AS (SELECT DISTINCT {_KEY} FROM a), seen AS (SELECT account_id, min(txn_date) AS x, max(txn_date) AS y FROM a GROUP BY 1),
t AS (SELECT u.*, nth > 1 OR o.account_id IS NOT NULL AS exact FROM u LEFT JOIN old o USING ({_KEY})),
s AS (SELECT t.*, (SELECT max(CASE WHEN t.txn_date = o.txn_date THEN 0.97 WHEN abs(t.txn_date - o.txn_date) = 1 THEN 0.72 ELSE 0.58 END) FROM old o WHERE o.account_id = t.account_id AND o.amount_cents = t.amount_cents AND o.name = t.name AND o.balance_cents = t.balance_cents AND abs(t.txn_date - o.txn_date) <= 3
  AND EXISTS (SELECT 1 FROM seen WHERE seen.account_id = t.account_id AND t.txn_date BETWEEN x AND y)) AS score FROM t),
c AS (SELECT account_id, count(*) FILTER (WHERE NOT exact AND coalesce(score, 0) < 0.9) AS n_imported, count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE NOT exact AND score >= 0.9) AS n_held, count(*) FILTER (WHERE NOT exact AND score < 0.9) AS n_review,
 coalesce(sum(amount_cents) FILTER (WHERE NOT exact AND coalesce(score, 0) < 0.9 AND amount_cents > 0), 0)::BIGINT AS in_cents, coalesce(sum(-amount_cents) FILTER (WHERE NOT exact AND coalesce(score, 0) < 0.9 AND amount_cents < 0), 0)::BIGINT AS out_cents, 1::BIGINT AS n_skipped FROM s GROUP BY 1)"""


def _imported(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(rows with outcome, quarantine) of the second of two imports."""
    ship(s)
    rules, work = dims.rules(s), _work(s, "import")
    known, seen = imports.empty_ledger(s), imports.empty_statements(s)
    for batch in _BATCHES:
        rows, bad = statement_files.read_statements(s, _write_files(s, d, batch, f"{work}/files-{batch}"))
        parsed = written(rows.withColumn("account_id", _account()), "parsed")
        tagged = imports.import_batch(parsed, known, seen, rules, f"{work}/{batch}")
        known, seen = imports.additions(tagged), imports.statements_of(tagged)
    return tagged, bad.withColumn("account_id", _account())


@query(f"{_IMPORTED} SELECT * FROM c")
def import_report(s, d):
    """Two imports, the second of which overlaps the first: what became of its rows."""
    return imports.counters(*_imported(s, d))


@query(f"{_IMPORTED} SELECT * FROM c")
def one_batch_report(s, d):
    """The same files in one batch: what became of the rows of each account's second
    file, which sees the period and rows of its first."""
    ship(s)
    work = _work(s, "import-at-once")
    for batch in _BATCHES:
        _write_files(s, d, batch, f"{work}/files/{batch}")
    rows, bad = statement_files.read_statements(s, f"{work}/files/*/account_id=*")
    parsed = written(rows.withColumn("account_id", _account()), "parsed")
    tagged = imports.import_batch(parsed, imports.empty_ledger(s), imports.empty_statements(s), dims.rules(s), f"{work}/tagged")
    second = F.contains("file", F.lit("/files/b/"))
    return imports.counters(tagged.where(second), bad.where(second).withColumn("account_id", _account()))


@query(f"""{_IMPORTED} SELECT account_id, 'statement' AS kind, CASE WHEN n_imported + n_held > 0 THEN 'imported' ELSE 'nothing new' END AS outcome, n_imported || ' imported, ' || n_exact || ' exact, ' || n_held || ' held, ' || n_review || ' for review' AS detail FROM c""")
def import_log(s, d):
    """The log's lines of the second import."""
    return imports.audit(_imported(s, d)[0], F.lit(None)).select("account_id", "kind", "outcome", "detail")


@query(f"""{_FILES}, r AS (SELECT {_KEY} FROM a UNION SELECT {_KEY} FROM b)
SELECT account_id, txn_date, count(*) AS n, sum(amount_cents)::BIGINT AS cents FROM r GROUP BY 1, 2""")
def streamed_import(s, d):
    """Both batches through a stream of files, the second one twice: each row once."""
    ship(s)
    work = _work(s, "stream-import")
    for batch in ("a", "b"):
        _write_files(s, d, batch, f"{work}/files-{batch}")
        for run in range(1 + (batch == "b")):
            jobs.import_files(s, f"{work}/files-{batch}/account_id=*", f"{work}/ledger", f"{work}/{batch}{run}", dims.rules(s), _account()).awaitTermination()
    return batches.table(s, f"{work}/ledger", "ledger").groupBy("account_id", "txn_date").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"))


@query(f"""{_FILES}, n AS (SELECT account_id, count(DISTINCT ({_KEY})) AS first_rows FROM a GROUP BY 1), m AS (SELECT account_id, count(DISTINCT ({_KEY})) AS rows FROM (SELECT {_KEY}, account_id FROM a UNION ALL SELECT {_KEY}, account_id FROM b) GROUP BY 1),
s AS (SELECT account_id, 'a' AS batch, min(txn_date) AS x, max(txn_date) AS y FROM a GROUP BY 1 UNION ALL SELECT account_id, 'b', min(txn_date), max(txn_date) FROM b GROUP BY 1)
SELECT s.account_id, batch, x AS period_start, y AS period_end, CASE WHEN batch = 'a' THEN first_rows WHEN n.account_id IS NULL THEN m.rows ELSE m.rows - first_rows END AS added, 1::BIGINT AS log_lines FROM s LEFT JOIN n USING (account_id) LEFT JOIN m USING (account_id)""")
def streamed_tables(s, d):
    """Ledger, log and statements after both batches have come through a stream and
    been put together: each file's period, the rows that it added and its log line."""
    ship(s)
    work = _work(s, "stream-tables")
    for batch in ("a", "b"):
        _write_files(s, d, batch, f"{work}/files-{batch}")
        jobs.import_files(s, f"{work}/files-{batch}/account_id=*", f"{work}/store", f"{work}/{batch}", dims.rules(s), _account()).awaitTermination()
    batches.compacted(s, f"{work}/store", jobs.BY)
    ledger, log, seen = (batches.table(s, f"{work}/store", t) for t in ("ledger", "log", "statements"))
    added = ledger.groupBy("account_id", "sha256").agg(F.count("*").alias("added"))
    lines = log.groupBy(F.col("ref").alias("file")).agg(F.count("*").alias("log_lines"))
    out = seen.join(added, ["account_id", "sha256"], "left").join(lines, "file", "left").withColumn("batch", F.regexp_extract("file", "files-([ab])/", 1))
    return out.select("account_id", "batch", "period_start", "period_end", F.coalesce("added", F.lit(0)).alias("added"), "log_lines")


@query(f"""{_FILES} SELECT account_id, count(*) AS n, sum(amount_cents)::BIGINT AS cents, min(txn_date) AS first, max(txn_date) AS last FROM b GROUP BY 1""")
def profiled_files(s, d):
    """Files without a header, month first, outflows positive, read by a named profile."""
    ship(s)
    first, last = _BATCHES["b"]
    l = L(s, d).where(f"status = 'active' AND dayofmonth(txn_date) BETWEEN {first} AND {last}")
    shown = lambda c: (c.cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    line = F.concat_ws(";", "merchant_norm", shown(F.col("balance_cents")), shown(-F.col("amount_cents")), F.date_format("txn_date", "MM/dd/yyyy"))
    path = _work(s, "profiled-files")
    write_files(l, line, path)
    book = F.lit('{"profiles": {"reversed": {"txn_date": 3, "amount": 2, "balance": 1, "description": [0], "outflow_is_negative": false, "dayfirst": false}}}')
    s.range(1).select(book.alias("value")).write.text(f"{path}-profiles")
    profiles = statement_files.load_profiles(s, f"{path}-profiles")
    lines = statement_files.scan(s, f"{path}/account_id=*")
    chosen = lines.select("file").distinct().withColumn("profile", F.lit("reversed"))
    rows = statement_files.typed(lines, chosen, profiles)[0].withColumn("account_id", _account())
    return rows.groupBy("account_id").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"), F.min("txn_date").alias("first"), F.max("txn_date").alias("last"))


@query(f"""WITH rules(rule_id, priority, pattern, category, merchant, txn_type) AS (VALUES {dims.rules_sql()})
SELECT pattern, CASE WHEN priority <= 10 THEN 'Gifts & Donations' ELSE category END AS category, priority FROM rules""")
def seeded_rules(s, d):
    """The shipped pack loaded again over a table in which rows have been changed."""
    pack = dims.rules(s)
    changed = pack.where("priority <= 10").withColumn("category", F.lit("Gifts & Donations"))
    return dims.seed_absent(changed, pack, "field", "match_type", "pattern", "source").select("pattern", "category", "priority")


# --- review and lookup ---


@query(f"""{_PAIRS} SELECT p.account_id, new_id, existing_id, score, verdict, n.txn_date AS new_date, e.txn_date AS existing_date, n.merchant_norm AS new_name, e.merchant_norm AS existing_name, n.amount_cents, s.statement_id AS existing_statement
 FROM pairs p JOIN incoming n ON n.id = new_id JOIN ledger e ON e.id = existing_id LEFT JOIN statements s ON s.account_id = e.account_id AND e.txn_date BETWEEN s.period_start AND s.period_end WHERE verdict = 'review'""")
def review_queue(s, d):
    n, e = view(s, d, "incoming"), L(s, d)
    side = lambda df, x: df.select(F.col("id").alias(f"{x}_id"), F.col("txn_date").alias(f"{x}_date"), F.col("merchant_norm").alias(f"{x}_name"), *(["amount_cents"] if x == "new" else []))
    pairs = _pairs(s, d).where("verdict = 'review'").drop("gap_days")
    found = pairs.join(side(n, "new"), "new_id").join(side(e, "existing"), "existing_id")
    st = view(s, d, "statements").select(F.col("account_id").alias("_a"), F.col("statement_id").alias("existing_statement"), "period_start", "period_end")
    found = found.join(st, (F.col("account_id") == F.col("_a")) & F.col("existing_date").between(F.col("period_start"), F.col("period_end")), "left").drop("_a", "period_start", "period_end")
    return found.orderBy(F.desc("score"), "new_date", "new_id", "existing_id")


@query(f"""{_PAIRS} SELECT p.account_id, count(*) AS n FROM pairs p JOIN ledger e ON e.id = existing_id WHERE verdict = 'review' AND e.txn_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-15' GROUP BY 1""")
def pending_in_period(s, d):
    pairs = _pairs(s, d).where("verdict = 'review'")
    rows = L(s, d).where("txn_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'").select(F.col("id").alias("existing_id"))
    return pairs.join(rows, "existing_id", "left_semi").groupBy("account_id").agg(F.count("*").alias("n"))


@query(f"""{sql_views('ledger', 'statements')} SELECT statement_id, s.account_id, 'account ' || s.account_id AS name, period_start, period_end FROM statements s ORDER BY period_end DESC, statement_id DESC LIMIT 25""")
def recent_statements(s, d):
    accounts = L(s, d).select("account_id", F.concat(F.lit("account "), "account_id").alias("name")).distinct()
    return view(s, d, "statements").join(accounts, "account_id").select("statement_id", "account_id", "name", "period_start", "period_end").orderBy(F.desc("period_end"), F.desc("statement_id")).limit(25)


@query(f"""{sql_views('ledger', 'receipts')}, n AS (SELECT receipt_id AS id, count(*) AS n_receipts FROM receipts GROUP BY 1)
SELECT l.id, account_id, txn_date, -amount_cents AS cents, coalesce(n_receipts, 0) AS n_receipts FROM ledger l LEFT JOIN n USING (id) WHERE {OUT} AND merchant_norm = 'purchase-3'""")
def merchant_drill_down(s, d):
    r = view(s, d, "receipts").select(F.col("receipt_id").alias("txn_id"))
    return report.drill_down(L(s, d), "purchase-3", r).select("id", "account_id", "txn_date", F.negate("amount_cents").alias("cents"), "n_receipts")


@query(f"""{sql_views('ledger')}, p AS (SELECT count(*) AS n, coalesce(sum(-amount_cents), 0)::BIGINT AS cents FROM (SELECT * FROM ledger WHERE {OUT} AND coalesce(category, 'Uncategorised') = 'Groceries' AND txn_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND contains(merchant_norm, 'view') ORDER BY txn_date DESC, id DESC LIMIT 250)) SELECT * FROM p""")
def ledger_page_total(s, d):
    """Rows and outflow of one page of a filtered ledger."""
    page = report.search(L(s, d), "VIEW", category_is="Groceries", start="2024-01-05", end="2024-01-20")
    return page.agg(F.count("*").alias("n"), F.coalesce(F.sum(-F.col("amount_cents")), F.lit(0)).alias("cents"))


@query(f"""{sql_views('ledger')}, e AS (SELECT account_id, min(txn_date) AS a, max(txn_date) AS b, count(*) FILTER (WHERE txn_date = DATE '2024-01-30') AS n FROM ledger GROUP BY 1)
SELECT account_id, CASE WHEN n > 0 THEN DATE '2024-01-30' ELSE a END AS start, CASE WHEN n > 0 THEN DATE '2024-01-30' ELSE b END AS "end" FROM e""")
def default_periods(s, d):
    day = F.lit("2024-01-30").cast("date")
    l = L(s, d)
    return report.default_period(l, l.select("account_id", day.alias("start"), day.alias("end")).distinct())


@query(f"""{sql_views('ledger')} SELECT account_id, account_id % 2 = 0 AS chosen, count(*) AS n, coalesce(sum(-amount_cents) FILTER (WHERE amount_cents < 0), 0)::BIGINT AS out_cents FROM ledger WHERE status = 'active' GROUP BY 1""")
def account_filter(s, d):
    """Totals of all accounts, with those marked that a request (a table) names."""
    request = L(s, d).select("account_id").distinct().where("account_id % 2 = 0").withColumn("chosen", F.lit(True))
    some = L(s, d).where("status = 'active'").join(request, "account_id", "left").fillna(False, ["chosen"])
    return some.groupBy("account_id", "chosen").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("amount_cents") < 0, -F.col("amount_cents"))), F.lit(0)).alias("out_cents"))


# --- advice ---


@query(ORACLE_SQL["frivolous_rows"].replace("frivolity / 3 * CASE", "CASE WHEN merchant_norm = 'view-3' THEN 1 ELSE 0 END AS flag, frivolity / 3 * CASE").replace("base +", "CASE WHEN flag = 1 THEN greatest(base, 0.9) ELSE base END +").replace(
    "CASE WHEN habit THEN 'habit' END)", "CASE WHEN flag = 1 THEN 'merchant' END, CASE WHEN habit THEN 'habit' END)"))
def frivolous_flagged(s, d):
    """As frivolous_rows, with one merchant that a person has flagged."""
    flags = L(s, d).where("merchant_norm = 'view-3'").select(F.col("merchant_norm").alias("merchant"))
    return advice.frivolity(L(s, d), flagged=flags)


@query(f"WITH x AS ({ORACLE_SQL['frivolous_rows']}) SELECT account_id, count(*) AS n, sum(cents)::BIGINT AS cents FROM x GROUP BY 1")
def frivolous_totals(s, d):
    return advice.frivolity(L(s, d)).groupBy("account_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"""{sql_views('ledger', 'narrations')} SELECT account_id, 'Uber Eats' AS merchant, count(*) AS n, sum(-amount_cents)::BIGINT AS cents FROM narrations WHERE id % 12 = 3 AND amount_cents < 0 GROUP BY 1""")
def delivery_orders(s, d):
    named = classify.classify(view(s, d, "narrations"), dims.rules(s)).withColumnRenamed("merchant", "merchant_norm")
    return advice.deliveries(named.withColumn("status", F.lit("active")))


@query()
def advice_summary(s, d):
    ship(s)
    return advice.advice_totals(advice.advice(L(s, d)), L(s, d))


@query()
def advice_ranked(s, d):
    """Findings in the order in which an account's list shows them."""
    ship(s)
    return advice.ranked(advice.advice(L(s, d)))


@query(f"WITH x AS ({ORACLE_SQL['frivolous_rows']}) SELECT * FROM (SELECT *, sum(cents) OVER (PARTITION BY account_id)::BIGINT AS total_cents, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, cents DESC, id)::INT AS rank FROM x) WHERE rank <= 200")
def frivolous_ranked(s, d):
    return advice.frivolity_ranked(L(s, d))


# --- classification again ---



@query(f"""WITH c AS ({_RULED}) SELECT id, account_id, CASE WHEN category_source = 'default' AND amount_cents <= 0 AND merchant = 'Qwerty Trading' THEN 'Shopping & Clothing' ELSE category END AS category,
 CASE WHEN category_source = 'default' AND amount_cents <= 0 AND merchant = 'Qwerty Trading' THEN 'merchant' ELSE category_source END AS category_source FROM c""")
def merchant_defaults(s, d):
    """Classification where no rule speaks but the merchant has a default."""
    names = view(s, d, "narrations").select(text.canonical_key(text.merchant_name(text.clean_description(F.col("description_raw")))).alias("canonical")).distinct()
    known = names.where("canonical = 'qwertytrading'").withColumn("default_category", F.lit("Shopping & Clothing"))
    return classify.classify(view(s, d, "narrations"), dims.rules(s), known).select("id", "account_id", "category", "category_source")


@query(f"""WITH c AS ({_RULED}), o AS (SELECT DISTINCT account_id FROM c WHERE merchant ILIKE 'qwerty trading' AND id % 60 = 11)
SELECT id, c.account_id, CASE WHEN category_source = 'default' AND amount_cents < 0 THEN CASE WHEN o.account_id IS NULL THEN 'Shopping & Clothing' ELSE 'Gifts & Donations' END ELSE category END AS category,
 CASE WHEN category_source = 'default' AND amount_cents < 0 THEN 'merchant' ELSE category_source END AS category_source FROM c LEFT JOIN o USING (account_id)""")
def account_defaults(s, d):
    """Accounts correct a merchant; the merchants that come back are given to the
    classification: theirs is their choice, for all others the shared default stays."""
    n, rules = view(s, d, "narrations"), dims.rules(s)
    known = s.range(1).select(F.lit(None).cast("long").alias("account_id"), F.lit("qwertytrading").alias("canonical"), F.lit("Shopping & Clothing").alias("default_category"))
    l = classify.classify(n, rules, known).withColumnRenamed("merchant", "merchant_norm")
    changes = l.where("id % 60 = 11").select("id", F.lit("Gifts & Donations").alias("new_category"))
    _, _, known = mutate.set_category(l, changes, rules, known)
    return classify.classify(n, rules, known).select("id", "account_id", "category", "category_source")


@query(f"""WITH c AS ({_RULED}) SELECT id, account_id, CASE WHEN id % 4 = 0 THEN 'Gifts' ELSE category END AS category, CASE WHEN id % 4 = 0 THEN 'user' ELSE category_source END AS category_source,
 CASE WHEN id % 4 = 0 THEN 'eft' WHEN txn_type = 'other' THEN 'eft' ELSE txn_type END AS txn_type FROM c""")
def reclassified_rows(s, d):
    """All rows classified again but those that a user has set."""
    n = view(s, d, "narrations")
    mine = F.col("id") % 4 == 0
    n = n.withColumn("merchant", F.lit("x")).withColumn("category", F.when(mine, "Gifts")).withColumn("category_source", F.when(mine, "user")).withColumn("txn_type", F.lit("eft"))
    return classify.reclassified(n, dims.rules(s), all_but_user=True).select("id", "account_id", "category", "category_source", "txn_type")


def _changes(s: SparkSession, d: str) -> DataFrame:
    return L(s, d).where("category IS NULL").select("id", F.col("merchant_norm").alias("merchant"), F.lit("Groceries").alias("new_category"))


@query(f"""{sql_views('ledger')} SELECT coalesce(category, 'Groceries') AS category, CASE WHEN category IS NULL THEN 'user' ELSE 'default' END AS category_source, count(*) AS n, sum(amount_cents)::BIGINT AS cents FROM ledger GROUP BY 1, 2""")
def user_categories(s, d):
    l, _, _ = mutate.set_category(L(s, d), _changes(s, d), dims.rules(s))
    return l.groupBy("category", "category_source").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"))


@query(f"""{sql_views('ledger')} SELECT DISTINCT account_id, lower(merchant_norm) AS pattern, 'Groceries' AS category, 5 AS priority FROM ledger WHERE category IS NULL""")
def learned_rules(s, d):
    _, rules, _ = mutate.set_category(L(s, d), _changes(s, d), dims.rules(s))
    return rules.where("source = 'user'").select("account_id", "pattern", "category", "priority")


@query(f"""WITH c AS ({_RULED}), ch AS (SELECT DISTINCT account_id FROM c WHERE id % 60 = 11) SELECT id, account_id,
 CASE WHEN id % 60 = 11 OR (id % 12 = 11 AND amount_cents <= 0 AND account_id IN (SELECT account_id FROM ch)) THEN 'Gifts & Donations' ELSE category END AS category,
 CASE WHEN id % 60 = 11 THEN 'user' WHEN id % 12 = 11 AND amount_cents <= 0 AND account_id IN (SELECT account_id FROM ch) THEN 'rule' ELSE category_source END AS category_source FROM c""")
def user_choices_kept(s, d):
    """Some rows are given a category by hand, then all are classified again: the
    choices stay, and the account's other rows of the merchant follow them."""
    l = classify.classify(view(s, d, "narrations"), dims.rules(s)).withColumnRenamed("merchant", "merchant_norm")
    changes = l.where("id % 60 = 11").select("id", F.lit("Gifts & Donations").alias("new_category"))
    l, rules, _ = mutate.set_category(l, changes, dims.rules(s))
    return classify.reclassified(l.withColumnRenamed("merchant_norm", "merchant"), rules, all_but_user=True).select("id", "account_id", "category", "category_source")


@query(f"""{sql_views('ledger')} SELECT DISTINCT 'account ' || account_id AS name FROM ledger""")
def accounts_created(s, d):
    names = L(s, d).select("account_id", F.concat(F.lit("account "), "account_id").alias("name")).distinct()
    return mutate.accounts_with(names.where("account_id % 2 = 0"), names.select("name")).select("name")


# --- undo ---


@query(f"""{sql_views('ledger', 'receipts')}, t AS (SELECT id, account_id * 10 + CAST(FLOOR((EXTRACT(DAY FROM txn_date)-1)/10) AS BIGINT) AS statement_id FROM ledger),
x AS (SELECT DISTINCT statement_id FROM t JOIN receipts ON receipt_id = id WHERE receipt_id % 10 = 0)
SELECT statement_id, count(*) AS n FROM t WHERE NOT (statement_id % 7 = 0 AND statement_id NOT IN (SELECT statement_id FROM x)) GROUP BY 1""")
def undone_imports(s, d):
    """Undoes some statements; those whose rows receipts are linked to refuse."""
    t = L(s, d).withColumn("statement_id", F.col("account_id") * 10 + F.floor((F.dayofmonth("txn_date") - 1) / 10))
    receipts = view(s, d, "receipts").select("receipt_id", F.when(F.col("receipt_id") % 10 == 0, F.col("receipt_id")).alias("txn_id"), F.lit("matched").alias("link_status"))
    none = s.createDataFrame([], "withdrawal_id long, receipt_id long")
    pairs = _pairs(s, d)
    ids = t.select("statement_id").distinct()
    tables = {"statements": ids, "transactions": t, "receipts": receipts, "allocations": none, "candidates": pairs}
    return mutate.undo(tables, ids.where("statement_id % 7 = 0"))["transactions"].groupBy("statement_id").agg(F.count("*").alias("n"))


# --- receipts ---


@query(f"""{sql_views('ledger', 'receipts')} SELECT a.account_id, a.receipt_date, a.total_cents, a.receipt_id AS first_id, b.receipt_id AS second_id FROM receipts a JOIN receipts b
 ON a.account_id = b.account_id AND a.receipt_date = b.receipt_date AND a.total_cents = b.total_cents AND a.receipt_id < b.receipt_id AND split_part(a.merchant_norm, '-', 1) = split_part(b.merchant_norm, '-', 1)
 UNION ALL SELECT account_id, receipt_date, total_cents, receipt_id, receipt_id + 1000000 FROM receipts WHERE receipt_id % 15 = 0""")
def same_slips(s, d):
    """Receipts stored twice; some are repeated under another id to have a few."""
    r = view(s, d, "receipts")
    again = r.where("receipt_id % 15 = 0").withColumn("receipt_id", F.col("receipt_id") + 1000000)
    return match.same_slips(r.unionByName(again))


@query(f"""{sql_views('ledger', 'receipts')} SELECT CASE WHEN receipt_id % 4 = 0 THEN 'ignored' ELSE 'unmatched' END AS link_status, count(*) AS n, sum(total_cents)::BIGINT AS cents FROM receipts GROUP BY 1""")
def ignored_receipts(s, d):
    r = view(s, d, "receipts").withColumn("link_status", F.lit("unmatched"))
    left, _ = mutate.ignore_receipts(r, r.select("receipt_id"), r.where("receipt_id % 4 = 0").select("receipt_id"))
    return left.groupBy("link_status").agg(F.count("*").alias("n"), F.sum("total_cents").alias("cents"))


_SLIPS = """rs AS (SELECT *, CASE WHEN receipt_id % 4 = 0 THEN 'unmatched' WHEN receipt_id % 4 = 1 THEN 'matched' ELSE 'cash_allocated' END AS link_status, CASE WHEN receipt_id % 4 = 1 THEN receipt_id END AS txn_id FROM receipts)"""


def _slips(s: SparkSession, d: str) -> DataFrame:
    r, n = view(s, d, "receipts"), F.col("receipt_id") % 4
    return r.withColumn("link_status", F.when(n == 0, "unmatched").when(n == 1, "matched").otherwise("cash_allocated")).withColumn("txn_id", F.when(n == 1, F.col("receipt_id")))


@query(f"""{sql_views('ledger', 'receipts')}, {_SLIPS} SELECT r.*, l.txn_date AS paid_date, -l.amount_cents AS paid_cents FROM rs r LEFT JOIN ledger l ON l.id = txn_id WHERE link_status = 'matched'""")
def receipts_matched(s, d):
    """The receipts of one link status, newest first, with the rows that paid."""
    return report.receipts_list(_slips(s, d), L(s, d), "matched")


@query(f"""{sql_views('ledger', 'receipts')}, {_SLIPS}, a AS (SELECT receipt_id, l.id AS w, l.txn_date AS x, least(-amount_cents, total_cents) AS n FROM rs JOIN ledger l ON l.account_id = rs.account_id AND {OUT} AND is_cash_withdrawal = 1 AND l.txn_date BETWEEN receipt_date - 21 AND receipt_date WHERE link_status = 'cash_allocated'),
g AS (SELECT receipt_id, count(*) AS n_allocations, sum(n)::BIGINT AS drawn_cents, min(x) AS first_drawn FROM a GROUP BY 1)
SELECT r.receipt_id, link_status, l.txn_date AS paid_date, coalesce(n_allocations, 0)::INT AS n_allocations, coalesce(drawn_cents, 0) AS drawn_cents, first_drawn FROM rs r LEFT JOIN ledger l ON l.id = txn_id LEFT JOIN g ON g.receipt_id = r.receipt_id""")
def receipt_detail(s, d):
    """Each receipt with what paid for it; every withdrawal before a cash slip counts as drawn on."""
    r, rows = _slips(s, d), L(s, d)
    cash = match.cash_candidates(r.where("link_status = 'cash_allocated'"), rows).select("receipt_id", "withdrawal_id", F.least("withdrawn", "total_cents").alias("amount_cents"))
    found = report.receipt_details(r, cash, rows)
    drawn = F.aggregate(F.coalesce("allocations", F.array()), F.lit(0).cast("long"), lambda t, a: t + a["amount_cents"])
    return found.select(
        "receipt_id", "link_status", "paid_date", F.coalesce(F.size("allocations"), F.lit(0)).alias("n_allocations"), drawn.alias("drawn_cents"), F.array_min(F.transform("allocations", lambda a: a["drawn_on"])).alias("first_drawn")
    )


@query(f"{LINKED} SELECT l.*, txn_date, -amount_cents AS paid_cents, t.merchant_norm AS paid_to FROM links l LEFT JOIN ledger t ON t.id = l.txn_id")
def receipt_overview(s, d):
    """Every receipt with its link and the ledger row behind it."""
    ship(s)
    linked, _ = match.link_receipts(view(s, d, "receipts"), L(s, d))
    rows = L(s, d).select(F.col("id").alias("txn_id"), "txn_date", F.negate("amount_cents").alias("paid_cents"), F.col("merchant_norm").alias("paid_to"))
    return linked.join(rows, "txn_id", "left")


_EARLIER = "early AS (SELECT * FROM ledger WHERE EXTRACT(DAY FROM txn_date) <= 15)"
_AGAIN = "again AS (SELECT account_id, receipt_id, receipt_date, merchant_norm, total_cents, tender_type FROM links_first WHERE link_status <> 'matched')"


@query(f"""{sql_views('ledger', 'receipts').replace('WITH', 'WITH RECURSIVE', 1)}, {_EARLIER}, {links_sql.walk('_first', 'early')}, {_AGAIN},
{links_sql.walk('_again', 'ledger', 'again', "SELECT txn_id FROM links_first WHERE link_status = 'matched'")}
SELECT link_status, count(*) AS n FROM (SELECT link_status FROM links_first WHERE link_status = 'matched' UNION ALL SELECT link_status FROM links_again) GROUP BY 1""")
def receipts_rematched(s, d):
    """Counts by status after the unmatched are tried again against a later ledger."""
    ship(s)
    linked, _ = match.link_receipts(view(s, d, "receipts"), L(s, d).where("dayofmonth(txn_date) <= 15"))
    path = _work(s, "linked")
    linked.write.parquet(path)
    return match.rematch(s.read.parquet(path), L(s, d)).groupBy("link_status").agg(F.count("*").alias("n"))


@query(f"""{LINKED}, c AS (SELECT txn_id AS id, {_BOUGHT} AS bought FROM links WHERE link_status = 'matched')
SELECT CASE WHEN coalesce(category, 'Uncategorised') = 'Uncategorised' THEN coalesce(bought, category) ELSE category END AS category, count(*) AS n, sum(amount_cents)::BIGINT AS cents FROM ledger LEFT JOIN c USING (id) GROUP BY 1""")
def enriched_ledger(s, d):
    """The ledger with what matched receipts know; amounts stay."""
    ship(s)
    linked, _ = match.link_receipts(view(s, d, "receipts"), L(s, d))
    return mutate.enrich(L(s, d), with_categories(linked)).groupBy("category").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"))


@query(f"""{LINKED}, r AS ({ORACLE_SQL['reconciliation']}), b AS ({ORACLE_SQL['balance_check']}), d AS ({ORACLE_SQL['statement_coverage']}), p AS ({_PAIRS} SELECT account_id, count(*) AS n_pending FROM pairs WHERE verdict = 'review' GROUP BY 1),
x AS (SELECT account_id, sum(amount_cents)::BIGINT AS explained FROM cash GROUP BY 1),
s AS (SELECT account_id, count(*) FILTER (WHERE link_status = 'matched') AS n_matched, count(*) FILTER (WHERE link_status = 'cash_allocated') AS n_cash, count(*) FILTER (WHERE link_status = 'unmatched') AS n_unmatched FROM links GROUP BY 1),
t AS (SELECT r.*, greatest(0, cash_cents - coalesce(explained, 0)) AS open_cents, agrees, coalesce(covered_days, 0) AS covered_days, total_days, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_matched, 0) AS n_matched, coalesce(n_cash, 0) AS n_cash,
 coalesce(n_unmatched, 0) AS n_unmatched, coalesce(n_pending, 0) AS n_pending FROM r LEFT JOIN b USING (account_id) LEFT JOIN d USING (account_id) LEFT JOIN p USING (account_id) LEFT JOIN x USING (account_id) LEFT JOIN s USING (account_id))
SELECT account_id, residual_cents = 0 AS reconciles, agrees AS balances_agree, covered_days, total_days, cash_cents, cash_cents - open_cents AS cash_explained_cents, n_matched, n_cash, n_unmatched, n_pending,
 round(CASE WHEN outflow_cents > 0 THEN greatest(0.0, 1 - (open_cents + uncategorised_cents) / outflow_cents) ELSE 1.0 END, 6) AS explained_share,
 concat_ws(',', CASE WHEN residual_cents <> 0 THEN 'residual' END, CASE WHEN open_cents > 0 THEN 'unexplained_cash' END, CASE WHEN uncategorised_cents > 0.05 * outflow_cents THEN 'uncategorised' END,
  CASE WHEN n_gaps > 0 OR total_days IS NULL THEN 'coverage_gaps' END, CASE WHEN NOT agrees THEN 'balances' END, CASE WHEN n_pending > 0 THEN 'pending_duplicates' END, CASE WHEN n_unmatched > 0 THEN 'unmatched_receipts' END) AS warnings FROM t""")
def completeness(s, d):
    ship(s)
    linked, cash = match.link_receipts(view(s, d, "receipts"), L(s, d))
    pending = _pairs(s, d).where("verdict = 'review'")
    return report.completeness(L(s, d), view(s, d, "statements"), linked, cash, pending)


@query(f"""{sql_views('ledger', 'receipts')} SELECT receipt_id, 'Coffee & Snacks' AS category, '' AS warnings FROM receipts WHERE merchant_norm LIKE 'click-%' AND receipt_id % 2 = 1
 UNION ALL SELECT receipt_id, NULL, 'lines_differ' FROM receipts WHERE merchant_norm LIKE 'purchase-%' AND receipt_id % 2 = 1""")
def receipts_stored(s, d):
    """Receipts of which half are stored already; lines of card slips do not add up."""
    r = view(s, d, "receipts")
    shown = lambda c: money.from_cents(c).cast("decimal(20,2)").cast("string")
    line = F.col("total_cents") + F.when(F.startswith("merchant_norm", F.lit("purchase-")), 1000).otherwise(0)
    item = F.struct(F.lit("item").alias("description"), F.lit("1").alias("quantity"), shown(line).alias("unit_price"), shown(line).alias("line_total"))
    unique = F.concat("merchant_norm", F.lit(" no "), F.md5(F.col("receipt_id").cast("string")))
    body = F.to_json(F.struct(unique.alias("merchant"), F.date_format("receipt_date", "dd/MM/yyyy").alias("date"), shown(F.col("total_cents")).alias("total"), "tender_type", F.lit("high").alias("confidence"), F.array(item).alias("items")))
    p = receipt_sources.from_payload(r.select("account_id", "receipt_id", body.alias("payload"))).withColumn("sha256", F.sha2("payload", 256))
    merchants = p.where("merchant LIKE 'click-%'").select(text.canonical_key(F.col("merchant")).alias("canonical")).distinct().withColumn("default_category", F.lit("Coffee & Snacks"))
    known = p.where("receipt_id % 2 = 0")
    return receipt_sources.stored(p, known, merchants).select("receipt_id", "category", "warnings")


@query(f"""{sql_views('ledger', 'receipts')}, l AS (SELECT account_id, id, txn_date, md5(merchant_norm) AS name, -amount_cents AS cents FROM ledger WHERE {OUT} AND is_cash_withdrawal = 0),
r AS (SELECT account_id, receipt_id, CASE WHEN receipt_id % 4 = 2 THEN receipt_date + 20 ELSE receipt_date END AS receipt_date, CASE receipt_id % 4 WHEN 0 THEN NULL WHEN 3 THEN total_cents * 3 ELSE total_cents END AS total,
 CASE WHEN receipt_id % 4 = 1 THEN md5('x' || receipt_id) ELSE md5(merchant_norm) END AS name, receipt_id % 12 = 7 AS linked FROM receipts),
e AS (SELECT r.receipt_id, l.id, abs(l.cents - r.total) AS off, l.txn_date - r.receipt_date AS gap, abs(l.cents - r.total) <= greatest(200, 0.05 * r.total) AS a, l.txn_date - r.receipt_date BETWEEN -2 AND 4 AS d, l.name = r.name AS n,
 l.id IN (SELECT receipt_id FROM r WHERE linked) AS taken FROM r JOIN l USING (account_id) WHERE NOT linked AND r.total > 0),
k AS (SELECT *, CASE WHEN a AND d AND n AND taken THEN 4 WHEN a AND d THEN 3 WHEN a AND n AND abs(gap) <= 31 THEN 2 WHEN d AND n THEN 1 END AS rank FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY rank DESC, off, abs(gap), id) AS z FROM k WHERE rank IS NOT NULL)
SELECT r.receipt_id, CASE WHEN r.total IS NULL THEN 'no_total' ELSE ['nothing_near', 'amount', 'date', 'name', 'claimed'][coalesce(b.rank, 0) + 1] END AS reason, b.id AS txn_id, b.off AS off_cents, b.gap AS gap_days FROM r LEFT JOIN b ON b.receipt_id = r.receipt_id AND z = 1 WHERE NOT linked""")
def unmatched_reasons(s, d):
    """Why slips stayed unmatched: some have no total, another name, a day three weeks
    later or three times the amount, and a few rows are held by other receipts."""
    r, n = view(s, d, "receipts"), F.col("receipt_id") % 4
    linked = F.col("receipt_id") % 12 == 7
    r = r.select(
        "account_id", "receipt_id", F.when(n == 2, F.date_add("receipt_date", 20)).otherwise(F.col("receipt_date")).alias("receipt_date"),
        F.when(n == 0, None).when(n == 3, F.col("total_cents") * 3).otherwise(F.col("total_cents")).alias("total_cents"),
        F.md5(F.when(n == 1, F.concat(F.lit("x"), F.col("receipt_id"))).otherwise(F.col("merchant_norm"))).alias("merchant_norm"),
        F.when(linked, "matched").otherwise("unmatched").alias("link_status"), F.when(linked, F.col("receipt_id")).alias("txn_id"),
    )
    return match.near_misses(r, L(s, d).withColumn("merchant_norm", F.md5("merchant_norm")))


@query(f"""{sql_views('receipts')} SELECT receipt_id, n::INT AS line_no, CASE n WHEN 0 THEN 'goods' ELSE 'bag' END AS description, 1.0::DOUBLE AS quantity, CASE n WHEN 0 THEN total_cents - 50 ELSE 50 END AS unit_price_cents, CASE n WHEN 0 THEN total_cents - 50 ELSE 50 END AS line_total_cents
FROM receipts, range(2) x(n) WHERE receipt_id % 2 = 1""")
def receipt_items(s, d):
    """The lines of newly stored receipts, as rows; half of the slips are stored already."""
    shown = lambda c: money.from_cents(c).cast("decimal(20,2)").cast("string")
    item = lambda name, c: F.struct(F.lit(name).alias("description"), F.lit("1").alias("quantity"), shown(c).alias("unit_price"), shown(c).alias("line_total"))
    lines = F.array(item(" goods ", F.col("total_cents") - 50), item(" ", F.lit(7)), item("bag", F.lit(50)))
    body = F.to_json(F.struct(F.col("merchant_norm").alias("merchant"), F.date_format("receipt_date", "dd/MM/yyyy").alias("date"), shown(F.col("total_cents")).alias("total"), "tender_type", lines.alias("items"), F.col("receipt_id").cast("string").alias("time")))
    p = receipt_sources.from_payload(view(s, d, "receipts").select("account_id", "receipt_id", body.alias("payload"))).withColumn("sha256", F.sha2("payload", 256))
    merchants = s.range(0).select(F.lit("").alias("canonical"), F.lit("").alias("merchant"), F.lit("").alias("default_category"))
    return receipt_sources.store(p, p.where("receipt_id % 2 = 0"), merchants)[1]


_BARS = "coalesce(CASE WHEN max(cents) OVER (PARTITION BY account_id) > 0 THEN round(greatest(cents, 0) / max(cents) OVER (PARTITION BY account_id), 6) END, 0)::DOUBLE AS relative"


@query(f"""WITH m AS ({ORACLE_SQL['top_merchants']}), t AS ({ORACLE_SQL['monthly_trend']}), r AS ({ORACLE_SQL['recurring_charges']})
SELECT kind, account_id, key, cents, relative FROM (
 SELECT 'merchant' AS kind, account_id, merchant AS key, cents, {_BARS} FROM m
 UNION ALL SELECT 'month', account_id, strftime(month, '%Y-%m'), outflow_cents, relative FROM (SELECT *, {_BARS} FROM (SELECT *, outflow_cents AS cents FROM t))
 UNION ALL SELECT 'recurring', account_id, merchant_norm, annual_cents, relative FROM (SELECT *, {_BARS} FROM (SELECT *, annual_cents AS cents FROM r)))""")
def relative_bars(s, d):
    """Merchants, months and recurring charges, each beside the largest of its account."""
    parts = []
    for kind, found, key, value in (
        ("merchant", report.top_merchants(L(s, d)), F.col("merchant"), "cents"),
        ("month", report.monthly_trend(L(s, d)), F.date_format("month", "yyyy-MM"), "outflow_cents"),
        ("recurring", recurring.recurring(view(s, d, "series")), F.col("merchant_norm"), "annual_cents"),
    ):
        shown = report.relative(found, value)
        parts.append(shown.select(F.lit(kind).alias("kind"), "account_id", key.alias("key"), F.col(value).alias("cents"), "relative"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{sql_views('ledger')}, b AS (SELECT *, date_trunc('week', txn_date)::DATE::VARCHAR AS week, category IS NULL AND EXTRACT(DAY FROM txn_date) BETWEEN 8 AND 14 AS chosen,
 status = 'duplicate' AND EXTRACT(DAY FROM txn_date) BETWEEN 22 AND 28 AS freed FROM ledger), v AS (SELECT unnest([1, 2, 3, 4]) AS version)
SELECT version, week, count(*) AS n, count(*) FILTER (WHERE version BETWEEN 2 AND 3 AND chosen) AS n_user, count(*) FILTER (WHERE status = 'active' OR (version = 3 AND freed)) AS n_active,
 coalesce(sum(-amount_cents) FILTER (WHERE category = 'Groceries' OR (version BETWEEN 2 AND 3 AND chosen)), 0)::BIGINT AS groceries_cents,
 version = 1 OR (version = 2 AND bool_or(chosen)) OR (version = 3 AND bool_or(freed)) OR (version = 4 AND (bool_or(chosen) OR bool_or(freed))) AS changed FROM b CROSS JOIN v GROUP BY 1, 2""")
def versioned_ledger(s, d):
    """A ledger in folders by week: categories chosen in the second week, duplicates
    freed in the fourth, then all taken back. What each version shows, and which of
    its folders are other ones than the version before had."""
    root = _work(s, "versions")
    l = L(s, d).withColumn("week", F.date_trunc("week", "txn_date").cast("date").cast("string")).withColumn("category_source", F.lit("default"))
    held = [versions.commit(s, root, {"ledger": versions.Change(l, "week"), "rules": versions.Change(dims.rules(s))}, versions.Version())]
    chosen = L(s, d).where("category IS NULL AND dayofmonth(txn_date) BETWEEN 8 AND 14").select("id", F.lit("Groceries").alias("new_category"))
    held.append(versions.set_category(s, root, chosen))
    freed = L(s, d).where("status = 'duplicate' AND dayofmonth(txn_date) BETWEEN 22 AND 28").select("id", F.lit("distinct").alias("resolution"))
    held.append(versions.resolve(s, root, freed))
    held.append(versions.revert(s, root, 1))
    folders = [{}, *(v.tables["ledger"]["folders"] for v in held)]
    changed = [(v.number, week, path != folders[k].get(week)) for k, v in enumerate(held) for week, path in folders[k + 1].items()]
    rows = None
    for v in held:
        t = versions.read(s, root, "ledger", v).withColumn("version", F.lit(v.number))
        rows = t if rows is None else rows.unionByName(t)
    out = rows.groupBy("version", "week").agg(
        F.count("*").alias("n"), F.count_if(F.col("category_source") == "user").alias("n_user"), F.count_if(F.col("status") == "active").alias("n_active"),
        F.coalesce(F.sum(F.when(F.col("category") == "Groceries", -F.col("amount_cents"))), F.lit(0)).alias("groceries_cents"),
    )
    return out.join(s.createDataFrame(changed, "version int, week string, changed boolean"), ["version", "week"])
