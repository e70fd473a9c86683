"""Registered queries over the fixture views, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text
from ..functions.dates import named_periods
from ..operators import advice, classify, dedupe, dims, match, mutate, recurring, report
from ..shipping import ship
from ..sources import receipts as receipt_sources
from ..sources import statements as statement_files
from ..sources.fixtures import sql_views, view, write_files
from ..store import work_path
from ..streaming import jobs, late
from . import links_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CATS = f"cats(name, kind, frivolity, reducible) AS (VALUES {dims.categories_sql()})"
FACTS = (
    "f AS (SELECT l.*, coalesce(l.category, 'Uncategorised') AS cat, coalesce(c.kind, 'discretionary') AS kind, coalesce(c.frivolity, 1) AS frivolity, "
    "coalesce(c.reducible, 0.25) AS reducible FROM ledger l LEFT JOIN cats c ON coalesce(l.category, 'Uncategorised') = c.name)"
)
OUT = "status = 'active' AND amount_cents < 0"
EXTENT = "ext AS (SELECT account_id, min(txn_date) AS a, max(txn_date) AS b, (date_diff('day', min(txn_date), max(txn_date)) + 1) / 30.44::DOUBLE AS months FROM ledger GROUP BY 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def L(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "ledger")


# --- reports ---


@query(f"""{sql_views('ledger')}, {CATS}, {FACTS}, {EXTENT},
b AS (SELECT account_id, cat AS category, any_value(kind) AS kind, sum(-amount_cents)::BIGINT AS cents, count(*) AS n, max(-amount_cents) AS largest_cents FROM f WHERE {OUT} GROUP BY 1, 2)
SELECT b.account_id, category, kind, cents, n, largest_cents, trunc(cents / n)::BIGINT AS average_cents, trunc(cents / months)::BIGINT AS monthly_cents,
 round(coalesce(cents / nullif(sum(CASE WHEN kind NOT IN ('excluded','income') THEN cents ELSE 0 END) OVER (PARTITION BY b.account_id), 0), 0.0), 6) AS share
FROM b JOIN ext USING (account_id)""")
def category_breakdown(s, d):
    return report.category_breakdown(L(s, d))


@query(f"""{sql_views('ledger')}, {CATS}, {FACTS}, t AS (SELECT account_id,
 coalesce(sum(-amount_cents) FILTER (WHERE {OUT}), 0)::BIGINT AS outflow_cents, coalesce(sum(amount_cents) FILTER (WHERE status='active' AND amount_cents > 0), 0)::BIGINT AS inflow_cents,
 count(*) FILTER (WHERE status='active') AS n_rows,
 coalesce(sum(-amount_cents) FILTER (WHERE {OUT} AND kind IN ('excluded','income')), 0)::BIGINT AS excluded_cents,
 coalesce(sum(-amount_cents) FILTER (WHERE {OUT} AND kind = 'essential'), 0)::BIGINT AS essential_cents,
 coalesce(sum(-amount_cents) FILTER (WHERE {OUT} AND kind IN ('discretionary','cash')), 0)::BIGINT AS discretionary_cents,
 coalesce(sum(-amount_cents) FILTER (WHERE {OUT} AND is_cash_withdrawal = 1), 0)::BIGINT AS cash_cents,
 coalesce(sum(-amount_cents) FILTER (WHERE {OUT} AND cat = 'Uncategorised'), 0)::BIGINT AS uncategorised_cents,
 count(*) FILTER (WHERE status='duplicate') AS n_held, coalesce(sum(abs(amount_cents)) FILTER (WHERE status='duplicate'), 0)::BIGINT AS held_cents FROM f GROUP BY 1)
SELECT account_id, outflow_cents, inflow_cents, inflow_cents - outflow_cents AS net_cents, n_rows, excluded_cents, outflow_cents - excluded_cents AS spend_cents, essential_cents, discretionary_cents,
 cash_cents, cash_cents AS unexplained_cash_cents, uncategorised_cents, n_held, held_cents, excluded_cents + essential_cents + discretionary_cents - outflow_cents AS residual_cents,
 round(CASE WHEN outflow_cents > 0 THEN greatest(0.0, 1 - (cash_cents + uncategorised_cents) / outflow_cents) ELSE 1.0 END, 6) AS explained_share,
 concat_ws(',', CASE WHEN cash_cents > 0 THEN 'unexplained_cash' END, CASE WHEN uncategorised_cents > 0.05 * outflow_cents THEN 'uncategorised' END) AS warnings FROM t""")
def reconciliation(s, d):
    return report.reconciliation(L(s, d))


_REPORT = {"outflow_cents": "", "inflow_cents": "", "net_cents": "", "n_rows": "", "excluded_cents": "", "spend_cents": "", "essential_cents": "", "discretionary_cents": "", "cash_cents": "", "unexplained_cash_cents": "",
           "uncategorised_cents": "", "n_held": "", "held_cents": "", "residual_cents": "", "explained_share": links_sql.number("explained_share"), "warnings": "'\"' || warnings || '\"'"}


@query(f"""WITH r AS ({ORACLE_SQL['reconciliation']}), c AS ({ORACLE_SQL['category_breakdown']}), j AS (SELECT account_id, '[' || string_agg('{{"category":"' || category || '","kind":"' || kind || '","cents":' || cents || ',"n":' || n || ',"share":' || {links_sql.number('share')} || '}}', ',' ORDER BY cents DESC, category) || ']' AS lines FROM c GROUP BY 1)
SELECT account_id, '{{"account_id":' || account_id || {" || ".join(f"""',"{k}":' || {v or k}""" for k, v in _REPORT.items())} || coalesce(',"categories":' || lines, '') || '}}' AS report FROM r LEFT JOIN j USING (account_id)""")
def account_reports(s, d):
    return report.report_json(report.category_breakdown(L(s, d)), report.reconciliation(L(s, d)))


@query(f"""{sql_views('ledger')}, {EXTENT}, p AS (
 SELECT account_id, 'this-month' AS period, date_trunc('month', b)::DATE AS s, last_day(b) AS e FROM ext UNION ALL
 SELECT account_id, 'last-days', b - 6, b FROM ext UNION ALL SELECT account_id, 'year-to-date', date_trunc('year', b)::DATE, b FROM ext UNION ALL
 SELECT account_id, 'last-months', (b - INTERVAL 3 MONTH)::DATE, b FROM ext UNION ALL
 SELECT account_id, 'quarter', date_trunc('quarter', b)::DATE, (date_trunc('quarter', b) + INTERVAL 3 MONTH)::DATE - 1 FROM ext UNION ALL
 SELECT account_id, 'year', date_trunc('year', b)::DATE, (date_trunc('year', b) + INTERVAL 1 YEAR)::DATE - 1 FROM ext UNION ALL
 SELECT account_id, 'last-month', (date_trunc('month', b) - INTERVAL 1 MONTH)::DATE, date_trunc('month', b)::DATE - 1 FROM ext UNION ALL
 SELECT account_id, 'last-year', (date_trunc('year', b) - INTERVAL 1 YEAR)::DATE, date_trunc('year', b)::DATE - 1 FROM ext UNION ALL
 SELECT account_id, 'all', a, b FROM ext)
SELECT l.account_id, period, coalesce(sum(-amount_cents) FILTER (WHERE {OUT}), 0)::BIGINT AS outflow_cents,
 coalesce(sum(amount_cents) FILTER (WHERE status='active' AND amount_cents > 0), 0)::BIGINT AS inflow_cents, count(*) FILTER (WHERE status='active') AS n_rows
FROM ledger l JOIN p ON l.account_id = p.account_id AND txn_date BETWEEN s AND e GROUP BY 1, 2""")
def period_totals(s, d):
    l = L(s, d)
    extents = l.groupBy("account_id").agg(F.min("txn_date").alias("first"), F.max("txn_date").alias("last"))
    return report.totals(report.in_periods(l, named_periods(extents)), "account_id", "period")


@query(f"""{sql_views('ledger')}, m AS (SELECT account_id, coalesce(nullif(merchant_norm, ''), 'Unknown') AS merchant, sum(-amount_cents)::BIGINT AS cents, count(*) AS n,
 max(-amount_cents) AS largest_cents, arg_max(coalesce(category, 'Uncategorised'), -amount_cents * 1000000000::HUGEINT - id) AS category FROM ledger WHERE {OUT} GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY cents DESC, merchant)::INT AS rank FROM m) WHERE rank <= 40""")
def top_merchants(s, d):
    return report.top_merchants(L(s, d))


@query(f"""{sql_views('ledger')}, c AS (SELECT account_id, coalesce(category, 'Uncategorised') AS category, sum(-amount_cents)::BIGINT AS cents FROM ledger WHERE {OUT} GROUP BY 1, 2),
r AS (SELECT account_id, CASE WHEN row_number() OVER (PARTITION BY account_id ORDER BY cents DESC, category) <= 3 THEN category ELSE 'Everything else' END AS category, cents FROM c),
g AS (SELECT account_id, category, sum(cents)::BIGINT AS cents FROM r GROUP BY 1, 2) SELECT *, round(cents / max(cents) OVER (PARTITION BY account_id), 6) AS relative FROM g""")
def category_rollup(s, d):
    return report.category_rollup(L(s, d))


@query(f"""{sql_views('ledger')} SELECT account_id, txn_date, sum(-amount_cents)::BIGINT AS cents, count(*) AS n FROM ledger WHERE {OUT} GROUP BY 1, 2""")
def daily_series(s, d):
    return report.daily_series(L(s, d))


@query(f"""{sql_views('ledger')}, d AS (SELECT account_id, txn_date, sum(-amount_cents)::BIGINT AS cents FROM ledger WHERE {OUT} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY cents, txn_date) AS k, count(*) OVER (PARTITION BY account_id) AS n, row_number() OVER (PARTITION BY account_id ORDER BY cents DESC, txn_date) AS top FROM d)
SELECT account_id, max(txn_date) FILTER (WHERE top = 1) AS busiest_day, max(cents) AS busiest_cents, max(cents) FILTER (WHERE k = n // 2 + 1) AS typical_cents FROM r GROUP BY 1""")
def busy_days(s, d):
    return report.busy_days(L(s, d))


@query(f"""{sql_views('ledger')}, {CATS}, {FACTS}, s AS (SELECT account_id, date_trunc('month', txn_date)::DATE AS month, coalesce(sum(-amount_cents) FILTER (WHERE amount_cents < 0), 0)::BIGINT AS o,
 coalesce(sum(amount_cents) FILTER (WHERE amount_cents >= 0), 0)::BIGINT AS i, coalesce(sum(-amount_cents) FILTER (WHERE amount_cents < 0 AND kind NOT IN ('excluded','income')), 0)::BIGINT AS p,
 coalesce(sum(-amount_cents) FILTER (WHERE amount_cents < 0 AND kind = 'essential'), 0)::BIGINT AS e FROM f WHERE status='active' GROUP BY 1, 2),
g AS (SELECT account_id, (m - to_months(k))::DATE AS month FROM (SELECT account_id, max(month) AS m FROM s GROUP BY 1), (SELECT unnest(range(6))::INT AS k))
SELECT g.account_id, g.month, coalesce(o, 0) AS outflow_cents, coalesce(i, 0) AS inflow_cents, coalesce(p, 0) AS spend_cents, coalesce(e, 0) AS essential_cents FROM g LEFT JOIN s USING (account_id, month)""")
def monthly_trend(s, d):
    return report.monthly_trend(L(s, d))


@query(f"""{sql_views('ledger')}, b AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY txn_date, id) AS k, row_number() OVER (PARTITION BY account_id ORDER BY txn_date DESC, id DESC) AS z FROM ledger WHERE status='active'),
t AS (SELECT account_id, count(*) AS n, max(balance_cents - amount_cents) FILTER (WHERE k = 1) AS opening_cents, max(balance_cents) FILTER (WHERE z = 1) AS closing_cents, sum(amount_cents)::BIGINT AS moved_cents FROM b GROUP BY 1)
SELECT *, CASE WHEN n >= 2 THEN abs(opening_cents + moved_cents - closing_cents) <= 2 END AS agrees FROM t""")
def balance_check(s, d):
    return report.balance_check(L(s, d))


@query(f"""{sql_views('ledger', 'statements')}, {EXTENT}, s AS (SELECT s.account_id, a AS start, b AS "end", period_start AS x, period_end AS y FROM statements s JOIN ext USING (account_id)),
r AS (SELECT *, max(y) OVER (PARTITION BY account_id ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT account_id, start, "end", island, min(x) AS x, max(y) AS y FROM i GROUP BY ALL)
SELECT account_id, start, "end", sum(y - x + 1)::BIGINT AS covered_days, ("end" - start + 1)::BIGINT AS total_days,
 (count(*) - 1 + (CASE WHEN min(x) > start THEN 1 ELSE 0 END) + (CASE WHEN max(y) < "end" THEN 1 ELSE 0 END))::BIGINT AS n_gaps FROM m GROUP BY account_id, start, "end" """)
def statement_coverage(s, d):
    periods = L(s, d).groupBy("account_id").agg(F.min("txn_date").alias("start"), F.max("txn_date").alias("end"))
    return report.coverage(view(s, d, "statements"), periods)


@query(f"""{sql_views('ledger', 'narrations')} SELECT l.account_id, merchant_norm AS merchant, count(*) AS n, sum(-l.amount_cents)::BIGINT AS cents, min(l.id) AS example_id, arg_min(description_raw, l.id) AS sample
 FROM ledger l JOIN narrations n ON n.id = l.id WHERE status = 'active' AND l.amount_cents < 0 AND category IS NULL GROUP BY 1, 2""")
def uncategorised_merchants(s, d):
    """Half of the rows without a category are marked as such, as an import does."""
    l = L(s, d).join(view(s, d, "narrations").select("id", "description_raw"), "id")
    marked = F.when(F.col("category").isNull() & (F.col("id") % 2 == 0), "Uncategorised").otherwise(F.col("category"))
    return report.uncategorised_merchants(l.withColumn("category", marked))


@query(f"""{sql_views('ledger')} SELECT id, account_id, txn_date, merchant_norm, amount_cents FROM ledger WHERE {OUT} AND merchant_norm ILIKE '%PURCHASE-3%' ORDER BY txn_date DESC, id DESC LIMIT 250""")
def ledger_search(s, d):
    return report.search(L(s, d), "PURCHASE-3").select("id", "account_id", "txn_date", "merchant_norm", "amount_cents")


@query(f"""{sql_views('ledger')} SELECT account_id, CASE WHEN is_cash_withdrawal = 1 THEN 'atm' WHEN merchant_norm LIKE 'purchase-%' THEN 'card' ELSE 'other' END AS txn_type, sum(-amount_cents)::BIGINT AS cents, count(*) AS n,
 CASE WHEN is_cash_withdrawal = 1 THEN 'Cash withdrawal' WHEN merchant_norm LIKE 'purchase-%' THEN 'Card purchase' ELSE 'Other / unclassified' END AS label FROM ledger WHERE {OUT} GROUP BY ALL""")
def type_breakdown(s, d):
    kind = F.when(F.col("is_cash_withdrawal") == 1, "atm").when(F.startswith("merchant_norm", F.lit("purchase-")), "card")
    return report.type_breakdown(L(s, d).withColumn("txn_type", kind))


@query(f"""{sql_views('ledger', 'statements')}, x AS (SELECT s.account_id, statement_id, period_start, period_end, count(l.id) AS n, coalesce(sum(-amount_cents) FILTER (WHERE amount_cents < 0), 0)::BIGINT AS out_cents
 FROM statements s LEFT JOIN ledger l ON l.account_id = s.account_id AND l.account_id * 10 + CAST(FLOOR((EXTRACT(DAY FROM l.txn_date)-1)/10) AS BIGINT) = s.statement_id GROUP BY 1, 2, 3, 4) SELECT * FROM x""")
def import_history(s, d):
    slot = F.col("account_id") * 10 + F.floor((F.dayofmonth("txn_date") - 1) / 10)
    l = L(s, d).groupBy(slot.alias("statement_id")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("amount_cents") < 0, -F.col("amount_cents"))), F.lit(0)).alias("out_cents")
    )
    return view(s, d, "statements").join(l, "statement_id", "left").fillna(0, ["n", "out_cents"])


# --- series ---

_REC = f"""{sql_views('series')}, act AS (SELECT * FROM series WHERE status = 'active'), nw AS (SELECT account_id, max(txn_date) AS newest FROM act GROUP BY 1),
g AS (SELECT *, date_diff('day', lag(txn_date) OVER w, txn_date) AS gap, row_number() OVER w AS nth, row_number() OVER (PARTITION BY account_id, merchant_norm ORDER BY -amount_cents) AS k,
 count(*) OVER (PARTITION BY account_id, merchant_norm) AS m FROM act WINDOW w AS (PARTITION BY account_id, merchant_norm ORDER BY txn_date, id)),
a AS (SELECT account_id, merchant_norm, max(category) FILTER (WHERE nth = 1) AS category, count(*) AS n, sum(-amount_cents)::BIGINT AS total_cents, min(txn_date) AS first_date, max(txn_date) AS last_date, count(*) FILTER (WHERE gap > 0) AS ng,
 median(gap) FILTER (WHERE gap > 0) AS gap, max(-amount_cents) FILTER (WHERE k = m // 2 + 1) AS typical_cents, max(-amount_cents) - min(-amount_cents) AS spread FROM g GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN gap BETWEEN 5 AND 9 THEN 'weekly' WHEN gap BETWEEN 11 AND 18 THEN 'fortnightly' WHEN gap BETWEEN 25 AND 36 THEN 'monthly' WHEN gap BETWEEN 80 AND 100 THEN 'quarterly' WHEN gap BETWEEN 350 AND 380 THEN 'annual' ELSE 'irregular' END AS cadence FROM a WHERE n >= 3 AND ng >= 2),
v AS (SELECT c.*, date_diff('day', last_date, newest) / gap <= 1.6 AS active, spread / typical_cents > CASE WHEN cadence IN ('monthly','quarterly') THEN 0.35 ELSE 0.6 END AS varies,
 typical_cents * CASE cadence WHEN 'weekly' THEN 52 WHEN 'fortnightly' THEN 26 WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 ELSE 1 END AS annual_cents FROM c JOIN nw USING (account_id)),
rec AS (SELECT account_id, merchant_norm, category, n, total_cents, first_date, last_date, round(gap, 6) AS gap_days, typical_cents, cadence, active, varies, annual_cents, annual_cents // 12 AS monthly_cents,
 cadence IN ('monthly','quarterly','annual') AND NOT varies AS subscription, row_number() OVER (PARTITION BY account_id ORDER BY annual_cents DESC, merchant_norm)::INT AS rank FROM v WHERE cadence <> 'irregular')"""


@query(f"{_REC} SELECT * FROM rec")
def recurring_charges(s, d):
    return recurring.recurring(view(s, d, "series"))


@query(f"""{_REC} SELECT account_id, count(*) FILTER (WHERE active) AS n_active, count(*) FILTER (WHERE NOT active) AS n_cancelled, coalesce(sum(monthly_cents) FILTER (WHERE active), 0)::BIGINT AS monthly_cents,
 coalesce(sum(annual_cents) FILTER (WHERE active), 0)::BIGINT AS annual_cents FROM rec GROUP BY 1""")
def commitments(s, d):
    return recurring.commitments(recurring.recurring(view(s, d, "series")))


@query(f"""{sql_views('series')}, k AS (SELECT *, row_number() OVER (PARTITION BY account_id, merchant_norm ORDER BY txn_date, id) AS k, count(*) OVER (PARTITION BY account_id, merchant_norm) AS m FROM series WHERE status = 'active'),
g AS (SELECT account_id, merchant_norm, count(*) AS n, avg(-amount_cents) FILTER (WHERE k <= m // 2) AS o, avg(-amount_cents) FILTER (WHERE k > m // 2) AS w FROM k WHERE m >= 4 GROUP BY 1, 2)
SELECT account_id, merchant_norm, n, round(o, 4) AS old_cents, round(w, 4) AS new_cents FROM g WHERE (w - o) / o >= 0.1 AND w - o >= 1000""")
def price_creep(s, d):
    return recurring.price_creep(view(s, d, "series"))


@query(f"""{sql_views('series')}, m AS (SELECT account_id, category, date_trunc('month', txn_date)::DATE AS month, sum(-amount_cents)::BIGINT AS cents FROM series WHERE status = 'active' GROUP BY 1, 2, 3),
e AS (SELECT account_id, category, min(month) AS f, any_value(z) AS z FROM (SELECT *, max(month) OVER (PARTITION BY account_id) AS z FROM m) WHERE month > z - INTERVAL 6 MONTH GROUP BY 1, 2),
g AS (SELECT account_id, category, z, unnest(generate_series(f::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM e),
t AS (SELECT account_id, category, count(*) AS n_months, sum(coalesce(cents, 0)) FILTER (WHERE month = z) AS l, avg(coalesce(cents, 0)) FILTER (WHERE month <> z) AS a FROM g LEFT JOIN m USING (account_id, category, month) GROUP BY 1, 2)
SELECT account_id, category, n_months, l::BIGINT AS latest_cents, round(a, 4) AS mean_cents FROM t WHERE n_months >= 3 AND a > 0 AND l > 1.4 * a AND l - a >= 20000""")
def category_spikes(s, d):
    return recurring.spikes(view(s, d, "series"))


# --- advice ---


@query(f"""{sql_views('ledger')}, {CATS}, {FACTS}, o AS (SELECT f.*, -amount_cents AS cents, count(*) OVER (PARTITION BY f.account_id, merchant_norm) / ((max(txn_date) OVER (PARTITION BY f.account_id) - min(txn_date) OVER (PARTITION BY f.account_id) + 1) / 30.44::DOUBLE) AS pm FROM f WHERE {OUT}),
s AS (SELECT *, pm >= 6 AND cents <= 15000 AS habit, frivolity / 3 * CASE WHEN kind = 'essential' THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS base FROM o)
SELECT account_id, id, cat AS category, cents, round(least(1.0::DOUBLE, base + CASE WHEN habit THEN 0.15::DOUBLE ELSE 0 END), 3) AS score,
 concat_ws(',', CASE WHEN frivolity >= 2 THEN 'category' END, CASE WHEN habit THEN 'habit' END) AS reasons FROM s WHERE kind NOT IN ('excluded','income') AND round(least(1.0::DOUBLE, base + CASE WHEN habit THEN 0.15::DOUBLE ELSE 0 END), 3) >= 0.6""")
def frivolous_rows(s, d):
    return advice.frivolity(L(s, d))


@query(f"""{sql_views('ledger')}, {CATS}, {FACTS}, {EXTENT}, h AS (SELECT account_id, merchant_norm AS merchant, cat AS category, any_value(kind) AS kind, any_value(frivolity) AS fr, count(*) AS n, sum(-amount_cents)::BIGINT AS cents FROM f WHERE {OUT} GROUP BY 1, 2, 3)
SELECT h.account_id, merchant, category, n, cents, trunc(cents / months * 0.5)::BIGINT AS want FROM h JOIN ext USING (account_id) WHERE n >= 6 AND cents / n <= 20000 AND fr >= 2 AND kind NOT IN ('excluded','income') AND n / months >= 4""")
def habit_spend(s, d):
    return advice.habits(L(s, d))


@query(f"""{sql_views('ledger')}, {CATS}, {FACTS}, {EXTENT}, m AS (SELECT f.account_id, cat AS category, any_value(kind) AS kind, any_value(f.frivolity)::INT AS frivolity, any_value(reducible)::DOUBLE AS r, trunc(sum(-amount_cents) / any_value(months))::BIGINT AS monthly FROM f JOIN ext USING (account_id) WHERE {OUT} GROUP BY 1, 2)
SELECT account_id, category, trunc(monthly * r)::BIGINT AS ceiling, kind, frivolity, monthly FROM m""")
def savings_headroom(s, d):
    return advice.headroom(L(s, d))


@query(f"""{sql_views('ledger')}, {CATS}, {FACTS}, {EXTENT}, m AS (SELECT f.account_id, cat AS category, trunc(trunc(sum(-amount_cents) / any_value(months)) * any_value(reducible)::DOUBLE)::BIGINT AS ceiling FROM f JOIN ext USING (account_id) WHERE {OUT} GROUP BY 1, 2),
h AS (SELECT account_id, cat AS category, merchant_norm AS key, 5 AS seq, any_value(kind) AS kind, any_value(frivolity) AS fr, count(*) AS n, sum(-amount_cents)::BIGINT AS cents FROM f WHERE {OUT} GROUP BY 1, 2, 3),
c AS (SELECT account_id, category, key, seq, trunc(cents / months * 0.5)::BIGINT AS want FROM h JOIN ext USING (account_id) WHERE n >= 6 AND cents / n <= 20000 AND fr >= 2 AND kind NOT IN ('excluded','income') AND n / months >= 4),
r AS (SELECT c.*, ceiling, sum(want) OVER (PARTITION BY account_id, category ORDER BY seq, key ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c JOIN m USING (account_id, category))
SELECT account_id, category, seq, key, want, (least(ceiling, run) - least(ceiling, run - want))::BIGINT AS granted FROM r""")
def claim_ledger(s, d):
    h = advice.habits(L(s, d)).select("account_id", "category", F.col("merchant").alias("key"), F.lit(5).alias("seq"), "want")
    return advice.granted(h, advice.headroom(L(s, d)))


@query()
def savings_advice(s, d):
    ship(s)
    return advice.advice(L(s, d))


# --- classification and text ---

@query(f"""{sql_views('narrations')}, rules(rule_id, priority, pattern, category, merchant, txn_type) AS (VALUES {dims.rules_sql()}),
h AS (SELECT n.id, n.account_id, n.amount_cents, n.description_raw, r.* FROM narrations n LEFT JOIN rules r ON contains(lower(description_raw), r.pattern) AND (amount_cents <= 0 OR r.category IN ('Transfers','Savings & Investment'))),
g AS (SELECT id, account_id, amount_cents, description_raw, arg_min(category, priority * 1000 + rule_id) FILTER (WHERE category IS NOT NULL) AS c, arg_min(merchant, priority * 1000 + rule_id) FILTER (WHERE merchant IS NOT NULL) AS m,
 arg_min(txn_type, priority * 1000 + rule_id) FILTER (WHERE txn_type IS NOT NULL) AS t FROM h GROUP BY 1, 2, 3, 4)
SELECT id, account_id, amount_cents, description_raw, coalesce(m, CASE id % 12 WHEN 0 THEN 'Checkers Fourways' WHEN 1 THEN 'Woolworths Food' WHEN 2 THEN 'Vida E Caffe' WHEN 3 THEN 'Uber Eats' WHEN 4 THEN 'Hollywoodbets Online' WHEN 5 THEN 'Engen Fourways'
 WHEN 6 THEN 'Netflix.com Amsterdam' WHEN 7 THEN 'Takealot.com' WHEN 8 THEN 'Traffic Fine Aarto' WHEN 9 THEN 'Transfer TO Savings OWN Account' WHEN 10 THEN 'Monthly Account FEE' ELSE 'Qwerty Trading' END) AS merchant,
 coalesce(c, CASE WHEN amount_cents > 0 THEN 'Income' ELSE 'Uncategorised' END) AS category,
 CASE WHEN amount_cents > 0 AND c IS NULL THEN 'credit' ELSE coalesce(t, 'other') END AS txn_type, CASE WHEN c IS NULL THEN 'default' ELSE 'rule' END AS category_source FROM g""")
def rule_classification(s, d):
    return classify.classify(view(s, d, "narrations"), dims.rules(s))


@query("""SELECT c_custkey, round(CASE WHEN a = b THEN 1.0 ELSE least(0.8, 0.3 + 0.6 * (1.0 / 3)) END, 6) AS similarity FROM (SELECT c_custkey, lower(c_name) AS a,
 'customer ' || lpad(((c_custkey + 1) % 1000)::VARCHAR, 9, '0') AS b FROM customer)""")
def name_similarity(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    other = F.concat(F.lit("customer "), F.lpad(((F.col("c_custkey") + 1) % 1000).cast("string"), 9, "0"))
    return c.select("c_custkey", F.round(text.similarity(F.regexp_replace("c_name", "#", " "), other), 6).alias("similarity"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice * 100 AS BIGINT) AS cents FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice FROM orders)""")
def amount_texts(s, d):
    p = F.col("o_totalprice").cast("decimal(18,2)")
    plain = p.cast("string")
    us, eu = F.format_number(p.cast("double"), 2), F.translate(F.format_number(p.cast("double"), 2), ",.", ".,")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), us, F.lit(")"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("R "), eu)).otherwise(plain)
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", shown.alias("t"))
    return o.select("o_orderkey", money.to_cents(money.parse_amount(F.col("t"))).alias("cents"))


@query()
def narration_names(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    cleaned = text.clean_description(F.col("line"))
    return lines.select("doc_id", cleaned.alias("cleaned"), text.merchant_name(cleaned).alias("merchant")).withColumn("canonical", text.canonical_key(F.col("merchant")))


@query()
def receipt_texts(s, d):
    return receipt_sources.from_text(s.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


@query(f"""{sql_views('receipts')} SELECT receipt_id, merchant_norm AS merchant, receipt_date, total_cents, tender_type, 0.9::DOUBLE AS confidence, 2::INT AS n_items, FALSE AS inconsistent FROM receipts""")
def receipt_payloads(s, d):
    r = view(s, d, "receipts")
    half = F.floor(F.col("total_cents") / 2)
    shown = lambda c: money.from_cents(c).cast("decimal(20,2)").cast("string")
    item = lambda c: F.struct(F.lit("item").alias("description"), F.lit("1").alias("quantity"), shown(c).alias("unit_price"), shown(c).alias("line_total"))
    empty = F.struct(F.lit(" ").alias("description"), F.lit("1").alias("quantity"), F.lit("0").alias("unit_price"), F.lit("0").alias("line_total"))
    payload = F.to_json(
        F.struct(
            F.col("merchant_norm").alias("merchant"), F.date_format("receipt_date", "dd/MM/yyyy").alias("date"), shown(F.col("total_cents")).alias("total"),
            F.col("tender_type"), F.lit("High").alias("confidence"), F.array(item(half), empty, item(F.col("total_cents") - half)).alias("items"),
        )
    )
    p = receipt_sources.from_payload(r.select("receipt_id", payload.alias("payload")))
    return p.select("receipt_id", "merchant", "receipt_date", "total_cents", "tender_type", "confidence", F.size("items").alias("n_items"), "inconsistent")


# --- duplicates ---

_PAIRS = f"""{sql_views('ledger', 'statements', 'incoming')}, p AS (SELECT n.account_id, n.id AS new_id, e.id AS existing_id, abs(n.txn_date - e.txn_date)::INT AS gap_days, n.balance_cents IS NOT NULL AND e.balance_cents IS NOT NULL AS two,
 lower(n.merchant_norm) <> lower(e.merchant_norm) OR coalesce(n.balance_cents <> e.balance_cents, FALSE) AS off FROM incoming n JOIN ledger e ON n.account_id = e.account_id AND n.amount_cents = e.amount_cents AND abs(n.txn_date - e.txn_date) <= 3 AND e.status <> 'duplicate'
 WHERE EXISTS (SELECT 1 FROM statements s WHERE s.account_id = n.account_id AND n.txn_date BETWEEN s.period_start AND s.period_end)),
q AS (SELECT account_id, new_id, existing_id, gap_days, (CASE WHEN gap_days = 0 THEN CASE WHEN two THEN 0.97 ELSE 0.93 END WHEN gap_days = 1 THEN 0.72 ELSE 0.58 END)::DOUBLE AS score FROM p WHERE NOT off),
pairs AS (SELECT *, CASE WHEN score >= 0.9 THEN 'held' ELSE 'review' END AS verdict FROM q)"""


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return dedupe.near_duplicates(view(s, d, "incoming"), L(s, d), view(s, d, "statements"))


@query(f"{_PAIRS} SELECT * FROM pairs")
def duplicate_candidates(s, d):
    return _pairs(s, d)


@query(f"{_PAIRS} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY account_id, new_id ORDER BY score DESC, existing_id) AS k FROM pairs) WHERE k = 1")
def duplicate_verdicts(s, d):
    return dedupe.top_verdict(_pairs(s, d))


@query(f"""{sql_views('ledger', 'incoming')}, x AS (SELECT id, account_id, balance_cents, concat_ws('|', strftime(txn_date, '%Y-%m-%d'), amount_cents::VARCHAR, regexp_replace(lower(merchant_norm), '[^a-z0-9]', '', 'g')) AS k FROM incoming)
SELECT id, account_id, o::INT AS occurrence, sha1(k || '|' || CASE WHEN balance_cents IS NULL THEN 'o' || o ELSE 'b' || balance_cents END) AS fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY account_id, k ORDER BY id) - 1 AS o FROM x)""")
def fingerprints(s, d):
    return dedupe.fingerprinted(view(s, d, "incoming")).select("id", "account_id", "occurrence", "fingerprint")


_PRINTS = """SELECT *, o::INT AS occurrence, sha1(k || '|' || CASE WHEN balance_cents IS NULL THEN 'o' || o ELSE 'b' || balance_cents END) AS fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY account_id, k ORDER BY id) - 1 AS o
 FROM (SELECT id, account_id, txn_date, merchant_norm, amount_cents, balance_cents, concat_ws('|', strftime(txn_date, '%Y-%m-%d'), amount_cents::VARCHAR, regexp_replace(lower(merchant_norm), '[^a-z0-9]', '', 'g')) AS k FROM {}))"""


@query(f"""{sql_views('ledger', 'incoming')}, i AS ({_PRINTS.format('incoming')}), l AS ({_PRINTS.format('ledger')})
SELECT id, account_id, txn_date, merchant_norm, amount_cents, balance_cents, k AS soft_key, occurrence, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY account_id, fingerprint ORDER BY id) AS nth FROM i)
 WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM l WHERE l.account_id = account_id AND l.fingerprint = fingerprint)""".replace("l.account_id = account_id AND l.fingerprint = fingerprint", "l.account_id = x.account_id AND l.fingerprint = x.fingerprint").replace("FROM i)\n", "FROM i) x\n"))
def incoming_new_rows(s, d):
    fresh = dedupe.first_of_fingerprint(dedupe.fingerprinted(view(s, d, "incoming")))
    return dedupe.new_rows(fresh, dedupe.fingerprinted(L(s, d)))


@query(f"""{sql_views('ledger', 'statements', 'incoming')} SELECT i.* FROM incoming i WHERE EXISTS (SELECT 1 FROM statements s WHERE s.account_id = i.account_id AND i.txn_date BETWEEN period_start AND period_end)""")
def incoming_covered(s, d):
    return dedupe.covered(view(s, d, "incoming"), view(s, d, "statements"))


# --- receipts ---

LINKED = links_sql.with_links(sql_views("ledger", "receipts"))
#: What was bought, by the shop's number.
_BOUGHT = "CASE CAST(split_part(merchant_norm, '-', 2) AS INT) % 3 WHEN 0 THEN 'Coffee & Snacks' WHEN 1 THEN 'Groceries' END"


@query(f"{sql_views('ledger', 'receipts')}, {links_sql.cards()}")
def receipt_candidates(s, d):
    """Names of one kind are alike to 0.8, as one word of their one is the same."""
    return match.card_candidates(view(s, d, "receipts"), L(s, d))


@query(f"""{sql_views('ledger', 'receipts')} SELECT r.account_id, receipt_id, receipt_date, total_cents, l.id AS withdrawal_id, -amount_cents AS withdrawn, (receipt_date - l.txn_date)::INT AS days_before FROM receipts r JOIN ledger l ON r.account_id = l.account_id AND {OUT} AND is_cash_withdrawal = 1 AND l.txn_date BETWEEN receipt_date - 21 AND receipt_date""")
def cash_candidates(s, d):
    return match.cash_candidates(view(s, d, "receipts"), L(s, d))


@query(f"{LINKED} SELECT * FROM links")
def receipt_links(s, d):
    ship(s)
    return match.link_receipts(view(s, d, "receipts"), L(s, d))[0]


@query(f"{LINKED} SELECT link_status, count(*) AS n, sum(total_cents)::BIGINT AS cents FROM links GROUP BY 1")
def receipts_by_status(s, d):
    ship(s)
    return match.link_receipts(view(s, d, "receipts"), L(s, d))[0].groupBy("link_status").agg(F.count("*").alias("n"), F.sum("total_cents").alias("cents"))


@query(f"""{LINKED}, v AS (SELECT c.account_id, coalesce({_BOUGHT}, 'Uncategorised') AS category, sum(amount_cents)::BIGINT AS cents FROM cash c JOIN receipts USING (receipt_id) GROUP BY 1, 2),
t AS (SELECT account_id, coalesce(category, 'Uncategorised') AS category, sum(-amount_cents)::BIGINT AS cents FROM ledger WHERE {OUT} GROUP BY 1, 2),
m AS (SELECT v.account_id, v.category, floor(v.cents * least(1.0::DOUBLE, t.cents / (sum(v.cents) OVER (PARTITION BY v.account_id))::BIGINT))::BIGINT AS moved FROM v JOIN t ON t.account_id = v.account_id AND t.category = 'Cash Withdrawals'),
u AS (SELECT * FROM t UNION ALL SELECT * FROM m UNION ALL SELECT account_id, 'Cash Withdrawals', -moved FROM m)
SELECT account_id, category, sum(cents)::BIGINT AS cents FROM u GROUP BY 1, 2 HAVING NOT (category = 'Cash Withdrawals' AND sum(cents) <= 0)""")
def cash_reclassified(s, d):
    ship(s)
    receipts = with_categories(view(s, d, "receipts"))
    cash = match.link_receipts(receipts, L(s, d))[1]
    return report.cash_reclassified(L(s, d), report.cash_revealed(cash, receipts, L(s, d)))


def with_categories(receipts: DataFrame) -> DataFrame:
    """Receipts with what was bought: by the shop's number."""
    n = F.substring_index("merchant_norm", "-", -1).cast("int") % 3
    return receipts.withColumn("category", F.when(n == 0, "Coffee & Snacks").when(n == 1, "Groceries"))


# --- changes ---


@query(f"""{sql_views('ledger')} SELECT CASE WHEN id % 31 = 0 AND id % 2 = 0 THEN 'active' WHEN id % 97 = 0 THEN 'duplicate' ELSE status END AS status, count(*) AS n, sum(amount_cents)::BIGINT AS cents FROM ledger GROUP BY 1""")
def resolved_duplicates(s, d):
    l = L(s, d)
    decisions = l.where("(id % 31 = 0 AND id % 2 = 0) OR id % 97 = 0").select("id", F.when(F.expr("id % 31 = 0 AND id % 2 = 0"), "distinct").otherwise("duplicate").alias("resolution"))
    return mutate.resolve_candidates(l, decisions).groupBy("status").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"))


@query(f"""{sql_views('ledger')} SELECT account_id * 10 + CAST(FLOOR((EXTRACT(DAY FROM txn_date)-1)/10) AS BIGINT) AS statement_id, count(*) AS n_rows, coalesce(sum(-amount_cents) FILTER (WHERE amount_cents < 0), 0)::BIGINT AS out_cents,
 coalesce(sum(amount_cents) FILTER (WHERE amount_cents > 0), 0)::BIGINT AS in_cents, count(*) FILTER (WHERE id % 50 = 0) AS n_receipts,
 count(*) FILTER (WHERE is_cash_withdrawal = 1 AND id % 3 = 0) AS n_allocations, count(*) FILTER (WHERE id % 70 = 0) AS n_pending, count(*) FILTER (WHERE id % 50 = 0 OR (is_cash_withdrawal = 1 AND id % 3 = 0)) > 0 AS blocked FROM ledger GROUP BY 1""")
def undo_plan(s, d):
    l = L(s, d).withColumn("statement_id", F.col("account_id") * 10 + F.floor((F.dayofmonth("txn_date") - 1) / 10))
    some = lambda cond, name: l.where(cond).select(F.col("id").alias(name))
    return mutate.undo_plan(l, some("id % 50 = 0", "txn_id"), some("is_cash_withdrawal = 1 AND id % 3 = 0", "withdrawal_id"), some("id % 70 = 0", "new_id"))


@query(f"""{sql_views('ledger')}, o AS (SELECT regexp_replace(lower(merchant_norm), '[^a-z0-9]', '', 'g') AS canonical, min(merchant_norm) AS merchant, NULL::VARCHAR AS dc FROM ledger WHERE id % 2 = 0 GROUP BY 1),
n AS (SELECT regexp_replace(lower(merchant_norm), '[^a-z0-9]', '', 'g') AS canonical, min(merchant_norm) AS merchant, max(category) AS dc FROM ledger WHERE id % 2 = 1 GROUP BY 1)
SELECT coalesce(o.canonical, n.canonical) AS canonical, coalesce(o.merchant, n.merchant) AS merchant, coalesce(o.dc, n.dc) AS default_category FROM o FULL JOIN n ON o.canonical = n.canonical""")
def merchant_upsert(s, d):
    l = L(s, d).withColumn("canonical", text.canonical_key(F.col("merchant_norm")))
    old = l.where("id % 2 = 0").groupBy("canonical").agg(F.min("merchant_norm").alias("merchant")).withColumn("default_category", F.lit(None).cast("string"))
    new = l.where("id % 2 = 1").groupBy("canonical").agg(F.min("merchant_norm").alias("merchant"), F.max("category").alias("default_category"))
    return mutate.upsert_merchants(old, new)


@query(f"""{_PAIRS}, {sql_views('receipts').split('WITH ', 1)[1].split(chr(10) + 'receipts AS', 1)[1].join(['receipts AS', ''])},
l AS (SELECT account_id, count(*) FILTER (WHERE status='active') AS n_active, count(*) FILTER (WHERE status='duplicate') AS n_duplicate FROM ledger GROUP BY 1),
st AS (SELECT account_id, count(*) AS n_statements, min(period_start) AS first_day, max(period_end) AS last_day FROM statements GROUP BY 1)
SELECT account_id, n_active, n_duplicate, coalesce(n_statements, 0) AS n_statements, first_day, last_day, (SELECT count(*) FROM receipts r WHERE r.account_id = l.account_id) AS n_receipts,
 (SELECT count(*) FROM pairs p WHERE p.account_id = l.account_id AND verdict = 'review') AS n_pending FROM l LEFT JOIN st USING (account_id)""")
def store_status(s, d):
    return report.store_status(L(s, d), view(s, d, "statements"), view(s, d, "receipts"), _pairs(s, d).where("verdict = 'review'"))


# --- files and streams ---


_work = work_path


@query(f"""{sql_views('ledger')}, w AS (SELECT account_id, ts, id, txn_date, merchant_norm, balance_cents, CASE WHEN account_id % 2 = 0 THEN -amount_cents ELSE amount_cents END AS amt,
 balance_cents - lag(balance_cents) OVER (PARTITION BY account_id ORDER BY ts, id) AS delta, row_number() OVER (PARTITION BY account_id ORDER BY ts, id) AS k FROM ledger WHERE status = 'active'),
f AS (SELECT account_id, count(*) AS n, min(amt) AS least, avg(CASE WHEN abs(delta - amt) <= 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE delta IS NOT NULL) AS same, avg(CASE WHEN abs(delta + amt) <= 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE delta IS NOT NULL) AS flipped FROM w GROUP BY 1)
SELECT w.account_id, k::INT AS line_no, (k - 1)::INT AS row_ordinal, txn_date, NULL::DATE AS posted_date, merchant_norm AS description_raw, CASE WHEN (n >= 3 AND flipped > same AND flipped >= 0.7) OR (n < 3 AND least >= 0) THEN -amt ELSE amt END AS amount_cents, balance_cents,
 TRUE AS day_first, 1.0::DOUBLE AS confidence, '' AS card_last4 FROM w JOIN f USING (account_id)""")
def statement_files_parsed(s, d):
    """Statement files written from the ledger in two layouts, one with inverted
    signs, then read back: a row for each ledger row that the files hold."""
    ship(s)
    l = L(s, d).where("status = 'active'")
    amount = F.when(F.col("account_id") % 2 == 0, -F.col("amount_cents")).otherwise(F.col("amount_cents"))
    shown = lambda c: (c.cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    line = F.concat_ws(",", F.date_format("txn_date", "dd/MM/yyyy"), "merchant_norm", shown(amount), shown(F.col("balance_cents")))
    path = _work(s, "statement-files")
    write_files(l, line, path, "Date,Description,Amount,Balance")
    read = statement_files.read_statements(s, f"{path}/account_id=*")[0]
    return read.withColumn("account_id", F.regexp_extract("file", r"account_id=(\d+)", 1).cast("long")).drop("file", "sha256")


@query(f"""{sql_views('ledger')} SELECT account_id, txn_date AS day, coalesce(category, 'Uncategorised') AS category, sum(-amount_cents)::BIGINT AS cents, count(*) AS n FROM ledger WHERE {OUT} GROUP BY 1, 2, 3""")
def streamed_daily_outflow(s, d):
    """The daily totals of a finished stream over the events, equal to the batch result."""
    source = _work(s, "stream-in")
    L(s, d).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    rows = s.readStream.schema(s.read.parquet(source).schema).parquet(source)
    out, where = _work(s, "stream-out"), _work(s, "stream-state")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    q = jobs.daily_outflow(rows).writeStream.foreachBatch(keep).option("checkpointLocation", where).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(out)


_ARRIVALS = "CASE WHEN EXTRACT(DAY FROM txn_date) <= 10 THEN 1 WHEN EXTRACT(DAY FROM txn_date) <= 20 THEN 2 ELSE 3 END + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 2 ELSE 0 END"


@query(f"""{sql_views('ledger')}, r AS (SELECT account_id, txn_date AS day, coalesce(category, 'Uncategorised') AS category, ts, -amount_cents AS cents, least(3, {_ARRIVALS}) AS k FROM ledger WHERE {OUT}),
h AS (SELECT k, (max(newest) OVER (ORDER BY k) - INTERVAL 3 DAY)::DATE AS horizon FROM (SELECT k, max(ts) AS newest FROM r GROUP BY 1)),
t AS (SELECT r.*, coalesce(day < (SELECT max(horizon) FROM h WHERE h.k < r.k), false) AS late FROM r)
SELECT account_id, day, category, sum(cents)::BIGINT AS cents, count(*) AS n, count(*) FILTER (WHERE late) AS n_late FROM t WHERE day < (SELECT max(horizon) FROM h) GROUP BY 1, 2, 3""")
def streamed_late_rows(s, d):
    """Three arrivals, some rows one or two of them too late: days closed once, rows
    behind the horizon on the side and merged by two settlements."""
    work = _work(s, "stream-late")
    l = L(s, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.expr(f"least(3, {_ARRIVALS})"))
    l.write.partitionBy("k").parquet(f"{work}/all")
    schema = l.drop("k").schema
    for k in (1, 2, 3):
        s.read.schema(schema).parquet(f"{work}/all/k={k}").write.mode("append").parquet(f"{work}/arrived")
        rows = s.readStream.schema(schema).parquet(f"{work}/arrived")
        late.daily_closed(s, rows, f"{work}/store", f"{work}/stream").awaitTermination()
        if k > 1:
            late.settle(s, f"{work}/store")
    return late.totals(s, f"{work}/store")
