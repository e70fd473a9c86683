"""Ledger-shaped views of the driver's tables, one text for both SQL dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WORDS = (
    "'CHECKERS HYPER FOURWAYS ZA', 'WOOLWORTHS FOOD SANDTON', 'VIDA E CAFFE', 'UBER EATS ZA', 'HOLLYWOODBETS ONLINE', 'ENGEN FOURWAYS', "
    "'NETFLIX.COM AMSTERDAM NL', 'TAKEALOT.COM CAPE TOWN', 'TRAFFIC FINE AARTO', 'TRANSFER TO SAVINGS OWN ACCOUNT', 'MONTHLY ACCOUNT FEE', 'QWERTY TRADING 12/03'"
)
_DIALECTS = {
    "spark": {
        "K": "CAST(get_json_object(props,'$.k') AS INT)",
        "MINUS": "date_sub(txn_date, CAST(id % 4 AS INT))",
        "PLUS": "date_add(txn_date, CAST(CASE WHEN id % 4 = 0 THEN id % 3 ELSE 0 END AS INT))",
        "PICK": f"element_at(array({_WORDS}), CAST(id % 12 AS INT) + 1)",
    },
    "duckdb": {
        "K": "CAST(json_extract_string(props,'$.k') AS INT)",
        "MINUS": "txn_date - CAST(id % 4 AS INT)",
        "PLUS": "txn_date + CAST(CASE WHEN id % 4 = 0 THEN id % 3 ELSE 0 END AS INT)",
        "PICK": f"[{_WORDS}][CAST(id % 12 AS INT) + 1]",
    },
}
_VIEWS = {
    "ledger": """
SELECT id, account_id, ts, txn_date, merchant_norm, category, is_cash_withdrawal, status, amount_cents,
  1000000 + CAST(SUM(amount_cents) OVER (PARTITION BY account_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance_cents
FROM (SELECT event_id AS id, user_id AS account_id, ts, CAST(ts AS DATE) AS txn_date,
  CONCAT(event_type, '-', CAST({K} % 10 AS STRING)) AS merchant_norm,
  CASE WHEN event_type='signup' THEN 'Income' WHEN event_id % 20 = 0 THEN 'Cash Withdrawals' WHEN event_id % 23 = 0 THEN NULL
    WHEN event_type='purchase' THEN 'Shopping & Clothing' WHEN event_type='click' THEN 'Coffee & Snacks'
    WHEN event_type='view' THEN 'Groceries' ELSE 'Fines & Penalties' END AS category,
  CASE WHEN event_type<>'signup' AND event_id % 20 = 0 THEN 1 ELSE 0 END AS is_cash_withdrawal,
  CASE WHEN event_id % 31 = 0 THEN 'duplicate' ELSE 'active' END AS status,
  CASE WHEN event_type='signup' THEN 1 ELSE -1 END * CAST(ROUND(value*100) AS BIGINT) AS amount_cents FROM events) x""",
    "receipts": """
SELECT id AS receipt_id, account_id, {MINUS} AS receipt_date, merchant_norm,
  -amount_cents + CASE WHEN id % 3 = 0 THEN 50 ELSE 0 END AS total_cents,
  CASE WHEN merchant_norm LIKE 'purchase-%' THEN 'card' ELSE 'cash' END AS tender_type
FROM ledger WHERE status='active' AND amount_cents < 0 AND is_cash_withdrawal = 0
  AND ((merchant_norm LIKE 'purchase-%' AND id % 5 = 0) OR (merchant_norm LIKE 'click-%' AND id % 9 = 0))""",
    "statements": """
SELECT account_id, account_id*10 + slot AS statement_id, MIN(txn_date) AS period_start, MAX(txn_date) AS period_end
FROM (SELECT account_id, txn_date, CAST(FLOOR((EXTRACT(DAY FROM txn_date)-1)/10) AS BIGINT) AS slot FROM ledger) s
WHERE NOT (slot = 1 AND account_id % 3 = 0) GROUP BY account_id, slot""",
    "incoming": """
SELECT id + 1000000 AS id, account_id, {PLUS} AS txn_date, merchant_norm, amount_cents,
  CASE WHEN id % 2 = 0 THEN NULL ELSE balance_cents END AS balance_cents FROM ledger
WHERE status='active' AND EXTRACT(DAY FROM txn_date) BETWEEN 11 AND 20""",
    "series": """
SELECT ROW_NUMBER() OVER (PARTITION BY c_nationkey, p_brand ORDER BY o_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS id,
  CAST(c_nationkey AS BIGINT) AS account_id, CASE WHEN o_orderkey % 40 = 7 THEN CONCAT(p_brand, ' once ', CAST(o_orderkey AS STRING)) ELSE p_brand END AS merchant_norm,
  CAST(o_orderdate AS DATE) AS txn_date, CASE WHEN o_orderkey % 23 = 5 THEN 'duplicate' ELSE 'active' END AS status,
  -CASE WHEN CAST(REPLACE(p_brand,'Brand#','') AS INT) % 3 = 0 THEN 9900 ELSE CAST(ROUND(l_extendedprice) AS BIGINT) END AS amount_cents,
  CASE WHEN CAST(REPLACE(p_brand,'Brand#','') AS INT) % 2 = 0 THEN 'Subscriptions & Streaming' ELSE 'Communications' END AS category
FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN part ON p_partkey=l_partkey JOIN customer ON c_custkey=o_custkey""",
    "narrations": """
SELECT id, account_id, amount_cents, CONCAT(CASE WHEN id % 5 < 2 THEN 'CARD PURCHASE 4067****1234 ' ELSE 'POS PURCHASE ' END, {PICK}) AS description_raw FROM ledger""",
}
_NEEDS = {"receipts": "ledger", "statements": "ledger", "incoming": "ledger", "narrations": "ledger"}
_TABLES = {"ledger": ["events"], "series": ["lineitem", "orders", "part", "customer"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame over the tables in ``sf_dir``."""
    text = _VIEWS[name].format(**_DIALECTS["spark"])
    sources = {}
    if name in _NEEDS:
        sources[_NEEDS[name]] = view(spark, sf_dir, _NEEDS[name])
    else:
        sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    for t in sources:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **sources)


def write_files(rows: DataFrame, line: Column, path: str, head: str = "", foot: str = "") -> None:
    """A text file for each account, in a folder of its own under ``path``: a line for
    each row in the order of ts and id, after ``head`` and before ``foot``.

    The first and the last row bring these lines with them. As rows of a union they
    could stand in another task, and so in another file, than their account: Spark
    drops a repartition of two sides that are dealt out alike, and then puts together
    partitions of each side on its own."""
    spark = rows.sparkSession
    parts = 4 * spark.sparkContext.defaultParallelism  # a file's cost is not its bytes
    w = Window.partitionBy("account_id").orderBy("ts", "id")
    one = lambda text, there: F.when(there, F.lit(text)).otherwise(F.lit(""))
    before = one(f"{head}\n" if head else "", F.row_number().over(w) == 1)
    after = one(f"\n{foot}" if foot else "", F.lead(F.lit(1)).over(w).isNull())
    lines = rows.select("account_id", "ts", "id", line.alias("line")).repartition(parts, "account_id")
    lines = lines.select("account_id", "ts", "id", F.concat(before, "line", after).alias("value")).sortWithinPartitions("account_id", "ts", "id")
    lines.select("account_id", "value").write.mode("append").partitionBy("account_id").text(path)


def sql_views(*names: str) -> str:
    """The views as the start of a WITH clause in DuckDB."""
    order = [n for n in _VIEWS if n in names or any(_NEEDS.get(x) == n for x in names)]
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n].format(**_DIALECTS['duckdb'])})" for n in order)
