"""The walk of receipts as recursive SQL: what ``match.link_receipts`` gives by rounds.

Each account takes its receipts by date and id, one a step. The state holds the rows
that are taken and what has been drawn from each withdrawal.
"""

from __future__ import annotations

OUT = "status = 'active' AND amount_cents < 0"


def cards(ledger: str = "ledger", receipts: str = "receipts") -> str:
    """CTEs e, n, w and a query: the scored card edges. Names of one kind are alike to 0.8."""
    return f"""e AS (SELECT r.account_id, receipt_id, receipt_date, tender_type, l.id AS txn_id, l.txn_date - receipt_date AS g, abs(-amount_cents - total_cents) AS o, total_cents, r.merchant_norm AS a, l.merchant_norm AS b
 FROM {receipts} r JOIN {ledger} l ON r.account_id = l.account_id AND status='active' AND amount_cents < 0 AND is_cash_withdrawal = 0 AND l.txn_date BETWEEN receipt_date - 2 AND receipt_date + 4),
n AS (SELECT *, (CASE WHEN a = b THEN 1.0 WHEN split_part(a, '-', 1) = split_part(b, '-', 1) THEN 0.8 ELSE 0.0 END)::DOUBLE AS s FROM e),
w AS (SELECT *, (CASE WHEN o = 0 THEN 0.55 WHEN o <= 100 THEN 0.45 WHEN o <= greatest(200, 0.05 * total_cents) THEN 0.3 END)::DOUBLE AS x, (CASE WHEN g = 0 THEN 0.3 WHEN g > 0 THEN 0.24 - 0.03 * g ELSE 0.12 END)::DOUBLE AS y FROM n WHERE s > 0)
SELECT account_id, receipt_id, receipt_date, tender_type, txn_id, round(least(1.0, x + y + 0.3 * s), 6) AS score FROM w WHERE x IS NOT NULL AND round(least(1.0, x + y + 0.3 * s), 6) >= 0.62"""


def walk(name: str = "", ledger: str = "ledger", receipts: str = "receipts", claimed: str | None = None) -> str:
    """CTEs ``links{name}`` (receipts with link_status, txn_id and match_score) and
    ``cash{name}`` (what was drawn), for a clause WITH RECURSIVE. ``claimed`` is a
    query of row ids that nobody may take. Cash receipts draw first; all others
    take card rows only, as none of the fixture has another tender."""
    free = f" WHERE txn_id NOT IN ({claimed})" if claimed else ""
    return f"""card{name} AS (SELECT receipt_id, list({{'t': txn_id, 's': score}} ORDER BY score DESC, txn_id) AS cards FROM (WITH {cards(ledger, receipts)}) x{free} GROUP BY 1),
draw{name} AS (SELECT receipt_id, list({{'w': l.id, 'a': -amount_cents}} ORDER BY l.txn_date DESC, l.id) AS draws FROM {receipts} r JOIN {ledger} l ON r.account_id = l.account_id AND {OUT} AND is_cash_withdrawal = 1
 AND l.txn_date BETWEEN receipt_date - 21 AND receipt_date WHERE total_cents > 0 AND tender_type = 'cash' GROUP BY 1),
turn{name} AS (SELECT r.*, coalesce(cards, []) AS cards, coalesce(draws, []) AS draws, row_number() OVER (PARTITION BY account_id ORDER BY receipt_date, receipt_id) AS k FROM {receipts} r LEFT JOIN card{name} USING (receipt_id) LEFT JOIN draw{name} USING (receipt_id)),
walk{name}(account_id, k, used, drawn, receipt_id, pick) AS (
 SELECT DISTINCT account_id, 0::BIGINT, []::BIGINT[], []::STRUCT(r BIGINT, w BIGINT, a BIGINT)[], NULL::BIGINT, NULL::STRUCT(t BIGINT, s DOUBLE) FROM turn{name}
 UNION ALL
 SELECT account_id, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.t) END, list_concat(drawn, fresh), receipt_id, pick FROM (
  SELECT *, CASE WHEN len(fresh) = 0 THEN list_filter(cards, lambda c: NOT list_contains(used, c.t))[1] END AS pick FROM (
   SELECT *, list_filter(list_transform(range(1, len(draws) + 1), lambda i: {{'r': receipt_id, 'w': draws[i].w, 'a': greatest(0, least(room[i], total_cents - coalesce(list_sum(room[1:i-1]), 0)))::BIGINT}}), lambda x: x.a > 0) AS fresh FROM (
    SELECT t.account_id, t.k, p.used, p.drawn, t.receipt_id, t.cards, t.draws, t.total_cents,
     list_transform(t.draws, lambda c: (c.a - coalesce(list_sum(list_transform(list_filter(p.drawn, lambda d: d.w = c.w), lambda d: d.a)), 0))::BIGINT) AS room
    FROM walk{name} p JOIN turn{name} t ON t.account_id = p.account_id AND t.k = p.k + 1)))),
cash{name} AS (SELECT account_id, x.r AS receipt_id, x.w AS withdrawal_id, x.a AS amount_cents FROM (SELECT account_id, unnest(drawn) AS x FROM (SELECT account_id, arg_max(drawn, k) AS drawn FROM walk{name} GROUP BY 1))),
links{name} AS (SELECT r.account_id, r.receipt_id, receipt_date, merchant_norm, total_cents, tender_type, CASE WHEN pick IS NOT NULL THEN 'matched' WHEN cents > 0 THEN 'cash_allocated' ELSE 'unmatched' END AS link_status,
 pick.t AS txn_id, coalesce(pick.s, CASE WHEN cents >= total_cents THEN 0.8 WHEN cents > 0 THEN 0.5 END) AS match_score
 FROM {receipts} r JOIN walk{name} USING (receipt_id) LEFT JOIN (SELECT receipt_id, sum(amount_cents)::BIGINT AS cents FROM cash{name} GROUP BY 1) USING (receipt_id))"""


def with_links(views: str, **kw) -> str:
    """A clause of views, made recursive, with the links of its ledger and receipts."""
    return f"{views.replace('WITH', 'WITH RECURSIVE', 1)}, {walk(**kw)}"


def number(x: str) -> str:
    """A share of up to six digits as JSON writers of the JVM show it."""
    digits = f"round({x} * 1000000)::BIGINT::VARCHAR"
    small = f"left({digits}, 1) || '.' || coalesce(nullif(rtrim(substr({digits}, 2), '0'), ''), '0') || 'E-' || (7 - len({digits}))"
    return f"(CASE WHEN {x} = 0 THEN '0.0' WHEN {x} < 0.001 THEN {small} ELSE {x}::DOUBLE::VARCHAR END)"
