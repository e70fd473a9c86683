"""Daily totals with rows that come after their day has closed, against a walk in plain Python."""

import datetime as dt
from collections import defaultdict

import pytest
from brassledger.streaming import batches, late
from pyspark.sql import functions as F

SCHEMA = "account_id long, ts timestamp, status string, amount_cents long, category string, day string, batch int, row int"


def at(day, hour=12, month=3):
    return dt.datetime(2025, month, day, hour)


def row(account, ts, cents=-100, category="Groceries", status="active"):
    return (account, ts, status, cents, category, "clash", 7, 8)


ARRIVALS = [
    [row(1, at(1)), row(1, at(1)), row(1, at(4)), row(2, at(8)), row(None, at(2)), row(1, at(2), category=None), row(1, at(3), status="duplicate"), row(1, at(3), 500)],
    [row(1, at(2), -7), row(1, at(5), -8), row(1, None, -9), row(2, at(12)), row(1, at(4), -3, category="Fuel")],
    [],
    [row(1, at(9), -1), row(1, at(1), -2), row(3, at(8), -5), row(2, at(28)), row(1, at(12), -4)],
]


def walked(arrivals, delay=3):
    horizon, open_, closed, side = None, defaultdict(lambda: [0, 0]), {}, defaultdict(lambda: [0, 0])
    for rows in arrivals:
        rows = [r for r in rows if r[2] == "active" and r[3] < 0]
        for account, ts, _, cents, category, *_ in rows:
            key = (account, ts and ts.date(), category or "Uncategorised")
            at_ = side if ts is None or (horizon and ts.date() < horizon) else open_
            at_[key][0] -= cents
            at_[key][1] += 1
        seen = [r[1] for r in rows if r[1]]
        if seen:
            horizon = max(filter(None, (horizon, (max(seen) - dt.timedelta(days=delay)).date())))
        for key in [k for k in open_ if horizon and k[1] < horizon]:
            assert key not in closed
            closed[key] = open_.pop(key)
    return closed, side


def both(closed, side):
    keys = set(closed) | set(side)
    return {k: (closed.get(k, [0, 0])[0] + side.get(k, [0, 0])[0], closed.get(k, [0, 0])[1] + side.get(k, [0, 0])[1], side.get(k, [0, 0])[1]) for k in keys}


def arrive(spark, base, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    late.daily_closed(spark, spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), f"{base}/store", f"{base}/work").awaitTermination()


def shown(spark, base):
    return {(r.account_id, r.day, r.category): (r.cents, r.n, r.n_late) for r in late.totals(spark, f"{base}/store").collect()}


def test_late_rows_against_a_walk(spark, tmp_path):
    base = str(tmp_path)
    for k, rows in enumerate(ARRIVALS, 1):
        arrive(spark, base, rows)
        closed, side = walked(ARRIVALS[:k])
        if k == 3:  # nothing is settled before this
            assert shown(spark, base) == both(closed, {})
            assert late.settle(spark, f"{base}/store") and not late.settle(spark, f"{base}/store")
            assert shown(spark, base) == both(closed, side)
    assert late.settle(spark, f"{base}/store") and not late.settle(spark, f"{base}/store")
    assert shown(spark, base) == both(closed, side) and (1, None, "Groceries") in both(closed, side)
    kept = batches.table(spark, f"{base}/store", "late", schema="day date, row struct<account_id: long, day: string, batch: int>").collect()
    assert len(kept) == sum(n for _, n in side.values()) and {r["row"]["day"] for r in kept} == {"clash"}
    late_before = shown(spark, base)
    batches.compacted(spark, f"{base}/store", late.BY)
    assert shown(spark, base) == late_before and not late.settle(spark, f"{base}/store")


def test_no_rows_at_all(spark, tmp_path):
    arrive(spark, str(tmp_path), [])
    assert shown(spark, str(tmp_path)) == {} and not late.settle(spark, f"{tmp_path}/store")


@pytest.mark.parametrize("after", [1, 3])
def test_a_batch_that_fails_closes_its_days_once(spark, tmp_path, monkeypatch, after):
    base, left, real = str(tmp_path), [after], batches._write
    arrive(spark, base, ARRIVALS[0])

    def tripped(*a):
        if left[0] == 0:
            raise OSError("lost")
        left[0] -= 1
        real(*a)

    monkeypatch.setattr(batches, "_write", tripped)
    with pytest.raises(Exception, match="lost"):
        arrive(spark, base, ARRIVALS[1])
    assert shown(spark, base) == both(walked(ARRIVALS[:1])[0], {})
    monkeypatch.undo()
    arrive(spark, base, [])
    late.settle(spark, f"{base}/store")
    assert shown(spark, base) == both(*walked(ARRIVALS[:2]))


def test_closing_reads_only_the_days_that_close(spark, tmp_path):
    base = str(tmp_path)
    arrive(spark, base, ARRIVALS[0])
    arrive(spark, base, ARRIVALS[1])
    part = batches.table(spark, f"{base}/store", "partials", schema=late.TOTALS).where(F.col("day") < F.lit(dt.date(2025, 3, 5)))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
