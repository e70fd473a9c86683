"""Dates in many formats, and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats in order of trial, for day-first and for month-first files.
SHARED = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")
DAY_FIRST = ("dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "d/M/yyyy", "dd-MM-yy", "dd/MM/yy", "dd.MM.yy")
MONTH_FIRST = ("MM/dd/yyyy", "MM-dd-yyyy", "M/d/yyyy", "MM/dd/yy")
NAMED = (
    "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "d-MMM-yy", "d MMM yy", "MMM d, yyyy", "MMMM d, yyyy",
)
TIMED = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss")


def _looks(s: Column, fmt: str) -> Column:
    """Whether a text may be of a format, told by its marks and where they stand.
    Trying a format that does not fit costs an exception, many times a match."""
    if fmt == "yyyyMMdd":
        return s.rlike("^[+-]?[0-9]+$")
    if fmt[:4] == "yyyy":
        return s.rlike(f"^[+-]?[0-9]{{4,}}{fmt[4]}")
    if fmt[:2] in ("dd", "MM") and fmt[:3] != "MMM":
        return s.rlike(rf"^[0-9]{{2}}\{fmt[2]}")
    found = F.lit(True)
    for mark in sorted(set(fmt) & set("-/,: ")):
        found = found & F.contains(s, F.lit(mark))
    return found


def parse_date(text: Column, day_first: Column) -> Column:
    """The date, or null. ``day_first`` decides the order of formats per row."""
    s = F.trim(text)
    read = lambda formats: [F.when(_looks(s, f), F.try_to_timestamp(s, F.lit(f)).cast("date")) for f in formats]
    day, month = F.coalesce(*read(DAY_FIRST)), F.coalesce(*read(MONTH_FIRST))
    numeric = F.when(day_first, F.coalesce(day, month)).otherwise(F.coalesce(month, day))
    # Digits alone cannot be a named month, and only a colon makes a time.
    named = F.when(s.rlike("[A-Za-z]{3}"), F.coalesce(*read(NAMED)))
    timed = F.when(F.contains(s, F.lit(":")), F.coalesce(*read(TIMED)))
    return F.when((F.length(s) >= 6) & s.rlike("[0-9]"), F.coalesce(*read(SHARED), numeric, named, timed))


def month_periods(extents: DataFrame) -> DataFrame:
    """(account_id, period, start, end) of each calendar month of an extent
    (account_id, first, last)."""
    months = F.explode(F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month")))
    m = extents.select("account_id", months.alias("start"))
    return m.select("account_id", F.date_format("start", "yyyy-MM").alias("period"), "start", F.last_day("start").alias("end"))


def named_periods(extents: DataFrame, last_days: int = 7, last_months: int = 3) -> DataFrame:
    """The usual report periods of each account as of the end of its data:
    this and last month, quarter, year, year to date, the last days (inclusive),
    the last months (same day back, clamped to the month's end) and all data."""
    as_of = F.col("last")
    quarter = F.trunc(as_of, "quarter")
    last_month = F.add_months(F.trunc(as_of, "month"), -1)
    rows = [
        ("this-month", F.trunc(as_of, "month"), F.last_day(as_of)),
        ("last-month", last_month, F.last_day(last_month)),
        ("quarter", quarter, F.date_sub(F.add_months(quarter, 3), 1)),
        ("year", F.trunc(as_of, "year"), F.date_sub(F.add_months(F.trunc(as_of, "year"), 12), 1)),
        ("last-year", F.add_months(F.trunc(as_of, "year"), -12), F.date_sub(F.trunc(as_of, "year"), 1)),
        ("year-to-date", F.trunc(as_of, "year"), as_of),
        ("last-days", F.date_sub(as_of, last_days - 1), as_of),
        ("last-months", F.add_months(as_of, -last_months), as_of),
        ("all", F.col("first"), as_of),
    ]
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("period"), a.alias("start"), b.alias("end")) for n, a, b in rows)))
    return extents.select("account_id", every.alias("p")).select("account_id", "p.*")


def months_of(start: Column, end: Column) -> Column:
    """Length of an inclusive period in average months."""
    return (F.datediff(end, start) + 1) / 30.44
