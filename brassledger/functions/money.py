"""Money as text, decimal and whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_amount(text: Column) -> Column:
    """Decimal amount of a text, null if it holds none.

    Currency signs and blanks are dropped; (x), -x and x- are negative. The last
    of ',' and '.' is the decimal mark if both occur; one comma followed by one
    or two digits is one too; several dots group thousands; one dot always is
    the decimal mark.
    """
    s = F.trim(text)
    negative = s.rlike(r"^\(.*\)$|-\s*$|^[^0-9]*-")
    # ';' stands for the decimal mark once it is known; each step is one replacement.
    steps = (
        (r"[^0-9.,]", ""),
        (r"^(.*\..*),(\d*)$", "$1;$2"),
        (r",(?=.*\.)|[.,](?=.*;)", ""),
        (r"^([^,;]*),(\d{1,2})$", "$1;$2"),
        (r",", ""),
        (r"\.(?=.*\.)|(?<=\.[^.]{0,18})\.", ""),
        (r";", "."),
    )
    for pattern, new in steps:
        s = F.regexp_replace(s, F.lit(pattern), F.lit(new))
    return s.try_cast("decimal(18,6)") * F.when(negative, -1).otherwise(1).cast("decimal(1,0)")


def to_cents(amount: Column) -> Column:
    """Half-up whole cents of a decimal."""
    return F.round(amount * 100, 0).cast("long")


def from_cents(cents: Column) -> Column:
    return F.coalesce(cents, F.lit(0)).cast("decimal(20,2)") / F.lit(100).cast("decimal(3,0)")


def truncated(x: Column) -> Column:
    """Whole number toward zero."""
    return x.cast("long")
