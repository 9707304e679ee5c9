"""Half-open date windows: a row is inside if start <= value < end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def within(value: Column, start: Column | None, end: Column | None) -> Column:
    """start <= value < end; either end may be open. Null is outside."""
    parts = [value >= start] * (start is not None) + [value < end] * (end is not None)
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out & value.isNotNull()


def day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def month_window(year: int, month: int, months: int = 1) -> tuple[Column, Column]:
    """Start and end of months whole months; a quarter is three."""
    last = year * 12 + month - 1 + months
    return day(f"{year:04d}-{month:02d}-01"), day(f"{last // 12:04d}-{last % 12 + 1:02d}-01")


def quarter_window(year: int, quarter: int) -> tuple[Column, Column]:
    return month_window(year, 3 * quarter - 2, 3)


#: Windows relative to the latest value in the data: (unit, how far back, units).
RELATIVE = {"today": ("day", 0, 1), "yesterday": ("day", 1, 1), "this month": ("month", 0, 1), "last month": ("month", 1, 1), "this year": ("year", 0, 1), "last year": ("year", 1, 1)}


def relative_window(latest: Column, name: str) -> tuple[Column, Column]:
    """Window of a name in RELATIVE, or of "last N days", that ends with latest's day."""
    shift = lambda start, unit, n: F.timestamp_add(unit, F.lit(n), start)
    if name in RELATIVE:
        unit, back, n = RELATIVE[name]
        start = shift(F.date_trunc(unit, latest), unit, -back)
        return start.cast("timestamp_ntz"), shift(start, unit, n).cast("timestamp_ntz")
    words = name.split()
    if len(words) != 3 or words[0] != "last" or not words[1].isdigit() or words[2] not in ("day", "days"):
        raise ValueError(f"no such window: {name!r}")
    end = shift(F.date_trunc("day", latest), "day", 1)
    return shift(end, "day", -int(words[1])).cast("timestamp_ntz"), end.cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Days from start to end with fractions, as a double; null if either is null."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(86_400_000_000.0)
