"""Date parsing and date labels."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarbook.fixed_values import WEEKDAYS

DateLike = date | str | Column


def as_date(value: DateLike) -> Column:
    return value.cast("date") if isinstance(value, Column) else F.lit(str(value)).cast("date")


def month_name_date(c: Column) -> Column:
    """`01-Feb-2024` or `1-Feb-2024`; anything else is NULL."""
    return F.try_to_date(c, "d-MMM-yyyy")


def slash_date(c: Column) -> Column:
    """`31/12/2024` (day first); anything else is NULL."""
    return F.try_to_date(c, "d/M/yyyy")


def sheet_header_date(header: str) -> date | None:
    """Date named by a sheet column header: `dd/mm/yyyy`, else `dd/mm/yy`."""
    for pattern in ("%d/%m/%Y", "%d/%m/%y"):
        try:
            return datetime.strptime(header, pattern).date()
        except ValueError:
            continue
    return None


def business_date(ts: Column, shift_hours: int) -> Column:
    """Calendar date after moving the timestamp back, so that late nights belong to the day before."""
    return (ts - F.expr(f"INTERVAL {shift_hours} HOURS")).cast("date")


def iso_year_week(d: Column) -> Column:
    """`202501` for 2024-12-30: ISO week-year followed by the two-digit ISO week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def period_label(d: Column) -> Column:
    return F.date_format(d, "yyyy.MM.dd")


def weekday_abbr(d: Column) -> Column:
    return F.date_format(d, "E")


def weekday_order(abbr: Column) -> Column:
    """Mon = 1 ... Sun = 7, for sorting weekday names."""
    return F.array_position(F.array(*[F.lit(day) for day in WEEKDAYS]), abbr)
