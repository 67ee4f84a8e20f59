"""Number parsing, safe division and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarbook.fixed_values import NULL_TEXT

WRITTEN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_double(c: Column) -> Column:
    """A number written in digits, else NULL; "5d", "NaN" and "Infinity" are no numbers."""
    written = F.rlike(F.trim(c.cast("string")), F.lit(WRITTEN_NUMBER))
    return F.when(written, c.try_cast("double"))


def thousands_number(c: Column) -> Column:
    """`1,234.50` -> 1234.5; text that is no number becomes NULL."""
    return to_double(F.replace(c.cast("string"), F.lit(","), F.lit("")))


def decimal_comma_number(c: Column) -> Column:
    """`12,50` -> 12.5."""
    return to_double(F.replace(c.cast("string"), F.lit(","), F.lit(".")))


def percent_fraction(c: Column) -> Column:
    """`12%` -> 0.12."""
    return to_double(F.replace(c.cast("string"), F.lit("%"), F.lit(""))) / 100


def gross_quantity(net: Column, waste: Column) -> Column:
    """Quantity to take from stock so that `net` is left after waste; NULL when all of it is waste."""
    return F.try_divide(net, F.lit(1.0) - waste)


def count_cell(c: Column) -> Column:
    """A counted cell: every "-" is dropped, then a number or NULL."""
    return to_double(F.replace(c.cast("string"), F.lit("-"), F.lit("")))


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def round_half_even(c: Column) -> Column:
    """Whole number, half to even.

    Sums of doubles differ in their last bits with the order tasks finish in; cutting those off first
    keeps a tie a tie on every run.
    """
    return F.bround(F.round(c, 6), 0)


def dash_text(c: Column, grouped: bool = True) -> Column:
    """Rounded number as text, NULL as a dash; thousands separators when `grouped`."""
    text = F.format_number(round_half_even(c), 0) if grouped else F.round(F.round(c, 6), 0).cast("string")
    return F.coalesce(text, F.lit(NULL_TEXT))
