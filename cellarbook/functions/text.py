"""Text clean-up rules for item names and unit names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarbook.fixed_values import CATEGORY_OTHER, CATEGORY_PREFIXES, ITEM_TEXT_REPLACEMENTS
from cellarbook.site import Site

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.btrim(c, F.lit(WHITESPACE))


def title_case(c: Column) -> Column:
    """Capital after any non-letter ("Coca-Cola 2X1"), unlike `initcap`, which looks at blanks only."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def contains_ci(c: Column, mark: str) -> Column:
    """Case-insensitive substring test; NULL text counts as "no"."""
    return F.coalesce(F.lower(c).contains(mark), F.lit(False))


def normal_item_name(c: Column) -> Column:
    replaced = reduce(
        lambda text, rule: F.replace(text, F.lit(rule[0]), F.lit(rule[1])), ITEM_TEXT_REPLACEMENTS, F.lower(c)
    )
    return title_case(strip(replaced))


def item_category(c: Column) -> Column:
    name = F.lower(c)
    first, *rest = CATEGORY_PREFIXES
    rule = F.when(name.startswith(first[0]), first[1])
    for prefix, label in rest:
        rule = rule.when(name.startswith(prefix), label)
    return rule.otherwise(CATEGORY_OTHER)


def unit_name(c: Column, site: Site) -> Column:
    """One spelling per unit, whatever case or blanks the ledgers use."""
    trimmed = F.trim(c)
    return (
        F.when(F.lower(trimmed) == site.b, site.b).when(F.lower(trimmed) == site.a, site.unit_a).otherwise(trimmed)
    )
