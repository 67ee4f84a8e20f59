"""Delivery orders and hand-typed extras written as free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarbook.fixed_values import (
    COMMISSION_TAX_FACTOR,
    COMMISSION_TIERS,
    EXTRA_MEAT_MARK,
    NUMBERED_ITEM,
    VEGETARIAN_MARK,
    VEGETARIAN_QUANTITIES,
)
from cellarbook.functions.text import contains_ci, strip
from cellarbook.operators.unpivot import unpivot_columns


def order_items(orders: DataFrame, text: str) -> DataFrame:
    """`2 Burger [no cheese], 1 Soda, note` -> (2, burger), (1, soda).

    Every comma splits, also one inside brackets; a part is read up to its first "[", and a part that
    does not begin with a number is dropped.
    """
    others = [c for c in orders.columns if c != text]
    parts = orders.select(*others, F.explode(F.split(text, ",")).alias("_part"))
    parts = parts.withColumn("_part", strip(F.split_part(F.col("_part"), F.lit("["), F.lit(1))))
    numbered = parts.filter(F.col("_part").rlike(NUMBERED_ITEM))
    return numbered.select(
        *others,
        F.regexp_extract("_part", NUMBERED_ITEM, 1).try_cast("bigint").alias("cantidad"),
        F.lower(strip(F.regexp_extract("_part", NUMBERED_ITEM, 2))).alias("producto"),
    )


def commission_fee(day: Column) -> Column:
    """Fee of the delivery channel on that day."""
    rule = None
    for comparison, limit, fee in COMMISSION_TIERS:
        if limit is None:
            return rule.otherwise(F.lit(fee))
        limit = F.lit(limit).cast("date")
        test = day < limit if comparison == "<" else day <= limit
        rule = F.when(test, F.lit(fee)) if rule is None else rule.when(test, F.lit(fee))
    return rule


def net_of_commission(net: Column, day: Column) -> Column:
    return net * (F.lit(1.0) - commission_fee(day) / F.lit(COMMISSION_TAX_FACTOR))


def signed_extra(quantity: Column, notes: Column, first: Column, second: Column) -> Column:
    """A vegetarian order with extra meat takes the meat back."""
    takes_back = contains_ci(notes, VEGETARIAN_MARK) & (
        contains_ci(first, EXTRA_MEAT_MARK) | contains_ci(second, EXTRA_MEAT_MARK)
    )
    return F.when(takes_back, -quantity).otherwise(quantity)


def extra_values(extras: DataFrame) -> DataFrame:
    """(fecha, variable1, variable2, cantidad) -> one row per value named in the first two places of either list."""
    place = lambda c, i: strip(F.try_element_at(F.split(c, ","), F.lit(i)))
    wide = extras.select(
        "fecha",
        "cantidad",
        place("variable1", 1).alias("v11"),
        place("variable1", 2).alias("v12"),
        place("variable2", 1).alias("v21"),
        place("variable2", 2).alias("v22"),
    )
    long = unpivot_columns(wide, ["fecha", "cantidad"], ["v11", "v12", "v21", "v22"], "_place", "value")
    return long.filter(F.col("value").isNotNull() & (F.col("value") != "-")).select("fecha", "cantidad", "value")


def vegetarian_returns(extras: DataFrame) -> DataFrame:
    """Vegetarian dishes with their sign turned, kept for the small whole quantities only."""
    signed = F.when(contains_ci(F.col("notas"), VEGETARIAN_MARK), -F.col("cantidad")).otherwise(F.col("cantidad"))
    return extras.withColumn("cantidad", signed).filter(F.col("cantidad").isin(*VEGETARIAN_QUANTITIES))
