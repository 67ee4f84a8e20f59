"""Bills of materials, portion weights, prices and per-item factors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarbook.functions.dates import DateLike, as_date
from cellarbook.functions.text import not_blank
from cellarbook.operators.flows import LINE_BYTES, per_day
from cellarbook.operators.joins import fits_broadcast, join_side, spread


def explode_recipe(sales: DataFrame, recipe: DataFrame, own_code_only: bool, dealt: bool = False) -> DataFrame:
    """Ingredient use of each sale line: sold quantity times recipe quantity.

    `dealt` are sales summed by code and day: few bytes that become many rows of use, so they are dealt over tasks by
    what the plan reads, by code alone where the join needs that.
    """
    lines = recipe.filter(not_blank(F.col("cod_insumo"))) if own_code_only else recipe
    lines = lines.select(
        F.col("cod_producto").alias("codigo_inventario"),
        F.col("producto").alias("_dish"),
        "cod_insumo",
        "insumo",
        F.col("cantidad").alias("factor_receta"),
    )
    sold = sales.filter(F.col("codigo_inventario").isNotNull())
    if dealt:
        sold = spread(sold, ["codigo_inventario", "fecha"][: 2 if fits_broadcast(lines) else 1], LINE_BYTES)
    joined = join_side(sold, lines, ["codigo_inventario"])
    code = ["cod_insumo"] if own_code_only else []
    return joined.select(
        "fecha",
        *code,
        "insumo",
        F.col("codigo_inventario").alias("cod_producto"),
        F.col("_dish").alias("producto"),
        F.col("cantidad").alias("cantidad_vendida"),
        "factor_receta",
        (F.col("cantidad") * F.col("factor_receta")).alias("cantidad_consumida"),
    )


def ingredient_use_per_day(sales: DataFrame, recipe: DataFrame, own_code_only: bool) -> DataFrame:
    """The same use summed per sold code and day before the join, which is all a flow needs."""
    return explode_recipe(per_day(sales, ["codigo_inventario"]), recipe, own_code_only, dealt=True)


def trimmed_mean(samples: DataFrame, by: str, value: str, out: str, deviations: float = 2.0) -> DataFrame:
    """Mean per group without samples beyond `deviations` population standard deviations.

    Samples of one value are counted first, on the map side, so a group in which they mostly agree is down
    to a few rows before it meets its limits.
    """
    limits = samples.groupBy(by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    near = F.col(value).between(
        F.col("_mean") - deviations * F.col("_dev"), F.col("_mean") + deviations * F.col("_dev")
    )
    distinct = samples.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    kept = join_side(distinct, limits, [by]).filter(near)
    return kept.groupBy(by).agg((F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias(out))


def weighted_price(purchases: DataFrame, as_of: DateLike, days: int) -> DataFrame:
    """Average price paid per code over the last `days` days, weighted by quantity."""
    recent = purchases.filter(not_blank(F.col("cod_producto")) & (F.col("fecha") >= F.date_sub(as_date(as_of), days)))
    sums = recent.groupBy("cod_producto").agg(
        F.sum("cantidad").alias("cantidad"), F.sum("precio_total").alias("_paid")
    )
    return sums.select(
        "cod_producto", "cantidad", F.try_divide(F.col("_paid"), F.col("cantidad")).alias("precio_compra")
    )


def portions(counted: Column, weight: Column, mean_weight: Column, whole: bool) -> Column:
    """Portions as written, else weight over the mean portion weight."""
    by_weight = F.try_divide(weight, mean_weight)
    return F.coalesce(counted, F.round(by_weight, 0) if whole else by_weight)


def apply_factors(
    quantity: Column,
    name: Column | None = None,
    by_name: Iterable[tuple[str, float]] = (),
    code: Column | None = None,
    by_code: Iterable[tuple[str, float]] = (),
) -> Column:
    """Units of stock behind a sold quantity; a rule by name wins over one by code."""
    rules = [(name == n, f) for n, f in by_name] + [(code == c, f) for c, f in by_code]
    if not rules:
        return quantity
    out = None
    for test, factor in rules:
        value = quantity * F.lit(factor)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(quantity)


def lowest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One whole row per key, the lowest by `order` (NULL last).

    A minimum over a struct combines on the map side, so copies of one key are never gathered.
    """
    ranked = [x for c in order for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))]
    rest = [F.col(c) for c in rows.columns if c != key and c not in order]
    best = rows.groupBy(key).agg(F.min(F.struct(*ranked, *rest)).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col(f"_best.{c}").alias(c) for c in rows.columns])

