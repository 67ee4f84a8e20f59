"""Sales pivot: any row dimensions by unit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarbook.functions.dates import DateLike, as_date, weekday_order
from cellarbook.functions.numbers import or_zero, round_half_even

# Dimensions from coarse to fine; a pivot nests them in this order, in whatever order they are asked for.
DIMENSIONS = ("anio", "mes", "semana_anio", "dia_semana", "dia", "negocio", "categoria", "producto", "cod_prod")
METRICS = {"ventas_bs": ("ventas_bs", "sum"), "cantidad": ("cantidad", "sum"), "ventas_x_dia": ("ventas_bs", "per_day")}


def filter_sales(
    cube: DataFrame,
    units: Sequence[str],
    start: DateLike | None = None,
    end: DateLike | None = None,
    categories: Sequence[str] = (),
    items: Sequence[str] = (),
    weeks: Sequence[int] = (),
) -> DataFrame:
    """Filters of the sales pivot. No unit selected gives no rows; any other empty list filters nothing."""
    if not units:
        return cube.filter(F.lit(False))
    if start is not None:
        cube = cube.filter(F.col("fecha") >= as_date(start))
    if end is not None:
        cube = cube.filter(F.col("fecha") <= as_date(end))
    for column, wanted in (("categoria", categories), ("producto", items), ("semana_anio", weeks), ("negocio", units)):
        if wanted:
            cube = cube.filter(F.col(column).isin(*wanted))
    return cube


def sales_pivot(cube: DataFrame, rows: Sequence[str], metric: str, units: Sequence[str]) -> DataFrame:
    """One column per unit, missing cells 0, `Total` when there is more than one unit; half-even rounded.

    `ventas_x_dia` divides a cell's sum by the days it has sales on. Rows with a NULL dimension or
    of other units are left out. The unit columns are named by the caller, so no extra pass finds them, and all cells of a row are
    conditional sums of one aggregate: one shuffle, combined on the map side.
    """
    dims = [d for d in DIMENSIONS if d in rows] or ["anio"]
    column, how = METRICS[metric]
    cube = cube.filter(F.col("negocio").isin(*units))
    for d in dims:
        cube = cube.filter(F.col(d).isNotNull())
    if how == "per_day":
        # Down to one row per cell and day first; counting days is then a plain count.
        cube = cube.groupBy(*dict.fromkeys([*dims, "negocio", "dia"])).agg(F.sum(column).alias(column))

    def cell(unit: str) -> Column:
        is_unit = F.col("negocio") == unit
        total = F.sum(F.when(is_unit, F.col(column)))
        return F.try_divide(total, F.count_if(is_unit)) if how == "per_day" else total

    wide = cube.groupBy(*dims).agg(*[cell(u).alias(f"_unit_{i}") for i, u in enumerate(units)])
    filled = [or_zero(F.col(f"_unit_{i}")) for i in range(len(units))]
    out = [round_half_even(c).alias(u) for c, u in zip(filled, units)]
    if len(units) > 1:
        out.append(round_half_even(reduce(Column.__add__, filled)).alias("Total"))
    return wide.select(*dims, *out)


def in_pivot_order(pivot: DataFrame) -> DataFrame:
    """Sort by the row dimensions, weekdays from Monday to Sunday."""
    dims = [d for d in DIMENSIONS if d in pivot.columns]
    return pivot.orderBy(*[weekday_order(F.col(d)) if d == "dia_semana" else F.col(d) for d in dims])
