"""Counted against expected stock, per period and per day, for every area by one pair of functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarbook.functions.dates import DateLike, as_date, period_label, weekday_abbr
from cellarbook.functions.numbers import or_zero
from cellarbook.operators.flows import LINE_BYTES, days_in_periods, flow_days, sum_over_periods
from cellarbook.operators.joins import spread
from cellarbook.operators.periods import OPEN_DAYS


@dataclass(frozen=True)
class Area:
    """How one stock area is reconciled.

    measures: output columns worked out from the flow sums, alike for a period and for a day.
    total:    measures that make up `ventas_totales` and leave stock as one sum.
    apart:    measures that leave stock besides that sum.
    """

    key: str
    carry: tuple[str, ...]
    upper: bool
    flows: tuple[str, ...]
    measures: tuple[str, ...]
    total: tuple[str, ...] = ()
    apart: tuple[str, ...] = ()
    counted: tuple[str, ...] = ()
    formulas: Callable[[], dict[str, Column]] | None = None
    inflow: str = "compras"
    show_total: bool = True

    def measure_columns(self) -> list[Column]:
        special = self.formulas() if self.formulas else {}
        return [special.get(m, or_zero(F.col(m))).alias(m) for m in self.measures]

    def sold(self) -> Column:
        first, *rest = self.total
        out = F.col(first)
        for name in rest:
            out = out + F.col(name)
        return out

    def leave(self, stock: Column) -> Column:
        if self.total:
            stock = stock - self.sold()
        for name in self.apart:
            stock = stock - F.col(name)
        return stock

    def expected(self) -> Column:
        return self.leave(F.col("inv_inicial") + F.col(self.inflow))

    def net(self) -> Column:
        return self.leave(F.col(self.inflow))


def complimentary_when_moved(movement: str, direct: str) -> Column:
    """Movements beyond direct sales, but only where there were movements at all; may be negative."""
    return F.when(F.col(f"{movement}_rows") > 0, or_zero(F.col(movement)) - or_zero(F.col(direct))).otherwise(0.0)


# Unit A, drinks and wines: by name; sales are direct plus through recipes.
DRINKS_A = Area(
    key="producto",
    carry=("categoria",),
    upper=True,
    flows=("compras", "directas", "indirectas", "ventas_ext", "movimientos", "salidas"),
    counted=("movimientos",),
    measures=("compras", "ventas", "ventas_ext", "cortesias", "salidas"),
    formulas=lambda: {
        "ventas": or_zero(F.col("directas")) + or_zero(F.col("indirectas")),
        "cortesias": complimentary_when_moved("movimientos", "directas"),
    },
    total=("ventas", "ventas_ext", "cortesias"),
    apart=("salidas",),
)
# Unit A, ingredients: by name.
INGREDIENTS_A = Area(
    key="producto",
    carry=(),
    upper=True,
    flows=("compras", "ventas", "salidas"),
    measures=("compras", "ventas", "salidas"),
    apart=("ventas", "salidas"),
    show_total=False,
)
# Unit B, drinks: by code; complimentary items stand apart from sales.
DRINKS_B = Area(
    key="cod_producto",
    carry=("producto",),
    upper=False,
    flows=("compras", "vtas", "vtas_anc", "vtas_py", "vtas_ext", "cortesias"),
    measures=("compras", "vtas", "vtas_anc", "vtas_py", "vtas_ext", "cortesias"),
    total=("vtas", "vtas_anc", "vtas_py", "vtas_ext"),
    apart=("cortesias",),
)
# Unit B, ingredients: by name, which the counts carry in upper case already; everything that leaves is in the total.
INGREDIENTS_B = Area(
    key="producto",
    carry=(),
    upper=False,
    flows=("compras", "vtas", "vtas_anc", "vtas_py", "cortesias", "salidas"),
    measures=("compras", "vtas", "vtas_anc", "vtas_py", "cortesias", "salidas"),
    total=("vtas", "vtas_anc", "vtas_py", "cortesias", "salidas"),
)


def area_flow_days(
    flows: dict[str, DataFrame], area: Area, counted_on: tuple[date, date] | None = None
) -> DataFrame:
    """Flow days of an area. `counted_on` are its first and last count date: no period takes in more
    than the days after the first and up to the end of the period the last one opens."""
    if set(flows) != set(area.flows):
        raise ValueError(f"this area takes the flows {area.flows}, not {tuple(flows)}")
    between = None
    if counted_on is not None:
        first, last = counted_on
        between = (first + timedelta(days=1), last + timedelta(days=OPEN_DAYS))
    return flow_days(flows, area.counted, between)


def reconcile_periods(periods: DataFrame, days: DataFrame, area: Area, counts: DataFrame | None = None) -> DataFrame:
    """One row per period: opening, flows, expected stock, closing count and difference.

    `counts` are what the periods were made of; their items' spellings cost less to read than the periods'.
    """
    summed = sum_over_periods(periods, days, area.key, area.upper, counts)
    ids = [area.key, *area.carry]
    base = summed.select(*ids, "fecha_inicio", "fecha_cierre", "inv_inicial", "cierre", *area.measure_columns())
    total = [area.sold().alias("ventas_totales")] if area.show_total else []
    return base.select(
        *ids,
        period_label(F.col("fecha_cierre")).alias("semana"),
        "fecha_inicio",
        "fecha_cierre",
        "inv_inicial",
        *area.measures,
        *total,
        area.expected().alias("inv_calculado"),
        "cierre",
        (F.col("cierre") - area.expected()).alias("diferencia"),
    )


def labelled(periods: DataFrame) -> DataFrame:
    """Periods with their label: all that the days of a period need of it."""
    return periods.withColumn("semana", period_label(F.col("fecha_cierre")))


def days_of_periods(weekly: DataFrame, as_of: DateLike) -> DataFrame:
    """One row per day of each period, up to `as_of`; a period that has not begun by then has none."""
    first = F.date_add("fecha_inicio", 1)
    last = F.least(F.col("fecha_cierre"), as_date(as_of))
    # `sequence` raises on a descending range, and the filter may run after it: bound it in place as well.
    return weekly.filter(first <= last).withColumn("fecha", F.explode(F.sequence(first, F.greatest(first, last))))


def reconcile_days(
    weekly: DataFrame, days: DataFrame, area: Area, as_of: DateLike, shown: Sequence[str] = (), counts: DataFrame | None = None
) -> DataFrame:
    """Daily breakdown with a running expected stock, up to `as_of`; a period that has not begun by then has no days.

    First day shows the opening, last day the closing count; the difference is on the last day only.
    The running sum is per (name, period), so its windows are as short as a period; periods are dealt by
    both before they are taken apart into days. `counts` are as in `reconcile_periods`.
    """
    keep = list(dict.fromkeys([area.key, *area.carry, "semana", "fecha_inicio", "fecha_cierre", "inv_inicial", "cierre"]))
    first = F.date_add("fecha_inicio", 1)
    last = F.least(F.col("fecha_cierre"), as_date(as_of))
    begun = days_in_periods(weekly.select(*keep).filter(first <= last), days, area.key, area.upper, counts)
    begun = spread(begun, ["producto", "semana"], LINE_BYTES)
    flow = F.try_element_at("_flows", F.col("fecha")).alias("_flow")
    dated = days_of_periods(begun, as_of).select(*keep, "fecha", flow)
    detail = dated.select(*keep, "fecha", "_flow.*").select(*keep, "fecha", *area.measure_columns())
    running = (
        Window.partitionBy("producto", "semana")
        .orderBy("fecha", area.key, "fecha_inicio")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    is_first = F.col("fecha") == F.date_add("fecha_inicio", 1)
    is_last = F.col("fecha") == F.col("fecha_cierre")
    stock = detail.withColumn("inv_dia_esperado", F.col("inv_inicial") + F.sum(area.net()).over(running))
    return stock.select(
        *(shown or [c for c in dict.fromkeys(["producto", *area.carry]) if c in keep]),
        "semana",
        "fecha",
        weekday_abbr(F.col("fecha")).alias("dia"),
        *area.measures,
        "inv_dia_esperado",
        F.when(is_first, F.col("inv_inicial")).when(is_last, F.col("cierre")).alias("inv_ini_fin"),
        F.when(is_last, F.col("cierre") - F.col("inv_dia_esperado")).alias("diferencia"),
    )
