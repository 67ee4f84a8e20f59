"""Compile many ledgers into one, and one ledger into a monthly P&L."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarbook.fixed_values import (
    PNL_ALL_UNITS,
    PNL_INCOME_LINE,
    PNL_LEFT_OUT,
    PNL_LINES,
    PNL_LINES_AFTER_OPTIONAL,
    PNL_OPTIONAL_LINE,
)
from cellarbook.functions.dates import DateLike, as_date
from cellarbook.functions.numbers import or_zero, round_half_even
from cellarbook.functions.text import unit_name
from cellarbook.operators.joins import constant_rows
from cellarbook.site import Site

MONTHS = tuple(range(1, 13))
MONTH_COLUMNS = tuple(f"m{m:02d}" for m in MONTHS)


@dataclass(frozen=True)
class Ledger:
    """One expense source. `day`, `amount` and `keep` are SQL expressions over its columns."""

    table: str
    account: str
    day: str
    amount: str
    keep: str | None = None


LEDGER_TEXTS = {
    "categoria": "Categoria",
    "categoria_fc": "Categoria FC",
    "categoria_detalle": "Categoria Detalle",
    "detalle": "Detalle",
    "empresa": "Empresa",
    "fijo_semanal_otros": "Fijo/Semanal/Otros",
}
EXPENSE_COLUMNS = (
    "fecha",
    "categoria",
    "categoria_fc",
    "categoria_detalle",
    "detalle",
    "bs",
    "cuenta",
    "empresa",
    "fijo_semanal_otros",
)


def compile_ledgers(tables: dict[str, DataFrame], ledgers: Sequence[Ledger], first_date: str) -> DataFrame:
    """Bring every source to one schema and append them; filters reach each source's own scan."""

    def one(ledger: Ledger) -> DataFrame:
        source = tables[ledger.table]
        if ledger.keep:
            source = source.filter(ledger.keep)
        return source.select(
            F.expr(ledger.day).cast("date").alias("fecha"),
            *[F.col(f"`{c}`").cast("string").alias(name) for name, c in LEDGER_TEXTS.items()],
            F.expr(ledger.amount).cast("double").alias("bs"),
            F.lit(ledger.account).alias("cuenta"),
        ).select(*EXPENSE_COLUMNS)

    compiled = reduce(DataFrame.unionByName, [one(ledger) for ledger in ledgers])
    return compiled.filter(F.col("fecha") >= F.lit(first_date).cast("date"))


def unmapped_categories(expenses: DataFrame) -> DataFrame:
    """Categories the layout does not show, with what they add up to."""
    lines = [line for _, _, line, _, _ in PNL_LINES]
    other = expenses.filter(~F.col("categoria").isin(*lines, PNL_LEFT_OUT) | F.col("categoria").isNull())
    return other.groupBy("categoria").agg(F.sum("bs").alias("bs"), F.count(F.lit(1)).alias("n"))


def layout(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, PNL_LINES, ["grupo_eerr", "orden_grupo", "categoria", "calculos_eerr", "orden"])


def monthly_pnl(expenses: DataFrame, income: DataFrame, site: Site) -> DataFrame:
    """Month x unit x line, with running subtotals and a unit that stands for all of them.

    Entries are summed to month, category and unit first. Everything after that works on this small
    table: the "all units" rows are added up from it rather than by doubling the ledgers, and each
    (month, unit) becomes one row with a column per line, so the dense grid and the running subtotals
    are plain column arithmetic without a cross join or a window.
    """
    entries = expenses.select("fecha", "categoria", (-F.col("bs")).alias("bs"), F.col("empresa").alias("_unit"))
    entries = entries.unionByName(
        income.select(
            "fecha", F.lit(PNL_INCOME_LINE).alias("categoria"), F.col("total").alias("bs"), F.col("negocio").alias("_unit")
        )
    )
    monthly = (
        entries.filter(F.col("categoria") != PNL_LEFT_OUT)
        .groupBy(F.trunc("fecha", "month").alias("periodo"), "categoria", unit_name(F.col("_unit"), site).alias("negocio"))
        .agg(F.sum("bs").alias("bs"))
    )
    both = monthly.unionByName(monthly.withColumn("negocio", F.lit(PNL_ALL_UNITS)))
    ordered = sorted(PNL_LINES, key=lambda line: line[4])
    wide = both.groupBy("periodo", "negocio").agg(
        *[F.sum(F.when(F.col("categoria") == line[2], F.col("bs"))).alias(f"_{i}") for i, line in enumerate(ordered)]
    )
    # A row without a unit belongs to no unit's lines; it only counts under "all".
    known = F.col("negocio").isNotNull()
    wide = wide.select(
        "periodo", "negocio", *[F.when(known, or_zero(F.col(f"_{i}"))).otherwise(0.0).alias(f"_{i}") for i in range(len(ordered))]
    )
    lines, running = [], None
    for i, (group, _, line, is_subtotal, order) in enumerate(ordered):
        own = F.col(f"_{i}")
        running = own if running is None else running + own
        lines.append(
            F.struct(
                F.lit(order).alias("orden"),
                F.lit(group).alias("grupo_eerr"),
                F.lit(line).alias("categoria"),
                F.lit(is_subtotal).alias("calculos_eerr"),
                (running if is_subtotal else own).alias("monto"),
            )
        )
    return wide.select("periodo", "negocio", F.inline(F.array(*lines)))


def month_pivot(pnl: DataFrame, as_of: DateLike, units: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """Lines x months per year and unit, months rounded half-even, the year being the sum of rounded months.

    Months of the current year that lie after `as_of` are left out.
    """
    today = as_date(as_of)
    rows = pnl.withColumn("anio", F.year("periodo")).withColumn("_month", F.month("periodo"))
    if units is not None:
        rows = rows.filter(F.col("negocio").isin(*units))
    if years is not None:
        rows = rows.filter(F.col("anio").isin(*years))
    rows = rows.filter((F.col("anio") != F.year(today)) | (F.col("_month") <= F.month(today)))
    wide = rows.groupBy("anio", "negocio", "orden", "grupo_eerr", "categoria", "calculos_eerr").agg(
        *[
            F.max(F.when(F.col("_month") == m, round_half_even(F.col("monto")).cast("bigint"))).alias(name)
            for m, name in zip(MONTHS, MONTH_COLUMNS)
        ]
    )
    total = reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0)) for c in MONTH_COLUMNS])
    return wide.withColumn("total", total.cast("bigint"))


def without_line(pivot: DataFrame, line: str = PNL_OPTIONAL_LINE, later: Sequence[str] = PNL_LINES_AFTER_OPTIONAL) -> DataFrame:
    """Leave a line out and take it back from the subtotals after it.

    The window is one year and unit, that is the lines of the layout.
    """
    whole = Window.partitionBy("anio", "negocio")
    amounts = [*MONTH_COLUMNS, "total"]
    left_out = {c: F.max(F.when(F.col("categoria") == line, F.col(c))).over(whole) for c in amounts}
    marked = pivot.select("*", *[left_out[c].alias(f"_out_{c}") for c in amounts])
    adjusted = [
        F.when(F.col("categoria").isin(*later), F.col(c) - F.coalesce(F.col(f"_out_{c}"), F.lit(0)))
        .otherwise(F.col(c))
        .alias(c)
        for c in amounts
    ]
    return marked.filter(F.col("categoria") != line).select(
        "anio", "negocio", "orden", "grupo_eerr", "categoria", "calculos_eerr", *adjusted
    )


def group_rollup(pivot: DataFrame, expanded: Sequence[str] = ()) -> DataFrame:
    """One row per group, being the sum of its lines, and the lines themselves below expanded groups.

    A group of one line keeps that line's subtotal flag; only groups of several lines can be expanded.
    `posicion` puts lines below their group.
    """
    amounts = [*MONTH_COLUMNS, "total"]
    orders = {}
    for group, order, *_ in PNL_LINES:
        orders[group] = order
    group_order = F.element_at(F.create_map(*[F.lit(x) for pair in orders.items() for x in pair]), F.col("grupo_eerr"))
    sums = pivot.groupBy("anio", "negocio", "grupo_eerr").agg(
        *[F.sum(c).alias(c) for c in amounts],
        F.count(F.lit(1)).alias("_lines"),
        F.max("calculos_eerr").alias("_flag"),
    )
    many = F.col("_lines") > 1
    is_open = F.col("grupo_eerr").isin(*expanded) if expanded else F.lit(False)
    groups = sums.select(
        "anio",
        "negocio",
        group_order.alias("orden_grupo"),
        F.lit("").alias("posicion"),
        F.concat(F.when(many & is_open, "▾ ").when(many, "▸ ").otherwise(""), F.col("grupo_eerr")).alias("categoria"),
        F.when(many, F.lit(0)).otherwise(F.col("_flag")).alias("calculos_eerr"),
        many.cast("int").alias("tiene_hijos"),
        F.lit(0).alias("nivel"),
        *amounts,
    )
    if not expanded:
        return groups
    several = [g for g in orders if sum(1 for line in PNL_LINES if line[0] == g) > 1]
    wanted = [g for g in expanded if g in several]
    lines = pivot.filter(F.col("grupo_eerr").isin(*wanted)) if wanted else pivot.filter(F.lit(False))
    counted = lines.withColumn("_lines", F.count(F.lit(1)).over(Window.partitionBy("anio", "negocio", "grupo_eerr")))
    children = counted.filter("_lines > 1").select(
        "anio",
        "negocio",
        group_order.alias("orden_grupo"),
        F.col("orden").alias("posicion"),
        "categoria",
        "calculos_eerr",
        F.lit(0).alias("tiene_hijos"),
        F.lit(1).alias("nivel"),
        *amounts,
    )
    return groups.unionByName(children)
