"""Named queries over the driver tables: every dataset, operator, report, reader and writer.

Each takes (spark, folder). Doubles are rounded to four decimals so that results can be compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarbook import fixed_values as fixed
from cellarbook.functions import dates, numbers, text
from cellarbook.operators import flows, periods, pivot, pnl, reconcile, recipes
from cellarbook.plans import quality, reports, warehouse
from cellarbook.plans.bindings import AS_OF, SITE, landed
from cellarbook.plans.bindings import warehouse as bound
from cellarbook.session import scratch_path
from cellarbook.sources import readers, schemas, sinks
from cellarbook.sources.landing import INVOICES, Landing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
A, B = SITE.a, SITE.b
REPORT_YEAR = 2024
PERIOD = "2024.03.03"


def settle(df: DataFrame) -> DataFrame:
    """Round doubles to four decimals; NaN and infinities stay what they are, and -0.0 becomes 0.0.

    Sums added up in another order differ in their last bits. The ninth decimal is settled first, so that a
    value right between two results does not fall to either side because of that.
    """

    def shown(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(F.round(c, 9), 4) + F.lit(0.0)).alias(field.name)
        return c

    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str):
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, folder: settle(build(spark, folder))
        return build

    return register


def _register_gold() -> None:
    constants = ("dim_min_max_porciones", "dim_insumo_{b}", "dim_orden_eerr")

    def make(table: str) -> Query:
        return lambda spark, folder: settle(bound(spark, folder)[table])

    for name in warehouse._BUILDERS:
        if name not in constants:
            QUERIES["gold_" + name.format(a="a", b="b")] = make(name.format(a=A, b=B))


_register_gold()


# ---- constants, each against the tables it describes ------------------------


@query("gold_dim_min_max_porciones")
def stock_against_limits(spark, folder):
    names = F.array(*[F.lit(row[0]) for row in fixed.MIN_MAX_PORTIONS])
    size = len(fixed.MIN_MAX_PORTIONS)
    stock = landed(spark, folder)["part"].select(
        F.element_at(names, (F.pmod("p_partkey", F.lit(size)) + 1).cast("int")).alias("insumo"), "p_size"
    )
    limits = bound(spark, folder)["dim_min_max_porciones"]
    return (
        stock.join(F.broadcast(limits), "insumo")
        .groupBy("insumo", "min_porc", "max_porc")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("p_size") < F.col("min_porc")).alias("bajo"),
            F.count_if(F.col("p_size") > F.col("max_porc")).alias("sobre"),
        )
    )


@query("gold_dim_insumo_b")
def sales_of_ingredients(spark, folder):
    w = bound(spark, folder)
    codes = w.gold("dim_insumo_{b}").withColumnRenamed("cod_producto", "codigo_inventario")
    lines = w["fct_ventas_items"].join(F.broadcast(codes), "codigo_inventario")
    return lines.groupBy("insumo", "codigo_inventario").agg(
        F.sum("cantidad").alias("cantidad"), F.count(F.lit(1)).alias("n")
    )


@query("gold_dim_orden_eerr")
def expenses_by_group(spark, folder):
    w = bound(spark, folder)
    lines = w["dim_orden_eerr"].select("categoria", "grupo_eerr", "orden")
    sums = w["fct_gastos_compilados"].groupBy("categoria").agg(F.sum("bs").alias("bs"))
    return sums.join(F.broadcast(lines), "categoria").select("orden", "grupo_eerr", "categoria", "bs")


# ---- composite operators ----------------------------------------------------


def _drink_counts(spark, folder):
    return bound(spark, folder)["fct_inventario_fisico"]


PERIOD_SHOWN = ("producto", "categoria", "fecha_inicio", "fecha_cierre", "inv_inicial", "cierre")


@query("rule_count_periods_closed")
def closed(spark, folder):
    return periods.closed_periods(_drink_counts(spark, folder), "producto", ["categoria"]).select(*PERIOD_SHOWN)


@query("rule_count_periods_open")
def open_(spark, folder):
    return periods.open_periods(_drink_counts(spark, folder), "producto", ["categoria"]).select(*PERIOD_SHOWN)


@query("rule_counts_averaged")
def averaged(spark, folder):
    return periods.average_counts(bound(spark, folder).gold("fct_inventario_{b}"), ["cod_producto", "producto"])


@query("rule_interval_flow_sums")
def interval_sums(spark, folder):
    w = bound(spark, folder)
    made = periods.count_periods(w["fct_inventario_fisico"], "producto", ["categoria"])
    days = flows.flow_days({"compras": flows.flow_rows(w.gold("fct_compras_insumos_{a}"), F.upper("producto"))})
    return flows.sum_over_periods(made, days, "producto", upper=True).select(
        *PERIOD_SHOWN, numbers.or_zero(F.col("compras")).alias("compras")
    )


@query("rule_complimentary_when_moved")
def complimentary_a(spark, folder):
    return bound(spark, folder).gold("fct_reconciliacion_bebidas_{a}").select(
        "producto", "categoria", "semana", "fecha_inicio", "cierre", "ventas", "cortesias"
    )


@query("rule_complimentary_internal")
def complimentary_b(spark, folder):
    w = bound(spark, folder)
    days = flows.flow_days({"cortesias": flows.flow_rows(w.gold("fct_mov_inv_{b}"), "codigo_inventario")})
    return days.select(F.col(flows.KEY).alias("codigo_inventario"), flows.DAY, "cortesias")


@query("rule_day_expansion")
def day_expansion(spark, folder):
    weekly = bound(spark, folder).gold("fct_reconciliacion_insumos_{a}")
    days = reconcile.days_of_periods(weekly, AS_OF)
    return days.groupBy("semana", "fecha_inicio", "fecha_cierre").agg(
        F.count(F.lit(1)).alias("filas"), F.min("fecha").alias("primero"), F.max("fecha").alias("ultimo")
    )


@query("rule_same_day_flow_sums")
def same_day(spark, folder):
    w = bound(spark, folder)
    weekly = w.gold("fct_reconciliacion_insumos_{b}").select("producto", "fecha_inicio", "fecha_cierre", "cierre")
    days = flows.flow_days(
        {"salidas": flows.flow_rows(w.gold("fct_salidas_mermas_{b}"), F.upper("producto"), "porciones")}
    )
    dated = flows.on_same_day(reconcile.days_of_periods(weekly, AS_OF), days, "producto", upper=False)
    return dated.select("producto", "fecha", "fecha_cierre", "cierre", numbers.or_zero(F.col("salidas")).alias("salidas"))


@query("rule_item_factors")
def item_factors(spark, folder):
    w = bound(spark, folder)
    own = warehouse._own_sales(w).select(F.lit("own").alias("canal"), "codigo_inventario", "cantidad")
    other = warehouse._other_unit_sales(w).select(F.lit("other").alias("canal"), "codigo_inventario", "cantidad")
    return own.unionByName(other).groupBy("canal", "codigo_inventario").agg(F.sum("cantidad").alias("unidades"))


@query("rule_portion_fallback")
def portion_fallback(spark, folder):
    w = bound(spark, folder)
    mean = w.gold("dim_promedio_peso_porcion_{a}")
    bought = w.gold("fct_compras_insumos_{a}").select("producto", "porciones", "peso_real")
    joined = warehouse.join_side(bought, mean, ["producto"], "left")
    served, weight, unit = F.col("porciones"), F.col("peso_real"), F.col("promedio_peso_x_porcion")
    return joined.groupBy("producto").agg(
        F.sum(recipes.portions(served, weight, unit, whole=True)).alias("enteras"),
        F.sum(recipes.portions(served, weight, unit, whole=False)).alias("exactas"),
    )


@query("rule_code_fallback")
def code_fallback(spark, folder):
    w = bound(spark, folder)
    codes = w.item_names().select(F.col("producto").alias("producto2"), "cod_producto")
    added = flows.per_day(w.gold("fct_extras_izi_{b}"), ["producto2", "value"]).join(codes, "producto2", "left")
    return added.groupBy(F.coalesce("cod_producto", "value").alias("codigo")).agg(
        F.sum("cantidad").alias("cantidad"), F.sum("_rows").alias("n")
    )


@query("rule_all_units_total")
def all_units(spark, folder):
    rows = bound(spark, folder)["fct_estados_resultados"].filter("calculos_eerr = 0")
    is_all = F.col("negocio") == fixed.PNL_ALL_UNITS
    return rows.groupBy("categoria").agg(
        F.sum(F.when(is_all, F.col("monto"))).alias("todos"), F.sum(F.when(~is_all, F.col("monto"))).alias("por_negocio")
    )


@query("rule_dense_grid")
def dense_grid(spark, folder):
    rows = bound(spark, folder)["fct_estados_resultados"]
    return rows.groupBy("periodo", "negocio").agg(
        F.count(F.lit(1)).alias("lineas"), F.count_if(F.col("monto") == 0).alias("vacias")
    )


@query("rule_trimmed_mean")
def trimmed(spark, folder):
    """Trimmed mean over a whole fact: price per unit of each supplier without outliers."""
    lines = landed(spark, folder)["lineitem"].select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return recipes.trimmed_mean(lines, "l_suppkey", "p", "precio_medio")


# ---- reports ----------------------------------------------------------------


def _area_tables(spark, folder, name):
    table, area, categories, measure = reports.AREAS[name]
    w = bound(spark, folder)
    weekly = table.format(a=A, b=B)
    return w[weekly], w[weekly + "_diario"], area, categories, measure


def _register_area_reports() -> None:
    def weekly(name):
        def build(spark, folder):
            rows, _, area, categories, _ = _area_tables(spark, folder, name)
            return reports.weekly_report(rows, area, categories)

        return build

    def daily(name):
        def build(spark, folder):
            _, rows, area, categories, _ = _area_tables(spark, folder, name)
            return reports.daily_report(rows, area, categories)

        return build

    def sales(name):
        def build(spark, folder):
            rows, _, area, categories, measure = _area_tables(spark, folder, name)
            latest = reports.latest_of(bound(spark, folder), reports.AREAS[name][0], area)
            return reports.period_sales(rows, measure, categories, latest=latest)

        return build

    def card(name):
        def build(spark, folder):
            rows, _, area, categories, _ = _area_tables(spark, folder, name)
            return reports.weekly_report(rows, area, categories, PERIOD, different=True, card=True)

        return build

    def daily_card(name):
        def build(spark, folder):
            rows, days, area, categories, _ = _area_tables(spark, folder, name)
            return reports.daily_card(days, rows, area, categories, PERIOD)

        return build

    for name in reports.AREAS:
        query(f"report_weekly_{name}")(weekly(name))
        query(f"report_daily_{name}")(daily(name))
        query(f"report_period_sales_{name}")(sales(name))
        query(f"card_weekly_different_{name}")(card(name))
        query(f"card_daily_{name}")(daily_card(name))


_register_area_reports()


@query("card_period_sales_total")
def period_sales_total(spark, folder):
    weekly, _, area, categories, measure = _area_tables(spark, folder, "bebidas")
    latest = reports.latest_of(bound(spark, folder), reports.AREAS["bebidas"][0], area)
    return reports.period_sales(weekly, measure, categories, by_item=False, latest=latest)


@query("card_weekly_dash_text")
def card_dash(spark, folder):
    weekly, _, area, categories, _ = _area_tables(spark, folder, "bebidas")
    # Running periods included: they are what the dash is for.
    rows = weekly.filter(F.col("categoria").isin(*categories)).select("semana", *reports.weekly_columns(area, card=True))
    return reports.card_display(rows)


@query("report_filtered_keep_unknown")
def filtered(spark, folder):
    _, daily, area, categories, _ = _area_tables(spark, folder, "bebidas")
    return reports.daily_report(daily, area, categories, period=PERIOD, different=True)


@query("report_weekly_display")
def display(spark, folder):
    weekly, _, area, categories, _ = _area_tables(spark, folder, "vinos")
    return reports.display(weekly.filter(F.col("categoria").isin(*categories)).select(*reports.weekly_columns(area)))


@query("report_exceptions_a")
def exceptions_a(spark, folder):
    return reports.exceptions_a(bound(spark, folder), SITE)


@query("report_exceptions_b")
def exceptions_b(spark, folder):
    return reports.exceptions_b(bound(spark, folder), SITE)


@query("report_exceptions_of_period")
def exceptions_of_period(spark, folder):
    rows = reports.exceptions_a(bound(spark, folder), SITE, PERIOD)
    return rows.withColumn("diferencia", numbers.round_half_even(F.col("diferencia")))


@query("report_difference_flag")
def difference_flag(spark, folder):
    weekly, _, area, _, _ = _area_tables(spark, folder, "b_bebidas")
    flagged = sinks.with_difference_flag(weekly.select("cod_producto", "fecha_inicio", *reports.weekly_columns(area)))
    return flagged.withColumn("has_diff", F.col("has_diff").cast("string"))


@query("report_periods_latest_first")
def periods_latest_first(spark, folder):
    return reports.periods_latest_first(_area_tables(spark, folder, "bebidas")[0])


@query("report_latest_complete_period")
def latest_complete(spark, folder):
    w = bound(spark, folder)
    return reports.latest_complete_period(
        [w[f"fct_reconciliacion_{kind}_{unit}"] for kind in ("bebidas", "insumos") for unit in (A, B)]
    )


@query("report_item_options")
def item_options(spark, folder):
    return reports.options(_area_tables(spark, folder, "insumos")[0], "producto")


@query("report_sizes")
def report_sizes(spark, folder):
    """Rows of every report that is loaded for the stock, sales and finance pages.

    The weekly tables are stored once, and with them the flow days, for all reports that read them.
    """
    w = warehouse.Warehouse(spark, landed(spark, folder), AS_OF, SITE)
    w.rebuild(scratch_path(spark, "reported"), [table.format(a=A, b=B) for table, *_ in reports.AREAS.values()])
    loaded = {**reports.load_all(w, SITE), **reports.load_finance(w)}
    flat = {}
    for name, part in loaded.items():
        flat |= {f"{name}.{k}": df for k, df in part.items()} if isinstance(part, dict) else {name: part}
    counts = [df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(n).alias("reporte"), "filas") for n, df in flat.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def _cube(spark, folder):
    w = bound(spark, folder)
    return reports.sales_cube(w["fct_ventas_items"], w["dim_producto"])


UNITS = (SITE.unit_a, SITE.unit_b)


@query("sales_cube")
def cube(spark, folder):
    return _cube(spark, folder)


@query("sales_pivot_sum")
def pivot_sum(spark, folder):
    return pivot.sales_pivot(_cube(spark, folder), ["semana_anio", "categoria"], "ventas_bs", UNITS)


@query("sales_pivot_quantity_by_item")
def pivot_items(spark, folder):
    return pivot.sales_pivot(_cube(spark, folder), ["producto", "cod_prod", "anio"], "cantidad", UNITS)


@query("sales_pivot_per_day")
def pivot_per_day(spark, folder):
    return pivot.sales_pivot(_cube(spark, folder), ["mes", "categoria"], "ventas_x_dia", UNITS)


@query("sales_pivot_weekday_order")
def pivot_weekday(spark, folder):
    wide = pivot.sales_pivot(_cube(spark, folder), ["dia_semana", "anio"], "ventas_bs", UNITS)
    return pivot.in_pivot_order(wide).withColumn("orden_dia", dates.weekday_order(F.col("dia_semana")).cast("bigint"))


@query("sales_pivot_one_unit")
def pivot_one(spark, folder):
    rows = pivot.filter_sales(
        _cube(spark, folder), [SITE.unit_b], start="2022-01-01", end="2024-06-30", categories=["AGUAS", "GASEOSAS", "1. Burgers"]
    )
    return pivot.sales_pivot(rows, ["anio"], "ventas_bs", [SITE.unit_b])


@query("sales_filtered")
def sales_filtered(spark, folder):
    return pivot.filter_sales(_cube(spark, folder), UNITS, weeks=[202401, 202402, 202310], items=[])


@query("sales_no_unit_selected")
def sales_no_unit(spark, folder):
    return pivot.filter_sales(_cube(spark, folder), [])


def _month_pivot(spark, folder, **how):
    return pnl.month_pivot(bound(spark, folder)["fct_estados_resultados"], AS_OF, **how)


def _as_doubles(wide: DataFrame) -> DataFrame:
    """Amounts of a month pivot as doubles: a month without rows is NULL, and NULL whole numbers compare badly."""
    amounts = {c: F.col(c).cast("double") for c in (*pnl.MONTH_COLUMNS, "total")}
    return wide.withColumns(amounts)


@query("pnl_month_pivot")
def month_pivot(spark, folder):
    return _as_doubles(_month_pivot(spark, folder))


@query("pnl_current_year")
def current_year(spark, folder):
    return _as_doubles(_month_pivot(spark, folder, units=[fixed.PNL_ALL_UNITS], years=[REPORT_YEAR]))


@query("pnl_without_line")
def without_line(spark, folder):
    return _as_doubles(pnl.without_line(_month_pivot(spark, folder)))


@query("pnl_group_rollup")
def group_rollup(spark, folder):
    rows = _month_pivot(spark, folder, years=[2023])
    return _as_doubles(pnl.group_rollup(rows, expanded=["Salarios", "Costos", "EBITDA"]))


@query("pnl_read")
def pnl_read(spark, folder):
    return reports.load_finance(bound(spark, folder))["estados_resultados"]


# ---- checks -----------------------------------------------------------------


@query("check_unmapped_categories")
def unmapped(spark, folder):
    return pnl.unmapped_categories(bound(spark, folder)["fct_gastos_compilados"])


@query("check_unmatched_lines")
def unmatched(spark, folder):
    w = bound(spark, folder)
    return quality.unmatched_lines(w["fct_ventas_items"], w["dim_producto"])


@query("check_repeated_keys")
def repeated(spark, folder):
    return quality.repeated_keys(bound(spark, folder).gold("dim_receta_{a}"), "insumo")


@query("check_rejected_dates")
def rejected(spark, folder):
    raw = landed(spark, folder)
    day, portion = F.col("Fecha"), F.col("`Fecha Porcion`")
    return quality.rejected_dates(
        {
            "compras": (raw[f"compras_insumos_{A}"], portion, dates.month_name_date(portion)),
            "extras": (raw["pedidosya_ventas_extras"], day, dates.slash_date(day)),
            "salidas": (raw[f"salidas_mermas_{A}"], day, dates.month_name_date(day)),
        }
    )


# ---- scalar functions -------------------------------------------------------


@query("fn_text")
def text_functions(spark, folder):
    parts = landed(spark, folder)["part"].select(
        "p_partkey", F.concat(F.upper("p_name"), F.lit("-2x1 o'neil "), F.lower("p_brand")).alias("t")
    )
    t = F.col("t")
    return parts.select(
        "p_partkey",
        text.title_case(t).alias("titulo"),
        text.normal_item_name(t).alias("normal"),
        text.item_category(t).alias("categoria"),
        text.unit_name(F.concat(F.lit(" "), F.upper(F.lit(SITE.b)), F.lit(" ")), SITE).alias("negocio"),
        text.contains_ci(t, "widget").alias("tiene"),
    )


@query("fn_dates")
def date_functions(spark, folder):
    orders = landed(spark, folder)["orders"].select("o_orderkey", "o_orderdate", F.col("o_orderdate").cast("date").alias("d"))
    d = F.col("d")
    return orders.select(
        "o_orderkey",
        dates.month_name_date(F.date_format(d, "d-MMM-yyyy")).alias("con_mes"),
        dates.slash_date(F.date_format(d, "dd/MM/yyyy")).alias("con_barra"),
        dates.business_date(F.col("o_orderdate"), fixed.BUSINESS_DAY_SHIFT_HOURS).alias("dia_comercial"),
        dates.iso_year_week(d).alias("semana_iso"),
        dates.period_label(d).alias("periodo"),
        dates.weekday_abbr(d).alias("dia"),
        F.trunc(d, "month").alias("mes"),
    )


@query("fn_numbers")
def number_functions(spark, folder):
    lines = landed(spark, folder)["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    price = F.format_number("l_extendedprice", 2)
    return lines.groupBy("l_linenumber").agg(
        F.sum(numbers.thousands_number(price)).alias("miles"),
        F.sum(numbers.decimal_comma_number(F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(",")))).alias("coma"),
        F.sum(numbers.count_cell(F.concat(F.lit("-"), F.col("l_quantity").cast("string")))).alias("conteo"),
        F.sum(
            numbers.gross_quantity(
                F.col("l_quantity"), numbers.percent_fraction(F.concat((F.col("l_linenumber") * 10).cast("string"), F.lit("%")))
            )
        ).alias("bruto"),
        F.sum(numbers.round_half_even(F.col("l_quantity") / 2)).alias("par"),
        F.max(numbers.dash_text(F.nullif(F.col("l_quantity"), F.lit(50.0)))).alias("texto"),
    )


# ---- readers and writers ----------------------------------------------------

_ITEM_COLUMNS = ["Cod", "Producto", "Cantidad", "Nota"]


SHEET_FILES = 4
DOCUMENT_RECORDS = 100_000  # of one JSON document, about
COMPRESSED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _write_lines(documents: DataFrame, path: str) -> None:
    """JSON lines, compressed: names take most of a line. No task reads part of such a file, so files are short."""
    documents.write.options(**COMPRESSED, maxRecordsPerFile=DOCUMENT_RECORDS).json(path)


@query("source_invoice_json")
def invoice_json(spark, folder):
    """Nested documents written as JSON lines by Spark and read through the invoice reader."""
    path = scratch_path(spark, "invoices")
    _write_lines(landed(spark, folder)["invoice_documents"], path)
    invoices = readers.read_invoices(spark, [path], SITE, lines=True)
    items = invoices.select("_negocio", "anulada", F.explode("listaItems").alias("i"))
    return items.groupBy(F.col("_negocio").alias("negocio"), "anulada", F.col("i.articulo").alias("producto")).agg(
        F.sum("i.cantidad").alias("cantidad"), F.sum("i.precioTotal").alias("precio_total"), F.count(F.lit(1)).alias("n")
    )


def _as_documents(size: int, opening: str, closing: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of documents with so many records each, one after another; a task's last one may have fewer."""

    def lines(batches):
        n = 0
        for batch in batches:
            values, done, out = batch.column("value"), 0, []
            while done < len(values):
                part = values.slice(done, size - n)
                after = pc.binary_join_element_wise(",", part, "")
                out += [after] if n else [pa.array([opening], part.type), part.slice(0, 1), after.slice(1)]
                n, done = n + len(part), done + len(part)
                if n == size:
                    out.append(pa.array([closing], part.type))
                    n = 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out)], ["value"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([closing], pa.string())], ["value"])

    return lines


def _write_documents(records: DataFrame, path: str, opening: str, closing: str, **options: str) -> None:
    """Each record's text in one of several JSON documents, whose arrays hold them; more records, more documents.

    Tasks that read several documents' worth write them as they are, without a shuffle.
    """
    tasks = records.groupBy(F.spark_partition_id()).count().agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).head()
    if tasks[1] > SHEET_FILES * DOCUMENT_RECORDS * tasks[0]:
        made = records.mapInArrow(_as_documents(DOCUMENT_RECORDS, opening, closing), "value string")
        made.write.options(**options, maxRecordsPerFile=DOCUMENT_RECORDS + 2).text(path)
        return
    many = max(SHEET_FILES, -(-tasks[1] // DOCUMENT_RECORDS))
    dealt = records.select(F.pmod(F.xxhash64("value"), F.lit(many)).alias("_file"), F.lit(1).alias("_at"), "value")
    files = records.sparkSession.range(many).withColumnRenamed("id", "_file")
    ends = [files.select("_file", F.lit(at).alias("_at"), F.lit(text).alias("value")) for at, text in ((0, opening), (2, closing))]
    lines = dealt.unionByName(ends[0]).unionByName(ends[1]).repartition(many, "_file")
    # The opening is a document's first line. Which record follows is left open; one task places and writes them.
    place = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    comma = F.when((F.col("_at") == 1) & (place > 2), ",").otherwise("")
    lines = lines.select("_file", F.concat(comma, "value").alias("value"))
    lines.write.options(**options).partitionBy("_file").text(path)


@query("source_invoice_documents")
def invoice_documents(spark, folder):
    """The same invoices as documents of one array each, read in parts."""
    path = scratch_path(spark, "documents")
    bills = landed(spark, folder)["invoice_documents"].select(F.explode("facturas").alias("f"))
    _write_documents(bills.select(F.to_json("f").alias("value")), path, '{"version": [1], "facturas": [', "]}", **COMPRESSED)
    items = readers.read_invoices(spark, [path], SITE).select("_negocio", "anulada", F.explode("listaItems").alias("i"))
    return items.groupBy(F.col("_negocio").alias("negocio"), "anulada", F.col("i.articulo").alias("producto")).agg(
        F.sum("i.cantidad").alias("cantidad"), F.sum("i.precioTotal").alias("precio_total"), F.count(F.lit(1)).alias("n")
    )


@query("source_json_array")
def json_array(spark, folder):
    """Item master as JSON arrays, some records no JSON; read in parts."""
    path = scratch_path(spark, "items")
    master = landed(spark, folder)["izi_items_inventario"]
    whole = F.to_json(F.struct(*master.columns))
    value = F.when(F.col("codigo").startswith("I"), F.concat(F.lit('{"codigo": '), "codigo", F.lit("}"))).otherwise(whole)
    _write_documents(master.select(value.alias("value")), path, "[", "]", **COMPRESSED)
    read = readers.read_json_array(spark, path, schemas.ITEM_MASTER)
    return read.select(F.coalesce("categoria.nombre", F.lit("?")).alias("categoria"), "precioUnitario").groupBy("categoria").agg(
        F.count(F.lit(1)).alias("n"), F.sum("precioUnitario").alias("precio")
    )


@query("source_json_bad_records")
def json_bad_records(spark, folder):
    """Item master as JSON lines, some cut short; what does not parse is told apart, not lost."""
    path = scratch_path(spark, "items")
    master = landed(spark, folder)["izi_items_inventario"]
    line = F.to_json(F.struct(*master.columns))
    master.select(F.when(F.col("codigo").startswith("I"), F.substring(line, 1, 10)).otherwise(line).alias("value")).write.text(path)
    read = readers.read_json_array(spark, path, schemas.ITEM_MASTER, lines=True)
    return read.select(F.coalesce("categoria.nombre", F.lit("?")).alias("categoria"), "precioUnitario").groupBy("categoria").agg(
        F.count(F.lit(1)).alias("n"), F.sum("precioUnitario").alias("precio")
    )


def _item_sheet(spark, folder) -> DataFrame:
    parts = landed(spark, folder)["part"]
    return parts.select(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("Cod"),
        F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand")).alias("Producto"),
        F.when(F.pmod("p_partkey", F.lit(10)) == 0, "-").otherwise(F.col("p_size").cast("string")).alias("Cantidad"),
        F.lit(None).cast("string").alias("Nota"),
    )


def _typed_sheet(sheet: DataFrame) -> DataFrame:
    return sheet.select(
        F.col("Cod").alias("cod"), F.col("Producto").alias("producto"), numbers.to_double(F.col("Cantidad")).alias("cantidad"), F.col("Nota").alias("nota")
    )


@query("source_csv_sheet")
def csv_sheet(spark, folder):
    path = scratch_path(spark, "sheet")
    _item_sheet(spark, folder).write.option("header", True).csv(path)
    return _typed_sheet(readers.read_csv(spark, path, _ITEM_COLUMNS))


def _stacked_lines(sheet: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """Text of several sheets, told apart by `_file`: lines before, header, rows, lines after."""
    cells = [F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("")) for c in sheet.columns]
    head = F.array(*[F.lit(x) for x in [*before, ",".join(sheet.columns)]])
    tail = F.array(*[F.lit(x) for x in after]) if after else F.array().cast("array<string>")
    numbered = sheet.select(F.concat_ws(",", *cells).alias("value"), F.pmod(F.xxhash64("Cod"), F.lit(SHEET_FILES)).alias("_file"))
    files = sheet.sparkSession.range(SHEET_FILES).withColumnRenamed("id", "_file")
    first = files.select("_file", F.lit(0).alias("_at"), F.posexplode(head).alias("_n", "value"))
    last = files.select("_file", F.lit(2).alias("_at"), F.posexplode(tail).alias("_n", "value"))
    body = numbered.select("_file", F.lit(1).alias("_at"), F.lit(0).alias("_n"), "value")
    return first.unionByName(body).unionByName(last)


def _write_sheets(spark, folder, name: str, before: list[str], after: list[str]) -> str:
    path = scratch_path(spark, name)
    lines = _stacked_lines(_item_sheet(spark, folder), before, after)
    # One sheet is one folder with one file, however the rows were dealt out.
    lines = lines.repartition("_file").sortWithinPartitions("_file", "_at", "_n").select("_file", "value")
    lines.write.partitionBy("_file").text(path)
    return path


@query("source_csv_skip_rows")
def csv_skip_rows(spark, folder):
    path = _write_sheets(spark, folder, "skip", ["exported by hand,,,"], [])
    return _typed_sheet(readers.read_csv(spark, path, _ITEM_COLUMNS, skip=1))


def _broken_sheets(spark, folder, name: str) -> str:
    """Items with quotes and line breaks in their names, in sheets whose columns stand in different orders."""
    items = _item_sheet(spark, folder).select(
        "Cod", F.concat(F.lit('12" '), "Producto", F.lit('\n"'), "Cod", F.lit('"')).alias("Producto"), "Cantidad"
    )

    def quoted(c: str):
        return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))

    orders = (["Cod", "Producto", "Cantidad"], ["Cantidad", "Cod", "Producto"], ["Producto", "Cod"])
    lines = None
    for i, columns in enumerate(orders):
        rows = items.filter(F.substring("Cod", 2, 20).cast("long") % len(orders) == i)
        body = rows.select(F.lit(i).alias("_file"), F.lit(2).alias("_at"), F.concat_ws(",", *map(quoted, columns)).alias("value"))
        head = spark.createDataFrame([(i, 0, '"exported\nby hand",,'), (i, 1, ",".join(columns))], "_file int, _at int, value string")
        lines = head.unionByName(body) if lines is None else lines.unionByName(head).unionByName(body)
    path = scratch_path(spark, name)
    lines.repartition("_file").sortWithinPartitions("_file", "_at").select("_file", "value").write.partitionBy("_file").text(path)
    return path


@query("source_csv_records")
def csv_records(spark, folder):
    """Cells with quotes and line breaks, columns by the header of each file."""
    sheet = readers.read_csv(spark, _broken_sheets(spark, folder, "records"), skip=1)
    return sheet.select(
        F.col("Cod").alias("cod"), F.col("Producto").alias("producto"), (F.col("Cantidad").isNotNull()).alias("contado")
    )


@query("source_first_block")
def first_block(spark, folder):
    after = [",,,", "Cod,Producto,Cantidad,Nota", "Z1,next block,9,"]
    path = _write_sheets(spark, folder, "blocks", ["Estimates,,,", ",,,"], after)
    block = readers.read_first_block(spark, path, _ITEM_COLUMNS, "Cantidad", "Gastos Aproximados")
    return block.select(*[F.col(c).alias(c.lower()) for c in ("Cod", "Producto", "Cantidad", "Cuenta")])


@query("source_first_block_of_events")
def first_block_of_events(spark, folder):
    """Per user: the events after the first signup and before the next error."""
    events = landed(spark, folder)["events"].select("user_id", "event_id", "event_type", "value")
    return readers.first_block(
        events,
        ["user_id"],
        F.col("event_id"),
        F.col("event_type") == "signup",
        F.col("event_type") == "error",
    )


@query("source_landing_folder")
def landing_folder(spark, folder):
    """Sale lines of a warehouse over a landing folder: invoices as JSON lines."""
    path = scratch_path(spark, "landing")
    _write_lines(landed(spark, folder)["invoice_documents"], f"{path}/{INVOICES}.json")
    return warehouse.Warehouse(spark, Landing(spark, path, SITE, lines=True), AS_OF, SITE)["fct_ventas_items"]


@query("source_stored_gold")
def stored_gold(spark, folder):
    """Three months of sale lines of a stored warehouse, opened again after a refresh of another table."""
    path = scratch_path(spark, "stored")
    made = warehouse.Warehouse(spark, landed(spark, folder), AS_OF, SITE)
    for table in ("fct_ventas_items", "dim_producto"):
        made.rebuild(path, only=[table])
    return warehouse.Warehouse.open(spark, path, AS_OF, SITE).between("fct_ventas_items", "2024-01-15", "2024-03-20")


@query("source_union_by_name")
def union_by_name(spark, folder):
    """Inputs whose columns differ, appended by name with NULL for what one lacks."""
    raw = landed(spark, folder)
    both = raw[f"salidas_mermas_{A}"].unionByName(raw[f"salidas_mermas_{B}"], allowMissingColumns=True)
    return both.select(F.col("Producto").alias("producto"), F.col("Peso").alias("peso_a"), F.col("`Peso (g / ml)`").alias("peso_b"))


@query("sink_table_replace")
def table_replace(spark, folder):
    w = bound(spark, folder)
    path = scratch_path(spark, "gold")
    sinks.write_table(w["dim_producto"].limit(0), path)
    return sinks.write_table(w["dim_producto"], path)


@query("sink_view")
def view(spark, folder):
    sinks.create_view(bound(spark, folder)["fct_movimiento_inventario"], "fct_movimiento_inventario")
    return spark.sql("SELECT codigo_inventario, sum(cantidad) AS cantidad FROM fct_movimiento_inventario GROUP BY codigo_inventario")


@query("sink_export_csv")
def export(spark, folder):
    weekly, _, area, categories, _ = _area_tables(spark, folder, "bebidas")
    path = scratch_path(spark, "export")
    report = settle(sinks.with_difference_flag(reports.weekly_report(weekly, area, categories)))
    sinks.export_csv(report, path)
    back = readers.read_csv(spark, path, report.columns)
    return back.select(
        "producto", "semana", numbers.to_double(F.col("cierre")).alias("cierre"), (F.col("has_diff") == "true").alias("has_diff")
    )


@query("sink_table_sample")
def sample(spark, folder):
    """The look at a table's first rows: how many there are, as which ones is not fixed."""
    return sinks.sample_rows(bound(spark, folder)["dim_producto"]).agg(F.count(F.lit(1)).alias("filas"))


@query("sink_table_list")
def table_list(spark, folder):
    sinks.create_view(bound(spark, folder)["dim_producto"], "listed_dim_producto")
    listed = sinks.list_tables(spark).filter(F.col("tableName") == "listed_dim_producto").select(F.col("tableName").alias("tabla"))
    rows = spark.table("listed_dim_producto").agg(F.count(F.lit(1)).alias("filas"))
    return listed.withColumn("filas", rows.scalar())
