"""SQL twin of each query in `cellarbook.plans.catalog`."""

from __future__ import annotations

from cellarbook import fixed_values as fixed
from cellarbook.plans import reports
from cellarbook.plans.bindings import AS_OF, SITE
from cellarbook.plans.catalog import PERIOD, REPORT_YEAR
from oracle import gold
from oracle.compose import compose, rounded, settled
from oracle.gold import PARTS, item_text, quoted, titled

A, B, UNIT_A, UNIT_B = SITE.a, SITE.b, SITE.unit_a, SITE.unit_b

DOUBLES = {
    "fct_ventas_items": "cantidad precio_total",
    "dim_producto": "precio_unitario cantidad_stock",
    "fct_movimiento_inventario": "cantidad",
    f"dim_receta_{A}": "cantidad_usada merma_pct porciones cantidad",
    f"fct_consumo_insumos_{A}": "cantidad_vendida factor_receta cantidad_consumida",
    f"fct_salidas_mermas_{A}": "peso porciones",
    "fct_pedidosya_items": "",
    f"fct_compras_insumos_{A}": "porciones peso_real cantidad precio_unitario precio_total",
    f"fct_compras_insumos_{B}": "porciones peso_real peso_porcion cantidad precio_unitario precio_total",
    f"dim_compras_precios_{A}": "cantidad precio_compra",
    "dim_producto_izi": "precio_compra",
    f"fct_ventas_{B}_pedidosya": "",
    "fct_inventario_fisico": "cantidad",
    f"dim_receta_{B}": "cantidad_usada merma_pct cantidad",
    f"fct_inventario_{B}": "cantidad",
    f"fct_inventario_unitarios_{B}": "cantidad",
    "fct_apertura_vinos_copa": "num_botellas",
    f"pesos_platos_{A}": "cantidad",
    f"fct_compras_totales_{A}": "porciones peso_real cantidad precio_unitario precio_total cantidad_plato",
    f"fct_salidas_mermas_{B}": "peso porciones",
    f"fct_mov_inv_{B}": "cantidad",
    f"fct_mov_inv_{B}_todos": "cantidad",
    f"fct_extras_izi_{B}": "cantidad",
    "fct_inventario_insumos_gs": "peso cantidad",
    "fct_inventario_unitarios_gs": "cantidad",
    "dim_relacion_copa_vino": "",
    f"fct_copas_vino_{A}": "cantidad",
    f"dim_promedio_peso_porcion_{A}": "promedio_peso_x_porcion",
    f"fct_consumo_insumos_{A}_todos": "cantidad_vendida factor_receta cantidad_consumida",
    "fct_pedidosya_pedidos": "total_inicial_bs total_bs",
    "fct_ventas_diarias_negocio": "vtas_bs",
    "fct_gastos_compilados": "bs",
    "fct_ingresos_compilados": "total",
    "fct_estados_resultados": "monto",
}
_STOCK = {
    f"fct_reconciliacion_bebidas_{A}": "compras ventas ventas_ext cortesias salidas",
    f"fct_reconciliacion_insumos_{A}": "compras ventas salidas",
    f"fct_reconciliacion_bebidas_{B}": "compras vtas vtas_anc vtas_py vtas_ext cortesias",
    f"fct_reconciliacion_insumos_{B}": "compras vtas vtas_anc vtas_py cortesias salidas",
}
WEEKLY_DOUBLES, DAILY_DOUBLES = {}, {}
for _table, _measures in _STOCK.items():
    _total = "" if _table == f"fct_reconciliacion_insumos_{A}" else " ventas_totales"
    WEEKLY_DOUBLES[_table] = f"inv_inicial {_measures}{_total} inv_calculado cierre diferencia"
    DAILY_DOUBLES[_table] = f"{_measures} inv_dia_esperado inv_ini_fin diferencia"
    DOUBLES[_table] = WEEKLY_DOUBLES[_table]
    DOUBLES[_table + "_diario"] = DAILY_DOUBLES[_table]

SQL: dict[str, str] = {}


def generic(table: str) -> str:
    words = ["a" if w == A else "b" if w == B else w for w in table.split("_")]
    return "_".join(words)


def add(name: str, sql: str) -> None:
    SQL[name] = compose(sql, PARTS)


for _table, _doubles in DOUBLES.items():
    add("gold_" + generic(_table), rounded(_table, _doubles))


def r4(expr: str, name: str) -> str:
    return f"{settled(expr)} AS {name}"


# -- constants against the tables they describe
_limits = ", ".join(f"({i}, '{n}', {lo}, {hi})" for i, (n, lo, hi) in enumerate(fixed.MIN_MAX_PORTIONS))
add(
    "gold_dim_min_max_porciones",
    "SELECT insumo, min_porc, max_porc, count(*) AS n, count(*) FILTER (p_size < min_porc) AS bajo, "
    f"count(*) FILTER (p_size > max_porc) AS sobre FROM part JOIN (VALUES {_limits}) t(i, insumo, min_porc, max_porc) "
    f"ON i = p_partkey % {len(fixed.MIN_MAX_PORTIONS)} GROUP BY ALL",
)
add(
    "gold_dim_insumo_b",
    f"SELECT insumo, codigo_inventario, {r4('sum(cantidad)', 'cantidad')}, count(*) AS n FROM fct_ventas_items "
    f"JOIN dim_insumo_{B} ON cod_producto = codigo_inventario GROUP BY insumo, codigo_inventario",
)
add(
    "gold_dim_orden_eerr",
    f"SELECT orden, grupo_eerr, categoria, {r4('sum(bs)', 'bs')} FROM fct_gastos_compilados JOIN dim_orden_eerr USING (categoria) "
    "GROUP BY orden, grupo_eerr, categoria",
)

# -- rules
_PER = "producto, categoria, fecha_inicio, fecha_cierre"
_COUNT = f"{r4('inv_inicial', 'inv_inicial')}, {r4('cierre', 'cierre')}"
add("rule_count_periods_closed", f"SELECT {_PER}, {_COUNT} FROM drinks_a_periods WHERE cierre IS NOT NULL")
add("rule_count_periods_open", f"SELECT {_PER}, {_COUNT} FROM drinks_a_periods WHERE cierre IS NULL")
add(
    "rule_counts_averaged",
    f"SELECT cod_producto, producto, fecha, {r4('avg(cantidad)', 'cantidad')} FROM fct_inventario_{B} GROUP BY cod_producto, producto, fecha",
)
add(
    "rule_interval_flow_sums",
    f"SELECT {_PER}, {_COUNT}, {r4('coalesce((SELECT sum(c.cantidad) FROM fct_compras_insumos_' + A + ' c WHERE upper(c.producto) = upper(p.producto) AND c.fecha > p.fecha_inicio AND c.fecha <= p.fecha_cierre), 0)', 'compras')} "
    "FROM drinks_a_periods p",
)
add(
    "rule_complimentary_when_moved",
    f"SELECT producto, categoria, semana, fecha_inicio, {r4('cierre', 'cierre')}, {r4('ventas', 'ventas')}, {r4('cortesias', 'cortesias')} "
    f"FROM fct_reconciliacion_bebidas_{A}",
)
add(
    "rule_complimentary_internal",
    f"SELECT codigo_inventario, fecha, {r4('sum(cantidad)', 'cortesias')} FROM fct_mov_inv_{B} GROUP BY codigo_inventario, fecha",
)
add(
    "rule_day_expansion",
    "SELECT strftime(fecha_cierre, '%Y.%m.%d') AS semana, fecha_inicio, fecha_cierre, count(*) AS filas, min(fecha) AS primero, max(fecha) AS ultimo "
    "FROM ingredients_a_days GROUP BY fecha_inicio, fecha_cierre",
)
add(
    "rule_same_day_flow_sums",
    f"SELECT producto, fecha, fecha_cierre, {r4('cierre', 'cierre')}, {r4('salidas', 'salidas')} FROM ingredients_b_day_sums",
)
add(
    "rule_item_factors",
    f"SELECT 'own' AS canal, codigo_inventario, {r4(f'sum({gold.OWN})', 'unidades')} FROM fct_ventas_items WHERE negocio = '{UNIT_B}' "
    f"GROUP BY codigo_inventario UNION ALL SELECT 'other', codigo_inventario, {r4(f'sum({gold.OTHER})', 'unidades')} FROM fct_ventas_items "
    f"WHERE negocio = '{UNIT_A}' GROUP BY codigo_inventario",
)
_BY_WEIGHT = "peso_real / nullif(promedio_peso_x_porcion, 0)"
add(
    "rule_portion_fallback",
    f"SELECT producto, {r4(f'sum(coalesce(porciones, round({_BY_WEIGHT}, 0)))', 'enteras')}, {r4(f'sum(coalesce(porciones, {_BY_WEIGHT}))', 'exactas')} "
    f"FROM fct_compras_insumos_{A} LEFT JOIN dim_promedio_peso_porcion_{A} USING (producto) GROUP BY producto",
)
add(
    "rule_code_fallback",
    f"SELECT coalesce(i.cod_producto, e.value) AS codigo, {r4('sum(e.cantidad)', 'cantidad')}, count(*) AS n FROM fct_extras_izi_{B} e "
    "LEFT JOIN dim_producto_izi i ON i.producto = e.producto2 GROUP BY 1",
)
add(
    "rule_all_units_total",
    "SELECT categoria, " + r4("sum(monto) FILTER (negocio = 'Todos')", "todos") + ", "
    + r4("sum(monto) FILTER (negocio <> 'Todos')", "por_negocio")
    + " FROM fct_estados_resultados WHERE calculos_eerr = 0 GROUP BY categoria",
)
add(
    "rule_dense_grid",
    "SELECT periodo, negocio, count(*) AS lineas, count(*) FILTER (monto = 0) AS vacias FROM fct_estados_resultados GROUP BY periodo, negocio",
)
add(
    "rule_trimmed_mean",
    f"SELECT l_suppkey, {r4('avg(p)', 'precio_medio')} FROM (SELECT l_suppkey, l_extendedprice / l_quantity AS p, "
    "avg(l_extendedprice / l_quantity) OVER s AS m, stddev_pop(l_extendedprice / l_quantity) OVER s AS d FROM lineitem "
    "WINDOW s AS (PARTITION BY l_suppkey)) WHERE abs(p - m) <= 2 * d GROUP BY l_suppkey",
)


# -- reports
def in_categories(categories) -> str:
    return f"categoria IN ({quoted(categories)})" if categories else "TRUE"


for _name, (_t, _area, _cats, _measure) in reports.AREAS.items():
    _table = _t.format(a=A, b=B)
    _measures = _STOCK[_table].split()
    _tot = [] if _table == f"fct_reconciliacion_insumos_{A}" else ["ventas_totales"]
    _numbers = ["inv_inicial", *_measures, *_tot, "inv_calculado", "cierre", "diferencia"]
    _amounts = ", ".join(r4(c, c) for c in _numbers)
    _where = in_categories(_cats)
    add(
        f"report_weekly_{_name}",
        f"SELECT producto, semana, fecha_cierre, {_amounts} FROM {_table} WHERE {_where} AND diferencia IS NOT NULL",
    )
    _daily = [*_measures, "inv_dia_esperado", "inv_ini_fin", "diferencia"]
    _day_amounts = ", ".join(r4(c, c) for c in _daily)
    add(f"report_daily_{_name}", f"SELECT producto, semana, fecha, dia, {_day_amounts} FROM {_table}_diario WHERE {_where}")
    _latest = f"fecha_cierre > (SELECT max(fecha_cierre) FROM {_table}) - INTERVAL 6 WEEKS"
    add(
        f"report_period_sales_{_name}",
        f"SELECT producto, semana, {r4(f'sum({_measure})', 'ventas')} FROM {_table} WHERE {_where} AND {_latest} GROUP BY producto, semana",
    )
    add(
        f"card_weekly_different_{_name}",
        f"SELECT producto, {_amounts} FROM {_table} WHERE {_where} AND semana = '{PERIOD}' AND diferencia <> 0",
    )
    add(
        f"card_daily_{_name}",
        f"SELECT producto, strftime(fecha, '%d.%m.%y') AS fecha, {_day_amounts} FROM {_table}_diario WHERE {_where} AND semana = '{PERIOD}' "
        f"AND producto IN (SELECT producto FROM {_table} WHERE {_where} AND semana = '{PERIOD}' AND diferencia IS NOT NULL)",
    )

_DRINKS = f"fct_reconciliacion_bebidas_{A}"
_BEB, _VIN = in_categories(fixed.DRINK_CATEGORIES), in_categories(fixed.WINE_CATEGORIES)
add(
    "card_period_sales_total",
    f"SELECT semana, {r4('sum(ventas)', 'ventas')} FROM {_DRINKS} WHERE {_BEB} AND fecha_cierre > (SELECT max(fecha_cierre) FROM {_DRINKS}) - INTERVAL 6 WEEKS GROUP BY semana",
)
_plain = ", ".join(r4(c, c) for c in ["inv_inicial", *_STOCK[_DRINKS].split(), "ventas_totales", "diferencia"])
add(
    "card_weekly_dash_text",
    f"SELECT semana, producto, {_plain}, coalesce(CAST(round(round(inv_calculado, 6), 0) AS VARCHAR), '–') AS inv_calculado, "
    f"coalesce(CAST(round(round(cierre, 6), 0) AS VARCHAR), '–') AS cierre FROM {_DRINKS} WHERE {_BEB}",
)
_day = ", ".join(r4(c, c) for c in DAILY_DOUBLES[_DRINKS].split())
add(
    "report_filtered_keep_unknown",
    f"SELECT producto, semana, fecha, dia, {_day} FROM {_DRINKS}_diario WHERE {_BEB} AND semana = '{PERIOD}' AND diferencia IS DISTINCT FROM 0",
)
_even = ", ".join(
    f"round_even(round({c}, 6), 0) + 0.0 AS {c}" for c in ["inv_inicial", *_STOCK[_DRINKS].split(), "ventas_totales", "diferencia"]
)
_dashed = ", ".join(
    f"coalesce(format('{{:,}}', CAST(round_even(round({c}, 6), 0) AS BIGINT)), '–') AS {c}" for c in ("inv_calculado", "cierre")
)
add(
    "report_weekly_display",
    f"SELECT producto, semana, strftime(fecha_cierre, '%Y-%m-%d') AS fecha_cierre, {_even}, {_dashed} FROM {_DRINKS} WHERE {_VIN}",
)


def exceptions(parts: dict[str, str], amount: str, more: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS area, producto, semana, {amount} FROM {rows} AND diferencia <> 0 AND {more}" for label, rows in parts.items()
    )


_PARTS_A = {
    "Bebidas": f"{_DRINKS} WHERE {_BEB}",
    "Vinos": f"{_DRINKS} WHERE {_VIN}",
    "Insumos": f"fct_reconciliacion_insumos_{A} WHERE TRUE",
}
add("report_exceptions_a", exceptions(_PARTS_A, r4("diferencia", "diferencia")))
add(
    "report_exceptions_b",
    exceptions(
        {"Bebidas": f"fct_reconciliacion_bebidas_{B} WHERE TRUE", "Insumos": f"fct_reconciliacion_insumos_{B} WHERE TRUE"},
        r4("diferencia", "diferencia"),
    ),
)
add(
    "report_exceptions_of_period",
    exceptions(_PARTS_A, "round_even(round(diferencia, 6), 0) + 0.0 AS diferencia", f"semana = '{PERIOD}'"),
)
_B_DRINKS = f"fct_reconciliacion_bebidas_{B}"
_flagged = ", ".join(r4(c, c) for c in WEEKLY_DOUBLES[_B_DRINKS].split())
add(
    "report_difference_flag",
    f"SELECT cod_producto, fecha_inicio, producto, semana, fecha_cierre, {_flagged}, CAST(diferencia <> 0 AS VARCHAR) AS has_diff FROM {_B_DRINKS}",
)
add("report_periods_latest_first", f"SELECT DISTINCT semana FROM {_DRINKS} ORDER BY semana DESC")
add(
    "report_latest_complete_period",
    "SELECT max(semana) AS semana FROM ("
    + " UNION ALL ".join(
        f"SELECT semana FROM fct_reconciliacion_{kind}_{unit} WHERE diferencia IS NOT NULL" for kind in ("bebidas", "insumos") for unit in (A, B)
    )
    + ")",
)
add("report_item_options", f"SELECT DISTINCT producto FROM fct_reconciliacion_insumos_{A} WHERE producto IS NOT NULL")

_sizes = []
for _name, (_t, _area, _cats, _measure) in reports.AREAS.items():
    _table, _where = _t.format(a=A, b=B), in_categories(_cats)
    _sizes += [
        f"SELECT '{_name}.weekly' AS reporte, count(*) AS filas FROM {_table} WHERE {_where} AND diferencia IS NOT NULL",
        f"SELECT '{_name}.daily', count(*) FROM {_table}_diario WHERE {_where}",
        f"SELECT '{_name}.sales', count(DISTINCT (producto, semana)) FROM {_table} WHERE {_where} AND fecha_cierre > (SELECT max(fecha_cierre) FROM {_table}) - INTERVAL 6 WEEKS",
    ]
_sizes += [
    f"SELECT 'resumen', count(*) FROM ({exceptions(_PARTS_A, 'diferencia')})",
    "SELECT 'ventas', count(*) FROM sales_cube_rows",
    "SELECT 'estados_resultados', count(*) FROM fct_estados_resultados",
]
PARTS["sales_cube_rows"] = (
    "SELECT v.fecha, v.producto, v.negocio, v.codigo_inventario AS cod_prod, coalesce(d.categoria, 'Sin categoria') AS categoria, v.cantidad, "
    "v.precio_total AS ventas_bs, year(v.fecha) AS anio, strftime(v.fecha, '%Y-%m') AS mes, CAST(v.fecha AS VARCHAR) AS dia, "
    "CAST(isoyear(v.fecha) * 100 + weekofyear(v.fecha) AS INTEGER) AS semana_anio, strftime(v.fecha, '%a') AS dia_semana "
    "FROM fct_ventas_items v LEFT JOIN dim_producto d USING (codigo_inventario)"
)
add("report_sizes", " UNION ALL ".join(_sizes))
add("sales_cube", rounded("sales_cube_rows", "cantidad ventas_bs"))


def pivot(dims: str, cell: str, rows: str = "sales_cube_rows", units=(UNIT_A, UNIT_B), extra: str = "") -> str:
    cells = {u: f"coalesce({cell.format(f=f"FILTER (negocio = '{u}')")}, 0)" for u in units}
    shown = ", ".join(f'round_even(round({c}, 6), 0) + 0.0 AS "{u}"' for u, c in cells.items())
    total = f", round_even(round({' + '.join(cells.values())}, 6), 0) + 0.0 AS \"Total\"" if len(units) > 1 else ""
    some = " AND ".join(f"{d.strip()} IS NOT NULL" for d in dims.split(","))
    return f"SELECT {dims}, {shown}{total}{extra} FROM {rows} WHERE {some} GROUP BY {dims}"


add("sales_pivot_sum", pivot("semana_anio, categoria", "sum(ventas_bs) {f}"))
add("sales_pivot_quantity_by_item", pivot("anio, producto, cod_prod", "sum(cantidad) {f}"))
add("sales_pivot_per_day", pivot("mes, categoria", "sum(ventas_bs) {f} / count(DISTINCT dia) {f}"))
add(
    "sales_pivot_weekday_order",
    pivot("anio, dia_semana", "sum(ventas_bs) {f}", extra=", list_position(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], dia_semana) AS orden_dia"),
)
PARTS["one_unit_rows"] = (
    f"SELECT * FROM sales_cube_rows WHERE negocio = '{UNIT_B}' AND fecha BETWEEN DATE '2022-01-01' AND DATE '2024-06-30' "
    "AND categoria IN ('AGUAS', 'GASEOSAS', '1. Burgers')"
)
add("sales_pivot_one_unit", pivot("anio", "sum(ventas_bs) {f}", "one_unit_rows", (UNIT_B,)))
add(
    "sales_filtered",
    rounded(f"(SELECT * FROM sales_cube_rows WHERE semana_anio IN (202401, 202402, 202310) AND negocio IN ('{UNIT_A}', '{UNIT_B}'))", "cantidad ventas_bs"),
)
add("sales_no_unit_selected", rounded("(SELECT * FROM sales_cube_rows WHERE FALSE)", "cantidad ventas_bs"))

# -- P&L reports
_MONTHS = [f"m{m:02d}" for m in range(1, 13)]
_month_cells = ", ".join(
    f"max(round_even(round(monto, 6), 0)) FILTER (month(periodo) = {i + 1}) + 0.0 AS {m}" for i, m in enumerate(_MONTHS)
)
_not_future = f"(year(periodo) <> {AS_OF.year} OR month(periodo) <= {AS_OF.month})"
PARTS["month_cells"] = (
    f"SELECT year(periodo) AS anio, negocio, orden, grupo_eerr, categoria, calculos_eerr, {_month_cells} FROM fct_estados_resultados "
    f"WHERE {_not_future} GROUP BY ALL"
)
PARTS["month_rows"] = f"SELECT *, CAST({' + '.join(f'coalesce({m}, 0)' for m in _MONTHS)} AS DOUBLE) AS total FROM month_cells"
_AMOUNTS = [*_MONTHS, "total"]
add("pnl_month_pivot", "SELECT * FROM month_rows")
add("pnl_current_year", f"SELECT * FROM month_rows WHERE anio = {REPORT_YEAR} AND negocio = 'Todos'")
_less = ", ".join(
    f"CASE WHEN r.categoria IN ({quoted(fixed.PNL_LINES_AFTER_OPTIONAL)}) THEN r.{m} - coalesce(s.{m}, 0) ELSE r.{m} END AS {m}" for m in _AMOUNTS
)
add(
    "pnl_without_line",
    f"SELECT r.anio, r.negocio, r.orden, r.grupo_eerr, r.categoria, r.calculos_eerr, {_less} FROM month_rows r "
    f"LEFT JOIN month_rows s ON s.anio = r.anio AND s.negocio IS NOT DISTINCT FROM r.negocio AND s.categoria = '{fixed.PNL_OPTIONAL_LINE}' "
    f"WHERE r.categoria <> '{fixed.PNL_OPTIONAL_LINE}'",
)
_sums = ", ".join(f"sum({m}) AS {m}" for m in _AMOUNTS)
add(
    "pnl_group_rollup",
    "SELECT anio, negocio, any_value(o.orden_grupo) AS orden_grupo, '' AS posicion, "
    "CASE WHEN count(*) = 1 THEN '' WHEN grupo_eerr IN ('Salarios', 'Costos', 'EBITDA') THEN '▾ ' ELSE '▸ ' END || grupo_eerr AS categoria, "
    "CASE WHEN count(*) = 1 THEN max(r.calculos_eerr) ELSE 0 END AS calculos_eerr, CAST(count(*) > 1 AS INTEGER) AS tiene_hijos, 0 AS nivel, "
    f"{_sums} FROM month_rows r JOIN (SELECT DISTINCT grupo_eerr, orden_grupo FROM dim_orden_eerr) o USING (grupo_eerr) WHERE anio = 2023 "
    "GROUP BY anio, negocio, grupo_eerr UNION ALL "
    "SELECT anio, negocio, CASE grupo_eerr WHEN 'Salarios' THEN 4 ELSE 5 END, orden, categoria, calculos_eerr, 0, 1, "
    f"{', '.join(_AMOUNTS)} FROM month_rows WHERE anio = 2023 AND grupo_eerr IN ('Salarios', 'Costos')",
)
add("pnl_read", rounded("fct_estados_resultados", "monto"))

# -- checks
add(
    "check_unmapped_categories",
    f"SELECT categoria, {r4('sum(bs)', 'bs')}, count(*) AS n FROM fct_gastos_compilados WHERE categoria IS NULL OR (categoria <> 'Dividendos' "
    "AND categoria NOT IN (SELECT categoria FROM dim_orden_eerr)) GROUP BY categoria",
)
add(
    "check_unmatched_lines",
    "SELECT count(*) AS lineas, count(*) FILTER (codigo_inventario IS NULL OR codigo_inventario NOT IN "
    "(SELECT codigo_inventario FROM dim_producto)) AS sin_maestro FROM fct_ventas_items",
)
add("check_repeated_keys", f"SELECT insumo, count(*) AS filas FROM dim_receta_{A} GROUP BY insumo HAVING count(*) > 1")


def rejected(label: str, table: str, c: str, fmt: str) -> str:
    return (
        f"SELECT '{label}' AS tabla, count(*) FILTER (length({c}) > 0) AS con_fecha, "
        f"count(*) FILTER (length({c}) > 0 AND TRY_STRPTIME({c}, '{fmt}') IS NULL) AS rechazadas FROM {table}"
    )


add(
    "check_rejected_dates",
    " UNION ALL ".join(
        [
            rejected("compras", f"compras_insumos_{A}", '"Fecha Porcion"', "%d-%b-%Y"),
            rejected("extras", "pedidosya_ventas_extras", '"Fecha"', "%d/%m/%Y"),
            rejected("salidas", f"salidas_mermas_{A}", '"Fecha"', "%d-%b-%Y"),
        ]
    ),
)

# -- functions
_T = "upper(p_name) || '-2x1 o''neil ' || lower(p_brand)"
add(
    "fn_text",
    f"SELECT p_partkey, {titled('t')} AS titulo, {item_text('t')} AS normal, CASE WHEN lower(t) LIKE 'burger%' OR lower(t) LIKE 'cheeseb%' THEN '1. Burgers' "
    f"WHEN lower(t) LIKE 'sando%' THEN '2. Sandos' ELSE '3. Otros' END AS categoria, '{B}' AS negocio, lower(t) LIKE '%widget%' AS tiene "
    f"FROM (SELECT p_partkey, {_T} AS t FROM part)",
)
add(
    "fn_dates",
    "SELECT o_orderkey, d AS con_mes, d AS con_barra, CAST(o_orderdate - INTERVAL 4 HOURS AS DATE) AS dia_comercial, strftime(d, '%G%V') AS semana_iso, "
    "strftime(d, '%Y.%m.%d') AS periodo, strftime(d, '%a') AS dia, CAST(date_trunc('month', d) AS DATE) AS mes "
    "FROM (SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS d FROM orders)",
)
add(
    "fn_numbers",
    f"SELECT l_linenumber, {r4('sum(round(l_extendedprice, 2))', 'miles')}, {r4('sum(l_discount)', 'coma')}, {r4('sum(l_quantity)', 'conteo')}, "
    f"{r4('sum(l_quantity / (1 - l_linenumber * 0.1::DOUBLE))', 'bruto')}, {r4('sum(round_even(l_quantity / 2, 0))', 'par')}, "
    "max(CASE WHEN l_quantity = 50 THEN '–' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END) AS texto FROM lineitem GROUP BY l_linenumber",
)

# -- readers and writers
_INVOICES = (
    f"SELECT negocio, anulada, producto, {r4('sum(q)', 'cantidad')}, {r4('sum(p)', 'precio_total')}, count(*) AS n FROM ("
    "SELECT sucursal, anulada, item1 AS producto, quantity1 AS q, price1 AS p FROM src_invoice UNION ALL "
    "SELECT sucursal, anulada, item2, quantity2, price2 FROM src_invoice) JOIN "
    f"(VALUES (79344, '{UNIT_A}'), (81761, '{UNIT_B}')) u(sucursal, negocio) USING (sucursal) GROUP BY ALL"
)
add("source_invoice_json", _INVOICES)
add("source_invoice_documents", _INVOICES)
_ITEMS = (
    f"SELECT CASE WHEN codigo LIKE 'I%' THEN '?' ELSE categoria END AS categoria, count(*) AS n, "
    f"{r4("sum(precio) FILTER (codigo NOT LIKE 'I%')", 'precio')} FROM src_master GROUP BY 1"
)
add("source_json_bad_records", _ITEMS)
add("source_json_array", _ITEMS)
_SHEET = (
    "SELECT 'C' || CAST(p_partkey AS VARCHAR) AS cod, p_name || ', ' || p_brand AS producto, "
    "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS cantidad, CAST(NULL AS VARCHAR) AS nota FROM part"
)
add("source_csv_sheet", _SHEET)
add("source_csv_skip_rows", _SHEET)
# The third file has no quantity column.
add(
    "source_csv_records",
    "SELECT 'C' || CAST(p_partkey AS VARCHAR) AS cod, '12\" ' || p_name || ', ' || p_brand || chr(10) || '\"C' || CAST(p_partkey AS VARCHAR) || '\"' AS producto, "
    "p_partkey % 3 <> 2 AS contado FROM part",
)
add(
    "source_first_block",
    "SELECT 'C' || CAST(p_partkey AS VARCHAR) AS cod, p_name || ', ' || p_brand AS producto, "
    "CASE WHEN p_partkey % 10 = 0 THEN '-' ELSE CAST(p_size AS VARCHAR) END AS cantidad, 'Gastos Aproximados' AS cuenta FROM part",
)
add(
    "source_first_block_of_events",
    f"SELECT e.user_id, e.event_id, e.event_type, {r4('e.value', 'value')} FROM events e JOIN (SELECT user_id, min(event_id) AS first_signup FROM events "
    "WHERE event_type = 'signup' GROUP BY user_id) s ON s.user_id = e.user_id AND e.event_id > s.first_signup WHERE NOT EXISTS (SELECT 1 FROM events x "
    "WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.event_id > s.first_signup AND x.event_id <= e.event_id)",
)
add(
    "source_union_by_name",
    f"SELECT \"Producto\" AS producto, {r4('\"Peso\"', 'peso_a')}, CAST(NULL AS DOUBLE) AS peso_b FROM salidas_mermas_{A} UNION ALL "
    f"SELECT \"Producto\", NULL, {r4('\"Peso (g / ml)\"', 'peso_b')} FROM salidas_mermas_{B}",
)
add("sink_table_replace", rounded("dim_producto", DOUBLES["dim_producto"]))
add(
    "sink_view",
    f"SELECT codigo_inventario, {r4('sum(cantidad)', 'cantidad')} FROM fct_ventas_items GROUP BY codigo_inventario",
)
add(
    "sink_export_csv",
    f"SELECT producto, semana, {r4('cierre', 'cierre')}, diferencia <> 0 AS has_diff FROM {_DRINKS} WHERE {_BEB} AND diferencia IS NOT NULL",
)
add("sink_table_sample", "SELECT least(50, count(*)) AS filas FROM dim_producto")
add("sink_table_list", "SELECT 'listed_dim_producto' AS tabla, count(*) AS filas FROM dim_producto")

add("source_landing_folder", rounded("fct_ventas_items", DOUBLES["fct_ventas_items"]))
add(
    "source_stored_gold",
    rounded("fct_ventas_items", DOUBLES["fct_ventas_items"]) + " WHERE fecha BETWEEN DATE '2024-01-15' AND DATE '2024-03-20'",
)
