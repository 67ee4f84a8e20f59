"""Landed tables derived from the driver's TPC-H-like tables.

The driver's data has no restaurant in it, so each landed table is a projection of the driver table that
grows like it would: invoices and ledgers from `lineitem`, delivery orders from `orders`, item master,
recipes and count sheets from `part`, stock movements from `events`. Every row of those tables is used.

The projections are SQL that both Spark and the oracle's engine understand (names in backticks, tables in
braces), so the inputs of the two sides are the same by construction and the comparison is about the
datasets only. Nested inputs are the exception: `LANDED_NESTED` is Spark's, and the oracle starts from the
flat rows behind it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import date
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from cellarbook.fixed_values import PNL_LINES
from cellarbook.plans.warehouse import Warehouse
from cellarbook.site import Site
from cellarbook.sources.readers import spread_invoices

SITE = Site()
AS_OF = date(2024, 7, 10)
SHIFT_DAYS = 9132  # 25 years: ship and order dates then run from 2020 to 2026
TABLES = ("part", "supplier", "orders", "lineitem", "events")


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def whole(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


def eighths(expr: str) -> str:
    """Amounts in eighths add up exactly, whatever the order."""
    return f"floor({expr} * 8) / 8"


def day_month_year(d: str) -> str:
    """`5-Mar-2024`."""
    month = f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month({d}) AS INT) * 3 - 2, 3)"
    return f"{text(f'day({d})')} || '-' || {month} || '-' || {text(f'year({d})')}"


def slashed(d: str) -> str:
    two = lambda part: f"lpad({text(f'{part}({d})')}, 2, '0')"
    return f"{two('day')} || '/' || {two('month')} || '/' || {text(f'year({d})')}"


def thousands(x: str) -> str:
    """`12,345.50`."""
    return f"{text(whole(f'{x} / 1000'))} || ',' || lpad({text(f'{whole(x)} % 1000')}, 3, '0') || '.50'"


# Item codes: a few well-known ones, each standing for one item in a hundred, and one code per item otherwise.
KNOWN_CODES = {3: "OMU00052", 4: "OMU00053", 5: "OMU00071", 6: "OMU00068", 7: "OMU00031", 8: "OMU00059"}


def item_code(k: str, where: str = "TRUE") -> str:
    known = " ".join(f"WHEN {where} AND {k} % 100 = {i} THEN '{code}'" for i, code in KNOWN_CODES.items())
    return f"CASE {known} ELSE 'C' || {text(k)} END"


_CATEGORIES = (
    "CASE p_type WHEN 'STANDARD' THEN 'CERVEZA' WHEN 'ECONOMY' THEN 'GASEOSAS' WHEN 'PROMO' THEN 'AGUAS' "
    "WHEN 'LARGE' THEN 'VINO TINTO' WHEN 'MEDIUM' THEN 'VINO BLANCO ' ELSE 'OTROS' END"
)
COUNT_HEADERS = (
    "07/01/2024", "14/01/2024", "21/01/24", "04/02/2024", "03/03/2024", "31/03/24", "05/05/2024", "07/07/2024",
)


def count_cells(p: str, size: str, headers=COUNT_HEADERS, decimals: str = "") -> str:
    """Counted cells: numbers as text, some negative, some "-" and some empty."""

    def cell(i: int) -> str:
        number = f"{text(f'{size} + ({p} * {i + 3}) % 23')} || '{decimals}'"
        return (
            f"CASE WHEN ({p} + {i}) % 9 = 0 THEN '-' WHEN ({p} + {i}) % 13 = 0 THEN '' "
            f"WHEN ({p} + {i}) % 17 = 0 THEN '-' || {number} ELSE {number} END"
        )

    return ", ".join(f"{cell(i)} AS `{header}`" for i, header in enumerate(headers)) + ", 'x' AS `Obs`"


_LINE_NAMES = [line for _, _, line, _, _ in PNL_LINES if line != "Ingresos"][:16]
_LEDGER_CATEGORY = (
    "CASE l_suppkey % 20 "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate([*_LINE_NAMES, "Dividendos", "Otra cosa"]))
    + " END"
)
_EMPRESA = (
    f"CASE l_suppkey % 7 WHEN 0 THEN '{SITE.unit_a}' WHEN 1 THEN ' {SITE.a}' WHEN 2 THEN '{SITE.b}' "
    f"WHEN 3 THEN '{SITE.unit_b}' WHEN 4 THEN '{SITE.b} ' WHEN 5 THEN 'Otra' END"
)
_KIND = (
    "CASE l_orderkey % 7 WHEN 0 THEN 'Fijo' WHEN 1 THEN 'Semanal' WHEN 2 THEN 'Cash' WHEN 3 THEN 'ERROR' "
    "WHEN 4 THEN 'EXPLORA 1' WHEN 5 THEN 'Otros' END"
)
_LEDGER_TEXTS = (
    f"{_LEDGER_CATEGORY} AS `Categoria`, l_returnflag AS `Categoria FC`, 'det ' || {text('l_suppkey % 5')} AS "
    f"`Categoria Detalle`, 'd' || {text('l_orderkey')} AS `Detalle`, {_EMPRESA} AS `Empresa`, {_KIND} AS `Fijo/Semanal/Otros`"
)
_DIRECTION = (
    "CASE WHEN l_orderkey % 3 = 0 THEN 'Ingreso' ELSE 'Egreso' END AS `Ingreso Egreso`, "
    "CASE WHEN l_orderkey % 3 = 0 THEN price ELSE -price END AS `Importe Formateado`"
)
_CASH_TEXT = f"CASE WHEN l_orderkey % 11 = 0 THEN 'n/a' ELSE {text('price')} END AS `Bs`"
_MONTO = "CASE WHEN l_orderkey % 2 = 0 THEN -price ELSE price END AS `Monto`"
_NAMED = f"{day_month_year('d')} AS `Fecha`"

# Ledger -> (date column, amount columns); they share `lineitem` out by line number and status.
_LEDGERS = (
    ("gastos_bisa_{a}", "d AS `Fecha`", _DIRECTION),
    ("gastos_bisa_explora", "d AS `Fecha Ajustada`", _DIRECTION),
    ("gastos_caja_{a}", "d AS `Fecha`", _CASH_TEXT),
    ("gastos_caja_{b}", "d AS `Fecha`", _CASH_TEXT),
    ("gastos_bcp_{b}", "d AS `Fecha1`", _MONTO),
    ("gastos_bcp_bodas", "d AS `Fecha1`", _MONTO),
    ("gastos_cash_{a}_gs", _NAMED, _CASH_TEXT),
    ("gastos_cash_{b}_gs", _NAMED, _CASH_TEXT),
    ("gastos_fortaleza_{a}_gs", _NAMED, _DIRECTION),
    ("gastos_fortaleza_{b}_gs", _NAMED, _DIRECTION),
    ("gastos_bnb_{a}_gs", _NAMED, _DIRECTION),
    ("gastos_bnb_{b}_gs", _NAMED, _DIRECTION),
    ("gastos_us_{a}", "d AS `Fecha`", _CASH_TEXT),
    ("gastos_aproximados", "d AS `Fecha`", _CASH_TEXT),
)


def _purchases(flag: str, ingredient: str, own: str) -> str:
    return (
        f"SELECT CASE WHEN l_orderkey % 41 = 0 THEN '' ELSE {day_month_year('d')} END AS `Fecha`, "
        f"CASE l_orderkey % 5 WHEN 0 THEN {day_month_year('(d + 2)')} WHEN 1 THEN '' WHEN 2 THEN 'pendiente' END AS `Fecha Porcion`, "
        f"CASE WHEN l_orderkey % 31 = 0 THEN '' ELSE {item_code('k')} END AS `Cod Producto`, "
        f"l_returnflag AS `Categoria`, CASE WHEN l_linenumber % 2 = 0 THEN 'Item ' || {text('k')} ELSE {ingredient} END AS `Producto`, "
        f"'kg' AS `Medida`, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS `Porciones`, "
        f"CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity * (l_linenumber + 1) / 4 + l_orderkey % 97 / 8 END AS `Peso Real`, "
        f"l_quantity AS `Cantidad Compra`, price / l_quantity AS `Precio Unitario`, price AS `Precio Total`, "
        f"{own}, 'c' || {text('l_linenumber')} AS `Comentario` FROM {{src_line}} WHERE l_returnflag = '{flag}'"
    )


_A_INGREDIENT = f"'Insumo ' || {text(whole('l_partkey / 4'))}"
_B_INGREDIENT = (
    "CASE l_partkey % 50 WHEN 0 THEN 'Carne Molida' WHEN 1 THEN 'carne molida' WHEN 2 THEN 'Queso' WHEN 3 THEN "
    f"'Pechuga de pollo' ELSE 'Insumo B' || {text(whole('l_partkey / 4'))} END"
)
_B_INGREDIENT_OF_PART = _B_INGREDIENT.replace("l_partkey", "p_partkey")
_B_INGREDIENT_OF_EVENT = (
    "CASE event_id % 10 WHEN 0 THEN 'carne molida' WHEN 1 THEN 'QUESO' "
    f"ELSE 'insumo b' || {text(whole('event_id / 20'))} END"
)

# Rows of the driver tables with the keys and dates the landed tables use.
PREPARED = {
    "src_line": (
        f"SELECT *, {whole('l_partkey / 2')} AS k, {eighths('l_extendedprice')} AS price, "
        f"CAST(l_shipdate AS DATE) + {SHIFT_DAYS} AS d FROM {{lineitem}}"
    ),
    "src_part": f"SELECT *, {whole('p_partkey / 2')} AS k FROM {{part}}",
    "src_order": (
        f"SELECT *, {whole('o_orderkey / 15')} AS k, {eighths('o_totalprice')} AS price, "
        f"CAST(o_orderdate AS DATE) + {SHIFT_DAYS} AS d FROM {{orders}}"
    ),
    "src_event": (
        f"SELECT *, {whole('event_id / 10')} AS k, DATE '2023-12-25' + CAST(event_id % 210 AS INT) AS d FROM {{events}}"
    ),
    # One till line with two items: what was sold, and its service charge.
    "src_invoice": (
        f"SELECT CASE l_linestatus WHEN 'O' THEN 79344 ELSE 81761 END AS sucursal, d AS pay_day, "
        f"CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 15 END AS pay_hour, "
        f"CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS anulada, price AS total, "
        f"CASE k % 100 WHEN 1 THEN 'Chop Cerveza' WHEN 2 THEN 'Chop Cerveza 2X1' ELSE 'Item ' || {text('k')} END AS item1, "
        f"l_quantity AS quantity1, CASE WHEN k % 100 = 9 THEN NULL ELSE {item_code('k')} END AS code1, price AS price1, "
        f"'Servicio' AS item2, 1.0 AS quantity2, CASE WHEN l_linenumber % 2 = 0 THEN 'AN000046' ELSE 'S' || {text('l_suppkey')} END AS code2, "
        f"l_quantity / 2 AS price2 FROM {{src_line}}"
    ),
    "src_master": (
        f"SELECT CASE WHEN k % 100 = 11 THEN '6666' WHEN k % 10 = 0 THEN 'I' || {text('k')} "
        f"WHEN k % 7 = 0 AND k % 100 > 8 THEN ' C' || {text('k')} || ' ' ELSE {item_code('k')} END AS codigo, "
        f"CASE WHEN k % 100 = 3 THEN 'Super Smash Burger' WHEN p_partkey % 2 = 0 THEN 'Item ' || {text('k')} "
        f"ELSE 'Item ' || {text('k')} || ' alt' END AS nombre, "
        f"CASE p_type WHEN 'STANDARD' THEN '1. Burgers' WHEN 'ECONOMY' THEN '2. Sandos' ELSE {_CATEGORIES} END AS categoria, "
        f"p_retailprice AS precio, p_size AS stock FROM {{src_part}}"
    ),
}

LANDED_NESTED = {
    "invoice_documents": (
        "SELECT array(named_struct('sucursal', CAST(sucursal AS BIGINT), "
        "'fechaPago', CAST(pay_day AS TIMESTAMP_NTZ) + CASE pay_hour WHEN 2 THEN INTERVAL '2' HOUR ELSE INTERVAL '15' HOUR END, 'anulada', anulada, 'montoTotal', total, "
        "'listaItems', array(named_struct('articulo', item1, 'cantidad', quantity1, 'codigoInventario', code1, 'precioTotal', price1), "
        "named_struct('articulo', item2, 'cantidad', CAST(quantity2 AS DOUBLE), 'codigoInventario', code2, 'precioTotal', price2)))) AS facturas "
        "FROM {src_invoice}"
    ),
    "izi_items_inventario": (
        "SELECT codigo, nombre, named_struct('nombre', categoria) AS categoria, precio AS precioUnitario, "
        "CAST(stock AS DOUBLE) AS cantidad FROM {src_master}"
    ),
}

LANDED = {
    "izi_movimientos": (
        f"SELECT d AS fecha, floor(value / 10) AS cantidad, CASE event_type WHEN 'signup' THEN 'interna' WHEN 'click' THEN 'prod-venta' "
        f"ELSE 'compra' END AS tipoMovimiento, {item_code('k')} AS codigoInventario FROM {{src_event}}"
    ),
    "matriz_relaciones_{a}": (
        f"SELECT CASE WHEN p_partkey % 29 = 0 THEN '' ELSE {item_code('k', 'k < 100')} END AS `Cod Producto`, 'Item ' || {text('k')} AS `Producto (izi)`, "
        f"CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'C' || {text(whole('k / 2'))} ELSE '' END AS `Cod Insumo`, "
        f"CASE WHEN p_partkey % 3 = 1 THEN 'Item ' || {text(whole('k / 2'))} ELSE 'Insumo ' || {text(whole('p_partkey / 4'))} END AS `Insumo`, "
        f"p_size / 10 AS `Cantidad usada (kg o u)`, CASE WHEN p_partkey % 97 = 0 THEN '100%' ELSE {text('p_partkey % 5 * 10')} || '%' END AS `Merma (%)`, "
        f"CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE p_partkey % 4 + 1 END AS `Porciones`, "
        f"{text('p_size')} AS `Stock de porciones`, 'n' AS `Nuevo Stock`, p_type AS `Rango`, '2' AS `Dias de compras`, "
        f"'3' AS `Dias de llegada estimada`, '1' AS `Dias de produccion` FROM {{src_part}}"
    ),
    "matriz_relaciones_{b}": (
        f"SELECT {item_code('k', 'k < 100')} AS `Cod Producto`, 'Item ' || {text('k')} AS `Producto (izi)`, 'N' || {text('k')} AS `Cod Insumo`, "
        f"CASE WHEN p_partkey % 23 = 0 THEN '' ELSE 'Insumo B' || {text(whole('p_partkey / 4'))} END AS `Insumo`, p_type AS `Categoria`, "
        f"CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_size / 10 END AS `Cantidad usada (kg o u)`, "
        f"{text('p_partkey % 5 * 10')} || '%' AS `Merma (%)` FROM {{src_part}}"
    ),
    "salidas_mermas_{a}": (
        f"SELECT {day_month_year('d')} AS `Fecha`, 'insumo ' || {text(whole('event_id / 20'))} AS `Producto`, value / 10 AS `Peso`, "
        f"CASE WHEN event_id % 3 = 0 THEN NULL ELSE floor(value / 20) END AS `Porciones`, event_type AS `Comentarios` FROM {{src_event}}"
    ),
    "salidas_mermas_{b}": (
        f"SELECT {day_month_year('d')} AS `Fecha`, {_B_INGREDIENT_OF_EVENT} AS `Producto`, value AS `Peso (g / ml)`, "
        f"CASE WHEN event_id % 4 = 0 THEN NULL ELSE floor(value / 25) END AS `Porciones`, event_type AS `Comentarios` FROM {{src_event}}"
    ),
    "apertura_vinos_copa": (
        f"SELECT {day_month_year('d')} AS `Fecha`, CASE WHEN event_id % 17 = 0 THEN '' ELSE 'C' || {text('k')} END AS `Codigo Producto`, "
        f"'Botella ' || {text('k')} AS `Botella`, event_id % 4 + 1 AS `#Botellas`, event_type AS `Comentarios` FROM {{src_event}}"
    ),
    "pedidosya_ventas": (
        f"SELECT {text('d')} || ' 21:15:00' AS `Fecha del pedido`, CASE o_orderstatus WHEN 'P' THEN 'Cancelado' ELSE 'Entregado' END AS `Estado del pedido`, "
        f"CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'nota sin numero' WHEN 2 THEN '2 Burger-Doble [x, 3 y], 1 Item ' || {text('k')} "
        f"WHEN 3 THEN {text('o_orderkey % 3 + 1')} || ' Super Smash Burger [sin queso], 1 Gaseosa Coca-Cola Sin Azucar 500 ml' "
        f"WHEN 4 THEN '1 Cheeseburger,  2  Sando de Pollo, Item sin cantidad' "
        f"ELSE {text('o_orderkey % 3 + 1')} || ' Item ' || {text('k')} || ' [sin queso, 2 extra], 1 Chop Cerveza' END AS `Artículos`, "
        f"CASE WHEN o_orderkey % 37 = 0 THEN 'gratis' ELSE replace({text('price')}, '.', ',') END AS `Total del pedido`, "
        f"CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {text('o_orderkey % 7')} || ',50' END AS `Descuento total` FROM {{src_order}}"
    ),
    "pedidosya_ventas_extras": (
        f"SELECT CASE o_orderkey % 43 WHEN 0 THEN NULL WHEN 1 THEN '31/31/2024' ELSE {slashed('d')} END AS `Fecha`, "
        f"CASE o_orderkey % 6 WHEN 0 THEN 'Carne Extra, Item ' || {text('k')} WHEN 1 THEN 'Item ' || {text('k')} WHEN 2 THEN '-' "
        f"WHEN 3 THEN 'carne extra super smash, -, tercero' WHEN 4 THEN 'Super Smash Burger' END AS `Variable 1`, "
        f"CASE o_orderkey % 4 WHEN 0 THEN 'CARNE EXTRA' WHEN 1 THEN ' Item ' || {text('k + 1')} || ' ,Papas' WHEN 2 THEN '-' END AS `Variable 2`, "
        f"CASE o_orderkey % 5 WHEN 0 THEN 'Opcion Vegetariana' WHEN 1 THEN 'sin sal' WHEN 2 THEN 'veg' END AS `Notas`, "
        f"'Item ' || {text('k')} AS `Producto`, o_orderkey % 5 + 1 AS `Cantidad` FROM {{src_order}}"
    ),
    "compras_insumos_{a}": _purchases(
        "A", _A_INGREDIENT, f"CASE WHEN l_suppkey % 3 = 0 THEN 'otra' ELSE '{SITE.unit_a}' END AS `Empresa`"
    ),
    "compras_insumos_{b}": _purchases("N", _B_INGREDIENT, "l_quantity / 8 AS `Peso Porcion`"),
    "inventarios_gs": (
        f"SELECT {_CATEGORIES} AS `Categoria`, CASE WHEN p_partkey % 2 = 0 THEN 'Item ' ELSE 'ITEM ' END || {text('k')} AS `Producto`, "
        f"{count_cells('p_partkey', 'p_size')} FROM {{src_part}}"
    ),
    "inventarios_bebidas": (
        f"SELECT 'CERVEZA' AS `Categoria`, 'Item ' || {text('s_suppkey')} AS `Producto`, 'C' || {text('s_suppkey')} AS `Cod Producto`, "
        f"{count_cells('s_suppkey', 's_nationkey', ('14/01/2024', '20/01/24'))} FROM {{supplier}}"
    ),
    "inventarios_{b}": (
        f"SELECT 'Item ' || {text('k')} AS `Producto`, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE {item_code('k')} END AS `Cod Producto`, "
        f"CASE WHEN p_partkey % 15 = 0 THEN 'No' ELSE 'Si' END AS `Vigente`, {count_cells('p_partkey', 'p_size')} FROM {{src_part}}"
    ),
    "inventarios_unitarios_{b}": (
        f"SELECT p_type AS `Categoria`, {_B_INGREDIENT_OF_PART} AS `Producto`, {count_cells('p_partkey', 'p_size')} FROM {{src_part}}"
    ),
    "inventarios_insumos_gs": (
        f"SELECT p_type AS `Categoria`, 'Insumo ' || {text(whole('p_partkey / 4'))} AS `Producto`, {count_cells('p_partkey', 'p_size', decimals='.5')} FROM {{src_part}}"
    ),
    "inventarios_unitarios_gs": (
        f"SELECT p_type AS `Categoria`, 'Insumo ' || {text(whole('p_partkey / 4'))} AS `Producto`, {count_cells('p_partkey', 'p_size')} FROM {{src_part}}"
    ),
    "relacion_copa_vino": (
        f"SELECT p_type AS `Categoria`, {item_code('k', 'k < 100')} AS `Cod. Producto`, 'Item ' || {text('k')} AS `Producto`, "
        f"'Botella ' || {text('k')} AS `Botella`, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'B' || {text('k')} END AS `Cod Botella` FROM {{src_part}}"
    ),
    "registro_mesas_{a}": f"SELECT {_NAMED}, {thousands('price')} AS `Total` FROM {{src_order}} WHERE o_orderpriority = '1-URGENT'",
    "registro_mesas_{a}_historico": (
        f"SELECT {_NAMED}, {thousands('price')} AS `Total` FROM {{src_order}} WHERE o_orderpriority = '2-HIGH'"
    ),
    "ingresos_ventas_gs_eventos": f"SELECT {_NAMED}, price AS `Total` FROM {{src_order}} WHERE o_orderpriority = '3-MEDIUM'",
    "ingresos_ventas_gs_delivery": f"SELECT {_NAMED} FROM {{src_order}}",
    "ingresos_eventos_bodas": (
        f"SELECT {_NAMED}, CASE WHEN o_orderkey % 9 = 0 THEN 'pendiente' ELSE {thousands('price')} END AS `Bs`, "
        f"'Boda ' || {text('o_custkey')} AS `Nombre` FROM {{src_order}} WHERE o_orderpriority = '4-NOT SPECIFIED'"
    ),
    "ingresos_fac_ventas_{b}_odoo": (
        f"SELECT CASE WHEN o_orderkey % 2 = 0 THEN {text('d')} || ' 10:00:00' ELSE {text('d')} || ' 20:30:00' END AS `date_order`, "
        f"price AS `Total Bs` FROM {{src_order}}"
    ),
    "ingresos_ventas_{b}_eventos": f"SELECT {_NAMED}, {thousands('price')} AS `Total` FROM {{src_order}} WHERE o_orderpriority = '5-LOW'",
    **{
        name: f"SELECT {day}, {_LEDGER_TEXTS}, {amounts} FROM {{src_line}} WHERE l_linenumber = {i // 2 + 1} AND l_linestatus = '{'OF'[i % 2]}'"
        for i, (name, day, amounts) in enumerate(_LEDGERS)
    },
}


class Landed(Mapping[str, DataFrame]):
    """The landed tables over one folder of driver tables, made on demand."""

    def __init__(self, spark: SparkSession, folder: str, site: Site = SITE):
        self._spark, self._folder, self.site = spark, folder, site
        self._sql = {
            **PREPARED,
            **{name.format(a=site.a, b=site.b): sql for name, sql in {**LANDED, **LANDED_NESTED}.items()},
        }
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder.rstrip('/')}/{name}.parquet")

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name == "izi_facturas":
            return spread_invoices(self["invoice_documents"], self.site)
        sql = self._sql[name]
        needed = {t: self[t] for t in (*TABLES, *PREPARED) if "{" + t + "}" in sql}
        return self._spark.sql(sql, **needed)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter([*self._sql, "izi_facturas"])

    def __len__(self) -> int:
        return len(self._sql) + 1


# Plans, not data: a DataFrame is a description, so queries of one session may share it.
_LANDED: WeakKeyDictionary[SparkSession, dict[str, Landed]] = WeakKeyDictionary()
_WAREHOUSES: WeakKeyDictionary[SparkSession, dict[str, Warehouse]] = WeakKeyDictionary()


def landed(spark: SparkSession, folder: str) -> Landed:
    made = _LANDED.setdefault(spark, {})
    if folder not in made:
        made[folder] = Landed(spark, folder)
    return made[folder]


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    made = _WAREHOUSES.setdefault(spark, {})
    if folder not in made:
        made[folder] = Warehouse(spark, landed(spark, folder), AS_OF, SITE)
    return made[folder]
