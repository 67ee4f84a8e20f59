"""The gold datasets, each a lazy DataFrame over the landed tables.

`Warehouse(spark, raw, as_of)["fct_ventas_items"]` builds that dataset and what it needs; nothing runs
until an action. `rebuild` writes all of them, and each later one reads the earlier ones back from storage.
Table names end in the unit's name, for example `dim_receta_<a>`; `names()` lists them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarbook import fixed_values as fixed
from cellarbook.functions.dates import (
    DateLike,
    as_date,
    business_date,
    iso_year_week,
    month_name_date,
    slash_date,
)
from cellarbook.functions.numbers import (
    decimal_comma_number,
    gross_quantity,
    or_zero,
    percent_fraction,
    thousands_number,
    to_double,
)
from cellarbook.functions.text import blank_to_null, item_category, normal_item_name, not_blank, title_case
from cellarbook.operators import reconcile
from cellarbook.operators.flows import flow_rows, per_day
from cellarbook.operators.joins import constant_rows, join_side
from cellarbook.operators.order_text import (
    extra_values,
    net_of_commission,
    order_items,
    signed_extra,
    vegetarian_returns,
)
from cellarbook.operators.periods import average_counts, count_periods, last_close
from cellarbook.operators.pnl import Ledger, compile_ledgers, layout, monthly_pnl
from cellarbook.operators.recipes import (
    apply_factors,
    explode_recipe,
    ingredient_use_per_day,
    lowest_per_key,
    portions,
    trimmed_mean,
    weighted_price,
)
from cellarbook.operators.unpivot import count_range, unpivot_counts
from cellarbook.site import Site
from cellarbook.sources.manifest import Entry, commit, read_manifest, register, remove_unused
from cellarbook.sources.sinks import MONTH, new_version, read_stored, stored_by_month

PRICE_DAYS = 120
WEIGHT_DAYS = 60

_BUILDERS: dict[str, Callable[["Warehouse"], DataFrame]] = {}


def gold(name: str):
    """Register a builder; `{a}` and `{b}` stand for the unit names."""

    def register(build):
        _BUILDERS[name] = build
        return build

    return register


def _c(name: str):
    return F.col(f"`{name}`")


def _num(name: str):
    return to_double(_c(name))


class Warehouse(Mapping[str, DataFrame]):
    def __init__(self, spark: SparkSession, raw: Mapping[str, DataFrame], as_of: DateLike, site: Site | None = None):
        self.spark = spark
        self.as_of = as_of
        self.site = site or Site()
        self._raw = raw
        self._made: dict[str, DataFrame] = {}
        self._stored: dict[str, Entry] = {}
        self._folder: str | None = None
        self._opened = False
        self.version = 0
        self._builders = {self._named(name): build for name, build in _BUILDERS.items()}

    def _named(self, name: str) -> str:
        return name.format(a=self.site.a, b=self.site.b)

    def names(self) -> list[str]:
        return list(self._builders)

    def raw(self, name: str) -> DataFrame:
        return self._raw[self._named(name)]

    def gold(self, name: str) -> DataFrame:
        return self[self._named(name)]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if self._opened:
                self._made[name] = read_stored(self.spark, self._stored[name].path)
            else:
                self._made[name] = self._builders[name](self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def rebuild(self, folder: str, only: Sequence[str] = ()) -> dict[str, DataFrame]:
        """Full refresh of every dataset (or of `only` some) from the raw tables, in dependency order.

        The tables go to fresh folders below `folder`, and only when all of them are there do they become the
        current ones, next to those that are not refreshed. So a refresh may be repeated, one that fails changes
        nothing, two at once do not lose each other's tables, and readers of the tables before keep them.
        Datasets with a date are stored by month.
        """
        fresh = Warehouse(self.spark, self._raw, self.as_of, self.site)
        fresh._folder = new_version(folder)
        for name in (n for n in self._builders if not only or n in only):
            fresh._made[name], fresh._stored[name] = stored_by_month(fresh[name], f"{fresh._folder}/{name}")
        self.version = commit(self.spark, folder, fresh._stored).number
        self._made, self._stored, self._folder = fresh._made, fresh._stored, fresh._folder
        return {name: self._made[name] for name in self._stored}

    @classmethod
    def open(
        cls, spark: SparkSession, folder: str, as_of: DateLike, site: Site | None = None, version: int | None = None
    ) -> Warehouse:
        """The datasets stored below `folder`, for reports; raw tables are not needed.

        They are those of the last refresh, or of the one numbered `version`, and stay so while this is open.
        """
        own, found = cls(spark, {}, as_of, site), read_manifest(spark, folder, version)
        if not found.number:
            raise ValueError(f"nothing is stored below {folder}")
        own._stored, own.version, own._opened = dict(found.entries), found.number, True
        return own

    def entries(self) -> dict[str, Entry]:
        """What is known of the stored datasets: path, rows, rows without a date, first and last date."""
        return dict(self._stored)

    def register(self, database: str = "gold") -> None:
        """Show the stored datasets in a database of the session's catalog."""
        paths = {name: entry.path for name, entry in self._stored.items()}
        register(self.spark, self, paths, database)

    @staticmethod
    def remove_unused(spark: SparkSession, folder: str, keep: int = 1, hours: float = 24.0) -> list[str]:
        """Delete stored tables that only refreshes before the last `keep` have; the paths deleted."""
        return remove_unused(spark, folder, keep, hours)

    def between(self, name: str, first: DateLike, last: DateLike) -> DataFrame:
        """Rows of a dataset with a date from `first` to `last`; of a stored one only those months are read."""
        days = F.col("fecha").between(as_date(first), as_date(last))
        if name not in self._stored:
            return self[name].filter(days)
        stored = self.spark.read.parquet(self._stored[name].path)
        if MONTH in stored.columns:
            months = F.col(MONTH).between(F.date_format(as_date(first), "yyyy-MM"), F.date_format(as_date(last), "yyyy-MM"))
            stored = stored.filter(months).drop(MONTH)
        return stored.filter(days)

    # Flows several areas share.

    def item_names(self) -> DataFrame:
        """The item master without prices: who only needs names and codes does not wait for those."""
        return self["dim_producto_izi"] if "dim_producto_izi" in self._stored else _listed_items(self)

    # Stock areas: flow days and periods are worked out once for the weekly and the daily form.

    def periods(self, area: reconcile.Area) -> DataFrame:
        one_per_day = area is reconcile.INGREDIENTS_A
        return count_periods(counts_of(self, area), area.key, area.carry, one_per_day)

    def flow_days(self, build: Callable[[Warehouse], DataFrame]) -> DataFrame:
        """The flows of an area per item and day; a refresh stores them, so that both forms read them back."""
        name = f"_{build.__name__}"
        if name not in self._made:
            days = build(self)
            self._made[name] = stored_by_month(days, f"{self._folder}/{name}")[0] if self._folder else days
        return self._made[name]

    def weekly(self, area: reconcile.Area, flows: Callable[[Warehouse], DataFrame]) -> DataFrame:
        return reconcile.reconcile_periods(self.periods(area), self.flow_days(flows), area, counts_of(self, area))

    def daily(
        self, weekly: str, area: reconcile.Area, flows: Callable[[Warehouse], DataFrame], shown: Sequence[str] = ()
    ) -> DataFrame:
        """The days of a stored weekly table's periods, or else of the periods themselves: the sums are not needed."""
        stored = self._named(weekly) in self._stored
        periods = self.gold(weekly) if stored else reconcile.labelled(self.periods(area))
        counts = None if stored else counts_of(self, area)
        return reconcile.reconcile_days(periods, self.flow_days(flows), area, self.as_of, shown, counts)

    def last_close(self, weekly: str, area: reconcile.Area) -> date | None:
        """The latest closing date of an area's periods, known when a report is planned.

        Of a stored table its entry has it; otherwise it follows from the counts alone.
        """
        entry = self._stored.get(self._named(weekly))
        if entry is not None:
            return entry.last and date.fromisoformat(entry.last)
        return last_close(counts_of(self, area)).first()[0]

    def sales_of(self, unit: str) -> DataFrame:
        return self["fct_ventas_items"].filter(F.col("negocio") == unit)


# ---- sales and items --------------------------------------------------------


@gold("fct_ventas_items")
def sale_items(w: Warehouse) -> DataFrame:
    valid = w.raw("izi_facturas").filter(F.col("anulada") == 0)
    lines = valid.select(
        business_date(F.col("fechaPago"), fixed.BUSINESS_DAY_SHIFT_HOURS).alias("fecha"),
        F.col("_negocio").alias("negocio"),
        F.explode("listaItems").alias("item"),
    )
    untracked = (F.col("negocio") == w.site.unit_a) & (F.col("item.codigoInventario") == fixed.UNTRACKED_CODE_A)
    return lines.filter(~untracked).select(
        "fecha",
        F.col("item.articulo").alias("producto"),
        F.col("item.cantidad").alias("cantidad"),
        "negocio",
        F.col("item.codigoInventario").alias("codigo_inventario"),
        F.col("item.precioTotal").alias("precio_total"),
    )


@gold("dim_producto")
def items(w: Warehouse) -> DataFrame:
    master = w.raw("izi_items_inventario").select(
        F.col("codigo").alias("codigo_inventario"),
        F.col("nombre").alias("producto"),
        F.col("categoria.nombre").alias("categoria"),
        F.col("precioUnitario").alias("precio_unitario"),
        F.col("cantidad").alias("cantidad_stock"),
    )
    return lowest_per_key(master, "codigo_inventario", ["producto", "categoria"])


@gold("fct_movimiento_inventario")
def stock_sales(w: Warehouse) -> DataFrame:
    return w["fct_ventas_items"].select("fecha", "producto", "cantidad", "codigo_inventario")


# ---- recipes and withdrawals ------------------------------------------------


@gold("dim_receta_{a}")
def recipe_a(w: Warehouse) -> DataFrame:
    rows = w.raw("matriz_relaciones_{a}").filter(_c("Cod Producto") != "")
    base = rows.select(
        _c("Cod Producto").alias("cod_producto"),
        _c("Producto (izi)").alias("producto"),
        _c("Cod Insumo").alias("cod_insumo"),
        _c("Insumo").alias("insumo"),
        _num("Cantidad usada (kg o u)").alias("cantidad_usada"),
        percent_fraction(_c("Merma (%)")).alias("merma_pct"),
        F.coalesce(_num("Porciones"), F.lit(1.0)).alias("porciones"),
        _c("Stock de porciones").alias("stock_porciones"),
        _c("Nuevo Stock").alias("nuevo_stock"),
        _c("Rango").alias("rango"),
        _c("Dias de compras").alias("dias_compras"),
        _c("Dias de llegada estimada").alias("dias_llegada_estimada"),
        _c("Dias de produccion").alias("dias_produccion"),
    )
    return base.filter(F.col("porciones") != 0).withColumn(
        "cantidad", gross_quantity(F.col("cantidad_usada"), F.col("merma_pct"))
    )


@gold("fct_consumo_insumos_{a}")
def ingredient_use_own_code(w: Warehouse) -> DataFrame:
    return explode_recipe(w["fct_movimiento_inventario"], w.gold("dim_receta_{a}"), own_code_only=True)


@gold("fct_salidas_mermas_{a}")
def withdrawals_a(w: Warehouse) -> DataFrame:
    return _withdrawals(w.raw("salidas_mermas_{a}"), "Peso")


def _withdrawals(rows: DataFrame, weight: str) -> DataFrame:
    return rows.select(
        month_name_date(_c("Fecha")).alias("fecha"),
        _c("Producto").alias("producto"),
        _num(weight).alias("peso"),
        _num("Porciones").alias("porciones"),
        _c("Comentarios").alias("comentarios"),
    )


# ---- delivery ---------------------------------------------------------------


@gold("fct_pedidosya_items")
def delivery_items(w: Warehouse) -> DataFrame:
    delivered = w.raw("pedidosya_ventas").filter(_c("Estado del pedido") == fixed.DELIVERED_STATUS)
    orders = delivered.select(_c("Fecha del pedido").try_cast("date").alias("fecha"), _c("Artículos").alias("_text"))
    return order_items(orders, "_text").withColumn("canal", F.lit(fixed.DELIVERY_CHANNEL))


# ---- purchases and prices ---------------------------------------------------


def _purchases(rows: DataFrame, *own: tuple[str, str]) -> DataFrame:
    dated = rows.filter(not_blank(_c("Fecha")))
    return dated.select(
        F.coalesce(month_name_date(blank_to_null(_c("Fecha Porcion"))), month_name_date(_c("Fecha"))).alias("fecha"),
        _c("Cod Producto").alias("cod_producto"),
        _c("Categoria").alias("categoria"),
        _c("Producto").alias("producto"),
        _c("Medida").alias("medida"),
        _num("Porciones").alias("porciones"),
        _num("Peso Real").alias("peso_real"),
        _num("Cantidad Compra").alias("cantidad"),
        _num("Precio Unitario").alias("precio_unitario"),
        _num("Precio Total").alias("precio_total"),
        *[(_num(c) if c.startswith("Peso") else _c(c)).alias(name) for c, name in own],
        _c("Comentario").alias("comentario"),
    )


@gold("fct_compras_insumos_{a}")
def purchases_a(w: Warehouse) -> DataFrame:
    return _purchases(w.raw("compras_insumos_{a}"), ("Empresa", "empresa"))


@gold("fct_compras_insumos_{b}")
def purchases_b(w: Warehouse) -> DataFrame:
    return _purchases(w.raw("compras_insumos_{b}"), ("Peso Porcion", "peso_porcion"))


@gold("dim_compras_precios_{a}")
def purchase_prices(w: Warehouse) -> DataFrame:
    return weighted_price(w.gold("fct_compras_insumos_{a}"), w.as_of, PRICE_DAYS)


def _listed_items(w: Warehouse) -> DataFrame:
    master = w.raw("izi_items_inventario").select(
        "codigo", F.col("nombre").alias("producto"), F.col("categoria.nombre").alias("categoria")
    )
    base = lowest_per_key(master, "codigo", ["producto", "categoria"]).select(
        F.trim("codigo").alias("cod_producto"), "producto", "categoria"
    )
    for prefix in fixed.MASTER_EXCLUDED_PREFIXES:
        base = base.filter(~F.col("cod_producto").startswith(prefix))
    kept = base.filter(~F.col("cod_producto").isin(*fixed.MASTER_EXCLUDED_CODES))
    return kept.withColumn("producto_", title_case(F.col("producto")))


@gold("dim_producto_izi")
def item_master(w: Warehouse) -> DataFrame:
    prices = w.gold("dim_compras_precios_{a}").select("cod_producto", "precio_compra")
    priced = _listed_items(w).join(prices, "cod_producto", "left")
    return priced.select("cod_producto", "producto", "categoria", "precio_compra", "producto_")


@gold("fct_ventas_{b}_pedidosya")
def delivery_sales(w: Warehouse) -> DataFrame:
    named = w["fct_pedidosya_items"].withColumn("producto", normal_item_name(F.col("producto")))
    codes = w.item_names().select(F.col("producto_").alias("producto"), "cod_producto")
    return join_side(named.withColumn("categoria", item_category(F.col("producto"))), codes, ["producto"], "left").select(
        "fecha", "cantidad", "producto", "categoria", "canal", "cod_producto"
    )


# ---- counts -----------------------------------------------------------------


@gold("fct_inventario_fisico")
def drink_counts_a(w: Warehouse) -> DataFrame:
    sheets = [unpivot_counts(w.raw(name)) for name in ("inventarios_gs", "inventarios_bebidas")]
    return sheets[0].unionByName(sheets[1], allowMissingColumns=True)


@gold("dim_receta_{b}")
def recipe_b(w: Warehouse) -> DataFrame:
    net = _num("Cantidad usada (kg o u)")
    waste = percent_fraction(_c("Merma (%)"))
    return w.raw("matriz_relaciones_{b}").filter((_c("Insumo") != "") & net.isNotNull()).select(
        _c("Cod Producto").alias("cod_producto"),
        _c("Producto (izi)").alias("producto"),
        _c("Cod Insumo").alias("cod_insumo"),
        _c("Insumo").alias("insumo"),
        _c("Categoria").alias("categoria"),
        net.alias("cantidad_usada"),
        waste.alias("merma_pct"),
        gross_quantity(net, waste).alias("cantidad"),
    )


@gold("fct_inventario_{b}")
def drink_counts_b(w: Warehouse) -> DataFrame:
    return unpivot_counts(w.raw("inventarios_{b}"), only_current=True)


def _known_counts(w: Warehouse, sheet: str, value: str = "cantidad") -> DataFrame:
    return unpivot_counts(w.raw(sheet), value).filter(F.col(value).isNotNull())


@gold("fct_inventario_unitarios_{b}")
def ingredient_counts_b(w: Warehouse) -> DataFrame:
    counts = _known_counts(w, "inventarios_unitarios_{b}")
    named = counts.select("fecha", "producto", _optional(counts, "categoria").alias("categoria_conteo"), "cantidad")
    recipe = w.gold("dim_receta_{b}").select(F.col("insumo").alias("producto"), "categoria", "cod_producto")
    return join_side(named, recipe, ["producto"], "left").select(
        "fecha", "producto", "categoria_conteo", "cantidad", "categoria", "cod_producto"
    )


def _optional(df: DataFrame, column: str):
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


@gold("fct_apertura_vinos_copa")
def bottles_opened(w: Warehouse) -> DataFrame:
    return w.raw("apertura_vinos_copa").filter(_c("Codigo Producto") != "").select(
        month_name_date(_c("Fecha")).alias("fecha"),
        _c("Codigo Producto").alias("codigo_producto"),
        _c("Botella").alias("botella"),
        _num("#Botellas").alias("num_botellas"),
        _c("Comentarios").alias("comentarios"),
    )


@gold("pesos_platos_{a}")
def dish_weights(w: Warehouse) -> DataFrame:
    net = _num("Cantidad usada (kg o u)")
    rows = w.raw("matriz_relaciones_{a}").filter(_c("Cod Producto") != "")
    return rows.select(
        _c("Cod Producto").alias("cod_producto"), gross_quantity(net, percent_fraction(_c("Merma (%)"))).alias("cantidad")
    ).filter(F.col("cantidad").isNotNull())


@gold("fct_compras_totales_{a}")
def purchases_with_weight(w: Warehouse) -> DataFrame:
    weights = w.gold("pesos_platos_{a}").withColumnRenamed("cantidad", "cantidad_plato")
    purchases = w.gold("fct_compras_insumos_{a}")
    return join_side(purchases, weights, ["cod_producto"], "left").select(*purchases.columns, "cantidad_plato")


@gold("fct_salidas_mermas_{b}")
def withdrawals_b(w: Warehouse) -> DataFrame:
    return _withdrawals(w.raw("salidas_mermas_{b}"), "Peso (g / ml)")


@gold("dim_min_max_porciones")
def min_max_portions(w: Warehouse) -> DataFrame:
    rows = constant_rows(w.spark, fixed.MIN_MAX_PORTIONS, ["insumo", "min_porc", "max_porc"])
    return rows.select("insumo", F.col("min_porc").cast("bigint"), F.col("max_porc").cast("bigint"))


# ---- movements and extras ---------------------------------------------------


def _movements(w: Warehouse) -> DataFrame:
    return w.raw("izi_movimientos").select(
        F.col("fecha").cast("date").alias("fecha"),
        "cantidad",
        F.col("tipoMovimiento").alias("tipo_movimiento"),
        F.col("codigoInventario").alias("codigo_inventario"),
    )


@gold("fct_mov_inv_{b}")
def internal_movements(w: Warehouse) -> DataFrame:
    return _movements(w).filter(F.col("tipo_movimiento") == fixed.MOVEMENT_INTERNAL)


@gold("fct_mov_inv_{b}_todos")
def all_movements(w: Warehouse) -> DataFrame:
    return _movements(w)


@gold("fct_extras_izi_{b}")
def extras(w: Warehouse) -> DataFrame:
    typed = w.raw("pedidosya_ventas_extras").select(
        slash_date(_c("Fecha")).alias("fecha"),
        _c("Variable 1").alias("variable1"),
        _c("Variable 2").alias("variable2"),
        _c("Notas").alias("notas"),
        _c("Producto").alias("producto"),
        _num("Cantidad").alias("cantidad"),
    )
    master = w.item_names()
    signed = typed.filter(F.col("fecha").isNotNull()).withColumn(
        "cantidad", signed_extra(F.col("cantidad"), F.col("notas"), F.col("variable1"), F.col("variable2"))
    )
    names = master.select(F.col("producto").alias("value"), F.col("producto").alias("producto2"))
    added = join_side(extra_values(signed), names, ["value"], "left").select("fecha", "cantidad", "value", "producto2")

    vegetarian = master.filter(F.col("categoria").isin(*fixed.VEGETARIAN_CATEGORIES))
    dishes = vegetarian.select("producto", F.col("cod_producto").alias("value"))
    returned = join_side(vegetarian_returns(typed), dishes, ["producto"]).select(
        "fecha", "cantidad", "value", F.lit(None).cast("string").alias("producto2")
    )
    return added.unionByName(returned)


@gold("fct_inventario_insumos_gs")
def weight_counts(w: Warehouse) -> DataFrame:
    counts = _known_counts(w, "inventarios_insumos_gs", "peso")
    recipe = w.gold("dim_receta_{a}").select(F.col("insumo").alias("producto"), "cod_producto", "cantidad_usada")
    joined = join_side(counts.select("fecha", _optional(counts, "categoria").alias("categoria"), "producto", "peso"), recipe, ["producto"], "left")
    return joined.select(
        "fecha",
        "categoria",
        "producto",
        "peso",
        "cod_producto",
        F.try_divide(F.col("peso") * 1000, F.col("cantidad_usada")).alias("cantidad"),
    )


@gold("fct_inventario_unitarios_gs")
def ingredient_counts_a(w: Warehouse) -> DataFrame:
    counts = _known_counts(w, "inventarios_unitarios_gs")
    recipe = w.gold("dim_receta_{a}").select(F.col("insumo").alias("producto"), "cod_producto")
    named = counts.select("fecha", _optional(counts, "categoria").alias("categoria"), "producto", "cantidad")
    return join_side(named, recipe, ["producto"], "left").select("fecha", "categoria", "producto", "cantidad", "cod_producto")


@gold("dim_relacion_copa_vino")
def glass_map(w: Warehouse) -> DataFrame:
    return w.raw("relacion_copa_vino").filter(_c("Cod Botella") != "").select(
        _c("Categoria").alias("categoria"),
        _c("Cod. Producto").alias("cod_producto"),
        _c("Producto").alias("producto"),
        _c("Botella").alias("botella"),
        _c("Cod Botella").alias("cod_botella"),
    )


@gold("fct_copas_vino_{a}")
def glass_sales(w: Warehouse) -> DataFrame:
    bottles = w["dim_relacion_copa_vino"].select(F.col("cod_producto").alias("codigo_inventario"), "cod_botella")
    sales = w.sales_of(w.site.unit_a).select("fecha", "producto", "cantidad", "codigo_inventario")
    return join_side(sales, bottles, ["codigo_inventario"]).select(*sales.columns, "cod_botella")


def _counted_on(w: Warehouse, *sheets: str):
    return count_range(*[w.raw(sheet) for sheet in sheets])


def counts_of(w: Warehouse, area: reconcile.Area) -> DataFrame:
    """The physical counts an area is reconciled by."""
    if area is reconcile.DRINKS_A:
        return w["fct_inventario_fisico"]
    if area is reconcile.INGREDIENTS_A:
        # The counts are averaged per name and day, which the recipe join of their dataset cannot change:
        # it repeats all rows of a name alike. So the sheet is read without it.
        return average_counts(_known_counts(w, "inventarios_unitarios_gs"), ["producto"])
    if area is reconcile.DRINKS_B:
        coded = w.gold("fct_inventario_{b}").filter(not_blank(F.col("cod_producto")))
        return average_counts(coded, ["cod_producto", "producto"])
    # Averaged per spelling, then upper-cased: two spellings counted on one day stay two counts of one item.
    spelled = average_counts(_known_counts(w, "inventarios_unitarios_{b}"), ["producto"])
    return spelled.withColumn("producto", F.upper("producto"))


# ---- reconciliation: unit A, drinks and wines -------------------------------


def drinks_a_flow_days(w: Warehouse) -> DataFrame:
    moved = w.gold("fct_mov_inv_{b}_todos").filter(F.col("tipo_movimiento").isin(*fixed.MOVEMENT_COMPLIMENTARY_A))
    master = w["dim_producto"].select("codigo_inventario", "producto")
    movements = per_day(moved, ["codigo_inventario"]).join(master, "codigo_inventario")
    codes = w.item_names().select(F.col("cod_producto").alias("codigo_producto"), "producto")
    bottles = per_day(w["fct_apertura_vinos_copa"], ["codigo_producto"], "num_botellas").join(codes, "codigo_producto")
    through_recipes = ingredient_use_per_day(w["fct_movimiento_inventario"], w.gold("dim_receta_{a}"), own_code_only=True)
    name = F.upper("producto")
    return reconcile.area_flow_days(
        {
            "compras": flow_rows(w.gold("fct_compras_insumos_{a}"), name),
            "directas": flow_rows(w.sales_of(w.site.unit_a), name),
            "indirectas": flow_rows(through_recipes, F.upper("insumo"), "cantidad_consumida"),
            "ventas_ext": flow_rows(w["fct_pedidosya_items"], name),
            "movimientos": flow_rows(movements, name, count="_rows"),
            "salidas": flow_rows(bottles, name, "num_botellas"),
        },
        reconcile.DRINKS_A,
        _counted_on(w, "inventarios_gs", "inventarios_bebidas"),
    )


@gold("fct_reconciliacion_bebidas_{a}")
def drinks_a_weekly(w: Warehouse) -> DataFrame:
    return w.weekly(reconcile.DRINKS_A, drinks_a_flow_days)


@gold("fct_reconciliacion_bebidas_{a}_diario")
def drinks_a_daily(w: Warehouse) -> DataFrame:
    return w.daily("fct_reconciliacion_bebidas_{a}", reconcile.DRINKS_A, drinks_a_flow_days)


# ---- reconciliation: unit A, ingredients ------------------------------------


@gold("dim_promedio_peso_porcion_{a}")
def portion_weights(w: Warehouse) -> DataFrame:
    served, weight = _num("Porciones"), _num("Peso Real")
    recent = month_name_date(_c("Fecha")) >= F.date_sub(as_date(w.as_of), WEIGHT_DAYS)
    samples = w.raw("compras_insumos_{a}").filter(weight.isNotNull() & (served != 0) & recent)
    samples = samples.select(_c("Producto").alias("producto"), F.try_divide(weight, served).alias("_weight"))
    return trimmed_mean(samples.filter(F.col("producto").isNotNull()), "producto", "_weight", "promedio_peso_x_porcion")


@gold("fct_consumo_insumos_{a}_todos")
def ingredient_use_all(w: Warehouse) -> DataFrame:
    return explode_recipe(w["fct_movimiento_inventario"], w.gold("dim_receta_{a}"), own_code_only=False)


def ingredients_a_flow_days(w: Warehouse) -> DataFrame:
    mean_weight = w.gold("dim_promedio_peso_porcion_{a}")
    bought = w.raw("compras_insumos_{a}").filter((_c("Empresa") == w.site.unit_a) & not_blank(_c("Fecha"))).select(
        _c("Producto").alias("producto"),
        month_name_date(_c("Fecha")).alias("fecha"),
        _num("Porciones").alias("porciones"),
        _num("Peso Real").alias("peso"),
    )
    used = ingredient_use_per_day(w["fct_movimiento_inventario"], w.gold("dim_receta_{a}"), own_code_only=False)

    def in_portions(rows: DataFrame, whole: bool) -> DataFrame:
        weighed = join_side(rows.select("producto", "fecha", "porciones", "peso"), mean_weight, ["producto"], "left")
        served = portions(F.col("porciones"), F.col("peso"), F.col("promedio_peso_x_porcion"), whole)
        return flow_rows(weighed, F.upper("producto"), served)

    return reconcile.area_flow_days(
        {
            "compras": in_portions(bought, whole=True),
            "ventas": flow_rows(used, F.upper("insumo"), "cantidad_consumida"),
            "salidas": in_portions(w.gold("fct_salidas_mermas_{a}"), whole=False),
        },
        reconcile.INGREDIENTS_A,
        _counted_on(w, "inventarios_unitarios_gs"),
    )


@gold("fct_reconciliacion_insumos_{a}")
def ingredients_a_weekly(w: Warehouse) -> DataFrame:
    return w.weekly(reconcile.INGREDIENTS_A, ingredients_a_flow_days)


@gold("fct_reconciliacion_insumos_{a}_diario")
def ingredients_a_daily(w: Warehouse) -> DataFrame:
    return w.daily("fct_reconciliacion_insumos_{a}", reconcile.INGREDIENTS_A, ingredients_a_flow_days)


# ---- reconciliation: unit B, drinks -----------------------------------------


def _own_sales(w: Warehouse) -> DataFrame:
    units = apply_factors(
        F.col("cantidad"),
        F.col("producto"),
        fixed.SALES_FACTORS_BY_NAME,
        F.col("codigo_inventario"),
        fixed.OWN_SALES_FACTORS_BY_CODE,
    )
    return w.sales_of(w.site.unit_b).withColumn("cantidad", units)


def _other_unit_sales(w: Warehouse) -> DataFrame:
    units = apply_factors(
        F.col("cantidad"), code=F.col("codigo_inventario"), by_code=fixed.OTHER_UNIT_FACTORS_BY_CODE
    )
    return w.sales_of(w.site.unit_a).withColumn("cantidad", units)


def drinks_b_flow_days(w: Warehouse) -> DataFrame:
    codes = w.item_names().select(F.col("producto").alias("producto2"), "cod_producto")
    extras = per_day(w.gold("fct_extras_izi_{b}"), ["producto2", "value"])
    # Text that matched no item has no key; it would all meet in one task.
    matched = extras.filter(F.col("producto2").isNotNull()).join(codes, "producto2", "left")
    added = matched.unionByName(extras.filter(F.col("producto2").isNull()), allowMissingColumns=True)
    bought = w.gold("fct_compras_insumos_{b}").filter(not_blank(F.col("cod_producto")))
    return reconcile.area_flow_days(
        {
            "compras": flow_rows(bought, "cod_producto"),
            "vtas": flow_rows(_own_sales(w), "codigo_inventario"),
            "vtas_anc": flow_rows(_other_unit_sales(w), "codigo_inventario"),
            "vtas_py": flow_rows(w.gold("fct_ventas_{b}_pedidosya"), "cod_producto"),
            "vtas_ext": flow_rows(added, F.coalesce("cod_producto", "value")),
            "cortesias": flow_rows(w.gold("fct_mov_inv_{b}"), "codigo_inventario"),
        },
        reconcile.DRINKS_B,
        _counted_on(w, "inventarios_{b}"),
    )


@gold("fct_reconciliacion_bebidas_{b}")
def drinks_b_weekly(w: Warehouse) -> DataFrame:
    return w.weekly(reconcile.DRINKS_B, drinks_b_flow_days)


@gold("fct_reconciliacion_bebidas_{b}_diario")
def drinks_b_daily(w: Warehouse) -> DataFrame:
    return w.daily("fct_reconciliacion_bebidas_{b}", reconcile.DRINKS_B, drinks_b_flow_days, shown=["producto"])


# ---- reconciliation: unit B, ingredients ------------------------------------


@gold("dim_insumo_{b}")
def ingredient_codes(w: Warehouse) -> DataFrame:
    rows = [(code, name) for name, codes in fixed.INGREDIENT_CODES.items() for code in codes]
    return constant_rows(w.spark, rows, ["cod_producto", "insumo"])


def ingredients_b_flow_days(w: Warehouse) -> DataFrame:
    codes = F.broadcast(w.gold("dim_insumo_{b}"))

    def of_ingredient(rows: DataFrame, code: str) -> DataFrame:
        return flow_rows(rows.withColumnRenamed(code, "cod_producto").join(codes, "cod_producto"), "insumo")

    delivered = w.gold("fct_ventas_{b}_pedidosya")
    delivered = delivered.withColumn(
        "cantidad", apply_factors(F.col("cantidad"), F.col("producto"), fixed.DELIVERY_FACTORS_BY_NAME)
    )
    bought = w.raw("compras_insumos_{b}").select(
        _c("Producto").alias("producto"), month_name_date(_c("Fecha")).alias("fecha"), _num("Porciones").alias("cantidad")
    )
    return reconcile.area_flow_days(
        {
            "compras": flow_rows(bought, F.upper("producto")),
            "vtas": of_ingredient(_own_sales(w), "codigo_inventario"),
            "vtas_anc": of_ingredient(_other_unit_sales(w), "codigo_inventario"),
            "vtas_py": of_ingredient(delivered, "cod_producto"),
            "cortesias": of_ingredient(w.gold("fct_mov_inv_{b}"), "codigo_inventario"),
            "salidas": flow_rows(w.gold("fct_salidas_mermas_{b}"), F.upper("producto"), "porciones"),
        },
        reconcile.INGREDIENTS_B,
        _counted_on(w, "inventarios_unitarios_{b}"),
    )


@gold("fct_reconciliacion_insumos_{b}")
def ingredients_b_weekly(w: Warehouse) -> DataFrame:
    return w.weekly(reconcile.INGREDIENTS_B, ingredients_b_flow_days)


@gold("fct_reconciliacion_insumos_{b}_diario")
def ingredients_b_daily(w: Warehouse) -> DataFrame:
    return w.daily("fct_reconciliacion_insumos_{b}", reconcile.INGREDIENTS_B, ingredients_b_flow_days)


# ---- sales totals -----------------------------------------------------------


@gold("fct_pedidosya_pedidos")
def delivery_orders(w: Warehouse) -> DataFrame:
    delivered = w.raw("pedidosya_ventas").filter(_c("Estado del pedido") == fixed.DELIVERED_STATUS)
    amounts = delivered.select(
        _c("Fecha del pedido").try_cast("date").alias("fecha"),
        decimal_comma_number(_c("Total del pedido")).alias("_total"),
        or_zero(decimal_comma_number(_c("Descuento total"))).alias("_discount"),
    ).filter(F.col("fecha").isNotNull() & F.col("_total").isNotNull())
    net = F.col("_total") - F.col("_discount")
    return amounts.select(
        "fecha", net.alias("total_inicial_bs"), net_of_commission(net, F.col("fecha")).alias("total_bs")
    )


@gold("fct_ventas_diarias_negocio")
def daily_sales(w: Warehouse) -> DataFrame:
    till = w.raw("izi_facturas").filter(F.col("anulada") == 0).select(
        business_date(F.col("fechaPago"), fixed.BUSINESS_DAY_SHIFT_HOURS).alias("fecha"),
        F.col("_negocio").alias("negocio"),
        F.explode("listaItems.precioTotal").alias("vtas_bs"),
    )
    delivery = w["fct_pedidosya_pedidos"].select(
        "fecha", F.lit(w.site.unit_b).alias("negocio"), F.col("total_bs").alias("vtas_bs")
    )
    days = till.unionByName(delivery).groupBy("fecha", "negocio").agg(F.sum("vtas_bs").alias("vtas_bs"))
    return days.select("fecha", "negocio", iso_year_week(F.col("fecha")).alias("semana_ano"), "vtas_bs")


# ---- expenses, income, P&L --------------------------------------------------

_DAY, _NAMED_DAY = "try_cast(Fecha AS DATE)", "try_to_date(Fecha, 'd-MMM-yyyy')"
_FLIPPED, _CASH = "-try_cast(`Importe Formateado` AS DOUBLE)", "try_cast(Bs AS DOUBLE)"
_OUT = "`Ingreso Egreso` = 'Egreso'"
_SIGNED = "try_cast(Monto AS DOUBLE)"
_NO_ERROR = f"{_SIGNED} < 0 AND `Fijo/Semanal/Otros` NOT IN ('ERROR', 'Error', 'Cash')"


def expense_ledgers(site: Site) -> list[Ledger]:
    """The sources of the expense ledger: table, account, date, positive amount, rows kept."""
    a, b, name_a = site.a, site.b, site.unit_a
    return [
        Ledger(f"gastos_bisa_{a}", f"Bisa {name_a}", _DAY, _FLIPPED, _OUT),
        Ledger("gastos_bisa_explora", "Bisa Explora", "try_cast(`Fecha Ajustada` AS DATE)", _FLIPPED, _OUT),
        Ledger(
            f"gastos_caja_{a}",
            f"Cash {name_a}",
            _DAY,
            _CASH,
            "Empresa IS NOT NULL AND `Fijo/Semanal/Otros` NOT IN ('Cash', 'Transferencias')",
        ),
        Ledger(
            f"gastos_caja_{b}", f"Cash {b}", _DAY, _CASH, f"Empresa = '{b}' AND `Fijo/Semanal/Otros` IN ('Fijo', 'Semanal')"
        ),
        Ledger(f"gastos_bcp_{b}", f"BCP {b}", "try_cast(Fecha1 AS DATE)", f"abs({_SIGNED})", _NO_ERROR),
        Ledger(
            "gastos_bcp_bodas",
            "BCP catering",
            "try_cast(Fecha1 AS DATE)",
            f"abs({_SIGNED})",
            f"{_NO_ERROR} AND Categoria IS NOT NULL",
        ),
        Ledger(f"gastos_cash_{a}_gs", f"Cash {name_a} GS", _NAMED_DAY, _CASH, "Empresa IS NOT NULL"),
        Ledger(f"gastos_cash_{b}_gs", f"Cash {site.unit_b} GS", _NAMED_DAY, _CASH, "Empresa IS NOT NULL"),
        *[
            Ledger(f"gastos_{table}_{unit}_gs", f"{bank} {shown} GS", _NAMED_DAY, _FLIPPED, f"{_OUT} AND Categoria IS NOT NULL")
            for table, bank in (("fortaleza", "Fortaleza"), ("bnb", "BNB"))
            for unit, shown in ((a, name_a), (b, b))
        ],
        Ledger(f"gastos_us_{a}", f"$us {name_a}", _DAY, _CASH, "Empresa IS NOT NULL"),
        Ledger("gastos_aproximados", "Gastos Aproximados", _DAY, _CASH),
    ]


@gold("fct_gastos_compilados")
def expenses(w: Warehouse) -> DataFrame:
    ledgers = expense_ledgers(w.site)
    return compile_ledgers({x.table: w.raw(x.table) for x in ledgers}, ledgers, fixed.PNL_FIRST_DATE)


@gold("fct_ingresos_compilados")
def income(w: Warehouse) -> DataFrame:
    site = w.site
    named_day = month_name_date(_c("Fecha"))

    def amounts(table: str, total) -> DataFrame:
        return w.raw(table).select(named_day.alias("fecha"), total.alias("total"))

    def per_date(rows: DataFrame) -> DataFrame:
        return rows.groupBy("fecha").agg(F.sum("total").alias("total"))

    def tagged(rows: DataFrame, unit: str, channel: str, event=None) -> DataFrame:
        name = F.lit(None).cast("string") if event is None else event
        return rows.select(
            "fecha",
            "total",
            F.lit(unit).alias("negocio"),
            F.lit(channel).alias("canal"),
            name.alias("canal2_bodas"),
        )

    total = thousands_number(_c("Total"))
    current = amounts("registro_mesas_{a}", total).filter(
        F.col("fecha") > F.lit(fixed.DINING_ROOM_CURRENT_FROM).cast("date")
    )
    dining = current.unionByName(amounts("registro_mesas_{a}_historico", total))
    # Delivery of unit A adds dates only; its amounts are left out on purpose.
    unit_a = dining.unionByName(amounts("ingresos_ventas_gs_eventos", total)).unionByName(
        amounts("ingresos_ventas_gs_delivery", F.lit(0.0))
    )
    catering = w.raw("ingresos_eventos_bodas").select(
        named_day.alias("fecha"), thousands_number(_c("Bs")).alias("total"), _c("Nombre").alias("_event")
    )
    # Grouped by the timestamp but shown by date: a date may come more than once.
    erp = w.raw("ingresos_fac_ventas_{b}_odoo").groupBy("date_order").agg(F.sum(_num("Total Bs")).alias("total"))
    invoices = w.raw("izi_facturas").filter((F.col("anulada") == 0) & (F.col("_negocio") == site.unit_b)).select(
        business_date(F.col("fechaPago"), fixed.BUSINESS_DAY_SHIFT_HOURS).alias("fecha"), F.col("montoTotal").alias("total")
    )
    advisory = w.raw("gastos_bisa_explora").filter(
        (_c("Ingreso Egreso") == "Ingreso") & _c("Fijo/Semanal/Otros").isin(*fixed.ADVISORY_LABELS)
    )
    advisory = advisory.select(
        _c("Fecha Ajustada").try_cast("date").alias("fecha"), _num("Importe Formateado").alias("total")
    )
    delivery = w["fct_pedidosya_pedidos"].select("fecha", F.col("total_bs").alias("total"))
    parts = [
        tagged(per_date(unit_a), site.unit_a, f"{site.unit_a} GS Total Restaurante"),
        tagged(catering, "Catering", "Catering", F.col("_event")),
        tagged(erp.select(F.col("date_order").try_cast("date").alias("fecha"), "total"), site.b, f"{site.unit_b} Odoo"),
        tagged(per_date(delivery), site.b, f"{site.unit_b} {fixed.DELIVERY_CHANNEL}"),
        tagged(per_date(amounts("ingresos_ventas_{b}_eventos", total)), site.b, f"{site.unit_b} Eventos"),
        tagged(per_date(invoices), site.b, f"{site.b} iZi"),
        tagged(advisory, "Asesoria", "Asesoria"),
    ]
    compiled = parts[0]
    for part in parts[1:]:
        compiled = compiled.unionByName(part)
    return compiled.filter(F.col("fecha") >= F.lit(fixed.PNL_FIRST_DATE).cast("date"))


@gold("dim_orden_eerr")
def pnl_layout(w: Warehouse) -> DataFrame:
    return layout(w.spark)


@gold("fct_estados_resultados")
def pnl(w: Warehouse) -> DataFrame:
    return monthly_pnl(w["fct_gastos_compilados"], w["fct_ingresos_compilados"], w.site)
