"""Size-checked joins, the P&L and the sales pivot."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cellarbook import fixed_values as fixed
from cellarbook.operators import joins, pivot, pnl
from cellarbook.plans import quality, reports
from cellarbook.site import Site

SITE = Site("Alpha", "beTa")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_both_join_paths_give_the_same_rows(spark, rows, how):
    fact = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        (F.col("id") % 5).alias("copies"),
    )
    side = spark.sql("SELECT * FROM VALUES ('hot', 1), ('hot', 2), ('k1', 3), (NULL, 4) AS t(k, v)")
    small = joins.join_side(fact, side, ["k"], how)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not joins.fits_broadcast(side)
        large = joins.join_side(fact, side, ["k"], how)
        assert "SortMergeJoin" in large._jdf.queryExecution().toString()
        large_rows = rows(large, "k", "copies", "v")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert large_rows == rows(small, "k", "copies", "v")


def test_broadcast_limit_reads_units(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for text, size in (("10MB", 10 << 20), ("64k", 64 << 10), ("-1", -1), ("10485760b", 10485760)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
            assert joins.broadcast_limit(spark) == size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def ledgers(spark):
    expenses = spark.createDataFrame(
        [
            (date(2024, 1, 5), "Compras", 40.0, "Alpha"),
            (date(2024, 1, 6), "Salarios Fijos", 6.0, " beta "),
            (date(2024, 1, 6), "Salarios Socios", 4.0, "BETA"),
            (date(2024, 1, 7), "Dividendos", 500.0, "Alpha"),
            (date(2024, 1, 7), "Otra", 3.0, "Alpha"),
            (date(2024, 1, 7), "Gasto", 1.0, None),
            (date(2024, 2, 7), None, 9.0, "Alpha"),
        ],
        "fecha date, categoria string, bs double, empresa string",
    )
    income = spark.createDataFrame([(date(2024, 1, 31), 100.0, "Alpha")], "fecha date, total double, negocio string")
    return expenses, income


def test_pnl_subtotals_and_units(spark, rows):
    got = pnl.monthly_pnl(*ledgers(spark), SITE)
    line = {(r.negocio, r.categoria): r.monto for r in got.collect()}
    assert len(line) == 4 * len(fixed.PNL_LINES)  # Alpha, beta, no unit, all; the NULL category is gone
    assert (line["Todos", "Margen Bruto"], line["Todos", "EBITDA"], line["Todos", "Resultado Total"]) == (60.0, 49.0, 49.0)
    assert (line["Alpha", "Margen Bruto"], line["beta", "EBITDA"], line[None, "Gasto"]) == (60.0, -10.0, 0.0)
    assert {r.periodo for r in got.collect()} == {date(2024, 1, 1)}
    assert rows(pnl.unmapped_categories(ledgers(spark)[0])) == [(None, 9.0, 1), ("Otra", 3.0, 1)]


def test_month_pivot_rounds_half_even_then_adds(spark, rows):
    base = spark.createDataFrame(
        [(date(2024, 1, 1), -10.5), (date(2024, 2, 1), -11.5), (date(2024, 5, 1), 7.0), (date(2023, 12, 1), 1.0)], "periodo date, monto double"
    ).select("periodo", F.lit("Todos").alias("negocio"), F.lit("2.09").alias("orden"), F.lit("Gastos Variables").alias("grupo_eerr"), F.lit("Gasto").alias("categoria"), F.lit(0).alias("calculos_eerr"), "monto")
    got = pnl.month_pivot(base, date(2024, 3, 31))
    assert rows(got, "anio", "m01", "m02", "m05", "m12", "total") == [(2023, None, None, None, 1, 1), (2024, -10, -12, None, None, -22)]


def test_leaving_a_line_out_and_rolling_up(spark):
    months = pnl.month_pivot(pnl.monthly_pnl(*ledgers(spark), SITE), date(2024, 12, 31), units=["Todos"])
    without = {r.categoria: r.m01 for r in pnl.without_line(months).collect()}
    assert "Salarios Socios" not in without
    assert (without["Margen Bruto"], without["EBITDA"], without["Resultado Total"]) == (60, 53, 53)
    rolled = pnl.group_rollup(months, ["Salarios", "EBITDA"]).orderBy("orden_grupo", "posicion").collect()
    shown = [(r.categoria, r.m01, r.tiene_hijos, r.calculos_eerr) for r in rolled]
    at = [i for i, s in enumerate(shown) if s[0] == "▾ Salarios"][0]
    assert shown[at] == ("▾ Salarios", -10, 1, 0)
    assert [s[0] for s in shown[at + 1 : at + 5]] == ["Salarios Fijos", "Salarios Semanales", "Salarios Extras", "Salarios Socios"]
    assert ("EBITDA", 49, 0, 1) in shown and ("▸ Costos", 0, 1, 0) in shown


def cube(spark):
    sales = spark.createDataFrame(
        [
            (date(2024, 1, 1), "a", 1.0, "Alpha", "C1", 10.0),
            (date(2024, 1, 1), "a", 1.0, "Alpha", "C1", 5.0),
            (date(2024, 1, 2), "a", 1.0, "Alpha", "C1", 6.0),
            (date(2024, 1, 2), "b", 2.0, "beTa", None, 4.5),
        ],
        "fecha date, producto string, cantidad double, negocio string, codigo_inventario string, precio_total double",
    )
    items = spark.createDataFrame([("C1", "AGUAS")], "codigo_inventario string, categoria string")
    return reports.sales_cube(sales, items), sales, items


def test_sales_pivot(spark, rows):
    data, sales, items = cube(spark)
    assert rows(pivot.sales_pivot(data, ["categoria"], "ventas_bs", ["Alpha", "beTa"])) == [("AGUAS", 21.0, 0.0, 21.0), ("Sin categoria", 0.0, 4.0, 4.0)]
    assert rows(pivot.sales_pivot(data, [], "ventas_x_dia", ["Alpha"])) == [(2024, 10.0)]
    by_code = pivot.sales_pivot(data, ["cod_prod"], "cantidad", ["Alpha", "beTa"])
    assert rows(by_code) == [("C1", 3.0, 0.0, 3.0)]
    week = pivot.in_pivot_order(pivot.sales_pivot(data, ["dia_semana"], "cantidad", ["Alpha"]))
    assert [r.dia_semana for r in week.collect()] == ["Mon", "Tue"]
    assert pivot.filter_sales(data, []).count() == 0
    assert pivot.filter_sales(data, ["Alpha"], categories=[], end="2024-01-01").count() == 2
    assert rows(quality.unmatched_lines(sales, items)) == [(4, 1)]


def test_difference_toggles(spark, rows):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", None)], "producto string, diferencia double")
    assert rows(reports.only_different(df, keep_unknown=True), "producto") == [("b",), ("c",)]
    assert rows(reports.only_different(df, keep_unknown=False), "producto") == [("b",)]
