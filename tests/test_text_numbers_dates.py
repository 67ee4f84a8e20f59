"""Text, number and date rules, delivery text, extras and factors."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cellarbook import fixed_values as fixed
from cellarbook.functions import dates, numbers, text
from cellarbook.operators import order_text, recipes, unpivot
from cellarbook.site import Site


def values(spark, expression, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").orderBy("i")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "expression, inputs, expected",
    [
        (text.title_case, ["coca-cola 2x1", "PAN DE AJO", "o'neil ñandú", None], ["Coca-Cola 2X1", "Pan De Ajo", "O'Neil Ñandú", None]),
        (
            text.normal_item_name,
            ["Gaseosa Coca-Cola Sin Azucar 500 ml", "burger-doble]", "Agua 600 ml", " té \t"],
            ["Coca Zero", "Burger Doble", "Agua", "Té"],
        ),
        (text.item_category, ["Burger x", "CHEESEBURGER", "Sando", "Agua", None], ["1. Burgers", "1. Burgers", "2. Sandos", "3. Otros", "3. Otros"]),
        (numbers.count_cell, ["5", "-", "-3", "", "1.5", "x", None], [5.0, None, 3.0, None, 1.5, None, None]),
        (numbers.thousands_number, ["1,234.50", "7", "n/a"], [1234.5, 7.0, None]),
        (numbers.decimal_comma_number, ["12,50", "3"], [12.5, 3.0]),
        (numbers.percent_fraction, ["12%", "", None], [0.12, None, None]),
        (dates.month_name_date, ["01-Feb-2024", "1-Feb-2024", "pendiente", "", None], [date(2024, 2, 1)] * 2 + [None] * 3),
        (dates.slash_date, ["07/01/2024", "31/31/2024"], [date(2024, 1, 7), None]),
    ],
)
def test_column_rules(spark, expression, inputs, expected):
    assert values(spark, expression, *inputs) == expected


def test_units_have_one_spelling(spark):
    site = Site("Alpha", "beTa")
    assert values(spark, lambda c: text.unit_name(c, site), "beta", "Beta ", " BETA", "ALPHA", " Otra", None) == ["beta"] * 3 + ["Alpha", "Otra", None]


def test_iso_week_and_business_day(spark):
    df = spark.createDataFrame([(datetime(2024, 12, 30, 2, 0),)], "t timestamp_ntz")
    got = df.select(
        dates.iso_year_week(F.col("t").cast("date")), dates.business_date(F.col("t"), fixed.BUSINESS_DAY_SHIFT_HOURS)
    ).first()
    assert tuple(got) == ("202501", date(2024, 12, 29))


def test_gross_quantity(spark):
    df = spark.range(1).select(
        numbers.gross_quantity(F.lit(0.8), F.lit(0.2)).alias("a"), numbers.gross_quantity(F.lit(0.8), F.lit(1.0)).alias("b")
    )
    assert tuple(df.first()) == (pytest.approx(1.0), None)


def test_dash_text_and_half_even(spark):
    df = spark.createDataFrame([(1234.5,), (None,), (-10.5,), (2.4999999999,)], "v double")
    got = df.select(numbers.dash_text(F.col("v")), numbers.round_half_even(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("1,234", 1234.0), ("–", None), ("-10", -10.0), ("2", 2.0)]


def test_delivery_text(spark, rows):
    df = spark.createDataFrame(
        [("2 Burger [sin queso], 1 Coca-Cola, nota",), ("a [x, 3 y], 1 b",), (None,), ("",), ("10  Agua\t",)], "t string"
    )
    got = rows(order_text.order_items(df, "t"), "cantidad", "producto")
    assert got == sorted([(2, "burger"), (1, "coca-cola"), (3, "y]"), (1, "b"), (10, "agua")], key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("day, fee", [("2024-09-23", 0.18), ("2024-09-24", 0.22), ("2024-10-24", 0.22), ("2024-10-25", 0.25)])
def test_commission_tiers(spark, day, fee):
    row = spark.range(1).select(order_text.net_of_commission(F.lit(100.0), F.lit(day).cast("date"))).first()
    assert row[0] == pytest.approx(100 * (1 - fee / 0.87))


def test_extras_split_and_sign(spark, rows):
    df = spark.createDataFrame(
        [("Carne Extra, Queso , más", "-", 2.0, "opción VEG"), (None, "Papas", 1.0, None)],
        "variable1 string, variable2 string, cantidad double, notas string",
    ).withColumn("fecha", F.lit("2024-01-01").cast("date"))
    signed = df.withColumn(
        "cantidad", order_text.signed_extra(F.col("cantidad"), F.col("notas"), F.col("variable1"), F.col("variable2"))
    )
    assert rows(order_text.extra_values(signed), "cantidad", "value") == [(-2.0, "Carne Extra"), (-2.0, "Queso"), (1.0, "Papas")]
    assert rows(order_text.vegetarian_returns(df), "cantidad") == [(-2.0,)]


def test_unpivot_reads_dates_from_headers(spark, rows):
    sheet = spark.createDataFrame(
        [("Ron", "Si", "5", "-", "x"), ("Gin", "No", "1", "2", "y")], "Producto string, Vigente string, `07/01/24` string, `14/01/2024` string, Obs string"
    )
    long = unpivot.unpivot_counts(sheet, only_current=True)
    assert long.columns == ["fecha", "producto", "cantidad"]
    assert rows(long) == [(date(2024, 1, 7), "Ron", 5.0), (date(2024, 1, 14), "Ron", None)]
    assert unpivot.unpivot_counts(sheet).count() == 4
    assert unpivot.count_range(sheet) == (date(2024, 1, 7), date(2024, 1, 14))
    assert unpivot.unpivot_counts(sheet.select("Producto", "Obs")).count() == 0


def test_factors_by_name_come_first(spark, rows):
    df = spark.createDataFrame(
        [("Chop Cerveza", "OMU00052", 4.0), ("x", "OMU00052", 4.0), ("x", "OMU00068", 4.0), ("x", None, 4.0)], "n string, c string, q double"
    )
    units = recipes.apply_factors(
        F.col("q"), F.col("n"), fixed.SALES_FACTORS_BY_NAME, F.col("c"), fixed.OWN_SALES_FACTORS_BY_CODE
    )
    assert rows(df.select("n", "c", units.alias("u")), "u") == [(0.0,), (2.0,), (3.0,), (4.0,)]


def test_trimmed_mean_drops_outliers(spark, rows):
    df = spark.createDataFrame([("a", 1.0)] * 9 + [("a", 100.0), ("b", 7.0)], "k string, v double")
    assert rows(recipes.trimmed_mean(df, "k", "v", "m")) == [("a", 1.0), ("b", 7.0)]


def test_weighted_price_window(spark, rows):
    df = spark.createDataFrame(
        [("a", date(2024, 1, 1), 1.0, 999.0), ("a", date(2024, 6, 1), 2.0, 10.0), ("a", date(2024, 6, 9), 3.0, 20.0), ("z", date(2024, 6, 9), 0.0, 5.0), ("", date(2024, 6, 9), 1.0, 1.0)],
        "cod_producto string, fecha date, cantidad double, precio_total double",
    )
    assert rows(recipes.weighted_price(df, date(2024, 6, 30), 120)) == [("a", 5.0, 6.0), ("z", 0.0, None)]


def test_lowest_per_key_is_one_whole_row(spark, rows):
    df = spark.createDataFrame([("1", "b", 1), ("1", "a", 9), ("1", None, 0), ("2", None, 5)], "k string, n string, x int")
    assert rows(recipes.lowest_per_key(df, "k", ["n"])) == [("1", "a", 9), ("2", None, 5)]
