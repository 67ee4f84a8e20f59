"""Hand-computed answers for periods, flows, balances and day expansion."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cellarbook.operators import flows, periods, reconcile

DAY0 = date(2026, 7, 19)


def day(n):
    return DAY0 + timedelta(days=n)


def counts(spark, *rows):
    return spark.createDataFrame([(i, day(n), q) for i, n, q in rows], "producto string, fecha date, cantidad double")


def moves(spark, *rows):
    df = spark.createDataFrame([(i, day(n), q) for i, n, q in rows], "producto string, fecha date, cantidad double")
    return flows.flow_rows(df, F.upper("producto"))


def drinks(spark, **given):
    return {name: given.get(name, moves(spark)) for name in reconcile.DRINKS_A.flows}


def weekly_a(spark, counted, **given):
    days = reconcile.area_flow_days(drinks(spark, **given), reconcile.DRINKS_A)
    made = periods.count_periods(counted.withColumn("categoria", F.lit("CERVEZA")), "producto", ["categoria"])
    return reconcile.reconcile_periods(made, days, reconcile.DRINKS_A), days


def test_published_case(spark, rows):
    sold = moves(spark, *[("Huari", n, 12 / 7) for n in range(1, 8)])
    weekly, _ = weekly_a(spark, counts(spark, ("HUARI", 0, 81.0), ("HUARI", 7, 69.0)), directas=sold)
    closed = weekly.filter("cierre IS NOT NULL").select("inv_inicial", F.round("ventas", 9), F.round("inv_calculado", 9), "cierre", F.round("diferencia", 9))
    assert rows(closed) == [(81.0, 12.0, 69.0, 69.0, 0.0)]


def test_interval_is_open_at_start_and_closed_at_end(spark, rows):
    bought = moves(spark, ("a", 0, 1.0), ("a", 1, 10.0), ("a", 7, 100.0), ("a", 8, 1000.0))
    weekly, _ = weekly_a(spark, counts(spark, ("a", 0, 5.0), ("a", 7, 5.0)), compras=bought)
    assert rows(weekly, "semana", "compras") == [("2026.07.26", 110.0), ("2026.08.02", 1000.0)]


def test_open_period_has_no_difference(spark, rows):
    weekly, days = weekly_a(spark, counts(spark, ("a", 0, 5.0), ("a", 7, 4.0)))
    open_ = weekly.filter("cierre IS NULL")
    assert rows(open_, "fecha_inicio", "fecha_cierre", "inv_inicial", "diferencia") == [(day(7), day(14), 4.0, None)]
    daily = reconcile.reconcile_days(open_, days, reconcile.DRINKS_A, day(9))
    assert rows(daily, "fecha", "inv_ini_fin", "diferencia") == [(day(8), 4.0, None), (day(9), None, None)]
    assert reconcile.reconcile_days(open_, days, reconcile.DRINKS_A, day(7)).count() == 0


def test_complimentary_only_where_something_moved(spark, rows):
    counted = counts(spark, ("a", 0, 5.0), ("a", 7, 5.0))
    sold = moves(spark, ("a", 2, 5.0))
    still, _ = weekly_a(spark, counted, directas=sold)
    moved, _ = weekly_a(spark, counted, directas=sold, movimientos=moves(spark, ("A", 3, 7.0)))
    null_move = spark.createDataFrame([("a", day(3), None)], "producto string, fecha date, cantidad double")
    only_null, _ = weekly_a(spark, counted, directas=sold, movimientos=flows.flow_rows(null_move, F.upper("producto")))
    take = lambda df: rows(df.filter("cierre IS NOT NULL"), "cortesias")
    assert (take(still), take(moved), take(only_null)) == ([(0.0,)], [(2.0,)], [(-5.0,)])


def test_spellings_share_flows_but_keep_their_own_periods(spark, rows):
    counted = counts(spark, ("Ron", 0, 1.0), ("Ron", 7, 1.0), ("RON", 3, 2.0), ("RON", 10, 2.0))
    weekly, _ = weekly_a(spark, counted, compras=moves(spark, ("ron", 5, 4.0), ("ron", 9, 8.0)))
    got = rows(weekly, "producto", "semana", "compras")
    assert got == [("RON", "2026.07.29", 12.0), ("RON", "2026.08.05", 0.0), ("Ron", "2026.07.26", 4.0), ("Ron", "2026.08.02", 8.0)]


def test_counts_of_one_day_close_empty_periods(spark, rows):
    counted = counts(spark, ("a", 0, 5.0), ("a", 7, 4.0), ("a", 7, 3.0), ("a", 7, None), ("a", 9, 1.0))
    made = periods.closed_periods(counted, "producto")
    assert rows(made, "fecha_inicio", "fecha_cierre", "inv_inicial", "cierre") == [
        (day(0), day(7), 5.0, 3.0),
        (day(7), day(7), 3.0, 4.0),
        (day(7), day(9), None, 1.0),
    ]
    weekly, _ = weekly_a(spark, counted, compras=moves(spark, ("a", 7, 6.0)))
    assert rows(weekly.filter("fecha_inicio = fecha_cierre"), "compras", "diferencia") == [(0.0, 1.0)]
    assert rows(weekly.filter(F.col("inv_inicial") == 5), "compras") == [(6.0,)]


def test_equal_counts_of_one_day_are_repeated(spark, rows):
    counted = counts(spark, ("a", 0, 5.0), ("a", 7, 4.0), ("a", 7, 4.0), ("a", 7, 4.0), ("a", 7, 6.0), ("a", 9, 1.0))
    weekly, _ = weekly_a(spark, counted, compras=moves(spark, ("a", 7, 2.0), ("a", 8, 3.0)))
    assert rows(weekly, "fecha_inicio", "fecha_cierre", "inv_inicial", "compras", "cierre") == [
        (day(0), day(7), 5.0, 2.0, 4.0),
        (day(7), day(7), 4.0, 0.0, 4.0),
        (day(7), day(7), 4.0, 0.0, 4.0),
        (day(7), day(7), 4.0, 0.0, 6.0),
        (day(7), day(9), 6.0, 3.0, 1.0),
        (day(9), day(16), 1.0, 0.0, None),
    ]


def test_both_ways_of_making_periods_agree(spark, rows):
    counted = periods.average_counts(
        counts(spark, *[(f"i{k % 3}", (k * 5) % 23, float(k) if k % 4 else None) for k in range(60)]), ["producto"]
    )
    one = rows(periods.closed_periods(counted, "producto", one_per_day=True))
    assert one == rows(periods.closed_periods(counted, "producto")) and one


def test_items_without_a_name_are_kept(spark, rows):
    weekly, _ = weekly_a(spark, counts(spark, (None, 0, 5.0), (None, 7, 4.0)), compras=moves(spark, (None, 3, 9.0)))
    assert rows(weekly, "semana", "compras", "diferencia") == [("2026.07.26", 0.0, -1.0), ("2026.08.02", 0.0, None)]


def test_last_day_of_a_closed_period_ends_at_the_weekly_figures(spark, rows):
    sold = moves(spark, ("a", 1, 2.0), ("a", 4, 3.0))
    bought = moves(spark, ("a", 4, 10.0))
    counted = counts(spark, ("a", 0, 5.0), ("a", 7, 9.0))
    weekly, days = weekly_a(spark, counted, directas=sold, compras=bought)
    daily = reconcile.reconcile_days(weekly, days, reconcile.DRINKS_A, day(30)).filter("semana = '2026.07.26'")
    assert [r.inv_dia_esperado for r in daily.orderBy("fecha").collect()] == [3.0, 3.0, 3.0, 10.0, 10.0, 10.0, 10.0]
    last = rows(daily.filter("diferencia IS NOT NULL"), "inv_dia_esperado", "inv_ini_fin", "diferencia")
    assert last == rows(weekly.filter("cierre IS NOT NULL"), "inv_calculado", "cierre", "diferencia") == [(10.0, 9.0, -1.0)]


def test_one_day_period_shows_the_opening_count(spark, rows):
    weekly, days = weekly_a(spark, counts(spark, ("a", 0, 5.0), ("a", 1, 4.0)))
    daily = reconcile.reconcile_days(weekly.filter("cierre IS NOT NULL"), days, reconcile.DRINKS_A, day(9))
    assert rows(daily, "inv_ini_fin", "diferencia") == [(5.0, -1.0)]


def test_interval_sums_against_brute_force_with_a_hot_item(spark):
    """One item holds most movements, periods of three spellings overlap; every sum is checked by hand."""
    import random

    rng = random.Random(7)
    names = ["hot", "Hot", "HOT", "b", "c"]
    counted = [(n, d, float(rng.randint(0, 50))) for n in names for d in sorted(rng.sample(range(0, 90), 9))]
    moved = [("hot" if rng.random() < 0.7 else rng.choice("bcd"), rng.randint(-5, 100), rng.randint(1, 9) / 8) for _ in range(3000)]
    weekly, _ = weekly_a(spark, counts(spark, *counted), compras=moves(spark, *moved))
    got = weekly.collect()
    assert len(got) == len(names) * 9
    for r in got:
        want = sum(q for i, d, q in moved if i.upper() == r.producto.upper() and r.fecha_inicio < day(d) <= r.fecha_cierre)
        assert r.compras == want


def test_date_limits_change_nothing(spark, rows):
    counted = counts(spark, ("a", 0, 5.0), ("a", 7, 5.0)).withColumn("categoria", F.lit("x"))
    given = drinks(spark, compras=moves(spark, *[("a", n, 1.0) for n in range(-3, 20)]))
    made = periods.count_periods(counted, "producto", ["categoria"])
    free, limited = [
        rows(reconcile.reconcile_periods(made, reconcile.area_flow_days(given, reconcile.DRINKS_A, limits), reconcile.DRINKS_A))
        for limits in (None, (day(0), day(7)))
    ]
    assert free == limited


@pytest.mark.parametrize(
    "area, expected",
    [(reconcile.INGREDIENTS_A, 100 + 1 - 2 - 3), (reconcile.DRINKS_B, 100 + 1 - (2 + 3 + 4 + 5) - 6), (reconcile.INGREDIENTS_B, 100 + 1 - (2 + 3 + 4 + 5 + 6))],
)
def test_balance_of_each_area(spark, rows, area, expected):
    item = "A"
    given = {name: moves(spark, (item, 1, float(i + 1))) for i, name in enumerate(area.flows)}
    counted = counts(spark, (item, 0, 100.0), (item, 7, 90.0)).withColumn("cod_producto", F.col("producto"))
    made = periods.count_periods(counted, area.key, area.carry)
    weekly = reconcile.reconcile_periods(made, reconcile.area_flow_days(given, area), area).filter("cierre IS NOT NULL")
    assert rows(weekly, "inv_calculado", "diferencia") == [(float(expected), 90.0 - expected)]
