"""Queries against their SQL twins on the smallest tables; `check.py` runs all of them on larger ones."""

import pytest

import __spark_entry__ as contract
from check import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "gold_fct_ventas_items",
    "gold_dim_producto_izi",
    "gold_fct_ventas_b_pedidosya",
    "gold_fct_extras_izi_b",
    "gold_fct_reconciliacion_bebidas_a",
    "gold_fct_reconciliacion_bebidas_b_diario",
    "gold_fct_reconciliacion_insumos_a",
    "gold_fct_reconciliacion_insumos_b",
    "gold_fct_estados_resultados",
    "rule_portion_fallback",
    "sales_pivot_per_day",
    "pnl_group_rollup",
    "source_csv_skip_rows",
    "source_first_block",
    "source_invoice_json",
]


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


def test_every_query_has_a_twin():
    assert set(contract.QUERIES) == set(contract.SQL)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, oracle, name):
    state, found, _ = compare(spark, oracle, FOLDER, name)
    assert state == "ok" and found > 0
