"""Versions of stored tables: partial refreshes, two writers, removal, listing."""

from concurrent.futures import ThreadPoolExecutor
from datetime import date
from pathlib import Path

import pytest

from cellarbook.plans import reports
from cellarbook.plans.bindings import AS_OF, SITE, landed
from cellarbook.plans.warehouse import Warehouse
from cellarbook.sources import manifest, sinks

FOLDER = "/root/testdata/sf0.001"


def entry(path, rows=1):
    return manifest.Entry(path, rows)


def test_two_writers_never_share_a_number(spark, tmp_path):
    folder = str(tmp_path)

    def write(i):
        return manifest.commit(spark, folder, {f"t{i}": entry(f"{folder}/version-{i}/t{i}"), "shared": entry(f"{folder}/{i}")}).number

    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(write, range(24)))
    assert sorted(numbers) == list(range(1, 25))
    found = manifest.read_manifest(spark, folder)
    assert found.number == 24 and set(found.entries) == {f"t{i}" for i in range(24)} | {"shared"}
    assert found.entries["shared"].path == f"{folder}/{numbers.index(24)}"
    assert manifest.read_manifest(spark, folder, 3).number == 3
    assert not [p for p in (tmp_path / "manifest").iterdir() if p.suffix != ".json"]  # no drafts left


def test_a_file_is_published_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/a/1.json"
    assert manifest.publish(spark, "one", path) and not manifest.publish(spark, "two", path)
    assert Path(path).read_text() == "one"
    assert manifest.read_manifest(spark, f"{tmp_path}/none") == manifest.Manifest(0, {})
    with pytest.raises(ValueError, match="nothing is stored"):
        Warehouse.open(spark, f"{tmp_path}/none", AS_OF)


def test_partial_refreshes_keep_all_tables(spark, rows, tmp_path):
    folder, raw = str(tmp_path / "gold"), dict(landed(spark, FOLDER).items())
    w = Warehouse(spark, raw, AS_OF, SITE)
    tables = w.rebuild(folder)
    lines, items = tables["fct_ventas_items"].count(), tables["dim_producto"].count()
    sold = w.entries()["fct_ventas_items"]
    days = [r.fecha for r in tables["fct_ventas_items"].select("fecha").collect()]
    dated = sorted(d for d in days if d)
    assert (sold.rows, sold.undated, sold.first, sold.last) == (lines, len(days) - len(dated), str(dated[0]), str(dated[-1]))
    raw["izi_facturas"] = raw["izi_facturas"].limit(0)
    partial = Warehouse(spark, raw, AS_OF, SITE)
    assert list(partial.rebuild(folder, ["fct_ventas_items"])) == ["fct_ventas_items"]
    partial.rebuild(folder, ["dim_insumo_" + SITE.b])
    opened = Warehouse.open(spark, folder, AS_OF, SITE)
    assert opened.version == 3 and len(opened.entries()) == 45
    assert all(opened[name].columns for name in opened.names())
    assert opened["fct_ventas_items"].count() == 0 and opened["dim_producto"].count() == items
    before = Warehouse.open(spark, folder, AS_OF, SITE, version=1)
    assert before["fct_ventas_items"].count() == lines

    # Reports of an opened warehouse take the latest close from its entry.
    name, area, categories, measure = reports.AREAS["bebidas"]
    weekly = opened.gold(name)
    latest = opened.last_close(name, area)
    assert isinstance(latest, date) and latest == weekly.agg({"fecha_cierre": "max"}).first()[0]
    lazy = Warehouse(spark, landed(spark, FOLDER), AS_OF, SITE)
    assert lazy.last_close(name, area) == latest
    by_literal = reports.period_sales(weekly, measure, categories, latest=reports.latest_of(opened, name, area))
    assert rows(by_literal) == rows(reports.period_sales(weekly, measure, categories))
    assert by_literal._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2  # once in either plan shown

    opened.register("gold_test")
    listed = {r.tableName for r in sinks.list_tables(spark).filter("namespace = 'gold_test'").collect()}
    assert listed == set(opened.names())
    assert spark.table("gold_test.dim_producto").count() == items
    assert "_mes" not in spark.table("gold_test.fct_ventas_items").columns

    # Old versions go, once they are old enough; what the newest one still names stays.
    assert manifest.remove_unused(spark, folder) == []
    gone = Warehouse.remove_unused(spark, folder, hours=-1)
    assert any(p.endswith("/fct_ventas_items") for p in gone)
    again = Warehouse.open(spark, folder, AS_OF, SITE)
    assert again["dim_producto"].count() == items and again["fct_ventas_items"].count() == 0
    with pytest.raises(ValueError, match="no version 1"):
        Warehouse.open(spark, folder, AS_OF, SITE, version=1)
    spark.sql("DROP DATABASE gold_test CASCADE")
