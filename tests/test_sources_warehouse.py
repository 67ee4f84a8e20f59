"""Readers and writers on files, and the datasets end to end."""

import json
from datetime import date

import pytest

from cellarbook.plans import quality
from cellarbook.plans.bindings import AS_OF, SITE, landed
from cellarbook.plans.catalog import QUERIES, settle
from cellarbook.plans.warehouse import Warehouse
from cellarbook.site import Site
from cellarbook.sources import readers, schemas, sinks
from cellarbook.sources.landing import Landing

FOLDER = "/root/testdata/sf0.001"


def test_invoice_documents(spark, rows, tmp_path):
    item = {"articulo": "Ron", "cantidad": 1, "codigoInventario": "C1", "precioTotal": 5.5}
    one = {"sucursal": 79344, "fechaPago": "2024-01-02T03:30:00", "anulada": 0, "montoTotal": 5.5, "listaItems": [item, item]}
    (tmp_path / "a.json").write_text(json.dumps({"facturas": [one, {**one, "anulada": 1}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"facturas": [{"sucursal": 81761, "anulada": 0, "listaItems": [item]}]}))
    site = Site("Alpha", "beTa")
    invoices = readers.read_invoices(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], site)
    assert rows(invoices, "_negocio", "anulada", "montoTotal") == [("Alpha", 0, 5.5), ("Alpha", 1, 5.5), ("beTa", 0, None)]
    w = Warehouse(spark, {"izi_facturas": invoices}, date(2024, 1, 31), site)
    assert rows(w["fct_ventas_items"], "fecha", "producto", "negocio") == sorted(
        [(date(2024, 1, 1), "Ron", "Alpha")] * 2 + [(None, "Ron", "beTa")], key=lambda t: tuple(map(str, t))
    )


def test_json_arrays_with_bad_records(spark, rows, tmp_path):
    good = [{"codigo": "1", "nombre": "a", "categoria": {"nombre": "X"}}, {"codigo": "2", "nombre": "b"}]
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text('[{"codigo": "3", ')
    read = readers.read_json_array(spark, str(tmp_path / "good.json"), schemas.ITEM_MASTER)
    assert rows(read, "codigo", "categoria.nombre") == [("1", "X"), ("2", None)]
    assert "_extraido_en" in read.columns
    both = [str(tmp_path / "good.json"), str(tmp_path / "bad.json")]
    assert readers.read_json_array(spark, both, schemas.ITEM_MASTER, keep_bad=False).count() == 2
    kept = readers.read_json_array(spark, both, schemas.ITEM_MASTER)
    assert rows(quality.rejected_records({"items": (kept, "codigo")})) == [("items", 3, 2, 1)]
    assert [bad is None for _, bad in rows(kept, "codigo", readers.CORRUPT)] == [True, True, False]


def test_csv_with_and_without_junk_rows(spark, rows, tmp_path):
    (tmp_path / "plain.csv").write_text('Cod,"Nombre, largo",N\n1,"a, b",2\n2,,\n')
    plain = readers.read_csv(spark, str(tmp_path / "plain.csv"))
    assert plain.columns == ["Cod", "Nombre, largo", "N"] and rows(plain) == [("1", "a, b", "2"), ("2", None, None)]
    folder = tmp_path / "sheets"
    folder.mkdir()
    for i in range(3):
        body = "".join(f'{i}{k},"x, y",{k}\n' for k in range(5))
        (folder / f"{i}.csv").write_text(f"junk {i}\nmore junk\nCod,Producto,N\n{body}")
    skipped = readers.read_csv(spark, str(folder), ["Cod", "Producto", "N"], skip=2)
    assert rows(skipped) == sorted((f"{i}{k}", "x, y", str(k)) for i in range(3) for k in range(5))
    assert readers.read_csv(spark, str(folder / "0.csv"), skip=2).columns == ["Cod", "Producto", "N"]


def test_first_block_of_a_stacked_sheet(spark, rows, tmp_path):
    path = tmp_path / "blocks.csv"
    path.write_text(
        "Estimates 2024,,\n,,\nEmpresa,Fecha,Bs\nAlpha,2024-01-01,1\nAlpha,,2\nbeta,2024-01-03,3\n,,\nEmpresa,Fecha,Bs\nGamma,2024-02-01,9\n"
    )
    got = readers.read_first_block(spark, str(path), ["Empresa", "Fecha", "Bs"], "Fecha", "Gastos Aproximados")
    assert rows(got) == [("Alpha", "2024-01-01", "1", "Gastos Aproximados"), ("beta", "2024-01-03", "3", "Gastos Aproximados")]
    path.write_text("Empresa,Fecha,Bs\nAlpha,2024-01-01,1\n")
    assert readers.read_first_block(spark, str(path), ["Empresa", "Fecha", "Bs"], "Fecha", "x").count() == 1


def test_tables_are_replaced_and_exports_keep_all_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(10), path)
    assert sinks.write_table(spark.range(3), path).count() == 3
    report = spark.sql("SELECT id, IF(id % 2 = 0, 0D, 1.5D) AS diferencia FROM range(0, 1000, 1, 4)")
    sinks.export_csv(sinks.with_difference_flag(report), str(tmp_path / "out"))
    back = readers.read_csv(spark, str(tmp_path / "out"), ["id", "diferencia", "has_diff"])
    assert back.count() == 1000 and back.filter("has_diff = 'true'").count() == 500
    sinks.create_view(report, "some_report")
    assert sinks.list_tables(spark).filter("tableName = 'some_report'").count() == 1
    assert sinks.sample_rows(report).count() == 50


@pytest.mark.parametrize("chosen", [("fct_estados_resultados", f"fct_reconciliacion_insumos_{SITE.b}_diario")])
def test_rebuilt_tables_equal_the_lazy_ones(spark, rows, tmp_path, chosen):
    lazy = Warehouse(spark, landed(spark, FOLDER), AS_OF, SITE)
    stored = Warehouse(spark, landed(spark, FOLDER), AS_OF, SITE)
    tables = stored.rebuild(str(tmp_path / "gold"))
    assert len(tables) == 45
    for name in chosen:
        assert tables[name].count() == lazy[name].count()
        assert "FileScan" in tables[name]._jdf.queryExecution().toString()


def test_refresh_may_be_repeated_and_follows_the_raw_tables(spark, rows, tmp_path):
    folder, only = str(tmp_path / "gold"), ["fct_ventas_items", "dim_producto"]
    raw = dict(landed(spark, FOLDER).items())
    w = Warehouse(spark, raw, AS_OF, SITE)
    first = w.rebuild(folder, only)
    before, lines = first["fct_ventas_items"], first["fct_ventas_items"].count()
    assert w.rebuild(folder, only)["fct_ventas_items"].count() == lines > 0
    raw["izi_facturas"] = raw["izi_facturas"].limit(0)
    assert w.rebuild(folder, only)["fct_ventas_items"].count() == 0
    assert before.count() == lines  # whoever reads the version before keeps it
    opened = Warehouse.open(spark, folder, AS_OF, SITE)
    assert opened["fct_ventas_items"].count() == 0 and opened["fct_ventas_items"].columns == before.columns
    raw["izi_facturas"] = spark.range(1)  # a refresh that fails changes nothing
    with pytest.raises(Exception, match="."):
        w.rebuild(folder, only)
    assert Warehouse.open(spark, folder, AS_OF, SITE)["fct_ventas_items"].count() == 0


def test_stored_dates_are_pruned_by_month(spark, rows, tmp_path):
    w = Warehouse(spark, landed(spark, FOLDER), AS_OF, SITE)
    lazy = w.between("fct_ventas_items", "2024-01-15", "2024-02-20")
    want = rows(lazy)
    w.rebuild(str(tmp_path / "gold"), ["fct_ventas_items"])
    stored = w.between("fct_ventas_items", "2024-01-15", "2024-02-20")
    assert rows(stored) == want and len(want) > 0
    assert "PartitionFilters: [isnotnull(_mes" in stored._jdf.queryExecution().toString()


def test_sheets_in_any_number_of_files(spark, rows, tmp_path):
    parts = spark.read.parquet(f"{FOLDER}/part.parquet")
    want = None
    for files in (1, 4, 20):
        folder = str(tmp_path / str(files))
        parts.repartition(files).write.parquet(f"{folder}/part.parquet")
        got = [rows(QUERIES[name](spark, folder)) for name in ("source_csv_skip_rows", "source_first_block")]
        want = want or got
        assert got == want and len(got[0]) == parts.count()


def test_landing_folder(spark, rows, tmp_path):
    item = {"articulo": "Ron", "cantidad": 1, "codigoInventario": "C1", "precioTotal": 5.5}
    bill = {"sucursal": 79344, "fechaPago": "2024-01-02T13:30:00", "anulada": 0, "montoTotal": 5.5, "listaItems": [item]}
    (tmp_path / "izi_facturas.json").write_text(json.dumps({"facturas": [bill]}))
    (tmp_path / "izi_items_inventario.json").write_text('[{"codigo": "C1", "nombre": "Ron"}]')
    (tmp_path / "relacion_copa_vino.csv").write_text("junk,,\nProducto,Botella,Cod Botella\nCopa,Vino,V1\n")
    (tmp_path / "salidas_mermas_a.csv").write_text("Fecha,Producto,Peso\n01-Feb-2024,Ron,2\n")
    (tmp_path / "gastos_aproximados.csv").write_text(",".join(schemas.ESTIMATES) + "\nAlpha,2024-01-01,,,,,,5,1\n,,,,,,,,\nX,2024-01-01,,,,,,5,1\n")
    raw = Landing(spark, str(tmp_path), Site("Alpha", "beTa"), ("izi_facturas", "relacion_copa_vino"))
    assert rows(raw["relacion_copa_vino"]) == [("Copa", "Vino", "V1")] and list(raw) == ["izi_facturas", "relacion_copa_vino"]
    assert raw["salidas_mermas_a"].columns == ["Fecha", "Producto", "Peso"] and raw["gastos_aproximados"].count() == 1
    w = Warehouse(spark, raw, date(2024, 1, 31), Site("Alpha", "beTa"))
    assert rows(w["fct_ventas_items"], "fecha", "producto", "negocio") == [(date(2024, 1, 2), "Ron", "Alpha")]


def test_rounding_keeps_large_and_special_values(spark):
    df = spark.sql("SELECT 2e15D a, double('NaN') b, double('-Infinity') c, 1.00005D d, 3 e")
    got = settle(df).first()
    assert got.a == 2e15 and got.b != got.b and got.c == float("-inf") and got.d == 1.0001 and got.e == 3
