"""JSON documents over several tasks."""

import json
import random

import pytest

from cellarbook.site import Site
from cellarbook.sources import readers, schemas
from cellarbook.sources.json_elements import elements

TEXTS = ["plain", 'a "quoted" word', "brace } and { and ]", "back\\slash\\", '\\"', "", "é}\n,", '"}"', "[{", "}}}}"]


@pytest.fixture(params=[None, 61, 700])
def split(request, spark):
    """Scans of whole files, and of many small parts."""
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.minPartitionNum")


def items(n, seed=1):
    rng = random.Random(seed)
    return [
        {"codigo": f"{i}", "nombre": rng.choice(TEXTS) + rng.choice(TEXTS), "categoria": {"nombre": rng.choice(TEXTS)}, "precioUnitario": i / 4}
        for i in range(n)
    ]


@pytest.mark.parametrize("indent", [None, 1])
def test_array_elements(spark, tmp_path, split, indent):
    given = items(200)
    (tmp_path / "a.json").write_text(json.dumps(given, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text("﻿" + json.dumps([{**x, "codigo": "b" + x["codigo"]} for x in given[:9]]))
    (tmp_path / "c.json").write_text("[ ]\n")
    if split:
        assert elements(spark, str(tmp_path / "a.json")).select("_at._block").distinct().count() > 8
    read = readers.read_json_array(spark, str(tmp_path), schemas.ITEM_MASTER)
    got = {r.codigo: r for r in read.collect()}
    assert len(got) == read.count() == 209 and all(r[readers.CORRUPT] is None for r in got.values())
    for x in given:
        r = got[x["codigo"]]
        assert (r.nombre, r.categoria.nombre, r.precioUnitario) == (x["nombre"], x["categoria"]["nombre"], x["precioUnitario"])


def test_bad_elements_are_kept(spark, tmp_path, split):
    good = json.dumps(items(30))[1:-1]
    (tmp_path / "a.json").write_text(f'[{good}, {{"codigo": x}}, {good}]')
    (tmp_path / "b.json").write_text(f'[{good}, {{"codigo": "cut", "nombre": "sh')
    (tmp_path / "c.json").write_text("no json at all")
    read = readers.read_json_array(spark, str(tmp_path), schemas.ITEM_MASTER)
    bad = sorted(r[0] for r in read.select(readers.CORRUPT).collect() if r[0])
    assert bad == ["no json at all", '{"codigo": "cut", "nombre": "sh', '{"codigo": x}']
    assert readers.read_json_array(spark, str(tmp_path), schemas.ITEM_MASTER, keep_bad=False).count() == 90


def test_invoices_of_a_document(spark, tmp_path, split):
    rng, site = random.Random(2), Site("Alpha", "beTa")
    bills = [
        {
            "sucursal": rng.choice([79344, 81761]),
            "fechaPago": "2024-01-02T03:30:00",
            "anulada": i % 2,
            "montoTotal": i / 2,
            "listaItems": [{"articulo": rng.choice(TEXTS), "cantidad": k, "codigoInventario": "C", "precioTotal": 1.5} for k in range(i % 4)],
        }
        for i in range(120)
    ]
    (tmp_path / "a.json").write_text(json.dumps({"n": [3], "k": ["facturas", [1]], "meta": {"facturas": 1, "x": [{"y": "]"}]}, "facturas": bills[:70], "otros": [{"sucursal": 1}], "z": {}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"facturas": bills[70:]}))
    (tmp_path / "c.json").write_text(json.dumps({"facturas": []}))
    read = readers.read_invoices(spark, [str(tmp_path / f"{n}.json") for n in "abc"], site)
    whole = readers.spread_invoices(spark.read.schema(schemas.INVOICE_DOCUMENT).option("multiLine", True).json(str(tmp_path)), site)
    columns = [c for c in whole.columns if c != "_extraido_en"]
    assert read.columns == whole.columns
    assert sorted(map(str, read.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    assert read.count() == 120
