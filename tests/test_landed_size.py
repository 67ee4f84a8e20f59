"""Landed files that queries write for themselves are a fraction of their text."""

import gzip
import json

import pytest

from cellarbook.plans import catalog
from cellarbook.sources import json_elements


@pytest.fixture
def folder(spark, tmp_path):
    """Till lines, one in fifty without keys."""
    spark.range(3000).selectExpr(
        "if(id % 50 = 7, NULL, id div 4) AS l_orderkey", "if(id % 50 = 9, NULL, id * 7 % 2000) AS l_partkey", "id % 90 AS l_suppkey",
        "cast(id % 7 + 1 AS int) AS l_linenumber", "cast(id % 50 + 1 AS double) AS l_quantity", "id * 37.25D AS l_extendedprice",
        "0.05D AS l_discount", "0.02D AS l_tax", "substr('ARN', cast(id % 3 + 1 AS int), 1) AS l_returnflag",
        "substr('OF', cast(id % 2 + 1 AS int), 1) AS l_linestatus", "timestamp'1999-01-01' + make_dt_interval(cast(id % 700 AS int)) AS l_shipdate",
    ).repartition(2).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.fixture
def scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: str(tmp_path / "scratch" / name))
    monkeypatch.setattr(catalog, "DOCUMENT_RECORDS", 400)
    return tmp_path / "scratch"


def _is_short(scratch, text: int, most_lines: int) -> None:
    files = [f for f in scratch.rglob("part-*") if f.is_file()]
    assert len(files) > 4 and sum(f.stat().st_size for f in files) < text / 4
    assert all(len(gzip.decompress(f.read_bytes()).splitlines()) <= most_lines for f in files)


def test_invoice_lines_are_compressed(spark, folder, scratch, rows):
    made = catalog.QUERIES["source_invoice_json"](spark, folder)
    invoices = catalog.landed(spark, folder)["izi_facturas"]
    text = invoices.selectExpr("sum(length(to_json(struct(*))))").head()[0]
    _is_short(scratch, text, 400)
    items = invoices.selectExpr("_negocio", "anulada", "explode(listaItems) AS i").groupBy("_negocio", "anulada", "i.articulo")
    want = items.agg({"i.cantidad": "sum", "i.precioTotal": "sum", "*": "count"}).count()
    assert made.count() == want and made.selectExpr("sum(n)").head()[0] == 6000


def test_a_landing_folder_is_compressed(spark, folder, scratch):
    made = catalog.QUERIES["source_landing_folder"](spark, folder)
    text = catalog.landed(spark, folder)["izi_facturas"].selectExpr("sum(length(to_json(struct(*))))").head()[0]
    _is_short(scratch, text, 400)
    assert sorted(map(str, made.collect())) == sorted(map(str, catalog.QUERIES["gold_fct_ventas_items"](spark, folder).collect()))
    assert made.count() > 1000


def test_documents_are_compressed_and_read_without_a_shuffle(spark, folder, scratch, monkeypatch):
    monkeypatch.setattr(catalog, "DOCUMENT_RECORDS", 200)
    monkeypatch.setattr(json_elements, "scratch_path", lambda spark, name: str(scratch / name))
    made = catalog.QUERIES["source_invoice_documents"](spark, folder)
    assert made.selectExpr("sum(n)").head()[0] == 6000
    text = catalog.landed(spark, folder)["izi_facturas"].selectExpr("sum(length(to_json(struct(*))))").head()[0]
    assert sum(f.stat().st_size for f in scratch.rglob("*") if f.is_file()) < text / 4
    texts = [gzip.decompress(f.read_bytes()).decode() for f in (scratch / "documents").glob("part-*.gz")]
    assert len(texts) >= 15 and all(0 < len(json.loads(t)["facturas"]) <= 200 for t in texts)
    lines = catalog.QUERIES["source_invoice_json"](spark, folder)
    assert sorted(map(str, made.collect())) == sorted(map(str, lines.collect()))
    read = json_elements.elements(spark, str(scratch / "documents"), "facturas")
    assert read.count() == 3000 and "Exchange" not in read._jdf.queryExecution().executedPlan().toString()


ODD = [
    '{"facturas": [{"a": "}]"}, {"b": [1, {"c": 2}]} ], "x": {"facturas": [{"d": 1}]}, "facturas" : [ {"e\\\\\\\\": "\\\\""}]}\n{"facturas": [{"f": 3}]}',
    '[{"facturas": [{"a": 1}]}, 5, {"b": "é\\\\"}, [{"c": 1}], {"d": {}}, null, {}]',
    '{"n": "facturas", "facturas": [null, {"a": "\\\\\\\\"}, {"open": [{"b": 1}, {"c": "not closed',
    "{}}}]]{{[\"}\" '}' \\\\} ]",
    "",
]


@pytest.mark.parametrize("member", [None, "facturas"])
def test_elements_are_the_same_however_files_are_split(spark, tmp_path, member):
    for i, text in enumerate(ODD):
        (tmp_path / f"{i}.json").write_text(text)
    settings = {"spark.sql.files.maxPartitionBytes": "23", "spark.sql.files.minPartitionNum": "64"}
    found = [json_elements.elements(spark, str(tmp_path), member).select("value").collect()]
    try:
        for limit in ("10m", "-1"):
            for name, value in {**settings, "spark.sql.autoBroadcastJoinThreshold": limit}.items():
                spark.conf.set(name, value)
            found.append(json_elements.elements(spark, str(tmp_path), member).select("value").collect())
    finally:
        for name in (*settings, "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
    assert len(found[0]) > 5 and sorted(found[0]) == sorted(found[1]) == sorted(found[2])
