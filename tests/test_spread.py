"""Shuffles and documents grow in number with the input."""

import json

import pytest
from pyspark.sql import functions as F

from cellarbook.operators import flows, periods, recipes, reconcile
from cellarbook.plans import catalog


def test_counts_are_dealt_over_tasks_by_what_is_read(spark, tmp_path, monkeypatch):
    sheet = spark.range(2000).select(
        F.concat(F.lit("Item "), F.col("id")).alias("producto"), F.lit("c").alias("categoria"),
        F.date_add(F.lit("2024-01-07").cast("date"), F.pmod("id", F.lit(9)).cast("int")).alias("fecha"), F.col("id").cast("double").alias("cantidad"),
    )
    sheet.write.parquet(str(tmp_path / "counts"))
    counts = spark.read.parquet(str(tmp_path / "counts"))
    few = periods.count_periods(counts, "producto", ["categoria"])
    monkeypatch.setattr(periods, "SHEET_BYTES", 512)
    many = periods.count_periods(counts, "producto", ["categoria"])
    assert few.rdd.getNumPartitions() <= 8 < many.rdd.getNumPartitions()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_more_records_are_written_as_more_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "DOCUMENT_RECORDS", 20)
    records = spark.range(300).select(F.format_string('{"a": %d}', "id").alias("value"))
    catalog._write_documents(records, str(tmp_path / "made"), '{"version": [1], "facturas": [', "]}")
    texts = [p.read_text() for p in (tmp_path / "made").glob("_file=*/*.txt")]
    assert len(texts) == 15
    assert sorted(f["a"] for t in texts for f in json.loads(t)["facturas"]) == list(range(300))


def _daily(spark, area, tmp_path):
    """Counts of names in two spellings, some for two codes, and flows on every third day."""
    day = F.date_add(F.lit("2024-01-07").cast("date"), F.pmod("id", F.lit(40)).cast("int"))
    counts = spark.range(400).select(
        F.concat(F.when(F.col("id") % 2 == 0, "Item ").otherwise("ITEM "), (F.col("id") % 7).cast("string")).alias("producto"),
        F.concat(F.lit("C"), F.col("id") % 11).alias("cod_producto"), (F.col("id") % 3).cast("string").alias("categoria"),
        day.alias("fecha"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("cantidad"),
    )
    counts.write.parquet(str(tmp_path / "counts"))
    counts = spark.read.parquet(str(tmp_path / "counts"))
    key = F.concat(F.lit("ITEM "), F.col("id") % 7) if area.upper else F.concat(F.lit("C"), F.col("id") % 11)
    rows = spark.range(300).select(key.alias("k"), F.date_add(F.lit("2024-01-05").cast("date"), (F.col("id") % 50).cast("int")).alias("fecha"), F.col("id").alias("cantidad"))
    days = reconcile.area_flow_days({name: flows.flow_rows(rows, "k") for name in area.flows}, area)
    made = reconcile.labelled(periods.count_periods(counts, area.key, area.carry))
    return made, days, reconcile.reconcile_days(made, days, area, "2024-02-20", counts=counts)


@pytest.mark.parametrize("area", [reconcile.DRINKS_A, reconcile.DRINKS_B])
def test_days_of_periods_are_made_after_the_shuffles(spark, tmp_path, monkeypatch, area):
    monkeypatch.setattr(periods, "SHEET_BYTES", 512)
    for module in (flows, reconcile):
        monkeypatch.setattr(module, "LINE_BYTES", 512)
    made, days, daily = _daily(spark, area, tmp_path)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("sequence(")], plan
    # By comparing each day of each period with each day of flows.
    spread_out = reconcile.days_of_periods(made, "2024-02-20").collect()
    flow = {(r[flows.KEY], r[flows.DAY]): r.compras for r in days.collect()}
    name = (lambda r: r.producto.upper()) if area.upper else (lambda r: r.cod_producto)
    wanted = sorted((r.producto, r.semana, r.fecha, flow.get((name(r), r.fecha)) or 0.0) for r in spread_out)
    assert sorted((r.producto, r.semana, r.fecha, r.compras) for r in daily.collect()) == wanted and wanted


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_ingredient_use_is_dealt_over_tasks_by_what_is_read(spark, tmp_path, monkeypatch, limit):
    day = F.date_add(F.lit("2024-01-07").cast("date"), F.pmod("id", F.lit(9)).cast("int"))
    code = F.when(F.col("id") % 50 > 0, F.concat(F.lit("C"), F.col("id") % 40))
    rows = spark.range(2000).select(day.alias("fecha"), code.alias("codigo_inventario"), (F.col("id") % 6).cast("double").alias("cantidad"))
    rows.write.parquet(str(tmp_path / "sales"))
    sales = spark.read.parquet(str(tmp_path / "sales"))
    lines = [(f"C{i % 45}", "dish", f"N{i}" if i % 4 else "", f"Insumo {i % 12}", 0.5 * (i % 3)) for i in range(90)]
    kinds = "cod_producto string, producto string, cod_insumo string, insumo string, cantidad double"
    spark.createDataFrame(lines, kinds).coalesce(1).write.parquet(str(tmp_path / "recipe"))
    recipe = spark.read.parquet(str(tmp_path / "recipe"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        few = recipes.ingredient_use_per_day(sales, recipe, own_code_only=True)
        monkeypatch.setattr(recipes, "LINE_BYTES", 512)
        many = recipes.ingredient_use_per_day(sales, recipe, own_code_only=True)
        assert few.rdd.getNumPartitions() <= 8 < many.rdd.getNumPartitions()
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
        assert many.count() == sum(1 for c, _, n, _, _ in lines if n for r in sales.select("codigo_inventario", "fecha").distinct().collect() if r[0] == c)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
