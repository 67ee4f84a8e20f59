"""Readers for landed JSON documents, CSV sheets and stacked-block sheets."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarbook.site import Site
from cellarbook.sources.json_elements import elements, parsed
from cellarbook.sources.records import BLOCK, CSV, FILE, LINE, records
from cellarbook.sources.schemas import INVOICE_DOCUMENT

CORRUPT = "_corrupt_record"


def spread_invoices(documents: DataFrame, site: Site, loaded_at: Column | None = None) -> DataFrame:
    """Documents with a root array `facturas` -> one row per invoice with its unit and load time."""
    invoices = documents.select(F.explode("facturas").alias("f")).select("f.*")
    unit = None
    for branch, name in site.unit_of_branch().items():
        test = F.col("sucursal") == branch
        unit = F.when(test, name) if unit is None else unit.when(test, name)
    stamp = F.current_timestamp() if loaded_at is None else loaded_at
    return invoices.withColumn("_negocio", unit).withColumn("_extraido_en", stamp)


def read_invoices(
    spark: SparkSession, paths: Sequence[str], site: Site, schema: str = INVOICE_DOCUMENT, lines: bool = False
) -> DataFrame:
    """Nested invoice documents of all units as one; a column missing in one file is NULL there.

    With `lines` every line is a document. Otherwise a file is one, whose invoices are found in all parts of it
    by the tasks that scan them (`json_elements`). Invoices that do not parse are left out.
    """
    if lines:
        return spread_invoices(spark.read.schema(schema).json(list(paths)), site)
    invoice = T.StructType.fromDDL(schema)["facturas"].dataType.elementType
    found = parsed(elements(spark, list(paths), "facturas"), invoice.simpleString().removeprefix("struct<").removesuffix(">"), CORRUPT)
    documents = found.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return spread_invoices(documents.select(F.array(F.struct(*documents.columns)).alias("facturas")), site)


def read_json_array(
    spark: SparkSession, paths: str | Sequence[str], schema: str, keep_bad: bool = True, lines: bool = False
) -> DataFrame:
    """JSON arrays (or, with `lines`, one record per line) with a load time.

    An array's records are found in all parts of its file by the tasks that scan them. Records that do not parse
    are kept in `_corrupt_record` with NULLs elsewhere, and `plans.quality.rejected_records` counts them;
    `keep_bad=False` drops them.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if lines:
        full = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
        read = spark.read.schema(full).options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).json(paths)
        if not keep_bad:
            read = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    else:
        read = parsed(elements(spark, paths), schema, CORRUPT)
        if not keep_bad:
            read = read.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return read.withColumn("_extraido_en", F.current_timestamp())


def _cells(header: str) -> list[str]:
    """Names in a header record; empty ones and repeats are told apart by their place."""
    cells = next(csv.reader(io.StringIO(header, newline="")), [])
    names = [cell or f"column{i}" for i, cell in enumerate(cells)]
    return [n if names.count(n) == 1 else f"{n}{i}" for i, n in enumerate(names)]


def _from_csv(names: Sequence[str]) -> Column:
    return F.from_csv("value", ", ".join(f"`{c.replace('`', '``')}` STRING" for c in names), CSV)


def csv_header(spark: SparkSession, path: str, skip: int = 0) -> list[str]:
    """Header cells of a sheet: the record after `skip` junk rows."""
    return _cells(_with_header(records(spark, path), skip)[1][0])


def _with_header(rows: DataFrame, skip: int) -> tuple[DataFrame, list[str]]:
    """(records below the header of their file with `_header`, the different headers)."""
    place = F.struct(BLOCK, LINE)
    first = rows.filter(F.col(BLOCK) == 0).select("value", FILE, place.alias("_at"))
    heads = first.groupBy(FILE).agg(F.min(F.struct("_at", "value")).alias("_head"))
    for _ in range(skip):
        later = first.join(heads, FILE).filter(F.col("_at") > F.col("_head._at"))
        heads = later.groupBy(FILE).agg(F.min(F.struct("_at", "value")).alias("_head"))
    heads = heads.select(FILE, F.col("_head._at").alias("_top"), F.col("_head.value").alias("_header"))
    body = rows.join(heads, FILE).filter((place > F.col("_top")) & (F.col("value") != ""))
    return body, [r[0] for r in heads.select("_header").distinct().orderBy("_header").collect()]


def read_csv(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, skip: int = 0
) -> DataFrame:
    """CSV with a header, all columns as text; `skip` junk rows above the header of each file.

    Doubled quotes and line breaks inside quotes belong to their cell (`records`). Columns go by the names in
    the header of each file: where headers differ, a column that a file lacks is NULL there. `columns` gives
    names by place instead, to all files alike. Empty lines are left out; no files with a header give an error.
    """
    body, headers = _with_header(records(spark, path), skip)
    if columns:
        return body.select(_from_csv(columns).alias("r")).select("r.*")
    if not headers:
        raise ValueError(f"no header in {path}")
    named = {h: _cells(h) for h in headers}
    if len(named) == 1:
        return body.select(_from_csv(named[headers[0]]).alias("r")).select("r.*")
    places = [f"c{i}" for i in range(max(map(len, named.values())))]
    cells = body.select("_header", _from_csv(places).alias("r"))

    def cell(name: str) -> Column:
        out = F.lit(None).cast("string")
        for header, names in named.items():
            if name in names:
                out = F.when(F.col("_header") == header, F.col("r")[f"c{names.index(name)}"]).otherwise(out)
        return out.alias(name)

    return cells.select(*[cell(name) for name in dict.fromkeys(n for names in named.values() for n in names)])


def first_block(
    rows: DataFrame, group: Sequence[str], position: Column, is_header: Column, is_blank: Column
) -> DataFrame:
    """Rows after the first header row of each group and before the next blank row.

    Both limits are minima over the position, which combine on the map side; no group is sorted or
    gathered. Groups without a header give nothing.
    """
    placed = rows.withColumn("_at", position).withColumn("_blank", is_blank).withColumn("_head", is_header)
    heads = placed.filter("_head").groupBy(*group).agg(F.min("_at").alias("_from"))
    after = placed.join(heads, list(group)).filter(F.col("_at") > F.col("_from"))
    ends = after.filter("_blank").groupBy(*group).agg(F.min("_at").alias("_to"))
    block = after.join(ends, list(group), "left").filter(F.col("_to").isNull() | (F.col("_at") < F.col("_to")))
    return block.drop("_at", "_blank", "_head", "_from", "_to")


def read_first_block(
    spark: SparkSession, path: str, columns: Sequence[str], required: str, label: str, label_column: str = "Cuenta"
) -> DataFrame:
    """First block of a sheet in which several blocks are stacked, separated by blank rows.

    The header row is the one whose first cell is the first of `columns`. Rows without `required` are
    dropped, and the block is tagged with the account it stands for.
    """
    lines = records(spark, path).withColumn("r", _from_csv(columns))
    blank = F.translate(F.coalesce("value", F.lit("")), ", \t\r\"", "") == ""
    header = F.coalesce(F.col("r").getField(columns[0]) == columns[0], F.lit(False))
    block = first_block(lines, [FILE], F.struct(BLOCK, LINE), header, blank)
    return (
        block.select("r.*")
        .filter(F.col(f"`{required}`").isNotNull())
        .withColumn(label_column, F.lit(label))
    )
