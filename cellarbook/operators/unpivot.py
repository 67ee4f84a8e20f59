"""Wide count sheets to long rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.functions.dates import sheet_header_date
from cellarbook.functions.numbers import count_cell

SHEET_IDS = {"Categoria": "categoria", "Producto": "producto", "Cod Producto": "cod_producto"}
CURRENT_FLAG = "Vigente"


def count_range(*sheets: DataFrame) -> tuple[date, date] | None:
    """First and last count date of the sheets, read from their headers alone."""
    days = [day for sheet in sheets for day in map(sheet_header_date, sheet.columns) if day is not None]
    return (min(days), max(days)) if days else None


def unpivot_counts(sheet: DataFrame, value: str = "cantidad", only_current: bool = False) -> DataFrame:
    """One row per item and count date.

    The date columns are found from the header, that is from the schema and without a job. Columns that
    name no date are dropped before the scan, so Parquet never reads them. Id columns may be missing.
    """
    if only_current and CURRENT_FLAG in sheet.columns:
        sheet = sheet.filter(F.col(CURRENT_FLAG) == "Si")
    ids = [c for c in SHEET_IDS if c in sheet.columns]
    dated = [(c, sheet_header_date(c)) for c in sheet.columns if c not in ids and c != CURRENT_FLAG]
    dated = [(c, day) for c, day in dated if day is not None]
    out_ids = [F.col(f"`{c}`").alias(SHEET_IDS[c]) for c in ids]
    if not dated:
        empty = [F.lit(None).cast("date").alias("fecha"), F.lit(None).cast("double").alias(value)]
        return sheet.select(empty[0], *out_ids, empty[1]).limit(0)
    cells = sheet.select(*out_ids, *[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, (c, _) in enumerate(dated)])
    days = F.create_map(*[x for i, (_, day) in enumerate(dated) for x in (F.lit(f"_{i}"), F.lit(day))])
    names = [SHEET_IDS[c] for c in ids]
    long = cells.unpivot(names, [f"_{i}" for i in range(len(dated))], "_header", "_cell")
    return long.select(days[F.col("_header")].alias("fecha"), *names, count_cell(F.col("_cell")).alias(value))


def unpivot_columns(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)
