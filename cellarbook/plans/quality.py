"""Checks that say how much a rule drops or repeats, instead of stopping the run."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarbook.functions.text import not_blank
from cellarbook.sources.readers import CORRUPT


def rejected_dates(tables: Mapping[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """Per table: rows with a date text, and how many of those do not parse (text, parsed)."""
    counts = [
        df.agg(
            F.count_if(not_blank(text)).alias("con_fecha"),
            F.count_if(not_blank(text) & parsed.isNull()).alias("rechazadas"),
        ).select(F.lit(name).alias("tabla"), "con_fecha", "rechazadas")
        for name, (df, text, parsed) in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def rejected_records(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per table read with its bad records kept, and its key column: rows, those with a key, and those that did not parse."""
    counts = [
        df.agg(
            F.count(F.lit(1)).alias("filas"), F.count(key).alias("con_clave"), F.count_if(F.col(CORRUPT).isNotNull()).alias("rechazadas")
        ).select(F.lit(name).alias("tabla"), "filas", "con_clave", "rechazadas")
        for name, (df, key) in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def repeated_keys(side: DataFrame, key: str) -> DataFrame:
    """Keys of a join side that repeat rows of the other side, and how often."""
    counted = side.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("filas"))
    return counted.filter("filas > 1")


def unmatched_lines(sales: DataFrame, items: DataFrame) -> DataFrame:
    """Sale lines, and those whose code is not in the item master."""
    codes = items.select("codigo_inventario", F.lit(True).alias("_known")).filter(F.col("codigo_inventario").isNotNull())
    per_code = sales.groupBy("codigo_inventario").agg(F.count(F.lit(1)).alias("_n"))
    joined = per_code.join(codes, "codigo_inventario", "left")
    return joined.agg(
        F.sum("_n").alias("lineas"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("sin_maestro"),
    )
