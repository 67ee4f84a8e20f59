"""Writers: full-refresh tables, views, text exports and the list of tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellarbook.sources.manifest import Entry


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace the Parquet table at `path` and return it as read back, with its lineage cut."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


MONTH = "_mes"


def _month(day: str) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none"))


def stored_by_month(df: DataFrame, path: str) -> tuple[DataFrame, Entry]:
    """Write a table, in one folder per month where it has a date `fecha`: (the table as read back, its entry).

    Rows and dates are counted while they are written.
    """
    dates = [c for c, kind in df.dtypes if kind == "date" and c in ("fecha", "fecha_cierre")]
    day = dates[0] if dates else None
    metrics = [F.count(F.lit(1)).alias("rows")]
    if day:
        metrics += [F.count_if(F.col(day).isNull()).alias("undated"), F.min(day).alias("first"), F.max(day).alias("last")]
    seen = Observation()
    watched = df.observe(seen, *metrics)
    by_month = day == "fecha"
    if by_month:
        months = watched.withColumn(MONTH, _month(day))
        months.write.mode("overwrite").option("compression", "zstd").partitionBy(MONTH).parquet(path)
    else:
        write_table(watched, path)
    found = seen.get
    entry = Entry(path, found["rows"], found.get("undated"), *[d and d.isoformat() for d in (found.get("first"), found.get("last"))])
    if by_month and not found["rows"]:
        # Without rows there is no month and no file that tells the columns.
        write_table(df.limit(0), path)
    return read_stored(df.sparkSession, path), entry


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """A table that `stored_by_month` wrote."""
    return spark.read.parquet(path).drop(MONTH)


def new_version(folder: str) -> str:
    """Path of a version that nobody reads yet."""
    return f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"


def create_view(df: DataFrame, name: str) -> None:
    """A live view: nothing is stored, and it follows the table behind it."""
    df.createOrReplaceTempView(name)


def export_csv(df: DataFrame, path: str) -> None:
    """Publish a report as CSV with a header, one file per partition; no task sees all of it.

    A quote inside a cell is doubled, as sheets expect it.
    """
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def with_difference_flag(report: DataFrame) -> DataFrame:
    """Data behind the grey/orange marking: whether counted and expected stock differ."""
    return report.withColumn("has_diff", F.col("diferencia") != 0)


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the tables and views of all databases; those of the session alone have no database."""
    listed = [spark.sql(f"SHOW TABLES IN `{d.name}`") for d in spark.catalog.listDatabases()]
    return reduce(DataFrame.union, listed).distinct()


def sample_rows(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first rows of a table, for a look at it."""
    return df.limit(rows)
