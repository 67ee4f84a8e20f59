"""Count-to-count periods.

A period of an item runs from one physical count (excluded) to the next one (included). The item's last
known count opens a period without a closing count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarbook.operators.joins import spread

OPEN_DAYS = 7
#: Bytes of count sheets whose counts one task puts in order: a sheet is one column a date, so they are many rows.
SHEET_BYTES = 64 << 10


def average_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Several counts of one item on one day become their mean."""
    return counts.groupBy(*keys, "fecha").agg(F.avg("cantidad").alias("cantidad"))


def _counts_in_order(counts: DataFrame, key: str, carry: Sequence[str], one_per_day: bool) -> DataFrame:
    """Each distinct count with its number, the count before it, and the item's last known count.

    Equal counts are one row here, so the window over an item is as long as it has different counts. It is
    read in order, so its rows may be more than memory holds. Tasks grow in number with the sheets.
    """
    counts = spread(counts, [key], SHEET_BYTES)
    if one_per_day:
        distinct = counts.select(key, *carry, "fecha", "cantidad", F.lit(1).cast("bigint").alias("_copies"))
    else:
        distinct = counts.groupBy(key, *carry, "fecha", "cantidad").agg(F.count(F.lit(1)).alias("_copies"))
    item = Window.partitionBy(key)
    in_order = item.orderBy("fecha", F.col("cantidad").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in carry])
    itself = F.struct("fecha", "cantidad", *carry)
    return distinct.select(
        "*",
        F.lag("fecha").over(in_order).alias("_day_before"),
        F.lag("cantidad").over(in_order).alias("_before"),
        F.max(F.when(F.col("cantidad").isNotNull(), itself)).over(item).alias("_latest"),
        itself.alias("_itself"),
    )


def _period(start, end, opening, closing) -> Column:
    return F.struct(
        start.alias("fecha_inicio"), end.alias("fecha_cierre"), opening.alias("inv_inicial"), closing.cast("double").alias("cierre")
    )


def _from_counts(counts: DataFrame, key: str, carry: Sequence[str], one_per_day: bool, closed: bool, days: int | None) -> DataFrame:
    """Every count gives the periods that end or begin with it, from one pass over the counts in order."""
    day, quantity = F.col("fecha"), F.col("cantidad")
    nothing = F.array().cast("array<struct<fecha_inicio: date, fecha_cierre: date, inv_inicial: double, cierre: double>>")
    made = []
    if closed:
        known = quantity.isNotNull()
        ends = F.array(_period(F.col("_day_before"), day, F.col("_before").cast("double"), quantity))
        again = F.array_repeat(_period(day, day, quantity.cast("double"), quantity), (F.col("_copies") - 1).cast("int"))
        made += [F.when(known & F.col("_day_before").isNotNull(), ends).otherwise(nothing), F.when(known, again).otherwise(nothing)]
    if days is not None:
        begins = F.array(_period(day, F.date_add(day, days), quantity.cast("double"), F.lit(None)))
        made.append(F.when(F.col("_itself").eqNullSafe(F.col("_latest")), begins).otherwise(nothing))
    rows = _counts_in_order(counts, key, carry, one_per_day)
    return rows.select(key, *carry, F.explode(F.concat(*made)).alias("_p")).select(key, *carry, "_p.*")


def closed_periods(counts: DataFrame, key: str, carry: Sequence[str] = (), one_per_day: bool = False) -> DataFrame:
    """Periods with a closing count.

    Several counts of one item on one day are taken in order of quantity, each but the first closing an
    empty period; of equal counts each but the first as well. `one_per_day` says that there are none.
    """
    return _from_counts(counts, key, carry, one_per_day, True, None)


def open_periods(counts: DataFrame, key: str, carry: Sequence[str] = (), days: int = OPEN_DAYS) -> DataFrame:
    """The last known count of each item starts a period of `days` days that nothing closes yet."""
    return _from_counts(counts, key, carry, False, False, days)


def count_periods(counts: DataFrame, key: str, carry: Sequence[str] = (), one_per_day: bool = False) -> DataFrame:
    """Closed and open periods, in one pass."""
    return _from_counts(counts, key, carry, one_per_day, True, OPEN_DAYS)


def last_close(counts: DataFrame) -> DataFrame:
    """One row: the latest closing date of all periods, which is that of the last known count's open one."""
    known = F.when(F.col("cantidad").isNotNull(), F.col("fecha"))
    return counts.select(F.date_add(F.max(known), OPEN_DAYS).alias("fecha_cierre"))
