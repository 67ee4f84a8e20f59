"""Stock flows per item and day, and their sums over periods.

All flows of an area go into one table of (item, day) with a sum (and, where a rule asks whether anything
happened, a row count) per flow. That first aggregation combines on the map side, so an item holding a
third of all movements is down to one row per day before anything is grouped by item alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellarbook.operators.joins import spread

KEY, DAY = "_item", "fecha"
#: Bytes of input whose flows and periods one task puts in order.
LINE_BYTES = 4 << 20


def flow_rows(rows: DataFrame, key, quantity="cantidad", day: str = "fecha", count=None) -> DataFrame:
    """Bring a movement table to (item, day, quantity, number of rows)."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(
        as_column(key).cast("string").alias(KEY),
        F.col(day).cast("date").alias(DAY),
        as_column(quantity).cast("double").alias("_qty"),
        (F.lit(1) if count is None else as_column(count)).cast("bigint").alias("_rows"),
    )


def per_day(rows: DataFrame, by: Sequence[str], quantity: str = "cantidad", day: str = "fecha") -> DataFrame:
    """Pre-aggregate a fact before it is joined with a map or a bill of materials."""
    return rows.groupBy(*by, day).agg(F.sum(quantity).alias(quantity), F.count(F.lit(1)).alias("_rows"))


def flow_days(
    flows: Mapping[str, DataFrame], counted: Sequence[str] = (), between: tuple[date, date] | None = None
) -> DataFrame:
    """One row per (item, day): column `<flow>` per flow, and `<flow>_rows` for the counted ones.

    `between` are the first and last day that any period can take in. As literals they are pushed down
    into every source, so history before the first count is neither aggregated nor shuffled.
    """
    dated = F.col(DAY).isNotNull() if between is None else F.col(DAY).between(*[F.lit(day) for day in between])
    wanted = F.col(KEY).isNotNull() & dated
    tagged = [df.filter(wanted).withColumn("_flow", F.lit(name)) for name, df in flows.items()]
    long = reduce(DataFrame.unionByName, tagged)
    sums = [F.sum(F.when(F.col("_flow") == name, F.col("_qty"))).alias(name) for name in flows]
    counts = [F.sum(F.when(F.col("_flow") == name, F.col("_rows"))).alias(f"{name}_rows") for name in counted]
    return long.groupBy(KEY, DAY).agg(*sums, *counts)


def _in_periods(
    periods: DataFrame, days: DataFrame, key: str, upper: bool, spelled: DataFrame | None
) -> tuple[DataFrame, list[str]]:
    """Periods and days by item, each with the period it belongs to (`_period`); and the flows' columns.

    Instead of comparing each period with each day of its item, periods and days are put in one descending
    order per item and every day picks up the last closing date seen, so the work is linear. Spellings of
    an item that differ in case only (`upper`) each get their own copy of the shared flows first, because
    their periods may overlap; those of one spelling never do, and no two of them close on one day. Empty
    periods take nothing in and pass by. `spelled` may hold the spellings where they are known without
    working out the periods.
    """
    measures = [c for c in days.columns if c not in (KEY, DAY)]
    nothing = [F.lit(None).cast(days.schema[m].dataType).alias(m) for m in measures]
    if upper:
        items = (periods if spelled is None else spelled).select(F.col(key).alias("_raw")).distinct()
        days = days.join(items.withColumn(KEY, F.upper("_raw")), KEY).withColumn(KEY, F.col("_raw")).drop("_raw")

    marks = periods.select(
        F.col(key).cast("string").alias(KEY),
        F.col("fecha_cierre").alias(DAY),
        F.struct(*periods.columns).alias("_own"),
        *nothing,
    )
    own_type = marks.schema["_own"].dataType
    line = spread(days.withColumn("_own", F.lit(None).cast(own_type)).unionByName(marks), [KEY], LINE_BYTES)

    latest_first = (
        Window.partitionBy(KEY)
        .orderBy(F.col(DAY).desc(), F.col("_own").isNull().asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    lasting = F.when(F.col("_own.fecha_inicio") < F.col("_own.fecha_cierre"), F.col("_own"))
    placed = line.withColumn("_closing", F.last(lasting, ignorenulls=True).over(latest_first)).withColumn(
        "_period", F.coalesce("_own", F.when(F.col(DAY) > F.col("_closing.fecha_inicio"), F.col("_closing")))
    )
    return placed.filter(F.col("_period").isNotNull()), measures


#: Equal periods are one group, and stay as many rows as they were.
_EACH = "explode(array_repeat(0, CAST(_times AS INT))) AS _nth"


def sum_over_periods(
    periods: DataFrame, days: DataFrame, key: str, upper: bool, spelled: DataFrame | None = None
) -> DataFrame:
    """Add to each period the flow sums of its days: start < day <= close."""
    placed, measures = _in_periods(periods, days, key, upper, spelled)
    summed = placed.groupBy(KEY, "_period").agg(F.count("_own").alias("_times"), *[F.sum(m).alias(m) for m in measures])
    return summed.select("_period", *measures, F.expr(_EACH)).select("_period.*", *measures)


def days_in_periods(
    periods: DataFrame, days: DataFrame, key: str, upper: bool, spelled: DataFrame | None = None
) -> DataFrame:
    """Add to each period `_flows`: a map from those of its days that have flows to their sums.

    So the days of periods, which are many times more than the periods, need no shuffle to meet the flows.
    """
    placed, measures = _in_periods(periods, days, key, upper, spelled)
    flow = F.when(F.col("_own").isNull(), F.struct(F.col(DAY), F.struct(*measures)))
    found = placed.groupBy(KEY, "_period").agg(F.count("_own").alias("_times"), F.collect_list(flow).alias("_flows"))
    found = found.select("_period", F.map_from_entries("_flows").alias("_flows"), F.expr(_EACH))
    return found.select("_period.*", "_flows")


def on_same_day(days_of_periods: DataFrame, days: DataFrame, key: str, upper: bool) -> DataFrame:
    """Add to each (item, day) row the flow sums of exactly that day."""
    item = F.upper(key) if upper else F.col(key)
    return days_of_periods.withColumn(KEY, item.cast("string")).join(days, [KEY, DAY], "left").drop(KEY)
