"""Records of CSV files, which may hold line breaks inside quotes, from files that are split over tasks.

A line alone does not say whether it begins inside a quoted cell. But it says how it ends for either case, and
such steps can be put together: within a block in the order of lines, then over the blocks of a file. That
gives every line its state, and lines inside a cell go to the record that opened it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarbook.operators.joins import join_side

#: How cells are written: a quote inside quotes is doubled, and line breaks inside quotes belong to the cell.
CSV = {"escape": '"', "multiLine": "true"}

_INSIDE = r'[^"]*+(?:""[^"]*+)*+'  # up to the quote that closes the cell
_CELL = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?'
_OPEN = rf'(?:{_CELL},)*+"{_INSIDE}\z'  # the last cell is not closed

FILE, BLOCK, LINE = "_file", "_block", "_line"


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files with a position that grows along each file.

    A scan task numbers its lines in order, so (block start, number) orders the lines of a file without
    a shuffle. A byte order mark at a line's start is dropped, a carriage return at its end is kept.
    """
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.regexp_replace("value", "^﻿", "").alias("value"),
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(LINE),
    )


def _states(steps: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Add what holds before and after each step if all begins outside a cell (0) or inside one (1).

    A step has `_e0` and `_e1`, what it ends in from either state: it keeps the state, turns it, or sets it.
    """
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_order = Window.partitionBy(*by).orderBy(order)
    turns = F.sum(((F.col("_e0") == 1) & (F.col("_e1") == 0)).cast("int")).over(so_far)
    counted = steps.withColumn("_turns", turns)
    last_set = F.last(F.when(F.col("_e0") == F.col("_e1"), F.struct(F.col("_e0").alias("to"), "_turns")), ignorenulls=True)
    placed = counted.withColumn("_set", last_set.over(so_far))

    def after(start: int) -> Column:
        since = F.col("_set.to") + F.col("_turns") - F.col("_set._turns")
        return F.pmod(F.when(F.col("_set").isNull(), F.col("_turns") + start).otherwise(since), F.lit(2)).cast("int")

    ended = placed.withColumns({"_after0": after(0), "_after1": after(1)})
    begun = {f"_before{s}": F.lag(f"_after{s}", 1, s).over(in_order) for s in (0, 1)}
    return ended.withColumns(begun).drop("_turns", "_set")


def records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """value, _file, _block, _line of every record; the position is that of its first line.

    One scan looks whether any line leaves a cell open. Where none does, lines are records and nothing is
    shuffled. Otherwise lines meet by file block; only records of several lines are put together, and only
    those that reach over a block's end need another block. A cell that is never closed takes in the rest of
    its file, as every CSV reader has it.
    """
    lines = numbered_lines(spark, paths)
    text = F.col("value")
    end = F.regexp_replace("value", r"\r\z", "").alias("value")
    if not lines.filter(text.contains('"') & text.rlike(f"^{_OPEN}")).head(1):
        return lines.select(end, FILE, BLOCK, LINE)

    quoted = text.contains('"')
    stays = text.rlike(rf"^{_INSIDE}\z") | text.rlike(rf'^{_INSIDE}"[^,]*+,{_OPEN}')
    steps = lines.withColumns(
        {
            "_e0": F.when(quoted, text.rlike(f"^{_OPEN}").cast("int")).otherwise(0),
            "_e1": F.when(quoted, stays.cast("int")).otherwise(1),
        }
    )
    known = _states(steps, [FILE, BLOCK], LINE)
    whole = known.groupBy(FILE, BLOCK).agg(
        F.max_by(F.struct("_after0", "_after1"), LINE).alias("_end"),
        *[F.max(F.when(F.col(f"_before{s}") == 0, F.col(LINE))).alias(f"_last{s}") for s in (0, 1)],
    )
    whole = whole.select(FILE, BLOCK, "_last0", "_last1", F.col("_end._after0").alias("_e0"), F.col("_end._after1").alias("_e1"))
    entries = _states(whole, [FILE], BLOCK).withColumn("_entry", F.col("_before0"))
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("_entry") == 0, F.col("_last0")).otherwise(F.col("_last1"))
    owner = F.when(last.isNotNull(), F.struct(BLOCK, last.alias(LINE)))
    entries = entries.select(FILE, BLOCK, "_entry", F.last(owner, ignorenulls=True).over(before).alias("_from"))

    def state(name: str) -> Column:
        return F.when(F.col("_entry") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    placed = join_side(known, entries, [FILE, BLOCK]).withColumns({"_start": state("_before"), "_stop": state("_after")})
    so_far = Window.partitionBy(FILE, BLOCK).orderBy(LINE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.col("_start") == 0, F.struct(BLOCK, LINE)), ignorenulls=True).over(so_far)
    owned = placed.withColumn("_owner", F.coalesce(opened, "_from"))
    alone = (F.col("_start") == 0) & (F.col("_stop") == 0)
    parts = owned.filter(~alone).groupBy(FILE, "_owner").agg(F.array_sort(F.collect_list(F.struct(BLOCK, LINE, "value"))).alias("_parts"))
    joined = F.array_join(F.transform("_parts", lambda p: p["value"]), "\n")
    put = parts.select(joined.alias("value"), FILE, F.col(f"_owner.{BLOCK}").alias(BLOCK), F.col(f"_owner.{LINE}").alias(LINE))
    return owned.filter(alone).select("value", FILE, BLOCK, LINE).unionByName(put).select(end, FILE, BLOCK, LINE)
