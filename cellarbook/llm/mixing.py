"""A mixture of sources with set weights, drawn by balanced sampling (the cube method).

Every document of a source is wanted target / source_size times. The whole part is taken as it is; the
fraction is an inclusion probability, to become 0 or 1. Three undecided documents of a source at a time are
moved along the direction that leaves both their expected words and their expected number unchanged, until
one of them is decided. So the totals of words and documents stay exact while nearly all are decided, in
blocks of a source that know nothing of each other. What blocks leave undecided (two documents each) goes
through the same step again, until a source fits one block. There the last few documents of spread sizes
are landed together, by the best of all their roundings;
where one huge document keeps that from coming near, the flight of the last block is drawn again.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellarbook.operators.joins import join_side
from cellarbook.session import scratch_path
from cellarbook.sources.sinks import write_table

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK = 4096
LANDED = 14
FLIGHTS = 12
WORD = "[^\\x20\\x09-\\x0D]+"
UNITS = "doc_id long, source string, size long, source_size long, target double, block long, whole int, part double"


def word_count(text) -> F.Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """One row per source: its size, documents, and target.

    The windows run over one row per source. Filling up in order of size per weight: the sources whose share
    would pass `most` times their size stop there, and they are the first ones in that order.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place % len(weights) + 1)
    rows = totals.withColumn("w", weight).withColumn("limit", most * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("w"), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weights_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weights_left)
    rows = rows.withColumn("stops", F.col("level") * F.col("w") > F.col("limit"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    target = F.when(F.col("stops"), F.col("limit")).otherwise(F.least("limit", level * F.col("w")))
    return rows.select("source", "source_size", "docs", target.alias("target"))


def flight(sizes: list[float], part: list[float], rng: np.random.Generator) -> list[int]:
    """Move `part` in place; returns the units still undecided, two at most unless all their sizes agree."""
    draws = iter(rng.random(len(sizes) + 1).tolist())
    pool: list[int] = []
    for unit in range(len(sizes)):
        if not 0 < part[unit] < 1:
            continue
        pool.append(unit)
        if len(pool) < 3:
            continue
        i, j, k = pool
        a, b, c = sizes[i], sizes[j], sizes[k]
        u = (b - c, c - a, a - b)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for unit_, step in zip(pool, u, strict=True):
            if step > 0:
                up, down = min(up, (1 - part[unit_]) / step), min(down, part[unit_] / step)
            elif step < 0:
                up, down = min(up, part[unit_] / -step), min(down, (1 - part[unit_]) / -step)
        move = up if next(draws) * (up + down) < down else -down
        for unit_, step in zip(pool, u, strict=True):
            new = part[unit_] + move * step
            part[unit_] = 0.0 if new < 1e-9 else 1.0 if new > 1 - 1e-9 else new
        pool = [x for x in pool if 0 < part[x] < 1]
    return pool


def land(sizes: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The rounding of a few units that comes nearest to their words, then to their number."""
    choices = np.array(list(itertools.product((0.0, 1.0), repeat=len(sizes))))
    words = np.abs(choices @ sizes - part @ sizes)
    number = np.abs(choices.sum(1) - part.sum())
    return choices[np.argmin(words + 0.02 * max(1.0, sizes.mean()) * number)]


def _decider(last: bool, seed: int):
    return lambda units: _decide(units, last, seed)


def _decide(units: pd.DataFrame, last: bool, seed: int) -> pd.DataFrame:
    units = units.sort_values(["size", "doc_id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    name = f"{seed}:{units['source'].iloc[0]}:{units['block'].iloc[0]}:{last}"
    rng = np.random.Generator(np.random.PCG64(zlib.crc32(name.encode())))
    sizes, start = units["size"].to_numpy(float), units["part"].to_numpy(float)
    if not last:
        part = start.tolist()
        flight(sizes.tolist(), part, rng)
        return units.assign(part=part)
    held = np.unique(np.linspace(0, len(units) - 1, LANDED).round().astype(int))
    rest = np.setdiff1d(np.arange(len(units)), held)
    best = None
    for _ in range(FLIGHTS):
        moved, part = start[rest].tolist(), start.copy()
        flight(sizes[rest].tolist(), moved, rng)
        part[rest] = moved
        open_ = np.flatnonzero((part > 0) & (part < 1))
        if len(open_):
            part[open_] = land(sizes[open_], part[open_])
        miss = abs(float((part - start) @ sizes))
        if best is None or miss < best[0]:
            best = miss, part
        if miss <= 1:
            break
    return units.assign(part=best[1])


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_TIMES, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """How often the mixture takes each row: doc_id, source, size, source_size, target, copies (0 to `most`).

    Null text has size 0; a null source is a source of its own, the last one. Rows are units of their own even
    if they share a doc_id, and rows that agree in everything may trade places. Blocks follow from hashes of
    doc_id and size, so reruns agree whatever the partitions. Sources without words take nothing. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"))
    sized = write_table(sized, scratch_path(spark, "sizes"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    targets = write_table(source_targets(sized, weights, most).withColumn("_key", key), scratch_path(spark, "targets"))
    units = join_side(sized.withColumn("_key", key), targets.drop("source"), ["_key"])
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("_times", F.least(times, F.lit(float(most)))).withColumn("whole", F.floor("_times").cast("int"))
    hashed = F.xxhash64("doc_id", "size")
    units = units.withColumn("part", F.col("_times") - F.col("whole"))
    units = units.withColumn("block", F.pmod(hashed, F.ceil(F.col("docs") / block)))
    names = [c.split()[0] for c in UNITS.split(", ")]
    units = units.select(names)
    undecided = (F.col("part") > 0) & (F.col("part") < 1)
    done, open_ = [units.where(~undecided)], units.where(undecided)
    # The largest source's number of units; known before the first round.
    largest = targets.agg(F.max("docs")).first()[0] or 0
    while True:
        last = largest <= block
        moved = open_.groupBy("source", "block").applyInPandas(_decider(last, seed), UNITS)
        moved = write_table(moved, scratch_path(spark, "mixed"))
        done.append(moved.where(~undecided))
        if last:
            break
        left = write_table(moved.where(undecided), scratch_path(spark, "undecided"))
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        largest = counts.agg(F.max("n")).first()[0] or 0
        blocks = -(-largest // block)
        open_ = left.withColumn("block", F.pmod(hashed, F.lit(max(1, blocks))))
    out = done[0]
    for frame in done[1:]:
        out = out.unionByName(frame)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("part")).cast("int").alias("copies"))
