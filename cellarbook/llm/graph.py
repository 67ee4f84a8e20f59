"""Connected components of a table of links, by alternating stars, with each round written to the shared folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.session import scratch_path
from cellarbook.sources.sinks import write_table

#: Nodes that a task holds at once while it joins its own links.
HELD = 100_000


def forest(pairs) -> dict[int, int]:
    """Smallest node reachable from each node of some links."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(above)}


def _joined(batches):
    """The links of a partition as stars around the smallest node; they connect the same nodes."""

    def out(pairs):
        stars = [(x, t) for x, t in forest(pairs).items() if x != t]
        arrays = [pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(arrays, ["u", "v"])

    pairs: list[tuple[int, int]] = []
    for batch in batches:
        pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(pairs) > HELD:
            yield out(pairs)
            pairs = []
    if pairs:
        yield out(pairs)


def _state(links: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), digest).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that is not the smallest of its component.

    `links` has two columns of long node names; order, repeats and loops do not matter, and links with a null
    end are left out. Each round joins links with a minimum per node, so a node with very many links is
    reduced on the map side and its rows are split like any skewed join. An empty table gives no rows.
    """
    spark = links.sparkSession
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = write_table(ends.mapInArrow(_joined, "u long, v long").distinct(), scratch_path(spark, "links"))
    state = _state(now)
    while state[0]:
        # Large star: a node's larger neighbours go to the smallest node around it.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_table(large, scratch_path(spark, "large"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = write_table(others.union(least).distinct(), scratch_path(spark, "links"))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
