"""Near copies among vectors: small-world graphs per shard, every shard searched, cosines verified, links joined.

Equal vectors stand behind one of them. The others are dealt to shards by hash, each shard gets a graph
(`hnsw.Hnsw`), and its vectors search the graphs of their own and of every later shard in blocks. Probes with
a known answer at the wanted cosine audit each graph's recall, and its beam is doubled until they are found.
A vector whose whole beam is similar is compared with all vectors of the shard, the widest beam.

Graphs are written once, a folder of the shared scratch table for each shard. The tasks that search get only the
numbers of shards and blocks and open the folders by path, so that no vector is shuffled for a search.

A task reports the number of links of each vector and a spanning forest of its links, never all pairs of a
large group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.llm.graph import components, forest
from cellarbook.llm.hnsw import TOGETHER, Hnsw
from cellarbook.llm.vectors import matrix, prepared, unit
from cellarbook.operators.joins import join_side
from cellarbook.session import scratch_path
from cellarbook.sources.sinks import write_table

COSINE = 0.95
SHARD = 32_768  # vectors of one graph, on average
BLOCK = 4096  # vectors of a shard that search another one together
UNITS = 8  # blocks that a task searches with, as far as there are more tasks than twice the cores
BEAM = 24
PROBES, RECALL = 128, 0.99
SHARDS = "dim int, shard int, n long, beam int, ids binary, copies binary, vecs binary, graph array<binary>"


def _build(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One row with the vectors of a shard, their graph, and its audited beam."""
    rows = rows.sort_values("rep", kind="stable")
    dim, shard = int(rows["dim"].iloc[0]), int(rows["shard"].iloc[0])
    ids, copies, vecs = rows["rep"].to_numpy("<i8"), rows["copies"].to_numpy("<i8"), matrix(rows["vec"], dim)
    units = unit(vecs)
    graph = Hnsw.build(units.astype(np.float32))
    out = (dim, shard, len(ids), audited_beam(graph, units, cosine, BEAM), ids.tobytes(), copies.tobytes(), vecs.tobytes(), graph.blob())
    return pd.DataFrame([out], columns=[c.split()[0] for c in SHARDS.split(", ")])


class Shard:
    """A shard read from its folder; `graph` is None unless asked for."""

    def __init__(self, folder: str, dim: int, shard: int, searched: bool):
        if folder.startswith("file:"):
            folder = "/" + folder.removeprefix("file:").lstrip("/")
        files, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        columns = ["beam", "ids", "copies", "vecs"] + ["graph"] * searched
        table = pq.read_table(f"{root}/dim={dim}/shard={shard}", filesystem=files, columns=columns, partitioning=None)
        beam, ids, copies, vecs, *graph = (table.column(c)[0].as_py() for c in columns)
        self.beam, self.ids, self.copies = beam, np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8")
        self.units = unit(np.frombuffer(vecs, np.float64).reshape(-1, dim))
        self.graph = Hnsw.opened(self.units.astype(np.float32), graph[0]) if searched else None


def audited_beam(graph: Hnsw, vectors: np.ndarray, cosine: float, beam: int) -> int:
    """The smallest doubling of `beam` with which probes at about `cosine` find the vectors they were made from."""
    n = len(vectors)
    rng = np.random.Generator(np.random.PCG64(n))
    rows = np.arange(n) if n <= PROBES else rng.choice(n, PROBES, replace=False)
    noise = rng.standard_normal((len(rows), vectors.shape[1]))
    noise -= (noise * vectors[rows]).sum(1, keepdims=True) * vectors[rows]
    length = np.sqrt((noise * noise).sum(1, keepdims=True))
    wanted = min(1.0, cosine + 0.005)
    probes = wanted * vectors[rows] + np.sqrt(1 - wanted**2) * noise / np.where(length > 0, length, 1)
    while beam < n:
        found, sims = graph.search(probes, beam)
        hit = (found == rows[:, None]).any(1) | (sims[:, -1] >= cosine)  # a full beam is widened in any case
        if hit.mean() >= RECALL:
            return beam
        beam *= 2
    return n


def linked(graph: Hnsw, all_units: np.ndarray, queries: np.ndarray, cosine: float, beam: int):
    """(query, row) of pairs with at least that cosine in double precision."""
    for low in range(0, len(queries), TOGETHER):
        some = queries[low : low + TOGETHER]
        found, sims = graph.search(some, beam)
        full = np.flatnonzero(sims[:, -1] >= cosine - 1e-4)
        near = sims >= cosine - 1e-4
        near[full] = False
        x, k = np.nonzero(near)
        y = found[x, k]
        if len(full):
            exact = some[full].astype(np.float32) @ all_units.astype(np.float32).T
            a, b = np.nonzero(exact >= cosine - 1e-4)
            x, y = np.concatenate([x, full[a]]), np.concatenate([y, b])
        good = np.zeros(len(x), bool)
        for i in range(0, len(x), 1 << 16):
            part = slice(i, i + (1 << 16))
            good[part] = (some[x[part]] * all_units[y[part]]).sum(1) >= cosine
        yield x[good] + low, y[good]


def _search_all(batches, folder: str, cosine: float):
    """Searches of blocks of a shard in another one: (a, b, 0) for links of a forest, (a, null, n) for counts."""
    target: tuple[tuple[int, int] | None, Shard | None] = (None, None)
    source: tuple[tuple[int, int] | None, Shard | None] = (None, None)
    for batch in batches:
        for dim, there, here, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if target[0] != (dim, there):
                target = (None, None)  # before the next one is opened
                target = (dim, there), Shard(folder, dim, there, True)
            if source[0] != (dim, here):
                source = (None, None)
                source = (dim, here), Shard(folder, dim, here, False)
            own, asking = target[1], source[1]
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            ids, copies = asking.ids[part], asking.copies[part]
            links: dict[int, int] = {}
            counts: dict[int, int] = {}
            for x, y in linked(own.graph, own.units, asking.units[part], cosine, own.beam):
                other = ids[x] != own.ids[y]
                a, b = ids[x[other]], own.ids[y[other]]
                np_counts(counts, a, own.copies[y[other]])
                if there != here:  # a later shard does not search this one
                    np_counts(counts, b, copies[x[other]])
                links = forest([*links.items(), *zip(a.tolist(), b.tolist(), strict=True)])
            out = [(a, b, 0) for a, b in links.items() if a != b] + [(a, None, n) for a, n in counts.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"])


def np_counts(counts: dict[int, int], names: np.ndarray, numbers: np.ndarray) -> None:
    """Add numbers to the counts of names."""
    distinct, inverse = np.unique(names, return_inverse=True)
    sums = np.bincount(inverse, numbers, len(distinct)).astype(np.int64)
    for name, n in zip(distinct.tolist(), sums.tolist(), strict=True):
        counts[name] = counts.get(name, 0) + n


def group(vectors: DataFrame, cosine: float = COSINE, shard_size: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors` (vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components link with nothing; so do vectors of
    different lengths. Rows that share a vec_id and differ in their values are vectors of their own under one
    name. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = write_table(prepared(vectors), scratch_path(spark, "vectors"))
    known = rows.where("dim > 0 AND vec_id IS NOT NULL")
    groups = known.groupBy("dim", "sig").agg(F.min(F.struct("vec_id", "vec")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = write_table(groups.select("dim", "sig", F.col("r.vec_id").alias("rep"), "r.vec", "copies"), scratch_path(spark, "reps"))
    shards = max(1, -(-reps.count() // shard_size))
    dealt = reps.drop("sig").withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    folder = scratch_path(spark, "graphs")
    built = dealt.groupBy("dim", "shard").applyInPandas(lambda rows: _build(rows, cosine), SHARDS)
    built.write.option("compression", "zstd").partitionBy("dim", "shard").parquet(folder)
    sizes = spark.read.schema("n long, dim int, shard int").parquet(folder)  # without vectors there is no file
    there = sizes.select("dim", F.col("shard").alias("target"))
    here = sizes.withColumn("target", F.explode(F.sequence(F.col("shard"), F.lit(shards - 1)))).join(there, ["dim", "target"])
    blocks = F.sequence(F.lit(0), ((F.col("n") - 1) / BLOCK).cast("int"))
    units = here.select("dim", "target", F.col("shard").alias("source"), F.explode(blocks).alias("block"))
    units = write_table(units, scratch_path(spark, "units"))
    count = units.count()
    tasks = max(1, min(count, max(2 * spark.sparkContext.defaultParallelism, count // UNITS)))
    key = ["dim", "target", "source", "block"]
    units = units.repartitionByRange(tasks, *key).sortWithinPartitions(*key)
    found = units.mapInArrow(lambda batches: _search_all(batches, folder, cosine), "a long, b long, n long")
    found = write_table(found, scratch_path(spark, "found"))
    links = found.where("b IS NOT NULL")
    final = components(links).withColumnRenamed("node", "rep")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    shared = reps.drop("vec").join(final, "rep", "left").join(counts, "rep", "left").where("copies > 1 OR n > 0")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    shared = write_table(shared.select("dim", "sig", F.coalesce("component", "rep").alias("component_id"), n_links), scratch_path(spark, "shared"))
    out = join_side(rows.select("vec_id", "dim", "sig"), shared, ["dim", "sig"], "left")
    named = F.col("vec_id").isNotNull()
    component = F.coalesce(F.when(named, F.col("component_id")), "vec_id")
    n_links = F.coalesce(F.when(named, F.col("n_links")), F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
