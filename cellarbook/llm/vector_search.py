"""Nearest neighbours by inner product over balanced posting lists.

Vectors are brought to one length by one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that
the largest inner product becomes the smallest angle. Centroids come from a bounded sample, cut in halves of
equal size again and again. A small-world graph in memory finds a vector's centroids; a vector near a boundary
is put into several lists. A query reads all lists whose distance is within a ratio of its nearest one; an
audit against brute force on a few queries sets that ratio. Long lists are read in parts by several tasks.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellarbook.llm.hnsw import Hnsw
from cellarbook.llm.vectors import matrix, prepared
from cellarbook.session import scratch_path
from cellarbook.sources.sinks import write_table

#: Vectors that the centroids are fitted on, at most, and centroids, at most (both are in the driver's memory).
SAMPLE, CENTROIDS = 32_768, 4096
LIST = 1024  # vectors of a list before copies, as far as CENTROIDS allows
COPIES, BOUNDARY = 4, 1.06  # lists of a vector, and how much farther than the nearest they may be
AUDITED, COVERED = 256, 0.985  # queries of the audit, and the share of true neighbours their lists must hold
WORST = 0.9  # and the share of each audited query's own
BANDS = 4  # groups of queries, by the distance of the nearest list, that have a ratio of their own
PART = 4096  # vectors of a list that are read by one task
TOGETHER = 128
HELD = 1 << 18  # entries that a task keeps to merge before it hands them on


def centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit centroids of about `count` groups of equal size, from halving along the line between two means."""
    groups, rng = [np.arange(len(sample))], np.random.Generator(np.random.PCG64(3))
    while len(groups) < count and len(groups[0]) >= 4:
        halves = []
        for own in groups:
            points = sample[own]
            ends = points[rng.choice(len(own), 2, replace=False)]
            for _ in range(5):
                side = points @ (ends[0] - ends[1])
                left = side >= np.median(side)
                if left.all() or not left.any():
                    break
                ends = np.stack([points[left].mean(0), points[~left].mean(0)])
            order = np.argsort(-(points @ (ends[0] - ends[1])), kind="stable")
            halves += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        groups = halves
    means = np.stack([sample[g].mean(0) for g in groups])
    length = np.sqrt((means * means).sum(1, keepdims=True))
    return (means / np.where(length > 1e-12, length, 1)).astype(np.float32)


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors over the largest norm, with the component that makes them unit."""
    scaled = vectors / most
    rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))
    return np.concatenate([scaled, rest[:, None]], 1).astype(np.float32)


def _asked(queries: np.ndarray) -> np.ndarray:
    """Queries as unit vectors with the added component 0."""
    rows = queries / np.sqrt((queries * queries).sum(1, keepdims=True))
    return np.concatenate([rows, np.zeros((len(rows), 1))], 1).astype(np.float32)


def _distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


class Lists:
    """The graph over centroids, and the rules that choose lists."""

    def __init__(self, centers: np.ndarray, most: float):
        self.centers, self.most = centers, most
        self.graph = Hnsw.build(centers)
        self.edges, self.ratios, self.beam = np.zeros(0), np.array([2.0]), min(len(centers), 16)

    def of_vectors(self, vectors: np.ndarray):
        """(row, list) of vectors: the nearest list, and others about as near."""
        ids, cosines = self.graph.search(lifted(vectors, self.most), 16)
        ids, far = ids[:, :COPIES], _distance(cosines[:, :COPIES])
        return self._within(ids, far, BOUNDARY)

    def of_queries(self, queries: np.ndarray):
        """(row, list) of queries: all lists within the ratio, found with a beam that widens until one lies beyond it."""
        asked, todo, beam = _asked(queries), np.arange(len(queries)), self.beam
        rows, lists = [], []
        while len(todo):
            ids, cosines = self.graph.search(asked[todo], beam)
            far = _distance(cosines)
            ratio = self.ratios[np.searchsorted(self.edges, far[:, 0], side="right")]
            beyond = (ids[:, -1] < 0) | (far[:, -1] > ratio * far[:, 0] + 1e-6) | (beam >= len(self.centers))
            row, own = self._within(ids[beyond], far[beyond], ratio[beyond, None])
            rows.append(todo[beyond][row])
            lists.append(own)
            todo, beam = todo[~beyond], min(2 * beam, len(self.centers))
        return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, int), np.zeros(0, int))

    def of_all(self, queries: np.ndarray):
        """(row, list) of every query and every list."""
        rows, lists = np.divmod(np.arange(len(queries) * len(self.centers)), len(self.centers))
        return rows, lists

    @staticmethod
    def _within(ids: np.ndarray, far: np.ndarray, ratio):
        rows, k = np.nonzero((ids >= 0) & (far <= ratio * far[:, :1] + 1e-6))
        return rows, ids[rows, k]

    def audit(self, queries: np.ndarray, neighbours: list[np.ndarray]) -> None:
        """Set the ratios so that lists within them hold, in each band, the share COVERED of all true neighbours and WORST
        of every query's own; then widen the beam until the lists that the graph finds hold as many."""
        needs, near, first = [], [], []
        every = _distance(_asked(queries) @ self.centers.T)
        for far, vectors in zip(every, neighbours, strict=True):
            rows, lists = self.of_vectors(vectors) if len(vectors) else (np.zeros(0, int), np.zeros(0, int))
            near.append((len(vectors), rows, lists))
            if len(vectors):
                best = np.full(len(vectors), np.inf)
                np.minimum.at(best, rows, far[lists])
                needs.append(best / max(far.min(), 1e-9))
                first.append(far.min())
        if not needs:
            return
        bands = np.array_split(np.argsort(first, kind="stable"), min(BANDS, len(first)))
        self.edges = np.array([first[band[0]] for band in bands[1:]])
        of_band = [[needs[i] for i in band] for band in bands]
        self.ratios = 1e-3 + np.array([max(np.quantile(np.concatenate(own), COVERED), max(np.quantile(x, WORST) for x in own)) for own in of_band])
        while self.beam < len(self.centers) and self._held(queries, near) < COVERED - 0.005:
            self.beam = min(2 * self.beam, len(self.centers))

    def _held(self, queries: np.ndarray, near: list) -> float:
        """Share of the neighbours that lie in lists found for their query."""
        rows, lists = self.of_queries(queries)
        held = sum(len(np.unique(r[np.isin(own, lists[rows == i])])) for i, (_, r, own) in enumerate(near))
        return held / sum(n for n, _, _ in near)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: largest score first, smaller id where scores tie."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def nearest(queries: np.ndarray, names: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query, id, score) of each query's k nearest among `vectors`, itself left out; queries in order."""
    out = []
    for low in range(0, len(queries), TOGETHER):
        some, own = queries[low : low + TOGETHER], names[low : low + TOGETHER]
        rough = some @ vectors.T
        rough[own[:, None] == ids[None, :]] = -np.inf
        n = rough.shape[1]
        width = min(n, k + 4)
        at = np.argpartition(-rough, width - 1, axis=1)[:, :width] if width < n else np.tile(np.arange(n), (len(some), 1))
        edge = np.sort(np.take_along_axis(rough, at, 1), axis=1)[:, width - min(k, width)]
        edge -= 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
        # Summed alike for equal vectors, unlike a blocked product, so that ties are ties.
        scores = (vectors[at] * some[:, None, :]).sum(2)
        scores[~np.isfinite(np.take_along_axis(rough, at, 1))] = -np.inf
        order = np.lexsort((ids[at], -scores), axis=1)[:, :k]
        good = np.isfinite(np.take_along_axis(scores, order, 1))
        found_ids, found_scores = np.take_along_axis(ids[at], order, 1), np.take_along_axis(scores, order, 1)
        tied = (rough >= edge[:, None]).sum(1) > width  # more rows may tie for the last place than were looked at
        for i in np.flatnonzero(~tied):
            out.append((np.full(int(good[i].sum()), own[i]), found_ids[i][good[i]], found_scores[i][good[i]]))
        for i in np.flatnonzero(tied):
            near = np.flatnonzero((rough[i] >= edge[i]) & np.isfinite(rough[i]))
            exact = (vectors[near] * some[i]).sum(1)
            best = _best(exact, ids[near], k)
            out.append((np.full(len(best), own[i]), ids[near[best]], exact[best]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


FOUND = "query_id long, best array<struct<minus: double, vec_id: long>>"


def _found(triple) -> pa.RecordBatch:
    """One row for each query with all that was found for it; rows of a query follow each other."""
    names, ids, scores = triple
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, int)
    best = pa.StructArray.from_arrays([pa.array(-scores, pa.float64()), pa.array(ids, pa.int64())], ["minus", "vec_id"])
    lists = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(names)], pa.int32()), best)
    return pa.RecordBatch.from_arrays([pa.array(names[first], pa.int64()), lists], ["query_id", "best"])


def _merged(triples, k: int):
    """The k best of each query from several results, equal entries once; rows of a query follow each other."""
    names, ids, scores = (np.concatenate(x) for x in zip(*triples, strict=True))
    order = np.lexsort((ids, -scores, names))
    names, ids, scores = names[order], ids[order], scores[order]
    other = np.ones(len(names), bool)
    other[1:] = (names[1:] != names[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    names, ids, scores = names[other], ids[other], scores[other]
    first = np.searchsorted(names, names)
    best = np.arange(len(names)) - first < k
    return names[best], ids[best], scores[best]


def combined(triples, k: int):
    """Results of a task with the k best of each query, merged over the lists it read as far as HELD allows."""
    held, size = [], 0
    for triple in triples:
        held.append(triple)
        size += len(triple[0])
        if size > HELD:
            held = [_merged(held, k)]
            size = len(held[0][0])
            if 2 * size > HELD:
                yield _found(held[0])
                held, size = [], 0
    if size:
        yield _found(_merged(held, k))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked. A rank's limit is applied before the shuffle as well as behind it.

    Equal entries come from copies of a vector in several lists and share one rank.
    """
    every = found.select("query_id", F.explode("best").alias("b")).select("query_id", "b.minus", "b.vec_id")
    order = Window.partitionBy("query_id").orderBy("minus", "vec_id")
    ranked = every.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    distinct = ranked.dropDuplicates(["query_id", "rank"])  # rows of a rank are equal
    return distinct.select("query_id", "rank", "vec_id", (-F.col("minus")).alias("score"))


def _brute(rows: DataFrame, names: np.ndarray, queries: np.ndarray, dim: int, k: int) -> DataFrame:
    """Exact neighbours of a few queries among all rows, with their vectors."""

    def run(batches):
        parts = ((b.column(0).to_numpy(), matrix(b.column(1).to_pylist(), dim)) for b in batches if b.num_rows)
        yield from combined((nearest(queries, names, vectors, ids, k) for ids, vectors in parts), k)

    top = _top(rows.select("vec_id", "vec").mapInArrow(run, FOUND), k)
    return rows.select("vec_id", "vec").join(F.broadcast(top), "vec_id")  # AUDITED * k rows at most


def _fit(rows: DataFrame, dim: int, most: float, count: int, queries, k: int, size: int) -> Lists:
    sample = rows.orderBy(F.xxhash64("vec_id", "sig"), "vec_id").limit(SAMPLE).select("vec").collect()
    groups = min(CENTROIDS, max(1, -(-count // size)))
    lists = Lists(centroids(lifted(matrix([r.vec for r in sample], dim), most), groups), most)
    asked = rows.where(queries).orderBy(F.xxhash64("vec_id"), "vec_id").limit(AUDITED).select("vec_id", "vec").collect()
    if asked:
        names, vectors = np.array([r.vec_id for r in asked]), matrix([r.vec for r in asked], dim)
        true: dict[int, list] = {}
        for r in _brute(rows, names, vectors, dim, k).collect():
            true.setdefault(r.query_id, []).append(r.vec)
        lists.audit(vectors, [matrix(true.get(int(n), []), dim) for n in names])
    return lists


def _search_dim(rows: DataFrame, dim: int, most: float, count: int, queries, k: int, size: int) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(_fit(rows, dim, most, count, queries, k, size))

    def placed(rows: DataFrame, rule: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, 2048):
                    part = batch.slice(low, 2048)
                    vectors = matrix(part.column(1).to_pylist(), dim)
                    at, lists = getattr(shared.value, rule)(vectors)
                    arrays = [pa.array(lists, pa.int32()), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))]
                    yield pa.RecordBatch.from_arrays(arrays, ["list", "id", "vec"])

        return rows.select("vec_id", "vec").mapInArrow(run, "list int, id long, vec binary")

    lists = write_table(placed(rows, "of_vectors"), scratch_path(spark, "lists"))
    sizes = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    # One row per list, CENTROIDS at most.
    sizes = F.broadcast(write_table(sizes, scratch_path(spark, "list-sizes")))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    members = lists.join(sizes, "list").select("list", part, F.lit(0).alias("kind"), "id", "vec")

    def read(batches):
        def every():
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    yield from zip(*(c.to_pylist() for c in batch.slice(low, 1024).columns), strict=True)

        for _, group in groupby(every(), key=lambda r: r[:2]):
            held, asking = [], []
            for _, _, kind, name, vec in group:
                (asking if kind else held).append((name, vec))
                if len(asking) == 1024:
                    yield from compare(held, asking)
                    asking = []
            yield from compare(held, asking)

    def compare(held, asking):
        if held and asking:
            ids, vectors = np.array([x for x, _ in held]), matrix([v for _, v in held], dim)
            names, queries = np.array([x for x, _ in asking]), matrix([v for _, v in asking], dim)
            yield nearest(queries, names, vectors, ids, k)

    def searched(some: DataFrame, rule: str) -> DataFrame:
        asked = placed(some, rule).join(sizes, "list")
        asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "vec")
        together = members.union(asked).repartition("list", "part").sortWithinPartitions("list", "part", "kind")
        return _top(together.mapInArrow(lambda batches: combined(read(batches), k), FOUND), k)

    asking = rows.where(queries)
    found = write_table(searched(asking, "of_queries"), scratch_path(spark, "found"))
    full = found.where(F.col("rank") == min(k, count - 1)).select(F.col("query_id").alias("vec_id"))
    short = write_table(asking.join(full, "vec_id", "left_anti"), scratch_path(spark, "short"))
    if count < 2 or short.isEmpty():
        return found
    kept = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return kept.union(searched(short, "of_all"))


def search(vectors: DataFrame, queries: str, k: int = 20, list_size: int = LIST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row that the SQL condition `queries` on vec_id picks.

    Candidates are all rows but those with the query's own vec_id. Vectors that are null, zero or hold null or
    non-finite components, and rows without vec_id, take no part; vectors of other lengths are not compared.
    Rows that share a vec_id and differ in their values are candidates of their own under one name; equal ones
    count once. Other columns are ignored. An empty table gives no rows. The
    driver loops over the lengths that occur.
    """
    spark = vectors.sparkSession
    rows = write_table(prepared(vectors).where("dim > 0 AND vec_id IS NOT NULL"), scratch_path(spark, "vectors"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, most, count in rows.groupBy("dim").agg(F.max("norm"), F.count(F.lit(1))).collect():
        found = _search_dim(rows.where(F.col("dim") == dim), dim, most, count, F.expr(queries), k, list_size)
        out = out.union(found.select("query_id", "rank", "vec_id", "score"))
    return out
