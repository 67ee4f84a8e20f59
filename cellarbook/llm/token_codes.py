"""Token ids of a corpus as directly addressable codes in ascending document order.

Layout below one folder: `shards` (Parquet; one row is a run of whole documents with about SHARD_TOKENS ids:
its part and place, its documents, where each starts, and the `dac` blob) and `directory` (first global
position of each part). Parts are ranges of doc_id in ascending order, and so are shards in a part.

Any global position is read through `directory`, one shard row, and the blob's rank directory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarbook.llm import dac
from cellarbook.llm.tokens import Vocabulary, encoded

SHARD_TOKENS = 1 << 18
SHARDS = "part int, seq int, start_in_part long, n_tokens long, doc_ids array<long>, doc_starts array<long>, dac binary"


def write_codes(docs: DataFrame, path: str, vocabulary: Vocabulary, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text (null: empty) and write the ids below `path`, a fresh folder.

    One shuffle by ranges of doc_id; a task holds one shard at a time. A null doc_id comes first, rows that
    share a doc_id follow each other, and each row is a document of its own. Other columns are ignored. An
    empty table gives empty files.
    """

    def build(batches):
        part, seq, total = TaskContext.get().partitionId(), 0, 0
        ids, names, starts, size = [], [], [], 0

        def shard():
            nonlocal seq, total, ids, names, starts, size
            row = [[part], [seq], [total], [size], [names], [starts], [dac.encode(np.concatenate(ids))]]
            seq, total = seq + 1, total + size
            ids, names, starts, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], columns)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, own in encoded(batch.column(1), vocabulary):
                names.append(keys[row])
                starts.append(size)
                ids.append(own)
                size += len(own)
                if size >= shard_tokens:
                    yield shard()
        if names:
            yield shard()

    columns = [c.split()[0] for c in SHARDS.split(", ")]
    longs = pa.list_(pa.int64())
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), longs, longs, pa.binary()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # The blobs are dense already.
    ordered.mapInArrow(build, SHARDS).write.option("compression", "none").parquet(f"{path}/shards")
    sums = docs.sparkSession.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per part: as many as the range shuffle has partitions, whatever the number of documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base.write.parquet(f"{path}/directory")


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard rows with `start`, the global position of their first id."""
    shards, directory = spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/directory")
    return shards.join(F.broadcast(directory), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Every document from the files: doc_id, start, and ids (little-endian unsigned 32-bit integers)."""

    def decode(batches):
        for batch in batches:
            for names, starts, base, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = dac.Codes(blob).all().astype("<u4").tobytes()
                ends = [*starts[1:], len(ids) // 4]
                own = [ids[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
                first = pa.array([base + a for a in starts], pa.int64())
                arrays = [pa.array(names, pa.int64()), first, pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "ids"])

    shards = open_shards(spark, path).select("doc_ids", "doc_starts", "start", "dac")
    return shards.mapInArrow(decode, "doc_id long, start long, ids binary")


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, id) of global positions, without decoding any shard; positions beyond the end give no row."""

    def pick(batches):
        for batch in batches:
            at, ids = [], []
            for start, size, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = dac.Codes(blob)
                inside = [p for p in positions if start <= p < start + size]
                at += inside
                ids += [codes.at(p - start) for p in inside]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, pa.int64())], ["position", "id"])

    shards = open_shards(spark, path).select("start", "n_tokens", "dac")
    wanted = F.exists(F.array(*map(F.lit, positions)), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))
    return shards.where(wanted).mapInArrow(pick, "position long, id long")
