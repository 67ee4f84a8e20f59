"""Vectors as whole numbers: which rows take part, and their scaled entries as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024


def usable(vectors: DataFrame, divisor: int = 1) -> tuple[DataFrame, int]:
    """(rows whose vector can be compared as (vec_id long, embedding array<double>, other columns), its length).

    Left out are rows whose vector is null, empty or holds null or non-finite entries. All vectors of a table
    should be of one length; of several, the one that most rows have counts (of equals the longest), and rows
    of another length are left out. A length that `divisor` does not divide leaves no rows. Without rows the
    length is 0.
    """
    entries = F.col("embedding").cast("array<double>")

    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    rows = vectors.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("embedding", entries)
    rows = rows.where("embedding IS NOT NULL AND size(embedding) > 0").where(F.forall("embedding", good))
    lengths = rows.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    first = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    length = first["length"] if first and first["length"] % divisor == 0 else 0
    return rows.where(F.size("embedding") == length), length


def scaled(column: pa.Array, length: int, limit: int) -> np.ndarray:
    """floor(SCALE * entry) of each row, at most `limit` in size."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * SCALE), -limit, limit).astype(np.int64)
