"""Vectors as bytes of 64-bit floats, with rows that cannot be compared marked."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, sig (a digest of the values), norm, vec of every row; dim is 0 where a vector takes no part.

    That is where it is null or empty, all zero, or holds null or non-finite components.
    """

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes nan
            offsets, known = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            dims, sigs, norms, out = [], [], [], []
            for i in range(batch.num_rows):
                v = flat[offsets[i] : offsets[i + 1]] + 0.0 if known[i] else flat[:0]
                good = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                raw = v.tobytes() if good else b""
                dims.append(len(v) if good else 0)
                norms.append(float(np.sqrt((v * v).sum())) if good else 0.0)
                sigs.append(hashlib.blake2b(raw, digest_size=16).digest())
                out.append(raw)
            types = [pa.int32(), pa.binary(), pa.float64(), pa.binary()]
            arrays = [pa.array(v, t) for v, t in zip((dims, sigs, norms, out), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["vec_id", "dim", "sig", "norm", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, dim int, sig binary, norm double, vec binary")


def matrix(raw, dim: int) -> np.ndarray:
    """Rows of 64-bit floats from a sequence of bytes."""
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
