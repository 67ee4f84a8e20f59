"""How much text a Python worker is sent at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

SETTING, MOST = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes, where nobody asked for smaller ones yet.

    By default a batch of long texts or sets may hold 64 MB, on either side of the pipe to each Python worker.
    """
    now = str(spark.conf.get(SETTING, f"{MOST + 1}")).rstrip("b")
    if not now.isdigit() or int(now) > MOST:
        spark.conf.set(SETTING, str(MOST))


def handed_back(out: Iterator) -> Iterator:
    """The same rows; at their end the worker gives memory it holds for later back to its machine.

    Workers are used again by the stages that follow, next to executors that need the room.
    """
    yield from out
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
