"""Joins of a fact with a side table whose size is looked at first, and shuffles as wide as their input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks of one shuffle; beyond that they grow again.
MOST_TASKS = 8192
_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def broadcast_limit(spark: SparkSession) -> int:
    """`spark.sql.autoBroadcastJoinThreshold` in bytes; negative means never."""
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).lower().strip()
    if text.endswith("b") and text[-2:-1] in _UNITS:
        text = text[:-1]
    unit = _UNITS.get(text[-1:], 1)
    return int(text.rstrip("bkmg")) * unit


def fits_broadcast(df: DataFrame) -> bool:
    """True when the optimizer's own size estimate is below the session's broadcast limit.

    The estimate grows with the files read, so a side that outgrows the limit stops being broadcast.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= broadcast_limit(df.sparkSession)


def join_side(fact: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join that keeps a hot key of `fact` from ending up in one task.

    A side below the broadcast limit is broadcast, so the fact is not shuffled at all. A larger one meets
    it in a shuffled join, whose oversized partitions the adaptive execution splits, equal rows as well as
    others, from the map outputs as they are; so a task that is run again reads the same rows. All rows of
    both sides take part either way.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join_side keeps all fact rows only for inner and left joins, not {how!r}")
    keys = list(on)
    if fits_broadcast(side):
        return fact.join(F.broadcast(side), keys, how)
    return fact.join(side, keys, how)


def read_bytes(df: DataFrame) -> int:
    """Bytes of all files and literals that a plan reads, by the optimizer; no job is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))


def spread(df: DataFrame, keys: Sequence[str], each: int) -> DataFrame:
    """The rows dealt by their keys over one task per `each` bytes that the plan reads.

    Adaptive execution joins partitions by their bytes on the wire, where sorted numbers and few dates are a
    hundredth of what they take in a sort; it leaves a number given here alone. A plan that reads little is
    left as it is.
    """
    tasks = min(MOST_TASKS, -(-read_bytes(df) // each))
    if tasks <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(tasks, *keys)


def constant_rows(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[str]) -> DataFrame:
    """A small relation of literals; it lives in the plan, so it may always be broadcast."""

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(value, float):
            return f"{value!r}D"
        return str(value)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
