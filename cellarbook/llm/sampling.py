"""Samples of bounded size that do not depend on how rows are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def about(rows: DataFrame, most: int, *names: str) -> DataFrame:
    """All rows of a stored table if they are `most` or fewer, else about that many: those whose names' hash is low.

    The names should tell rows apart; rows that agree in them are taken or left together.
    """
    count = rows.count()
    if count <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*names), F.lit(_STEPS)) < _STEPS * most // count)
