"""Whitening of vectors by their covariance's leading components.

Sums and products of the scaled entries are exact whole numbers, combined on the map side to one matrix as
large as a vector is long; so the covariance does not depend on how the rows are spread. The driver splits that
matrix (`eigen`), and the components go to all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.llm.eigen import EPS, eigen
from cellarbook.llm.entries import scaled, usable

OFFSET = 100_000
COMPONENTS = 8
LIMIT = 1 << 40  # entries beyond count as this
_ROWS = "vec_id long, component int, deviation decimal(38,0), whitened double"


@dataclass
class Model:
    """Rows n, sums S per dimension, all eigenvalues of the covariance, and the leading unit eigenvectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def length(self) -> int:
        return len(self.sums)

    @property
    def positive(self) -> np.ndarray:
        """Which of the kept components vary at all."""
        top = self.values[: self.vectors.shape[1]]
        return top > (self.length * EPS * self.values[0] if len(top) else 0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, unrounded but for the last bit: whole numbers are subtracted first."""
        near = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - near) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; nan for a component that does not vary."""
        roots = np.where(self.positive, np.sqrt(np.abs(self.values[: self.vectors.shape[1]])), np.nan)
        return self.centred(x) @ self.vectors / roots


def _entries(column: pa.Array, length: int) -> np.ndarray:
    return scaled(column, length, LIMIT) + OFFSET


def _gram(y: np.ndarray) -> np.ndarray:
    """Exact products of columns, as Python integers."""
    top = int(np.abs(y).max(initial=0)) ** 2
    if top * len(y) < 1 << 53:
        return (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64).astype(object)
    if top * len(y) < 1 << 63:
        return (y.T @ y).astype(object)
    return y.T.astype(object) @ y.astype(object)


def _totals(rows: DataFrame, length: int, middle: list[int] | None) -> dict[tuple[int, int], int]:
    """Sums by (i, j): with `middle` the products of entries less it, else (i, -1) sums and (-1, -1) the count."""

    def run(batches):
        total = {}
        for batch in batches:
            x = _entries(batch.column(0), length)
            for a in range(0, len(x), 4096):
                if middle is None:
                    part = {(i, -1): s for i, s in enumerate(x[a : a + 4096].astype(object).sum(axis=0))}
                    part[-1, -1] = len(x[a : a + 4096])
                else:
                    gram = _gram(x[a : a + 4096] - np.array(middle, np.int64))
                    part = {(i, j): gram[i, j] for i in range(length) for j in range(i + 1)}
                for k, v in part.items():
                    total[k] = total.get(k, 0) + int(v)
        if total:
            keys = [pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)]
            sums = pa.array([Decimal(v) for v in total.values()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*keys, sums], ["i", "j", "v"])

    parts = rows.select("embedding").mapInArrow(run, "i int, j int, v decimal(38,0)")
    return {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model:
    """The model of all usable vectors (see `entries.usable`); without any, n is 0."""
    rows, length = usable(vectors)
    first = _totals(rows, length, None) if length else {}
    n = first.get((-1, -1), 0)
    if not n:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)))
    sums = [first[i, -1] for i in range(length)]
    middle = [round(Fraction(s, n)) for s in sums]
    products = _totals(rows, length, middle)
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    covariance = np.zeros((length, length), np.longdouble)
    for (i, j), v in products.items():
        exact = Fraction(n * v - rest[i] * rest[j], n * n)
        near = float(exact)
        covariance[i, j] = covariance[j, i] = np.longdouble(near) + np.longdouble(float(exact - Fraction(near)))
    values, basis = eigen(covariance)
    return Model(n, sums, values, np.ascontiguousarray(basis[:, :components]))


def identity_error(vectors: DataFrame, model: Model) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components that vary."""
    k = int(model.positive.sum())
    if not k:
        return None

    def totals(mean):
        def run(batches):
            total = np.zeros(k * k if mean is not None else k)
            for batch in batches:
                w = model.whitened(_entries(batch.column(0), model.length))[:, :k]
                total += w.sum(axis=0) if mean is None else ((w - mean).T @ (w - mean)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        sums = usable(vectors)[0].select("embedding").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        return np.array([r["v"] for r in sums.orderBy("i").collect()]) / model.n

    return float(np.abs(totals(totals(None)).reshape(k, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Model) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), deviation, whitened, explained of every usable vector.

    deviation is the exact sum over dimensions of (n * x - S)^2; explained is the component's share of the
    covariance's trace. Rows that share a vec_id each give rows of their own, a null vec_id stays null, and
    other columns are ignored. A component that does not vary has no whitened value (null); one vector alone
    has no explained share either. Entries beyond 2**40 count as that. An empty table gives no rows.
    """

    def run(batches):
        k = model.vectors.shape[1]
        for batch in batches:
            x = _entries(batch.column(1), model.length)
            for a in range(0, len(x), 2048):
                part = x[a : a + 2048]
                scaled_up = part.astype(object) * model.n - np.array(model.sums, object)
                deviation = [Decimal(v) if v < 10**38 else None for v in (scaled_up * scaled_up).sum(axis=1).tolist()]
                w = model.whitened(part).ravel()
                ids = batch.column(0).slice(a, len(part)).take(pa.array(np.repeat(np.arange(len(part)), k)))
                arrays = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1), len(part)), pa.int32()),
                    pa.array([d for d in deviation for _ in range(k)], pa.decimal128(38, 0)),
                    pa.array(w, pa.float64(), mask=np.isnan(w)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "deviation", "whitened"])

    trace = float(model.values.sum())
    shares = [float(v) / trace if trace > 0 else None for v in model.values[: model.vectors.shape[1]]]
    rows = usable(vectors)[0].select("vec_id", "embedding") if model.n else vectors.sparkSession.createDataFrame([], "vec_id long, embedding array<double>")
    share = F.element_at(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("component")) if shares else F.lit(None).cast("double")
    return rows.mapInArrow(run, _ROWS).withColumn("explained", share)
