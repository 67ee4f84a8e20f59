"""Gradient-boosted trees for two classes over a few numeric features (logistic loss, trees of one depth).

Trees grow from sums over the rows by node, feature and bin. `fit` takes these sums of arrays, `fit_rows` of a
table of any size by one Spark job for each level of a tree; the driver sees the sums only. Slopes and curves
are added up as whole numbers, so the trees do not depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, DEPTH, RATE, LEAST = 40, 3, 0.3, 5
#: Bins of a feature, and the cut of a node that has none.
BINS, NO_CUT = 33, 255
#: Tasks that add up the sums of a level: a few thousand numbers of each task that reads rows, however many rows.
ADDING = 4
#: Slopes and curves are counted in parts of one.
UNIT = 1 << 20
#: Steps of a margin of 1 by which `threshold` tells scores of a table apart, and where margins end.
STEPS, END = 256, 30
#: Values up to it are cuts as they are; beyond, 32 values between one power of two and the next.
FINE = 64

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]  # feature and bin of each inner node, leaves


@dataclass
class Boosted:
    """Sum of complete binary trees: inner nodes compare a feature with a cut, leaves add to the log odds."""

    start: float = 0.0
    depth: int = 3
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            out += leaf[_node(x, feature, cut, self.depth) - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _probability(self.margin(x))


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -END, END)))


def _node(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row reaches after so many levels."""
    rows, node = np.arange(len(x)), np.zeros(len(x), int)
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    return node


def _margin(bins: np.ndarray, start: float, trees: Sequence[Tree]) -> np.ndarray:
    out = np.full(len(bins), start)
    for feature, cut, leaf in trees:
        out += leaf[_node(bins, feature, cut, DEPTH) - (2**DEPTH - 1)]
    return out


def _sums(bins: np.ndarray, y: np.ndarray, times: np.ndarray, start: float, trees: Sequence[Tree], grown, level: int) -> np.ndarray:
    """Slopes, curves and number of rows by node of a level of the tree being grown, feature and bin."""
    p = 1 / (1 + np.exp(-_margin(bins, start, trees)))
    width = bins.shape[1]
    node = _node(bins, *grown, level) - (2**level - 1)
    place = ((node[:, None] * width + np.arange(width)) * BINS + bins).ravel()
    parts = (np.rint((y - p) * UNIT) * times, np.rint(p * (1 - p) * UNIT) * times, times)
    size = 2**level * width * BINS
    return np.stack([np.bincount(place, np.repeat(w, width), size) for w in parts]).astype(np.int64).reshape(3, -1, width, BINS)


def _best(found: np.ndarray) -> tuple[int, int] | None:
    """Feature and bin of the cut that lowers the second-order loss of a node most."""
    g, h, n = np.cumsum(found, axis=-1)
    s, c, rows = g[0, -1] / UNIT, h[0, -1] / UNIT, n[0, -1]
    g, h, n = g[:, :-1] / UNIT, h[:, :-1] / UNIT, n[:, :-1]
    gain = g * g / (h + 1) + (s - g) ** 2 / (c - h + 1) - s * s / (c + 1)
    gain[(n < LEAST) | (rows - n < LEAST)] = 0
    feature, cut = np.unravel_index(gain.argmax(), gain.shape)
    return (int(feature), int(cut)) if gain[feature, cut] > 1e-6 else None


def _grow(sums: Callable, rows: float, ones: float, cuts: Sequence[np.ndarray]) -> tuple[Boosted, list[Tree]]:
    """Trees from `sums(start, trees, grown, level)`; the trees once more by bins."""
    share = min(max(ones / rows if rows else 0.5, 1e-3), 1 - 1e-3)
    model, trees = Boosted(float(np.log(share / (1 - share))), DEPTH), []
    if not 0 < ones < rows:
        return model, trees
    inner = 2**DEPTH - 1
    for _ in range(ROUNDS):
        feature, cut, leaf = np.zeros(inner, int), np.full(inner, NO_CUT), np.zeros(inner + 1)
        for level in range(DEPTH):
            found = sums(model.start, trees, (feature, cut), level)
            for i in range(2**level):
                here, own = 2**level - 1 + i, found[:, i]
                if best := _best(own):
                    feature[here], cut[here] = best
                if level == DEPTH - 1:
                    low = own[:2, feature[here], : cut[here] + 1].sum(-1)
                    for side, (g, h) in enumerate((low / UNIT, (own[:2, 0].sum(-1) - low) / UNIT)):
                        leaf[2 * i + side] = RATE * g / (h + 1)
        trees.append((feature, cut, leaf))
        model.features.append(feature)
        model.cuts.append(np.array([np.inf if b == NO_CUT else cuts[f][b] for f, b in zip(feature, cut, strict=True)]))
        model.leaves.append(leaf)
    return model, trees


def _cuts(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Values, of ascending ones, at equal shares of the rows."""
    reached = np.cumsum(times)
    shares = np.arange(1, BINS) / BINS * reached[-1]
    return np.unique(np.asarray(values, float)[np.searchsorted(reached, shares)])


def _coarse(v: np.ndarray) -> np.ndarray:
    """Values of a feature, not below 0, as cuts take them (`FINE`)."""
    step = 2.0 ** (np.floor(np.log2(np.maximum(v, FINE) + 0.5)) - 5)
    return np.where(v < FINE, v, np.floor(v / step) * step)


def _binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """x > cut[b] is bin > b."""
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.uint8)


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Fit on rows `x` and labels 0/1."""
    if len(y) == 0:
        return _grow(None, 0, 0, [])[0]
    cuts = [_cuts(*np.unique(_coarse(x[:, j]), return_counts=True)) for j in range(x.shape[1])]
    bins, times = _binned(x, cuts), np.ones(len(y))
    return _grow(lambda *now: _sums(bins, y, times, *now), len(y), y.sum(), cuts)[0]


def threshold(scores: np.ndarray, labels: np.ndarray, precision: float, times: np.ndarray | None = None) -> float:
    """The lowest score from which on the share of label 1 is at least `precision`; above all scores if none is."""
    order = np.argsort(-scores, kind="stable")
    times = np.ones(len(scores)) if times is None else times
    right = np.cumsum((labels * times)[order]) / np.cumsum(times[order])
    last = np.ones(len(order), bool)  # equal scores stand or fall together
    last[:-1] = scores[order][1:] != scores[order][:-1]
    good = np.flatnonzero((right >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else 2.0


def _cut_table(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The cuts of all features, from counts of all their values as `_coarse` gives them, a few hundred at most."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col("v"), F.lit(float(FINE))) + 0.5)) - 5)
    value = F.when(F.col("v") < FINE, F.col("v")).otherwise(F.floor(F.col("v") / step) * step).alias("v")
    counts = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j", value).agg(F.count(F.lit(1)).alias("n")).collect()
    by_feature: list[dict[float, int]] = [{} for _ in range(width)]
    for r in counts:
        by_feature[r.j][r.v] = r.n
    return [_cuts(sorted(own), [own[v] for v in sorted(own)]) for own in by_feature]


def _blocks(batches, width: int):
    """Bins and the other columns of Arrow batches."""
    for batch in batches:
        bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
        yield bins, [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]


def binned_rows(rows: DataFrame, cuts: Sequence[np.ndarray]) -> DataFrame:
    """(bins, kind, apart, y, times): equal rows of the table (x, kind, apart, y) are one."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(cuts))
            bins = pa.array([b.tobytes() for b in _binned(x, cuts)], pa.binary())
            yield pa.RecordBatch.from_arrays([bins, *batch.columns[1:]], ["bins", "kind", "apart", "y"])

    own = rows.select("x", "kind", "apart", "y").mapInArrow(run, "bins binary, kind int, apart boolean, y int")
    return own.groupBy("bins", "kind", "apart", "y").agg(F.count(F.lit(1)).alias("times"))


def fit_rows(rows: DataFrame, width: int, store: Callable[[DataFrame], DataFrame]) -> tuple[Boosted, DataFrame]:
    """Fit on all rows of a stored table (x, kind, apart, y) that are not `apart`; a label is 0 or 1.

    Also returns scores of those apart: (kind, score, y, times), with margins rounded down to whole `STEPS`. `store` writes
    the binned rows, which are read once for each level of each tree.
    """
    cuts = _cut_table(rows.where("NOT apart"), width) if rows.where("NOT apart").head(1) else [np.zeros(0)] * width
    stored = store(binned_rows(rows, cuts))
    own = stored.where("NOT apart").select("bins", "y", "times")
    total = own.agg(F.sum("times").alias("n"), F.sum(F.col("y") * F.col("times")).alias("ones")).first()

    def sums(start, trees, grown, level):
        def run(batches):
            found = np.zeros((3, 2**level, width, BINS), np.int64)
            for bins, (y, times) in _blocks(batches, width):
                found += _sums(bins, y, times, start, trees, grown, level)
            g, h, n = found.reshape(3, -1)
            place = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (place, g[place], h[place], n[place])], ["place", "g", "h", "n"])

        parts = own.mapInArrow(run, "place long, g long, h long, n long").groupBy("place").agg(*[F.sum(c).alias(c) for c in "ghn"])
        parts = parts.coalesce(ADDING)
        found = np.zeros((3, 2**level * width * BINS), np.int64)
        for r in parts.collect():
            found[:, r.place] = r.g, r.h, r.n
        return found.reshape(3, 2**level, width, BINS)

    model, trees = _grow(sums, total.n or 0, total.ones or 0, cuts)

    def scored(batches):
        for bins, (kind, y, times) in _blocks(batches, width):
            margin = np.clip(_margin(bins, model.start, trees), -END, END)
            step = np.floor(margin * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, step, y, times)], ["kind", "step", "y", "times"])

    held = stored.where("apart").select("bins", "kind", "y", "times")
    steps = held.mapInArrow(scored, "kind int, step int, y int, times long").groupBy("kind", "step", "y")
    return model, steps.agg(F.sum("times").alias("times"))


def score_of(step: np.ndarray) -> np.ndarray:
    """The score of a margin in whole `STEPS`."""
    return _probability(step / STEPS)
