import math
from fractions import Fraction

import numpy as np
import pytest

from cellarbook.llm import whitening
from cellarbook.llm.eigen import eigen, polar
from cellarbook.llm.queries import op12_whitening

FOLDER = "/root/testdata/sf0.01"


def by_hand(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, sums)] for row in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    deviation = ((x * n - sums) ** 2).sum(axis=1)
    return kept, n, deviation, values, centred @ basis[:, :8] / np.sqrt(values[:8])


def test_query_against_whole_matrix(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    kept, n, deviation, values, white = by_hand(rows)
    got = op12_whitening(spark, FOLDER)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    found = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(found) == 8 * len(kept)
    for c in range(8):
        own = np.array([found[i, c + 1].whitened for i, _ in kept])
        sign = np.sign(own @ white[:, c])
        assert np.abs(own * sign - white[:, c]).max() < 1e-7
    one = found[kept[0][0], 1]
    assert one.n == n and one.explained == pytest.approx(values[0] / values.sum(), rel=1e-10)
    assert all(found[i, 3].deviation == int(d) for (i, _), d in zip(kept, deviation))
    assert {r.identity_error for r in found.values()} == {one.identity_error} and one.identity_error < 1e-9


def test_odd_rows_ties_and_one_vector(spark):
    schema = "vec_id long, embedding array<float>, n string, component string"
    inf, nan = float("inf"), float("nan")
    odd = [(1, None, "a", "b"), (2, [], "a", "b"), (3, [1.0, None], "a", "b"), (4, [nan, 1.0], None, None), (5, [1.0, -inf], "a", "b"), (9, [1.0, 2.0, 3.0], "", "")]
    rows = [(6, [0.0, 1.0], "a", "b"), (7, [1.0, 1.0], "a", "b"), (7, [1.0, 1.0], "a", "b"), (None, [0.5, 1.0], "a", "b")]
    frame = spark.createDataFrame(odd + rows, schema).repartition(3)
    model = whitening.fit(frame)
    found = whitening.whiten(frame, model)
    assert found.columns == ["vec_id", "component", "deviation", "whitened", "explained"]
    got = found.collect()
    assert sorted(str(r.vec_id) for r in got) == ["6", "6", "7", "7", "7", "7", "None", "None"]
    assert {r.component: r.explained for r in got} == {1: 1.0, 2: 0.0}
    assert all(r.whitened is None for r in got if r.component == 2)  # the second entry never changes
    assert sum(r.whitened for r in got if r.component == 1) == pytest.approx(0, abs=1e-12)
    assert whitening.identity_error(frame, model) < 1e-12
    alone = spark.createDataFrame(rows[:1], schema)
    assert [(r.whitened, r.explained) for r in whitening.whiten(alone, whitening.fit(alone)).collect()] == [(None, None)] * 2
    empty = spark.createDataFrame(odd[:2], schema)
    assert whitening.whiten(empty, whitening.fit(empty)).count() == 0
    assert whitening.identity_error(empty, whitening.fit(empty)) is None


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**28 + 3 * i), float(-(2**27) - i * i)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    kept, n, deviation, values, white = by_hand(rows)
    model = whitening.fit(frame)
    found = {(r.vec_id, r.component): r for r in whitening.whiten(frame, model).collect()}
    assert all(int(found[i, 1].deviation) == d for (i, _), d in zip(kept, deviation))
    assert np.allclose([abs(found[i, 1].whitened) for i, _ in kept], np.abs(white[:, 0]), atol=1e-8)


@pytest.mark.parametrize("values", [[5.0, 5.0, 5.0, 1.0], [3.0, 0.0, 0.0, 0.0, 0.0], [1e9, 1.0, 1e-3, 1e-3 + 1e-9], list(range(1, 40))])
def test_spectrum_is_split_into_single_components(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, basis = eigen(a.astype(np.longdouble))
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-13 * max(values))
    assert np.abs(basis.T @ basis - np.eye(len(a))).max() < 1e-10
    assert np.abs(a @ basis - basis * found).max() <= 1e-12 * max(values)


def test_polar_factor_is_the_sign():
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((6, 6)))
    values = np.array([1e-9, -2, 3, -4e-5, 100, -1])
    assert np.allclose(polar((q * values) @ q.T), (q * np.sign(values)) @ q.T, atol=1e-6)
