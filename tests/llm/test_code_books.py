import hashlib
import math

import numpy as np
import pytest

from cellarbook.llm import code_books
from cellarbook.llm.queries import op13_code_books

FOLDER = "/root/testdata/sf0.01"


def by_hand(rows, rounds=4):
    """Plain rounds over every entry: {index of row: (code, error)}, sha256 of the codebooks."""
    x = np.array([[math.floor(1024 * c) for c in v] for v in rows], np.int64)
    width = x.shape[1] // 4
    codes, errors, books = [], 0, []
    for p in range(4):
        own = x[:, p * width : (p + 1) * width]
        book = own[:256].copy()
        for step in range(rounds + 1):
            far = ((own[:, None] - book) ** 2).sum(axis=2)
            near = far.argmin(axis=1)
            if step < rounds:
                for e in range(len(book)):
                    if (near == e).any():
                        book[e] = own[near == e].sum(axis=0) // (near == e).sum()
        codes.append(near)
        errors = errors + far.min(axis=1)
        books += book.ravel().tolist()
    text = ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(x))]
    return text, errors.tolist(), hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def test_query_against_every_entry(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    text, errors, digest = by_hand([r.embedding for r in rows])
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r.label] = by_label.get(r.label, 0) + e
    got = op13_code_books(spark, FOLDER)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    found = {r.vec_id: tuple(r)[1:] for r in got.collect()}
    assert found == {r.vec_id: (t, e, by_label[r.label], digest) for r, t, e in zip(rows, text, errors)}


def clustered(n, dim=16, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((40, dim))[rng.integers(0, 40, n)] + spread * rng.standard_normal((n, dim))).tolist()


def test_bounds_skip_distances_and_change_nothing(spark):
    rows = clustered(3000)
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(5)
    codes, books = code_books.compress(frame)
    text, errors, digest = by_hand(rows)
    found = {r.vec_id: (r.code.hex(), r.error) for r in codes.collect()}
    assert found == {i: (t, e) for i, (t, e) in enumerate(zip(text, errors))}
    assert books.digest() == digest
    assert codes.agg({"computed": "sum"}).first()[0] < 0.6 * 4 * 256 * len(rows)


def test_net_way_is_below_summed_steps():
    books = [np.array([[0, 0], [9, 9]]), np.array([[40, 0], [9, 9]]), np.array([[1, 0], [9, 9]])]
    part = code_books.Part(books, np.array([0, 1]))
    assert part.moves()[:, 0] == pytest.approx([1, 39, 0], rel=1e-5) and part.moves()[0, 0] < 40 + 39


def test_ties_repeats_and_few_rows(spark):
    grid = [[float(a), float(b), 0.0, 0.0, 1.0, 1.0, float(a), 0.5] for a in range(4) for b in range(4)] * 30
    frame = spark.createDataFrame(list(enumerate(grid)), "vec_id long, embedding array<float>").repartition(3)
    codes, books = code_books.compress(frame)
    text, errors, digest = by_hand(grid)
    assert {r.vec_id: (r.code.hex(), r.error) for r in codes.collect()} == {i: (t, e) for i, (t, e) in enumerate(zip(text, errors))}
    assert books.digest() == digest
    back = code_books.decode(codes, books).collect()
    assert all(r.error == 0 and r.decoded == grid[r.vec_id] for r in back)


def test_odd_rows_clashing_columns_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int, codes string, x string"
    inf, nan = float("inf"), float("nan")
    odd = [(1, None, 1, "", ""), (2, [], 1, "", ""), (3, [1.0, None, 1.0, 1.0], 1, "", ""), (4, [nan] * 4, 1, "", ""), (5, [inf] * 4, 2, "", ""), (6, [1.0] * 8, 1, "", "")]
    good = [(7, [0.0, 1.0, -0.001, 3.0], None, "q", "w"), (7, [0.5, 1.0, 2.0, 3.0], 1, None, None), (None, [0.0, 1.0, 2.0, 3.0], None, "q", "w")]
    codes, books = code_books.compress(spark.createDataFrame(odd + good, schema), ["label", "codes", "x"])
    assert sorted((str(r.vec_id), str(r.label), str(r.x), r.error) for r in codes.collect()) == [("7", "1", "None", 0), ("7", "None", "w", 0), ("None", "None", "w", 0)]
    assert len(books.parts[0].books[-1]) == 3
    codes, books = code_books.compress(spark.createDataFrame(odd[:2], schema))
    assert codes.count() == 0 and books is None
    three = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    assert code_books.compress(three)[0].count() == 0


def test_large_entries_are_compared_in_whole_numbers():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-(2**27), 2**27, (50, 16)), rng.integers(-(2**27), 2**27, (9, 16))
    assert (code_books.squared(x, book) == ((x[:, None] - book) ** 2).sum(axis=2)).all()
