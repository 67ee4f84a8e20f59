import numpy as np

from cellarbook.llm import vector_search
from cellarbook.llm.queries import op9_vector_search


def by_hand(rows, picks, k):
    out = {}
    for name, q in rows:
        if picks(name):
            scored = sorted((-float((np.array(v) * np.array(q)).sum()), i) for i, v in rows if i != name and len(v) == len(q))
            out[name] = [(i, -s) for s, i in scored[:k]]
    return out


def got(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for own in out.values():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
    return {q: [(i, s) for _, i, s in own] for q, own in out.items()}


def recall(found, want):
    return np.mean([len({i for i, _ in found[q]} & {i for i, _ in own}) / max(1, len(own)) for q, own in want.items()])


def check_scores(found, rows):
    vectors = dict(rows)
    for q, own in found.items():
        for i, s in own:
            assert i != q and abs(s - float(np.dot(np.array(vectors[i], float), np.array(vectors[q], float)))) < 1e-9
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_recall_and_scores_on_the_given_vectors(spark):
    for scale in ("0.01",):
        folder = f"/root/testdata/sf{scale}"
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        want, found = by_hand(rows, lambda i: i % 20 == 0, 20), got(op9_vector_search(spark, folder))
        assert set(found) == set(want) and all(len(own) == 20 for own in found.values())
        check_scores(found, rows)
        assert recall(found, want) >= 0.95


def test_lengths_ties_and_clusters(spark):
    """Long and short vectors, a vector repeated a thousand times, and tight clusters."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 16))
    rows = [(i, ((0.2 + i % 7) * (base[i % 12] + 0.3 * rng.standard_normal(16))).tolist()) for i in range(3000)]
    rows += [(5000 + i, (2 * base[3]).tolist()) for i in range(1000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, dim int").repartition(4)
    want, found = by_hand(rows, lambda i: i % 100 == 0, 10), got(vector_search.search(frame, "vec_id % 100 = 0", 10))
    check_scores(found, rows)
    assert recall(found, want) >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (20, [0.0, 1.0]), (3, None), (40, [0.0, 0.0]), (5, [float("nan"), 1.0])]
    rows += [(6, [None, 1.0]), (7, []), (60, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 5.0) for r in rows], "vec_id long, embedding array<float>, score double")
    found = got(vector_search.search(frame, "vec_id % 20 = 0", 20))
    assert found == {0: [(1, 1.0), (2, 1.0), (20, 0.0)], 20: [(1, 1.0), (2, 1.0), (0, 0.0)]}
    assert vector_search.search(frame.limit(0), "vec_id % 20 = 0").collect() == []


def test_groups_of_equal_size():
    rng = np.random.default_rng(7)
    centers = vector_search.centroids(rng.standard_normal((1000, 8)).astype(np.float32), 30)
    assert len(centers) == 32 and np.allclose((centers**2).sum(1), 1, atol=1e-5)


def test_recall_over_many_lists(spark):
    """20,000 vectors in 128 lists: clusters of many sizes, and vectors without structure."""
    rng = np.random.default_rng(8)
    base, sizes = rng.standard_normal((300, 24)), rng.zipf(1.5, 10_000) % 300
    clustered = base[sizes] * (0.5 + rng.random((10_000, 1))) + 0.4 * rng.standard_normal((10_000, 24))
    v = np.concatenate([clustered, rng.standard_normal((10_000, 24))])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(8)
    asked = np.arange(0, len(v), 100)
    scores = v[asked] @ v.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {int(q): set(np.argsort(-s)[:20].tolist()) for q, s in zip(asked, scores)}
    found = got(vector_search.search(frame, "vec_id % 100 = 0", 20, list_size=160))
    shares = np.array([len({i for i, _ in found[q]} & own) / 20 for q, own in want.items()])
    assert shares.mean() >= 0.95 and shares.min() >= 0.7, (shares.mean(), shares.min())


def test_every_list_within_the_ratio_is_found():
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((300, 8)).astype(np.float32)
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    lists, queries = vector_search.Lists(centers, 1.0), rng.standard_normal((50, 7))
    lists.ratios = np.array([1.6])
    rows, own = lists.of_queries(queries)
    far = vector_search._distance(vector_search._asked(queries) @ centers.T)
    want = far <= 1.6 * far.min(1, keepdims=True)
    assert want.sum(1).max() > 16
    assert want[rows, own].mean() > 0.99 and len(rows) >= 0.98 * want.sum()


def test_queries_whose_lists_hold_too_few(spark):
    """A far vector has a list of its own; its query is answered from all lists."""
    rng = np.random.default_rng(10)
    rows = [(i, (rng.standard_normal(6) + np.eye(6)[0] * 9).tolist()) for i in range(1, 400)] + [(0, [-9.0] + [0.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, found = by_hand(rows, lambda i: i % 50 == 0, 20), got(vector_search.search(frame, "vec_id % 50 = 0", 20, list_size=10))
    assert all(len(own) == 20 for own in found.values()) and set(found) == set(want)
    check_scores(found, rows)


def test_merging_in_parts(monkeypatch):
    """Merged results of many parts are the best of all, also where little can be held."""
    monkeypatch.setattr(vector_search, "HELD", 50)
    rng = np.random.default_rng(12)
    triples = [(np.sort(rng.integers(0, 9, 30)), rng.integers(0, 40, 30), rng.integers(0, 12, 30) / 4) for _ in range(20)]
    seen = {}
    for batch in vector_search.combined(iter(triples), 5):
        for name, best in zip(*batch.to_pydict().values()):
            seen.setdefault(name, set()).update((b["minus"], b["vec_id"]) for b in best)
    want = {}
    for names, ids, scores in triples:
        for name, i, x in zip(names.tolist(), ids.tolist(), scores.tolist()):
            want.setdefault(name, set()).add((-x, i))
    assert {q: sorted(own)[:5] for q, own in seen.items()} == {q: sorted(own)[:5] for q, own in want.items()}
