import numpy as np

from cellarbook.llm import vector_dups
from cellarbook.llm.graph import forest
from cellarbook.llm.hnsw import Hnsw
from cellarbook.llm.queries import op7_vector_dups

FOLDER = "/root/testdata/sf0.01"


def by_hand(rows):
    ids = [i for i, _ in rows]
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v), g in zip(rows, good)]
    links, n = [], {i: 0 for i in ids}
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.95:
                links.append((ids[a], ids[b]))
                n[ids[a]] += 1
                n[ids[b]] += 1
    top = forest(links)
    return {i: (n[i], top.get(i, i), top.get(i, i) == i) for i in ids}


def got(frame):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in frame.collect()}


def test_all_vectors_against_every_pair(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert got(op7_vector_dups(spark, FOLDER)) == by_hand(rows)


def test_large_groups_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(240)]
    rows += [(300 + i, base[0].tolist()) for i in range(150)] + [(500 + i, rng.standard_normal(16).tolist()) for i in range(200)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [float("inf")] + [1.0] * 15)]
    rows += [(905, [None] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, (3e5 * base[1]).tolist())]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, dim int").repartition(3)
    want = by_hand(rows)
    assert got(vector_dups.group(frame)) == want
    assert got(vector_dups.group(frame, shard_size=100)) == want
    assert vector_dups.group(frame.limit(0)).collect() == []
    assert [tuple(r) for r in vector_dups.group(spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<float>")).collect()] == [(None, 0, None, True)]


def test_graph_finds_what_an_exact_search_finds():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Hnsw.build(v)
    ids, sims = Hnsw.opened(v, graph.blob()).search(v[:200], 60)
    assert (ids[:, 0] == np.arange(200)).mean() > 0.97
    true = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.9
    assert (np.diff(sims, axis=1) <= 1e-6).all()


def test_blocks_of_many_shards(spark, monkeypatch):
    """Links within and across shards, each shard searched in several blocks."""
    monkeypatch.setattr(vector_dups, "BLOCK", 16)
    rng = np.random.default_rng(11)
    base = rng.standard_normal((40, 12))
    rows = [(int(i), (base[i % 40] + 0.06 * rng.standard_normal(12)).tolist()) for i in rng.permutation(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert got(vector_dups.group(frame, shard_size=60)) == by_hand(rows)
