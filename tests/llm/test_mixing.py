import re
from collections import defaultdict

import pytest

from cellarbook.llm import mixing
from cellarbook.llm.queries import op2_mixing

FOLDER = "/root/testdata/sf0.01"


def by_hand(sizes: dict):
    """Shares by weight, stopped at three times a source's size, the excess shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = total - sum(stopped.values())
        free = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 3.0 * sizes[s] for s in over}


def check(rows, docs, near):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs]
    sizes, source = defaultdict(int), {}
    for d, n in zip(docs, words, strict=True):
        sizes[d["source"]] += n
        source[d["doc_id"]] = d["source"]
    want, taken = by_hand(sizes), defaultdict(int)
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((d["doc_id"], n) for d, n in zip(docs, words, strict=True))
    for r in rows:
        own = source[r.doc_id]
        assert r.source_size == sizes[own] and r.target == pytest.approx(want[own])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[own] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= near * max(t, 1), (s, taken[s], t)


def test_words_taken_come_near_the_targets(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    first, again = op2_mixing(spark, FOLDER).collect(), op2_mixing(spark, FOLDER).collect()
    check(first, docs, 0.002)
    assert sorted(first) == sorted(again)


def test_blocks_leave_little_and_sources_balance(spark):
    """Many small blocks and several rounds: the totals of words and documents still hold."""
    docs = spark.range(6000).selectExpr(
        "id AS doc_id", "repeat('w ', 1 + int(hash(id, 3) % 40 + 40)) AS text", "IF(id % 3 = 0, 'hot', 's' || (id % 7)) AS source", "1 AS size", "2 AS part"
    )
    rows = mixing.mix(docs, block=64).collect()
    words, want, copies, docs_wanted = defaultdict(int), {}, defaultdict(int), defaultdict(float)
    for r in rows:
        words[r.source] += r.size * r.copies
        copies[r.source] += r.copies
        want[r.source] = r.target
        docs_wanted[r.source] += r.target / r.source_size
    for s in want:
        assert abs(words[s] - want[s]) <= 0.01 * want[s] and abs(copies[s] - docs_wanted[s]) <= 8


def test_flight_keeps_totals_and_expectations():
    import numpy as np

    rng, seen = np.random.default_rng(1), np.zeros(9)
    sizes = [9.0, 7, 7, 5, 4, 4, 3, 2, 1]
    for _ in range(3000):
        part = [0.3] * 9
        mixing.flight(sizes, part, rng)
        assert sum(part) == pytest.approx(2.7) and sum(p * s for p, s in zip(part, sizes)) == pytest.approx(0.3 * 42)
        seen += part
    assert abs(seen / 3000 - 0.3).max() < 0.03


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (None, "x y", None), (3, "a b c", ""), (3, "a b c", ""), (4, "q " * 50_000, "a"), (5, " \t\n", "z"), (6, "é ü", "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    renamed = [r.asDict() | {"taken": r.size * r.copies} for r in got]
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in renamed)
    want = by_hand({"a": 50_000, None: 2, "": 6, "z": 0, "é": 2})
    assert all(r.target == pytest.approx(want[r.source]) for r in got)
    assert mixing.mix(docs.limit(0)).collect() == []
