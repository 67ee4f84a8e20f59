import hashlib
import random

import numpy as np
import pytest

from cellarbook.llm import suffix_dedup
from cellarbook.llm.queries import op11_suffix_dedup
from cellarbook.llm.suffix_sort import least_owner, sort_suffixes, stretches

FOLDER = "/root/testdata/sf0.01"


def by_hand(rows, length=50):
    """Every string of every text in a dictionary: sorted (doc_id, bytes, spans, kept)."""
    place = [(2**63 - 1 if i is None else i) for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    least = {}
    for p, t in zip(place, texts):
        for a in range(len(t) - length + 1):
            s = t[a : a + length]
            least[s] = min(p, least.get(s, p))
    out = []
    for (i, _), p, t in zip(rows, place, texts):
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if least[t[a : a + length]] < p:
                gone[a : a + length] = b"\1" * length
        spans, a = [], 0
        while (a := gone.find(1, a)) >= 0:
            b = gone.find(0, a)
            b = len(t) if b < 0 else b
            spans.append((a, b))
            a = b
        out.append((i, len(t), spans, bytes(x for x, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in frame.collect()), key=str)


def test_query_against_every_string(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = {i: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in by_hand(rows)}
    frame = op11_suffix_dedup(spark, FOLDER)
    assert frame.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = {r.doc_id: tuple(r)[1:] for r in frame.collect()}
    assert found == want and sum(v[1] for v in want.values()) > 1000


def shared_texts(seed, n=120, words=300):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(1, 9))) for _ in range(words)]
    passages = [" ".join(rng.choices(pool, k=rng.randint(5, 40))) for _ in range(4)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(pool, k=rng.randint(0, 60)))
        if rng.random() < 0.7:
            cut = rng.randint(0, len(text))
            text = text[:cut] + rng.choice(passages) + text[cut:]
        rows.append((rng.randint(-5, 10**12), text))
        if rng.random() < 0.2:
            copy = list(text)
            if copy:
                copy[rng.randrange(len(copy))] = "#"
            rows.append((rng.randint(0, 10**12), "".join(copy)))
    return rows


@pytest.mark.parametrize("hot", [1024, 3])
def test_passages_copies_and_hot_leads(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = shared_texts(7)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # The hot limit is read where the function runs, which is another process.
    shared = suffix_dedup._shared_leads
    monkeypatch.setattr(suffix_dedup, "_shared_leads", lambda table: (setattr(suffix_dedup, "HOT", hot), shared(table))[1])
    assert got(suffix_dedup.remove_repeats(frame)) == by_hand(rows)


def test_odd_rows_ties_and_clashing_columns(spark):
    long = "ab" * 40_000
    rows = [(5, "x" * 300), (3, "x" * 120), (3, "y" + "x" * 200), (None, "x" * 60), (None, "z" * 60), (7, "z" * 60), (8, None), (9, ""), (10, "x" * 49)]
    rows += [(11, long), (12, long[:5000] + "c" + long[:77]), (12, long[:5000] + "c" + long[:77]), (13, "é" * 30), (14, "\0" * 70), (15, "\0" * 50)]
    frame = spark.createDataFrame([(i, t, 1, "q", b"") for i, t in rows], "doc_id long, text string, chunk int, place string, kept binary")
    assert got(suffix_dedup.remove_repeats(frame.repartition(4))) == by_hand(rows)
    assert got(suffix_dedup.remove_repeats(frame.where("doc_id = 1"))) == []
    assert got(suffix_dedup.remove_repeats(frame.where("text IS NULL"))) == [(8, 0, [], b"")]


def test_other_lengths(spark):
    rows = shared_texts(3, n=40)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(suffix_dedup.remove_repeats(frame, 17)) == by_hand(rows, 17)


def test_multikey_sort_and_owners():
    rng = np.random.default_rng(2)
    for length in (5, 8, 20, 50):
        data = rng.integers(97, 99, 4000).astype(np.uint8)
        data[1000:2000] = data[:1000]
        starts = np.arange(len(data) - length + 1)
        order, new = sort_suffixes(data, starts, length)
        strings = [data[a : a + length].tobytes() for a in order]
        assert strings == sorted(strings)
        assert new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]
        offsets, owner = np.array([0, 10, 1500, 1500, 4000]), np.array([4, 9, 1, 2])
        found, first = least_owner(data, offsets, owner, length)
        least = {}
        for a, b, o in zip(offsets, offsets[1:], owner):
            for s in range(a, b - length + 1):
                key = data[s : s + length].tobytes()
                least[key] = min(o, least.get(key, o))
        assert found.tolist() == [least[data[s : s + length].tobytes()] for a, b in zip(offsets, offsets[1:]) for s in range(a, b - length + 1)]
        assert first[-1] == len(found)


def test_stretches_of_equal_strings_share_the_leading_part(monkeypatch):
    from cellarbook.llm import suffix_sort

    rng = np.random.default_rng(4)
    shared = rng.integers(97, 105, 400).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 105, n).astype(np.uint8), shared, rng.integers(97, 105, 90).astype(np.uint8)]) for n in (0, 3, 700)]
    data, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    leads = []
    for block in (1 << 20, 333):
        monkeypatch.setattr(suffix_sort, "BLOCK", block)
        s = stretches(data, offsets, 50)
        by_start = {a: int(h) for f, l, h in zip(s.first, s.last, s.hash) for a in range(f, l + 1)}
        assert sorted(by_start) == [a for b, e in zip(offsets, offsets[1:]) for a in range(b, e - 49)]
        leads.append(by_start)
        at = [int(o) + n for o, n in zip(offsets, (0, 3, 700))]
        for k in range(351):
            assert len({by_start[a + k] for a in at}) == 1
    assert leads[0] == leads[1]
