import random
import re

import numpy as np
import pytest

from cellarbook.llm import graph, ngram_join, trie
from cellarbook.llm.queries import op4_ngram_join

FOLDER = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def by_hand(docs, k, percent):
    """Sizes and components by comparing every two documents that share a shingle."""
    sets = [(i, plain_set(t, k)) for i, t in docs]
    where, links = {}, []
    for x, (_, s) in enumerate(sets):
        partners = {}
        for g in s:
            for y in where.get(g, ()):
                partners[y] = partners.get(y, 0) + 1
            where.setdefault(g, []).append(x)
        for y, both in partners.items():
            if 100 * both >= percent * (len(s) + len(sets[y][1]) - both):
                links.append((sets[x][0], sets[y][0]))
    top = graph.forest(links)
    return {i: (len(s), top.get(i, i)) for i, s in sets}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_all_documents_against_every_pair(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = by_hand(docs, 3, 90)
    assert got(op4_ngram_join(spark, FOLDER)) == want
    assert sum(i != c for i, (_, c) in want.items()) > 20


@pytest.mark.parametrize("words,percent,changes", [(3, 90, 9), (5, 80, 16)])
def test_families_near_the_threshold(spark, words, percent, changes):
    rng = random.Random(words)
    docs, n = [], 0
    for family in range(12):
        base = [f"w{rng.randrange(40 if family % 2 else 4000)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.choice([2, 9, 40])):
            own = list(base)
            for _ in range(rng.randrange(changes)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            docs.append((n * 7 % 1009, " ".join(own)))
            n += 1
    docs += [(2000 + i, "the same passage in every one of these texts " * 2 + f"and a word {i} more {i * i}") for i in range(60)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(ngram_join.group(frame, words, percent)) == by_hand(docs, words, percent)


def test_odd_rows(spark):
    rows = [
        (1, None, 1), (2, "", 1), (3, " \t\n", 1), (4, "One", 1), (5, "one", 2), (6, "one two", 1), (7, "ONE\ttwo", 1), (8, "a b c", 0),
        (9, "a b c", 0), (9, "a b c", 0), (None, "a b c", 0), (None, "q", 0), (10, "w " * 30_000, 0), (11, "É b c", 0), (12, "é b c", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "sig")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.group(docs, 3, 90).collect()), key=str)
    want = [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 8), (9, 1, 8), (None, 1, None),
        (None, 1, None), (10, 1, 10), (11, 1, 11), (12, 1, 12),
    ]
    assert out == sorted(want, key=str)
    assert ngram_join.group(docs.limit(0)).collect() == []


def test_tree_against_plain_sets():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 5000, 300).astype(np.uint64))
    sets = []
    for i in range(120):
        keep = rng.random(len(base)) < rng.choice([0.5, 0.93, 0.99, 1.0])
        sets.append((i, np.unique(np.concatenate([base[keep], rng.integers(0, 5000, rng.integers(0, 12)).astype(np.uint64)]))))
    tree = trie.build(sets)
    for percent in (50, 80, 90, 100):
        for _, probe in sets[::7]:
            p = set(probe.tolist())
            want = sorted(i for i, s in sets if 100 * len(p & set(s.tolist())) >= percent * len(p | set(s.tolist())))
            assert sorted(trie.similar(tree, probe, percent)) == want
    assert trie.similar(trie.build([]), base, 90) == []


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(500)] + [(5, 5), (None, 3), (999, 1000)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    out = {r.node: r.component for r in graph.components(frame).collect()}
    want = {x: t for x, t in graph.forest([p for p in links if None not in p]).items() if x != t}
    assert out == want
    assert graph.components(frame.limit(0)).collect() == []


def test_words_that_a_polynomial_hash_takes_for_one(spark):
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[x ^ turn] for x in bits) for turn in (0, 1))
    rows = [(1, one), (2, two), (3, one), (4, f"x {one} y z"), (5, f"x {two} y z"), (6, f"X {one} Y Z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.group(frame, 3, 90)) == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (2, 4), 5: (2, 5), 6: (2, 4)}


def test_rows_that_share_an_id_keep_their_sets_and_links(spark):
    rng = random.Random(9)
    first, second = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(2))

    def edited(words):
        return " ".join([*words[:-1], f"x{rng.randrange(10**6)}"])

    rows = [(50, edited(first)), (50, edited(second)), (7, edited(first)), (8, edited(second)), (60, edited(second)), (50, "alone here now")]
    for _ in range(3):
        rng.shuffle(rows)
        out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90).collect())
        assert out == sorted([(50, 78, 7), (50, 78, 8), (7, 78, 7), (8, 78, 8), (60, 78, 8), (50, 1, 50)])


def test_digests_tell_spans_apart():
    from cellarbook.llm.words import digest_spans

    rng = np.random.default_rng(4)
    texts = {bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in rng.integers(1, 40, 3000)} | {b"\0", b"\0\0", b"a\0", b"a"}
    data = np.frombuffer(b"".join(sorted(texts)), np.uint8)
    ends = np.cumsum([len(t) for t in sorted(texts)])
    starts = ends - [len(t) for t in sorted(texts)]
    digests = digest_spans(data, starts, ends)
    assert len(set(digests.tolist())) == len(texts)
    again = digest_spans(data[starts[5] :], starts[5:] - starts[5], ends[5:] - starts[5])
    assert (again == digests[5:]).all()
