"""A family of near copies that share none of their rarest shingles: its pairs must not all be made."""

import random

from cellarbook.llm import ngram_join
from tests.llm.test_ngram_join import by_hand, got

MEMBERS = 240


def test_pairs_of_a_family_grow_with_its_size(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for n in range(MEMBERS):
        own = list(base)
        for at in rng.sample(range(len(own)), 2):
            own[at] = f"own{n}at{at}"
        docs.append((n, " ".join(own)))
    made, links = [], ngram_join._links

    def counted(docs, reps, pairs, *rest):
        made.append(pairs.count())
        return links(docs, reps, pairs, *rest)

    monkeypatch.setattr(ngram_join, "_links", counted)
    found = got(ngram_join.group(spark.createDataFrame(docs, "doc_id long, text string")))
    assert found == by_hand(docs, 5, 80)
    assert {c for _, c in found.values()} == {0}
    assert sum(made) < MEMBERS * MEMBERS / 8, made


def test_shingles_that_let_no_pair_be_similar_are_left_out(spark):
    rng = random.Random(8)
    sets = []
    for rep in range(400):
        n = rng.choice([rng.randrange(5, 60), rng.randrange(5, 2000)])
        sets.append((rep, n, rng.sample(range(20000), n - -(-80 * n // 100) + 1)))
    reps = spark.createDataFrame(sets, "rep long, n long, prefix array<long>")
    known = spark.createDataFrame([(7, 3), (9, 3)], "node long, component long")
    comp = {7: 3, 9: 3}
    rows = [(token, rep, n, at) for rep, n, prefix in sets for at, token in enumerate(prefix)]
    of: dict[int, list] = {}
    for token, rep, n, at in rows:
        of.setdefault(token, []).append((rep, n, at))
    may = lambda x, y: comp.get(x[0], x[0]) != comp.get(y[0], y[0]) and 180 * min(x[1] - x[2], y[1] - y[2]) >= 80 * (x[1] + y[1])
    needed = {(t, x[0]) for t, own in of.items() for x in own if any(may(x, y) for y in own)}
    kept = {(r.token, r.rep) for r in ngram_join._common(reps, known, 80).collect()}
    assert needed and needed <= kept
    twos = {(t, x[0]) for t, own in of.items() if len(own) == 2 for x in own}
    assert twos - needed and not (twos - needed) & kept
