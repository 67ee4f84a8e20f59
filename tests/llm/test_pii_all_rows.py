import random
import zlib

import numpy as np

from cellarbook.llm import boosting, pii


def test_trees_and_thresholds_are_those_of_all_documents(spark):
    rng = random.Random(2)
    phones = [f"call +1 {rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)} or see page {i} of 2024-01-{10 + i % 20}" for i in range(40)]
    texts = phones + [f"order {rng.randrange(10**9)} came" for _ in range(60)] + [f"a text of {i} words" for i in range(40_000)] + [None, ""]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    model = pii.fit(docs)
    assert model.thresholds["phone"] <= 1  # one document in a thousand has a phone number

    third = lambda t, n: zlib.crc32(b"%d %d" % (zlib.crc32(t.encode()), n)) % 3 == 2
    rows = [(x, y, third(t, n)) for t in texts if t for n, (x, y) in enumerate(pii.training_rows(t))]
    x, y, apart = (np.array(c, float) for c in zip(*rows, strict=True))
    alone = boosting.fit(x[apart == 0], y[apart == 0])
    assert len(alone.leaves) == len(model.trees.leaves) == boosting.ROUNDS
    for name in ("features", "cuts", "leaves"):
        assert np.array_equal(getattr(alone, name), getattr(model.trees, name))

    steps = np.floor(np.clip(alone.margin(x), -boosting.END, boosting.END) * boosting.STEPS)
    own = (apart == 1) & (x[:, 0] == pii.KINDS.index("phone"))
    want = boosting.threshold(boosting.score_of(steps[own]), y[own], pii.PRECISION)
    assert model.thresholds["phone"] == max(0.5, want)


def test_equal_rows_count_as_often_as_they_come():
    scores, labels = np.array([0.9, 0.8, 0.7]), np.array([1.0, 0.0, 1.0])
    assert boosting.threshold(scores, labels, 0.9, np.array([9, 1, 1])) == 0.7
    assert boosting.threshold(scores, labels, 0.9, np.array([1, 1, 1])) == 0.9
