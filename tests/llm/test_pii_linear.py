import random
import re
import time

import pyarrow as pa
import pytest

from cellarbook.llm import pii
from cellarbook.llm.sampling import about

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


@pytest.mark.parametrize("letters", ["a@.b", "a1@.-_ ", "12.3", "+1 2-(3)", "1 -2", "aé@.b@"])
def test_strict_matches_are_those_of_the_plain_forms(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        want = [(k, m.start(), m.end()) for k in pii.KINDS for m in PLAIN[k].finditer(text) if pii._holds(k, m[0])]
        assert pii.base_spans(text) == want, text


def test_taken_stretches_against_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        spans = [(a := rng.randint(0, 50), a + rng.randint(1, 6)) for _ in range(rng.randint(0, 8))]
        taken = pii.Taken(spans)
        for a in range(52):
            for b in range(a + 1, a + 5):
                meets = any(a < y and x < b for x, y in spans)
                assert taken.meets(a, b) == meets
        for a in range(0, 60, 3):
            if not taken.meets(a, a + 2):
                taken.add(a, a + 2)
                spans.append((a, a + 2))
        assert all(taken.meets(a, a + 1) == any(x <= a < y for x, y in spans) for a in range(64))


@pytest.mark.parametrize(
    "text",
    [
        "x" * 1_000_000 + "1",
        "1" * 1_000_000,
        "a1" * 400_000 + " at ",
        "1.2.3" * 100_000,
        "+1" * 300_000,
        "@" * 300_000 + "@a" * 100_000,
        " ".join(f"user{i}@host{i % 90}.example" for i in range(100_000)),
        " ".join(f"call {2000000000 + 7919 * i}" for i in range(20_000)),
    ],
    ids=["letters", "digits", "mixed", "dots", "plus", "at", "addresses", "phones"],
)
def test_long_texts_take_time_in_proportion(text):
    model = pii.fit_rows(*_few())
    began = time.process_time()
    found = pii.find(text, model)
    rows = pii.training_rows(text[:200_000])
    assert time.process_time() - began < 45
    if text.startswith("user0@"):
        assert sum(s for _, _, _, s in found) == 100_000 and rows


def _few():
    import numpy as np

    rows = [r for i in range(40) for r in pii.training_rows(f"write to a{i}@b.cd or call +1 {i % 10}88 555 24{i % 10}5 now")]
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)


def test_batches_are_cut_by_bytes():
    column = pa.array(["a" * 1_500_000, None, "b" * 900_000, "", "c" * 5_000_000, "d"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), column], ["i", "text"])
    parts = list(pii._slices([batch], 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1 << 21 for p in parts)


def test_sample_does_not_depend_on_partitions(spark, tmp_path):
    rows = spark.range(50_000).selectExpr("id AS doc", "id % 7 AS n")
    rows.write.parquet(str(tmp_path / "a"))
    rows.repartition(13).write.parquet(str(tmp_path / "b"))
    one, two = (sorted(map(tuple, about(spark.read.parquet(str(tmp_path / x)), 4000, "doc", "n").collect())) for x in "ab")
    assert one == two and 3600 < len(one) < 4400
    assert about(spark.read.parquet(str(tmp_path / "a")), 50_000, "doc", "n").count() == 50_000
