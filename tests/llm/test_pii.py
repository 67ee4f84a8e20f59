import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from cellarbook.llm import boosting, pii
from cellarbook.llm.queries import op5_pii

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def strict_by_hand(text):
    """The strict rules written out again, one kind after the other."""
    out = []
    for kind, form in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(form, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(digits[::-1]))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_strict_matches_of_all_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op5_pii(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20
    for r in rows:
        want = strict_by_hand(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_prefilter_loses_nothing():
    texts = ["a at b dot c", "a(at)b.c", "x@y.z", "ab.cd", "no. No", "End.", "[at] b [dot] c", "he is at the end. Then", "1", "", None, "q (dot) r"]
    keep = pii.possible(pa.array(texts))
    for text, k in zip(texts, keep, strict=True):
        assert k or not (pii.candidates(text or "") or pii.base_spans(text or "")), text
    assert not keep[4] and not keep[5] and not keep[9]


def test_other_ways_of_writing_are_added(model):
    found = lambda t: [(k, t[a:b]) for k, a, b, strict in pii.find(t, model) if not strict]
    assert found("call 988-555-2485 now") == [("phone", "988-555-2485")]
    assert found("server 10.2[.]3[.]4 up") == [("ip", "10.2[.]3[.]4")]
    for clean in ("born 1999-12-31, v1.2.3.4567", "he is at the.End of it", "the price 1.234.567", "word " * 5000):
        assert found(clean) == []


def test_redaction_and_odd_rows(spark, model):
    rows = [
        (1, "mail a.b@c.de, +1 (988) 555-2485!", 33, "x"), (1, None, None, "x"), (None, "", 0, None), (2, "é 10.1.2.3 é", 12, ""), (3, "é" * 60_000, 60_000, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = pii.redact(docs, model)
    assert got.columns == docs.columns
    out = sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str)
    want = [(1, "mail [EMAIL], [PHONE]!", 22), (1, None, None), (None, "", 0), (2, "é [IP] é", 8), (3, "é" * 60_000, 60_000)]
    assert out == sorted(want, key=str)
    found = pii.detect(docs, model).collect()
    assert len(found) == 5 and sum(len(r.spans) for r in found) == 3
    assert pii.detect(docs.limit(0), model).collect() == [] and pii.redact(docs.limit(0), model).collect() == []
    nothing = pii.fit(docs.limit(0))
    assert pii.find("call 988-555-2485 or a@b.cd", nothing) == [("email", 21, 27, True)]


def test_trees_and_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    p = boosting.fit(x, y).probability(x)
    assert ((p > 0.5) == y).mean() > 0.97
    assert boosting.threshold(np.array([0.9, 0.8, 0.8, 0.1]), np.array([1, 1, 0, 0]), 0.9) == 0.9
    assert boosting.threshold(np.array([0.9]), np.array([0.0]), 0.9) == 2.0
