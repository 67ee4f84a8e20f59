import zlib

import numpy as np
import pyarrow as pa

from cellarbook.llm import quality
from cellarbook.llm.queries import op10_quality
from cellarbook.llm.words import chunks, find_words

FOLDER = "/root/testdata/sf0.01"


def counts_of(texts):
    return np.concatenate([quality.term_counts(d, o) for _, _, d, o in chunks(pa.array(texts, pa.string()), 50)])


def test_held_out_documents_are_told_apart(spark):
    rows = {r.doc_id: r for r in op10_quality(spark, FOLDER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert sum(p == q for p, q in held) >= 0.96 * len(held)
    kept = [rows[i].score for i, q in labels.items() if q == 1 and rows[i].held_out]
    dropped = [rows[i].score for i, q in labels.items() if q == 0 and rows[i].held_out]
    assert np.mean(kept) > 0.9 and np.mean(dropped) < 0.2


def test_votes_against_plain_loops():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["ab", "Cd,", "ef!!", "gh", "|"], 1 + i % 40)) for i in range(150)]
    counts, labels = counts_of(texts), (np.arange(150) % 3 > 0).astype(float)
    model = quality.fit_arrays(counts, labels)
    vectors, got = model.project(counts), model.score(counts)
    for v, s in zip(vectors, got, strict=True):
        cosines = sorted(((float(v @ w), y) for w, y in zip(model.vectors, labels)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(c, 0) ** 8 for c, _ in cosines]
        assert abs(s - sum(w * y for w, (_, y) in zip(weights, cosines)) / sum(weights)) < 0.15


def test_words_and_shapes():
    texts = ["Thnd*** the", "", None, "A\tb\x0bc  Öl", "x" * 100_000]
    column = pa.array(texts, pa.string())
    for _, _, data, offsets in chunks(column):
        words = find_words(data, offsets)
        raw = data.tobytes()
        got = [[raw[a:b].decode() for a, b in zip(words.starts[i:j], words.ends[i:j])] for i, j in zip(words.first, words.first[1:])]
        assert got == [["Thnd***", "the"], [], [], ["A", "b", "c", "Öl"], ["x" * 100_000]]
        shapes = quality.shape_hashes(data, words.starts, words.ends)
        assert shapes[1] == shapes[3] == shapes[4] == shapes[6] and shapes[0] != shapes[1] != shapes[2]


def test_sliced_columns_and_repeats():
    counts = counts_of(["b b b", "a"])
    assert counts[0, quality.WORD_TERMS] >= 2
    sliced = pa.array(["zz", None, "a b", ""]).slice(1)
    assert [rows for _, rows, _, _ in chunks(sliced)] == [3]
    assert (counts_of(["x", "a b"])[1] == np.concatenate([quality.term_counts(d, o) for _, _, d, o in chunks(sliced)])[1]).all()


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, 0.1), (1, None, 0.1), (None, "", 0.2), (3, "w " * 50_000, 0.3), (4, "a b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1), (9, 5)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    assert sorted(model.labels) == [0, 1]
    got = quality.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score for r in got}[1] == 0.5  # nothing is similar to an empty text
    kept = quality.keep(docs, model, 0.9)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]
    assert quality.score(docs.limit(0), model).collect() == []
    empty = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
