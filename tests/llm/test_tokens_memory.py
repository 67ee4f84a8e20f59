import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from cellarbook.llm import packing
from cellarbook.llm.queries import vocabulary
from cellarbook.llm.tokens import Encoder, encoded
from llm.test_tokens_packing import whole


def texts(rows, words, seed=3):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    known = ["".join(rng.choice(letters, n)) for n in rng.integers(2, 10, 4000)]
    return [" ".join(rng.choice(known, words)) for _ in range(rows)]


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", "drop_space"), ("byte_bpe_50k.json", "keep_space")])
def test_a_worker_needs_little_memory_beside_its_texts(name, cut):
    """Texts of 4 MB: 54 and 55 MB at most when 2 MB were cut at once, besides the table of powers."""
    column, own = pa.array(texts(2000, 330)), vocabulary(name, 9, cut)
    assert column.nbytes > 4e6
    list(encoded(column.slice(0, 600), own))
    tracemalloc.start()
    try:
        got = [(len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for _, ids in encoded(column, own)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in whole(name, column.to_pylist(), 9)]
    assert peak < 45e6


def test_the_table_of_pieces_is_small():
    """Hashes and slots in arrays; with a dictionary it took 179 bytes for each of these pieces."""
    own = Encoder(vocabulary("byte_bpe_50k.json", 9, "keep_space"))
    words = sorted({f"{i * 7919 % 200_003:x}q{i % 97:x}" for i in range(120_000)})
    parts = [" ".join(words[i::8]).encode() for i in range(8)]
    for part in parts[:1]:
        own.encode(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
    tracemalloc.start()
    try:
        for part in parts[1:]:
            own.encode(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(own.slot) > 100_000 and held < 100 * len(own.slot)
    ids, _ = own.encode(np.frombuffer(parts[3], np.uint8), np.array([0, len(parts[3])]))
    assert ids.tolist() == whole("byte_bpe_50k.json", [parts[3].decode()], 9)[0]


def test_pieces_are_handed_on_in_batches_of_bounded_bytes(spark, monkeypatch):
    """Long texts have pieces of whole sequences, 8 KB each; batches had 4096 and more."""
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 5)))
    run = packing.pack(docs, vocabulary("byte_bpe_50k.json", 1, "keep_space"))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts(2, 600_000))], ["doc_id", "text"])
    out = list(run([batch]))
    assert sum(b.num_rows for b in out) > 1024 and sum(b.nbytes for b in out) > 10e6
    assert max(b.nbytes for b in out) < 9e6
