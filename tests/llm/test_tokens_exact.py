import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from cellarbook.llm.queries import op1_token_codes, vocabulary
from cellarbook.llm.tokens import Encoder, encoded
from cellarbook.llm.words import hash_spans

FILES = [("word_bpe_49k.json", "drop_space"), ("byte_bpe_50k.json", "keep_space")]


def twins(length, a="a", b="b"):
    """Two words that any polynomial hash modulo 2**64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def library(name, texts, end):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    return [x.ids + [end] for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_the_words_do_collide():
    one, two = (np.frombuffer(t.encode(), np.uint8) for t in twins(1024))
    ends = np.array([1024])
    assert hash_spans(one, ends - 1024, ends) == hash_spans(two, ends - 1024, ends) and (one != two).any()


@pytest.mark.parametrize("name,cut", FILES)
@pytest.mark.parametrize("length", [1024, 2048])
def test_colliding_words_keep_their_ids(name, cut, length):
    one, two = twins(length)
    texts = ["plain words here", f"x {one} y", f"x {two} y", f"{two} {one}", None, f"{one} {two} {one}", "plain words", "<|endoftext|> z", one, two]
    column = pa.array(texts)
    want = library(name, texts, 7)
    assert [ids.tolist() for _, ids in encoded(column, vocabulary(name, 7, cut))] == want
    # Over several calls the table keeps the first word's ids, and the second is still told apart.
    assert [[ids.tolist() for _, ids in encoded(column.slice(i, 1), vocabulary(name, 7, cut))][0] for i in range(len(texts))] == want
    backwards = [[ids.tolist() for _, ids in encoded(column.slice(i, 1), vocabulary(name, 8, cut))][0] for i in reversed(range(len(texts)))]
    assert [x[:-1] for x in reversed(backwards)] == [x[:-1] for x in want]


@pytest.mark.parametrize("name,cut", FILES)
def test_hits_are_compared_with_bytes_whatever_the_hash(name, cut, monkeypatch):
    from cellarbook.llm import tokens

    monkeypatch.setattr(tokens, "hash_spans", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(11))
    monkeypatch.setattr(tokens, "TABLE_PIECES", 12)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 40))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 6))) for _ in range(40)]
    own = Encoder(vocabulary(name, 7, cut))
    got = []
    for a in range(0, 40, 5):
        raw = [t.encode() for t in texts[a : a + 5]]
        ids, first = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        got += [ids[x:y].tolist() for x, y in zip(first[:-1], first[1:])]
    assert got == library(name, texts, 7)


def test_query_reads_them_back(spark, tmp_path):
    one, two = twins(1024)
    spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op1_token_codes(spark, str(tmp_path)).collect()}
    assert rows[1] == rows[3] != rows[2]
