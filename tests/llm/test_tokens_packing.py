import zlib

import numpy as np
import public_tokenizers
import pytest

from cellarbook.llm import dac, packing, token_codes
from cellarbook.llm.queries import op1_token_codes, op3_packing, packed, vocabulary
from cellarbook.llm.tokens import Vocabulary, encoded

ODD = [
    "a  b\n\n c", "  x", "a  b 　\n c", " lead", "trail  ", "it's they'll\tx'd", "İstanbul ß ﬁ é ́x é.", "a\x1c b",
    "<|endoftext|> x<|startoftext|>", "", None, "12 345,6!!  ..", "\r\n a\r\n\r\nb", "é. ×, ÷,a …. ñ.'s x'.'s",
    "日本語 テキスト。 漢字 a", "Á. a̸ ≮ b", "\xa0 x\x85\n y  ", "a&b|c@d.e", "&'s .'t", "word " * 9000,
]
FOLDER = "/root/testdata/sf0.001"


def whole(name, texts, end):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    return [x.ids + [end] for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def texts_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", "drop_space"), ("byte_bpe_50k.json", "keep_space")])
def test_pieces_give_the_ids_of_whole_texts(spark, name, cut):
    import pyarrow as pa

    texts = ODD + [t for _, t in texts_of(spark)]
    got = [ids.tolist() for _, ids in encoded(pa.array(texts), vocabulary(name, 7, cut))]
    assert got == whole(name, texts, 7)
    uncut = [ids.tolist() for _, ids in encoded(pa.array(ODD), Vocabulary(public_tokenizers.path(name), 7))]
    assert uncut == got[: len(ODD)]


@pytest.mark.parametrize("top", [1, 15, 16, 255, 256, 4096, 49_407, 70_000, 2**31])
def test_dac_round_trip_and_single_reads(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 2, 511, 513, 3001):
        values = (rng.random(n) ** 4 * (top + 1)).astype(np.uint32)
        codes = dac.Codes(dac.encode(values))
        assert (codes.all() == values).all()
        assert [codes.at(i) for i in range(0, n, 7)] == values[::7].tolist()


def test_codes_of_all_documents(spark):
    rows = {r.doc_id: r for r in op1_token_codes(spark, FOLDER).collect()}
    docs = sorted(texts_of(spark))
    start = 0
    for (doc_id, _), ids in zip(docs, whole("word_bpe_49k.json", [t for _, t in docs], 2), strict=True):
        row = rows.pop(doc_id)
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not rows


def test_any_position_is_read_alone(spark, tmp_path):
    own = vocabulary("word_bpe_49k.json", 2, "drop_space")
    docs = spark.createDataFrame([(i % 17, t, 1, 2) for i, t in enumerate(ODD * 3)], "doc_id long, text string, part int, start int")
    token_codes.write_codes(docs, str(tmp_path / "a"), own, shard_tokens=500)
    read = token_codes.read_codes(spark, str(tmp_path / "a")).orderBy("start").collect()
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in read])
    assert [r.start for r in read] == np.cumsum([0] + [len(r.ids) // 4 for r in read])[:-1].tolist()
    assert [r.doc_id for r in read] == sorted(i % 17 for i in range(len(ODD) * 3))
    wanted = [0, 1, 5, 499, 500, len(every) - 1, len(every) + 3]
    got = {r.position: r.id for r in token_codes.tokens_at(spark, str(tmp_path / "a"), wanted).collect()}
    assert got == {p: int(every[p]) for p in wanted if p < len(every)}


def check_packing(rows, ids_of):
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    padding = 0
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert set(pieces) == set(ids_of)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids_of[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(ids_of[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids_of[doc])
    return padding / max(1, sum(map(len, ids_of.values())))


def test_packing_covers_every_id_with_little_padding(spark):
    docs = texts_of(spark)
    ids = dict(zip([d for d, _ in docs], whole("byte_bpe_50k.json", [t for _, t in docs], 1), strict=True))
    assert check_packing(op3_packing(spark, FOLDER).collect(), ids) < 0.02


def test_packing_odd_and_empty_tables(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int")
    ids = dict(enumerate(whole("byte_bpe_50k.json", ODD, 1)))
    check_packing(packed(docs).collect(), ids)
    assert packed(docs.limit(0)).collect() == []


def test_cuts_fill_their_slots():
    for n in range(1, 6000, 7):
        cuts = packing.cut_lengths(n)
        assert sum(cuts) == n and min(cuts) > 0
        for c in cuts:
            assert packing.CAPACITY // (packing.CAPACITY // c) - c <= max(0, c // packing.SLACK)
