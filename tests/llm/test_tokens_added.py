"""Ids against a plain tokenizer of the file, also where a text holds an added token."""

import public_tokenizers
import pyarrow as pa
import pytest

from cellarbook.llm.queries import packed, vocabulary
from cellarbook.llm.tokens import Encoder, encoded

TEXTS = [
    "a b, c", "<|endoftext|>", "one <|endoftext|> two, three", "<|startoftext|>x.y<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> x", "", None, "<|endoftext",
    "|> plain, text", "é <|endoftext|>é", "  <|endoftext|>  b", "last, one.",
]


def plain(name, texts, end):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    return [own.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


@pytest.mark.parametrize("name,cut,special", [("word_bpe_49k.json", "drop_space", 49406), ("byte_bpe_50k.json", "keep_space", 50256)])
def test_added_tokens_as_the_library_has_them(name, cut, special):
    for texts in (TEXTS, TEXTS[::-1], TEXTS[:1], TEXTS[1:2]):
        want = plain(name, texts, 7)
        assert [ids.tolist() for _, ids in encoded(pa.array(texts, pa.string()), vocabulary(name, 7, cut))] == want
    assert any(special in ids for ids in plain(name, TEXTS, 7))


def test_texts_without_added_tokens_stay_in_pieces():
    own = Encoder(vocabulary("byte_bpe_50k.json", 7, "keep_space"))
    list_of = [ids.tolist() for ids in (own.encode(*_laid(["a b", "x <|endoftext|> y, z", "c d"]))[0],)]
    assert list_of == [sum(plain("byte_bpe_50k.json", ["a b", "x <|endoftext|> y, z", "c d"], 7), [])]
    assert len(own.slot) == 4


def _laid(texts):
    from cellarbook.llm.words import text_bytes

    return text_bytes(pa.array(texts))


def test_packing_counts_an_added_token_as_one(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.doc_tokens for r in packed(docs).collect()}
    assert got == {i: len(ids) for i, ids in enumerate(plain("byte_bpe_50k.json", TEXTS, 1))}
