import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from kmerlake.llm.bpe import Codec, encode_decode, merge_long, merge_short
from kmerlake.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def codec():
    return Codec(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def texts():
    rng = random.Random(1)
    pool = [chr(i) for i in range(1, 0x30)] + list("abc 12'.,!") + ["<|endoftext|>", " don't we'll", "\x85", "\xa0", "é", "中", "😀"]
    pool += [chr(rng.choice([rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(500)]
    return ["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(1500)] + ["", "a" * 3000, " " * 2000, "é" * 999]


def test_equals_library(codec, library):
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert got == np.array(want, "<u4").tobytes()
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_short_and_long_merges_agree(codec):
    v, rng = codec.vocabulary, random.Random(2)
    for _ in range(500):
        word = bytes(rng.choices(b"abeinrst \xc3\xa9", k=rng.randrange(1, 60)))
        assert merge_short(word, v.single, v.joins.get) == merge_long(word, v.single, v.joins.get)


def test_rows(odd_docs, codec):
    rows = encode_decode(odd_docs, tokenizer_path(), keep=["doc_id", "text", "ids"]).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["decoded"] == (r["text"] or "") and bytes(r["ids"]) == codec.encode(r["text"])


def test_all_columns_and_empty_table(odd_docs):
    full = encode_decode(odd_docs, tokenizer_path())
    assert "Score" in full.columns and full.columns.count("ids") == 1
    assert encode_decode(odd_docs.limit(0), tokenizer_path()).count() == 0


def test_compared_where_the_text_lies(spark):
    """No text and no decoded text travels back; the verdict equals the comparison of the returned texts."""
    rows = [(1, "one two  three"), (1, ""), (None, None), (2, "äöü \U0001f600 123")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = encode_decode(docs, tokenizer_path(), keep=["doc_id"], compare=True)
    assert got.columns == ["doc_id", "ids", "round_trip"]
    plain = encode_decode(docs, tokenizer_path(), keep=["doc_id", "text"]).collect()
    key = lambda r: (str(r[0]), bytes(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(
        [(r.doc_id, r.ids, r.decoded == (r.text or "")) for r in plain], key=key)


def test_remembered_words_are_bounded(codec, monkeypatch):
    """Two generations of 100,000 at most in a worker, and what is met again is not computed again."""
    from kmerlake.llm import bpe
    assert 2 * bpe.MEMORY <= 200_000
    monkeypatch.setattr(bpe, "MEMORY", 10)
    words = bpe.Words(codec.vocabulary)
    for i in range(100):
        assert words[f"w{i}"] == codec.words[f"w{i}"] and words["again"] == codec.words["again"]
        assert len(words) <= 10 and len(words.older) <= 10
    assert "again" in words or "again" in words.older
