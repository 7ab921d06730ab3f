"""BPE against the tokenizers library, and the stream against merging whole pieces."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nbquarry.llm import bpe
from nbquarry.llm.queries import token_digests

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "Hello, World's  <|endoftext|>x \u00e91234", "\u0391\u03a3 \u0130 \x1c\x1dab \u0085 e\u0301  !", "<|startoftext|>",
    "a<|endoftext|> <|endoftext|b", "don't DON'T we'll'", "\u4f60\u597d\u4e16\u754c\U0001f680\U0001f680", "\u0301start \u2028 \u3000x", "\x00\x01 \x7f",
    "a" * 20_000, "the" * 5_000, "ab" * 9_999 + "!", "\u00e9\u00df" * 4_000, "!?" * 7_000, "word " * 30_000, "\ufb01 \u1e9b\u0323 \u212b", "1234567890" * 100,
    "\u00b2 x\u00b2_y\u2167 \u00bd\u0663\u0967 a_b__ \u00aa\u02b0 it's \u00e9's _", "ab\u00e9 \u00a0" * 300_000, "ab " * 500_000,
]


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(vocabulary, text):
    data = vocabulary.encode(text)
    return list(struct.unpack(f"<{len(data) // 4}I", data))


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_same_as_library(vocabulary, library, text):
    assert ids(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_random_texts(vocabulary, library):
    rng = random.Random(5)
    letters = "aaabbcdeeefghiiklmnooprsttuwy  ,.'!?\n\t1\u00e9\u00c9\u00f1\u0301\u03a3\u4e16\U0001f680\x1f"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(300)))
        assert ids(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_stream_holds_little_and_changes_nothing(vocabulary):
    rng = random.Random(6)
    held = []
    merge = vocabulary.merge
    vocabulary.merge = lambda symbols: held.append(len(symbols)) or merge(symbols)
    try:
        for letters in ("ab", "the", "inrgst", "aeiou\u00e9", "xyz"):
            data = "".join(rng.choice(letters) for _ in range(9_000)).encode()
            whole = [vocabulary.inner[b] for b in data[:-1]] + [vocabulary.final[data[-1]]]
            expected = merge(whole)
            assert merge(whole[:60]) == vocabulary._merge_long(whole[:60])
            held.clear()
            assert list(vocabulary.piece(data, chunk=50)) == expected
            assert max(held) <= vocabulary.lookahead + 100
    finally:
        del vocabulary.merge


def test_lookahead_of_a_small_list():
    # "ab" after "bc": whether a b c becomes a bc depends on the byte after b.
    assert bpe.sufficient_lookahead([(2, 3), (1, 2)]) == 3
    assert bpe.sufficient_lookahead([(1, 2)]) == 2


def test_plain_text(vocabulary):
    state = bpe.PlainText(vocabulary)
    text = "".join(state.feed(np.array([i])) for i in ids(vocabulary, "caf\u00e9 \U0001f680 world!")) + state.finish()
    assert text == "caf\u00e9 \U0001f680 world !"


def test_query(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "y", 1) for r in rows], "doc_id long, text string, ids string, decoded int")
    sha = lambda data: hashlib.sha256(data).hexdigest()
    expected = []
    for i, t in rows:
        code = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(code, skip_special_tokens=False)
        expected.append((i, len(code), sha(struct.pack(f"<{len(code)}I", *code)), sha(decoded.encode())))
    assert sorted(map(tuple, token_digests(docs, PATH).collect()), key=str) == sorted(expected, key=str)
    assert bpe.encode(docs, PATH).columns == ["doc_id", "text", "ids", "decoded"]
    assert token_digests(docs.limit(0), PATH).count() == 0


def test_decoding_what_is_no_id(spark):
    good = struct.pack("<2I", 5, 6)
    rows = [(good,), (good,), (struct.pack("<3I", 5, 2**32 - 1, 6) + b"\x01",), (b"\x01\x02",), (b"",), (None,)]
    table = spark.createDataFrame(rows, "ids binary")
    for plain in (False, True):
        texts = [r.decoded for r in bpe.decode(table, PATH, plain=plain).collect()]
        assert texts[0] == texts[1] == texts[2] != "" and texts[3:] == ["", "", ""]
    assert bpe.decode(table.limit(0), PATH).count() == 0
