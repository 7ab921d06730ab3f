"""Packing: nothing is lost, rows are what best fit decreasing makes, and segments say where pieces are."""

import base64
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from nbquarry.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_best_fit(sizes, length):
    rows, room = [], []
    for i, size in enumerate(sizes):
        fits = [r for r in range(len(rows)) if room[r] >= size]
        if fits:
            r = min(fits, key=lambda r: room[r])
        else:
            r = len(rows)
            rows.append([])
            room.append(length)
        rows[r].append(i)
        room[r] -= size
    return room


@pytest.mark.parametrize("length", [1, 2, 7, 8, 64, 2048])
def test_best_fit(length):
    rng = random.Random(length)
    for n in (0, 1, 5, 400):
        sizes = sorted((rng.randint(1, length) for _ in range(n)), reverse=True)
        rows = packing.best_fit(np.array(sizes, dtype=int), length)
        assert sorted(i for r in rows for i in r) == list(range(n))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(plain_best_fit(sizes, length))


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("length, shard_bytes", [(16, 200), (2048, 1 << 20)])
def test_documents(spark, encoding, tmp_path, length, shard_bytes):
    texts = [None, "", "short", "a b c " * 40, "x" * 3000, "<|endoftext|>", "\u00e9\u4e16 " * 30, "word " * 20_000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1), (2, "short", "x", 1), (2, "short", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, shard int")
    packing.write(packing.pack_documents(docs, PATH, public_tokenizers.PATTERN, length=length, shard_bytes=shard_bytes), str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    found = packed.collect()
    pieces = Counter()
    for r in found:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == length and r.cu_seqlens[0] == 0 and len(r.cu_seqlens) == len(r.doc_ids) + 1 == len(r.parts) + 1
        for d, p, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (positions[a:b] == np.arange(b - a)).all()
            pieces[d, p, tuple(ids[a:b].tolist())] += 1
        assert (ids[r.cu_seqlens[-1]:] == 50256).all() and not positions[r.cu_seqlens[-1]:].any()
    expected = Counter()
    for i, t, *_ in rows:
        ids = encoding.encode_ordinary(t or "") + [50256]
        expected.update((i, p, tuple(ids[s:s + length])) for p, s in enumerate(range(0, len(ids), length)))
    assert pieces == expected
    short = Counter((r.shard, r.row) for r in found if r.shard >= 0)
    assert max(short.values(), default=1) == 1
    back = Counter((r.doc_id, r.part, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in packing.unpack(packed).collect())
    assert back == expected


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH, public_tokenizers.PATTERN).count() == 0
