"""Context-tree weighting against a tree of dictionaries, and what makes it a model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from nbquarry.llm import ctw


def decisions(text, depth):
    """``(context bytes, bits before, bit)`` for each bit of a text and its end."""
    data = b"\n" * depth + b" ".join(ctw.tokens(text)) + b"\n"
    for i in range(depth, len(data)):
        for k in range(8):
            yield data[i - depth:i], (1 << k) | data[i] >> (8 - k), data[i] >> (7 - k) & 1


def plain_scores(rows, depth):
    counts = Counter()
    for i, text in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            for context, node, bit in decisions(text, depth):
                for d in range(depth + 1):
                    counts[context[depth - d:], node, bit] += 1
    children = {}
    for context, node, _ in counts:
        if context:
            children.setdefault((context[1:], node), set()).add(context)

    def kt(context, node):
        a, b = counts[context, node, 0], counts[context, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(context, node)
            if len(context) < depth:
                own = np.logaddexp(own, sum(weighted(c, node) for c in children.get((context, node), ()))) - math.log(2)
            memo[context, node] = own
        return memo[context, node]

    def predict(context, node, bit, d):
        here = context[depth - d:]
        a, b = counts[here, node, 0], counts[here, node, 1]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        deeper = context[depth - d - 1:] if d < depth else None
        if deeper is None or not counts[deeper, node, 0] + counts[deeper, node, 1]:
            return own
        w = math.exp(kt(here, node) - math.log(2) - weighted(here, node))
        return w * own + (1 - w) * predict(context, node, bit, d + 1)

    return [sum(math.log10(predict(c, n, b, 0)) for c, n, b in decisions(t, depth)) for _, t in rows]


def plain_base(rows):
    counts, total = Counter(), 0
    for i, text in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            counts.update(ctw.tokens(text) + [b""])
    total = sum(counts.values())
    out = []
    for _, text in rows:
        t = ctw.tokens(text) + [b""]
        out.append((len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in t)))
    return out


TEXTS = [None, "", " \t", "The cat sat on the mat.", "the cat SAT on the mat", "a dog; a cat\nand the mat \u00e9\u00df\u4e16", "zzz qqq", "the the the " * 40]
ROWS = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(None, "the dog"), (3, "x"), (3, "x")]


@pytest.mark.parametrize("depth, block_bytes", [(2, 1 << 20), (3, 60), (5, 200)])
def test_scores(spark, depth, block_bytes):
    docs = spark.createDataFrame([(*r, 1, "y") for r in ROWS], "doc_id long, text string, n long, run string")
    found = ctw.score_documents(docs, depth=depth, block_bytes=block_bytes).collect()
    expected = [(i, *b, s) for (i, _), b, s in zip(ROWS, plain_base(ROWS), plain_scores(ROWS, depth))]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in found), key=key)
    for g, e in zip(got, sorted(((*e[:4], round(e[4], 9), round(e[5], 9)) for e in expected), key=key), strict=True):
        assert g[:4] == e[:4] and g[4:] == pytest.approx(e[4:], abs=1e-6)
    for r in found:
        size = len(b" ".join(ctw.tokens(dict(ROWS).get(r.doc_id)))) + 1
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10 == 0)
        assert r.doc_id == 3 or r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / size)


def test_probabilities_of_all_next_bytes_sum_to_one():
    rng = np.random.default_rng(1)
    runs = rng.integers(0, 3, (500, 4)) + 97
    codes = (runs[:, 0] << 24) + (runs[:, 1] << 16) + (97 << 8) + runs[:, 3]
    codes, counts = np.unique(codes.astype(np.uint64), return_counts=True)
    import pyarrow as pa
    every = np.unique(np.concatenate([codes, (codes[0] >> np.uint64(8) << np.uint64(8)) + np.arange(256, dtype=np.uint64)]))
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, codes)] = counts
    table = pa.table({"run": every.view(np.int64), "n": n})
    sums = ctw._upper_sums(table, 3).to_pandas()
    upper = ctw._upper(list(sums.itertuples()))
    found = ctw._predict(table, 3, upper).to_pandas()
    same = found[(found["run"].to_numpy() >> 8) == int(codes[0] >> np.uint64(8))]
    assert len(same) == 256 and (10 ** same["value"]).sum() == pytest.approx(1)


def test_no_training_and_no_rows(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = spark.createDataFrame([(i, "ab") for i in held], "doc_id long, text string")
    for r in ctw.score_documents(docs).collect():
        assert r.score == pytest.approx(3 * 8 * math.log10(0.5)) and r.train_tokens == 0 and r.n_known == 0 and r.held_out
    assert ctw.score_documents(docs.limit(0)).count() == 0


def test_held_out_texts_are_predicted_better_than_by_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [r for r in ctw.score_documents(docs).collect() if r.held_out]
    assert len(found) > 50
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert sum(r.score > r.base_score for r in found) > 0.5 * len(found)
