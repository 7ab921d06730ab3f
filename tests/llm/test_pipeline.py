"""The pipeline: each stage on what the one before has kept."""

import struct
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
import public_tokenizers
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, SF))
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def test_columns(steps):
    assert len(pipeline.STAGES) == 4
    assert all(columns == steps[0][0] for columns, _ in steps[1:-1])


def test_quality_keeps_sound_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1][1]}
    for r in steps[0][1]:
        if r.doc_id in labels and len(r.text.split()) >= 50:
            assert (r.doc_id in kept) == bool(labels[r.doc_id])


def test_near_duplicates_against_all_pairs(steps):
    before, after = steps[1][1], sorted(r.doc_id for r in steps[2][1])
    fps = [plain_fingerprint(r.text) for r in before]
    least = {}
    for r, group in zip(before, plain_components(fps)):
        least[group] = min(r.doc_id, least.get(group, r.doc_id))
    assert after == sorted(least.values()) and len(after) < len(before)


def test_mix_meets_its_targets(steps):
    before, after = Counter(), Counter()
    for r in steps[2][1]:
        before[r.source] += len(r.text.split())
    for r in steps[3][1]:
        after[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(before))}
    target, open_ = {}, dict(weights)
    left = sum(before.values())
    while open_:  # share what is left, fix those above their limit, and again
        level = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * level > 3 * before[s]]
        for s in over or list(open_):
            target[s] = 3 * before[s] if over else open_[s] * level
            del open_[s]
        left = sum(before.values()) - sum(target.values())
    for s in before:
        assert abs(after[s] - target[s]) <= 1
    whole = {r.doc_id: r.text for r in steps[2][1]}
    copies = Counter(r.doc_id for r in steps[3][1])
    assert max(copies.values()) <= 3
    assert all(whole[r.doc_id].startswith(r.text) for r in steps[3][1])


def test_tokens(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in steps[3][1])
    found = Counter((r.doc_id, struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in steps[4][1])
    assert found == expected


def test_run(spark, steps):
    found = pipeline.run(spark, SF)
    assert found.columns == steps[4][0] and sorted((r.doc_id, r.n_tokens) for r in found.collect()) == sorted((r.doc_id, r.n_tokens) for r in steps[4][1])
