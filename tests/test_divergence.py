"""Alignment of outputs against plain dynamic programming, and where two notebooks part."""

import json
import random

from pyspark.sql import functions as F

from nbquarry.operators import divergence as DV, outputs as O
from nbquarry.sources.archive import with_document


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        letters = "ab" if rng.random() < 0.3 else "abcdefgh"
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = DV.common_pairs(a, b)
        assert len(pairs) == plain_length(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        found = DV.align(a, b)
        assert sum(g["orig_to"] - g["orig_from"] for g in found["gaps"]) == len(a) - len(pairs)
        assert sum(g["exec_to"] - g["exec_from"] for g in found["gaps"]) == len(b) - len(pairs)
        assert bool(found["gaps"]) == (a != b) and a[:found["first"]] == b[:found["first"]]


def test_long_lists():
    rng = random.Random(2)
    a = [rng.randrange(10**6) for _ in range(6000)]
    b = [x for x in a if rng.random() > 0.02]
    for _ in range(60):
        b.insert(rng.randrange(len(b)), -1)
    assert len(DV.common_pairs(a, b)) == len(b) - 60


def notebook(outputs):
    said = lambda t: {"output_type": "stream", "name": "stdout", "text": t}
    return json.dumps({"cells": [{"cell_type": kind, "source": "", "outputs": [said(t) for t in texts]} for kind, texts in outputs]})


def test_first_output_that_differs(spark):
    base = [("code", ["a", "b"]), ("markdown", ["x"]), ("code", []), ("code", ["c", "d"])]
    variants = {
        "same": base, "changed": [*base[:3], ("code", ["c", "e"])], "missing": [("code", ["a"]), *base[1:]], "added": [*base, ("code", ["z"])],
        "none": [], "markdown": [base[0], ("markdown", ["other"]), *base[2:]],
    }
    rows = [(name, notebook(v)) for name, v in variants.items()] + [("broken", "{")]
    texts = spark.createDataFrame(rows, "name string, _text string")
    original = DV.hash_tree(with_document(spark.createDataFrame([(notebook(base),)], "_text string")), []).toDF("orig_root", "orig_leaves")
    for limit in (1 << 20, -1):
        executed = DV.hash_tree(with_document(texts, limit), ["name"]).toDF("name", "exec_root", "exec_leaves")
        found = {r.name: tuple(r)[1:-1] for r in DV.divergence(executed.crossJoin(F.broadcast(original)), ["name"]).collect()}
        assert found == {
            "changed": (3, 1, 3, 1, 4, 4, 3), "missing": (0, 1, 3, 0, 4, 3, 3), "added": (None, None, 4, 0, 4, 5, 4), "none": (0, 0, None, None, 4, 0, 0),
        }


def test_roots_agree_with_fingerprints(spark):
    rows = [(i, notebook([("code", list(t))])) for i, t in enumerate(["ab", "ab", "ba", "", "a"])]
    notebooks = with_document(spark.createDataFrame(rows, "nb_id long, _text string"))
    roots = {r.nb_id: r.root for r in DV.hash_tree(notebooks, ["nb_id"]).collect()}
    prints = {r.nb_id: r.outputs_hash for r in O.outputs_hash(notebooks).collect()}
    assert all((roots[i] == roots[j]) == (prints[i] == prints[j]) for i in roots for j in roots)
