"""Top k against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nbquarry.llm import topk


def plain(rows, k):
    usable = [
        (n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, q in usable:
        if i % 20 == 0:
            scores = sorted((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))) * -1, j) for m, j, c in usable if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def vectors(kind, n=260, width=6):
    rng = random.Random(kind)
    value = {
        "even": lambda: rng.uniform(-0.5, 0.5), "ties": lambda: rng.choice([0.0, 0.25, -0.25]), "skewed": lambda: rng.expovariate(3) ** 3,
        "large": lambda: rng.uniform(-1e5, 1e5), "huge": lambda: rng.uniform(-1e9, 1e9),
    }[kind]
    rows = [(i, [value() for _ in range(width)]) for i in range(n)]
    rows += [(20, [value() for _ in range(width)]), (40, None), (60, [0.1] * (width - 1) + [None]), (80, [float("nan")] * width), (None, [0.5] * width)]
    return rows + [(101, [0.5] * (width - 2)), (100, [float("inf")] * width), (120, [])]


@pytest.mark.parametrize("kind, blocks", [("even", (50, 7)), ("ties", (1000, 100)), ("skewed", (64, 64)), ("large", (90, 5)), ("huge", (300, 20))])
def test_same_as_brute_force(spark, kind, blocks):
    rows = vectors(kind)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, row string")
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, candidates=blocks[0], queries=blocks[1]).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, 5)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2048)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_reading_stops_early_where_bounds_allow():
    rng = np.random.default_rng(3)
    candidates = np.floor(rng.exponential(1, (4000, 3)) ** 4 * 10)
    queries = np.floor(rng.uniform(1, 9, (5, 3)))
    q, c, s = topk.block_top(queries, candidates, np.full(5, -1), np.arange(4000), 10)
    for i in range(5):
        order = np.lexsort((np.arange(4000), -(candidates @ queries[i])))[:10]
        assert list(c[q == i]) == list(order) and list(s[q == i]) == list((candidates @ queries[i])[order].astype(int))
