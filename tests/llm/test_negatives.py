"""Hard negatives against all pairs, and the search through cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nbquarry.llm import negatives


def plain(rows, positives=5, wanted=10):
    usable = [
        (n, i, label, [math.floor(256 * x) for x in v]) for n, (i, label, v) in enumerate(rows)
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, label, q in usable:
        if i % 10:
            continue
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j, other, m) for m, j, other, v in usable if m != n)
        for p, positive, _, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and -30 * p <= -100 * s[0] <= -90 * p][:wanted]
            out += [(i, positive, r + 1, s[1], -p, -s[0]) for r, s in enumerate(fits)]
    return sorted(out)


def vectors(kind, n=240, width=6):
    rng = random.Random(kind)
    value = {
        "even": lambda: rng.uniform(-0.2, 0.5), "ties": lambda: rng.choice([0.0, 0.25, 0.5]), "skewed": lambda: rng.expovariate(3) ** 3,
        "huge": lambda: rng.uniform(0, 1e9), "alike": lambda: 0.25,
    }[kind]
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [value() for _ in range(width)]) for i in range(n)]
    rows += [(20, 1, [value() for _ in range(width)]), (40, 1, None), (60, 1, [0.1] * (width - 1) + [None]), (80, 0, [float("nan")] * width)]
    return rows + [(None, 1, [0.5] * width), (90, None, [0.5] * width), (101, 2, [0.5] * (width - 2)), (100, 1, [float("inf")] * width), (120, 1, []), (130, 9, [0.5] * width)]


@pytest.mark.parametrize("kind, blocks, step", [("even", (50, 7), 8), ("ties", (1000, 100), 3), ("skewed", (64, 64), 256), ("huge", (300, 20), 16), ("alike", (90, 9), 16)])
def test_same_as_all_pairs(spark, kind, blocks, step):
    rows = vectors(kind)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, score int, row string")
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), candidates=blocks[0], anchors=blocks[1], codes=5, step=step)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])], "vec_id long, label int, embedding array<float>")
    mine = lambda d: [tuple(r) for r in negatives.hard_negatives(d, F.col("vec_id") == 0, F.col("label")).collect()]
    assert mine(df) == [(0, 1, 1, 2, 65536, 32768)]
    assert mine(df.limit(0)) == mine(df.where("vec_id = 0")) == mine(df.where("vec_id <> 1")) == []


def test_cells_are_visited_by_falling_bounds_that_hold():
    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.normal(0, 0.2, (3000, 8)))
    books = negatives.codebook(rows[:500, :4], 12), negatives.codebook(rows[:500, 4:], 12)
    cells, anchor = negatives.Cells(rows, books), rows[17]
    seen, before = [], math.inf
    for at, bound in cells.visit(anchor, 50):
        assert max(cells.scores(anchor, at)) <= before and bound <= before
        seen, before = seen + at.tolist(), bound
    assert sorted(seen) == list(range(3000)) and before == -math.inf


def test_search_stops_once_windows_are_certified():
    rng = np.random.default_rng(4)
    centres = 40 * rng.normal(0, 1, (10, 8))
    rows = np.floor(centres[rng.integers(0, 10, 5000)] + rng.normal(0, 1, (5000, 8)))
    cells = negatives.Cells(rows, (negatives.codebook(rows[:, :4], 10), negatives.codebook(rows[:, 4:], 10)))
    scored = []
    plain_scores, cells.scores = cells.scores, lambda anchor, at: scored.append(len(at)) or plain_scores(anchor, at)
    (best,) = negatives.best_in_windows(cells, rows[0], np.arange(5000), np.ones(5000, bool), [(-math.inf, math.inf)], 10, 16)
    exact = np.lexsort((np.arange(5000), -(rows @ rows[0])))[:10]
    assert [r for _, r in best] == exact.tolist() and sum(scored) < 2500
