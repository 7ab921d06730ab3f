"""Most frequent values by summaries of bounded size, against a full count."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nbquarry.operators import heavy


def skewed(seed, n=4000):
    rng = random.Random(seed)
    return [None if rng.random() < 0.05 else f"m{min(int(rng.paretovariate(0.7)), 10**6)}" for _ in range(n)]


@pytest.mark.parametrize("seed, counters", [(1, 8), (2, 40), (3, 2048)])
def test_same_as_a_full_count(spark, seed, counters):
    values = skewed(seed)
    df = spark.createDataFrame(list(enumerate(values)), "i int, module string").repartition(5)
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    counts = Counter(v for v in values if v is not None)
    expected = sorted(counts.items(), key=lambda x: (-x[1], first[x[0]]))[:10]
    assert [tuple(r) for r in heavy.top_values(df, "module", F.col("i"), 10, counters).collect()] == expected


def test_even_counts_are_all_counted(spark):
    df = spark.createDataFrame([(i, f"m{i % 100}") for i in range(1000)], "i int, module string").repartition(3)
    assert [tuple(r) for r in heavy.top_values(df, "module", F.col("i"), 3, 4).collect()] == [("m0", 10), ("m1", 10), ("m2", 10)]
    assert heavy.top_values(df.limit(0), "module", F.col("i"), 3, 4).count() == 0


def test_bound_holds_for_every_value_left_out():
    for seed in range(20):
        values = skewed(seed, 1500)
        batches = [pa.record_batch([pa.array(values[i:i + 100], pa.string())], ["v"]) for i in range(0, 1500, 100)]
        (found,) = heavy.summaries(iter(batches), 12)
        kept = {r["value"]: r["n"] for r in found.to_pylist() if r["value"] is not None}
        lost = sum(r["lost"] for r in found.to_pylist())
        counts = Counter(v for v in values if v is not None)
        assert len(kept) <= 12 and all(kept.get(v, 0) <= n <= kept.get(v, 0) + lost for v, n in counts.items())
