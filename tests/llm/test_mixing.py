"""Mixing: targets by hand, exact sums, and awkward rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from nbquarry.llm import mixing

ROWS = [(i, "w " * (i % 7 + 1), "abc"[i % 3] if i % 5 else "a", 1, "x") for i in range(300)]
ODD = [(None, "a b", None, 1, "x"), (900, None, "b", 1, "x"), (901, "", "b", 1, "x"), (902, "q " * 20_000, "", 1, "x"), (903, " \t", "empty", 1, "x")]
SAME = [(950, "same text here", "same", 1, "x")] * 10
SCHEMA = "doc_id long, text string, source string, size int, source_name string"


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    open_, target, left = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, sum(sizes.values())
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * level > 3 * sizes[s]]
        for s in over or list(open_):
            target[s] = 3 * sizes[s] if over else open_[s] * level
            del open_[s]
        left = sum(sizes.values()) - sum(target.values())
    return target


def test_targets_and_sums(spark):
    rows = ROWS + ODD + SAME
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    target, by_id = plain_targets(sizes), {r[0]: r for r in rows}
    taken = Counter()
    for r in found:
        source = by_id[r.doc_id][2]
        assert r.size == len((by_id[r.doc_id][1] or "").split()) and r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source]) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s in sizes:
        # Ten equal documents share what is left, whole words each.
        assert abs(taken[s] - target[s]) <= (10 if s == "same" else 0.5)
    key = lambda rs: sorted(map(str, rs))
    assert key(found) == key(mixing.mix(docs.repartition(7)).collect())


def test_documents_of_the_mix(spark):
    rows = ROWS + ODD
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.source_name == "x"
    assert words == {i: n for i, n in taken.items() if n}


def test_keys_are_spread(spark):
    docs = spark.range(5000).select(F.lit(1).alias("id"), F.col("id").cast("string").alias("text"))
    keys = [r.k for r in docs.select(mixing.random_key(F.col("id"), F.col("text"), "s").alias("k")).collect()]
    assert len(set(keys)) == 5000 and 0.45 < sum(k >> 59 for k in keys) / 5000 < 0.55


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
