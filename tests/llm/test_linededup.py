"""Repeated lines against a plain count, and the perfect hash on its own."""

import random
from collections import defaultdict

import numpy as np
import pytest

from nbquarry.llm import linededup


def plain(rows, least=3):
    """``(kept text, lines, dropped)`` of each row ``(doc_id, text)``."""
    split = [(i, [(line, line.strip(" \t\n\x0b\x0c\r").translate({65 + k: 97 + k for k in range(26)})) for line in (t or "").split("\n")]) for i, t in rows]
    holders = defaultdict(list)
    for i, lines in split:
        for key in {k for _, k in lines if len(k) >= 20}:
            holders[key].append(i)
    out = []
    for i, lines in split:
        def lost(key):
            known = [h for h in holders.get(key, []) if h is not None]
            return len(holders.get(key, [])) >= least and known and max(known) != i

        kept = [line for line, key in lines if not lost(key)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def rows(seed):
    rng = random.Random(seed)
    pool = [f"Line number {k} of the pool of lines" for k in range(40)] + ["short", "", "  ", "Ünïcödé line of twenty or more", "exactly 20 chars....", "only 19 characters."]
    spell = lambda line: rng.choice([line, line.upper(), f"  {line}\t", f"{line}\r"])
    out = [(i, "\n".join(spell(rng.choice(pool)) for _ in range(rng.randrange(12)))) for i in range(120)]
    out += [(i, "The very common line of every page\nown line of number %d, long enough" % i) for i in range(200, 400)]
    out += [(900, None), (None, "The very common line of every page"), (None, "a line that only rows without id hold")] + [(None, "a line that only rows without id hold")] * 3
    out += [(950, "repeated row, long enough to count")] * 4 + [(951, "x" * 200_000 + "\n" + "The very common line of every page")]
    return out + [(-5, "a\n\n\nb"), (7, "same id, other text and a pool line\nThe very common line of every page")]


@pytest.mark.parametrize("seed, shard_keys, part_rows", [(1, 16, 30), (2, 1 << 13, 1 << 17), (3, 64, 7)])
def test_same_as_plain_count(spark, seed, shard_keys, part_rows):
    given = rows(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in given], "doc_id long, text string, Line string, n_lines int").repartition(5)
    found = linededup.dedup_lines(df, shard_keys=shard_keys, part_rows=part_rows)
    assert found.columns == ["doc_id", "text", "Line", "n_lines", "n_dropped"]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r) for r in found.drop("Line").collect()], key=order) == sorted(plain(given), key=order)


def test_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 2**64, (n, 2), dtype=np.uint64)
    hashed = linededup.PerfectHash.build(keys)
    assert sorted(hashed.slots(keys)) == list(range(n))
    assert len(hashed.bits) * 8 <= 4 * n + 64 * len(hashed.sizes)


def test_strangers_are_told_by_their_fingerprint():
    rng = np.random.default_rng(5)
    keys, others = (rng.integers(0, 2**64, (4000, 2), dtype=np.uint64) for _ in range(2))
    arrays = linededup.shard_arrays(keys, np.full(4000, 300), np.arange(4000), np.ones(4000, bool), 3)
    lost = lambda k: linededup.repeated(arrays, k, np.full(4000, -1), np.zeros(4000, bool), 3)
    assert lost(keys).all() and lost(others).sum() <= 3
    assert arrays["count_bytes"] == 2
