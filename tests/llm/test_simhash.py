"""SimHash against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nbquarry.llm import simhash


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    runs = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a b c d", "A b C d e f g", "é ü ß x y z \x0b k", "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def chain(rng, n):
    """Fingerprints in walks of up to five flipped bits: many at the limit of the distance."""
    out = []
    for _ in range(n):
        fp = rng.getrandbits(64) if not out or rng.random() < 0.2 else rng.choice(out)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            fp ^= 1 << bit
        out.append(fp)
    return out


@pytest.mark.parametrize("run_rows", [3, 1 << 15])
def test_links_connect_what_all_pairs_connect(spark, run_rows):
    fps = sorted(set(chain(random.Random(1), 400)))
    rows = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    fp = F.col("fp")
    keyed = spark.createDataFrame(rows, "fp long").select(simhash.block_keys(fp, 4, 7).alias("keys"), fp.alias("node"), F.struct("fp").alias("bits"))
    edges = simhash.links(keyed, 4, run_rows=run_rows).collect()
    number = {f[0]: i for i, f in enumerate(rows)}
    label = list(range(len(fps)))
    for e in edges:
        assert (fps[number[e.a]] ^ fps[number[e.b]]).bit_count() <= 4
        old, new = label[number[e.a]], label[number[e.b]]
        label = [new if x == old else x for x in label]
    expected = plain_components(fps)
    assert len({(a, b) for a, b in zip(label, expected)}) == len(set(expected)) == len(set(label))


def test_components_of_a_long_path(spark):
    nodes = random.Random(2).sample(range(10**6), 200)
    edges = list(zip(nodes, nodes[1:])) + [(-5, -7), (-7, -5)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == dict.fromkeys(nodes, min(nodes)) | {-5: -7, -7: -7}


def texts():
    rng = random.Random(3)
    out = [(None, None), (1, None), (2, ""), (3, " "), (4, "short"), (5, "short"), (5, "short"), (None, "short"), (6, "Short")]
    for g in range(6):
        words = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(300)]
        for c in range(6):
            copy = list(words)
            for _ in range(c % 3):
                copy[rng.randrange(300)] = "x"
            out.append((100 * g + 10 + c, " ".join(copy)))
    out.append((999, "word " * 200_000))
    return out


def test_documents(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, fp int, component_id string, root int")
    found = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(fps)
    ids = {x: min((r[0] for r, y in zip(rows, label) if y == x and r[0] is not None), default=None) for x in label}
    expected = [(r[0], f, ids[x]) for r, f, x in zip(rows, fps, label)]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=key) == sorted(expected, key=key)


def plain_survivors(rows):
    """Of each component of ``(doc_id, text)`` the row with the smallest id; ids of the groups' members with it."""
    groups = {}
    for r, x in zip(rows, plain_components([plain_fingerprint(t) for _, t in rows])):
        groups.setdefault(x, []).append(r)
    return [(min((i for i, _ in g if i is not None), default=None), g) for g in groups.values()]


def test_one_of_each_group_stays(spark):
    rows = texts() + [(None, "three"), (9, "two"), (9, "two")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, node int, root string, text_hash int").repartition(3)
    kept = simhash.keep_one(docs).collect()
    assert kept[0].asDict().keys() == set(docs.columns)
    expected = plain_survivors(rows)
    assert sorted((r.doc_id for r in kept), key=str) == sorted((i for i, _ in expected), key=str)
    for i, group in expected:
        assert any(r.doc_id == i and (i, r.text) in group for r in kept)


def test_one_of_a_large_group_of_variants_stays(spark):
    rng = random.Random(8)
    words = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(1500)]
    rows = []
    for i in range(250):
        copy = list(words)
        copy[rng.randrange(1500)] = f"y{i}"
        rows.append((1000 - i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    expected = plain_survivors(rows)
    assert len(expected) < 20
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(i for i, _ in expected)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
