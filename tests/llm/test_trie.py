"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import re

from nbquarry.llm import queries, trie

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(found):
    """Rows of ``FIELDS`` from ``{conv_id: [(role, text), ...]}``."""
    members, ends = {}, {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[b] for b in below)
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node], digest(node))
                  for node, m in members.items())


def sequences_of(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in said.items()}


def conversations(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 17])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "é x  y\t"])))
    rows += [(1000 + c, turn, "user", f"common {turn}") for c in range(60) for turn in range(6)]
    rows += [(2000, None, None, None), (2000, None, "user", "b"), (2000, 3, "user", None), (2000, 3, "user", "z"), (2000, 3, "user", "z")]
    rows += [(None, 0, "user", "of no conversation"), (2001, 0, "us", "er text"), (2002, 0, "user", " text"), (-7, 0, "user", "w " * 5000)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, node int, depth string").repartition(4)


def test_same_as_prefixes(spark):
    for seed in (1, 2):
        rows = conversations(seed)
        found = trie.conversation_trie(frame(spark, rows)).select(*FIELDS).collect()
        assert sorted(map(tuple, found), key=str) == sorted(plain(sequences_of(rows)), key=str)


def test_one_long_conversation_and_its_copies(spark):
    rows = [(c, turn, "user", f"{turn}") for c in range(40) for turn in range(130 if c < 30 else 64)]
    found = trie.conversation_trie(frame(spark, rows)).select(*FIELDS).collect()
    assert sorted(map(tuple, found), key=str) == sorted(plain(sequences_of(rows)), key=str)


def test_without_turns(spark):
    nothing = spark.createDataFrame([], "conv_id long, turns binary")
    assert trie.prefix_trie(nothing).collect() == []
    only = spark.createDataFrame([(4, bytearray()), (2, bytearray())], "conv_id long, turns binary")
    (root,) = trie.prefix_trie(only).collect()
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (2, 0, None, 2, 0, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(b"2,4").hexdigest()


def test_query_rebuilds_conversations(spark):
    import zlib

    rows = [(c, turn, "user", f"{c % 3} {turn}") for c in range(65) for turn in range(c % 5 + (c % 20 == 0)) if c != 40]
    said = sequences_of(rows)
    share = lambda c: zlib.crc32(str(c).encode()) % 4
    expected = {c: said.get(c - c % 20, [])[:share(c)] + turns[share(c):] for c, turns in said.items()}
    found = trie.prefix_trie(queries.rebuilt(trie.sequences(frame(spark, rows)))).select(*FIELDS).collect()
    assert sorted(map(tuple, found), key=str) == sorted(plain(expected), key=str)
    assert any(not turns for turns in expected.values())
