"""Near duplicates by SimHash: blocks that close fingerprints must share, then the Hamming distance itself.

A fingerprint of 64 bits is cut into ``blocks`` blocks. Two fingerprints that differ in at most ``distance`` bits agree on
at least ``blocks - distance`` of them, so every such pair meets under one of the keys made of that many blocks. Fingerprints
under one key are compared in numpy, and only a spanning forest of their links leaves the task: a group of copies gives
as many rows as it has members, never all its pairs. Keys with more than ``run_rows`` fingerprints are compared in
blocks by separate tasks. Components of the links are found by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from nbquarry.llm.common import col, free_name, stored
from nbquarry.operators.joins import left_join_unique

DISTANCE = 4
BLOCKS = 7
SHINGLE = 4
SEED = 42
# Fingerprints of one key that one task holds at a time.
RUN_ROWS = 1 << 15

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``shingle`` words, lower-cased in A-Z; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(end + 1 for end in ends)]
    return [digest(joined[start:end], SEED) for start, end in zip(starts, ends[shingle - 1:])]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer; zero without words."""
    hashes = np.array(shingle_hashes(text, shingle), dtype=np.uint64)
    if not len(hashes):
        return 0
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
    ones = (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as the long ``name``. NULL and empty texts have fingerprint zero."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    return docs.withColumn(name, of(col(text)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _within(distance: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda a, b: _distance(a, b) <= distance


def _forest(fps: np.ndarray, near: Callable) -> np.ndarray:
    """Pairs of rows of ``fps`` (uint64) that span the graph of all links between them.

    A search from member to member compares each with those not reached so far: a tight group is reached at once, and
    costs little more than its size.
    """
    left, right = [], []
    ids, rest = np.arange(len(fps)), fps
    while len(ids) > 1:
        to_visit = [(ids[0], rest[0])]
        ids, rest = ids[1:], rest[1:]
        while to_visit and len(ids):
            i, at = to_visit.pop()
            reached = near(rest, at)
            if reached.any():
                found = ids[reached]
                left.append(np.full(len(found), i))
                right.append(found)
                to_visit.extend(zip(found, rest[reached]))
                ids, rest = ids[~reached], rest[~reached]
    if not left:
        return np.empty((0, 2), dtype=np.int64)
    return np.stack([np.concatenate(left), np.concatenate(right)], axis=1)


def _pairs_of_runs(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, near: Callable) -> np.ndarray:
    """Links within each run of equal keys, as pairs of nodes. Short runs are compared all at once, by the gap between two positions."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    short = lengths <= 4
    in_short = np.repeat(short, lengths)
    found = [np.empty((0, 2), dtype=np.int64)]
    for gap in range(1, int(lengths[short].max(initial=1))):
        at = np.flatnonzero((keys[gap:] == keys[:-gap]) & in_short[gap:])
        at = at[near(fps[at], fps[at + gap])]
        found.append(nodes[np.stack([at, at + gap], axis=1)])
    for start, length in zip(starts[~short], lengths[~short]):
        found.append(nodes[start + _forest(fps[start:start + length], near)])
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def links(keyed: DataFrame, distance: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """Links ``(a, b)``, a < b, between the nodes of ``(keys, node, bits)`` that share a key and differ in at most ``distance`` bits.

    ``keys`` is an array of longs, ``node`` a long that stands for one fingerprint, ``bits`` the fingerprint as a struct of longs.
    Not every such pair is listed, but every such pair is connected by listed ones.
    """
    near = _within(distance)
    words = keyed.schema["bits"].dataType.names
    bits = ", ".join(f"{w} long" for w in words)
    flat = keyed.select(F.explode("keys").alias("key"), "node", *[F.col("bits")[w].alias(w) for w in words])

    def within_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(ends: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(ends), pa.int64())
            return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1]), none, *[none] * len(words)], ["a", "b", "part", *words])

        def pending(key: int, nodes: np.ndarray, fps: np.ndarray, passed: int) -> pa.RecordBatch:
            parts = (passed + np.arange(len(nodes))) // run_rows
            columns = [np.full(len(nodes), key), nodes, parts, *fps.view(np.int64).T]
            return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], ["a", "b", "part", *words])

        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(words)), np.uint64))
        long_key, passed = None, 0
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            new = (columns[0], columns[1], np.stack(columns[2:], axis=1).view(np.uint64))
            keys, nodes, fps = (np.concatenate(x) for x in zip(held, new))
            if not len(keys):
                continue
            last, first = int(np.searchsorted(keys, keys[-1])), 0
            if long_key is not None:  # a run too long to hold goes on: pass it through with part numbers
                first = int(np.searchsorted(keys, long_key, side="right"))
                if first:
                    yield pending(long_key, nodes[:first], fps[:first], passed)
                    passed += first
                if first == len(keys):
                    held = (keys[:0], nodes[:0], fps[:0])
                    continue
                long_key, passed, last = None, 0, max(last, first)
            if last > first:
                yield table(_pairs_of_runs(keys[first:last], nodes[first:last], fps[first:last], near))
            held = (keys[last:], nodes[last:], fps[last:])
            if len(held[0]) > run_rows:
                long_key = int(held[0][0])
                yield pending(long_key, held[1], held[2], 0)
                passed, held = len(held[0]), (keys[:0], nodes[:0], fps[:0])
        if len(held[0]):
            yield table(_pairs_of_runs(*held, near))

    found = stored(
        flat.repartition("key").sortWithinPartitions("key", "node").mapInArrow(within_runs, f"a long, b long, part long, {bits}")
    )
    # Long runs: one task for each pair of parts of a key.
    waiting = found.where("part is not null").withColumnsRenamed({"a": "key", "b": "node"})
    counts = waiting.groupBy("key").agg((F.max("part") + 1).alias("parts"))
    spread = waiting.join(counts, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    spread = spread.select("key", "node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), *words)

    def within_parts(members: pa.Table) -> pa.Table:
        nodes, first = np.unique(members.column("node").to_numpy(), return_index=True)
        fps = np.stack([members.column(w).to_numpy()[first] for w in words], axis=1).view(np.uint64)
        ends = np.sort(nodes[_forest(fps, near)], axis=1)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    across = spread.groupBy("key", "i", "j").applyInArrow(within_parts, "a long, b long")
    return found.where("part is null").select("a", "b").unionByName(across).distinct()


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """The keys under which a fingerprint meets every other that differs in at most ``distance`` bits.

    ``blocks`` must exceed ``distance``; more blocks give longer keys, hence fewer chance meetings, and more keys.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [
        sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)
    ]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(fp.bitwiseAND(F.lit(m)), F.lit(t)) for t, m in enumerate(signed)])


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the edges ``(a, b)``; the root is the smallest node of its component.

    Large-star and small-star steps in turn, until an edge table no longer changes: each is a grouping and a join, and
    the number of rounds grows with the logarithm of the longest path.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if large:
            least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
            out = both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b")
        else:
            down = both.where("b < a")
            least = down.groupBy("a").agg(F.min("b").alias("least"))
            out = down.join(least, "a").select(F.col("least").alias("x"), F.explode(F.array("a", "b")).alias("b"))
            out = out.select(F.col("x").alias("a"), "b")
        return out.where("a <> b").distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = mark(edges)
    while before[0]:
        edges = stored(star(star(edges, large=True), large=False))
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (long), ``component_id`` (smallest id reachable over links).

    Equal texts have equal fingerprints and are one node from the start. NULL and empty texts have fingerprint zero and
    are linked like any other. A NULL id takes part in links; a component of NULL ids only has a NULL ``component_id``.
    Repeated rows give repeated rows; other columns play no role; an empty table gives an empty result.
    """
    marked = stored(with_fingerprint(docs.select(col(id).alias("doc_id"), col(text).alias("_text")), "_text", shingle=shingle).drop("_text"))
    named = component_ids(marked, distance, blocks)
    return left_join_unique(marked, named, ["fp"], ["doc_id"]).select("doc_id", "fp", "component_id")


def component_ids(marked: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``(fp, root, component_id)`` for the fingerprints of a stored table with ``doc_id`` and ``fp``."""
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    keyed = nodes.select(block_keys(F.col("fp"), distance, blocks).alias("keys"), F.col("fp").alias("node"), F.struct("fp").alias("bits"))
    roots = components(links(keyed, distance)).withColumnRenamed("node", "fp")
    rooted = stored(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return stored(left_join_unique(rooted, ids, ["root"], ["fp"]).select("fp", "root", "component_id"))


def keep_one(
    docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS, shingle: int = SHINGLE,
) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id.

    Groups are the components of :func:`near_duplicates`. Of rows that share the smallest id, the one with the smallest hash
    of its text stays, and of equal rows one. NULL ids come after all others; ids are integers. NULL and empty texts are
    copies of each other. Whole rows are shuffled once, to meet the survivors. An empty table stays empty.
    """
    hashed, number, missing = (free_name(docs, n) for n in ("text_hash", "id_number", "id_missing"))
    keyed = docs.withColumns({
        hashed: F.xxhash64(F.coalesce(col(text), F.lit(""))), number: F.coalesce(col(id).cast("long"), F.lit(0)), missing: col(id).isNull(),
    })
    place = F.struct(col(missing).alias("m"), col(number).alias("n"), col(hashed).alias("h"))
    thin = keyed.select(col(id).cast("long").alias("doc_id"), place.alias("place"), col(text).alias("_text"))
    marked = stored(with_fingerprint(thin, "_text", shingle=shingle).drop("_text"))
    named = component_ids(marked, distance, blocks)
    first = marked.groupBy("fp").agg(F.min("place").alias("place")).join(named, "fp").groupBy("root").agg(F.min("place").alias("place"))
    best = stored(first.select(F.col("place.h").alias(hashed), F.col("place.n").alias(number), F.col("place.m").alias(missing)))
    keys = [hashed, number, missing]
    return keyed.join(best, keys, "left_semi").dropDuplicates(keys).select(*[col(c) for c in docs.columns])
