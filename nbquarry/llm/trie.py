"""Prefix tries of conversations, built and summed by van Emde Boas recursion.

A conversation is a sequence of turns, each named by a digest of its role and text. A problem is a set of forests: pieces
of sequences, each hanging from the node ``forest``, no longer than a window. It is cut at half of its window. The first
halves, named by forest and content, are distinct nodes of the trie; as pieces of half the length they make the upper
problem. What comes after a cut hangs from the cut prefix and makes a lower problem. Upper and lower problems have the same
window and are solved together, so a trie of depth d takes log2(d) rounds, whatever its shape, and each round is one
grouping. In the end windows have length one, and pieces are the edges of the trie.

Totals of subtrees go back the same way. Sums within windows are merged from the shortest window to the longest: a
forest's sum gets those of the prefixes that were cut from it. Then, from the first cut to the last, what lies
below the end of a prefix's window is grafted on. Every link of these steps leads from one node to one other, so no
join has a hot key, and sums are combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from nbquarry.llm.common import col, stored
from nbquarry.operators.joins import left_join_unique

# A turn in a sequence: the digest of role and text, and the number of its words.
DIGEST_BYTES, WORD_BYTES = 16, 8
TURN = DIGEST_BYTES + WORD_BYTES
WORD = r"[^\x20\x09-\x0D]+"
# Characters of ids that are hashed at a time.
CHUNK = 1 << 20

_ROOT = hashlib.md5(b"root").digest()


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


def sequences(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns in order, ``TURN`` bytes each.

    Turns are ordered by ``turn``, NULL first, and where it is equal by role, then text. NULL roles and texts are empty. Rows
    with a NULL id are of no conversation. Repeated rows are turns of their own. Ids are integers.
    """
    said = conversations.where(col(id).isNotNull()).select(
        col(id).cast("long").alias("conv_id"), col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    # The role's length keeps role and text apart.
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(" "), "role", "text"))
    words = F.lpad(F.hex(F.regexp_count("text", F.lit(WORD)).cast("long")), 2 * WORD_BYTES, "0")
    named = said.select("conv_id", place.alias("place"), F.concat(name, words).alias("name"))
    inside = F.array_sort(F.collect_list(F.struct("place", "name")))
    return named.groupBy("conv_id").agg(F.unhex(F.array_join(inside.getField("name"), "")).alias("turns"))


def part_of(turns: Column, first: Column | int, count: Column | int | None = None) -> Column:
    """Turns from number ``first`` (from 0) on, ``count`` of them or all."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    start = (lit(first) * TURN + 1).cast("int")
    return F.substr(turns, start, (F.octet_length(turns) if count is None else lit(count) * TURN).cast("int"))


def _cut(pieces: DataFrame, half: int) -> tuple[DataFrame, DataFrame]:
    """The pieces of the upper and lower problems, told apart by ``upper``, and the nodes where whole sequences end at a cut."""
    size = F.octet_length("turns")
    reaches = size >= half * TURN
    marked = pieces.withColumn("name", F.when(reaches, _digest(F.concat("forest", part_of(F.col("turns"), 0, half)))))
    upper = marked.select(
        "forest", "depth", part_of(F.col("turns"), 0, half).alias("turns"), F.col("name").alias("end"), F.when(~reaches, F.col("sequence")).alias("sequence"),
        "n_convs", "conv_id",
    ).groupBy("forest", "depth", "turns", "end", "sequence").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    lower = marked.where(size > half * TURN).select(
        F.col("name").alias("forest"), (F.col("depth") + half).alias("depth"), part_of(F.col("turns"), half).alias("turns"), "end", "sequence", "n_convs", "conv_id",
    )
    ended = marked.where((size == half * TURN) & F.col("sequence").isNotNull()).select("sequence", "name")
    return upper.withColumn("upper", F.lit(True)).unionByName(lower.withColumn("upper", F.lit(False))), ended


def _sums(df: DataFrame, key: Column | str) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("leaves", "saved")])


def _end_digests(members: DataFrame) -> DataFrame:
    """``(sequence, ends_sha256)``: SHA-256 of the ids of each sequence, in ascending order and joined by commas.

    Ids are sorted by range, so that many copies of one conversation are spread out; each task joins what it has into
    pieces of text, and only these are hashed one after the other.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece() -> pa.RecordBatch:
            return pa.record_batch([pa.array([at], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["sequence", "first", "ids"])

        at, ids, size = None, [], 0
        for batch in batches:
            for sequence, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (sequence != at or size >= CHUNK):
                    yield piece()
                    ids, size = [], 0
                at = sequence
                ids.append(conv_id)
                size += len(str(conv_id)) + 1
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([at], pa.binary()), pa.array([hashed.hexdigest()])], ["sequence", "ends_sha256"])

        at, hashed = None, None
        for batch in batches:
            for sequence, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if sequence != at:
                    if hashed is not None:
                        yield done()
                    at, hashed = sequence, hashlib.sha256()
                else:
                    hashed.update(b",")
                hashed.update(ids.as_py().encode())
        if hashed is not None:
            yield done()

    order = ["sequence", "conv_id"]
    pieces = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "sequence binary, first long, ids string")
    return pieces.repartition("sequence").sortWithinPartitions("sequence", "first").mapInArrow(digest, "sequence binary, ends_sha256 string")


def prefix_trie(found: DataFrame) -> DataFrame:
    """The trie of ``(conv_id, turns)``, of which each conversation has one row: a row for each node, the root included.

    ``node`` and ``parent`` name a node and the one above it (the root's is NULL), ``turn`` is the digest of its last turn (NULL in the
    root). ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's, ``n_convs`` counts members: conversations that begin
    with the node's turns. ``n_children`` counts children, ``n_leaves`` the childless nodes of its subtree. ``saved_tokens`` adds up,
    over its subtree, the words of each node's last turn times the members beyond the first. ``ends_sha256`` is the SHA-256 of
    the ids that end in the node. Conversations without turns end in the root. Without conversations there are no nodes.
    """
    found = stored(found.select("conv_id", "turns", _digest(F.col("turns")).alias("sequence")))
    total = found.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    longest = (found.agg(F.max(F.octet_length("turns"))).first()[0] or 0) // TURN
    root = F.lit(_ROOT)
    pieces = found.where(F.octet_length("turns") > 0).groupBy("sequence", "turns").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    pieces = pieces.select(root.alias("forest"), F.lit(0).alias("depth"), "turns", F.lit(None).cast("binary").alias("end"), "sequence", "n_convs", "conv_id")

    rounds, ends = [], found.where(F.octet_length("turns") == 0).select("sequence", root.alias("name")).distinct()
    for power in reversed(range(longest.bit_length())):
        cut, ended = _cut(pieces, 1 << power)
        ends = ends.unionByName(ended)
        pieces = stored(cut)
        rounds.append(pieces)

    edges = pieces.select(
        F.col("end").alias("node"), F.col("forest").alias("parent"), (F.col("depth") + 1).alias("depth"), "n_convs", "conv_id",
        F.substr("turns", F.lit(1), F.lit(DIGEST_BYTES)).alias("turn"),
        F.conv(F.hex(F.substr("turns", F.lit(DIGEST_BYTES + 1), F.lit(WORD_BYTES))), 16, 10).cast("long").alias("words"),
    )
    top = total.where("n_convs > 0").select(
        root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), "n_convs", "conv_id",
        F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"),
    )
    children = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    own = edges.unionByName(top).join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stored(own.withColumns({"leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}).drop("words"))

    # Sums below each forest, within windows that double from round to round.
    sums = stored(_sums(nodes.where("parent is not null"), F.col("parent").alias("node")))
    within = []
    for pieces in reversed(rounds):
        cuts = pieces.where("upper and end is not null").select(F.col("forest").alias("above"), F.col("end").alias("node"))
        joined = stored(sums.join(cuts, "node", "left"))
        within.append(joined.where("above is not null").drop("above"))
        sums = stored(_sums(joined, F.coalesce("above", "node").alias("node")))
    # What lies below the window's end, grafted on from the first cut to the last.
    below = sums
    for pieces, inside in zip(rounds, reversed(within)):
        spans = pieces.where("not upper and end is not null").select(F.col("forest").alias("above"), F.col("end").alias("node"))
        grafted = spans.join(below, "node").select(F.col("above").alias("node"), "leaves", "saved")
        below = stored(below.unionByName(_sums(inside.unionByName(grafted), "node")))

    total_of = below.withColumnsRenamed({"leaves": "leaves_below", "saved": "saved_below"})
    digests = ends.join(_end_digests(found), "sequence").select(F.col("name").alias("node"), "ends_sha256")
    summed = stored(nodes.join(total_of, "node", "left").join(digests, "node", "left"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    plus = lambda own, below: F.col(own) + F.coalesce(below, F.lit(0))
    return left_join_unique(summed, parents, ["parent"], ["node"]).select(
        "node", "parent", "turn", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        plus("leaves", "leaves_below").alias("n_leaves"), plus("saved", "saved_below").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`prefix_trie` of a table with a row for each turn; other columns play no role. See :func:`sequences` for NULLs and ties."""
    return prefix_trie(sequences(conversations, id, turn, role, text))
