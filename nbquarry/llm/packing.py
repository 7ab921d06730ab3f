"""Token ids packed into rows of one length, for training.

Each document becomes its tokens and an end token. Documents longer than a row are split: full pieces are rows as they
are, and the rest is packed with the others. Packing is best fit decreasing: from the longest piece on, each goes to the
fullest row that still has room, found in a segment tree over the room that rows have left. Pieces are dealt into shards
of bounded size by hash, and each shard is packed in a task of its own; only pieces shorter than a row are shuffled.

A packed row holds the ids and, for attention within documents, where each piece ends (cumulative lengths) and positions
that start again from zero with each piece. Rows are written as Parquet: ids and positions are the bytes of little-endian
unsigned 16-bit integers, so a column of rows is an id matrix.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nbquarry.llm.common import col, stored

LENGTH = 2048
# Bytes of text that make a shard.
SHARD_BYTES = 8 << 20
# Bytes of ids in a batch that leaves a task.
BATCH_BYTES = 8 << 20
# Fixed value: the special token that no merge makes.
END_OF_TEXT = "<|endoftext|>"


class RoomTree:
    """Rows by the room they have left: a segment tree whose leaves are amounts of room and whose nodes count rows."""

    def __init__(self, length: int):
        self._leaves = 1 << length.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self._rows[room].append(row)
        at = room + self._leaves
        while at:
            self._count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return ``(room, row)`` of a row with the least room that is enough, or None."""
        at, count = need + self._leaves, self._count
        # Up to the first node to the right that has rows, then down to its first leaf that has.
        while not count[at]:
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self._leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self._leaves
        row = self._rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, row


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of positions in ``sizes``, which are in decreasing order and between 1 and ``length``."""
    tree, rows = RoomTree(length), []
    for i, size in enumerate(sizes.tolist()):
        found = tree.take(size)
        room, row = found or (length, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(i)
        if room > size:
            tree.add(room - size, row)
    return rows


def _packed(shard: int, first: int, rows: list[list[tuple[int | None, int, np.ndarray]]], length: int, pad: int) -> pa.RecordBatch:
    """Packed rows of pieces ``(doc_id, part, ids)``."""
    ids = np.full((len(rows), length), pad, "<u2")
    positions = np.zeros((len(rows), length), "<u2")
    ends = []
    for r, pieces in enumerate(rows):
        at = [0]
        for _, _, piece in pieces:
            ids[r, at[-1]:at[-1] + len(piece)] = piece
            positions[r, at[-1]:at[-1] + len(piece)] = np.arange(len(piece))
            at.append(at[-1] + len(piece))
        ends.append(at)
    row_bytes = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
    return pa.record_batch({
        "shard": pa.array(np.full(len(rows), shard), pa.int64()), "row": pa.array(np.arange(first, first + len(rows)), pa.int64()),
        "doc_ids": pa.array([[p[0] for p in r] for r in rows], pa.list_(pa.int64())), "parts": pa.array([[p[1] for p in r] for r in rows], pa.list_(pa.int32())),
        "cu_seqlens": pa.array(ends, pa.list_(pa.int32())), "ids": row_bytes(ids), "positions": row_bytes(positions),
    })


SCHEMA = "shard long, row long, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, ids binary, positions binary"


def pack(pieces: DataFrame, shards: int, pad: int, length: int = LENGTH) -> DataFrame:
    """Rows of ``SCHEMA`` from pieces ``(doc_id, part, ids)`` shorter than ``length``; ids are bytes of 16-bit integers."""
    def pack_shard(table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x.as_py(), "<u2") for x in table.column("ids")]
        doc_ids, parts = table.column("doc_id").to_pylist(), table.column("part").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), doc_ids[i] is None, doc_ids[i] or 0, parts[i]))
        rows = best_fit(np.array([len(ids[i]) for i in order]), length)
        shard, step = table.column("shard")[0].as_py(), max(1, BATCH_BYTES // (4 * length))
        whole = [[(doc_ids[order[i]], parts[order[i]], ids[order[i]]) for i in row] for row in rows]
        return pa.Table.from_batches([_packed(shard, i, whole[i:i + step], length, pad) for i in range(0, len(whole), step)])

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", "ids"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(pack_shard, SCHEMA)


_ENCODINGS: dict[str, object] = {}


def _encoder(spark: SparkSession, path: str, pattern: str):
    """A function that gives the encoding on the workers, built once in each, and the end token.

    The rank file, of fixed size, is broadcast, so that executors need not have it.
    """
    with open(path, "rb") as file:
        data = file.read()
    key, ranks = hashlib.sha256(data + pattern.encode()).hexdigest(), spark.sparkContext.broadcast(data)
    end = max(int(line.split()[1]) for line in data.splitlines() if line) + 1

    def load():
        import tiktoken

        if key not in _ENCODINGS:
            pairs = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.value.splitlines() if line)}
            _ENCODINGS.clear()
            _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens={END_OF_TEXT: end})
        return _ENCODINGS[key]

    return load, end


def pack_documents(
    docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Packed rows (``SCHEMA``) of all documents, tokenized with the rank file at ``path`` and split by ``pattern``.

    ``shard`` and ``row`` name a packed row; full pieces have shard -1 and the part's number as row. ``doc_ids`` and ``parts`` say
    which piece of which document stands in each segment, ``cu_seqlens`` where segments begin and the last one ends. What is
    left of a row is filled with the end token, beyond the last cumulative length. NULL and empty texts are an end token
    alone, so every document is in some row. Repeated rows are documents of their own; an empty table gives no rows.
    """
    if length > 1 << 16:
        raise ValueError("positions have 16 bits")
    load, end = _encoder(docs.sparkSession, path, pattern)
    if end >= 1 << 16:
        raise ValueError("ids have 16 bits")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load()
        names = ["doc_id", "part", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        out, size = ([], [], []), 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encoding.encode_ordinary(value.as_py() or ""), end], "<u2")
                for part, start in enumerate(range(0, len(ids), length)):
                    piece = ids[start:start + length].tobytes()
                    for column, x in zip(out, (doc_id, part, piece)):
                        column.append(x)
                    size += len(piece)
                    if size >= BATCH_BYTES:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names)
                        out, size = ([], [], []), 0
        if out[0]:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(d, p, np.frombuffer(x, "<u2"))] for d, p, x in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                packed = _packed(-1, 0, rows, length, 0)
                yield packed.set_column(1, "row", batch.column(1).cast(pa.int64()))

    plain = docs.select(col(id).cast("long").alias("doc_id"), col(text).alias("text"))
    size = plain.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 1
    # Full rows and short pieces come from one pass over the texts.
    pieces = stored(plain.mapInArrow(split, "doc_id long, part int, ids binary"))
    whole = F.octet_length("ids") == 2 * length
    packed = pack(pieces.where(~whole), max(1, -(-size // shard_bytes)), end, length)
    return pieces.where(whole).mapInArrow(full, SCHEMA).unionByName(packed)


def write(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet files, which hold the id matrix row by row."""
    packed.write.mode("errorifexists").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """The pieces back: ``(doc_id, part, ids)`` with ids as bytes, whose concatenation by part is the document."""
    segment = F.explode(F.sequence(F.lit(0), F.size("doc_ids") - 1))
    at = packed.withColumn("i", segment)
    start, stop = F.col("cu_seqlens")[F.col("i")], F.col("cu_seqlens")[F.col("i") + 1]
    return at.select(F.col("doc_ids")[F.col("i")].alias("doc_id"), F.col("parts")[F.col("i")].alias("part"), F.substring("ids", 2 * start + 1, 2 * (stop - start)).alias("ids"))
