"""Lines that many documents repeat, dropped by probing arrays behind a minimal perfect hash.

A line's key (stripped, lower-cased in A-Z) is named by a 128-bit hash. Distinct hashes are counted, with the number of
documents and the largest id that hold each, and dealt to shards of bounded size. A shard is a few arrays: the bits of a
minimal perfect hash, which gives each of its hashes a slot of its own, and by slot a 16-bit fingerprint and a count in
as few bytes as the shard's largest count needs; the largest id follows for repeated lines only. There is no table of
lines to join with: a document's hashes go to the task that holds a shard's arrays and are looked up there by the
thousands. Only the numbers of dropped lines come back. Shards that many documents ask are repeated, and each copy
answers a part of them, so a line that every document has is no hot key.

The perfect hash has levels. Keys alone in their place of a level's bit array are settled there, the others go on to
the next, smaller level; a key's slot is the number of set bits before its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from nbquarry.llm.common import col, free_name, stored

# Lines of at least so many code points in at least so many documents are dropped; white space at both ends is not part of a key.
SHORTEST, LEAST = 20, 3
WHITE = " \t\n\x0b\x0c\r"
# Distinct lines of a shard, and lookups that one copy of its arrays answers.
SHARD_KEYS, PART_ROWS = 1 << 13, 1 << 17
# So many shards with more than one copy are broadcast as a list; a longer list is joined.
MOST_LISTED = 1 << 20
# Bits of a level per key that comes to it.
ROOM = 1.6
# Rows of a batch that leaves a task.
BATCH_ROWS = 1 << 16

_STEP = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (_STEP, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def line_keys(text: str | None) -> tuple[list[str], list[bytes]]:
    """The lines of a text and their keys; a key too short to count is empty. A NULL text is one empty line."""
    lines = (text or "").split("\n")
    stripped = [line.strip(WHITE) for line in lines]
    return lines, [s.encode().lower() if len(s) >= SHORTEST else b"" for s in stripped]


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below ``size`` for each key, mixed anew for each level."""
    x = (keys[:, 0] ^ keys[:, 1] * _MIX[0]) + np.uint64((level + 1) * _STEP % 2**64)
    x = (x ^ x >> np.uint64(30)) * _MIX[1]
    x = (x ^ x >> np.uint64(27)) * _MIX[2]
    return ((x ^ x >> np.uint64(31)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys, given as rows of two 64-bit words."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.bits = list(sizes), bits
        self._words = np.frombuffer(bits, "<u8")
        ones = np.bitwise_count(self._words).astype(np.int64)
        self._before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = 64 * max(1, -(-int(ROOM * len(keys)) // 64))
            at = _places(keys, len(sizes), size)
            times = np.bincount(at, minlength=size)
            levels.append(np.packbits(times == 1, bitorder="little").tobytes())
            sizes.append(size)
            keys = keys[times[at] > 1]
        return cls(sizes, b"".join(levels))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key. A key that was not built in has some slot, or -1."""
        out, left, first = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _places(keys[left], level, size)
            word, bit = first + at // 64, (at % 64).astype(np.uint64)
            found = (self._words[word] >> bit & np.uint64(1)).astype(bool)
            lower = self._words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[found]] = (self._before[word] + np.bitwise_count(lower))[found]
            left, first = left[~found], first + size // 64
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (keys[:, 1] >> np.uint64(48)).astype(np.uint16)


SHARD = "sizes array<int>, bits binary, fingerprints binary, count_bytes int, counts binary, slots binary, keepers binary"


def shard_arrays(keys: np.ndarray, counts: np.ndarray, keepers: np.ndarray, known: np.ndarray, least: int) -> dict:
    """The arrays of a shard. ``keepers`` holds the largest id of each key, where ``known``."""
    hashed = PerfectHash.build(keys)
    slot = hashed.slots(keys)
    width = np.min_scalar_type(int(counts.max(initial=0))).itemsize
    by_slot, prints = np.zeros(len(keys), f"<u{width}"), np.zeros(len(keys), "<u2")
    by_slot[slot], prints[slot] = counts, fingerprints(keys)
    kept = np.flatnonzero((counts >= least) & known)
    kept = kept[np.argsort(slot[kept])]
    return {
        "sizes": hashed.sizes, "bits": hashed.bits, "fingerprints": prints.tobytes(), "count_bytes": width, "counts": by_slot.tobytes(),
        "slots": slot[kept].astype("<i4").tobytes(), "keepers": keepers[kept].astype("<i8").tobytes(),
    }


def repeated(shard: dict, keys: np.ndarray, ids: np.ndarray, no_id: np.ndarray, least: int) -> np.ndarray:
    """Which of the lines ``keys`` of documents ``ids`` are in ``least`` documents or more, and to be kept in another one."""
    slot = PerfectHash(shard["sizes"], shard["bits"]).slots(keys)
    prints, counts = np.frombuffer(shard["fingerprints"], "<u2"), np.frombuffer(shard["counts"], f"<u{shard['count_bytes']}")
    often = (slot >= 0) & (prints[slot] == fingerprints(keys)) & (counts[slot] >= least)
    kept, keepers = np.frombuffer(shard["slots"], "<i4"), np.frombuffer(shard["keepers"], "<i8")
    if not len(kept):  # documents without an id hold them all: none is the largest, and none loses its lines
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(kept, slot), len(kept) - 1)
    return often & (kept[at] == slot) & (no_id | (keepers[at] != ids))


def document_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, line, k1, k2)`` for each distinct key of each row ``(doc_id, text, text_hash)``; ``line`` is where it comes first."""
    names, kinds = ["doc_id", "text_hash", "line", "k1", "k2"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, at, digests = [], [], [], []

        def batch() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [pa.array(x, k) for x, k in zip((ids, hashes, at), kinds)]
            return pa.record_batch([*columns, pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1]))], names)

        for rows in batches:
            for doc_id, text, text_hash in zip(*(rows.column(i) for i in range(3))):
                first: dict[bytes, int] = {}
                for line, key in enumerate(line_keys(text.as_py())[1]):
                    if key:
                        first.setdefault(key, line)
                ids += [doc_id.as_py()] * len(first)
                hashes += [text_hash.as_py()] * len(first)
                at += first.values()
                digests += [xxhash.xxh3_128_digest(key) for key in first]
                if len(ids) >= BATCH_ROWS:
                    yield batch()
                    ids, hashes, at, digests = [], [], [], []
        if ids:
            yield batch()

    return docs.select("doc_id", "text", "text_hash").mapInArrow(listed, "doc_id long, text_hash long, line int, k1 long, k2 long")


def _keys(table: pa.Table, first: str, second: str) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in (first, second)], axis=1).view(np.uint64)


def line_index(lines: DataFrame, least: int = LEAST, shard_keys: int = SHARD_KEYS, part_rows: int = PART_ROWS) -> tuple[DataFrame, int]:
    """``(index, shards)``: a stored row of arrays for each shard, with the number of ``copies`` that its lookups ask for."""
    counted = stored(lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")))
    shards = max(1, -(-counted.count() // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        keeper, counts = table.column("keeper"), table.column("n").to_numpy()
        arrays = shard_arrays(_keys(table, "k1", "k2"), counts, keeper.fill_null(0).to_numpy(), keeper.is_valid().to_numpy(), least)
        row = {"shard": table.column("shard")[0].as_py(), "copies": -(-int(counts.sum()) // part_rows), **arrays}
        kinds = {"sizes": pa.list_(pa.int32()), "copies": pa.int32(), "count_bytes": pa.int32()}
        return pa.table({name: pa.array([value], kinds.get(name)) for name, value in row.items()})

    index = counted.withColumn("shard", F.pmod("k1", F.lit(shards))).groupBy("shard").applyInArrow(build, f"shard long, copies int, {SHARD}")
    return stored(index), shards


def repeated_lines(lines: DataFrame, least: int = LEAST, shard_keys: int = SHARD_KEYS, part_rows: int = PART_ROWS) -> DataFrame:
    """``(doc_id, text_hash, line)`` of the keys that a document has to lose, from the stored table of :func:`document_lines`."""
    index, shards = line_index(lines, least, shard_keys, part_rows)
    copied = stored(index.where("copies > 1").select("shard", "copies"))
    listed = F.broadcast(copied) if copied.count() <= MOST_LISTED else copied
    # Both sides' keys must have the same type, or equal keys would go to different tasks.
    copy = F.pmod(F.xxhash64("doc_id", "text_hash", "line"), F.coalesce("copies", F.lit(1))).cast("int")
    asking = lines.withColumn("shard", F.pmod("k1", F.lit(shards))).join(listed, "shard", "left").withColumn("copy", copy).drop("copies")
    # Columns of its own: both sides of a cogroup must not share any, or pruning one side would prune the other.
    arrays = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest("copies", F.lit(1)) - 1))).drop("copies")
    answering = arrays.select(*[F.col(c).alias(f"{c}_") for c in arrays.columns])

    def look_up(questions: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(questions):
            return questions.select(["doc_id", "text_hash", "line"])
        arrays = {name.removesuffix("_"): value[0] for name, value in shard.to_pydict().items()}
        ids = questions.column("doc_id")
        lost = repeated(arrays, _keys(questions, "k1", "k2"), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), least)
        return questions.select(["doc_id", "text_hash", "line"]).filter(pa.array(lost))

    return asking.groupBy("shard", "copy").cogroup(answering.groupBy("shard_", "copy_")).applyInArrow(look_up, "doc_id long, text_hash long, line int")


def dedup_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, shard_keys: int = SHARD_KEYS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` (before that) and ``n_dropped`` (long).

    A key of at least ``SHORTEST`` code points that at least ``least`` documents hold loses all its lines, but in the document
    with the largest id that holds it. Shorter lines and all others stay as they are, joined by line breaks. Every row is
    a document: repeated rows count apart, and those that share the largest id all keep their lines. A NULL id is below all
    others; keys that only rows without id hold lose nothing. A NULL text is one empty line and becomes empty. Ids are integers.
    Other columns stay, ``n_lines`` and ``n_dropped`` are replaced; an empty table stays empty.

    Hashes are shuffled twice, by line and by shard, and whole rows once, to meet the numbers of their lines.
    """
    number, missing, hashed, lost, cut = (free_name(docs, n) for n in ("id_number", "id_missing", "text_hash", "lost_lines", "cut_text"))
    of_text = F.xxhash64(F.coalesce(col(text), F.lit("")))
    lines = stored(document_lines(docs.select(col(id).cast("long").alias("doc_id"), col(text).alias("text"), of_text.alias("text_hash"))))
    answers = repeated_lines(lines, least, shard_keys, part_rows).groupBy(
        F.coalesce("doc_id", F.lit(0)).alias(number), F.col("doc_id").isNull().alias(missing), F.col("text_hash").alias(hashed)
    ).agg(F.collect_set("line").alias(lost))

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def without(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for value, at in zip(texts, numbers):
            lines, keys = line_keys(value.as_py())
            gone = {keys[i] for i in at.as_py() or ()}
            kept = [line for line, key in zip(lines, keys) if not key or key not in gone]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["text", "n_lines", "n_dropped"])

    keyed = docs.withColumns({number: F.coalesce(col(id).cast("long"), F.lit(0)), missing: col(id).isNull(), hashed: of_text})
    met = keyed.join(answers, [number, missing, hashed], "left").withColumn(cut, without(col(text), col(lost)))
    new = {text: col(cut)["text"], "n_lines": col(cut)["n_lines"], "n_dropped": col(cut)["n_dropped"]}
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return met.select(*[new[c].alias(c) if c == text else col(c) for c in others], *[new[c].alias(c) for c in ("n_lines", "n_dropped")])
