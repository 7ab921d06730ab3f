"""Language-model scores by context-tree weighting over bytes.

A text is its words, lower-cased in A-Z and joined by one space, and an end byte. Each byte is eight binary decisions, the
highest bit first. A decision has a context of up to ``DEPTH`` bytes before it; for every context of every length, the
training texts give two counts, and the Krichevsky-Trofimov estimate from them. The weight between a context and its
extensions by one more byte is that of context-tree weighting, from the probability each gives to the training data, so
a prediction mixes the estimates of all depths. A decision is predicted from the contexts that were seen: the
longest of them acts as a leaf.

Texts are dealt into blocks of bounded size. A block gives its distinct runs of ``DEPTH + 1`` bytes with counts; summed
over blocks these hold every context. The tree is cut below its first two levels: subtrees, one for each pair of last
bytes, are weighed in separate tasks, and only sums for the two upper levels, at most 256 * 255 rows, come to the
driver. Each run gets its probability there, and runs return to the blocks that asked for them: no task ever holds
more of the model than its own block needs. Counts of words, for the base score, go the same way; words are told apart
by 63-bit hashes, of which two among a billion distinct words are equal with a chance of one in twenty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from nbquarry.llm.common import col, stored

# Bytes of context.
DEPTH = 5
# Bytes of text in a block.
BLOCK_BYTES = 16 << 20
# Bytes of text turned into runs at a time.
CHUNK_BYTES = 1 << 20
END = b"\n"
# Fixed value: what the base score adds to each count.
ADDED = 0.1


def training(id: Column) -> Column:
    """Whether a document is learned from: crc32 of its id as text is not divisible by 10. A NULL id counts as empty."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 10 != 0


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The run that ends at each byte of each text and its end, and where each text starts among them."""
    start = END * depth
    joined = np.frombuffer(b"".join([start + t + END for t in texts]), np.uint8)
    runs = np.zeros(len(joined) - depth, np.uint64)
    for k in range(depth + 1):
        runs |= joined[depth - k:len(joined) - k].astype(np.uint64) << np.uint64(8 * k)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    # In ``runs``, text i is preceded by i paddings.
    keep = np.repeat(np.arange(len(texts)) * depth, sizes) + np.arange(sizes.sum())
    return runs[keep], starts


def _chunks(texts: pa.ChunkedArray) -> Iterator[tuple[int, list[list[bytes]]]]:
    """``(first row, tokens of some rows)``, about ``CHUNK_BYTES`` at a time."""
    first, held, size = 0, [], 0
    for value in texts:
        found = tokens(value.as_py())
        held.append(found)
        size += sum(map(len, found)) + len(found)
        if size >= CHUNK_BYTES:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def _hashed(texts: list[list[bytes]]) -> np.ndarray:
    """Keys of the words of some texts, each text followed by its end, the empty word: negative numbers, unlike runs."""
    whole = chain.from_iterable(chain(t, (b"",)) for t in texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, whole), np.uint64)
    return -1 - (hashes >> np.uint64(1)).astype(np.int64)


class _Counts:
    """Distinct keys with counts, kept sorted and merged now and then."""

    def __init__(self):
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, learned: np.ndarray) -> None:
        found, at = np.unique(keys, return_inverse=True)
        self._parts.append((found, np.bincount(at, learned, minlength=len(found)).astype(np.int64)))
        if sum(len(p[0]) for p in self._parts) > 1 << 21:
            self._parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([p[0] for p in self._parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([p[1] for p in self._parts])).astype(np.int64)


def _count(table: pa.Table, depth: int) -> pa.Table:
    """What a block needs of the model: keys of its runs and words, each with its count in the block's training texts."""
    train = table.column("train").to_numpy(zero_copy_only=False)
    counts = _Counts()
    for first, texts in _chunks(table.column("text")):
        learned = train[first:first + len(texts)]
        joined = [b" ".join(t) for t in texts]
        runs, _ = _runs(joined, depth)
        counts.add(runs.view(np.int64), np.repeat(learned, [len(j) + 1 for j in joined]))
        counts.add(_hashed(texts), np.repeat(learned, [len(t) + 1 for t in texts]))
    keys, n = counts.merged()
    return pa.table({"block": np.full(len(keys), table.column("block")[0].as_py()), "key": keys, "n": n})


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series, eight steps further on."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _node(byte: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """The decision node of a byte's bit (1 to 255: the bits before it, with a leading one) and the bit's value."""
    return (byte | np.uint64(256)) >> np.uint64(8 - bit), (byte >> np.uint64(7 - bit)) & np.uint64(1)


def _subtree(runs: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[list[dict]]:
    """For each bit of the byte predicted: the nodes of depths 2 to ``depth`` of the subtree that holds ``runs``.

    A node has its counts, the logarithm of its weighted probability, the weight of its own estimate, and ``at``: which
    node each run belongs to.
    """
    byte, context = runs & np.uint64(255), runs >> np.uint64(8)
    for bit in range(8):
        prefix, value = _node(byte, bit)
        nodes: list[dict] = []
        for d in range(2, depth + 1):
            keys = (context & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | prefix
            found, first, at = np.unique(keys, return_index=True, return_inverse=True)
            ones = np.bincount(at, counts * value.astype(np.int64))
            zeros = np.bincount(at, counts) - ones
            nodes.append({"at": at, "first": first, "zeros": zeros, "ones": ones, "log_kt": log_kt(zeros, ones), "prefix": found & np.uint64(255)})
        for d in range(len(nodes) - 1, -1, -1):
            node = nodes[d]
            if d == len(nodes) - 1:
                node["log_w"], node["own"] = node["log_kt"], np.ones(len(node["zeros"]))
            else:
                deeper = nodes[d + 1]
                children = np.bincount(node["at"][deeper["first"]], deeper["log_w"], minlength=len(node["zeros"]))
                node["log_w"] = np.logaddexp(node["log_kt"], children) - math.log(2)
                node["own"] = np.exp(node["log_kt"] - math.log(2) - node["log_w"])
        yield nodes


def _upper_sums(table: pa.Table, depth: int) -> pa.Table:
    """For the last byte of context and each node: counts, and log-probability of the subtree at depth 2."""
    runs, counts = table.column("run").to_numpy().view(np.uint64), table.column("n").to_numpy()
    last = int(runs[0] >> np.uint64(8) & np.uint64(255))
    tops = [nodes[0] for nodes in _subtree(runs, counts, depth)]
    join = lambda key: np.concatenate([t[key] for t in tops])
    nodes = join("prefix").astype(np.int64)
    return pa.table({
        "last": np.full(len(nodes), last), "node": nodes, "zeros": join("zeros").astype(np.int64), "ones": join("ones").astype(np.int64),
        "log_w": join("log_w"),
    })


def _estimate(zeros: np.ndarray, ones: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (np.where(value == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)


def _predict(table: pa.Table, depth: int, upper: dict[str, np.ndarray]) -> pa.Table:
    """Logarithm to base 10 of the probability of each run's last byte after the bytes before it."""
    runs, counts = table.column("run").to_numpy().view(np.uint64), table.column("n").to_numpy()
    byte, last = runs & np.uint64(255), (runs >> np.uint64(8) & np.uint64(255)).astype(np.int64)
    total = np.zeros(len(runs))
    for bit, nodes in enumerate(_subtree(runs, counts, depth)):
        prefix, value = _node(byte, bit)
        below, seen = None, np.zeros(len(runs), bool)
        for node in reversed(nodes):
            zeros, ones, own = (node[k][node["at"]] for k in ("zeros", "ones", "own"))
            estimate = _estimate(zeros, ones, value)
            below = estimate if below is None else np.where(seen, own * estimate + (1 - own) * below, estimate)
            seen = zeros + ones > 0
        for level, at in (("1", (last, prefix.astype(np.int64))), ("0", (prefix.astype(np.int64),))):
            zeros, ones, own = (upper[k + level][at] for k in ("zeros", "ones", "own"))
            estimate = _estimate(zeros, ones, value)
            below = np.where(seen, own * estimate + (1 - own) * below, estimate)
            seen = zeros + ones > 0
        total += np.log10(below)
    return pa.table({"run": table.column("run"), "value": total})


def _upper(rows: list) -> dict[str, np.ndarray]:
    """The two upper levels of the tree from sums over their subtrees: at most 256 * 255 rows."""
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        zeros[r.last, r.node], ones[r.last, r.node], below[r.last, r.node] = r.zeros, r.ones, r.log_w
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(own, below) - math.log(2)
    root_zeros, root_ones = zeros.sum(axis=0), ones.sum(axis=0)
    root = log_kt(root_zeros, root_ones)
    root_weighted = np.logaddexp(root, weighted.sum(axis=0)) - math.log(2)
    return {
        "zeros1": zeros, "ones1": ones, "own1": np.exp(own - math.log(2) - weighted),
        "zeros0": root_zeros, "ones0": root_ones, "own0": np.exp(root - math.log(2) - root_weighted),
    }


def _score(docs: pa.Table, model: pa.Table, depth: int, total: int, distinct: int) -> pa.Table:
    """Scores of a block's texts from what the block was given of the model."""
    order = np.argsort(model.column("key").to_numpy())
    keys, values = model.column("key").to_numpy()[order], model.column("value").to_numpy()[order]
    words = int(np.searchsorted(keys, 0))
    of_runs, of_words = pd.Index(keys[words:]), pd.Index(keys[:words])
    run_values, counts = values[words:], values[:words]
    logs = np.log10((counts + ADDED) / (total + ADDED * (distinct + 1)))
    score, base, n_tokens, n_known, n_bytes = [], [], [], [], []
    for _, texts in _chunks(docs.column("text")):
        joined = [b" ".join(t) for t in texts]
        runs, starts = _runs(joined, depth)
        score.append(np.add.reduceat(run_values[of_runs.get_indexer(runs.view(np.int64))], starts))
        sizes = np.array([len(t) + 1 for t in texts])
        at, starts = of_words.get_indexer(_hashed(texts)), np.r_[0, np.cumsum(sizes)[:-1]]
        base.append(np.add.reduceat(logs[at], starts))
        n_known.append(np.add.reduceat((counts[at] > 0).astype(np.int64), starts))
        n_tokens.append(sizes)
        n_bytes += [len(j) + 1 for j in joined]
    scores = np.concatenate(score)
    return pa.table({
        "doc_id": docs.column("doc_id"), "held_out": pa.compute.invert(docs.column("train")), "n_tokens": np.concatenate(n_tokens),
        "n_known": np.concatenate(n_known), "train_tokens": np.full(len(docs), total), "base_score": np.concatenate(base), "score": scores,
        "bits_per_byte": -scores / math.log10(2) / np.array(n_bytes),
    })


SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double,"
    " bits_per_byte double"
)


def score_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: see ``SCHEMA``. ``score`` is log10 of the probability of the text, ``bits_per_byte`` its code length.

    The model and the base score learn from the documents that ``training`` picks, and score all of them, also those
    learned from. NULL and empty texts consist of their end alone. Repeated rows are documents of their own. Without
    training texts each bit has probability 1/2. An empty table gives an empty result.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be between 2 and 6")
    plain = docs.select(col(id).alias("doc_id"), col(text).alias("text"), training(col(id)).alias("train"))
    size = plain.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 1
    blocks = max(1, -(-size // block_bytes))
    dealt = plain.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    needs = stored(dealt.groupBy("block").applyInArrow(lambda t: _count(t, depth), "block long, key long, n long"))

    # A word has one row for each block that has it, at most.
    same = Window.partitionBy("key")
    words = stored(needs.where("key < 0").select(
        "block", "key", F.sum("n").over(same).alias("n"), (F.row_number().over(same.orderBy("block")) == 1).alias("first")
    ))
    total, distinct = words.where("first and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    asked = needs.where("key >= 0").select("block", F.col("key").alias("run"), "n")
    runs = stored(asked.groupBy("run").agg(F.sum("n").alias("n")))
    subtree = F.shiftright("run", 8).bitwiseAND(0xFFFF)
    sums = runs.groupBy(subtree).applyInArrow(
        lambda t: _upper_sums(t, depth), "last long, node long, zeros long, ones long, log_w double"
    )
    sums = sums.groupBy("last", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log_w")])
    upper = _upper(sums.collect())
    predicted = runs.groupBy(subtree).applyInArrow(lambda t: _predict(t, depth, upper), "run long, value double")

    # Single precision is enough for one byte, and packs better.
    given = asked.select("block", "run").join(predicted, "run").select("block", F.col("run").alias("key"), F.col("value").cast("float").cast("double"))
    model = given.unionByName(words.select("block", "key", F.col("n").cast("double").alias("value")))
    both = dealt.groupBy("block").cogroup(model.groupBy("block"))
    return both.applyInArrow(lambda texts, given: _score(texts, given, depth, total, distinct), SCHEMA)
