"""Hard negatives for contrastive training, found in an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own, fitted to a bounded sample of rows. A pair of codes is a
cell. For an anchor, every code of a half gets a bound: the anchor's product with the code's centre, plus its length times
the code's radius, the largest distance of a row from its centre. No row of a cell scores more than the two bounds
together. Both lists of bounds are sorted once, and a heap visits cells by falling sums (multi-sequence search), so
the search for rows in a window of scores can stop once the next sum proves that nothing better is left.

Anchors meet candidates block by block, and every block is an index of its rows: two passes, one for an anchor's positives,
one for the negatives in the windows that these give. A pair of blocks is a task of bounded size and gives at most so many
rows per anchor as are wanted.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from nbquarry.llm.common import col, stored
from nbquarry.llm.topk import quantized

# Codes of each half, the rows that they are fitted to at most, and rounds of fitting.
CODES, SAMPLE, ROUNDS = 24, 1 << 13, 6
# Rows of a block of candidates and of a block of anchors.
CANDIDATES, ANCHORS = 8192, 1024
# Rows that are scored at a time.
STEP = 256
SCALE = 256
# Beyond this, sums of products are not exact as doubles.
EXACT = 2.0**53


def codebook(rows: np.ndarray, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``rows`` by k-means, from evenly spaced rows on; the same rows give the same centres."""
    centres = np.unique(rows[np.linspace(0, len(rows) - 1, min(codes, len(rows))).astype(int)], axis=0) if len(rows) else np.zeros((1, rows.shape[1]))
    for _ in range(rounds if len(rows) else 0):
        code = nearest(rows, centres)
        sizes = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


class Cells:
    """Rows of a block in the order of their cells."""

    def __init__(self, vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.vectors, self._split = vectors, books[0].shape[1]
        self._halves = []
        codes = []
        for half, book in zip(self._cut(vectors), books):
            code = nearest(half, book)
            used, code = np.unique(code, return_inverse=True)
            radii = np.zeros(len(used))
            np.maximum.at(radii, code, np.linalg.norm(half - book[used][code], axis=1))
            self._halves.append((book[used], radii))
            codes.append(code)
        cell = codes[0] * max(1, len(self._halves[1][1])) + codes[1]
        self._order = np.argsort(cell, kind="stable")
        shape = (len(self._halves[0][1]), len(self._halves[1][1]))
        self._starts = np.searchsorted(cell[self._order], np.arange(shape[0] * shape[1] + 1))

    def _cut(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[..., :self._split], vectors[..., self._split:]

    def visit(self, anchor: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, float]]:
        """Rows, some at a time, each time with a bound that no row to come exceeds; -inf at the end."""
        lists = []
        for part, (centres, radii) in zip(self._cut(anchor), self._halves):
            length = np.linalg.norm(part)
            # The last term is for rounding.
            bound = centres @ part + length * radii + 1e-9 * length * (np.linalg.norm(centres, axis=1) + radii)
            by_bound = np.argsort(-bound, kind="stable")
            lists.append((bound[by_bound].tolist(), by_bound.tolist()))
        (first, codes), (second, others) = lists
        width, starts = len(second), self._starts
        heap = [(-(first[0] + second[0]), 0, 0)] if first and second else []
        rows, size = [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            # Each pair is reached from one other: the pair before it in the second list, or in the first for the list's head.
            if j + 1 < width:
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if not j and i + 1 < len(first):
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
            cell = codes[i] * width + others[j]
            if starts[cell] < starts[cell + 1]:
                rows.append(self._order[starts[cell]:starts[cell + 1]])
                size += len(rows[-1])
            if rows and (size >= step or not heap):
                yield np.concatenate(rows), -heap[0][0] if heap else -math.inf
                rows, size = [], 0

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> list[int]:
        """Inner products as integers, clipped to 64 bits."""
        part = self.vectors[rows]
        if np.abs(part).max(initial=0) * np.abs(anchor).max(initial=0) * max(1, len(anchor)) < EXACT:
            return (part @ anchor).astype(np.int64).tolist()
        whole = [int(x) for x in anchor]
        return [max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(whole, row)))) for row in part]


def best_in_windows(
    cells: Cells, anchor: np.ndarray, ids: np.ndarray, allowed: np.ndarray, windows: list[tuple[float, float]], k: int, step: int = STEP
) -> list[list[tuple[int, int]]]:
    """For each window ``(low, high)`` of scores the ``k`` best allowed rows in it, as ``(-score, row)`` by falling score, then by id.

    A window is certified, and no longer looked into, once the bound on what is to come lies below its ``low`` or below the
    ``k``-th score found in it.
    """
    best: list[list[tuple[int, int, int]]] = [[] for _ in windows]
    waiting = [w for w, (low, high) in enumerate(windows) if low <= high]
    for rows, bound in cells.visit(anchor, step) if waiting else ():
        rows = rows[allowed[rows]]
        found = list(zip(cells.scores(anchor, rows), ids[rows].tolist(), rows.tolist()))
        for w in waiting:
            low, high = windows[w]
            best[w] = heapq.nsmallest(k, best[w] + [(-s, i, r) for s, i, r in found if low <= s <= high])
        waiting = [w for w in waiting if bound >= windows[w][0] and (len(best[w]) < k or bound >= -best[w][-1][0])]
        if not waiting:
            break
    return [[(s, r) for s, _, r in b] for b in best]


def window_of(score: int, least: int, most: int) -> tuple[float, float]:
    """The whole numbers ``n`` with ``least * score <= 100 * n <= most * score``; empty for a negative score, as ``least < most``."""
    return -(-least * score // 100), most * score // 100


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    values = column.combine_chunks()
    flat, lengths = values.flatten().to_numpy(zero_copy_only=False), np.diff(values.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _meet(asked: DataFrame, offered: DataFrame, work, schema: str) -> DataFrame:
    """``work`` of each pair of blocks; both sides have columns of their own."""
    return asked.groupBy("a", "c").cogroup(offered.groupBy("a_", "c_")).applyInArrow(work, schema)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, id: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 10,
    least: int = 30, most: int = 90, scale: int = SCALE, candidates: int = CANDIDATES, anchors: int = ANCHORS, codes: int = CODES, step: int = STEP,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(scale * x)``; a score is the integer inner product with the anchor (missing components count as
    zero, scores beyond a long are clipped). Higher scores come first, ties by smaller id. An anchor's positives are its
    first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels whose score is
    between ``least`` and ``most`` percent of the positive's are returned, all if there are fewer. So a positive with a
    negative score has none.

    Rows with a NULL id, label or vector, or a NULL or non-finite component take no part. Ids and labels are integers. Repeated
    rows are rows of their own: an anchor's copy is one of its positives, and repeated anchors give repeated results. Other
    columns play no role; an empty table gives none. The codebooks are fitted to the ``SAMPLE`` rows with the smallest hash of
    their id; they decide the order of visits, never the result.
    """
    usable = stored(
        vectors.select(col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), quantized(col(vector), scale).alias("v"))
        .where("id is not null and label is not null and v is not null").withColumn("row", F.monotonically_increasing_id())
    )
    rows, asking, width = usable.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
    width = width or 0
    sample = usable.orderBy(F.xxhash64("id"), "row").select("v").limit(SAMPLE).toArrow()
    fitted = _matrix(sample.column("v"), width) if len(sample) else np.zeros((0, width))
    books = codebook(fitted[:, :width // 2], codes), codebook(fitted[:, width // 2:], codes)

    c_blocks, a_blocks = max(1, -(-rows // candidates)), max(1, -(-asking // anchors))
    # The row number is stored, so a row falls into the same block each time.
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    offered = usable.select(*[F.col(x).alias(f"{x}_") for x in ("id", "row", "label", "v")], block(c_blocks).alias("c_"), every(a_blocks).alias("a_"))
    asked = usable.where("asks").select("id", "row", "label", "v", block(a_blocks).alias("a"))
    each = lambda df: df.withColumn("c", every(c_blocks))

    def candidate_columns(right: pa.Table):
        return _matrix(right.column("v_"), width), *[right.column(x).to_numpy() for x in ("id_", "row_", "label_")]

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "positive_id", "positive_row", "score"]
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        m, ids, row, labels = candidate_columns(right)
        out = []
        of_label = left.column("label").to_numpy()
        asking, q = left.column("row").to_numpy(), _matrix(left.column("v"), width)
        for value in np.unique(of_label):
            mine = np.flatnonzero(labels == value)
            cells = Cells(m[mine], books)
            for a in np.flatnonzero(of_label == value):
                (best,) = best_in_windows(cells, q[a], ids[mine], row[mine] != asking[a], [(-math.inf, math.inf)], positives, step)
                out += [(int(asking[a]), int(ids[mine[r]]), int(row[mine[r]]), -s) for s, r in best]
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names)

    met = _meet(each(asked), offered, find_positives, "anchor long, positive_id long, positive_row long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "positive_row"))
    chosen = stored(met.withColumn("place", place).where(F.col("place") <= positives).groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("chosen")
    ))

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        m, ids, _, labels = candidate_columns(right)
        cells, out = Cells(m, books), []
        for a, q in zip(left.select(["row", "id", "label", "chosen"]).to_pylist(), _matrix(left.column("v"), width)):
            windows = [window_of(p["score"], least, most) for p in a["chosen"]]
            for p, best in zip(a["chosen"], best_in_windows(cells, q, ids, labels != a["label"], windows, negatives, step)):
                out += [(a["row"], a["id"], p["place"], p["positive_id"], p["score"], int(ids[r]), -s) for s, r in best]
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(len(names))], names)

    with_chosen = asked.join(chosen, asked["row"] == chosen["anchor"]).drop("anchor")
    fields = "anchor long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _meet(each(with_chosen), offered, find_negatives, fields)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
