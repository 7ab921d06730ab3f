"""Exact top k by inner product, reading sorted lists without random access.

Each component of the candidates is a list, sorted once per block of candidates. A query reads every list from its best
end (the largest values for a positive weight, the smallest for a negative one), all to the same depth. After each
step a candidate's score is known to lie between two bounds: what was read of it, plus for each list not yet read the
worst value of that list, or the value the reading has come to. Once no other candidate's upper bound reaches the k-th best
lower bound, reading stops and the scores of those left are resolved. Many queries read at once, as products of
matrices, in which what has not been read is zero.

Queries meet candidates block by block. Each pair of blocks is a task of bounded size and gives at most k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from nbquarry.llm.common import col, stored

# Rows of a block of candidates and of a block of queries.
CANDIDATES, QUERIES = 8192, 1024
# How deep lists are read, as shares of their length; the last step reads all.
DEPTHS = (0.75, 0.9, 1.0)
# Bounds are resolved early once this many candidates per wanted row are left.
RESOLVE = 16
SCALE = 64


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as double; NULL where a component is NULL or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return F.when(vector.isNotNull() & F.forall(vector, finite), whole)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers, with zeros up to ``width``."""
    values = column.combine_chunks()
    flat, lengths = values.flatten().to_numpy(zero_copy_only=False), np.diff(values.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _width(column: pa.ChunkedArray) -> int:
    return max((len(x) for x in column.combine_chunks()), default=0)


def block_top(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, candidate, score)`` of the ``k`` best candidates for each query, ties to the smaller of ``ids``.

    ``own[q]`` is the position of the query among the candidates, or -1. Values are integers; while sums stay below
    2**24, 32-bit floats hold them exactly, then 64-bit ones, then Python's integers.
    """
    n, width = candidates.shape
    most = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(width, 1)
    if most >= 2.0**53:
        scores = _exact(queries, candidates)
        return _best(scores, np.ones(scores.shape, bool), own, ids, k)
    kind = np.float32 if most < 2.0**24 else np.float64
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    order = np.argsort(candidates, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(candidates, order, axis=0)
    low, high = lists[0], lists[-1]
    found = []
    active = np.arange(len(queries))
    for depth in DEPTHS:
        read = min(n, max(k + 1, int(np.ceil(depth * n))))
        if read == n:
            break
        from_top, from_bottom = rank >= n - read, rank < read
        frontier_top, frontier_bottom = lists[n - read], lists[read - 1]
        qu, qd = up[active], down[active]
        known = qu @ (candidates * from_top).T + qd @ (candidates * from_bottom).T
        upper = known + (qu * frontier_top) @ (~from_top).T.astype(kind) + (qd * frontier_bottom) @ (~from_bottom).T.astype(kind)
        lower = known + (qu * low) @ (~from_top).T.astype(kind) + (qd * high) @ (~from_bottom).T.astype(kind)
        rows = np.flatnonzero(own[active] >= 0)
        lower[rows, own[active][rows]] = upper[rows, own[active][rows]] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), -np.inf)
        left = upper >= bar[:, None]
        done = left.sum(axis=1) <= RESOLVE * k
        for q, keep in zip(active[done], left[done]):
            at = np.flatnonzero(keep)
            scores = candidates[at] @ queries[q]
            part = _best(scores[None], np.ones((1, len(at)), bool), np.array([-1]), ids[at], k)
            found.append((np.full(len(part[0]), q), at[part[1]], part[2]))
        active = active[~done]
        if not len(active):
            break
    if len(active):
        scores = queries[active] @ candidates.T
        q, c, s = _best(scores, np.ones(scores.shape, bool), own[active], ids, k)
        found.append((active[q], c, s))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    scores = whole(queries) @ whole(candidates).T
    return np.clip(scores, -(2**63), 2**63 - 1)


def _best(scores: np.ndarray, allowed: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    rows = np.flatnonzero(own >= 0)
    allowed[rows, own[rows]] = False
    out = [[], [], []]
    for q in range(len(scores)):
        at = np.flatnonzero(allowed[q])
        values = scores[q, at]
        if len(at) > k and values.dtype != object:
            bar = np.partition(values, len(at) - k)[len(at) - k]
            at = at[values >= bar]
            values = scores[q, at]
        pick = np.lexsort((ids[at], -values))[:k] if values.dtype != object else sorted(range(len(at)), key=lambda i: (-values[i], ids[at[i]]))[:k]
        out[0].append(np.full(len(pick), q))
        out[1].append(at[pick])
        out[2].append(np.array([int(v) for v in values[pick]], dtype=np.int64))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
    candidates: int = CANDIDATES, queries: int = QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query``, its ``k`` best other rows.

    Components are ``floor(scale * x)``, scores integer inner products (missing components count as zero, scores beyond
    a long are clipped). Ties go to the smaller id. A row takes no part if its vector is NULL or holds a NULL or a
    non-finite component, or if its id is NULL. A query's own row is no candidate; other rows with the same id are, and
    repeated query rows give repeated results. Fewer than ``k`` candidates give fewer rows, an empty table none.
    """
    usable = stored(
        vectors.select(col(id).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), quantized(col(vector), scale).alias("v"))
        .where("id is not null and v is not null").withColumn("row", F.monotonically_increasing_id())
    )
    total = usable.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    c_blocks, q_blocks = (max(1, -(-n // size)) for n, size in zip(total, (candidates, queries)))
    # The row number is stored, so a row falls into the same block each time.
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = usable.where("asks").select("id", "row", "v", block(q_blocks).alias("q"), every(c_blocks).alias("c"))
    # Columns of its own: both sides of a cogroup must not share any, or pruning one side would prune the other.
    offered = usable.select(*[F.col(c).alias(f"{c}_") for c in ("id", "row", "v")], block(c_blocks).alias("c"), every(q_blocks).alias("q"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        width = max(_width(left.column("v")), _width(right.column("v_")))
        rows, ids = right.column("row_").to_numpy(), right.column("id_").to_numpy()
        asking = left.column("row").to_numpy()
        order = np.argsort(rows)
        at = np.minimum(np.searchsorted(rows[order], asking), len(rows) - 1)
        own = np.where(rows[order][at] == asking, order[at], -1)
        q, c, score = block_top(_matrix(left.column("v"), width), _matrix(right.column("v_"), width), own, ids, k)
        return pa.table([pa.array(x, pa.int64()) for x in (asking[q], left.column("id").to_numpy()[q], ids[c], score)], names)

    met = asked.groupBy("q", "c").cogroup(offered.groupBy("q", "c")).applyInArrow(meet, "query long, query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
