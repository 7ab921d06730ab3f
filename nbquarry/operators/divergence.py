"""Where the outputs of two notebooks part: a tree of hashes, and the alignment of their leaves.

A leaf is the hash of one canonical output, with its place; the root is the hash of all of them. Notebooks with equal roots
are settled by the root alone. For the others, the leaves before the first difference are counted off, and the rest is
aligned by a longest common subsequence: outputs in it are the same, what lies between is changed, missing or new. Only
hashes travel to the comparison, never outputs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from nbquarry.functions import documents as D
from nbquarry.operators.outputs import canonical_output

LEAF = "struct<cell_idx: int, output_idx: int, hash: binary>"
_INT = T.IntegerType()
_GAP = T.StructType([T.StructField(n, _INT) for n in ("orig_from", "orig_to", "exec_from", "exec_to")])
ALIGNED = T.StructType([T.StructField("first", _INT), T.StructField("n_equal", _INT), T.StructField("gaps", T.ArrayType(_GAP))])


def _leaf(cell_idx: Column, output_idx: Column, output: Column) -> Column:
    digest = F.unhex(F.left(F.sha2(F.to_json(canonical_output(output)), 256), F.lit(32)))
    return F.struct(cell_idx.cast("int").alias("cell_idx"), output_idx.cast("int").alias("output_idx"), digest.alias("hash"))


def output_leaves(notebooks: DataFrame) -> Column:
    """The leaves of each notebook in order; NULL where it is undecoded."""
    cells = F.coalesce(D.list_items(F.col("doc"), "$.cells"), F.array().cast("array<variant>"))
    none = F.array().cast(f"array<{LEAF}>")

    def of_cell(cell: Column, i: Column) -> Column:
        outputs = F.transform(D.list_items(cell, "$.outputs"), lambda o, k: _leaf(i, k, o))
        return F.when(F.try_variant_get(cell, "$.cell_type", "string") == "code", F.coalesce(outputs, none)).otherwise(none)

    of_doc = F.when(F.col("doc").isNotNull(), F.flatten(F.transform(cells, of_cell)))
    if "large" not in notebooks.columns:
        return of_doc
    return F.coalesce(of_doc, F.transform("large.outputs", lambda o: _leaf(o.cell_idx, o.output_idx, D.parse_json(o.json))))


def hash_tree(notebooks: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``root`` and ``leaves``. Runs inside each row: no shuffle."""
    leaves = D.computed_once(notebooks.select(*keep, output_leaves(notebooks).alias("leaves")), "leaves")
    root = F.sha2(F.unhex(F.array_join(F.transform("leaves", lambda leaf: F.hex(leaf.hash)), "")), 256)
    return leaves.select(*keep, F.when(F.col("leaves").isNotNull(), root).alias("root"), "leaves")


# ---- longest common subsequence ----

def _prefix_lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``, row by row in the bits of one integer."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        common = row & at.get(x, 0)
        row = (row + common | row - common) & full
    lengths, n = [0], 0
    for j in range(len(b)):
        n += not row >> j & 1
        lengths.append(n)
    return lengths


def common_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of ``a`` and ``b``, by halving ``a``: memory grows with the lists, not their product."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i0, i1, j0, j1 = open_.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        if i1 - i0 == 1:
            if a[i0] in b[j0:j1]:
                found.append((i0, b.index(a[i0], j0, j1)))
            continue
        middle = (i0 + i1) // 2
        upper = _prefix_lengths(a[i0:middle], b[j0:j1])
        lower = _prefix_lengths(a[middle:i1][::-1], b[j0:j1][::-1])[::-1]
        cut = j0 + max(range(j1 - j0 + 1), key=lambda j: upper[j] + lower[j])
        open_ += [(i0, middle, j0, cut), (middle, i1, cut, j1)]
    return sorted(found)


def align(a: list, b: list) -> dict:
    """``first`` position that differs, the number of equal outputs, and what lies between them."""
    first = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    gaps, i, j = [], 0, 0
    pairs = common_pairs(a, b)
    for x, y in [*pairs, (len(a), len(b))]:
        if (x, y) != (i, j):
            gaps.append({"orig_from": i, "orig_to": x, "exec_from": j, "exec_to": y})
        i, j = x + 1, y + 1
    return {"first": first, "n_equal": len(pairs), "gaps": gaps}


def divergence(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """For pairs of trees ``(orig_root, orig_leaves, exec_root, exec_leaves)`` that differ: where, and how much.

    ``orig_cell_idx``, ``orig_output_idx`` and the same with ``exec_`` name the first output that differs (NULL on the side that has no
    more), ``n_orig`` and ``n_exec`` count outputs, ``n_equal`` those that both have in the same order; ``gaps`` are the ranges of
    outputs between these. Pairs with equal roots, or of which one notebook is undecoded, are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(ALIGNED)

    @F.arrow_udf(ALIGNED)
    def aligned(orig: pa.Array, executed: pa.Array) -> pa.Array:
        return pa.array([align(a, b) for a, b in zip(orig.to_pylist(), executed.to_pylist())], kind)

    hashes = lambda side: F.transform(f"{side}_leaves", lambda leaf: leaf.hash)
    differing = pairs.where(F.col("orig_root") != F.col("exec_root")).withColumn("aligned", aligned(hashes("orig"), hashes("exec")))
    place = lambda side, field: F.get(f"{side}_leaves", F.col("aligned.first"))[field].alias(f"{side}_{field}")
    return differing.select(
        *keep, *[place(side, field) for side in ("orig", "exec") for field in ("cell_idx", "output_idx")],
        F.array_size("orig_leaves").alias("n_orig"), F.array_size("exec_leaves").alias("n_exec"), F.col("aligned.n_equal").alias("n_equal"),
        F.col("aligned.gaps").alias("gaps"),
    )
