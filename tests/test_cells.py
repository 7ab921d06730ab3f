"""Order, gaps and flags: hand-made cases, and random cells against a plain loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from nbquarry.functions import documents as D
from nbquarry.operators import cells as C, shred
from nbquarry.plans.collect import notebook_metrics

# counts of the code cells -> unambiguous, out of order, skips in total, skips in the middle, maximum
CASES = [
    ([None, None], (False, False, 0, 0, 0)),
    ([1, 2, 3], (True, False, 0, 0, 3)),
    ([5, 6], (True, False, 0, 0, 6)),
    ([1, 4, 6], (True, False, 3, 1, 6)),
    ([3, 1, 2], (True, True, 0, 0, 3)),
    ([2, 2, 5], (True, False, 2, 0, 5)),
    ([1, None, 2], (True, False, 0, 0, 2)),
    ([1, "*"], (False, False, 0, 0, 1)),
    ([1, 3.0], (False, False, 0, 0, 1)),
    ([], (False, False, 0, 0, 0)),
]
FIELDS = ["has_unambiguous_order", "out_of_order", "n_skips_total", "n_skips_middle", "max_execution_count"]


def notebooks(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "nb_id int, t string")
    return df.select("nb_id", D.parse_json(F.col("t")).alias("doc"))


def code(count):
    return {"cell_type": "code", "source": "", "execution_count": count, "outputs": []}


def test_hand_made_counts(spark):
    docs = [{"cells": [{"cell_type": "markdown"}] + [code(c) for c in counts]} for counts, _ in CASES]
    nbs = notebooks(spark, docs)
    expected = [e for _, e in CASES]
    in_row = [tuple(r) for r in notebook_metrics(nbs).orderBy("nb_id").select(*FIELDS).collect()]
    assert in_row == expected
    long = [tuple(r) for r in C.cell_metrics(shred.explode_cells(nbs)).orderBy("nb_id").select(*FIELDS).collect()]
    assert long == expected


def model(counts):
    """The five metrics by walking the counts."""
    ints = [c for c in counts if type(c) is int]
    stored = [c for c in counts if c is not None]
    steps = sorted(ints)
    gaps = [(a, b - a - 1) for a, b in zip(steps, steps[1:]) if b - a > 1]
    return (
        bool(ints) and len(ints) == len(stored),
        any(b < a for a, b in zip(ints, ints[1:])),
        sum(g for _, g in gaps),
        sum(g for a, g in gaps if a != steps[0]),
        max(ints, default=0),
    )


@pytest.mark.parametrize("piece", [1, 3, C.PIECE])
def test_random_counts_in_pieces(spark, piece):
    rng = random.Random(piece)
    all_counts = [
        [rng.choice([None, None, rng.randint(1, 12), rng.randint(1, 12), k + 1]) for k in range(rng.randint(1, 14))]
        for _ in range(120)
    ]
    rows = [(nb, i, "code", c, c is not None) for nb, counts in enumerate(all_counts) for i, c in enumerate(counts)]
    rng.shuffle(rows)
    cells = spark.createDataFrame(
        rows, "nb_id int, cell_idx int, cell_type string, execution_count long, execution_count_set boolean"
    ).repartition(5)
    order = {r.nb_id: r.out_of_order for r in C.out_of_order(cells, piece).collect()}
    gaps = {r.nb_id: (r.n_skips_total, r.n_skips_middle) for r in C.execution_gaps(cells).collect()}
    for nb, counts in enumerate(all_counts):
        expected = model(counts)
        assert order[nb] == expected[1], counts
        assert gaps[nb] == expected[2:4], counts


def test_one_notebook_with_most_rows(spark):
    """A long sorted notebook with one fall far from any piece border, among many short ones."""
    n = 30_000
    e = F.when(F.col("id") == 20_001, F.lit(5)).otherwise(F.col("id") + 1)
    long = spark.range(n).select(F.lit(-1).cast("long").alias("nb_id"), F.col("id").alias("cell_idx"), e.alias("execution_count"))
    short = spark.range(1000).select(F.col("id").alias("nb_id"), F.lit(0).cast("long").alias("cell_idx"), F.lit(1).cast("long").alias("execution_count"))
    cells = long.unionByName(short).withColumns({"cell_type": F.lit("code"), "execution_count_set": F.lit(True)})
    fallen = [r.nb_id for r in C.out_of_order(cells).where("out_of_order").collect()]
    assert fallen == [-1]
    row = C.execution_gaps(cells).where("nb_id = -1").first()
    # 20002 is missing and 5 occurs twice
    assert (row.n_skips_total, row.n_skips_middle) == (1, 1)


def test_marks(spark):
    def cell(kind, source, outputs=None):
        return {"cell_type": kind, "source": source, "outputs": outputs or []}

    def shown(*mimes):
        return [{"output_type": "display_data", "data": {m: "" for m in mimes}}]

    cases = [
        (cell("markdown", "we asked CHATGPT."), {"ai_marker_found"}),
        (cell("markdown", "precursors and cursory"), set()),
        (cell("markdown", "éclaude claudeé"), set()),
        (cell("markdown", "xAs an AI language modelx"), {"ai_marker_found"}),
        (cell("code", "# ChatGPT"), set()),
        (cell("code", "a ``` b"), {"triple_backticks_in_code"}),
        (cell("markdown", "```"), set()),
        (cell("code", "/x"), {"has_abs_data_path"}),
        (cell("code", "/ x"), set()),
        (cell("code", "a\n/x"), set()),
        (cell("code", "open('C:\\d')"), {"has_abs_data_path"}),
        (cell("markdown", "/x"), set()),
        (cell("code", "", shown("text/plain")), {"outputs_text"}),
        (cell("code", "", shown("text/html")), {"outputs_text", "outputs_html_js"}),
        (cell("code", "", shown("application/javascript")), {"outputs_html_js"}),
        (cell("code", "", shown("image/svg+xml")), {"outputs_image"}),
        (cell("code", "", shown("image/gif")), set()),
        (cell("code", "", shown("text/latex")), {"outputs_text", "outputs_formatted"}),
        (cell("code", "", shown("application/vnd.bokehjs_exec.v0+json")), {"outputs_ext"}),
        (cell("code", "", shown("application/plotly.v1+json")), {"outputs_ext"}),
        (cell("code", "", [{"output_type": "error"}]), {"outputs_error"}),
        (cell("code", "", [{"output_type": "stream", "text": "x"}, "not an object"]), set()),
        (cell("raw", "```", shown("text/plain")), set()),
    ]
    flags = ["ai_marker_found", "triple_backticks_in_code", "has_abs_data_path", "outputs_text", "outputs_image",
             "outputs_html_js", "outputs_formatted", "outputs_ext", "outputs_error"]
    nbs = notebooks(spark, [{"cells": [c]} for c, _ in cases])
    for metrics in (notebook_metrics(nbs), C.cell_metrics(shred.explode_cells(nbs))):
        rows = metrics.orderBy("nb_id").select(*flags).collect()
        for (c, expected), row in zip(cases, rows):
            assert {f for f in flags if row[f]} == expected, c


def test_both_forms_agree(spark):
    rng = random.Random(5)
    docs = [
        {"cells": [
            {"cell_type": rng.choice(["code", "code", "markdown", "raw", "odd"]), "source": rng.choice(["/a", "x", ["```", "y"]]),
             "execution_count": rng.choice([None, "*", rng.randint(1, 9)]),
             "outputs": rng.choice([[], [{"output_type": "error"}], [{"output_type": "display_data", "data": {"text/html": ""}}]])}
            for _ in range(rng.randint(0, 8))
        ] + [{"cell_type": "raw"}]}
        for _ in range(80)
    ]
    nbs = notebooks(spark, docs)
    long = C.cell_metrics(shred.explode_cells(nbs))
    columns = sorted(long.columns)
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert key(long) == key(notebook_metrics(nbs))
