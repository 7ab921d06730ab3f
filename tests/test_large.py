"""Documents too large for a VARIANT, read as a stream: same results as the VARIANT way, nothing lost for its size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from nbquarry.functions import large
from nbquarry.functions.large import read_notebook
from nbquarry.operators import outputs as O, shred
from nbquarry.plans.collect import build_collection, notebook_metrics
from nbquarry.sources.archive import archive_rows, with_document

BROKEN = [
    "", "{", "{}", "[1]", '{"cells":[]} x', '{"cells":[1,]}', '{"cells":[],}', '{"cells":tru}', '{"cells" [1]}', '{"cells":[1 2]}', '{"cells":[]]',
    "nope", '{"cells":["\x01"]}', '{"cells":["\\q"]}', "{cells:[]}", '{"cells":3}', '"x', '{"a":1 "cells":[]}', '{"cells":[],"a":01}', '{"cells":[{]}',
]


def documents(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["import numpy as np\n", "é\t\"q\"", "\\ud83d", "def f():\n  return 1", "ChatGPT", "```", "C:\\tmp", "", "a" * 300])
    text = lambda: rng.choice([word(), [word() for _ in range(rng.randrange(4))], None, 7, {"a": 1}])
    count = lambda: rng.choice([None, rng.randrange(50), rng.randrange(50), "*", 3.0, True, 2**70])

    def output():
        data = {rng.choice(["text/plain", "image/png", "text/html", "application/x+json"]): text() for _ in range(rng.randrange(3))}
        return rng.choice([
            {"output_type": "display_data", "data": data, "metadata": {"x": [1, {"data": 2}]}}, {"output_type": "stream", "name": "stdout", "text": text()},
            {"output_type": "error", "ename": "E", "traceback": ["a", "b"]}, {"data": data}, {},
        ])

    def cell():
        made = {"cell_type": rng.choice(["code", "code", "markdown", "raw", "other"]), "source": text(), "execution_count": count(), "outputs": [output() for _ in range(rng.randrange(3))]}
        for key in rng.sample(sorted(made), rng.randrange(2)):
            del made[key]
        return rng.choice([made] * 12 + [5, None, [1]])

    for _ in range(n):
        doc = {"cells": [cell() for _ in range(rng.randrange(6))], "nbformat": 4, "metadata": rng.choice([
            {"kernelspec": {"name": "python3"}, "language_info": {"name": "python", "version": "3.9", "mode": {"name": "x"}}, "widgets": {"cells": [1e5, -2.5]}}, {}, None, 3,
        ])}
        yield json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    yield from ['{"cells":null}', ' {"cells":[],"cells":null,"x":NaN,"y":[-Infinity,1e5]} ', '{"cells":3,"cells":[{"cell_type":"code","source":"a","source":"b"}]}']


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_same_as_variant(spark, chunk):
    rows = list(enumerate([*documents(3), *BROKEN]))
    texts = spark.createDataFrame(rows, "nb_id long, _text string").repartition(3)
    small, large = with_document(texts), with_document(texts, large_bytes=-1, chunk_bytes=chunk)
    both = [lambda n: notebook_metrics(n), lambda n: O.outputs_hash(n)]
    if chunk > 7:
        both += [lambda n: shred.explode_cells(n), lambda n: shred.explode_mime(shred.explode_outputs(n))]
    for read in both:
        found, expected = (sorted((tuple(map(str, r)) for r in read(n).collect())) for n in (large, small))
        assert found == expected
    assert large.where("doc is not null").count() == 0


def test_chunks_do_not_matter():
    for text in documents(5, 30):
        raw = text.encode()
        assert len({json.dumps(read_notebook(raw, n)) for n in (1, 2, 3, 64, len(raw))}) == 1
    for text in BROKEN:
        assert all(read_notebook(text.encode("utf-8", "surrogatepass"), n) is None for n in (1, 5, 1000))


def test_nothing_is_undecoded_for_its_size(spark):
    """One image beyond the 128 MiB of a VARIANT, next to a small notebook."""
    image = F.concat(F.lit('{"output_type":"display_data","data":{"image/png":"'), F.repeat(F.lit("QUJD"), 34 << 20), F.lit('"}}'))
    body = lambda outputs: F.concat(F.lit('{"metadata":{"language_info":{"name":"python"}},"cells":[{"cell_type":"code","source":"import os","execution_count":1,"outputs":['), outputs, F.lit("]}]}"))
    contents = spark.range(2).select(
        F.lit("a/b").alias("repo_full_name"), F.col("id").cast("string").alias("file_path"), F.lit("0").alias("sha"), F.lit(1).cast("long").alias("size"), F.lit("u").alias("html_url"),
        F.lit("none").alias("encoding"), F.lit(None).cast("string").alias("content"), F.when(F.col("id") == 0, body(image)).otherwise(body(F.lit("{}"))).alias("download_body"),
    )
    repos = spark.createDataFrame([], "full_name string, id long, default_branch string, created_at timestamp, stargazers_count long")
    tree = spark.createDataFrame([], "repo_full_name string, type string, path string")
    found = {r.file_path: r for r in build_collection(contents, repos, tree).collect()}
    assert [(found[k].nb_ok_parse, found[k].n_code, found[k].outputs_image, found[k].imports_total) for k in "01"] == [(True, 1, True, 1), (True, 1, False, 1)]


def test_archive_keeps_large_texts(spark):
    texts = spark.createDataFrame([("o/r", "a.ipynb", "0123456789", '{"cells": [],  "x":1}')], "repo_full_name string, file_path string, file_sha string, _text string")
    (row,) = archive_rows(with_document(texts, large_bytes=3)).collect()
    assert row.raw == '{"cells": [],  "x":1}'


def test_outputs_of_both_kinds_in_one_pass(spark):
    """A union of short and large documents would decode and read every document twice."""
    docs = [*documents(5, 150), *BROKEN]
    rows = spark.createDataFrame(list(enumerate(docs)), "nb_id int, _text string")
    listed = lambda large_bytes: shred.explode_outputs(with_document(rows, large_bytes))
    mixed, plain = listed(400), listed(1 << 25)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("ArrowEvalPython"), plan.count("Union")) == (1, 0)
    found = lambda df: sorted(map(tuple, shred.explode_mime(df).collect()))
    assert found(mixed) == found(plain) and found(plain)


def test_whole_cells_are_read_as_sign_by_sign(monkeypatch):
    docs = [d.encode() for d in [*documents(6, 200), *BROKEN]]
    whole = [read_notebook(d) for d in docs]
    used = []
    monkeypatch.setattr(large, "_whole_cell", lambda text, at: used.append(at))
    assert [read_notebook(d) for d in docs] == whole and len(used) > 50
