"""Parsing, decoding and shredding of odd documents."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from nbquarry.functions import documents as D
from nbquarry.operators import shred
from nbquarry.operators.outputs import outputs_hash
from nbquarry.plans.collect import build_collection, notebook_metrics
from nbquarry.schema import COLLECTION_FIELDS
from nbquarry.sources.archive import decode_contents

NOTEBOOK = {"cells": [], "metadata": {}}


def parsed(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", F.to_json(D.parse_json(F.col("t"))).alias("j")).orderBy("i").collect()
    return [r.j for r in rows]


def test_parse_json_takes_whole_documents_only(spark):
    texts = ['{"a":1}', '{"a":1} x', '{"a":1}}', '[1,2', "nope", "", "{'a':1}", '{"a":1,"a":2}', ' {"a": 1} \n', '{"a":1},{"b":2']
    expected = ['{"a":1}', None, None, None, None, None, None, '{"a":2}', '{"a":1}', None]
    assert parsed(spark, texts) == expected


def test_parse_json_reads_what_python_writes(spark):
    text = json.dumps({"a": [float("nan"), float("inf")], "b": "é\u2028", "c": None})
    assert json.loads(parsed(spark, [text])[0]) == {"a": ["NaN", "Infinity"], "b": "é\u2028", "c": None}


def test_parse_json_reads_long_strings(spark):
    df = spark.range(1).select(F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 25_000_000), F.lit('"}')).alias("t"))
    length = df.select(F.length(F.try_variant_get(D.parse_json(F.col("t")), "$.a", "string")).alias("n")).first().n
    assert length == 25_000_000


@pytest.mark.parametrize("source,expected", [
    ("x", "x"), (["a\n", "b"], "a\nb"), (["a", 3, "b"], "ab"), ([], ""), (None, ""), (5, ""), ({"a": 1}, ""), ([["x"], "y"], "y"),
])
def test_source_text(spark, source, expected):
    doc = json.dumps({"cells": [{"cell_type": "code", "source": source}]})
    df = spark.createDataFrame([(1, doc)], "nb_id int, t string").select("nb_id", D.parse_json(F.col("t")).alias("doc"))
    assert shred.explode_cells(df).first().source == expected


def contents(spark, bodies):
    """Rows of ``contents`` from raw bytes, or (encoding, content, body) triples."""
    rows = []
    for i, body in enumerate(bodies):
        triple = body if isinstance(body, tuple) else ("base64", base64.encodebytes(body).decode(), None)
        rows.append((i, "o/r", f"{i}.ipynb", f"sha{i}", 1, "u", *triple))
    return spark.createDataFrame(
        rows, "nb_id int, repo_full_name string, file_path string, sha string, size long, html_url string,"
        " encoding string, content string, download_body string",
    )


def test_decoding(spark):
    good = json.dumps(NOTEBOOK)
    bodies = [
        good.encode(),                                             # 0 wrapped base64
        b'{"cells": [], "x": "\xff\xfe"}',                          # 1 invalid bytes are replaced
        b"{}", b"[]", b"[1]", b'"text"', b"not json",               # 2-6 no notebook
        b'{"metadata": {}}', b'{"cells": {"a": 1}}',                # 7-8 no list of cells
        b'{"cells": null}',                                        # 9 an empty notebook
        ("none", None, good), ("none", None, None),                # 10-11 the fetched body
        ("base64", "abc", None),                                   # 12 broken padding
        ("base64", base64.b64encode(good.encode()).decode().replace("a", "a*"), None),  # 13 foreign characters
        b'{"cells": [], "metadata": null}',                        # 14
    ]
    rows = decode_contents(contents(spark, bodies)).orderBy("nb_id").select((F.col("doc").isNotNull()).alias("d")).collect()
    assert [i for i, r in enumerate(rows) if r.d] == [0, 1, 9, 10, 13, 14]


def test_collection_keeps_undecoded_rows(spark):
    python = {"metadata": {"language_info": {"name": "ipython", "version": "3.9"}, "kernelspec": {"name": "k"}}}
    cell = {"cell_type": "code", "execution_count": 2, "source": "import a.b", "outputs": [{"output_type": "stream"}]}
    bodies = [json.dumps(b).encode() for b in (
        python | {"cells": [cell]}, python | {"cells": []}, {"cells": [cell], "metadata": {}},
    )] + [b"broken"]
    repos = spark.createDataFrame([("o/r", 7, "", "2025-01-02 00:00:00", 3)],
                                  "full_name string, id long, default_branch string, created_at string, stargazers_count long")
    tree = spark.createDataFrame([("o/r", "x/dev-Requirements.TXT", "blob"), ("o/r", "Pipfile.lock", "blob")],
                                 "repo_full_name string, path string, type string")
    build = lambda **kw: {
        r.file_path: r for r in build_collection(contents(spark, bodies), repos, tree, **kw).collect()
    }
    rows = build()
    assert sorted(rows) == ["0.ipynb", "1.ipynb", "3.ipynb"]
    assert list(rows["0.ipynb"].asDict()) == COLLECTION_FIELDS
    first, broken = rows["0.ipynb"], rows["3.ipynb"]
    assert (first.n_code, first.percent_code_executed, first.top_imports_json) == (1, 100.0, '[["a", 1]]')
    assert (first.deps_requirements_txt, first.deps_pipfile, first.deps_any) == (True, False, True)
    assert (first.repo_id, first.repo_default_branch, first.repo_stars) == (7, "main", 3)
    assert not broken.nb_ok_parse
    assert all(broken[f] is None for f in COLLECTION_FIELDS[10:])
    assert sorted(build(require_outputs=True)) == ["0.ipynb", "3.ipynb"]
    assert sorted(build(only_python=False)) == ["0.ipynb", "1.ipynb", "2.ipynb", "3.ipynb"]
    assert sorted(build(limit=2)) == ["0.ipynb", "1.ipynb"]


def hashes(spark, outputs_of_notebooks):
    docs = [
        (i, json.dumps({"cells": [{"cell_type": "markdown", "outputs": [1]}, {"cell_type": "code", "outputs": o}]}))
        for i, o in enumerate(outputs_of_notebooks)
    ]
    df = spark.createDataFrame(docs, "nb_id int, t string").select("nb_id", D.parse_json(F.col("t")).alias("doc"))
    return [(r.outputs_hash, r.n_outputs) for r in outputs_hash(df).orderBy("nb_id").collect()]


def test_fingerprints(spark):
    shown = lambda data, **more: {"output_type": "display_data", "data": data, **more}
    same = [
        [shown({"text/plain": "ab", "a/b": {"x": 1, "y": [2]}})],
        [shown({"a/b": {"y": [2], "x": 1}, "text/plain": ["a", "b"]}, metadata={"m": 1}, execution_count=9)],
    ]
    different = [
        [shown({"text/plain": "ab"})],
        [shown({"text/plain": "ab", "a/b": "{\"x\":1,\"y\":[2]}"})],
        [{"output_type": "execute_result", "data": {"text/plain": "ab", "a/b": {"x": 1, "y": [2]}}}],
        [{"output_type": "stream", "name": "stdout", "text": "ab"}],
        [{"output_type": "stream", "name": "stderr", "text": "ab"}],
        [{"output_type": "error", "ename": "E", "evalue": "v", "traceback": ["a", "b"]}],
        [{"output_type": "error", "ename": "E", "evalue": "v", "traceback": ["a", "c"]}],
        [{"output_type": "other", "data": {"k": 1}}],
        [shown({"text/plain": "b"}), shown({"text/plain": "a"})],
        [shown({"text/plain": "a"}), shown({"text/plain": "b"})],
        [shown({"n": 1})], [shown({"n": "1"})], [shown({})], [],
    ]
    result = hashes(spark, same + different)
    assert result[0] == result[1]
    assert len({h for h, _ in result}) == 1 + len(different)
    assert [n for _, n in result] == [len(o) for o in same + different]
    assert hashes(spark, [["not an object"], [shown({}), 3]]) == [("", 0), ("", 0)]


def test_joined_lists_equal_their_text(spark):
    a, b = hashes(spark, [
        [{"output_type": "stream", "name": "s", "text": ["x\n", "y"]}], [{"output_type": "stream", "name": "s", "text": "x\ny"}],
    ])
    assert a == b


def test_import_pairs(spark):
    texts = ['[["a", 1], ["b", 2]]', "nope", "{}", '[["a",1],"zz",["b",2]]', "[]", None, '[["a", "3"]]', '[["a", 2.9], ["b"]]', '[[1, 2]]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, top_imports_json string")
    rows = [tuple(r) for r in shred.explode_import_counts(df).orderBy("row_id", "pos").collect()]
    assert rows == [(0, 0, "a", 1), (0, 1, "b", 2), (3, 0, "a", 1), (6, 0, "a", 3), (7, 0, "a", 2)]


def test_metrics_are_null_without_document(spark):
    df = spark.createDataFrame([(1, "broken")], "nb_id int, t string").select("nb_id", D.parse_json(F.col("t")).alias("doc"))
    row = notebook_metrics(df).first().asDict()
    assert row.pop("nb_id") == 1
    assert set(row.values()) == {None}
