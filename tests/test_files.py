"""CSV, archive and streams."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from nbquarry.operators.filters import filter_parsed_strict, project_fields
from nbquarry.schema import COLLECTION_FIELDS, COLLECTION_SCHEMA, RUN_FIELDS
from nbquarry.session import configure, scratch_path
from nbquarry.sources import archive, tables
from nbquarry.streaming.windows import incremental_windows

# A row in the interchange format: doubled quotes, a comma in a field, empty metrics.
VALUES = {f: "" for f in COLLECTION_FIELDS} | {
    "repo_full_name": "o/r", "repo_id": "5", "repo_created_at": "2025-05-10T12:00:00Z", "file_path": 'a "b",c\nd.ipynb',
    "nb_ok_parse": "True", "n_code": "12", "percent_code_executed": "83.33", "out_of_order": "False",
    "top_imports_json": '[["numpy", 3], ["pandas", 2]]',
}


def csv_line(values):
    return ",".join('"' + v.replace('"', '""') + '"' if set(v) & set('",\n') else v for v in values) + "\n"


def write_window(path, *rows):
    path.write_text(csv_line(COLLECTION_FIELDS) + "".join(csv_line(r.values()) for r in rows))


def test_read_collection(spark, tmp_path):
    write_window(tmp_path / "w.csv", VALUES, VALUES | {"file_path": "second", "nb_ok_parse": "False"})
    df = tables.read_collection(spark, str(tmp_path / "w.csv"), row_order=True)
    first, second = df.orderBy("row_order").collect()
    assert df.columns == [*COLLECTION_FIELDS, "row_order"]
    assert (first.file_path, first.n_code, first.percent_code_executed) == ('a "b",c\nd.ipynb', 12, 83.33)
    assert (first.top_imports_json, first.out_of_order, first.deps_any, first.language) == (VALUES["top_imports_json"], False, None, None)
    assert first.repo_created_at.isoformat() == "2025-05-10T12:00:00"
    assert (second.file_path, second.nb_ok_parse) == ("second", False)


def test_collection_round_trip(spark, tmp_path):
    write_window(tmp_path / "w.csv", VALUES)
    df = tables.read_collection(spark, str(tmp_path / "w.csv"))
    tables.write_collection(df, str(tmp_path / "csv"), "csv")
    tables.write_collection(df, str(tmp_path / "parquet"))
    assert tables.read_collection(spark, str(tmp_path / "csv")).collect() == df.collect()
    assert spark.read.parquet(str(tmp_path / "parquet")).collect() == df.collect()
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text.startswith(",".join(COLLECTION_FIELDS)) and '""numpy""' in text and "2025-05-10T12:00:00Z" in text


def test_runs_round_trip(spark, tmp_path):
    runs = spark.range(2).select(
        *[F.lit(None).cast("string").alias(f) for f in RUN_FIELDS if f not in ("exec_ok", "outputs_equal", "elapsed_s")],
        (F.col("id") == 0).alias("exec_ok"), F.when(F.col("id") == 0, F.lit(True)).alias("outputs_equal"), F.lit(1.5).alias("elapsed_s"),
    )
    tables.write_runs(runs, str(tmp_path / "runs"), "csv")
    back = tables.read_runs(spark, str(tmp_path / "runs"))
    assert back.columns == RUN_FIELDS
    assert sorted(tuple(r) for r in back.select("exec_ok", "outputs_equal", "elapsed_s").na.fill(False).collect()) == [(False, False, 1.5), (True, True, 1.5)]


def test_archive_files(spark, tmp_path):
    folder = tmp_path / "own" / "repo"
    folder.mkdir(parents=True)
    (folder / "deadbeef_a_b.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code"}]}))
    (folder / "noSHA_broken.ipynb").write_bytes(b"\xff{")
    (folder / "ignored.txt").write_text("{}")
    rows = archive.read_notebook_archive(spark, str(tmp_path)).orderBy("archive_name").collect()
    assert [(r.owner, r.repo, r.archive_name, r.doc is not None) for r in rows] == [
        ("own", "repo", "deadbeef_a_b.ipynb", True), ("own", "repo", "noSHA_broken.ipynb", False),
    ]


def test_windows_are_appended_once(spark, tmp_path):
    source, target, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    run = lambda: incremental_windows(spark, str(source), target, progress).awaitTermination()
    write_window(source / "w1.csv", VALUES)
    run()
    run()
    write_window(source / "w2.csv", VALUES, VALUES)
    run()
    rows = spark.read.parquet(target)
    assert sorted(r.n for r in rows.groupBy("window_file").agg(F.count("*").alias("n")).collect()) == [1, 2]
    assert tables.consolidate_windows(spark, str(source)).count() == 3


def test_project_fields_fills_and_orders(spark):
    df = project_fields(spark.createDataFrame([("x", 1)], "file_path string, n_code int"))
    assert df.columns == COLLECTION_FIELDS
    row = df.first()
    assert (row.file_path, row.n_code, row.language) == ("x", 1, None)


def test_typed_tables_lose_nothing_that_summaries_count(spark):
    text = spark.createDataFrame([("n/a", "true"), ("4", "True"), ("", "False")], "n_code string, nb_ok_parse string")
    text = text.select(*[F.col(c) if c in text.columns else F.lit(None).cast("string").alias(c) for c in COLLECTION_SCHEMA.fieldNames()])
    typed = tables.type_columns(text, COLLECTION_SCHEMA, keep_spelling=True)
    assert [r.n_code for r in typed.collect()] == [0, 4, None]
    assert filter_parsed_strict(typed).count() == filter_parsed_strict(text).count() == 1


def test_times_are_written_in_utc(spark, tmp_path):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp'2025-01-01T12:00:00Z' as repo_created_at")
        df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in COLLECTION_SCHEMA.fields])
        tables.write_collection(df, str(tmp_path / "c"), "csv")
        assert tables.read_text_table(spark, str(tmp_path / "c"), COLLECTION_SCHEMA).first().repo_created_at == "2025-01-01T12:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_files_that_are_no_notebooks_are_not_readable(spark, tmp_path):
    folder = tmp_path / "o" / "r"
    folder.mkdir(parents=True)
    for name, body in (("a", "{}"), ("b", '"t"'), ("c", '{"cells": []}'), ("d", "not json")):
        (folder / f"00000000_{name}.ipynb").write_text(body)
    found = archive.read_notebook_archive(spark, str(tmp_path)).collect()
    assert sorted(r.archive_name[9] for r in found if r.doc is not None) == ["c"] and len(found) == 4


def test_scratch_needs_a_shared_folder():
    unset = SimpleNamespace(conf={})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(unset, "x")
    assert scratch_path(unset, "x", "/shared").startswith("/shared/nbquarry/x-")


def test_integers_are_told_by_their_text(spark):
    """Casts that fail raise and catch an error for each row, so only text that spells an integer is cast."""
    spelled = {"12": 12, " 12 ": 12, "12.0": 12, "1_000": 1000, "n/a": 0, "": None, "9007199254740993": 9007199254740993, "\x01+7\x7f": 7, "9" * 20: 0, "-": 0, "12.": 12}
    text = spark.createDataFrame([(t,) for t in spelled], "n_code string")
    typed = tables.type_columns(text, COLLECTION_SCHEMA)
    assert [r.n_code for r in typed.collect()] == list(spelled.values())
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2
    flags = spark.createDataFrame([(t,) for t in ("True", "False", " YES ", "true", "0", "")], "deps_any string")
    assert [r.deps_any for r in tables.type_columns(flags, COLLECTION_SCHEMA).collect()] == [True, False, True, True, False, None]


def test_wide_projections_are_compiled(spark):
    """The JVM leaves methods above 8,000 bytes uncompiled."""
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
