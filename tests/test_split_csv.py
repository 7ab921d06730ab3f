"""CSV files read by several tasks against the same files read by one."""

import csv
import random

import numpy as np
import pyarrow as pa
import pytest

from nbquarry.schema import RUN_SCHEMA, as_text_schema
from nbquarry.sources import split_csv, tables


def write(path, seed, records, end="\n", long_field=0):
    rng = random.Random(seed)
    value = lambda: rng.choice(["", "plain", 'say "hi"', "a\nb", "\n", "x,y", '"', '""\n"', "é\r\nz", " pad ", "tail\r", ",", "a" * rng.randrange(60)])
    names = RUN_SCHEMA.fieldNames()
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(names)
        for i in range(records):
            row = [str(i), *[value() for _ in names[1:]]]
            if long_field and i == records // 2:
                row[3] = "\nlong \"field\"," * long_field
            writer.writerow(row)


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, end, long_field", [(1, "\n", 0), (2, "\r\n", 0), (3, "\n", 900)])
def test_same_as_one_task_per_file(spark, small_splits, tmp_path, seed, end, long_field):
    for n, records in enumerate([300, 0, 1, 40]):
        write(tmp_path / f"f{n}.csv", seed + n, records, end, long_field)
    rows = lambda split: [tuple(r) for r in tables.read_text_table(spark, str(tmp_path), RUN_SCHEMA, row_order=True, split=split).orderBy("row_order").drop("row_order").collect()]
    work = str(tmp_path / "work")
    split_csv.csv_records(spark, str(tmp_path / "f0.csv"), work)
    starts = spark.read.parquet(work).select("start").distinct().count()
    assert starts > 5 and rows(True) == [tuple(v or None for v in r) for n in range(4) for r in csv.reader(open(tmp_path / f"f{n}.csv", newline="", encoding="utf-8")) if r[0] != "repo_full_name"]
    if end == "\r\n":  # one task would turn line breaks inside fields into plain ones
        return
    assert rows(True) == rows(False) and len(rows(True)) == 341
    typed = lambda split: sorted(map(str, tables.read_runs(spark, str(tmp_path / "*.csv"), split=split).collect()))
    assert typed(True) == typed(False)


def test_marks_do_not_depend_on_batches():
    rng = np.random.default_rng(1)
    lines = ["".join(rng.choice(list('a",')) for _ in range(rng.integers(0, 6))) for _ in range(200)]
    table = pa.table({"line": lines, "file": ["f"] * 120 + ["g"] * 80, "start": [0] * 50 + [64] * 70 + [0] * 80})
    read = lambda size: pa.Table.from_batches(split_csv.mark_lines(iter(table.to_batches(max_chunksize=size)))).to_pylist()
    assert read(1) == read(7) == read(1000)
    inside = False
    for row in [r for r in read(33) if r["file"] == "f" and r["start"] == 0]:
        assert row["odd"] == inside
        inside ^= row["quotes"] % 2 == 1


def test_column_names_come_from_the_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n"x\ny",\n\n"",2\n')
    schema = as_text_schema(RUN_SCHEMA)
    schema = type(schema)(schema.fields[:2])
    found = split_csv.read_csv_in_splits(spark, str(tmp_path / "a.csv"), schema, {"escape": '"', "multiLine": True, "header": True}, str(tmp_path / "w"))
    whole = tables.read_text_table(spark, str(tmp_path / "a.csv"), schema, row_order=True)
    assert [tuple(r)[:2] for r in found.orderBy("row_order").collect()] == [tuple(r)[:2] for r in whole.orderBy("row_order").collect()]
