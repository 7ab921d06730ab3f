"""The archive as named files: packing, pushed conditions, writing and reading back."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from nbquarry.sources import archive, archive_files as A


def notebooks(spark, rows):
    texts = spark.createDataFrame(rows, "repo_full_name string, file_path string, file_sha string, _text string").repartition(3)
    return archive.with_document(texts)


ROWS = [(f"o{i % 3}/r{i % 2}", f"d/n{i}.ipynb", f"{i:08}ff", json.dumps({"cells": [{"cell_type": "code", "source": f"é{i}"}] * i})) for i in range(12)]


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "files")
    archive.write_archive_files(notebooks(spark, [*ROWS, ("o/r", "broken.ipynb", "0", "{")]), path)
    return path


def light(df):
    return sorted((r.owner, r.repo, r.archive_name, r.n) for r in df.select("owner", "repo", "archive_name", F.size(F.try_variant_get("doc", "$.cells", "array<variant>")).alias("n")).collect())


def test_written_files_are_read_back(spark, base):
    names = sorted(str(p.relative_to(base)) for p in Path(base).rglob("*") if p.is_file())
    assert names == sorted(["_SUCCESS", *[f"o{i % 3}/r{i % 2}/{i:08}_n{i}.ipynb" for i in range(12)]])
    assert json.loads(Path(base, "_SUCCESS").read_text())["files"] == 12
    expected = [(f"o{i % 3}", f"r{i % 2}", f"{i:08}_n{i}.ipynb", i) for i in range(12)]
    assert light(archive.read_notebook_archive(spark, base)) == light(archive.read_notebook_archive(spark, base, hadoop=True)) == sorted(expected)


def test_appending_and_overwriting(spark, tmp_path):
    path = str(tmp_path / "files")
    archive.write_archive_files(notebooks(spark, ROWS[:4]), path)
    archive.write_archive_files(notebooks(spark, ROWS[3:6]), path, mode="append")
    assert len(light(archive.read_notebook_archive(spark, path))) == 6
    archive.write_archive_files(notebooks(spark, ROWS[:2]), path)
    assert len(light(archive.read_notebook_archive(spark, path))) == 2


def test_conditions_decide_which_folders_are_listed(spark, base):
    reader = A.ArchiveReader(base, A.PARTITION_BYTES)
    rest = GreaterThan(("owner",), "a")
    assert list(reader.pushFilters([EqualTo(("owner",), "o1"), In(("repo",), ("r0", "r7")), rest])) == [rest]
    (partition,) = reader.partitions()
    assert {p.split("/")[-3] + p.split("/")[-2] for p in partition.paths} == {"o1r0"}
    found = archive.read_notebook_archive(spark, base).where("owner = 'o1' and repo in ('r0', 'r7')")
    assert light(found) == [("o1", "r0", "00000004_n4.ipynb", 4), ("o1", "r0", "00000010_n10.ipynb", 10)]
    assert light(archive.read_notebook_archive(spark, base).where("owner = 'nobody'")) == []


def test_files_are_packed_by_bytes():
    one = A.OPEN_BYTES
    files = [("a", 0), ("b", one), ("c", 9 * one), ("d", 0), ("e", 0), ("f", 0)]
    assert A.pack(files, 3 * one) == [["a", "b"], ["c"], ["d", "e", "f"]]
    assert A.pack(files[3:], 100 * one, most_files=2) == [["d", "e"], ["f"]]
    assert A.pack([], one) == []


def test_partitions_follow_the_option(spark, base):
    read = lambda size: spark.read.format(A.NAME).option("partitionBytes", size).load(base)
    archive.read_notebook_archive(spark, base)
    assert read(1).rdd.getNumPartitions() == 12 and read(A.PARTITION_BYTES).rdd.getNumPartitions() == 1


def test_large_files_are_streamed(spark, base):
    found = archive.read_notebook_archive(spark, base, large_bytes=100)
    assert found.where("doc is null and large is not null").count() > 0
    assert sorted(found.select(F.coalesce(F.size("large.cells"), F.size(F.try_variant_get("doc", "$.cells", "array<variant>")))).toPandas().iloc[:, 0]) == list(range(12))
