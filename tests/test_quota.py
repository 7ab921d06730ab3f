"""Quotas across runs: files in any order and number of runs give what one batch gives."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from nbquarry.operators.filters import project_fields
from nbquarry.operators.sampling import CalendarWindow, window_quota
from nbquarry.sources.tables import write_collection
from nbquarry.streaming.quota import incremental_quota, within_quota

WINDOWS = [CalendarWindow(1, dt.date(2025, 1, 1), dt.date(2025, 1, 7), 3), CalendarWindow(2, dt.date(2025, 1, 8), dt.date(2025, 1, 14), 5),
           CalendarWindow(3, dt.date(2025, 1, 15), dt.date(2025, 1, 21), 4)]


def collection(spark, n, seed):
    rng = random.Random(seed)
    rows = [(f"o/r{i % 11}", rng.choice([None, i % 5]), f"n{i}.ipynb", dt.datetime(2025, 1, 1 + min(rng.randrange(16), rng.randrange(30)), 12), f"line\n{i}") for i in range(n)]
    return project_fields(spark.createDataFrame(rows, "repo_full_name string, repo_id long, file_path string, repo_created_at timestamp, kernel_name string"))


@pytest.mark.parametrize("runs", [[[0, 1, 2, 3]], [[3], [], [1, 0], [2]]])
def test_any_number_of_runs_gives_the_batch_result(spark, tmp_path, runs):
    rows = collection(spark, 120, 1).withColumn("part", F.pmod(F.xxhash64("file_path"), F.lit(4)))
    for part in range(4):
        write_collection(rows.where(F.col("part") == part).drop("part").coalesce(1), str(tmp_path / f"made{part}"), "csv")
    (tmp_path / "in").mkdir()
    found = lambda: spark.read.parquet(str(tmp_path / "out"))
    for number, run in enumerate(runs):
        for part in run:
            for file in (tmp_path / f"made{part}").glob("*.csv"):
                shutil.copy(file, tmp_path / "in" / f"{number}-{part}-{file.name}")
        incremental_quota(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), WINDOWS).awaitTermination()
    key = ["window_id", "quota_rank", "repo_full_name", "file_path", "repo_id", "repo_created_at", "kernel_name"]
    expected = window_quota(rows, WINDOWS, F.col("repo_created_at"), [F.desc("repo_created_at"), "repo_id", "repo_full_name", "file_path"])
    assert sorted(map(str, found().select(*key).collect())) == sorted(map(str, expected.select(*key).collect()))
    # The same files again under other names change nothing.
    for file in list((tmp_path / "in").glob("*.csv")):
        shutil.copy(file, tmp_path / "in" / f"again-{file.name}")
    incremental_quota(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), WINDOWS).awaitTermination()
    assert sorted(map(str, found().select(*key).collect())) == sorted(map(str, expected.select(*key).collect()))


def test_first_rows_of_a_long_stream():
    rng = random.Random(2)
    rows = [(rng.randrange(50), rng.choice([None, 1, 2]), f"r{i % 300}", "p", str(i)) for i in range(5000)]
    key = lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2], int(r[4]))
    first = {}
    for r in rows:
        old = first.get(r[2])
        first[r[2]] = r if old is None or (-r[0], r[1] is not None, r[1] or 0, r[4]) < (-old[0], old[1] is not None, old[1] or 0, old[4]) else old
    expected = sorted(first.values(), key=lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2]))[:7]
    assert within_quota(iter(rows), 7) == expected
