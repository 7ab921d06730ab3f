"""What must hold for plans at scale, whatever the data."""

import os
import re
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import DataFrameWriter, functions as F

import __spark_entry__ as entry
from nbquarry.operators import code as G, outputs as O
from nbquarry.plans.collect import build_collection, collect_and_archive, notebook_metrics
from nbquarry.sources import bucketed
from nbquarry.sources.archive import decode_contents
from registry import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def contents(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("contents"))
    X.contents(spark, SF).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_documents_are_never_shuffled(contents):
    for df in (notebook_metrics(decode_contents(contents)), O.outputs_hash(decode_contents(contents))):
        assert "Exchange" not in plan(df)


def test_documents_are_parsed_once(spark, contents):
    text = plan(build_collection(contents, X.repos(spark, SF), X.view(spark, SF, "fx_tree"), require_outputs=True))
    assert text.count("from_json") == 1
    # the rows that the filters drop never reach the Python worker
    assert text.index("ArrowEvalPython") < text.index("Filter (isnull(size(cells")


def test_archive_picks_documents_where_they_lie(spark, contents, tmp_path):
    work = str(tmp_path / "measured")
    collection, archived = collect_and_archive(contents, X.repos(spark, SF), X.view(spark, SF, "fx_tree"), work)
    for line in plan(archived).splitlines():
        assert not ("Exchange" in line and "raw" in line)
    assert "archived" not in re.findall(r"ReadSchema: (\S+)", plan(collection))[0]
    names = {r.archive_name for r in archived.collect()}
    assert len(names) == collection.where("nb_ok_parse").count() > 0
    assert "from_json" not in plan(archived)


def test_only_needed_columns_are_read(contents):
    schema = re.search(r"ReadSchema: (\S+)", plan(notebook_metrics(decode_contents(contents)))).group(1)
    assert "html_url" not in schema and "content" in schema


def test_date_filter_reaches_the_scan(spark):
    assert "GreaterThanOrEqual(o_orderdate" in plan(entry.queries()["filter_created_between"](spark, SF))


def test_date_filter_skips_folders(spark):
    text = plan(entry.queries()["filter_created_between_stored_by_date"](spark, SF))
    assert re.search(r"PartitionFilters: \[[^]]*created_date", text)


def test_windows_skip_folders_by_what_they_turn_out_to_hold(spark):
    df = entry.queries()["windows_of_days_stored_by_date"](spark, SF)
    text = plan(df)
    assert re.search(r"PartitionFilters: \[[^]]*dynamicpruning", text)
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().finalPhysicalPlan().collectLeaves()
    folders = [leaves.apply(i).metrics().apply("numPartitions").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numPartitions")]
    assert folders and all(0 < n <= 21 for n in folders)


@pytest.mark.parametrize("name", ["window_quota", "newest_per_range", "ranked_imports", "skips_middle"])
def test_rank_limits_apply_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["top_errors", "failures_by_repo", "failures_by_notebook", "limit_items", "divergence_examples"])
def test_top_lists_do_not_sort_everything(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["attach_dependencies", "match_originals", "run_table", "errors_by_notebook_traits",
                                  "assign_windows", "newest_per_range", "adaptive_date_ranges", "elapsed_profile"])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name,scans", [("elapsed_profile", 1), ("adaptive_date_ranges", 1)])
def test_inputs_are_scanned_no_more_than_needed(spark, name, scans):
    df = entry.queries()[name](spark, SF)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("FileScan") <= scans and "ReusedExchange" in final


def test_report_reads_its_inputs_three_times_at_most(spark, monkeypatch):
    """Once each for the facts, which are stored, and the runs again for examples."""
    read, written = [], []
    before = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: written.append(plan(self._df)) or before(self, path, *a, **k))
    df = entry.queries()["corpus_report"](spark, SF)
    df.collect()
    read = [line for text in [plan(df).split("Initial Plan")[0], *written] for line in text.splitlines() if "FileScan" in line]
    assert sum("testdata" in line for line in read) <= 3 and len(written) == 2


def test_joins_do_not_depend_on_broadcasting(spark):
    """With automatic broadcasts off, only the bounded lists of heavy buckets are broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry.queries()["attach_dependencies"](spark, SF))
        assert "SortMergeJoin" in text
        for exchange in text.split("BroadcastExchange")[1:]:
            assert "_bucket" in exchange[:600] and "HashAggregate(keys=[_bucket" in exchange[:900]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_stored_by_notebook_join_without_a_shuffle(spark, tmp_path):
    name, path = f"t{abs(hash(str(tmp_path))) % 10**8}", str(tmp_path)
    runs = spark.range(600).select("id", F.lit("o/r").alias("repo_full_name"), F.when(F.col("id") < 300, F.lit("hot")).otherwise(F.concat(F.lit("n"), (F.col("id") % 40).cast("string"))).alias("file_path"))
    notebooks = spark.createDataFrame([("o/r", "hot", 1), ("o/r", "n3", 2), ("o/q", "n4", 3)], "repo_full_name string, file_path string, v int")
    bucketed.write_bucketed(runs, name, f"{path}/a", 4, part_rows=100)
    bucketed.write_bucketed(notebooks, f"{name}_right", f"{path}/b", 4, part_rows=None)
    assert spark.table(f"{name}_hot").count() == 300
    text = plan(spark.table(name).join(spark.table(f"{name}_right").hint("merge"), bucketed.NOTEBOOK, "left"))
    assert "SortMergeJoin" in text and "Exchange" not in text
    found = bucketed.join_bucketed(spark, name, f"{name}_right", ["id"], part_rows=100)
    assert {r.v: r["count"] for r in found.groupBy("v").count().collect()} == {1: 300, 2: 7, None: 293}
    for table in (name, f"{name}_hot", f"{name}_right"):
        spark.sql(f"drop table {table}")


def test_features_run_without_this_package_on_workers(spark, tmp_path):
    """The function travels by value: a process that cannot import the package can run it."""
    (tmp_path / "f.pickle").write_bytes(cloudpickle.dumps(G._features_function().func))
    script = (
        "import importlib.util, pickle, pyarrow as pa; assert importlib.util.find_spec('nbquarry') is None;"
        " f = pickle.load(open('f.pickle', 'rb')); print(f(pa.array([['import a.b', 'x = (']])).to_pylist()[0]['modules'])"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "['a']", done.stderr
