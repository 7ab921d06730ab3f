"""Matching originals, logs, statistics on small and skewed input."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from nbquarry.operators import joins, matching, profile, runs as R, summary as S
from nbquarry.plans.report import corpus_report
from nbquarry.plans.run_table import runs_by_kernel


def test_smallest_name_with_the_suffix_wins(spark):
    names = ["ffff_a.ipynb", "dead_a.ipynb", "beef_x_a.ipynb", "aaaa_ba.ipynb", "plain.ipynb"]
    originals = spark.createDataFrame([("o", "r", n) for n in names], "owner string, repo string, archive_name string")
    runs = spark.createDataFrame(
        [(1, "o/r", "nb/a.ipynb"), (2, "o/r", "x_a.ipynb"), (3, "o/q", "a.ipynb"), (4, "o/r", "d/plain.ipynb"), (5, None, "a.ipynb")],
        "row_id int, repo_full_name string, file_path string",
    )
    got = {r.row_id: r.archive_name for r in matching.match_originals(runs, originals, [], ["row_id"]).collect()}
    assert got == {1: "beef_x_a.ipynb", 2: "beef_x_a.ipynb", 3: None, 4: None, 5: None}


def test_names_are_sanitized_on_both_sides(spark):
    originals = spark.createDataFrame([("o_", "r", "aa_a_b_1_.ipynb")], "owner string, repo string, archive_name string")
    runs = spark.createDataFrame([(1, "o!/r", "x/a b[1].ipynb")], "row_id int, repo_full_name string, file_path string")
    assert matching.match_originals(runs, originals, [], ["row_id"]).first().archive_name == "aa_a_b_1_.ipynb"


@pytest.mark.parametrize("part_rows", [1, 40, joins.PART_ROWS])
def test_matching_against_brute_force_with_a_hot_repository(spark, part_rows):
    rng = random.Random(3)
    repo = lambda: rng.choice(["o/hot"] * 5 + ["o/a", "o/b", "p/hot"])
    name = lambda: "_".join(rng.choice(["x", "y", "z"]) for _ in range(rng.randint(1, 3))) + ".ipynb"
    originals = [(*repo().split("/"), f"{rng.randint(0, 30):04}_{name()}") for _ in range(150)]
    runs = [(i, repo(), f"d/{name()}") for i in range(400)]
    odf = spark.createDataFrame(originals, "owner string, repo string, archive_name string").repartition(4)
    rdf = spark.createDataFrame(runs, "row_id int, repo_full_name string, file_path string").repartition(4)
    got = {r.row_id: r.archive_name for r in matching.match_originals(rdf, odf, [], ["row_id"], part_rows=part_rows).collect()}
    assert len(got) == len(runs)
    for row_id, full, path in runs:
        fits = [n for o, r, n in originals if f"{o}/{r}" == full and n.endswith("_" + path.split("/")[-1])]
        assert got[row_id] == min(fits, default=None)


@pytest.mark.parametrize("part_rows", [1, 500, joins.PART_ROWS])
def test_left_join_keeps_every_row_when_keys_are_hot(spark, part_rows):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None))
                                    .otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("unused", 3), (None, 4)], "k string, v int")
    joined = joins.left_join_unique(left, right, ["k"], ["id"], part_rows=part_rows)
    counts = {r.v: r["count"] for r in joined.groupBy("v").count().collect()}
    assert sum(counts.values()) == 5000
    assert counts == {1: 1667, 2: 1, None: 5000 - 1668}
    assert joins.left_join_unique(left, right, ["k"], ["id"], how="inner", part_rows=part_rows).count() == 1668


def test_heavy_buckets_hold_the_hot_key(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    assert [r._parts for r in joins.heavy_buckets(hot, ["k"], part_rows=1000).collect()] == [10]
    assert joins.heavy_buckets(hot, ["k"]).count() == 0


def test_no_part_of_a_key_with_half_of_all_rows_is_large(spark):
    left = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    heavy = joins.heavy_buckets(left, ["k"], part_rows=500)
    parts = joins.spread_left(left, heavy, ["k"], ["id"]).where("k = -1").groupBy("_part").count().collect()
    assert len(parts) == 40 and sum(r["count"] for r in parts) == 20_000 and max(r["count"] for r in parts) < 600


def test_hot_keys_are_spread_over_parts(spark):
    left = spark.range(30_000).select("id", F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.left_join_unique(left, right, ["k"], ["id"], part_rows=1000)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("v").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 30_000 and len(sizes) > 1 and max(sizes) < 20_000


def test_traits_count_like_a_row_by_row_join(spark):
    rng = random.Random(9)
    runs = [("r", f"f{rng.randint(0, 3)}", rng.choice(["E", None])) for _ in range(60)]
    listed = [("r", f"f{rng.randint(0, 2)}", rng.random() < 0.5, True, None) for _ in range(20)]
    rdf = spark.createDataFrame(runs, "repo_full_name string, file_path string, error string")
    cdf = spark.createDataFrame(listed, "repo_full_name string, file_path string, deps_any boolean, out_of_order boolean, has_abs_data_path boolean")
    got = {tuple(r)[:4]: r.n for r in matching.errors_by_notebook_traits(rdf, cdf).collect()}
    expected = {}
    for repo, file, error in runs:
        for traits in [c[2:] for c in listed if c[:2] == (repo, file)] or [(None, None, None)]:
            expected[(error, *traits)] = expected.get((error, *traits), 0) + 1
    assert got == expected


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0, -5.0, 0.0, 1e-300, 1e300], [2.0] * 99 + [7.0], [float("inf"), 1.0, 2.0], [8.0, 7.999999999, 8.000000001],
    [-1.5, -1.25, -1000.0, -0.0],
])
def test_median_and_mean(spark, values):
    df = spark.createDataFrame([("m", v) for v in values] + [("m", None)], "metric string, value double").repartition(3)
    row = profile.median_and_mean(df).first()
    assert row.n == len(values)
    assert row.median == statistics.median(values)
    assert row["mean"] == pytest.approx(statistics.fmean(values), rel=1e-12)


def test_random_medians(spark):
    rng = random.Random(1)
    data = {f"m{k}": [rng.choice([rng.gauss(0, 10 ** rng.randint(-3, 6)), 42.0]) for _ in range(rng.randint(1, 300))] for k in range(12)}
    df = spark.createDataFrame([(m, v) for m, vs in data.items() for v in vs], "metric string, value double").repartition(4)
    got = {r.metric: (r.n, r.median) for r in profile.median_and_mean(df).collect()}
    assert got == {m: (len(v), statistics.median(v)) for m, v in data.items()}


def log(returncode=0, timed_out=False, launch_error=None, stdout="", stderr="", elapsed_s=1.23456):
    return (returncode, timed_out, launch_error, stdout, stderr, elapsed_s)


def test_outcomes(spark):
    ok = 'NBEXEC_RESULT:{"ok": true, "outputs_hash": "h", "n_outputs": 2}'
    logs = [
        log(stdout=ok), log(stdout="x\r\n" + ok + "\r\n"), log(returncode=1, stdout=ok), log(stdout=""), log(returncode=2),
        log(stdout='NBEXEC_RESULT:{"ok": 1}'), log(stdout="NBEXEC_RESULT:{bad\n" + ok), log(stdout=" " + ok),
        log(timed_out=True, stdout=ok), log(launch_error="OSError"),
        log(returncode=1, stdout='NBEXEC_RESULT:{"ok": false, "error": "KeyError"}', stderr="e" * 3000),
    ]
    df = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(logs)],
        "i int, returncode int, timed_out boolean, launch_error string, stdout string, stderr string, elapsed_s double",
    )
    rows = R.normalize_outcome(R.parse_run_log(df)).orderBy("i").collect()
    assert [(r.exec_ok, r.error) for r in rows] == [
        (True, None), (True, None), (False, "SubprocessError"), (False, "UnknownError"), (False, "SubprocessError"),
        (False, "UnknownError"), (False, "UnknownError"), (False, "UnknownError"),
        (False, "TimeoutExpired"), (False, "OSError"), (False, "KeyError"),
    ]
    assert (rows[0].outputs_hash_exec, rows[0].n_outputs_exec, rows[0].elapsed_s) == ("h", 2, 1.235)
    assert (rows[8].outputs_hash_exec, rows[8].stderr_tail, len(rows[10].stderr_tail)) == ("", None, 2000)


def test_error_classes(spark):
    cases = [
        ("ModuleNotFoundError", "No module named 'a.b' and No module named 'c'", ("a.b", False, False)),
        ("E", "HTTP 401", (None, True, False)), ("AuthenticationError", None, (None, True, False)),
        ("E", "INVALID_API_KEY", (None, True, False)), ("FileNotFoundError", "", (None, False, True)),
        ("E", "model not found", (None, False, True)), (None, "No such file or directory: 401", (None, True, True)),
        ("E", "", (None, False, False)),
    ]
    df = spark.createDataFrame([(i, n, m) for i, (n, m, _) in enumerate(cases)], "i int, error string, exc_msg string")
    rows = R.classify_errors(df).orderBy("i").collect()
    assert [(r.missing_module, r.auth_error, r.file_missing) for r in rows] == [c[2] for c in cases]


def test_report_follows_the_input_columns(spark):
    collection = spark.createDataFrame(
        [(1, "True", "python", "", "True", "3", "1", "50.0", '[["a", 1]]')],
        "row_id int, nb_ok_parse string, language string, deps_any string, has_unambiguous_order string, n_code string,"
        " n_markdown string, percent_code_executed string, top_imports_json string",
    )
    runs = spark.createDataFrame([(1, "o/r", "f", "False", "", "2.5")],
                                 "row_id int, repo_full_name string, file_path string, exec_ok string, error string, elapsed_s string")
    sections = lambda *a: {r.section for r in corpus_report(*a).select("section").distinct().collect()}
    assert sections(collection) == {"collection"}
    assert sections(collection, runs) == {"collection", "runs"}
    rows = {(r.metric, r.dim): (r.n, r.value) for r in corpus_report(collection, runs).collect()}
    assert rows[("top_errors", "None")] == (1, None)
    assert rows[("failures_by_notebook", "o/r/f")] == (1, None)
    assert rows[("elapsed_failed", "median")] == (1, 2.5)
    assert ("elapsed_ok", "median") not in rows
    assert rows[("top_imports", "a")] == (1, None)


def test_no_denominator_no_kpi(spark):
    runs = spark.createDataFrame([("False", "", "True", "", "", "", "")],
                                 "original_found string, outputs_equal string, exec_ok string, outputs_hash_orig string,"
                                 " outputs_hash_exec string, n_outputs_orig string, n_outputs_exec string")
    assert S.reproducibility_kpis(runs).count() == 0
    assert S.originals_found_rate(runs).first().pct == 0.0


@pytest.mark.parametrize("part_rows", [1, 20, joins.PART_ROWS])
def test_runs_next_to_their_listings(spark, part_rows):
    runs = [(i, "o/hot" if i % 3 else f"o/{i}", "a") for i in range(90)] + [(100, None, "a")]
    listed = [("o/hot", "a", 1), ("o/hot", "a", 2), ("o/3", "a", 3), ("o/hot", "b", 4), (None, "a", 5)]
    rdf = spark.createDataFrame(runs, "row_id int, repo_full_name string, file_path string").repartition(3)
    cdf = spark.createDataFrame(listed, "repo_full_name string, file_path string, listing int")
    found = matching.runs_with_collection(rdf, cdf, ["listing"], ["row_id"], part_rows=part_rows)
    expected = [(i, x) for i, r, p in runs for x in [n for a, b, n in listed if r is not None and (a, b) == (r, p)] or [None]]
    assert sorted(((r.row_id, r.listing) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_cube_tells_subtotals_from_missing_values(spark):
    runs = spark.createDataFrame([("r", "a", "E"), ("r", "a", "E"), ("r", "a", None), ("r", "x", "E")], "repo_full_name string, file_path string, error string")
    collection = spark.createDataFrame([("r", "a", None, False, False)], "repo_full_name string, file_path string, deps_any boolean, out_of_order boolean, has_abs_data_path boolean")
    cube = {(r.level, r.error, r.deps_any, r.out_of_order, r.has_abs_data_path): (r.n, r.pct) for r in matching.error_cube(runs, collection).collect()}
    assert cube[(0, "E", None, False, False)] == (2, pytest.approx(200 / 3)) and cube[(0, None, None, False, False)] == (1, pytest.approx(100 / 3))
    assert cube[(8, None, None, False, False)] == (3, 100.0) and cube[(15, None, None, None, None)] == (4, 100.0) and cube[(7, "E", None, None, None)] == (3, 75.0)
    assert cube[(3, "E", None, None, None)] == (3, 75.0)


def test_a_kernel_with_few_notebooks_and_many_runs_is_split(spark):
    declared = spark.createDataFrame([("r", f"n{i}", "python3" if i < 3 else f"k{i}") for i in range(50)], "repo_full_name string, file_path string, kernel_name string")
    logs = spark.range(3000).select(F.lit("r").alias("repo_full_name"), F.concat(F.lit("n"), F.when(F.col("id") < 2400, F.col("id") % 3).otherwise(F.col("id") % 50).cast("string")).alias("file_path"), "id")
    counted = runs_by_kernel(declared, logs)
    assert {r.kernel_name: r.rows for r in counted.collect()}["python3"] == 2436
    assert max(r._parts for r in joins.heavy_buckets(counted, ["kernel_name"], 100, weight="rows").collect()) >= 25
    runs = logs.join(declared, ["repo_full_name", "file_path"])
    known = spark.createDataFrame([("python3",), ("k7",)], "name string")
    found = R.resolve_kernel(runs, known, ["id"], count_on=counted, part_rows=100).groupBy("kernel_name").count().collect()
    assert {r.kernel_name: r["count"] for r in found} == {"k7": 12, "python3": 2988}
