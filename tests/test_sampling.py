"""Date ranges against a plain bisection, windows, quotas."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nbquarry.functions import coerce
from nbquarry.operators import repos, sampling as P

DAY = dt.timedelta(days=1)


def bisect(counts, a, b, cap):
    total = min(sum(n for d, n in counts.items() if a <= d <= b), 1_000_000)
    if total < cap or a == b:
        return [(a, b, total)]
    middle = a + DAY * ((b - a).days // 2)
    return bisect(counts, a, middle, cap) + bisect(counts, middle + DAY, b, cap)


@pytest.mark.parametrize("seed,days,cap", [(1, 1, 5), (2, 2, 5), (3, 10, 3), (4, 100, 20), (5, 365, 40), (6, 33, 1), (7, 64, 10**7)])
def test_ranges(spark, seed, days, cap):
    rng = random.Random(seed)
    start = dt.date(2024, 2, 20)
    counts = {start + DAY * rng.randrange(days): rng.randint(1, 30) for _ in range(days)}
    counts[start - DAY] = 99
    rows = [(d,) for d, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "d date").repartition(3)
    end = start + DAY * (days - 1)
    got = [tuple(r) for r in P.adaptive_date_ranges(df, F.col("d"), start, end, cap).collect()]
    assert got == bisect(counts, start, end, cap)


def test_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        repos.check_date_bounds("2025-02-01", "2025-01-31")
    assert repos.check_date_bounds("2025-01-31", "2025-01-31") == (dt.date(2025, 1, 31),) * 2


def test_creation_bounds_include_both_days(spark):
    times = ["2025-01-01 00:00:00", "2025-01-31 23:59:59", "2025-02-01 00:00:00", "2024-12-31 23:59:59"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("created_at"))
    assert repos.filter_created_between(df, "2025-01-01", "2025-01-31").count() == 2


def test_calendar():
    windows = P.calendar_windows()
    assert len(windows) == 40 and sum(w.quota for w in windows) == 383
    assert windows[0][1:3] == (dt.date(2025, 1, 1), dt.date(2025, 1, 5))
    assert windows[-1][1:3] == (dt.date(2025, 9, 29), dt.date(2025, 9, 30))
    assert all(x.b + DAY == y.a for x, y in zip(windows, windows[1:]))


def test_quota_is_exact_when_one_window_is_hot(spark):
    windows = [P.CalendarWindow(1, dt.date(2025, 1, 1), dt.date(2025, 1, 5), 9), P.CalendarWindow(2, dt.date(2025, 1, 6), dt.date(2025, 1, 6), 2),
               P.CalendarWindow(3, dt.date(2025, 3, 1), dt.date(2025, 3, 1), 5)]
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("2025-01-06")).when(F.col("id") % 500 == 1, F.lit("2025-01-02"))
                                  .otherwise(F.lit("2025-02-02")).cast("date").alias("d")).repartition(7)
    kept = P.window_quota(df, windows, F.col("d"), [F.desc("id")])
    got = {(r.window_id, r.id) for r in kept.collect()}
    assert got == {(2, 2997), (2, 2994)} | {(1, i) for i in range(3000) if i % 500 == 1 and i % 3}


def test_pages(spark):
    df = spark.range(1200).select("id", F.lit("2025-01-01").cast("date").alias("d"), (F.col("id") % 600).alias("updated_at"))
    ranges = spark.createDataFrame([(dt.date(2025, 1, 1), dt.date(2025, 1, 2))], "a date, b date")
    rows = P.newest_per_range(df, ranges, F.col("d")).orderBy("range_rank").collect()
    assert len(rows) == 1000
    assert [r.id for r in rows[:3]] == [599, 1199, 598]
    assert [rows[0].page, rows[99].page, rows[100].page, rows[999].page] == [1, 1, 2, 10]


def test_limits(spark):
    df = spark.range(20)
    assert P.limit_runs(df, ["id"], 0).count() == P.limit_runs(df, ["id"]).count() == 20
    assert P.limit_repos(df, ["id"]).count() == 20
    assert [r.id for r in P.limit_items(df, [F.desc("id")], 2).collect()] == [19, 18]
    assert P.limit_items(df, ["id"], None).count() == 20


@pytest.mark.parametrize("text,number,whole", [
    ("12", 12.0, 12), (" 1.9 ", 1.9, 1), ("-1.9", -1.9, -1), ("1e3", 1000.0, 1000), ("1_000", 1000.0, 1000), ("1d", 0.0, 0),
    ("nan", None, 0), ("inf", float("inf"), 0), ("", 0.0, 0), (None, 0.0, 0), ("x", 0.0, 0), (".5", 0.5, 0), ("5.", 5.0, 5),
    ("1__0", 0.0, 0), ("0x10", 0.0, 0), ("+7", 7.0, 7), ("1e40", 1e40, 0),
])
def test_numbers(spark, text, number, whole):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(coerce.to_float(F.col("t")).alias("f"), coerce.to_int(F.col("t")).alias("i")).first()
    assert row.i == whole
    assert row.f != row.f if number is None else row.f == number


@pytest.mark.parametrize("text,expected", [
    ("True", True), (" YES ", True), ("t", True), ("y", True), ("1", True), ("1.0", False), ("on", False), ("", False), (None, False),
])
def test_booleans(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(coerce.to_bool(F.col("t")).alias("b")).first().b is expected
