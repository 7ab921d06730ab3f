"""Date ranges, calendar windows, quotas and limits."""

from __future__ import annotations

import datetime as dt
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from nbquarry import constants as K
from nbquarry.operators.repos import check_date_bounds


class CalendarWindow(NamedTuple):
    window_id: int
    a: dt.date
    b: dt.date
    quota: int


def calendar_windows() -> list[CalendarWindow]:
    """The collection calendar: weeks from Monday to Sunday, clipped to the bounds, each with its quota."""
    first, last = check_date_bounds(K.CALENDAR_START, K.CALENDAR_END)
    monday = first - dt.timedelta(days=first.weekday())
    windows = []
    for number, quota in enumerate(K.CALENDAR_QUOTAS):
        week = monday + dt.timedelta(weeks=number)
        windows.append(CalendarWindow(number + 1, max(week, first), min(week + dt.timedelta(days=6), last), quota))
    return windows


def window_days(spark: SparkSession, windows: list[CalendarWindow]) -> DataFrame:
    """One row per day of each window: as many rows as the windows have days."""
    rows = ", ".join(f"({w.window_id}, date '{w.a}', date '{w.b}', {w.quota})" for w in windows)
    return spark.sql(f"select *, explode(sequence(a, b)) as _day from values {rows} as w(window_id, a, b, quota)")


# Days of a window table that are broadcast at most.
MOST_DAYS = 1 << 20


def stored_window_days(windows: DataFrame) -> DataFrame:
    """One row per day of each window of a table ``(window_id, a, b, quota)``; windows without a quota or with reversed bounds have none."""
    days = windows.where("a <= b and quota > 0").select("window_id", "a", "b", "quota", F.explode(F.sequence("a", "b")).alias("_day"))
    n = days.count()
    if n > MOST_DAYS:
        raise ValueError(f"{n} days of windows; a calendar has fewer than {MOST_DAYS}")
    return days


def assign_windows(df: DataFrame, windows: list[CalendarWindow] | DataFrame, date: Column) -> DataFrame:
    """Rows whose date lies in a window, with the window's columns; both ends count.

    Windows are spread out to days so that this is an equality join. Their day table is small by construction, and so
    safe to broadcast. A collection stored by date (with a ``created_date`` column) is joined on that, so that once the windows'
    days are known, only those days' folders are read.
    """
    days = stored_window_days(windows) if isinstance(windows, DataFrame) else window_days(df.sparkSession, windows)
    if "created_date" in df.columns:
        return df.join(F.broadcast(days), F.col("created_date") == F.col("_day")).drop("_day")
    return df.withColumn("_day", F.to_date(date)).join(F.broadcast(days), "_day").drop("_day")


def window_quota(df: DataFrame, windows: list[CalendarWindow] | DataFrame, date: Column, order_by: list[Column | str]) -> DataFrame:
    """The first ``quota`` rows of each window in scan order. Filters come before, so dropped rows use no quota.

    The largest quota is a literal rank limit, which Spark applies on every partition before shuffling; the window's own
    quota then cuts what is left.
    """
    order = Window.partitionBy("window_id").orderBy(*order_by)
    largest = windows.agg(F.max("quota")).first()[0] or 0 if isinstance(windows, DataFrame) else max(w.quota for w in windows)
    ranked = assign_windows(df, windows, date).withColumn("quota_rank", F.row_number().over(order))
    return ranked.where(F.col("quota_rank") <= largest).where(F.col("quota_rank") <= F.col("quota"))


def _halvings(first: Column, last: Column, depth: int) -> Column:
    """For a day ``_day`` in ``[first, last]``: the nested ranges that bisecting down to it goes through."""
    def step(path: Column, _: Column) -> Column:
        top = F.element_at(path, -1)
        middle = F.date_add(top.a, F.floor(F.date_diff(top.b, top.a) / 2).cast("int"))
        left = F.col("_day") <= middle
        half = F.struct(
            F.when(left, top.a).otherwise(F.date_add(middle, 1)).alias("a"),
            F.when(left, middle).otherwise(top.b).alias("b"),
        )
        return F.when(top.a < top.b, F.concat(path, F.array(half))).otherwise(path)

    whole = F.array(F.struct(first.alias("a"), last.alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), whole, step)


def adaptive_date_ranges(
    df: DataFrame, date: Column, start: dt.date | str, end: dt.date | str, cap: int = K.RANGE_CAP
) -> DataFrame:
    """Bisect ``[start, end]`` until each range holds fewer than ``cap`` rows or is one day: ``(a, b, total)`` by ``a``.

    Where a range would be cut does not depend on the data, only whether it is. So each day's chain of nested ranges is
    laid out beforehand, daily counts are added up for every range at once, and a range is kept if it needs no further
    cut while the range around it does. Rows involved: days times the number of halvings.
    """
    first, last = check_date_bounds(start, end)
    n_days = (last - first).days + 1
    depth = max(1, math.ceil(math.log2(n_days)) + 1)
    daily = (
        df.select(F.to_date(date).alias("_day")).where(F.col("_day").between(F.lit(first), F.lit(last)))
        .groupBy("_day").agg(F.count(F.lit(1)).alias("rows"))
    )
    days = df.sparkSession.range(n_days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("_day"))
    chains = days.select("_day", F.posexplode(_halvings(F.lit(first), F.lit(last), depth)).alias("level", "r"))
    around = Window.partitionBy("_day").orderBy("level")
    nested = chains.select(
        "_day", "r.a", "r.b", F.lag("r.a").over(around).alias("around_a"), F.lag("r.b").over(around).alias("around_b")
    )
    totals = (
        nested.join(daily, "_day", "left")
        .groupBy("a", "b", "around_a", "around_b")
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))
    )
    outer = totals.select(F.col("a").alias("around_a"), F.col("b").alias("around_b"), F.col("total").alias("around_total"))
    joined = totals.join(outer, ["around_a", "around_b"], "left")
    settled = (F.col("total") < cap) | (F.col("a") == F.col("b"))
    reached = F.col("around_a").isNull() | (F.col("around_total") >= cap)
    return sort_ranges(joined.where(settled & reached).select("a", "b", "total"))


def sort_ranges(ranges: DataFrame) -> DataFrame:
    return ranges.orderBy("a")


def newest_per_range(
    repos: DataFrame, ranges: DataFrame, date: Column, updated: str = "updated_at", tie: str = "id",
    limit: int = K.ROWS_PER_RANGE, page_size: int = K.ROWS_PER_PAGE,
) -> DataFrame:
    """At most ``limit`` rows per range, most recently updated first, with rank and page number.

    ``ranges`` must not overlap. Spread out to days they are one row per day, so the join is an equality join on the
    day.
    """
    days = ranges.select("a", "b", F.explode(F.sequence("a", "b")).alias("_day"))
    order = Window.partitionBy("a").orderBy(F.desc(updated), tie)
    # One row per calendar day, so at most as many rows as the date bounds have days.
    placed = repos.withColumn("_day", F.to_date(date)).join(F.broadcast(days), "_day").drop("_day")
    ranked = placed.withColumn("range_rank", F.row_number().over(order)).where(F.col("range_rank") <= limit)
    return ranked.withColumn("page", F.ceil(F.col("range_rank") / page_size).cast("int"))


def limit_items(df: DataFrame, order_by: list[Column | str], n: int | None = K.DEFAULT_ITEM_LIMIT) -> DataFrame:
    """The first ``n`` rows in scan order; no limit if ``n`` is None."""
    return df if n is None else df.orderBy(*order_by).limit(max(n, 0))


def limit_repos(repos: DataFrame, order_by: list[Column | str], n: int | None = None) -> DataFrame:
    """The first ``n`` repositories in scan order; no limit if ``n`` is None or 0."""
    return repos.orderBy(*order_by).limit(n) if n else repos


def limit_runs(runs: DataFrame, order_by: list[Column | str], n: int | None = None) -> DataFrame:
    """The first ``n`` eligible rows; no limit if ``n`` is None or 0."""
    return runs.orderBy(*order_by).limit(n) if n else runs
