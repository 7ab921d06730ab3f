"""Date ranges, windows, quotas, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from nbquarry.operators import repos, sampling as P
from registry import fixtures as X
from registry.book import checked

_FX = f"with {X.duck_views('fx_collection')}"
_BOUNDS = ("1995-01-01", "2001-12-31")
_CAP = 900


def _orders(spark, sf):
    return X.table(spark, sf, "orders")


# The same bisection as a recursive query over daily counts.
_RANGES = f"""
with recursive daily as (
  select cast(o_orderdate as date) as day, count(*) as rows from orders group by 1),
ranges as (
  select date '{_BOUNDS[0]}' as a, date '{_BOUNDS[1]}' as b,
    (select coalesce(sum(rows), 0) from daily where day between date '{_BOUNDS[0]}' and date '{_BOUNDS[1]}') as total
  union all
  select h.a, h.b, (select coalesce(sum(rows), 0) from daily where day between h.a and h.b)
  from (
    select case side when 0 then a else a + cast((b - a) // 2 + 1 as integer) end as a, case side when 0 then a + cast((b - a) // 2 as integer) else b end as b
    from (select cast(a as date) as a, cast(b as date) as b, total from ranges) r, (values (0), (1)) s(side)
    where total >= {_CAP} and a < b) h),
final as (select a, b, cast(total as bigint) as total from ranges where total < {_CAP} or a = b)
"""


def _ranges(spark, sf):
    return P.adaptive_date_ranges(_orders(spark, sf), F.col("o_orderdate"), *_BOUNDS, cap=_CAP)


checked("adaptive_date_ranges", f"{_RANGES} select a, b, total from final")(_ranges)
checked("sort_ranges", f"{_RANGES} select a, b from final order by a")(
    lambda spark, sf: P.sort_ranges(_ranges(spark, sf).select("a", "b"))
)


@checked("newest_per_range", f"""{_RANGES}
select o_orderkey, a, range_rank, cast(ceil(range_rank / 100.0) as integer) as page from (
  select o_orderkey, a, row_number() over (partition by a order by o_totalprice desc, o_orderkey) as range_rank
  from orders join final on cast(o_orderdate as date) between a and b) r
where range_rank <= 1000""")
def newest_per_range(spark, sf):
    ranked = P.newest_per_range(
        _orders(spark, sf), _ranges(spark, sf), F.col("o_orderdate"), updated="o_totalprice", tie="o_orderkey"
    )
    return ranked.select("o_orderkey", "a", "range_rank", "page")


@checked("filter_created_between", "select o_orderkey from orders where cast(o_orderdate as date) between date '1996-03-01' and date '1997-02-28'")
def filter_created_between(spark, sf):
    return repos.filter_created_between(_orders(spark, sf), "1996-03-01", "1997-02-28", "o_orderdate").select("o_orderkey")


# Weeks from Monday, clipped to the calendar's bounds; quotas listed by week.
WINDOWS = f"""
quotas as (select unnest({[w.quota for w in P.calendar_windows()]}) as quota, unnest(range(1, 41)) as window_id),
windows as (
  select cast(window_id as integer) as window_id, quota,
    greatest(date '2024-12-30' + cast((window_id - 1) * 7 as integer), date '2025-01-01') as a,
    least(date '2024-12-30' + cast((window_id - 1) * 7 + 6 as integer), date '2025-09-30') as b from quotas)
"""


def _created():
    return F.left(F.col("repo_created_at"), F.lit(10)).cast("date")


@checked("assign_windows", f"""{_FX}, {WINDOWS}
select row_id, window_id, a, b from fx_collection join windows on cast(left(repo_created_at, 10) as date) between a and b""")
def assign_windows(spark, sf):
    placed = P.assign_windows(X.view(spark, sf, "fx_collection"), P.calendar_windows(), _created())
    return placed.select("row_id", "window_id", "a", "b")


@checked("window_quota", f"""{_FX}, {WINDOWS}
select row_id, window_id, quota_rank from (
  select row_id, window_id, quota, row_number() over (partition by window_id order by repo_created_at desc, row_id) as quota_rank
  from fx_collection join windows on cast(left(repo_created_at, 10) as date) between a and b
  where nb_ok_parse <> 'True' or lower(language) like '%python%') r
where quota_rank <= quota""")
def window_quota(spark, sf):
    kept = X.view(spark, sf, "fx_collection").where(
        (F.col("nb_ok_parse") != "True") | F.contains(F.lower("language"), F.lit("python"))
    )
    order = [F.desc("repo_created_at"), F.col("row_id")]
    return P.window_quota(kept, P.calendar_windows(), _created(), order).select("row_id", "window_id", "quota_rank")


checked("limit_items", f"{_FX} select row_id from fx_collection order by repo_created_at desc, row_id limit 1000")(
    lambda spark, sf: P.limit_items(X.view(spark, sf, "fx_collection"), [F.desc("repo_created_at"), "row_id"]).select("row_id")
)
checked("limit_repos", "select c_custkey from customer order by c_acctbal desc, c_custkey limit 50")(
    lambda spark, sf: P.limit_repos(X.table(spark, sf, "customer"), [F.desc("c_acctbal"), "c_custkey"], 50).select("c_custkey")
)
checked("limit_runs", f"with {X.duck_views('fx_runs')} select row_id from fx_runs where exec_ok = 'True' order by row_id limit 50")(
    lambda spark, sf: P.limit_runs(X.view(spark, sf, "fx_runs").where("exec_ok = 'True'"), ["row_id"], 50).select("row_id")
)
