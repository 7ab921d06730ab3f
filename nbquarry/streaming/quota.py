"""Quotas of calendar windows, kept across runs.

Each run takes the window files that have arrived since the last one. For each window the state holds the rows that are
within its quota so far, at most as many as the quota; a row that comes later and stands earlier in scan order takes
the place of the last one. So files may arrive in any order and in any number of runs, and once all are there the
result is that of ``collect_windows``. A row delivered again counts once.

A task first keeps what can be within the quota among its own rows, so that a window with most rows sends few to the
task that has its state.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from nbquarry.operators.sampling import CalendarWindow, assign_windows, calendar_windows
from nbquarry.schema import COLLECTION_SCHEMA
from nbquarry.streaming.windows import read_window_stream

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The scan order of ``collect_windows``: newest repository first, then its number and name, then the path.
_CANDIDATE = "window_id int, quota int, created_us long, repo_id long, repo_full_name string, file_path string, row string"
_KEPT = T.StructType([
    T.StructField("created_us", T.LongType()), T.StructField("repo_id", T.LongType()), T.StructField("repo_full_name", T.StringType()),
    T.StructField("file_path", T.StringType()), T.StructField("row", T.StringType()),
])
_FIELDS = _KEPT.fieldNames()


def _scan_key(kept: tuple) -> tuple:
    created, repo_id, name, path, row = kept
    first_if_null = lambda x, zero: (x is not None, zero if x is None else x)
    return (-created, *first_if_null(repo_id, 0), *first_if_null(name, ""), *first_if_null(path, ""), row)


def within_quota(rows: Iterator[tuple], quota: int) -> list[tuple]:
    """The first ``quota`` notebooks in scan order; of several rows of one notebook the first."""
    found: dict[tuple, tuple] = {}
    for row in rows:
        notebook = (row[2], row[3])
        if notebook not in found or _scan_key(row) < _scan_key(found[notebook]):
            found[notebook] = row
        if len(found) > 4 * quota + 64:
            found = {(r[2], r[3]): r for r in heapq.nsmallest(quota, found.values(), key=_scan_key)}
    return heapq.nsmallest(quota, found.values(), key=_scan_key)


def _tuples(frame: pd.DataFrame) -> Iterator[tuple]:
    plain = lambda v: None if pd.isna(v) else int(v)
    for created, repo_id, name, path, row in zip(*(frame[c] for c in _FIELDS)):
        yield int(created), plain(repo_id), name, path, row


def _frame(window_id: int, quota: int, rows: list[tuple], **more) -> pd.DataFrame:
    columns = dict(zip(_FIELDS, zip(*rows))) if rows else {c: [] for c in _FIELDS}
    frame = pd.DataFrame({"window_id": [window_id] * len(rows), "quota": [quota] * len(rows), **{k: list(v) for k, v in columns.items()}, **more})
    return frame.astype({"repo_id": "Int64"})


def _first_of_each_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept: dict[tuple[int, int], list[tuple]] = {}
    for frame in frames:
        for (window_id, quota), part in frame.groupby(["window_id", "quota"]):
            key = (int(window_id), int(quota))
            kept[key] = within_quota(iter([*kept.get(key, []), *_tuples(part)]), key[1])
    for (window_id, quota), rows in kept.items():
        yield _frame(window_id, quota, rows)


class WindowQuota(StatefulProcessor):
    """State of a window: the rows within its quota."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getListState("kept", _KEPT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window_id, quota = key
        before = [tuple(r) for r in self._kept.get()] if self._kept.exists() else []
        kept = within_quota(iter([*before, *(t for frame in rows for t in _tuples(frame))]), quota)
        if kept != before and kept:
            self._kept.put(kept)
            yield _frame(window_id, quota, kept, quota_rank=list(range(1, len(kept) + 1)))

    def close(self) -> None:
        pass


def _candidates(collection: DataFrame, windows: list[CalendarWindow], date: Column) -> DataFrame:
    placed = assign_windows(collection, windows, date)
    row = F.to_json(F.struct(*COLLECTION_SCHEMA.fieldNames()), {"ignoreNullFields": "true"})
    return placed.select("window_id", "quota", F.unix_micros(date).alias("created_us"), "repo_id", "repo_full_name", "file_path", row.alias("row"))


def incremental_quota(
    spark: SparkSession, path: str, target: str, checkpoint: str, windows: list[CalendarWindow] | None = None, multi_line: bool = True,
) -> StreamingQuery:
    """Take the window files not yet seen under ``path`` into ``target``, then stop.

    ``target`` is a parquet table in one folder for each window, with the columns of the collection, ``quota_rank`` and ``window_id``. A
    run replaces the folders of windows that have changed. State is kept under ``checkpoint``, so a restarted run goes on where
    the last one ended, and repeating a run that failed replaces the same folders.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    found = _candidates(read_window_stream(spark, path, multi_line), windows or calendar_windows(), F.col("repo_created_at"))
    first = found.mapInPandas(_first_of_each_task, _CANDIDATE)
    kept = first.groupBy("window_id", "quota").transformWithStateInPandas(
        WindowQuota(), outputStructType=f"{_CANDIDATE}, quota_rank int", outputMode="Update", timeMode="None"
    )

    def replace(batch: DataFrame, _: int) -> None:
        rows = batch.select(F.from_json("row", COLLECTION_SCHEMA).alias("r"), "quota_rank", "window_id").select("r.*", "quota_rank", "window_id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_id").parquet(target)

    return kept.writeStream.outputMode("update").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
