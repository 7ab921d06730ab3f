"""Compare a Spark result with a DuckDB result: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from nbquarry.session import BUILD_SETTINGS, configure


def session(cores: str = "8", partitions: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("nbquarry")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC").config(map=BUILD_SETTINGS).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    duck = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        duck.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return duck


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def compare(df: DataFrame, duck: duckdb.DuckDBPyConnection, oracle: str | None) -> tuple[str, int]:
    """``(problem, rows)``; the problem is empty if both agree, or if there is nothing to compare with."""
    columns = sorted(df.columns)
    rows = Counter(tuple(_plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    count = sum(rows.values())
    if oracle is None:
        return "", count
    result = duck.execute(oracle)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}", count
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    if rows == expected:
        return "", count
    by_text = lambda row: tuple(str(v) for v in row)
    extra, missing = (sorted((a - b).elements(), key=by_text) for a, b in ((rows, expected), (expected, rows)))
    first = [
        f"{c}: {x!r} vs {y!r}" for e, m in zip(extra[:1], missing[:1]) for c, x, y in zip(columns, e, m) if x != y
    ]
    return f"rows {count} vs {sum(expected.values())}, {len(extra)} only in Spark, {len(missing)} only in DuckDB; {first}", count
