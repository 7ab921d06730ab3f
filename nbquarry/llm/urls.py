"""URL filters: expressions of each URL, looked up by short hash and confirmed by full digest.

A rule is a host and a path; it fits a URL whose host is the rule's or a subdomain of it, and whose path starts with the
rule's. So a URL fits exactly the rules among its own expressions: every host suffix with every path prefix. Only as
many labels and only such prefix lengths are expanded as some rule has. Expressions and rules meet by a hash of
32 bits, then the full SHA-256 of both decides; of the rules that fit, the longest wins.

Each distinct pair of host and path is expanded once, however many pages have it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nbquarry.llm.common import col, free_name, stored
from nbquarry.operators.joins import left_join_unique


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased in A-Z; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A few rules ``(verdict, host, path)`` as a table; ``verdict`` is ``allow`` or ``block``."""
    names = ("verdict", "rule_host", "rule_path")
    rows = F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in zip(names, rule)]) for rule in rules])
    return spark.range(1).select(F.inline(rows))


def _digest(host: Column, path: Column) -> Column:
    # A host cannot contain a slash, and a path starts with one or is empty, so this is unambiguous.
    return F.sha2(F.concat(host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def expressions(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, digest, short)``: what a rule would have to be to fit, for distinct ``(host, path)``.

    Host suffixes start at a label, so ``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``.
    """
    # Distinct small numbers: no more than a host name has labels and a path has lengths.
    shapes = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))), F.collect_set(F.length("rule_path"))).first()
    some = lambda numbers: F.array(*[F.lit(n) for n in sorted(numbers)]).cast("array<int>")
    parts = F.split("host", r"\.")
    labels = F.filter(some(shapes[0]), lambda n: n <= F.size(parts))
    suffixes = F.transform(labels, lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefixes = F.transform(F.filter(some(shapes[1]), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    pairs = addresses.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    whole = pairs.select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    return whole.select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest")).withColumn("short", _short(F.col("digest")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the rule that won, or NULL) and ``verdict``.

    Longest wins: host and path together, then the longer host, then ``block``. Without a fitting rule the verdict is
    ``default``. NULL, empty and malformed URLs have empty host and path, which only a rule with an empty host and path
    fits. Repeated rules count once, repeated pages stay repeated, and columns of these names are replaced.
    """
    key_host, key_path = free_name(pages, "url_host"), free_name(pages, "url_path")
    keyed = pages.withColumns({key_host: host(col(url)), key_path: path(col(url))})
    addresses = stored(keyed.select(col(key_host).alias("host"), col(key_path).alias("path")).distinct())
    lowered = rules.select("verdict", F.lower("rule_host").alias("rule_host"), "rule_path").distinct()
    marked = lowered.withColumn("full", _digest(F.col("rule_host"), F.col("rule_path")))
    # One row per digest; of two rules for the same place, block wins.
    marked = stored(marked.groupBy("full", "rule_host", "rule_path").agg(F.max("verdict").alias("verdict")).withColumn("short", _short(F.col("full"))))
    # Many rules may share a short hash: gather them, so that the join has one row per key.
    by_short = marked.groupBy("short").agg(F.collect_list(F.struct("full", "verdict", "rule_host", "rule_path")).alias("rules"))
    met = left_join_unique(expressions(addresses, marked), by_short, ["short"], ["host", "path"], how="inner")
    fitting = met.select("host", "path", "digest", F.explode("rules").alias("r")).where("digest = r.full")
    rank = F.struct(
        (F.length("r.rule_host") + F.length("r.rule_path")).alias("length"), F.length("r.rule_host").alias("host_length"), F.col("r.verdict").alias("verdict"),
        F.concat("r.rule_host", "r.rule_path").alias("rule"),
    )
    best = stored(fitting.groupBy("host", "path").agg(F.max(rank).alias("best")).select(
        F.col("host").alias(key_host), F.col("path").alias(key_path), F.col("best.rule").alias("won"), F.col("best.verdict").alias("won_verdict")
    ))
    won = left_join_unique(keyed.drop(*[c for c in ("host", "path", "rule", "verdict", "won", "won_verdict") if c != url and c in pages.columns]), best, [key_host, key_path], [url])
    return won.withColumns({"rule": F.col("won"), "verdict": F.coalesce("won_verdict", F.lit(default))}).withColumnsRenamed(
        {key_host: "host", key_path: "path"}
    ).drop("won", "won_verdict")
