"""Names, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from nbquarry.constants import (
    DEFAULT_BRANCH, ELAPSED_DECIMALS, LOG_TAIL_CHARACTERS, MISSING_SHA, SHA_PREFIX_LENGTH, UNSAFE_NAME_CHARACTER,
)
from nbquarry.functions.coerce import blank_to_null


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(name, UNSAFE_NAME_CHARACTER, "_")


def sanitize_file_name(path: Column) -> Column:
    return sanitize_name(basename(path))


def owner_of(full_name: Column) -> Column:
    return F.get(F.split(full_name, "/", 2), F.lit(0))


def repo_of(full_name: Column) -> Column:
    return F.get(F.split(full_name, "/", 2), F.lit(1))


def short_sha(sha: Column) -> Column:
    return F.coalesce(blank_to_null(F.left(sha, F.lit(SHA_PREFIX_LENGTH))), F.lit(MISSING_SHA))


def archive_name(sha: Column, path: Column) -> Column:
    return F.concat(short_sha(sha), F.lit("_"), sanitize_file_name(path))


def default_branch(branch: Column) -> Column:
    return F.coalesce(blank_to_null(branch), F.lit(DEFAULT_BRANCH))


def log_tail(log: Column, n: int = LOG_TAIL_CHARACTERS) -> Column:
    return F.right(log, F.lit(n))


def round_elapsed(seconds: Column) -> Column:
    return F.round(seconds, ELAPSED_DECIMALS)


def notebook_label(repo_full_name: Column, file_path: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.coalesce(repo_full_name, empty), F.lit("/"), F.coalesce(file_path, empty))
