"""Lenient conversion of text columns, as CSV readers of this format do it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from nbquarry.constants import TRUE_WORDS

BLANKS = " \t\n\r\f\x0b"
_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBER = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"
)

# All that a cast to bigint takes, blanks and control characters at the ends included.
_INTEGER = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"


def _text(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def parse_float(c: Column) -> Column:
    """The number spelled by ``c`` (digit-group underscores allowed), or NULL."""
    text = _text(c)
    # Spark also reads type suffixes such as 1d as numbers, hence the pattern.
    return F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def to_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(parse_float(c), F.lit(float(default)))


def to_int(c: Column, default: int = 0) -> Column:
    """Truncate toward zero; anything that is not a finite 64-bit number gives the default."""
    return F.coalesce(parse_float(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def integer_text(c: Column) -> Column:
    """The integer that text ``c`` spells, or NULL. A cast alone would raise and catch an error for each other text."""
    return F.when(c.rlike(_INTEGER), c.try_cast("bigint"))


def to_bool(c: Column) -> Column:
    # The usual spellings are told by comparison alone.
    text = c.cast("string")
    usual = F.when(text == "True", F.lit(True)).when(text == "False", F.lit(False))
    return F.coalesce(usual, F.lower(_text(c)).isin(TRUE_WORDS), F.lit(False))


def pct(part: Column, whole: Column) -> Column:
    """Percentage, 0.0 when the whole is zero or missing."""
    share = F.lit(100.0) * part.cast("double") / whole.cast("double")
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(share)


def executed_percent(executed: Column, code: Column) -> Column:
    """Share of executed cells in percent: the quotient first, then the scaling, which fixes the last digit."""
    return F.when(code > 0, executed.cast("double") / code.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_filled(c: Column) -> Column:
    """True for a value that is neither NULL nor empty text."""
    return c.isNotNull() & (c.cast("string") != "")
