"""Row predicates on cells: text markers and output kinds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from nbquarry import constants as K

# i ignores case, u does so for all of Unicode, U makes \b treat accented letters as word characters.
AI_PATTERN = rf"(?iuU)\b(?:{'|'.join(K.AI_NAMES)})\b|{K.AI_PHRASE}"


def mentions_ai(source: Column) -> Column:
    return source.rlike(AI_PATTERN)


def has_code_fence(source: Column) -> Column:
    return F.contains(source, F.lit(K.CODE_FENCE))


def has_absolute_path(source: Column) -> Column:
    return source.rlike(K.ABSOLUTE_PATH_PATTERN)


def any_prefix(mimes: Column, prefixes: list[str]) -> Column:
    def starts(m: Column) -> Column:
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | F.startswith(m, F.lit(prefix))
        return hit

    return F.exists(mimes, starts)


def any_of(mimes: Column, names: list[str]) -> Column:
    return F.exists(mimes, lambda m: m.isin(names))


# Output kind -> predicate on the MIME types of a cell.
OUTPUT_KINDS = {
    "outputs_text": lambda mimes: any_prefix(mimes, K.MIME_PREFIX_TEXT),
    "outputs_image": lambda mimes: any_prefix(mimes, K.MIME_PREFIX_IMAGE),
    "outputs_html_js": lambda mimes: any_of(mimes, K.MIME_HTML_JS),
    "outputs_formatted": lambda mimes: any_of(mimes, K.MIME_FORMATTED),
    "outputs_ext": lambda mimes: any_prefix(mimes, K.MIME_PREFIX_EXTENSION),
}


def has_error_output(output_types: Column) -> Column:
    return F.exists(output_types, lambda t: t == "error")


def is_test_module(module: Column) -> Column:
    return module.rlike(K.TEST_NAME_PATTERN) | module.isin(K.TEST_MODULES)
