"""Notebook documents too large for a VARIANT: cells read off a stream of chunks, without building the document.

A reader is fed the text piece by piece and keeps a stack of open objects and lists. Values that no metric looks at are
checked and forgotten as they pass, output payloads above all; a cell becomes its light record when it closes. What the
reader accepts is what ``documents.parse_json`` and ``documents.usable_document`` accept together.
"""

from __future__ import annotations

import codecs
import json
import re
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Bytes fed to a reader at a time.
CHUNK_BYTES = 1 << 20

_S = T.StringType()
CELL = T.StructType([
    T.StructField("cell_idx", T.IntegerType()), T.StructField("cell_type", _S), T.StructField("source", _S), T.StructField("execution_count", T.LongType()),
    T.StructField("execution_count_set", T.BooleanType()), T.StructField("n_outputs", T.IntegerType()), T.StructField("output_types", T.ArrayType(_S)),
    T.StructField("mime_types", T.ArrayType(_S)),
])
# JSON text of each output of a code cell.
OUTPUT = T.StructType([T.StructField("cell_idx", T.IntegerType()), T.StructField("output_idx", T.IntegerType()), T.StructField("json", _S)])
LARGE = T.StructType([
    T.StructField("kernel_name", _S), T.StructField("language", _S), T.StructField("python_version_declared", _S), T.StructField("cells", T.ArrayType(CELL)),
    T.StructField("outputs", T.ArrayType(OUTPUT)),
])

_SPACE = re.compile(rb"[ \t\n\r]*")
_SCALAR = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|[+-]?Infinity")
_WORD = re.compile(rb"[-+.0-9A-Za-z]*")
_LONGEST_LITERAL = 1 << 16
_SIMPLE = re.compile(rb'"([^"\\\x00-\x1f]*)"')
_PLAIN = re.compile(rb'[^"\\\x00-\x1f]*')
_INTEGER = re.compile(rb"-?[0-9]+")
_ESCAPES = b'"\\/bfnrt'
_QUOTE, _BACKSLASH, _COLON, _LIST, _END_OF_LIST = b'"\\:[]'
_BETWEEN, _OPENING, _CLOSING = b",:", b"{[", b"}]"

# What is kept of a document. An object has its keys; a list the form of its items under ``*``; ``TEXT`` is a scalar, or a list of
# them where LINES; of KEYS only the names stay. Everything else is passed over.
SKIP, TEXT, LINES, KEYS = None, "text", "lines", "keys"
_OUTPUT = {"output_type": TEXT, "data": KEYS}
_CELL = {"cell_type": TEXT, "source": LINES, "execution_count": TEXT, "outputs": {"*": _OUTPUT}}
_DOCUMENT = {
    "metadata": {"kernelspec": {"name": TEXT}, "language_info": {"name": TEXT, "version": TEXT}}, "cells": {"*": _CELL},
}


class NotJson(ValueError):
    """The text is not one JSON value."""


class _Other:
    """A value of a form that nothing reads."""


_OTHER = _Other()


def _text(value: Any) -> str | None:
    """A scalar as text, as a cast gives it."""
    if value is None or isinstance(value, (str, _Other, dict, list)):
        return value if isinstance(value, str) else None
    return json.dumps(value)


def _joined(value: Any) -> str:
    if isinstance(value, list):
        return "".join(v for v in value if isinstance(v, str))
    return value if isinstance(value, str) else ""


def _record(cell: Any, position: int, outputs: list[str]) -> dict[str, Any]:
    cell = cell if isinstance(cell, dict) else {}
    kind = _text(cell.get("cell_type"))
    code, count = kind == "code", cell.get("execution_count")
    listed = cell.get("outputs") if code and isinstance(cell.get("outputs"), list) else []
    whole = isinstance(count, int) and not isinstance(count, bool) and -(2**63) <= count < 2**63
    part = lambda o, name: o.get(name) if isinstance(o, dict) else None
    mimes = [sorted(part(o, "data")) if isinstance(part(o, "data"), dict) else [] for o in listed]
    return {
        "cell_idx": position, "cell_type": kind, "source": _joined(cell.get("source")), "execution_count": count if code and whole else None,
        "execution_count_set": code and count is not None, "n_outputs": len(listed),
        "output_types": [_text(part(o, "output_type")) for o in listed], "mime_types": [m for ms in mimes for m in ms],
        "_outputs": [{"cell_idx": position, "output_idx": i, "json": o} for i, o in enumerate(outputs)] if code and listed else [],
    }


# Values that are whole in a chunk, read by Python's own scanner into the forms that the reader gives them.
_scan = json.JSONDecoder(parse_float=lambda _: _OTHER, parse_int=lambda n: int(n) if len(n) < 21 else _OTHER, parse_constant=str).scan_once
_SURROGATE = re.compile(rb"\\u[dD][89a-fA-F]")
_BLANK = re.compile(r"[ \t\n\r]*")
_AFTER_KEY = re.compile(r"[ \t\n\r]*:[ \t\n\r]*")
_AFTER_VALUE = re.compile(r"[ \t\n\r]*([,}\]])[ \t\n\r]*")
_NEXT_CELL = re.compile(r"[ \t\n\r]*,[ \t\n\r]*(?={)")


def _after_value(text: str, at: int, end: str) -> tuple[int, bool]:
    """Where the next item begins, or what follows the container, and whether it ended."""
    after = _AFTER_VALUE.match(text, at)
    if after is None or after.group(1) not in ("," + end):
        raise NotJson("comma or end missing")
    return (after.end(1), True) if after.group(1) == end else (after.end(), False)


def _whole_outputs(text: str, at: int) -> tuple[list[dict], list[str], int]:
    values, texts = [], []
    at = _BLANK.match(text, at + 1).end()
    ended = text[at] == "]"
    at += ended
    while not ended:
        if text[at] != "{":
            raise NotJson("no object")
        value, end = _scan(text, at)
        values.append(value)
        texts.append(text[at:end])
        at, ended = _after_value(text, end, "]")
    return values, texts, at


def _whole_cell(text: str, at: int) -> tuple[dict, list[str], int] | None:
    """The cell that begins at ``at``, the text of its outputs and its end; None if it is not whole or not of the usual form."""
    cell, outputs = {}, []
    try:
        at = _BLANK.match(text, at + 1).end()
        ended = text[at] == "}"
        at += ended
        while not ended:
            if text[at] != '"':
                return None
            key, at = scanstring(text, at + 1, True)
            colon = _AFTER_KEY.match(text, at)
            if colon is None:
                return None
            at = colon.end()
            if key == "outputs" and text[at] == "[":
                cell[key], outputs, at = _whole_outputs(text, at)
            else:
                cell[key], at = _scan(text, at)
            at, ended = _after_value(text, at, "}")
    except (StopIteration, IndexError, ValueError, RecursionError):
        return None
    return cell, outputs, at


class _Frame:
    """An open object or list: what is kept of it, and what may come next in it."""

    __slots__ = ("form", "is_list", "key", "node", "path", "wants")

    def __init__(self, is_list: bool, form: Any, path: tuple):
        self.is_list, self.form, self.path = is_list, form, path
        self.node: Any = [] if is_list else {}
        self.key: str | None = None
        self.wants = "value or end" if is_list else "key or end"


class NotebookReader:
    """Feed it chunks of UTF-8, then call :meth:`close`."""

    def __init__(self) -> None:
        self._rest, self._stack = b"", []
        self._string: list[bytes] | None = None
        self._done, self._value = False, None
        # JSON text of the outputs of the cell that is open.
        self._outputs: list[str] = []
        self._raw: list[bytes] | None = None
        self._raw_from = 0

    def feed(self, chunk: bytes) -> None:
        self._read(self._rest + chunk, last=False)

    def close(self) -> dict[str, Any] | None:
        """The light document (see ``LARGE``), or None if the text is no notebook."""
        self._read(self._rest, last=True)
        if not self._done or self._string is not None or self._stack:
            raise NotJson("text ends early")
        doc = self._value
        if not isinstance(doc, dict) or "cells" not in doc or not (doc["cells"] is None or isinstance(doc["cells"], list)):
            return None
        cells = doc["cells"] or []
        within = lambda *names: self._within(doc.get("metadata"), names)
        return {
            "kernel_name": within("kernelspec", "name"), "language": within("language_info", "name"),
            "python_version_declared": within("language_info", "version"),
            "outputs": [o for c in cells for o in c.pop("_outputs")], "cells": cells,
        }

    @staticmethod
    def _within(value: Any, names: tuple[str, ...]) -> str | None:
        for name in names:
            value = value.get(name) if isinstance(value, dict) else None
        return _text(value)

    def _read(self, data: bytes, last: bool) -> None:
        at, end = 0, len(data)
        self._raw_from = 0
        # Until a cell goes on in the next chunk, or is not of the usual form.
        whole_cells = True
        while True:
            if self._string is not None:
                at, closed = self._in_string(data, at, last)
                if not closed:
                    break
                continue
            if at < end and data[at] <= 0x20:
                at = _SPACE.match(data, at).end()
            if at == end:
                break
            if self._done:
                raise NotJson("text after the value")
            byte = data[at]
            if byte == _QUOTE:
                self._expect_value_or_key()
                whole = _SIMPLE.match(data, at)
                if whole is not None:
                    self._end_of_string(whole.group(1))
                    at = whole.end()
                else:
                    self._string = []
                    at += 1
            elif byte in _BETWEEN:
                self._between(byte == _COLON)
                at += 1
            elif byte in _OPENING:
                if whole_cells and byte != _LIST and self._expects_cell():
                    whole_cells, cells_end = False, self._whole_cells(data, at)
                    if cells_end > at:
                        at = cells_end
                        continue
                self._open(byte == _LIST, at)
                at += 1
            elif byte in _CLOSING:
                at += 1
                self._close(byte == _END_OF_LIST, data, at)
            else:
                if not last and _WORD.match(data, at).end() == end and end - at < _LONGEST_LITERAL:
                    break  # it may go on in the next chunk
                match = _SCALAR.match(data, at)
                if match is None:
                    raise NotJson("no value")
                self._expect_value()
                self._add(self._scalar(match.group()))
                at = match.end()
        if self._raw is not None:
            self._raw.append(data[self._raw_from:at])
        self._rest = data[at:]

    def _expects_cell(self) -> bool:
        top = self._stack[-1] if self._stack else None
        return top is not None and top.form is _DOCUMENT["cells"] and top.path == ("cells",) and top.wants in ("value", "value or end")

    def _whole_cells(self, data: bytes, at: int) -> int:
        """Adds the cells from ``at`` on that are whole in ``data``; gives the place after them.

        What is odd about a cell, or wrong, is left to the reading by signs: that starts at the first cell not added.
        """
        # Halves of characters are replaced there.
        if _SURROGATE.search(data, at):
            return at
        try:
            text, _ = codecs.utf_8_decode(data[at:], "strict", False)
        except UnicodeDecodeError:
            return at
        top, here = self._stack[-1], 0
        while (found := _whole_cell(text, here)) is not None:
            cell, outputs, here = found
            top.node.append(_record(cell, len(top.node), outputs))
            top.wants = "comma or end"
            following = _NEXT_CELL.match(text, here)
            if following is None:
                break
            here, top.wants = following.end(), "value"
        return at + len(text[:here].encode())

    def _in_string(self, data: bytes, at: int, last: bool) -> tuple[int, bool]:
        while True:
            stop = _PLAIN.match(data, at).end()
            self._string.append(data[at:stop])
            at = stop
            if at == len(data):
                return at, False
            if data[at] == _QUOTE:
                raw, self._string = b"".join(self._string), None
                self._end_of_string(raw)
                return at + 1, True
            if data[at] != _BACKSLASH:
                raise NotJson("control character")
            size = 6 if data[at + 1:at + 2] == b"u" else 2
            if len(data) - at < size:
                if last:
                    raise NotJson("text ends early")
                return at, False
            escape = data[at:at + size]
            if size == 2 and escape[1] not in _ESCAPES or size == 6 and not re.fullmatch(rb"\\u[0-9a-fA-F]{4}", escape):
                raise NotJson("bad escape")
            self._string.append(escape)
            at += size

    def _end_of_string(self, raw: bytes) -> None:
        top = self._stack[-1] if self._stack else None
        is_key = top is not None and not top.is_list and top.wants in ("key", "key or end")
        # Keys are read wherever one may matter, values only where they are kept.
        kept = self._form_of_key(top) if is_key else self._form_of_value() in (TEXT, LINES)
        if not kept:
            text = ""
        elif b"\\" in raw:
            text = json.loads(b'"' + raw + b'"').encode("utf-8", "replace").decode()
        else:
            text = raw.decode("utf-8", "replace")
        if is_key:
            top.key, top.wants = text, "colon"
        else:
            self._add(text)

    @staticmethod
    def _form_of_key(top: _Frame) -> bool:
        return top.form is KEYS or isinstance(top.form, dict)

    def _form_of_value(self) -> Any:
        if not self._stack:
            return _DOCUMENT
        top = self._stack[-1]
        if top.is_list:
            return TEXT if top.form is LINES else top.form.get("*") if isinstance(top.form, dict) else SKIP
        return top.form.get(top.key) if isinstance(top.form, dict) and top.key != "*" else SKIP

    def _expect_value(self) -> None:
        if self._stack and self._stack[-1].wants not in ("value", "value or end"):
            raise NotJson("value out of place")

    def _expect_value_or_key(self) -> None:
        if self._stack and self._stack[-1].wants not in ("value", "value or end", "key", "key or end"):
            raise NotJson("text out of place")

    def _scalar(self, raw: bytes) -> Any:
        if raw in (b"true", b"false", b"null"):
            return json.loads(raw)
        if _INTEGER.fullmatch(raw):
            # Beyond a long, a number is no integer of the format.
            return int(raw) if len(raw) < 21 else _OTHER
        return _OTHER if raw[-1:].isdigit() else raw.decode()

    def _path(self) -> tuple:
        if not self._stack:
            return ()
        top = self._stack[-1]
        return (*top.path, "*" if top.is_list else top.key)

    def _open(self, is_list: bool, at: int) -> None:
        self._expect_value()
        form, path = self._form_of_value(), self._path() if len(self._stack) < 5 else ("deep",)
        # An object where a list is wanted, or the other way round, is passed over.
        if isinstance(form, dict):
            form = form if is_list == ("*" in form) else SKIP
        elif form is KEYS:
            form = SKIP if is_list else KEYS
        elif form is LINES:
            form = LINES if is_list else SKIP
        else:
            form = SKIP
        frame = _Frame(is_list, form, path)
        if form is SKIP:
            frame.node = _OTHER
        self._stack.append(frame)
        if path == ("cells", "*"):
            self._outputs = []
        elif path == ("cells", "*", "outputs"):
            self._outputs = []
        elif path == ("cells", "*", "outputs", "*"):
            self._raw, self._raw_from = [], at

    def _close(self, is_list: bool, data: bytes, at: int) -> None:
        if not self._stack or self._stack[-1].is_list != is_list:
            raise NotJson("wrong bracket")
        frame = self._stack[-1]
        if frame.wants not in ("comma or end", "value or end" if is_list else "key or end"):
            raise NotJson("value missing")
        self._stack.pop()
        if frame.path == ("cells", "*", "outputs", "*"):
            self._outputs.append(b"".join([*self._raw, data[self._raw_from:at]]).decode("utf-8", "replace"))
            self._raw = None
        self._add(frame.node)

    def _between(self, colon: bool) -> None:
        top = self._stack[-1] if self._stack else None
        if top is None or top.wants != ("colon" if colon else "comma or end"):
            raise NotJson("sign out of place")
        top.wants = "value" if colon or top.is_list else "key"

    def _add(self, value: Any) -> None:
        """A complete value, to the container it stands in."""
        if not self._stack:
            self._value, self._done = value, True
            return
        top = self._stack[-1]
        if top.form is not SKIP:
            path = (*top.path, "*") if top.is_list else ()
            if path == ("cells", "*"):
                value, self._outputs = _record(value, len(top.node), self._outputs), []
            elif path == ("cells", "*", "outputs", "*") and not isinstance(value, dict):
                self._outputs.append(json.dumps(None if isinstance(value, _Other) else value))
            if top.is_list:
                top.node.append(value)
            else:
                top.node[top.key] = None if top.form is KEYS else value
        top.wants = "comma or end"


def read_notebook(text: bytes | memoryview, chunk_bytes: int = CHUNK_BYTES) -> dict[str, Any] | None:
    """The light document of ``text``, or None if it is no notebook."""
    reader = NotebookReader()
    try:
        for start in range(0, len(text), chunk_bytes):
            reader.feed(bytes(text[start:start + chunk_bytes]))
        return reader.close()
    except NotJson:
        return None


def large_document(text: Column, chunk_bytes: int = CHUNK_BYTES) -> Column:
    """The struct ``LARGE`` of each text; NULL for NULL and for what is no notebook."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(LARGE)

    @F.arrow_udf(LARGE)
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([None if t.as_buffer() is None else read_notebook(memoryview(t.as_buffer()), chunk_bytes) for t in texts], kind)

    return read(text)
