"""License scans with a positional index of rare words.

The templates' words are few, so their index is small and fixed: for each word, in which templates it stands and where. How
rare the words are is counted in the corpus itself. In a file, each template is looked up by the rarest of its words that
the file has: every occurrence fixes where the template would start. At each such place the other words are compared by
relative position. A template counts if enough of its words stand where they should and its mandatory phrase stands
there whole; a phrase is a template that must match whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nbquarry.llm.common import col, free_name

# The phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Template(NamedTuple):
    label: str
    text: str
    phrase: str


# Common licence notices, with the words that must stand in them.
TEMPLATES = [
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

# Share of a template's words that must stand where they should. A notice may lack so many words, and a template is looked up
# by one rare word more, so none is missed.
LEAST_SHARE = 0.7

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits, lower-cased in A-Z; characters beyond ASCII are letters."""
    return _WORDS((text or "").encode().lower())


def _spare(text: str) -> int:
    """Words that a notice may lack."""
    size = len(text.split())
    return size - math.ceil(LEAST_SHARE * size)


class Index:
    """The templates' words and, per template, the rarest ones to look for."""

    def __init__(self, templates: list[Template], phrases: dict[str, str], frequencies: dict[str, int], documents: int):
        self._rarity = {w: math.log((documents + 1) / (n + 1)) for w, n in frequencies.items()}
        self._phrases = [(p.encode().split(), label, self._rarest(p, 1)) for p, label in phrases.items()]
        self._templates = [
            (t.text.encode().split(), t.label, self._rarest(t.text, _spare(t.text) + 1), t.phrase.encode().split(), self._rarest(t.phrase, 1)) for t in templates
        ]
        self._known = frozenset(vocabulary(templates, phrases))

    def _rarest(self, text: str, n: int) -> list[tuple[bytes, int]]:
        """``(word, position)`` of the ``n`` rarest words, the rarest first; equally rare ones in order."""
        positions = {w: i for i, w in reversed(list(enumerate(text.split())))}
        chosen = sorted(positions, key=lambda w: (-self._rarity.get(w, math.inf), positions[w]))[:n]
        return [(w.encode(), i) for w in chosen for i, other in enumerate(text.split()) if other == w]

    @staticmethod
    def _starts(postings: dict[bytes, list[int]], anchors: list[tuple[bytes, int]]) -> Iterator[int]:
        for word, offset in anchors:
            for at in postings.get(word, ()):
                yield at - offset

    def scan(self, text: str | None) -> dict:
        """Words, base places, labels and spans of one text."""
        found = words(text)
        postings: dict[bytes, list[int]] = {}
        for i in [i for i, w in enumerate(found) if w in self._known]:
            postings.setdefault(found[i], []).append(i)
        base = [
            (start, len(phrase), label) for phrase, label, anchors in self._phrases for start in set(self._starts(postings, anchors))
            if start >= 0 and found[start:start + len(phrase)] == phrase
        ]
        spans, score = set(base), 1.0 if base else 0.0
        for template, label, anchors, phrase, phrase_anchors in self._templates:
            places = {s for s in self._starts(postings, phrase_anchors) if s >= 0 and found[s:s + len(phrase)] == phrase}
            if not places:
                continue
            for start in set(self._starts(postings, anchors)):
                begin = max(start, 0)
                there = found[begin:start + len(template)]
                share = sum(a == b for a, b in zip(template[begin - start:], there)) / len(template)
                if share >= LEAST_SHARE and any(start <= s and s + len(phrase) <= start + len(template) for s in places):
                    spans.add((begin, len(there), label))
                    score = max(score, share)
        starts = [s for s, _, _ in base]
        return {
            "n_words": len(found), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({label for _, _, label in base})), "labels": ",".join(sorted({label for _, _, label in spans})), "score": score,
            "spans": [{"start": s, "words": n, "label": label} for s, n, label in sorted(spans)],
        }


def vocabulary(templates: list[Template], phrases: dict[str, str]) -> set[bytes]:
    return {w for text in [*phrases, *(t.text for t in templates), *(t.phrase for t in templates)] for w in text.encode().split()}


def document_frequencies(docs: DataFrame, known: set[bytes], text: str = "text") -> DataFrame:
    """``(word, n)``: documents with each of the ``known`` words, and ``n`` of all documents under the empty word."""
    known = frozenset(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen[b""] += batch.num_rows
            for value in batch.column(0):
                seen.update(known.intersection(words(value.as_py())))
        yield pa.record_batch([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select(col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<start: long, words: long, label: string>>"
)
FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def scan(docs: DataFrame, text: str = "text", templates: list[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``docs`` with the fields of ``FIELDS``; columns of these names are replaced.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` concern the phrases only; ``labels`` also has those of templates,
    ``score`` is the best share of a template's words in place (1 for a phrase) and ``spans`` says where. NULL and empty
    texts have no words, no places (NULL first and last) and empty labels.
    """
    # One row for each word of the templates.
    counts = {r.word: r.n for r in document_frequencies(docs, vocabulary(templates, phrases), text).collect()}
    index = Index(templates, phrases, {w: n for w, n in counts.items() if w}, counts.get("", 0))

    @F.arrow_udf(_RESULT)
    def of(texts: pa.Array) -> pa.Array:
        types = pa.struct([
            *((n, pa.int64()) for n in FIELDS[:4]), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))),
        ])
        return pa.array([index.scan(t.as_py()) for t in texts], types)

    scanned = free_name(docs, "scanned")
    return docs.withColumn(scanned, of(col(text))).withColumns({f: col(scanned)[f] for f in FIELDS}).drop(scanned)
