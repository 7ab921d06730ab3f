"""License scans against a scan of every position."""

import random
import re

import pytest

from nbquarry.llm import licenses
from nbquarry.llm.queries import QUERIES

TEXTS = [
    None, "", "  ", "MIT License", "mit-license mit. license MITLICENSE", "The GNU General  Public\nLicense, version 3.", "cc by cc by-NC 4.0",
    "Licensed under the Apache License, Version 2.0.", "apache licenseX apache\u00e9 license apache license", "All rights reserved.",
    "Permission is hereby granted, free of charge, to any body getting a copy of this software", "gnu gnu general public license general public license",
    "license " * 5000 + "mit license", "permission is hereby granted free of charge",
]


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    full = set(labels)
    for t in licenses.TEMPLATES:
        w, p = t.text.split(), t.phrase.split()
        for start in range(-len(w) + 1, len(words)):
            same = sum(0 <= start + i < len(words) and words[start + i] == x for i, x in enumerate(w))
            inside = any(words[start + i:start + i + len(p)] == p for i in range(len(w) - len(p) + 1) if start + i >= 0)
            if same >= licenses.LEAST_SHARE * len(w) and inside:
                full.add(t.label)
    join = lambda x: ",".join(sorted(x))
    return len(words), len(places), min(places, default=None), max(places, default=None), join(labels), join(full)


def random_text(rng):
    known = [w.decode() for w in licenses.vocabulary(licenses.TEMPLATES, licenses.PHRASES)]
    parts = [rng.choice([t.text for t in licenses.TEMPLATES]).split() if rng.random() < 0.3 else [rng.choice(known + ["x"] * 20)] for _ in range(30)]
    words = [w for p in parts for w in p if rng.random() < 0.97]
    return " ".join(words)


def test_scan(spark):
    rng = random.Random(7)
    texts = TEXTS + [random_text(rng) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, scanned int")
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(found) == len(texts) and found[0].scanned == 1
    for i, text in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == plain(text), text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and (r.score == 1 or not r.base_labels)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "text string")).count() == 0


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op6_licenses"](spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == plain(texts[r.doc_id])
