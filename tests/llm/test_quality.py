"""Quality rules against plain Python, and what the limits adapt to."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from nbquarry.llm import quality
from nbquarry.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def sentence(i, n=60):
    return " ".join(f"word{(i * 7919 + k * k * 31) % 10007}" for k in range(n))


TEXTS = [
    None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a a a", "x\ny\nx\n\n\n x\nx \nx", "# * $ % & | < > ## é \x0b ñ", "same line\n" * 40,
    sentence(1), sentence(2) + "\n" + sentence(2), sentence(3) + " end " + sentence(3)[:200], "word " * 30_000, "é" * 100 + " " + sentence(4, 50_000),
    " ".join(sentence(k % 40, 12) for k in range(60)),
]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, words_of_text string")
    found = {r.doc_id: r for r in quality.features(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = found[i]
        assert (*[r[c] for c in quality.BASE], r.base_failed) == plain(t), i
        assert r.words_of_text == "x"


def table(spark):
    rows = []
    for i in range(300):
        rows.append((i, sentence(i), "en", "clean"))
        rows.append((1000 + i, " ".join(w + "#" for w in sentence(i).split()), "en", "tables"))
        rows.append((2000 + i, sentence(i).upper() if i % 10 == 0 else sentence(i), "en", None))
    rows += [(5000, " ".join(w + "%" for w in sentence(7).split()), "en", "clean"), (5001, sentence(9), None, "new"), (5002, "short", "en", "clean")]
    return rows, spark.createDataFrame([(*r, "y", 3) for r in rows], "doc_id long, text string, lang string, source string, kept string, document int")


def test_limits_follow_the_group(spark):
    rows, docs = table(spark)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # A source of symbols is normal for itself; the same document elsewhere is not.
    assert set(ids) == {i for i, *_ in rows} - {5000, 5002} - {2000 + i for i in range(0, 300, 10)} and len(ids) == len(set(ids))


def test_sketches_merge_and_are_accurate(spark):
    _, docs = table(spark)
    featured = quality.features(docs)
    whole = quality.limits(quality.sketches(featured))
    halves = [quality.sketches(featured.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    merged = quality.limits(halves[0].unionByName(halves[1]))
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect()))


def exact_limits(rows):
    """Limits of each (lang, source) from sorted values, for rows ``(lang, source, {rate: value})``."""
    def fence(weighted):
        upto, low, high = 0.0, None, None
        whole = sum(w for _, w in weighted)
        for value, w in sorted(weighted):
            upto += w
            low = value if low is None and upto >= 0.25 * whole - 1e-9 else low
            high = value if high is None and upto >= 0.75 * whole - 1e-9 else high
        return math.log(high) + quality.SPREADS * (math.log(high) - math.log(low))

    def evenly(chosen, key):
        sizes = Counter(key(r) for r in chosen)
        return [(r[2], 1 / sizes[key(r)]) for r in chosen]

    out = {}
    for rate in quality.RATES:
        flat = [(lang, source, values[rate]) for lang, source, values in rows]
        of_all = fence(evenly(flat, lambda r: r[1]))
        for lang, source in {r[:2] for r in flat}:
            mine, same = [r for r in flat if r[:2] == (lang, source)], [r for r in flat if r[0] == lang]
            of_language, sources = fence(evenly(same, lambda r: r[1])), len({r[1] for r in same})
            drawn = lambda n, own, to: (n * own + quality.DRAWN * to) / (n + quality.DRAWN)
            own = drawn(len(mine), fence([(r[2], 1) for r in mine]), drawn(len(same), of_language, of_all))
            out[lang, source, rate] = min(own, (sources * of_language + quality.SOURCES * of_all) / (sources + quality.SOURCES))
    return out


def test_limits_are_those_of_exact_quantiles(spark):
    """And the sketches decide: nothing else rejects a document past the base rule."""
    featured = quality.features(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).drop("text")
    table = quality.limits(quality.sketches(featured))
    found = {(r.lang_group[1:], r.source_group[1:], rate): math.log(r[f"most_{rate}"]) for r in table.collect() for rate in quality.RATES}
    rows = featured.collect()
    expected = exact_limits([(r.lang, r.source, r) for r in rows if not r.base_failed])
    assert found.keys() == expected.keys()
    # Two quartiles, each within the width of a bucket.
    slack = (1 + 2 * quality.SPREADS) * 2.1 * quality.ACCURACY
    assert all(abs(found[k] - expected[k]) <= slack for k in found)
    kept = {r.doc_id: r.kept for r in quality.judge(featured, table).collect()}
    fits = lambda r, more: all(r[j] <= 0 or math.log(r[j]) <= expected[r.lang, r.source, q] + more for q, j in quality.JUDGED.items())
    for r in rows:
        if r.base_failed or not fits(r, slack):
            assert not kept[r.doc_id]
        elif fits(r, -slack):
            assert kept[r.doc_id]
    assert sum(not r.base_failed and not kept[r.doc_id] for r in rows) > 40


def test_no_group_size_changes_limits_at_once(spark):
    rows = [(i, sentence(i), "en", f"s{i % 7}") for i in range(700)] + [(5000 + i, sentence(3 * i).upper() if i % 4 else sentence(i), "en", "grows") for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    featured = quality.features(docs).drop("text").cache()
    limit = lambda n: math.log(quality.limits(quality.sketches(featured.where(F.col("doc_id") < 5000 + n))).where("source_group = '=grows'").first().most_word_length)
    before, after = limit(199), limit(201)
    assert abs(before - after) < 0.05
    featured.unpersist()


def test_a_source_does_not_excuse_its_own_junk(spark):
    rows = [(1000 * s + i, sentence(i + s), "en", f"s{s}") for s in range(8) for i in range(210)]
    # The hot source has more rows than the others together, and a third of them are junk.
    rows += [(10_000 + i, " ".join(w + "#" * (2 * (i % 3 == 0)) for w in sentence(i).split()), "en", "hot") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.filter_documents(docs).collect()}
    assert kept == {i for i, text, *_ in rows if "#" not in text}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.filter_documents(docs).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in QUERIES["op3_quality"](spark, sf).collect():
        assert (*[r[c] for c in quality.BASE], r.base_failed) == plain(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
        if r.doc_id in labels and not r.base_failed:
            assert r.kept == bool(labels[r.doc_id])
