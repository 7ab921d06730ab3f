"""Quality rules whose cutoffs follow the data: quantile sketches per language and source.

Each document has a few rates (symbols, capitals, repeated lines and words, word length). A rate is rejected where it lies
far above the upper quartile of its language and source, measured by the spread between the quartiles, both on a
logarithmic scale: beyond Tukey's outer fence. Nothing else decides; no rate has a fixed cutoff.

Rates are of counts, and a count of zero has no logarithm and says little in a short text. So the sketches hold what a rate
would be with one event more, and a document is judged by what it would be with one less: a single event rejects
nothing. Quartiles come from sketches with logarithmic buckets: a count per bucket, so sketches merge by adding counts, in
any order and with the same result, and their relative error is at most twice ``ACCURACY``. A group's fence is drawn
towards that of its language, and a language's towards that of all, the more the fewer documents it has. In merged sketches
all sources weigh the same, and no group's limit lies beyond what they allow: a source full of junk can't excuse it,
however large it is.

Everything here is DataFrame functions. Texts are never shuffled: only bucket counts are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from nbquarry.llm.common import col, free_name, stored

# The base rule.
LEAST_WORDS = 50
MOST_REPEATED = 0.5
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# Repeated windows are looked up in a list up to this length; longer lists are sorted into place.
FEW = 16
# Half the relative width of a bucket.
ACCURACY = 0.01
# A group's own fence counts like its number of documents, the one it is drawn to like so many.
DRAWN = 30
# A language's bound counts like its number of sources, that of all like so many.
SOURCES = 4
# The weight of a source in merged sketches, as whole numbers add up the same in any order.
WEIGHT = 1 << 32
# A rate is too high beyond the upper quartile plus this many spreads: the outer fence.
SPREADS = 3.0
RATES = ["symbol_rate", "capital_rate", "dup_line_rate", "repeat_rate", "word_length"]
# Rates by which a document is judged, next to those that are sketched.
JUDGED = {r: f"least_{r}" for r in RATES}

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, though ``then`` may mention it for each element of an array."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three that the text has twice or more. Windows are compared by 64-bit hash."""
    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def by_sort(windows: Column) -> Column:
        """Positions of repeated windows: after sorting, a neighbour is equal."""
        def kept(runs: Column) -> Column:
            equal = lambda x, k: F.coalesce(F.get(runs, k)["g"] == x["g"], F.lit(False))
            return F.transform(F.filter(runs, lambda x, k: equal(x, k - 1) | equal(x, k + 1)), lambda x: x["i"])

        return _let(F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), kept)

    def by_list(windows: Column, repeated: Column) -> Column:
        return F.filter(F.transform(windows, lambda g, i: F.when(F.array_contains(repeated, g), i)), lambda i: i.isNotNull())

    def count(windows: Column) -> Column:
        twice = lambda runs: F.array_distinct(F.filter(runs, lambda g, k: F.coalesce(F.get(runs, k + 1) == g, F.lit(False))))
        found = lambda repeated: F.when(F.size(repeated) == 0, F.lit(0)).otherwise(
            _let(F.sort_array(F.when(F.size(repeated) <= FEW, by_list(windows, repeated)).otherwise(by_sort(windows))), covered)
        )
        return _let(_let(F.sort_array(windows), twice), found)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) >= 4, _let(windows, count)).otherwise(0).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the base rule, ``base_failed`` and two columns for each rate: as sketched, and as judged.

    All of ``docs`` stays, but for columns of these names, which are replaced. A NULL text counts as empty: no words, failed.
    """
    whole = F.coalesce(col(text), F.lit(""))
    words, lines, of_lines, of_capitals = (free_name(docs, n) for n in ("words_of_text", "lines_of_text", "events_of_lines", "events_of_capitals"))
    pieces = docs.withColumns({
        words: F.filter(F.split(whole, WHITE), lambda w: w != ""),
        lines: F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    count = lambda c: F.length(c).cast("long")
    counted = pieces.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": count(F.array_join(words, "")),
        "n_symbols": count(whole) - count(F.regexp_replace(whole, SYMBOLS, "")),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _let(col(words), _repeat_words),
        of_lines: F.struct((F.size(lines) - F.size(F.array_distinct(lines))).alias("n"), F.size(lines).alias("size")),
        of_capitals: F.struct((F.length(whole) - F.length(F.regexp_replace(whole, r"\p{Lu}", ""))).alias("n"), F.length(whole).alias("size")),
    }).drop(words, lines)
    events = {
        "symbol_rate": (F.col("n_symbols"), F.col("n_words")), "capital_rate": (col(of_capitals)["n"], col(of_capitals)["size"]),
        "dup_line_rate": (col(of_lines)["n"], col(of_lines)["size"]), "repeat_rate": (F.col("n_repeat_words"), F.col("n_words")),
    }
    word_length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    more = {r: (n + 1) / (size + 1) for r, (n, size) in events.items()} | {"word_length": word_length}
    fewer = {JUDGED[r]: F.greatest(n - 1, F.lit(0)) / (size + 1) for r, (n, size) in events.items()} | {JUDGED["word_length"]: word_length}
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumns({"base_failed": failed, **more, **fewer}).drop(of_lines, of_capitals)


def _names(lang: str | None, source: str | None) -> list[Column]:
    """Group values with a mark for NULL, so that NULL is a group like any other."""
    return [F.concat(F.lit("="), col(c).cast("string")) if c else F.lit("=") for c in (lang, source)]


def sketches(featured: DataFrame, lang: str | None = "lang", source: str | None = "source") -> DataFrame:
    """``(lang_group, source_group, rate, bucket, n)``: mergeable quantile sketches of the rates of sound documents.

    Bucket ``k`` counts values in ``(g^(k-1), g^k]`` with ``g = (1 + a) / (1 - a)``; all are above zero. Sketches merge by adding
    ``n``. Documents that fail the base rule are left out.
    """
    base = math.log((1 + ACCURACY) / (1 - ACCURACY))
    group_lang, group_source = (F.coalesce(c, F.lit("-")) for c in _names(lang, source))
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).cast("double").alias("value")) for r in RATES]))
    long = featured.where(~F.col("base_failed")).select(group_lang.alias("lang_group"), group_source.alias("source_group"), rates.alias("r"))
    bucket = F.ceil(F.log("r.value") / base).cast("int")
    return long.groupBy("lang_group", "source_group", F.col("r.rate").alias("rate"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def limits(sketch: DataFrame) -> DataFrame:
    """``(lang_group, source_group)`` and the highest accepted value of each rate, from sketches of the groups."""
    base = math.log((1 + ACCURACY) / (1 - ACCURACY))

    def quartiles(keys: list[str], counted: DataFrame) -> DataFrame:
        merged = counted.groupBy(*keys, "rate", "bucket").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
        upto, whole = Window.partitionBy(*keys, "rate").orderBy("bucket"), Window.partitionBy(*keys, "rate")
        ranked = merged.withColumns({"upto": F.sum("weight").over(upto), "all": F.sum("weight").over(whole), "total": F.sum("n").over(whole)})
        # The upper end of a bucket (and a little more, for rounding), so that no quartile lies below its values.
        end = F.col("bucket") * base + 1e-9
        at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), end))
        found = ranked.groupBy(*keys, "rate").agg(at(0.25).alias("low"), at(0.75).alias("high"), F.first("total").alias("total"))
        return found.select(*keys, "rate", "total", (F.col("high") + SPREADS * (F.col("high") - F.col("low"))).alias("fence"))

    def evenly(keys: list[str]) -> DataFrame:
        """Counts of the sources ``keys``, each with the same weight in all."""
        merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
        share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "rate"))
        return merged.withColumn("weight", F.ceil(share * WEIGHT))

    group, language, everything = ["lang_group", "source_group"], ["lang_group"], []
    renamed = lambda df, tag: df.withColumnsRenamed({c: f"{c}_{tag}" for c in ("fence", "total")})
    sources = sketch.groupBy("lang_group", "rate").agg(F.count_distinct("source_group").alias("sources"))
    joined = (
        renamed(quartiles(group, sketch.withColumn("weight", F.col("n"))), "0")
        .join(renamed(quartiles(language, evenly(group)), "1"), ["lang_group", "rate"]).join(sources, ["lang_group", "rate"])
        .join(renamed(quartiles(everything, evenly(["source_group"])), "2"), ["rate"])
    )
    # Logarithms throughout. Each fence is drawn to the next larger group's.
    drawn = lambda k, to: (F.col(f"total_{k}") * F.col(f"fence_{k}") + DRAWN * to) / (F.col(f"total_{k}") + DRAWN)
    bound = (F.col("sources") * F.col("fence_1") + SOURCES * F.col("fence_2")) / (F.col("sources") + SOURCES)
    limit = F.exp(F.least(drawn(0, drawn(1, F.col("fence_2"))), bound))
    columns = [F.max(F.when(F.col("rate") == r, limit)).alias(f"most_{r}") for r in RATES]
    return joined.groupBy(*group).agg(*columns)


def judge(featured: DataFrame, limits: DataFrame, lang: str | None = "lang", source: str | None = "source") -> DataFrame:
    """``featured`` with ``kept``: not ``base_failed``, and no rate above the limit of its group."""
    lang_key, source_key = free_name(featured, "lang_group"), free_name(featured, "source_group")
    names = [F.coalesce(c, F.lit("-")) for c in _names(lang, source)]
    keyed = featured.withColumns({lang_key: names[0], source_key: names[1]})
    most = limits.withColumnsRenamed({"lang_group": lang_key, "source_group": source_key})
    fits = [F.coalesce(F.col(JUDGED[r]) <= F.col(f"most_{r}"), F.lit(True)) for r in RATES]
    kept = ~F.col("base_failed")
    for fit in fits:
        kept = kept & fit
    joined = keyed.join(most, [lang_key, source_key], "left").withColumn("kept", kept)
    return joined.drop(lang_key, source_key, *[f"most_{r}" for r in RATES])


def filter_documents(docs: DataFrame, text: str = "text", lang: str | None = "lang", source: str | None = "source") -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``.

    Rates are worked out once and stored beside the documents; sketches and verdicts read them there. A NULL text counts as
    empty and goes, as every text below ``LEAST_WORDS`` words does. NULL languages and sources are groups like any other; ids
    play no role. Repeated rows are judged alike, texts may have any length, an empty table stays empty.
    """
    inside = "document"
    whole = docs.select(F.struct("*").alias(inside))
    texts = whole.select(inside, *[col(inside)[c].alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source")) if c])
    featured = stored(features(texts).drop("text"))
    lang, source = lang and "lang", source and "source"
    table = stored(limits(stored(sketches(featured, lang, source))))
    return judge(featured, table, lang, source).where("kept").select(f"{inside}.*")
