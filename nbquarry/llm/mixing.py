"""Mixing sources to target weights, exact to the word.

Every document gets a hash-random key. Within each source, documents are ordered by key and taken until the running
sum of their sizes meets the budget; a budget above the size of the source takes whole epochs first. The running sum is
a distributed one: sums by key range, then a prefix over those sums (``RANGES`` rows per source), then single keys within
the one range where the budget ends. What comes out is one cut per source, so documents themselves are never
shuffled or sorted: each compares its own key with the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from nbquarry.llm.common import col, free_name, stored

# The weights by rank of the source, repeating; the most copies of a source.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
WHITE = r"[\x20\x09-\x0D]+"
# Keys have 60 bits; the upper 16 name the range.
RANGE_BITS = 44


def words(text: Column) -> Column:
    """Number of words; zero for NULL."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")).cast("long")


def random_key(id: Column, text: Column, seed: str) -> Column:
    """60 bits that depend on the document alone, so reruns agree. Only equal documents share a key."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_name(source: Column) -> Column:
    """NULL is a source of its own, after all others."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("?"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS) -> DataFrame:
    """``(source_name, source_size, target)`` from ``(source_name, source_size)``, one row per source.

    Sources in code point order weigh ``weights``, repeating, and share ``share`` of all sizes. No target exceeds ``most``
    times the source's size; the excess goes to the others by weight. Sorted by how soon they reach that limit, the
    limited sources are the first ones, so one running sum finds them all. The windows run over one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumns({
        "rank": F.row_number().over(everything.orderBy("source_name")) - 1,
        "words_to_share": F.sum("source_size").over(everything) * share,
    })
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumns({"weight": weight, "limit": (F.col("source_size") * most).cast("double")})
    order = everything.orderBy(F.col("limit") / F.col("weight"), "source_name")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = weighed.withColumns({
        "left": F.col("words_to_share") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "weights_left": F.sum("weight").over(after),
    })
    limited = F.col("limit") / F.col("weight") <= F.col("left") / F.col("weights_left")
    # All that are not limited have the same level, that of the first of them.
    first = F.first(F.when(~limited, F.struct("left", "weights_left")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(limited, F.col("limit")).otherwise(F.col("weight") * first["left"] / first["weights_left"])
    return left.select("source_name", "source_size", target.alias("target"))


def cuts(keyed: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source of ``(source_name, size, key)``: target, whole epochs, and the key where the last one ends.

    ``cut_rest`` words are left for the ``cut_rows`` documents that have the key ``cut_key``.
    """
    ranges = stored(
        keyed.groupBy("source_name", F.shiftright("key", RANGE_BITS).alias("range")).agg(F.sum("size").alias("size"))
    )
    aims = targets(ranges.groupBy("source_name").agg(F.sum("size").alias("source_size")), weights, share, most)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    aims = stored(aims.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    upto = F.sum("size").over(Window.partitionBy("source_name").orderBy("range"))
    within = ranges.withColumn("before", upto - F.col("size")).join(aims.select("source_name", "rest"), "source_name")
    within = stored(
        within.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
        .select("source_name", "range", (F.col("rest") - F.col("before")).alias("rest"))
    )
    few = keyed.withColumn("range", F.shiftright("key", RANGE_BITS)).join(within, ["source_name", "range"])
    keys = few.groupBy("source_name", "rest", "key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    before = F.sum("size").over(Window.partitionBy("source_name").orderBy("key")) - F.col("size")
    ends = keys.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
    ends = ends.select("source_name", F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_rest"), F.col("rows").alias("cut_rows"))
    return stored(aims.join(ends, "source_name", "left").drop("rest"))


def take(keyed: DataFrame, cut: DataFrame, name: str, size: str, key: str) -> DataFrame:
    """``keyed`` with ``source_size``, ``target`` and ``taken``: the words the mix takes of each document.

    Documents below the cut are taken once more than the whole epochs. Equal documents at the cut share what is left.
    """
    last = F.when(col(key) < F.col("cut_key"), col(size)).when(
        col(key) == F.col("cut_key"), F.least(col(size), F.floor(F.col("cut_rest") / F.col("cut_rows")))
    ).otherwise(0)
    joined = keyed.join(cut.withColumnRenamed("source_name", name), name)
    return joined.withColumn("taken", (F.col("epochs") * col(size) + last).cast("long")).drop("epochs", "cut_key", "cut_rest", "cut_rows")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **settings) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs``.

    NULL and empty texts have size zero and are taken zero times. A NULL source is a source. Repeated rows are documents
    of their own. An empty table gives an empty result. Settings are those of ``targets``.
    """
    keyed = stored(docs.select(
        col(id).alias("doc_id"), words(col(text)).alias("size"), source_name(col(source)).alias("source_name"),
        random_key(col(id), col(text), seed).alias("key"),
    ))
    return take(keyed, cuts(keyed, **settings), "source_name", "size", "key").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    The document at which a source's budget ends is cut after the last word taken; documents not taken are absent.
    """
    name, size, key = (free_name(docs, n) for n in ("source_name", "size_in_words", "mix_key"))
    keyed = docs.select(F.struct("*").alias("document")).select(
        "document", source_name(F.col("document")[source]).alias(name), words(F.col("document")[text]).alias(size),
        random_key(F.col("document")[id], F.col("document")[text], seed).alias(key),
    )
    thin = stored(keyed.select(F.col(name).alias("source_name"), F.col(size).alias("size"), F.col(key).alias("key")))
    taken = take(keyed, cuts(thin, **settings), name, size, key).where("taken > 0")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / col(size)).cast("int"))))
    left = F.col("taken") - (F.col("copy") - 1) * col(size)
    whole = F.col("document")[text]
    cut = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)")), F.lit(1), left.cast("int")), "")
    result = F.when(left < col(size), cut).otherwise(whole)
    return copies.select(*[result.alias(c) if c == text else F.col("document")[c].alias(c) for c in docs.columns])
