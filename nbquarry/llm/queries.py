"""The registered queries of the operators and the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from nbquarry.llm import bpe, ctw, html, licenses, linededup, mixing, negatives, oracles, packing, quality, simhash, topk, trie, urls
from nbquarry.llm.common import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(query):
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"), _word_bpe())


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = stored(quality.features(_table(spark, sf_dir, "documents")).drop("text"))
    judged = quality.judge(featured, stored(quality.limits(quality.sketches(featured))))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


@_query("op1_mixing", oracles.OP1_MIXING)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


# The rules of the query.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@_query("op7_urls", oracles.OP7_URLS)
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


@_query("op2_top_k", oracles.OP2_TOP_K)
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query("op6_licenses")
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f for f in licenses.FIELDS if f != "spans"])


@_query("op8_ctw")
def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.score_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@_query("op4_html")
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query("op11_conversation_trie", oracles.OP11_TRIE)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie.prefix_trie(rebuilt(trie.sequences(_table(spark, sf_dir, "conversations"))))
    return found.drop("node", "parent", "turn")


def rebuilt(found: DataFrame) -> DataFrame:
    """The query's conversations: each begins with the first turns of the one whose number is the next lower multiple of 20."""
    own = found.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "shared": F.crc32(F.col("conv_id").cast("string")) % 4})
    heads = found.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), trie.part_of(F.col("turns"), 0, 3).alias("head"))
    head = F.coalesce(trie.part_of(F.col("head"), 0, F.col("shared")), F.lit(b""))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, trie.part_of(F.col("turns"), F.col("shared"))).alias("turns"))


@_query("op12_line_dedup", oracles.OP12_LINES)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query("op13_hard_negatives", oracles.OP13_NEGATIVES)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
