"""Notebook documents: decoding fetched contents, and the archive of originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nbquarry.functions import documents as D
from nbquarry.functions.large import CHUNK_BYTES, large_document
from nbquarry.functions.names import archive_name, owner_of, repo_of, sanitize_name, short_sha
from nbquarry.sources import archive_files

# A VARIANT holds 128 MiB. Its encoding of a text takes less than four times the text's bytes, so texts up to this fit.
LARGE_BYTES = 32 << 20
_ARCHIVE_PATH = r"/([^/]+)/([^/]+)/([^/]+)$"


def utf8_text(raw: Column) -> Column:
    """Bytes as text; invalid sequences become the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def decoded_text(encoding: Column, content: Column, download_body: Column) -> Column:
    """The file's text from base64 ``content``, or else from the separately fetched body; NULL if neither is usable."""
    whole_groups = lambda letters: F.when(F.length(letters) % 4 == 0, F.try_to_binary(letters, F.lit("base64")))
    unwrapped = F.replace(F.replace(content, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))
    # Other characters outside the alphabet are ignored too; the slow pattern only sees content that has some.
    raw = F.coalesce(whole_groups(unwrapped), whole_groups(F.regexp_replace(content, "[^A-Za-z0-9+/=]", "")))
    in_line = (encoding == "base64") & content.isNotNull()
    return F.when(in_line, utf8_text(raw)).otherwise(download_body)


def decode_contents(contents: DataFrame, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """Replace the encoded columns by ``doc``, a VARIANT that is NULL where no notebook could be read.

    Texts above ``large_bytes`` are read as a stream instead, into ``large``: metadata, light cells and the text of each output
    (``functions.large.LARGE``), with the whole text as ``raw``. At most one of the two columns is filled.
    """
    encoded = ["encoding", "content", "download_body"]
    text = decoded_text(*[F.col(c) for c in encoded])
    return with_document(contents.select(*[c for c in contents.columns if c not in encoded], text.alias("_text")), large_bytes)


def with_document(rows: DataFrame, large_bytes: int = LARGE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc`` and ``large`` for the column ``_text``. Short texts never leave the JVM."""
    is_large = F.octet_length("_text") > large_bytes
    read = D.computed_once(rows.withColumn("_large", large_document(F.when(is_large, F.col("_text")), chunk_bytes)), "_large")
    raw = F.struct("_large.*", F.col("_text").alias("raw"))
    parsed = read.withColumns({
        "large": F.when(F.col("_large").isNotNull(), raw), "_parsed": D.parse_json(F.when(~is_large, F.col("_text"))),
    }).drop("_large", "_text")
    return D.computed_once(parsed.withColumn("doc", D.usable_document(F.col("_parsed"))).drop("_parsed"), "doc")


def read_notebook_archive(spark: SparkSession, base: str, hadoop: bool = False, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """``(owner, repo, archive_name, path, doc, large)`` from files ``base/owner/repo/{sha8}_{name}.ipynb``.

    Both last columns are NULL where a file is no notebook. Small files share tasks, and conditions on owner and repository
    decide which folders are listed (see ``archive_files``). With ``hadoop`` Spark's own source for files is used, for stores that
    only Spark can open. Plans are better served by the packed table of :func:`write_notebook_archive`.
    """
    if hadoop:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.ipynb").load(base)
        part = lambda k: F.regexp_extract("path", _ARCHIVE_PATH, k)
        files = files.select(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("archive_name"), "path", "content")
    else:
        archive_files.register(spark)
        files = spark.read.format(archive_files.NAME).load(base)
    rows = files.select("owner", "repo", "archive_name", "path", utf8_text(F.col("content")).alias("_text"))
    return with_document(rows, large_bytes)


def write_archive_files(notebooks: DataFrame, base: str, mode: str = "overwrite") -> None:
    """Keep the decoded originals as named files, as :func:`read_notebook_archive` finds them. ``append`` adds to what is there."""
    archive_files.register(notebooks.sparkSession)
    rows = archive_rows(notebooks).select("owner", "repo", "archive_name", "raw")
    rows.write.format(archive_files.NAME).mode(mode).save(base)


def archive_row(notebooks: DataFrame, sha: Column) -> Column:
    """A decoded notebook as a struct: sanitized owner and repository, archive name, short hash, document text."""
    full_name, text = F.col("repo_full_name"), F.to_json("doc")
    return F.struct(
        sanitize_name(owner_of(full_name)).alias("owner"),
        sanitize_name(repo_of(full_name)).alias("repo"),
        archive_name(sha, F.col("file_path")).alias("archive_name"),
        short_sha(sha).alias("sha8"),
        (F.coalesce(text, F.col("large.raw")) if "large" in notebooks.columns else text).alias("raw"),
    )


def archive_rows(notebooks: DataFrame) -> DataFrame:
    """The archive rows of the decoded notebooks."""
    return notebooks.where(D.is_decoded(notebooks)).select(archive_row(notebooks, F.col("file_sha")).alias("a")).select("a.*")


def write_notebook_archive(notebooks: DataFrame, path: str) -> None:
    """Keep the decoded originals as one parquet table rather than one small file each."""
    archive_rows(notebooks).write.mode("overwrite").parquet(path)


def read_archive_table(spark: SparkSession, path: str) -> DataFrame:
    """The table written by :func:`write_notebook_archive`, in the shape of :func:`read_notebook_archive`."""
    rows = spark.read.parquet(path).select("owner", "repo", "archive_name", F.col("raw").alias("_text"))
    return with_document(rows)
