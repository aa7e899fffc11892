"""Folders of documents, question files and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of the files that are documents, with the kind of each.
KINDS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "txt": "text"}


def described(found: DataFrame, folder: str) -> DataFrame:
    """(path, source, kind, sha256, content) of files read as ``binaryFile``, those that are documents.

    A document has one of the endings in ``KINDS`` in either case, and no part
    of its path under the folder starts with a dot or an underscore.
    """
    root = folder.split("://")[-1].rstrip("/") + "/"
    inner = F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), root, -1)
    ending = F.lower(F.element_at(F.split("path", "[.]"), -1))
    kind = F.coalesce(*[F.when(ending == e, k) for e, k in KINDS.items()])
    rows = found.select("path", inner.alias("inner"), F.element_at(F.split("path", "/"), -1).alias("source"), kind.alias("kind"), F.sha2("content", 256).alias("sha256"), "content")
    return rows.where(F.col("kind").isNotNull() & ~F.col("inner").rlike("(^|/)[._]")).drop("inner")


def discover_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in a folder and all folders in it, as ``described``; an empty folder has none."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), folder)


def load_texts(found: DataFrame) -> DataFrame:
    """(source, kind, sha256, text) of documents in markdown or plain text; bytes that are no UTF-8 become replacement characters."""
    return found.where("kind <> 'pdf'").select("source", "kind", "sha256", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answerable, must_include, note) of a JSON file with a list of questions.

    Defaults: ids ``q01``, ``q02`` and so on by place, answerable, nothing to
    include, no note. A bare word in ``must_include`` is a group of its own.
    """
    kind = "array<struct<id: string, question: string, answerable: boolean, must_include: array<string>, note: string>>"
    text = spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.from_json("value", kind)).alias("pos", "q"))
    # a group that is a list comes as its own JSON
    group = lambda g: F.when(F.startswith(g, F.lit("[")), F.from_json(g, "array<string>")).otherwise(F.array(g))
    return text.select(
        F.coalesce("q.id", F.format_string("q%02d", F.col("pos") + 1)).alias("id"), "q.question", F.coalesce("q.answerable", F.lit(True)).alias("answerable"),
        F.coalesce(F.transform("q.must_include", group), F.array().cast("array<array<string>>")).alias("must_include"), F.coalesce("q.note", F.lit("")).alias("note"),
    )


def write_report(rows: DataFrame, folder: str) -> None:
    """``report_rows`` as CSV with a header; no rows give files without any."""
    rows.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(folder)


def append_chunks(chunks: DataFrame, folder: str, *, buckets: int = 64) -> None:
    """Add chunks to a table kept by bucket of their source, so a source's chunks are found and replaced by one folder."""
    bucket = F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int")
    chunks.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(folder)
