"""Catalogue statistics, snapshot differences and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def catalog_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per source: documents, complete documents, chunks and characters; chunks are counted before they join."""
    n = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("c"))
    return documents.join(n, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("complete")).alias("n_complete"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"),
    )


def latest_files(files: DataFrame) -> DataFrame:
    """The newest record of every file, by time of intake, then of report, then id."""
    w = Window.partitionBy("source", "sha256").orderBy(F.desc("ingested_at"), F.desc("reported_at"), F.desc("file_id"))
    return files.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def document_catalog(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, source, complete, n_stored): every document with the number of its stored chunks, 0 of none."""
    n = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n_stored"))
    return documents.select("doc_id", "source", "complete").join(n, "doc_id", "left").fillna(0, ["n_stored"])


def chunker_signature(version: int, most: int, least: int, overlap: int) -> str:
    """What chunks depend on besides the text; another signature makes a source be taken in again."""
    return f"{version}:{most}:{least}:{overlap}"


def snapshot_actions(stored: DataFrame, found: DataFrame, *, force: bool = False) -> DataFrame:
    """(source, action) of what intake has to do, from one row a source (source, sha256, chunker_sig; ``stored`` also complete).

    ``add`` a new source, ``remove`` one no longer found, ``update`` one with
    other content or chunker settings, ``resume`` an incomplete one that is
    the same, ``skip`` a complete one. With ``force`` all that is found and
    stored is updated. Nothing is written: what comes out is the plan.
    """
    a = stored.select("source", F.col("sha256").alias("s0"), F.col("chunker_sig").alias("c0"), F.col("complete").alias("done"), F.lit(True).alias("had"))
    b = found.select("source", F.col("sha256").alias("s1"), F.col("chunker_sig").alias("c1"), F.lit(True).alias("has"))
    same = F.lit(not force) & F.col("s0").eqNullSafe(F.col("s1")) & F.col("c0").eqNullSafe(F.col("c1"))
    act = F.when(F.col("had").isNull(), "add").when(F.col("has").isNull(), "remove").when(~same, "update").when(F.coalesce("done", F.lit(False)), "skip").otherwise("resume")
    return a.join(b, "source", "full_outer").select("source", act.alias("action"))


def newest_by_source(files: DataFrame) -> DataFrame:
    """The newest record of every source, by time of intake, then of report, then id; null is no source."""
    order = F.struct("ingested_at", "reported_at", "file_id")
    return files.where("source is not null").groupBy("source").agg(F.max_by(F.struct("sha256", "chunker_sig", "complete"), order).alias("f")).select("source", "f.*")


def missing_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, source, chunk_index) of every chunk that a document should have (0 to n_chunks - 1) and that is not stored."""
    wanted = documents.where("n_chunks > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_index"))
    have = chunks.select(F.col("document_id").alias("doc_id"), "chunk_index")
    return wanted.join(have, ["doc_id", "chunk_index"], "left_anti").select("doc_id", "source", "chunk_index")


def duplicate_texts(documents: DataFrame) -> DataFrame:
    """(text_hash, first_id, copies) of every text stored more than once."""
    keyed = documents.where("text is not null").select(F.md5("text").alias("text_hash"), "doc_id")
    return keyed.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
