"""Passages: how they are shown, found by page or id, counted and replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.lines import PAGE_NUMBER, signature


def heading_path(chapter: Column, section: Column) -> Column:
    """``chapter > section``, or the one there is; a chapter equal to its section stands once. Nulls are empty."""
    chapter, section = F.coalesce(chapter, F.lit("")), F.coalesce(section, F.lit(""))
    both = F.when(section == "", chapter).otherwise(F.concat(chapter, F.lit(" > "), section))
    return F.when((chapter != "") & (chapter != section), both).otherwise(section)


def embedding_text(chapter: Column, section: Column, text: Column) -> Column:
    """The text under its heading path, unless it starts with that already."""
    path, text = heading_path(chapter, section), F.coalesce(text, F.lit(""))
    return F.when((path == "") | F.startswith(text, path), text).otherwise(F.concat(path, F.lit("\n"), text))


def location(first: Column, last: Column) -> Column:
    """``p. 3`` or ``pp. 3-4``; empty without a first page; no range to page 0 or to the same page."""
    span = F.concat(F.lit("pp. "), first.cast("string"), F.lit("-"), last.cast("string"))
    one = F.concat(F.lit("p. "), first.cast("string"))
    return F.when(first.isNull(), "").when(F.coalesce(last, F.lit(0)).isin(0) | (last == first), one).otherwise(span)


def citation(source: Column, first: Column, last: Column) -> Column:
    """The source and, if known, the place in it."""
    at = location(first, last)
    return F.when(at == "", F.coalesce(source, F.lit(""))).otherwise(F.concat(F.coalesce(source, F.lit("")), F.lit(", "), at))


def with_source(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the source of their document; chunks of none are left out."""
    return chunks.join(documents.select(F.col("doc_id").alias("document_id"), "source"), "document_id")


def on_page(chunks: DataFrame, page: int) -> DataFrame:
    """Chunks that start on, or range over, a page, and all chunks without pages."""
    first, last = F.col("page_start"), F.col("page_end")
    return chunks.where(first.isNull() | (first == page) | F.coalesce(F.lit(page).between(first, last), F.lit(False)))


def fetch_in_order(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks of (list_id, ids) in each list's order; ids that are not stored are left out."""
    ids = wanted.select("list_id", F.posexplode("ids").alias("pos", "chunk_id"))
    return ids.join(chunks, "chunk_id")


def replace_documents(stored: DataFrame, incoming: DataFrame, key: str = "document_id") -> DataFrame:
    """``stored`` with all rows of the documents in ``incoming`` replaced by the incoming ones."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.select(*stored.columns))


def upsert(stored: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``updates`` put in place of those of the same key; keys of ``updates`` are unique."""
    return stored.join(updates.select(key), key, "left_anti").unionByName(updates.select(*stored.columns))


def delete_documents(documents: DataFrame, chunks: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the deleted doc_ids; their chunks go with them."""
    gone = deleted.select("doc_id").distinct()
    kept = documents.join(gone, "doc_id", "left_anti")
    return kept, chunks.join(gone, chunks["document_id"] == gone["doc_id"], "left_anti")


def page_lines(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, line_no, n_lines, line): the lines of each passage, taken as a page; null texts have none."""
    lines = F.split(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    cut = chunks.where("text is not null").select("document_id", "chunk_id", lines.alias("lines"))
    return cut.select("document_id", "chunk_id", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "line")).withColumn("line_no", F.col("at") + 1).drop("at")


def running_lines(chunks: DataFrame, *, edge: int = 3, least_share: float = 0.4, least_pages: int = 4) -> DataFrame:
    """(chunk_id, line_no) of running headers and footers of each document's pages.

    Only the first and last ``edge`` lines of a page are looked at. A line goes
    if its signature is on at least two and ``least_share`` of the document's
    pages, of which there are at least ``least_pages``, or if it is a page
    number. Counting happens by document and signature, never by page alone.
    """
    n = F.col("n_lines")
    edges = page_lines(chunks).where((F.col("line_no") <= edge) | (F.col("line_no") > n - edge)).withColumn("sig", signature(F.col("line")))
    pages = chunks.where("text is not null").groupBy("document_id").agg(F.count("*").alias("pages"))
    met = edges.where("sig <> ''").groupBy("document_id", "sig").agg(F.countDistinct("chunk_id").alias("on_pages"))
    need = F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(least_share)))
    repeated = met.join(pages, "document_id").where((F.col("pages") >= least_pages) & (F.col("on_pages") >= need)).select("document_id", "sig", F.lit(True).alias("repeated"))
    marked = edges.join(repeated, ["document_id", "sig"], "left")
    return marked.where(F.col("repeated") | F.col("sig").rlike(PAGE_NUMBER)).select("chunk_id", "line_no")


def document_profile(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: characters, chunks stored, letters and digits in them, first and last page; pages ignore nulls."""
    alnum = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]"))
    per = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(
        F.count("*").alias("n_stored"), F.sum(alnum).cast("bigint").alias("n_alnum"), F.min("page_start").alias("first_page"), F.max(F.greatest("page_start", "page_end")).alias("last_page")
    )
    sized = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    return sized.join(per, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_stored", F.lit(0)).alias("n_stored"), F.coalesce("n_alnum", F.lit(0)).alias("n_alnum"), "first_page", "last_page")


def ordered_chunks(chunks: DataFrame, documents: DataFrame, source: str) -> DataFrame:
    """The chunks of one source in the order of its documents and of their indexes."""
    order = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    found = with_source(chunks, documents.where(F.col("source") == source))
    return found.withColumn("place", F.row_number().over(order))
