"""Rows, margins, paragraphs and printed headings of pages, from the boxes of their words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.lines import SKIPPED_CHAPTER
from docquarry.functions.text import collapsed, lowered


def word_boxes(lines: DataFrame, *, pitch: float = 12.0, per_page: int = 50) -> DataFrame:
    """(doc_id, page, x0, y0, y1, word): a box for each word of numbered lines, as if set with ``per_page`` lines a page.

    Lines stand ``pitch`` points apart and ten points high; a blank line leaves
    its room free. ``x0`` is the word's place in its line.
    """
    place = (F.col("line_no") - 1) % per_page
    words = lines.where("line <> ''").select("doc_id", ((F.col("line_no") - 1) / per_page).cast("int").alias("page"), place.alias("row"), F.posexplode(F.split("line", " ")).alias("x", "word"))
    return words.select("doc_id", "page", F.col("x").cast("double").alias("x0"), (F.col("row") * pitch).alias("y0"), (F.col("row") * pitch + 10.0).alias("y1"), "word")


def rows_from_words(boxes: DataFrame, *, tolerance: float = 2.5) -> DataFrame:
    """(doc_id, page, row_no, y0, y1, text): words whose baselines lie within ``tolerance`` of the one before are a row, from left to right."""
    page = Window.partitionBy("doc_id", "page").orderBy("y1", "x0", "word")
    breaks = (F.col("y1") - F.lag("y1").over(page) > tolerance).cast("int")
    numbered = boxes.withColumn("row_no", F.sum(F.coalesce(breaks, F.lit(0))).over(page))
    rows = numbered.groupBy("doc_id", "page", "row_no").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.array_sort(F.collect_list(F.struct("x0", "word"))).alias("w"))
    return rows.select("doc_id", "page", "row_no", "y0", "y1", F.array_join(F.col("w.word"), " ").alias("text"))


def without_margins(rows: DataFrame, *, height: float, top: float = 0.085, bottom: float = 0.87) -> DataFrame:
    """Rows that reach into the page between the two margins, given as shares of its height."""
    return rows.where((F.col("y1") > top * height) & (F.col("y0") < bottom * height))


def with_gaps(rows: DataFrame) -> DataFrame:
    """``rows`` with ``gap``: whether more room than 0.8 of the row's height (of at least 6 points) is above it, as before a paragraph."""
    page = Window.partitionBy("doc_id", "page").orderBy("row_no")
    room = F.col("y0") - F.lag("y1").over(page)
    return rows.withColumn("gap", F.coalesce(room > 0.8 * F.greatest(F.col("y1") - F.col("y0"), F.lit(6.0)), F.lit(False)))


def printed_headings(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """(doc_id, line_no): body lines that print a heading of the outline (doc_id, title) again, on one row or broken over two.

    Compared in lower case with single blanks. Lines meet titles by document
    and text, so nothing is compared within a document in all pairs.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    norm = lowered(collapsed(F.col("line")))
    rows = lines.where("line <> ''").select("doc_id", "line_no", norm.alias("own"))
    near = rows.withColumn("after", F.lead("own").over(order)).withColumn("before", F.lag("own").over(order))
    forms = F.array_compact(F.array(F.col("own"), F.concat("own", F.lit(" "), "after"), F.concat("before", F.lit(" "), "own")))
    titles = outline.where("title is not null").select("doc_id", lowered(collapsed(F.col("title"))).alias("form")).where("form <> ''").distinct()
    return near.select("doc_id", "line_no", F.explode(forms).alias("form")).join(titles, ["doc_id", "form"], "left_semi").select("doc_id", "line_no").distinct()


def without_front_matter(units: DataFrame) -> DataFrame:
    """Units of a document but those under a chapter without content of its own (contents, index, notices), and its heading."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    chapter = F.when((F.col("kind") == "heading") & (F.col("level") <= 1), F.col("text").rlike(SKIPPED_CHAPTER))
    return units.withColumn("skipped", F.coalesce(F.last(chapter, ignorenulls=True).over(order), F.lit(False))).where("not skipped").drop("skipped")
