"""Page layout queries, over word boxes that Spark derives from the documents' lines, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import chunking, layout
from docquarry.plans.texts import AS_MARKDOWN, COLLAPSED, LINES, LOW, MD, UNITS
from docquarry.sources.tables import table


def rows(s: SparkSession, d: str) -> DataFrame:
    return layout.rows_from_words(layout.word_boxes(chunking.document_lines(table(s, d, "documents"))))


def rows_from_words(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d).select("doc_id", "page", "row_no", "y0", "y1", F.md5("text").alias("text"))


def paragraph_gaps(s: SparkSession, d: str) -> DataFrame:
    return layout.with_gaps(rows(s, d)).where("gap").select("doc_id", "page", "row_no")


def margin_rows(s: SparkSession, d: str) -> DataFrame:
    kept = layout.without_margins(rows(s, d), height=600.0)
    return kept.groupBy("doc_id", "page").agg(F.count("*").alias("n_rows"))


def heading_echo(s: SparkSession, d: str) -> DataFrame:
    """Lines of the documents that print a section of one of their chunks."""
    outline = table(s, d, "chunks").select(F.col("document_id").alias("doc_id"), F.col("section").alias("title"))
    return layout.printed_headings(chunking.document_lines(table(s, d, "documents")), outline)


def front_matter(s: SparkSession, d: str) -> DataFrame:
    """Lines with text of each document told again as markdown that do not stand under a chapter to skip."""
    units = chunking.units(chunking.document_lines(chunking.as_markdown(table(s, d, "chunks"))))
    return layout.without_front_matter(units).where("kind = 'text'").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (rows_from_words, paragraph_gaps, margin_rows, heading_echo, front_matter)}


ROWS = f"""{LINES}, r0 AS (SELECT doc_id, CAST((line_no - 1) // 50 AS INT) AS page, (line_no - 1) % 50 AS row, line FROM li WHERE line <> ''),
    rw AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY row) - 1 AS row_no, row * CAST(12 AS DOUBLE) AS y0, row * CAST(12 AS DOUBLE) + 10 AS y1, line FROM r0)"""


def oracle_sql() -> dict[str, str]:
    return {
        "rows_from_words": f"WITH {ROWS} SELECT doc_id, page, row_no, y0, y1, md5(line) AS text FROM rw",
        "paragraph_gaps": f"WITH {ROWS} SELECT doc_id, page, row_no FROM rw QUALIFY y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY row_no) > 8",
        "margin_rows": f"WITH {ROWS} SELECT doc_id, page, count(*) AS n_rows FROM rw WHERE y1 > 51 AND y0 < 522 GROUP BY ALL",
        "heading_echo": f"""WITH {LINES}, r AS (SELECT doc_id, line_no, {LOW.format(COLLAPSED.format('line'))} AS own FROM li WHERE line <> ''),
            n AS (SELECT *, lead(own) OVER w AS after, lag(own) OVER w AS before FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
            t AS (SELECT DISTINCT document_id AS doc_id, {LOW.format(COLLAPSED.format('section'))} AS title FROM chunks WHERE section IS NOT NULL)
            SELECT DISTINCT n.doc_id, line_no FROM n JOIN t ON t.doc_id = n.doc_id AND title <> '' AND title IN (own, own || ' ' || after, before || ' ' || own)""",
        "front_matter": f"""WITH {AS_MARKDOWN}, {UNITS}, h AS (SELECT *, CASE WHEN is_head AND length(regexp_extract(line, {MD}, 1)) <= 1 THEN
            regexp_matches(lower(trim(regexp_extract(line, {MD}, 2))), '^(?:[0-9]+\\s+)?(contents|table of contents|list of tables|list of figures|index|revision history|document revision history|important (security )?notice)\\b') END AS skip FROM md4 WHERE line = '' OR noise IS NULL),
            k AS (SELECT *, last_value(skip IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS skipped FROM h)
            SELECT doc_id, count(*) AS n_lines FROM k WHERE line <> '' AND NOT is_head AND NOT coalesce(skipped, false) GROUP BY doc_id""",
    }
