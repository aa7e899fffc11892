"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import identifiers, names
from docquarry.operators import catalog, search
from docquarry.plans import layouts, lifecycle, searches, texts
from docquarry.sources.tables import table

ASK = {"q_id": "id", "q_text": "question", "id_col": "doc_id", "text_col": "text"}


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(s, d, "eval_questions"), table(s, d, "documents"), **ASK)


def hybrid_passages(s: SparkSession, d: str) -> DataFrame:
    return search.hybrid_passages(table(s, d, "eval_questions"), table(s, d, "chunks"))


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return search.cosine_topk(v.where("vec_id % 50 = 0"), v)


def build_terms(s: SparkSession, d: str) -> DataFrame:
    return search.postings(table(s, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def catalog_stats(s: SparkSession, d: str) -> DataFrame:
    return catalog.catalog_stats(table(s, d, "documents"), table(s, d, "chunks"))


def snapshot_actions(s: SparkSession, d: str) -> DataFrame:
    """The log up to the middle of its time is the stored snapshot, what was taken in after it the found one."""
    return catalog.snapshot_actions(*lifecycle.halves(s, d))


def missing_chunks(s: SparkSession, d: str) -> DataFrame:
    return catalog.missing_chunks(table(s, d, "documents"), table(s, d, "chunks"))


def latest_files(s: SparkSession, d: str) -> DataFrame:
    return catalog.latest_files(table(s, d, "source_files")).select("file_id", "source", "sha256", "n_chunks")


def duplicate_texts(s: SparkSession, d: str) -> DataFrame:
    return catalog.duplicate_texts(table(s, d, "documents"))


def register_names(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "chunks").select("chunk_id", F.explode(F.array_distinct(identifiers(F.col("text")))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n_chunks"))


def register_names_all(s: SparkSession, d: str) -> DataFrame:
    found = table(s, d, "chunks").select("chunk_id", F.explode(F.array_distinct(names(F.col("text")))).alias("name"))
    return found.groupBy("name").agg(F.count("*").alias("n_chunks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (bm25_topk, vector_topk, build_terms, catalog_stats, latest_files, duplicate_texts, register_names, register_names_all, hybrid_passages, snapshot_actions, missing_chunks)
    return {f.__name__: f for f in every} | texts.queries() | searches.queries() | lifecycle.queries() | layouts.queries()


WHOLE_NAMES = r"list_transform(list_filter(string_split_regex({0}, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z][A-Za-z0-9]*(_[A-Za-z0-9]+)+')), lambda w: lower(w))"
TOK = "regexp_extract_all(lower(replace({0}, 'İ', ' ')), '[a-z0-9_]+')"
NAME = "regexp_extract_all({0}, '[A-Z]+[0-9][A-Z0-9]*_[A-Z0-9]+')"
BM25 = f"""
    tok AS (SELECT doc_id AS pid, unnest({TOK.format('text')}) AS term FROM documents),
    post AS (SELECT pid, term, count(*) AS tf FROM tok GROUP BY ALL),
    sz AS (SELECT doc_id AS pid, len({TOK.format("coalesce(text, '')")}) AS l FROM documents),
    st AS (SELECT count(*) AS n, avg(l) AS al FROM sz),
    d AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    ask AS (SELECT DISTINCT id AS qid, unnest({TOK.format('question')}) AS term FROM eval_questions),
    sc AS (SELECT qid, pid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score
           FROM ask JOIN post USING (term) JOIN d USING (term) JOIN sz USING (pid), st GROUP BY ALL),
    bm AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM sc QUALIFY rank <= 10)"""
HASHED = r"list_transform(list_filter(regexp_extract_all(lower(replace({0}, 'İ', 'i ')), '[a-z0-9]+'), lambda t: t <> ''), lambda t: md5(t))"
STRIP = r"regexp_replace({0}, '^[\s\pZ\x0B\x1C-\x1F\x{{85}}]+|[\s\pZ\x0B\x1C-\x1F\x{{85}}]+$', '', 'g')"
# BM25 over chunks under their headings, hashed vectors of 256 counts, both to 30, and the reference's boost by section
PASSAGES = f"""
    c0 AS (SELECT chunk_id AS pid, coalesce(chapter, '') AS ch, coalesce(section, '') AS section, coalesce(text, '') AS text FROM chunks),
    c1 AS (SELECT *, CASE WHEN ch <> '' AND ch <> section THEN CASE WHEN section = '' THEN ch ELSE ch || ' > ' || section END ELSE section END AS path FROM c0),
    c AS (SELECT pid, section, text, CASE WHEN path = '' OR starts_with(text, path) THEN text ELSE path || chr(10) || text END AS full_text FROM c1),
    tok AS (SELECT pid, unnest({TOK.format('full_text')}) AS term FROM c),
    post AS (SELECT pid, term, count(*) AS tf FROM tok GROUP BY ALL),
    sz AS (SELECT pid, len({TOK.format('full_text')}) AS l FROM c),
    st AS (SELECT count(*) AS n, avg(l) AS al FROM sz),
    d AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    ask AS (SELECT DISTINCT id AS qid, unnest({TOK.format('question')}) AS term FROM eval_questions),
    sc AS (SELECT qid, pid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score
           FROM ask JOIN post USING (term) JOIN d USING (term) JOIN sz USING (pid), st GROUP BY ALL),
    bm AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM sc QUALIFY rank <= 30),
    ph AS (SELECT pid, unnest({HASHED.format('full_text')}) AS h FROM c),
    qh AS (SELECT id AS qid, unnest({HASHED.format("coalesce(question, '')")}) AS h FROM eval_questions),
    pv AS (SELECT pid, h[1:2] AS b, sum(CASE WHEN h[7] >= '8' THEN 1 ELSE -1 END) AS x FROM ph GROUP BY ALL),
    qv AS (SELECT qid, h[1:2] AS b, sum(CASE WHEN h[7] >= '8' THEN 1 ELSE -1 END) AS x FROM qh GROUP BY ALL),
    pl AS (SELECT pid, sqrt(sum(x * x)) AS l FROM pv GROUP BY pid), ql AS (SELECT qid, sqrt(sum(x * x)) AS l FROM qv GROUP BY qid),
    dt AS (SELECT qid, pid, sum(qv.x * pv.x) AS dot FROM qv JOIN pv USING (b) GROUP BY ALL),
    cs AS (SELECT id AS qid, c.pid, round(coalesce(dot / nullif(ql.l * pl.l, 0), 0), 6) AS score FROM eval_questions CROSS JOIN c
           LEFT JOIN dt ON dt.qid = id AND dt.pid = c.pid LEFT JOIN ql ON ql.qid = id LEFT JOIN pl ON pl.pid = c.pid),
    vr AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM cs QUALIFY rank <= 30),
    fu AS (SELECT qid, pid, sum(1 / (60 + rank)) AS fused, min(vrank) AS vrank FROM (SELECT qid, pid, rank, rank AS vrank FROM vr UNION ALL SELECT qid, pid, rank, NULL FROM bm) GROUP BY ALL),
    nm AS (SELECT id AS qid, unnest({WHOLE_NAMES.format('question')}) AS name FROM eval_questions),
    ba AS (SELECT qid, name, regexp_replace(name, '^[^_]*_', '') AS rest, regexp_extract(split_part(name, '_', 1), '^(gpio)[a-k]$', 1)
           || regexp_extract(split_part(name, '_', 1), '^(tim|usart|uart|spi|i2c|i2s|dma|adc|can|dac|otg)[0-9]+$', 1) AS base FROM nm),
    va AS (SELECT qid, name AS v FROM ba UNION SELECT qid, base || 'x_' || rest FROM ba WHERE base <> '' UNION SELECT qid, base || '_' || rest FROM ba WHERE base <> ''),
    bo AS (SELECT qid, pid, text, vrank, round(fused + CASE WHEN EXISTS (SELECT 1 FROM va WHERE va.qid = fu.qid AND contains(lower(section), v)) THEN 1 / 61 ELSE 0 END, 9) AS score FROM fu JOIN c USING (pid)),
    fi AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vrank NULLS LAST, pid) AS r FROM bo QUALIFY r <= 10),
    un AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY qid, {STRIP.format('text')} ORDER BY r) = 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "bm25_topk": f"WITH {BM25} SELECT qid, pid, score, CAST(rank AS INT) AS rank FROM bm",
        "vector_topk": """WITH s AS (SELECT q.vec_id AS qid, p.vec_id AS pid, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
            FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id)
            SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS INT) AS rank FROM s QUALIFY rank <= 5""",
        "build_terms": f"WITH t AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term",
        "catalog_stats": """SELECT source, count(*) AS n_docs, CAST(count(*) FILTER (complete) AS BIGINT) AS n_complete, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_chunks, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS n_chars
            FROM documents LEFT JOIN (SELECT document_id, count(*) AS c FROM chunks GROUP BY 1) ON document_id = doc_id GROUP BY source""",
        "latest_files": """SELECT file_id, source, sha256, n_chunks FROM source_files
            QUALIFY row_number() OVER (PARTITION BY source, sha256 ORDER BY ingested_at DESC NULLS LAST, reported_at DESC NULLS LAST, file_id DESC) = 1""",
        "duplicate_texts": "SELECT md5(text) AS text_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
        "register_names": f"WITH t AS (SELECT DISTINCT chunk_id, unnest({NAME.format('text')}) AS name FROM chunks) SELECT name, count(*) AS n_chunks FROM t GROUP BY name",
        "register_names_all": f"WITH t AS (SELECT DISTINCT chunk_id, unnest({WHOLE_NAMES.format('text')}) AS name FROM chunks) SELECT name, count(*) AS n_chunks FROM t GROUP BY name",
        "hybrid_passages": f"WITH {PASSAGES} SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY r) AS INT) AS rank FROM un QUALIFY rank <= 5",
        "snapshot_actions": """WITH h AS (SELECT make_timestamp((epoch_us(min(ingested_at)) + epoch_us(max(ingested_at))) // 2) AS half FROM source_files),
            f AS (SELECT s.*, ingested_at <= half AS early FROM source_files s, h WHERE source IS NOT NULL),
            n AS (SELECT * FROM f WHERE early IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, early ORDER BY ingested_at DESC, reported_at DESC NULLS LAST, file_id DESC) = 1)
            SELECT source, CASE WHEN o.file_id IS NULL THEN 'add' WHEN w.file_id IS NULL THEN 'remove'
                WHEN o.sha256 IS DISTINCT FROM w.sha256 OR o.chunker_sig IS DISTINCT FROM w.chunker_sig THEN 'update' WHEN o.complete THEN 'skip' ELSE 'resume' END AS action
            FROM (SELECT * FROM n WHERE early) o FULL JOIN (SELECT * FROM n WHERE NOT early) w USING (source)""",
        "missing_chunks": """SELECT doc_id, source, chunk_index FROM (SELECT doc_id, source, CAST(unnest(range(n_chunks)) AS INT) AS chunk_index FROM documents) w
            WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = w.doc_id AND c.chunk_index = w.chunk_index)""",
    } | texts.oracle_sql() | searches.oracle_sql() | lifecycle.oracle_sql() | layouts.oracle_sql()
