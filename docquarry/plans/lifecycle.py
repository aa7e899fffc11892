"""Evaluation and intake queries, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import cited_ranks, contains_all, is_fallback
from docquarry.operators import catalog, chunking, evaluate, passages
from docquarry.plans.texts import AS_MARKDOWN, COLLAPSED, E, FOLD, LOW, UNITS
from docquarry.sources.tables import table


def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the intake log, newest record of each source: up to the middle of its time, and after it."""
    files = table(s, d, "source_files")
    half = files.agg(F.timestamp_micros(F.expr("(unix_micros(cast(min(ingested_at) as timestamp)) + unix_micros(cast(max(ingested_at) as timestamp))) div 2")).cast("timestamp_ntz").alias("half"))
    split = files.crossJoin(F.broadcast(half))  # half is one row
    at = F.col("ingested_at").cast("timestamp_ntz")
    return catalog.newest_by_source(split.where(at <= F.col("half"))), catalog.newest_by_source(split.where(at > F.col("half")))


def incremental_plan(s: SparkSession, d: str) -> DataFrame:
    done = {"add": "added", "update": "updated", "resume": "resumed", "skip": "unchanged", "remove": "removed"}
    act = F.element_at(F.create_map(*[F.lit(x) for pair in done.items() for x in pair]), F.col("action"))
    return catalog.snapshot_actions(*halves(s, d)).select("source", act.alias("action"))


def ingest_report(s: SparkSession, d: str) -> DataFrame:
    """How many sources each action takes, and the chunks stored of them."""
    stored = passages.with_source(table(s, d, "chunks"), table(s, d, "documents")).groupBy("source").agg(F.count("*").alias("c"))
    return incremental_plan(s, d).join(stored, "source", "left").groupBy("action").agg(F.count("*").alias("n_sources"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_chunks"))


def upsert_kv(s: SparkSession, d: str) -> DataFrame:
    """The earlier snapshot with the later one's records in place of those of the same source."""
    old, new = halves(s, d)
    return passages.upsert(old, new, "source").select("source", "sha256", "chunker_sig", "complete")


def resume_missing(s: SparkSession, d: str) -> DataFrame:
    """Chunks that the documents, cut anew, should have and that are not stored."""
    chunks = table(s, d, "chunks")
    wanted = chunking.chunk_documents(chunking.as_markdown(chunks)).select("doc_id", "chunk_index")
    return wanted.join(chunks.select(F.col("document_id").alias("doc_id"), "chunk_index"), ["doc_id", "chunk_index"], "left_anti")


def document_catalog(s: SparkSession, d: str) -> DataFrame:
    return catalog.document_catalog(table(s, d, "documents"), table(s, d, "chunks"))


def is_fallback_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_results").select("result_id", is_fallback(F.coalesce("answer", F.lit(""))).alias("is_fallback"))


def contains_all_rows(s: SparkSession, d: str) -> DataFrame:
    asked = F.broadcast(table(s, d, "eval_questions").select("id", "must_include"))  # 400 rows at every scale
    rows = table(s, d, "eval_results").select("result_id", "id", "answer").join(asked, "id")
    return rows.select("result_id", contains_all(F.coalesce("answer", F.lit("")), F.col("must_include")).alias("holds_all"))


def cited(s: SparkSession, d: str) -> DataFrame:
    ranks = cited_ranks(F.coalesce("answer", F.lit("")), 4)
    return table(s, d, "eval_results").select("result_id", F.array_join(F.transform(ranks, lambda n: n.cast("string")), ",").alias("ranks"))


def judged_results(s: SparkSession, d: str) -> DataFrame:
    return evaluate.judged(table(s, d, "eval_results"), table(s, d, "eval_questions"))


def eval_summary(s: SparkSession, d: str) -> DataFrame:
    return evaluate.eval_summary(table(s, d, "eval_results"))


def latency_stats(s: SparkSession, d: str) -> DataFrame:
    return evaluate.latency_stats(table(s, d, "eval_results"))


def suggest_threshold(s: SparkSession, d: str) -> DataFrame:
    return evaluate.suggest_threshold(table(s, d, "eval_results"))


def threshold_curve(s: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_curve(table(s, d, "eval_results"))


def report_rows(s: SparkSession, d: str) -> DataFrame:
    return evaluate.report_rows(table(s, d, "eval_results"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (incremental_plan, ingest_report, upsert_kv, resume_missing, document_catalog, judged_results, eval_summary, latency_stats, suggest_threshold, threshold_curve, report_rows)
    return {f.__name__: f for f in every} | {"cited_ranks": cited, "is_fallback": is_fallback_rows, "contains_all": contains_all_rows}


PACKED = "regexp_replace(" + LOW + ", '" + E + "+', '', 'g')"
FALLBACK = "(" + " OR ".join("contains(" + LOW.format("coalesce(answer, '')") + ", '" + h.replace("'", "''") + "')" for h in (
    "don't have that information", "do not have that information", "not in the provided", "bilgiye sahip değilim", "bilgi bulunmamaktadır", "belgelerde yer almıyor", "dokümanlarda yer almıyor")) + ")"
HOLDS = f"len(list_filter(must_include, lambda g: len(list_filter(g, lambda w: contains({PACKED.format("coalesce(answer, '')")}, {PACKED.format('w')}))) = 0)) = 0"
HALVES = """h AS (SELECT make_timestamp((epoch_us(min(ingested_at)) + epoch_us(max(ingested_at))) // 2) AS half FROM source_files),
    f AS (SELECT s.*, ingested_at <= half AS early FROM source_files s, h WHERE source IS NOT NULL),
    nw AS (SELECT * FROM f WHERE early IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, early ORDER BY ingested_at DESC, reported_at DESC NULLS LAST, file_id DESC) = 1),
    ip AS (SELECT source, CASE WHEN o.file_id IS NULL THEN 'added' WHEN w.file_id IS NULL THEN 'removed'
        WHEN o.sha256 IS DISTINCT FROM w.sha256 OR o.chunker_sig IS DISTINCT FROM w.chunker_sig THEN 'updated' WHEN o.complete THEN 'unchanged' ELSE 'resumed' END AS action
        FROM (SELECT * FROM nw WHERE early) o FULL JOIN (SELECT * FROM nw WHERE NOT early) w USING (source))"""


def pct(num: str, den: str) -> str:
    return f"CASE WHEN count(*) FILTER ({den}) = 0 THEN 'n/a' ELSE count(*) FILTER ({num}) || '/' || count(*) FILTER ({den}) || ' (' || CAST(round_even(100.0 * count(*) FILTER ({num}) / count(*) FILTER ({den}), 0) AS INT) || '%)' END"


def oracle_sql() -> dict[str, str]:
    can, no = "coalesce(answerable, false)", "NOT coalesce(answerable, false)"
    declined = "coalesce(declined, false)"
    return {
        "incremental_plan": f"WITH {HALVES} SELECT * FROM ip",
        "ingest_report": f"WITH {HALVES}, c AS (SELECT source, count(*) AS c FROM chunks JOIN documents ON doc_id = document_id GROUP BY 1) SELECT action, count(*) AS n_sources, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_chunks FROM ip LEFT JOIN c USING (source) GROUP BY action",
        "upsert_kv": f"WITH {HALVES} SELECT source, sha256, chunker_sig, complete FROM nw QUALIFY row_number() OVER (PARTITION BY source ORDER BY early) = 1",
        "resume_missing": f"WITH {AS_MARKDOWN}, {UNITS}, {FOLD} SELECT doc_id, chunk_index FROM folded WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = doc_id AND c.chunk_index = folded.chunk_index)",
        "document_catalog": "SELECT doc_id, source, complete, (SELECT count(*) FROM chunks WHERE document_id = doc_id) AS n_stored FROM documents",
        "is_fallback": f"SELECT result_id, {FALLBACK} AS is_fallback FROM eval_results",
        "contains_all": f"SELECT result_id, {HOLDS} AS holds_all FROM eval_results JOIN eval_questions USING (id)",
        "cited_ranks": r"""WITH a AS (SELECT result_id, list_filter(list_transform(regexp_extract_all(coalesce(answer, ''), '\[(\d{1,2})\]', 1), lambda x: CAST(x AS INT)), lambda n: n BETWEEN 1 AND 4) AS l FROM eval_results)
            SELECT result_id, array_to_string(list_filter(l, lambda n, i: list_position(l, n) = i), ',') AS ranks FROM a""",
        "judged_results": f"""SELECT result_id, declined_now, CASE WHEN answerable THEN NOT declined_now AND holds END AS keywords_now, CASE WHEN answerable THEN NOT declined_now AND holds ELSE declined_now END AS correct_now
            FROM (SELECT result_id, q.answerable, NOT coalesce(llm_called, false) OR {FALLBACK} AS declined_now, {HOLDS} AS holds FROM eval_results r JOIN eval_questions q USING (id))""",
        "eval_summary": f"""SELECT run_id, count(*) AS questions, {pct('correct', 'true')} AS overall, {pct(f'{can} AND keywords_ok', can)} AS answer_accuracy, {pct(f'{can} AND retrieval_hit', f'{can} AND retrieval_hit IS NOT NULL')} AS retrieval_hit,
            {pct(f'{can} AND {declined}', can)} AS false_declines, {pct(f'{no} AND {declined}', no)} AS decline_accuracy, {pct(f'NOT {declined} AND cited', f'NOT {declined}')} AS citation_rate FROM eval_results GROUP BY run_id""",
        "latency_stats": """WITH v AS (SELECT run_id, total_s, row_number() OVER (PARTITION BY run_id ORDER BY total_s) - 1 AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM eval_results WHERE llm_called AND total_s IS NOT NULL AND NOT isnan(total_s))
            SELECT run_id, round(avg(total_s), 6) AS mean_s, round(median(total_s), 6) AS median_s, round(max(total_s) FILTER (pos = CAST(round_even(CAST(0.95 AS DOUBLE) * (n - 1), 0) AS BIGINT)), 6) AS p95_s FROM v GROUP BY run_id""",
        "suggest_threshold": """WITH r AS (SELECT run_id, answerable, round(best_score, 4) AS s FROM eval_results WHERE best_score IS NOT NULL AND NOT isnan(best_score) AND answerable IS NOT NULL),
            both_kinds AS (SELECT run_id FROM r GROUP BY run_id HAVING count(*) FILTER (answerable) > 0 AND count(*) FILTER (NOT answerable) > 0),
            ds AS (SELECT DISTINCT run_id, s FROM r JOIN both_kinds USING (run_id)),
            cd AS (SELECT run_id, min(s) - 0.01 AS t FROM ds GROUP BY 1 UNION ALL SELECT run_id, coalesce((s + lead(s) OVER (PARTITION BY run_id ORDER BY s)) / 2, s + 0.01) FROM ds),
            jd AS (SELECT cd.run_id, t, count(*) FILTER (answerable AND s >= t) + count(*) FILTER (NOT answerable AND s < t) AS n_right, count(*) AS n FROM cd JOIN r USING (run_id) GROUP BY ALL),
            bs AS (SELECT * FROM jd QUALIFY n_right = max(n_right) OVER (PARTITION BY run_id)),
            pl AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t) AS k, count(*) OVER (PARTITION BY run_id) AS c FROM bs)
            SELECT run_id, round(t, 3) AS threshold, n_right, n FROM pl WHERE k = c // 2 + 1""",
        "threshold_curve": """SELECT CAST(floor(best_score / 0.05) AS BIGINT) AS bin, count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_other
            FROM eval_results WHERE best_score IS NOT NULL AND NOT isnan(best_score) GROUP BY 1""",
        "report_rows": f"""SELECT result_id, id, replace({COLLAPSED.format("coalesce(question, '')")}, '|', '\\|') AS question, substring(replace({COLLAPSED.format("coalesce(answer, '')")}, '|', '\\|'), 1, 400) AS answer,
            CASE WHEN correct IS NULL THEN 'open' WHEN correct THEN 'right' ELSE 'wrong' END AS verdict, '' AS manual_review FROM eval_results""",
    }
