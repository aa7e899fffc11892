"""Search queries over the chunks and question set, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import answers, search
from docquarry.plans.texts import LOCATION, LOW, PATH, TERMS, VARIANTS, W
from docquarry.sources.tables import table


def ranked(s: SparkSession, d: str, **how) -> DataFrame:
    return search.ranked_passages(table(s, d, "eval_questions"), table(s, d, "chunks"), **how)


def shown(s: SparkSession, d: str) -> DataFrame:
    return search.shown_passages(ranked(s, d), table(s, d, "chunks"), table(s, d, "documents"))


def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return ranked(s, d).select("qid", "rank", "pid", "fused", "vector_rank", "keyword_rank")


def vector_only(s: SparkSession, d: str) -> DataFrame:
    return ranked(s, d, hybrid=False).select("qid", "rank", "pid", "fused", "vector_rank")


def identifier_boost(s: SparkSession, d: str) -> DataFrame:
    return ranked(s, d).where("boosted").select("qid", "pid")


def keyword_search(s: SparkSession, d: str) -> DataFrame:
    return search.keyword_topk(table(s, d, "eval_questions"), table(s, d, "chunks"))


def bm25_filtered(s: SparkSession, d: str) -> DataFrame:
    """Only chunks of two sources are returned; statistics are those of all chunks."""
    documents = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "source")
    return search.keyword_topk(table(s, d, "eval_questions"), table(s, d, "chunks").join(documents, "document_id", "left"), sources=["wiring.md", "rk6800.pdf"], k=10)


def bm25_prefix(s: SparkSession, d: str) -> DataFrame:
    return search.prefix_terms(table(s, d, "eval_questions"), table(s, d, "chunks"))


def phrase_match(s: SparkSession, d: str) -> DataFrame:
    return search.phrase_matches(table(s, d, "eval_questions"), table(s, d, "chunks"))


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    """Keyword and vector ranks of each question in one, without boost; ties to the lower id."""
    asked, chunks = table(s, d, "eval_questions"), table(s, d, "chunks")
    vector = search.hash_topk(asked, search.with_headings(chunks), q_id="id", q_text="question", id_col="pid", text_col="full")
    return search.fuse(search.keyword_topk(asked, chunks), vector, k=10)


def hash_embed(s: SparkSession, d: str) -> DataFrame:
    return search.hash_buckets(table(s, d, "documents"), "doc_id", "text")


def best_score(s: SparkSession, d: str) -> DataFrame:
    return answers.best_scores(table(s, d, "eval_questions"), table(s, d, "chunks"))


def gate(s: SparkSession, d: str) -> DataFrame:
    return answers.gate(best_score(s, d), least=0.25)


def vector_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    """The stated query set against the vectors of three labels only."""
    v = table(s, d, "embeddings")
    return search.cosine_topk(v.where("vec_id % 50 = 0"), v.where("label in (1, 2, 3)"))


def labels(s: SparkSession, d: str) -> DataFrame:
    return shown(s, d).select("qid", "rank", "label", "found_by")


def context_text(s: SparkSession, d: str) -> DataFrame:
    return answers.contexts(shown(s, d)).select("qid", F.md5("context").alias("context"), "n_passages")


def build_messages(s: SparkSession, d: str) -> DataFrame:
    asked = answers.messages(table(s, d, "eval_questions"), answers.contexts(shown(s, d)))
    return asked.select("qid", F.explode("messages").alias("m")).select("qid", "m.role", F.md5("m.content").alias("content"))


def extractive_answer(s: SparkSession, d: str) -> DataFrame:
    return answers.extractive_answers(table(s, d, "eval_questions"), shown(s, d))


def finalize_answers(s: SparkSession, d: str) -> DataFrame:
    """Every question answered: search, gate, extracted answer, citations."""
    asked = table(s, d, "eval_questions")
    found = shown(s, d)
    return answers.finalize(answers.extractive_answers(asked, found), found, gate(s, d))


def eval_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Every question's answer of ``finalize_answers`` judged against what it must include."""
    asked, found = table(s, d, "eval_questions"), shown(s, d)
    final = answers.finalize(answers.extractive_answers(asked, found), found, gate(s, d))
    return answers.verdicts(asked, final, answers.contexts(found)).select("qid", "declined", "keywords_ok", "retrieval_hit", "correct")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        hybrid_search, vector_only, identifier_boost, keyword_search, bm25_filtered, bm25_prefix, phrase_match, rrf_fusion, hash_embed, best_score, gate, vector_topk_filtered, labels,
        context_text, build_messages, extractive_answer, finalize_answers, eval_verdicts,
    )
    return {f.__name__: f for f in every}


TOKENS = "regexp_extract_all(" + LOW.format("coalesce({0}, '')") + r", '[\p{{L}}\p{{N}}]+')"
KEYWORDS = f"""
    kt AS (SELECT chunk_id AS pid, document_id, {TOKENS.format('text')} AS t0, {TOKENS.format('section')} AS t1, {TOKENS.format('chapter')} AS t2 FROM chunks),
    kl AS (SELECT pid, len(t0) + len(t1) + len(t2) AS l FROM kt),
    kn AS (SELECT count(*) AS n, avg(l) AS al FROM kl),
    kf AS (SELECT pid, 1.0 AS w, 0 AS f, unnest(range(1, len(t0) + 1)) AS at, unnest(t0) AS tok FROM kt UNION ALL SELECT pid, 2.0, 1, unnest(range(1, len(t1) + 1)), unnest(t1) FROM kt UNION ALL SELECT pid, 0.5, 2, unnest(range(1, len(t2) + 1)), unnest(t2) FROM kt),
    {TERMS},
    ut AS (SELECT DISTINCT t.term AS term, t.prefix AS prefix FROM terms),
    vo AS (SELECT DISTINCT tok FROM kf),
    vm AS (SELECT tok, term, prefix FROM vo JOIN ut ON NOT contains(term, ' ') AND NOT prefix AND tok = term UNION ALL SELECT tok, term, prefix FROM vo JOIN ut ON prefix AND left(tok, 4) = left(term, 4) AND starts_with(tok, term)),
    oc AS (SELECT pid, term, prefix, w FROM kf JOIN vm USING (tok) UNION ALL
        SELECT pid, term, prefix, w FROM (SELECT k.pid, u.term, u.prefix, k.w, list_transform(range(0, len(string_split(u.term, ' '))), lambda i: k.at + i) AS ats, string_split(u.term, ' ') AS ws, k.f, kt.t0, kt.t1, kt.t2
            FROM kf k JOIN ut u ON contains(u.term, ' ') AND k.tok = split_part(u.term, ' ', 1) JOIN kt ON kt.pid = k.pid)
        WHERE list_transform(ats, lambda i: CASE f WHEN 0 THEN t0[i] WHEN 1 THEN t1[i] ELSE t2[i] END) = ws),
    ff AS (SELECT pid, term, prefix, CAST(sum(w) AS DOUBLE) AS f FROM oc GROUP BY ALL),
    fd AS (SELECT term, prefix, count(*) AS df FROM ff GROUP BY ALL),
    fi AS (SELECT term, prefix, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM fd, kn),
    ks AS (SELECT qid, pid, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM terms JOIN ff ON ff.term = t.term AND ff.prefix = t.prefix JOIN fi ON fi.term = t.term AND fi.prefix = t.prefix JOIN kl USING (pid), kn GROUP BY ALL)"""
HASHED = r"list_transform(regexp_extract_all(lower(replace({0}, 'İ', 'i ')), '[a-z0-9]+'), lambda t: md5(t))"
VECTORS = f"""
    c AS (SELECT pid, document_id, section, text, CASE WHEN path = '' OR starts_with(text, path) THEN text ELSE path || chr(10) || text END AS full_text
        FROM (SELECT chunk_id AS pid, document_id, coalesce(section, '') AS section, coalesce(text, '') AS text, {PATH} AS path FROM chunks)),
    ph AS (SELECT pid, unnest({HASHED.format('full_text')}) AS h FROM c),
    qh AS (SELECT id AS qid, unnest({HASHED.format("coalesce(question, '')")}) AS h FROM eval_questions),
    pv AS (SELECT pid, h[1:2] AS b, sum(CASE WHEN h[7] >= '8' THEN 1 ELSE -1 END) AS x FROM ph GROUP BY ALL),
    qv AS (SELECT qid, h[1:2] AS b, sum(CASE WHEN h[7] >= '8' THEN 1 ELSE -1 END) AS x FROM qh GROUP BY ALL),
    pl AS (SELECT pid, sqrt(sum(x * x)) AS l FROM pv GROUP BY pid), ql AS (SELECT qid, sqrt(sum(x * x)) AS l FROM qv GROUP BY qid),
    dt AS (SELECT qid, pid, sum(qv.x * pv.x) AS dot FROM qv JOIN pv USING (b) GROUP BY ALL),
    cs AS (SELECT id AS qid, c.pid, round(coalesce(dot / nullif(ql.l * pl.l, 0), 0), 6) AS score FROM eval_questions CROSS JOIN c
        LEFT JOIN dt ON dt.qid = id AND dt.pid = c.pid LEFT JOIN ql ON ql.qid = id LEFT JOIN pl ON pl.pid = c.pid)"""
STRIPPED = f"regexp_replace({{0}}, '^{W}+|{W}+$', '', 'g')".replace("{Z}", "{{Z}}").replace("{0B}", "{{0B}}").replace("{1C}", "{{1C}}").replace("{1F}", "{{1F}}").replace("{85}", "{{85}}")


def rank_sql(hybrid: bool) -> str:
    both = "SELECT qid, pid, rank, rank AS v, NULL AS k FROM vr" + " UNION ALL SELECT qid, pid, rank, NULL, rank FROM kr" * hybrid
    keyword = f"{KEYWORDS}, kr AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM ks QUALIFY rank <= 30)," if hybrid else ""
    return f"""{keyword} {VECTORS},
    vr AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM cs QUALIFY rank <= 30),
    fu AS (SELECT qid, pid, sum(1 / (60 + rank)) AS fused, CAST(min(v) AS INT) AS vector_rank, CAST(min(k) AS INT) AS keyword_rank FROM ({both}) GROUP BY ALL),
    {VARIANTS},
    bo AS (SELECT *, round(fused + CASE WHEN boosted THEN 1 / 61 ELSE 0 END, 9) AS score FROM (SELECT qid, pid, text, vector_rank, keyword_rank, fused, EXISTS (SELECT 1 FROM va WHERE va.qid = fu.qid AND contains(lower(section), v)) AS boosted FROM fu JOIN c USING (pid))),
    fo AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vector_rank NULLS LAST, pid) AS r FROM bo QUALIFY r <= 8),
    on1 AS (SELECT * FROM fo QUALIFY row_number() OVER (PARTITION BY qid, {STRIPPED.format('text')} ORDER BY r) = 1),
    ranked AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY r) AS INT) AS rank, pid, score AS fused, vector_rank, keyword_rank, boosted FROM on1 QUALIFY rank <= 4)"""


SHOWN = f"""{rank_sql(True)},
    sh0 AS (SELECT r.*, d.source, coalesce(ch.text, '') AS text, {LOCATION} AS loc, coalesce(ch.section, '') AS sec, {PATH} AS path FROM ranked r JOIN chunks ch ON ch.chunk_id = pid JOIN documents d ON d.doc_id = document_id),
    sh AS (SELECT *, coalesce(source, '') || CASE WHEN loc = '' THEN '' ELSE ', ' || loc END AS citation FROM sh0),
    lb AS (SELECT *, '[' || rank || '] ' || citation AS head FROM sh)"""
BEST = f"{VECTORS}, be AS (SELECT qid, max(score) AS best_score FROM cs GROUP BY qid)"
ASK_COL = f"trim(regexp_replace(coalesce(question, ''), '{W}+', ' ', 'g'))"
CONTEXT = """cx AS (SELECT qid, string_agg(head || CASE WHEN path = '' THEN '' ELSE ' - ' || path END || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(text, chr(10) ORDER BY rank) AS texts, count(*) AS n_passages FROM lb GROUP BY qid)"""
ANSWER = rf"""ea AS (SELECT qid, trim(answer0) AS answer FROM (SELECT id AS qid, CASE WHEN l.text IS NULL THEN '{answers.FALLBACK}' ELSE array_to_string(string_split(regexp_replace(trim(regexp_replace(l.text, '{W}+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], ' ') || ' [1]' END AS answer0
    FROM eval_questions LEFT JOIN lb l ON l.qid = id AND l.rank = 1))"""
PACK = LOW.format("{0}")
PACKED = "regexp_replace(" + LOW + ", '" + W.replace("{", "{{").replace("}", "}}") + "+', '', 'g')"
FALLBACK_LIKE = " OR ".join("contains(" + LOW.format("answer") + ", '" + h.replace("'", "''") + "')" for h in answers.DECLINES)
FINAL = f"""ga AS (SELECT qid, best_score < 0.25 AS gated FROM be),
    fa0 AS (SELECT ea.qid, CASE WHEN gated THEN '{answers.FALLBACK.replace("'", "''")}' ELSE answer END AS answer, NOT gated AS llm_called, best_score FROM ea JOIN ga USING (qid) JOIN be USING (qid)),
    fa AS (SELECT *, NOT llm_called OR {FALLBACK_LIKE} AS declined, list_filter(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d{{1,2}})\\]', 1), lambda x: CAST(x AS INT))), lambda x: x >= 1) AS ns FROM fa0),
    fs AS (SELECT qid, string_agg(head || CASE WHEN sec = '' THEN '' ELSE ' - ' || sec END, '; ' ORDER BY list_position(ns, rank)) AS sources FROM fa JOIN lb USING (qid) WHERE NOT declined AND list_contains(ns, rank) GROUP BY qid),
    fz AS (SELECT qid, answer, llm_called, declined, coalesce(sources, '') AS sources, round(best_score, 4) AS best_score FROM fa LEFT JOIN fs USING (qid))"""
ANSWER = ANSWER.replace(f"'{answers.FALLBACK}'", "'" + answers.FALLBACK.replace("'", "''") + "'")


def oracle_sql() -> dict[str, str]:
    hay, word = PACKED, PACKED.format("w")
    holds = "len(list_filter(must_include, lambda g: len(list_filter(g, lambda w: contains(" + "{hay}" + f", {word}))) = 0)) = 0"
    return {
        "hybrid_search": f"WITH {rank_sql(True)} SELECT qid, rank, pid, fused, vector_rank, keyword_rank FROM ranked",
        "vector_only": f"WITH {rank_sql(False)} SELECT qid, rank, pid, fused, vector_rank FROM ranked",
        "identifier_boost": f"WITH {rank_sql(True)} SELECT qid, pid FROM ranked WHERE boosted",
        "keyword_search": f"WITH {KEYWORDS} SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS INT) AS rank FROM ks QUALIFY rank <= 30",
        "bm25_filtered": f"""WITH {KEYWORDS} SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS INT) AS rank
            FROM ks JOIN kt USING (pid) JOIN documents ON doc_id = document_id WHERE source IN ('wiring.md', 'rk6800.pdf') QUALIFY rank <= 10""",
        "bm25_prefix": f"""WITH {TERMS}, a AS (SELECT DISTINCT t.term AS term FROM terms WHERE t.prefix),
            v AS (SELECT token, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id, unnest({TOKENS.format('text')}) AS token FROM chunks) GROUP BY 1)
            SELECT term, token, n_chunks FROM a JOIN v ON left(token, 4) = left(term, 4) AND starts_with(token, term)""",
        "phrase_match": f"""WITH {TERMS}, a AS (SELECT DISTINCT t.term AS phrase FROM terms WHERE contains(t.term, ' ')),
            k AS (SELECT chunk_id AS pid, {TOKENS.format('text')} AS w FROM chunks), g AS (SELECT pid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS two FROM k)
            SELECT phrase, pid, count(*) AS n FROM a JOIN g ON two = phrase GROUP BY ALL""",
        "rrf_fusion": f"""WITH {rank_sql(True)}, rf AS (SELECT qid, pid, round(fused, 9) AS score FROM fu)
            SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS INT) AS rank FROM rf QUALIFY rank <= 10""",
        "hash_embed": f"WITH h AS (SELECT doc_id, unnest({HASHED.format("coalesce(text, '')").replace("'i '", "'i'")}) AS h FROM documents) SELECT doc_id, CAST(('0x' || h[1:2]) AS INT) AS bucket, CAST(sum(CASE WHEN h[7] >= '8' THEN 1 ELSE -1 END) AS BIGINT) AS value FROM h GROUP BY ALL",
        "best_score": f"WITH {BEST} SELECT qid, best_score FROM be",
        "gate": f"WITH {BEST} SELECT qid, best_score, CASE WHEN best_score < 0.25 THEN '{answers.FALLBACK.replace("'", "''")}' END AS fallback FROM be",
        "vector_topk_filtered": """WITH s AS (SELECT q.vec_id AS qid, p.vec_id AS pid, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
            FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id AND p.label IN (1, 2, 3))
            SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS INT) AS rank FROM s QUALIFY rank <= 5""",
        "labels": f"WITH {SHOWN} SELECT qid, rank, head || CASE WHEN sec = '' THEN '' ELSE ' - ' || sec END AS label, concat_ws(', ', 'vector #' || vector_rank, 'keyword #' || keyword_rank) AS found_by FROM lb",
        "context_text": f"WITH {SHOWN}, {CONTEXT} SELECT qid, md5(context) AS context, n_passages FROM cx",
        "build_messages": f"""WITH {SHOWN}, {CONTEXT}, q AS (SELECT id AS qid, {ASK_COL} AS asked FROM eval_questions)
            SELECT qid, 'system' AS role, md5('{answers.RULES.replace("'", "''")}') AS content FROM q JOIN cx USING (qid) UNION ALL
            SELECT qid, 'user', md5('Context passages:' || chr(10) || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || 'Question: ' || asked || chr(10) || 'Answer (with [n] citations):') FROM q JOIN cx USING (qid)""",
        "extractive_answer": f"WITH {SHOWN}, {ANSWER} SELECT qid, answer FROM ea",
        "finalize_answers": f"WITH {SHOWN}, be AS (SELECT qid, max(score) AS best_score FROM cs GROUP BY qid), {ANSWER}, {FINAL} SELECT * FROM fz",
        "eval_verdicts": f"""WITH {SHOWN}, {CONTEXT}, be AS (SELECT qid, max(score) AS best_score FROM cs GROUP BY qid), {ANSWER}, {FINAL},
            v AS (SELECT fz.qid, answerable, declined, NOT declined AND {holds.replace("{hay}", hay.format("answer"))} AS ok, CASE WHEN len(must_include) > 0 THEN {holds.replace("{hay}", hay.format("coalesce(texts, '')"))} END AS hit
                FROM fz JOIN eval_questions ON id = fz.qid LEFT JOIN cx ON cx.qid = fz.qid)
            SELECT qid, declined, CASE WHEN answerable THEN ok END AS keywords_ok, CASE WHEN answerable THEN hit END AS retrieval_hit, CASE WHEN answerable THEN ok ELSE declined END AS correct FROM v""",
    }
