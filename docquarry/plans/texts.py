"""Queries on lines and passages, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import lines, text
from docquarry.operators import chunking, passages
from docquarry.sources.tables import table

W = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
E = W.replace("{", "{{").replace("}", "}}")  # in templates
COLLAPSED = "trim(regexp_replace({0}, '" + E + "+', ' ', 'g'))"
INLINED = "regexp_replace(regexp_replace({0}, '[ \\t]+', ' ', 'g'), '^" + E + "+|" + E + "+$', '', 'g')"
LOW = "lower(replace({0}, 'İ', 'i'))"
PACKED = "regexp_replace(" + LOW + ", '" + E + "+', '', 'g')"
PATH = """CASE WHEN coalesce(chapter, '') <> '' AND coalesce(chapter, '') <> coalesce(section, '')
    THEN CASE WHEN coalesce(section, '') = '' THEN chapter ELSE chapter || ' > ' || section END ELSE coalesce(section, '') END"""
LOCATION = """CASE WHEN page_start IS NULL THEN '' WHEN page_end IS NOT NULL AND page_end <> 0 AND page_end <> page_start
    THEN 'pp. ' || page_start || '-' || page_end ELSE 'p. ' || page_start END"""
LINES = f"""
    ln0 AS (SELECT doc_id, kind, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    ln AS (SELECT doc_id, kind, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS raw FROM ln0),
    li AS (SELECT doc_id, kind, CAST(line_no AS INT) AS line_no, {INLINED.format('raw')} AS line FROM ln)"""
BIT = r"'^(\d{1,2}|r|w|rw|rs|rt_w|rc_w0|rc_w1|rc_r|t|-|res\.?|reset|value)$'"
NOISE = rf"""CASE WHEN regexp_matches(line, '(\.\s?){{4,}}\s*\d+\s*$') THEN 'contents'
    WHEN {LOW.format('line')} IN ('contents', 'list of tables', 'list of figures', 'table of contents') THEN 'front'
    WHEN len(string_split_regex(line, '{W}+')) >= 6 AND len(list_filter(string_split_regex(line, '{W}+'), lambda t: regexp_matches(lower(t), {BIT}))) >= 0.8 * len(string_split_regex(line, '{W}+')) THEN 'bits' END"""
MD = r"'^(#{1,6})\s+(.*?)\s*#*$'"
NUM = r"'^(\d{1,2}(?:\.\d{1,2}){0,4}|[A-Z]\.\d{1,2}(?:\.\d{1,2})*|Appendix\s+[A-Z])\s+[A-Z][A-Za-z][^\n]{1,88}$'"
# documents told again as markdown: each stored chunk once under its chapter and section
AS_MARKDOWN = """
    once AS (SELECT * FROM chunks WHERE text IS NOT NULL AND chunk_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY chunk_id) = 1),
    md AS (SELECT document_id AS doc_id, string_agg('# ' || coalesce(chapter, '') || chr(10) || '## ' || coalesce(section, '') || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM once GROUP BY 1)"""
UNITS = f"""
    md0 AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM md),
    md1 AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS raw FROM md0),
    md2 AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, {INLINED.format('raw')} AS line FROM md1),
    md3 AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 AS in_code FROM md2),
    md4 AS (SELECT *, {NOISE} AS noise, in_code = 0 AND regexp_matches(line, {MD}) AND trim(regexp_extract(line, {MD}, 2)) <> '' AS is_head FROM md3)"""


def normalize_text(s: SparkSession, d: str) -> DataFrame:
    q = F.coalesce("answer", F.lit(""))
    return table(s, d, "eval_results").select("result_id", F.md5(text.inlined(q)).alias("inlined"), F.md5(text.collapsed(q)).alias("collapsed"), F.md5(text.lowered(text.collapsed(q))).alias("lowered"))


def normalize_question(s: SparkSession, d: str) -> DataFrame:
    asked = F.substring(text.collapsed(F.coalesce("question", F.lit(""))), 1, 1000)
    return table(s, d, "eval_results").groupBy(F.when(asked == "", "Please type a question.").otherwise(asked).alias("asked")).agg(F.count("*").alias("n"))


def noise_lines(s: SparkSession, d: str) -> DataFrame:
    return chunking.document_lines(table(s, d, "documents")).select("doc_id", "line_no", lines.noise(F.col("line")).alias("noise")).where("noise is not null")


def numbered_headings(s: SparkSession, d: str) -> DataFrame:
    pdf = table(s, d, "documents").where("kind = 'pdf'")
    return chunking.document_lines(pdf).select("doc_id", "line_no", lines.numbered_heading(F.col("line")).alias("h")).where("h is not null").select("doc_id", "line_no", "h.level", "h.title")


def md_headings(s: SparkSession, d: str) -> DataFrame:
    units = chunking.units(chunking.document_lines(chunking.as_markdown(table(s, d, "chunks"))))
    return units.where("kind = 'heading'").select("doc_id", "line_no", "level", F.col("text").alias("title"))


def sentence_split(s: SparkSession, d: str) -> DataFrame:
    parts = lines.sentences(F.coalesce("text", F.lit("")))
    return table(s, d, "chunks").select("chunk_id", F.size(parts).alias("n_sentences"), F.md5(F.array_join(parts, "|")).alias("sentences"))


def dehyphenate(s: SparkSession, d: str) -> DataFrame:
    joined = lines.dehyphenated(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")))
    return table(s, d, "chunks").where("text is not null").select("chunk_id", F.md5(joined).alias("joined"))


def repeated_lines(s: SparkSession, d: str) -> DataFrame:
    return passages.running_lines(table(s, d, "chunks"))


def skip_chapters(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").where("chapter is not null").groupBy("chapter").agg(F.count("*").alias("n_chunks")).withColumn("skipped", F.col("chapter").rlike(lines.SKIPPED_CHAPTER))


def min_alnum(s: SparkSession, d: str) -> DataFrame:
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]")).cast("bigint")
    return table(s, d, "chunks").select("chunk_id", n.alias("n_alnum"), (n >= 40).alias("kept"))


def content_hash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def identifier_variants(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_questions").select(F.col("id").alias("qid"), F.explode(text.name_variants(text.names(F.col("question")))).alias("variant"))


def build_match_query(s: SparkSession, d: str) -> DataFrame:
    terms = F.posexplode(text.match_terms(F.col("question")))
    return table(s, d, "eval_questions").select(F.col("id").alias("qid"), terms.alias("pos", "t")).select("qid", "pos", F.array_join("t.words", " ").alias("term"), "t.prefix")


def heading_path(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", passages.heading_path(F.col("chapter"), F.col("section")).alias("heading_path"))


def embedding_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", F.md5(passages.embedding_text(F.col("chapter"), F.col("section"), F.col("text"))).alias("embedded"))


def citation(s: SparkSession, d: str) -> DataFrame:
    at = F.col("page_start"), F.col("page_end")
    shown = passages.with_source(table(s, d, "chunks"), table(s, d, "documents"))
    return shown.select("chunk_id", passages.location(*at).alias("location"), passages.citation(F.col("source"), *at).alias("citation"))


def inspect_page(s: SparkSession, d: str) -> DataFrame:
    return passages.on_page(table(s, d, "chunks"), 12).select("chunk_id", "document_id", "page_start", "page_end")


def inspect_doc(s: SparkSession, d: str) -> DataFrame:
    return passages.ordered_chunks(table(s, d, "chunks"), table(s, d, "documents"), "wiring.md").select("document_id", "place", "chunk_id", "chunk_index")


def join_chunk_doc(s: SparkSession, d: str) -> DataFrame:
    return passages.with_source(table(s, d, "chunks"), table(s, d, "documents")).groupBy("source", "dim").agg(F.count("*").alias("n_chunks"))


def count_chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").agg(F.count("*").alias("n_chunks"))


def distinct_sources(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("source is not null").select("source").distinct().orderBy("source")


def doc_profile(s: SparkSession, d: str) -> DataFrame:
    return passages.document_profile(table(s, d, "documents"), table(s, d, "chunks"))


def fetch_in_order(s: SparkSession, d: str) -> DataFrame:
    """Every question's list: the ids of the chunks whose section holds one of its names, newest first, and one id that is not stored."""
    chunks = table(s, d, "chunks")
    asked = table(s, d, "eval_questions").select(F.col("id").alias("list_id"), F.explode(F.array_distinct(text.names(F.col("question")))).alias("name"))
    held = chunks.select("chunk_id", F.explode(F.array_distinct(text.names(F.coalesce("text", F.lit(""))))).alias("name"))
    newest = Window.partitionBy("list_id").orderBy(F.desc("chunk_id"))
    top = held.join(F.broadcast(asked), "name").select("list_id", "chunk_id").distinct().withColumn("r", F.row_number().over(newest)).where("r <= 20")
    ids = top.groupBy("list_id").agg(F.concat(F.array(F.lit(-1).cast("bigint")), F.reverse(F.array_sort(F.collect_list("chunk_id")))).alias("ids"))
    return passages.fetch_in_order(chunks, ids).select("list_id", "pos", "chunk_id", "chunk_index")


def replace_doc(s: SparkSession, d: str) -> DataFrame:
    """Documents told again as markdown and cut anew take the place of their stored chunks, where a document has ten or more."""
    chunks = table(s, d, "chunks")
    many = chunks.groupBy("document_id").agg(F.count("*").alias("n")).where("n >= 10").select("document_id")
    stored = chunks.select("document_id", "chunk_index", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"))
    anew = chunking.chunk_documents(chunking.as_markdown(chunks.join(many, "document_id"))).select(F.col("doc_id").alias("document_id"), "chunk_index", F.md5("text").alias("text_hash"))
    return passages.replace_documents(stored, anew)


def delete_cascade(s: SparkSession, d: str) -> DataFrame:
    """Documents without a source go, and their chunks with them."""
    documents = table(s, d, "documents")
    kept, chunks = passages.delete_documents(documents, table(s, d, "chunks"), documents.where("source is null"))
    return chunks.select(F.col("document_id").alias("doc_id"), "chunk_id").join(kept.select("doc_id", "source"), "doc_id", "left")


def asof_heading(s: SparkSession, d: str) -> DataFrame:
    """The numbered heading that stands last at or before every line that is no heading."""
    h = chunking.document_lines(table(s, d, "documents")).withColumn("h", lines.numbered_heading(F.col("line")))
    before = Window.partitionBy("doc_id").orderBy("line_no")
    found = h.withColumn("heading", F.last("h.title", ignorenulls=True).over(before)).where("h is null and line <> ''")
    return found.groupBy("doc_id", "heading").agg(F.count("*").alias("n_lines"))


def chunk_documents(s: SparkSession, d: str) -> DataFrame:
    found = chunking.chunk_documents(chunking.as_markdown(table(s, d, "chunks")))
    return found.select("doc_id", "chunk_index", "chapter", "section", F.length("text").alias("n_chars"), F.md5("text").alias("text_hash"))


def like_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").where(F.col("p_name").like("%e%")).select("p_partkey", "p_name")


def update_rewrite(s: SparkSession, d: str) -> DataFrame:
    """The table written anew with the value of some rows changed: sizes above 40 are cut to 40."""
    return table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, 40).otherwise(F.col("p_size")).alias("p_size"))


def scan_point_lookup(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("doc_id = 17").select("doc_id", "source", "kind", "n_chunks", "complete")


def scan_vectors(s: SparkSession, d: str) -> DataFrame:
    v = passages.with_source(table(s, d, "chunks"), table(s, d, "documents"))
    return v.select("chunk_id", "source", F.size("embedding").alias("n_values"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        normalize_text, normalize_question, noise_lines, numbered_headings, md_headings, sentence_split, dehyphenate, repeated_lines, skip_chapters, min_alnum,
        content_hash, identifier_variants, build_match_query, heading_path, embedding_text, citation, inspect_page, inspect_doc, join_chunk_doc, count_chunks,
        distinct_sources, doc_profile, fetch_in_order, replace_doc, delete_cascade, asof_heading, chunk_documents, like_filter, update_rewrite, scan_point_lookup, scan_vectors,
    )
    return {f.__name__: f for f in every}


NAMES = r"list_transform(list_filter(string_split_regex({0}, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z][A-Za-z0-9]*(_[A-Za-z0-9]+)+')), lambda w: lower(w))"
VARIANTS = f"""
    nm AS (SELECT id AS qid, unnest({NAMES.format('question')}) AS name FROM eval_questions),
    ba AS (SELECT qid, name, regexp_replace(name, '^[^_]*_', '') AS rest, regexp_extract(split_part(name, '_', 1), '^(gpio)[a-k]$', 1)
        || regexp_extract(split_part(name, '_', 1), '^(tim|usart|uart|spi|i2c|i2s|dma|adc|can|dac|otg)[0-9]+$', 1) AS base FROM nm),
    va AS (SELECT qid, name AS v FROM ba UNION SELECT qid, base || 'x_' || rest FROM ba WHERE base <> '' UNION SELECT qid, base || '_' || rest FROM ba WHERE base <> '')"""
STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
ASCII_LOW = f"translate(coalesce(question, ''), '{text.UPPER}', '{text.UPPER.lower()}')"
TERMS = f"""
    t0 AS (SELECT id AS qid, {NAMES.format("coalesce(question, '')")} AS nm, regexp_extract_all({ASCII_LOW}, '[a-z0-9]+') AS w FROM eval_questions),
    t1 AS (SELECT qid, list_transform(nm, lambda n: {{'term': replace(n, '_', ' '), 'prefix': false}}) || list_transform(
        list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: x NOT IN ({STOP}) AND (length(x) > 1 OR regexp_matches(x, '^[0-9]$'))),
        lambda x: {{'term': x, 'prefix': length(x) >= 4}}) AS ts FROM t0),
    terms AS (SELECT qid, CAST(unnest(range(0, least(len(ts), 24))) AS INT) AS pos, unnest(ts[1:24]) AS t FROM t1)"""
SIG_LOW = COLLAPSED.format(LOW.format("line"))
# the fold, as lists reduced with the state in one struct
HELD = "coalesce(list_sum(list_transform(a.lines, lambda l: length(l) + 1)), 0)"
PLAIN_CUT = f"(x.kind = 'heading' AND len(a.lines) > 0 AND (x.level <= 1 OR {HELD} >= 300) OR x.kind = 'break' AND {HELD} >= 900)"
TEXT_CUT = f"(x.kind = 'text' AND len(a.lines) > 0 AND {HELD} + length(x.text) > 1200 AND ({HELD} >= 300 OR {HELD} + length(x.text) > 1800))"
JOINED = rf"regexp_replace(regexp_replace(array_to_string(a.lines, chr(10)), '-\n(\p{{Ll}})', '\1', 'g'), '^{W}+|{W}+$', '', 'g')"
FULL = "(a.buf <> '' AND length(a.buf) + 1 + length(x.buf) > 1200)"
NEXT = f"trim(CASE WHEN {FULL} THEN x.buf ELSE a.buf || ' ' || x.buf END)"
FOLD = rf"""
    un AS (SELECT doc_id, line_no, CASE WHEN line = '' THEN 'break' WHEN is_head THEN 'heading' ELSE 'text' END AS kind,
        CASE WHEN is_head THEN length(regexp_extract(line, {MD}, 1)) END AS level, CASE WHEN is_head THEN trim(regexp_extract(line, {MD}, 2)) ELSE line END AS text FROM md4 WHERE line = '' OR noise IS NULL),
    pc AS (SELECT *, CASE WHEN kind <> 'text' OR length(text) <= 1200 THEN {{'parts': CAST([] AS VARCHAR[]), 'buf': text}} ELSE list_reduce(
        list_transform(string_split(regexp_replace(text, '([.!?;:])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda s: {{'parts': CAST([] AS VARCHAR[]), 'buf': s}}),
        lambda a, x: {{'parts': a.parts || (CASE WHEN {FULL} THEN [a.buf] ELSE [] END) || list_transform(range(0, greatest(0, (length({NEXT}) - 1) // 1200)), lambda i: substring({NEXT}, i * 1200 + 1, 1200)),
            'buf': substring({NEXT}, greatest(0, (length({NEXT}) - 1) // 1200) * 1200 + 1)}}, {{'parts': CAST([] AS VARCHAR[]), 'buf': ''}}) END AS c FROM un),
    ps AS (SELECT doc_id, line_no, kind, level, CASE WHEN kind <> 'text' THEN [text] ELSE c.parts || CASE WHEN c.buf <> '' THEN [c.buf] ELSE [] END END AS t FROM pc),
    pu AS (SELECT doc_id, line_no, kind, level, unnest(range(1, len(t) + 1)) AS no, unnest(t) AS text FROM ps),
    sg AS (SELECT *, sum(CASE WHEN level <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no, no) AS segment FROM pu),
    el AS (SELECT doc_id, segment, list({{'kind': kind, 'level': level, 'text': text, 'lines': CAST([] AS VARCHAR[]), 'chapter': '', 'section': '', 'out': CAST([] AS STRUCT(chapter VARCHAR, section VARCHAR, "text" VARCHAR)[])}} ORDER BY line_no, no) AS e FROM sg GROUP BY ALL),
    st AS (SELECT doc_id, segment, list_reduce(e, lambda a, x: {{'kind': x.kind, 'level': x.level, 'text': x.text,
        'lines': (CASE WHEN {PLAIN_CUT} THEN CAST([] AS VARCHAR[]) WHEN {TEXT_CUT} THEN list_filter(a.lines, lambda l, i: list_sum(list_transform(a.lines[i:], lambda m: length(m) + 1)) - 1 <= 200) ELSE a.lines END)
            || CASE WHEN x.kind = 'break' THEN CAST([] AS VARCHAR[]) ELSE [x.text] END,
        'chapter': CASE WHEN x.kind = 'heading' AND x.level <= 1 THEN x.text ELSE a.chapter END, 'section': CASE WHEN x.kind = 'heading' THEN x.text ELSE a.section END,
        'out': a.out || CASE WHEN {PLAIN_CUT} OR {TEXT_CUT} THEN [{{'chapter': a.chapter, 'section': a.section, 'text': {JOINED}}}] ELSE [] END}},
        {{'kind': '', 'level': CAST(NULL AS BIGINT), 'text': '', 'lines': CAST([] AS VARCHAR[]), 'chapter': '', 'section': '', 'out': CAST([] AS STRUCT(chapter VARCHAR, section VARCHAR, "text" VARCHAR)[])}}) AS a FROM el),
    fo AS (SELECT doc_id, segment, a.out || CASE WHEN len(a.lines) > 0 THEN [{{'chapter': a.chapter, 'section': a.section, 'text': {JOINED}}}] ELSE [] END AS out FROM st),
    fx AS (SELECT doc_id, segment, unnest(range(1, len(out) + 1)) AS no, unnest(out) AS o FROM fo),
    folded AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY segment, no) - 1 AS INT) AS chunk_index, o.chapter AS chapter, o.section AS section, o.text AS text
        FROM fx WHERE length(regexp_replace(o.text, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 40)"""


def oracle_sql() -> dict[str, str]:
    return {
        "normalize_text": f"SELECT result_id, md5({INLINED.format('a')}) AS inlined, md5({COLLAPSED.format('a')}) AS collapsed, md5({LOW.format(COLLAPSED.format('a'))}) AS lowered FROM (SELECT result_id, coalesce(answer, '') AS a FROM eval_results)",
        "normalize_question": f"SELECT CASE WHEN a = '' THEN 'Please type a question.' ELSE a END AS asked, count(*) AS n FROM (SELECT substring({COLLAPSED.format("coalesce(question, '')")}, 1, 1000) AS a FROM eval_results) GROUP BY 1",
        "noise_lines": f"WITH {LINES} SELECT * FROM (SELECT doc_id, line_no, {NOISE} AS noise FROM li) WHERE noise IS NOT NULL",
        "numbered_headings": rf"""WITH {LINES}, h AS (SELECT doc_id, line_no, line, regexp_extract(line, {NUM}, 1) AS num FROM li WHERE kind = 'pdf' AND length(line) <= 90 AND NOT regexp_matches(line, '[.,;]$') AND regexp_matches(line, {NUM}))
            SELECT doc_id, line_no, CASE WHEN regexp_matches(num, '^\d') THEN CAST(len(string_split(num, '.')) AS INT) ELSE 1 END AS level, line AS title FROM h""",
        "md_headings": f"WITH {AS_MARKDOWN}, {UNITS} SELECT doc_id, line_no, CAST(length(regexp_extract(line, {MD}, 1)) AS INT) AS level, trim(regexp_extract(line, {MD}, 2)) AS title FROM md4 WHERE line <> '' AND noise IS NULL AND is_head",
        "sentence_split": r"SELECT chunk_id, CAST(len(p) AS INT) AS n_sentences, md5(array_to_string(p, '|')) AS sentences FROM (SELECT chunk_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\s\x{0B}]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM chunks)",
        "dehyphenate": r"SELECT chunk_id, md5(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '-\n(\p{Ll})', '\1', 'g')) AS joined FROM chunks WHERE text IS NOT NULL",
        "repeated_lines": rf"""WITH p0 AS (SELECT document_id, chunk_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM chunks WHERE text IS NOT NULL),
            p1 AS (SELECT document_id, chunk_id, len(l) AS n, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM p0),
            e AS (SELECT document_id, chunk_id, CAST(line_no AS INT) AS line_no, CASE WHEN length({SIG_LOW}) <= 40 THEN regexp_replace({SIG_LOW}, '[0-9]+', '#', 'g') ELSE {SIG_LOW} END AS sig FROM p1 WHERE line_no <= 3 OR line_no > n - 3),
            pg AS (SELECT document_id, count(*) AS pages FROM p0 GROUP BY 1),
            r AS (SELECT document_id, sig FROM e JOIN pg USING (document_id) WHERE sig <> '' GROUP BY document_id, sig, pages HAVING pages >= 4 AND count(DISTINCT chunk_id) >= greatest(2, floor(pages * CAST(0.4 AS DOUBLE))))
            SELECT chunk_id, line_no FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.document_id = e.document_id AND r.sig = e.sig) OR regexp_matches(sig, '^(page\s*)?#(\s*(/|of)\s*#)?$')""",
        "skip_chapters": r"SELECT chapter, count(*) AS n_chunks, regexp_matches(lower(chapter), '^(?:[0-9]+\s+)?(contents|table of contents|list of tables|list of figures|index|revision history|document revision history|important (security )?notice)\b') AS skipped FROM chunks WHERE chapter IS NOT NULL GROUP BY chapter",
        "min_alnum": r"SELECT chunk_id, n AS n_alnum, n >= 40 AS kept FROM (SELECT chunk_id, length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) AS n FROM chunks)",
        "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "identifier_variants": f"WITH {VARIANTS} SELECT qid, v AS variant FROM va",
        "build_match_query": f"WITH {TERMS} SELECT qid, pos, t.term AS term, t.prefix AS prefix FROM terms",
        "heading_path": f"SELECT chunk_id, {PATH} AS heading_path FROM chunks",
        "embedding_text": f"SELECT chunk_id, md5(CASE WHEN p = '' OR starts_with(t, p) THEN t ELSE p || chr(10) || t END) AS embedded FROM (SELECT chunk_id, coalesce(text, '') AS t, {PATH} AS p FROM chunks)",
        "citation": f"SELECT chunk_id, location, coalesce(source, '') || CASE WHEN location = '' THEN '' ELSE ', ' || location END AS citation FROM (SELECT chunk_id, source, {LOCATION} AS location FROM chunks JOIN documents ON doc_id = document_id)",
        "inspect_page": "SELECT chunk_id, document_id, page_start, page_end FROM chunks WHERE page_start IS NULL OR page_start = 12 OR 12 BETWEEN page_start AND page_end",
        "inspect_doc": "SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS INT) AS place, chunk_id, chunk_index FROM chunks JOIN documents ON doc_id = document_id WHERE source = 'wiring.md'",
        "join_chunk_doc": "SELECT source, dim, count(*) AS n_chunks FROM chunks JOIN documents ON doc_id = document_id GROUP BY ALL",
        "count_chunks": "SELECT count(*) AS n_chunks FROM chunks",
        "distinct_sources": "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source",
        "doc_profile": r"""SELECT doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(n_stored, 0) AS n_stored, coalesce(n_alnum, 0) AS n_alnum, first_page, last_page FROM documents d LEFT JOIN (
            SELECT document_id, count(*) AS n_stored, CAST(sum(length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g'))) AS BIGINT) AS n_alnum, min(page_start) AS first_page, max(greatest(page_start, page_end)) AS last_page FROM chunks GROUP BY 1) ON document_id = doc_id""",
        "fetch_in_order": f"""WITH a AS (SELECT DISTINCT id AS list_id, unnest({NAMES.format('question')}) AS name FROM eval_questions),
            h AS (SELECT DISTINCT chunk_id, chunk_index, unnest({NAMES.format("coalesce(text, '')")}) AS name FROM chunks),
            f AS (SELECT DISTINCT list_id, chunk_id, chunk_index FROM a JOIN h USING (name))
            SELECT list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY chunk_id DESC) AS INT) AS pos, chunk_id, chunk_index FROM f QUALIFY pos <= 20""",
        "replace_doc": f"""WITH big AS (SELECT document_id FROM chunks GROUP BY 1 HAVING count(*) >= 10), {AS_MARKDOWN.replace('FROM chunks WHERE', 'FROM chunks WHERE document_id IN (FROM big) AND')}, {UNITS}, {FOLD}
            SELECT doc_id AS document_id, chunk_index, md5(text) AS text_hash FROM folded UNION ALL
            SELECT document_id, chunk_index, md5(coalesce(text, '')) FROM chunks WHERE document_id IS NULL OR document_id NOT IN (SELECT doc_id FROM folded)""",
        "delete_cascade": "SELECT doc_id, chunk_id, source FROM chunks JOIN documents ON doc_id = document_id WHERE source IS NOT NULL",
        "asof_heading": f"""WITH {LINES}, h AS (SELECT *, CASE WHEN length(line) <= 90 AND NOT regexp_matches(line, '[.,;]$') AND regexp_matches(line, {NUM}) THEN line END AS title FROM li),
            b AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading FROM h)
            SELECT doc_id, heading, count(*) AS n_lines FROM b WHERE title IS NULL AND line <> '' GROUP BY ALL""",
        "chunk_documents": f"WITH {AS_MARKDOWN}, {UNITS}, {FOLD} SELECT doc_id, chunk_index, chapter, section, CAST(length(text) AS INT) AS n_chars, md5(text) AS text_hash FROM folded",
        "like_filter": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%'",
        "update_rewrite": "SELECT p_partkey, least(p_size, 40) AS p_size FROM part",
        "scan_point_lookup": "SELECT doc_id, source, kind, n_chunks, complete FROM documents WHERE doc_id = 17",
        "scan_vectors": "SELECT chunk_id, source, CAST(len(embedding) AS INT) AS n_values, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM chunks JOIN documents ON doc_id = document_id",
    }
