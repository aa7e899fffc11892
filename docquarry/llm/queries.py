"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import furniture, leaks, lookalike, nearpairs, neighbours, pairs, split, tokenize

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary(spark: SparkSession) -> str:
    """Path of the vocabulary; the setting ``docquarry.tokenizers`` names its folder."""
    return f"{spark.conf.get('docquarry.tokenizers', '/opt/tokenizers')}/{VOCABULARY}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(read(spark, d, "eval_results"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_passages(read(spark, d, "chunks")).where("piece_no = 0").select("chunk_id", "cut")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_passages(read(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_vectors(read(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nearpairs.near_pairs(read(spark, d, "chunks"))


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    return nearpairs.exact_copies(read(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture.repeated_lines(read(spark, d, "chunks"), read(spark, d, "documents"))


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    chunks = read(spark, d, "chunks")
    found = furniture.repeated_lines(chunks, read(spark, d, "documents"))
    return furniture.remove_lines(chunks.select("chunk_id", "text"), found)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(read(spark, d, "documents"), vocabulary(spark))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(read(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(read(spark, d, "documents")).select("doc_id", F.col("form"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.text_classes(read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p2_found, p2_pieces, p3_found, p4_found, p4_copies, p5_found, p5_cleaned, p6_ids, p7_found, p8_found, p8_forms, p8_classes)
    return {f.__name__: f for f in every}


# White space of any kind, and the words and normalised lines that the problems define.
W = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
WORDS = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"
LINE = "lower(regexp_replace(trim(regexp_replace(raw, '" + W + "+', ' ', 'g')), '\\p{Nd}+', '0', 'g'))"


def oracle_sql() -> dict[str, str]:
    twelve = "array_to_string(w[i:i + 11], ' ')"
    return {
        "p2_found": r"""
            SELECT chunk_id, CASE WHEN list_max(list_transform(
                regexp_split_to_array(regexp_replace(text, '([.!?;:])[\s\x0B\x1C-\x1F\x{85}\p{Z}]', '\1' || chr(10), 'g'), chr(10)),
                lambda x: length(x))) > 1200 THEN 'forced' ELSE 'natural' END AS cut
            FROM chunks WHERE length(text) > 1200""",
        "p4_copies": "SELECT chunk_id, min(chunk_id) OVER (PARTITION BY text) AS copy_of FROM chunks WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY text) > 1",
        "p4_found": f"""
            WITH t AS (SELECT chunk_id, {WORDS.format('text')} AS w FROM chunks WHERE text IS NOT NULL),
            r AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS run FROM t WHERE len(w) >= 3),
            n AS (SELECT chunk_id, count(*) AS n FROM r GROUP BY 1),
            b AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS shared FROM r x JOIN r y ON x.run = y.run AND x.chunk_id < y.chunk_id GROUP BY ALL)
            SELECT a AS chunk_id_a, b AS chunk_id_b FROM b JOIN n p ON p.chunk_id = a JOIN n q ON q.chunk_id = b WHERE 2 * shared >= p.n + q.n - shared""",
        "p5_found": f"""
            WITH d AS (SELECT doc_id, source FROM documents WHERE source IS NOT NULL),
            need AS (SELECT source, greatest(5, count(DISTINCT doc_id) * CAST(0.1 AS DOUBLE)) AS need FROM d JOIN chunks ON document_id = doc_id GROUP BY 1),
            l0 AS (SELECT chunk_id, doc_id, source, string_split(text, chr(10)) AS l FROM chunks JOIN d ON doc_id = document_id WHERE text IS NOT NULL),
            l1 AS (SELECT chunk_id, doc_id, source, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line_no, unnest(l) AS raw FROM l0),
            l2 AS (SELECT chunk_id, doc_id, source, line_no, {LINE} AS line FROM l1),
            x AS (SELECT source, line FROM l2 JOIN need USING (source) WHERE line <> '' GROUP BY source, line, need HAVING count(DISTINCT doc_id) >= need)
            SELECT chunk_id, line_no FROM l2 JOIN x USING (source, line)""",
        "p7_found": f"""
            WITH i AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark), t AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
            ir AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: {twelve})) AS run FROM i WHERE len(w) >= 12),
            tr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: {twelve})) AS run FROM t WHERE len(w) >= 12)
            SELECT DISTINCT doc_id, item_id FROM ir JOIN tr USING (run)""",
    }
