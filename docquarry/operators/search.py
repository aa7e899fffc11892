"""Keyword and vector ranking of whole question sets, and their fusion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.text import lowered, match_terms, name_variants, names, tokens, word_tokens
from docquarry.operators.passages import citation, embedding_text, heading_path

K1, B, RRF_K = 1.2, 0.75, 60


def postings(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pid, term, tf) of every passage; terms are counted before they shuffle."""
    terms = passages.select(F.col(id_col).alias("pid"), F.explode(tokens(F.col(text_col))).alias("term"))
    return terms.groupBy("pid", "term").agg(F.count("*").alias("tf"))


def top(scores: DataFrame, by: list, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(*by)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(questions: DataFrame, passages: DataFrame, *, q_id: str, q_text: str, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """(qid, pid, score, rank): the ``k`` best passages of every question by plain BM25 over all its words; ties go to the lower pid.

    Null and empty texts hold no terms. Passages are scored where they lie, as
    in ``keyword_topk``.
    """
    terms = F.transform(F.array_distinct(tokens(F.coalesce(F.col(q_text), F.lit("")))), lambda t: F.struct(t.alias("w"), F.lit(False).alias("p")))
    rows = passages.select(F.col(id_col).cast("bigint").alias("pid"), F.lower(F.translate(F.coalesce(F.col(text_col), F.lit("")), "İ", " ")).alias("text"), F.lit(True).alias("wanted"))
    asked = questions.select(F.col(q_id).alias("qid"), terms.alias("terms"))
    return scored_topk(asked, rows, {"text": 1.0}, k=k, token="[a-z0-9_]+", idf=lambda n, df: np.log(1 + (n - df + 0.5) / (df + 0.5)))


def fuse(*rankings: DataFrame, k: int = 5) -> DataFrame:
    """(qid, pid, score, rank) by reciprocal ranks summed over the rankings."""
    every = rankings[0].select("qid", "pid", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("qid", "pid", "rank"))
    scores = every.groupBy("qid", "pid").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return top(scores, [F.desc("score"), "pid"], k)


def cosine_topk(queries: DataFrame, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(qid, pid, score, rank): exact cosine of a stated query set against all rows, never with the same id.

    The query vectors (at most 20,000) go to every task, which scores its rows
    block by block with a matrix product and sends its ``k`` best per query.
    Null, zero and non-finite vectors, and those of another length than the
    queries', are left out; ties go to the lower pid.
    """
    if k < 1:
        return nothing(queries, id_col)
    asked = stated(queries.where(F.col(vector_col).isNotNull()), [F.col(id_col).cast("bigint").alias("qid"), F.col(vector_col).cast("array<double>").alias("v")], 20_000)
    sizes = {len(r.v) for r in asked}
    if len(sizes) > 1:
        raise ValueError("query vectors differ in length")
    dim = sizes.pop() if sizes else 0
    qids, unit = np.array([r.qid for r in asked], np.int64), np.array([r.v for r in asked]).reshape(-1, dim)
    length = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    usable = np.isfinite(length[:, 0]) & (length[:, 0] > 0)
    qids, unit = qids[usable], unit[usable] / length[usable]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_rows = TopRows(len(qids), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                m = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                size = np.sqrt((m * m).sum(axis=1))
                fine = np.isfinite(size) & (size > 0)
                pids, m = part.column(0).to_numpy()[fine], m[fine] / size[fine, None]
                score = np.rint(unit @ m.T * 1e6) / 1e6
                top_rows.add(pids, np.where(qids[:, None] == pids[None, :], -np.inf, score))
        yield top_rows.batch()

    rows = vectors.select(F.col(id_col).cast("bigint").alias("pid"), F.col(vector_col).cast("array<double>").alias("v")).where((F.size("v") == dim) & F.col("pid").isNotNull())
    scored = rows.mapInArrow(best, "q int, pid bigint, score double").withColumnRenamed("q", "qid")
    found = top(scored, [F.desc("score"), "pid"], k).withColumnRenamed("qid", "q")
    return labelled(found, queries, id_col, qids.tolist()).select("qid", "pid", "score", "rank")


def with_headings(chunks: DataFrame) -> DataFrame:
    """(pid, section, text, full): ``full`` is the text under its chapter and section, as it is embedded."""
    section, text = (F.coalesce(F.col(c), F.lit("")) for c in ("section", "text"))
    full = embedding_text(F.col("chapter"), F.col("section"), F.col("text"))
    return chunks.select(F.col("chunk_id").alias("pid"), section.alias("section"), text.alias("text"), full.alias("full"))


def hash_vectors(texts: list[str], dim: int, known: dict[str, tuple[int, int]]) -> np.ndarray:
    """Unit vectors of signed token counts: bucket and sign of a token come from its md5; a text without tokens gives zeros."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        for t in re.findall("[a-z0-9]+", text.lower()):
            if t not in known:
                if len(known) > 500_000:
                    known.clear()
                h = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "little")
                known[t] = (h % dim, 1 if h >> 31 else -1)
            at, sign = known[t]
            row[at] += sign
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=out, where=size > 0)


def prefix_terms(questions: DataFrame, chunks: DataFrame, *, q_text: str = "question") -> DataFrame:
    """(term, token, n_chunks): every token of the chunks that an asked beginning of a word stands for, and in how many chunks it is.

    Beginnings have four letters or more, so they meet the vocabulary on the
    first four; the vocabulary is counted before it joins.
    """
    asked = questions.select(F.explode(match_terms(F.col(q_text))).alias("t")).where("t.prefix").select(F.get("t.words", F.lit(0)).alias("term")).distinct()
    held = chunks.select(F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n_chunks"))
    met = held.withColumn("four", F.substring("token", 1, 4)).join(asked.withColumn("four", F.substring("term", 1, 4)), "four")
    return met.where(F.startswith("token", F.col("term"))).select("term", "token", "n_chunks")


def phrase_matches(questions: DataFrame, chunks: DataFrame, *, q_text: str = "question") -> DataFrame:
    """(phrase, pid, n): how often the words of an asked name stand side by side in a chunk's text.

    Chunks are joined by the phrase's first word at its places, and the words
    after it are compared where they stand.
    """
    asked = questions.select(F.explode(match_terms(F.col(q_text))).alias("t")).where(F.size("t.words") > 1).select("t.words").distinct()
    placed = chunks.select(F.col("chunk_id").alias("pid"), word_tokens(F.col("text")).alias("tokens")).select("pid", "tokens", F.posexplode("tokens").alias("at", "token"))
    met = placed.join(F.broadcast(asked.withColumn("token", F.get("words", F.lit(0)))), "token")  # names of the stated question set
    beside = met.where(F.slice("tokens", F.col("at") + 1, F.size("words")) == F.col("words"))
    return beside.groupBy(F.array_join("words", " ").alias("phrase"), "pid").agg(F.count("*").alias("n"))


def hash_buckets(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, bucket, value): the hashed vector of each text before it is scaled, 256 buckets, sparse.

    A word's bucket is the first byte of its md5, its sign the top bit of the
    fourth. Words are summed before they shuffle. Null texts have none.
    """
    low = F.lower(F.translate(F.coalesce(F.col(text_col), F.lit("")), "İ", "i"))
    words = passages.select(F.col(id_col), F.explode(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1)).alias("word")).withColumn("h", F.md5("word"))
    bucket = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    sign = F.when(F.substring("h", 7, 1) >= "8", 1).otherwise(-1)
    return words.groupBy(id_col, bucket.alias("bucket")).agg(F.sum(sign).alias("value"))


class TopRows:
    """The ``k`` best (score, lower pid) of each of ``n`` questions over all rows a task has seen."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.least = n, k, np.full((n, 1), -np.inf)
        self.q, self.pid, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, pids: np.ndarray, score: np.ndarray) -> None:
        """``score`` has a row for each question and a column for each pid; what is not a candidate has -inf."""
        least = self.least
        if score.shape[1] > self.k:
            least = np.maximum(least, -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k])
        # all that reach the k-th score, so no tie is lost before it is broken
        q, col = np.nonzero((score >= least) & (score > -np.inf))
        q, pid, score = np.concatenate([self.q, q]), np.concatenate([self.pid, pids[col]]), np.concatenate([self.score, score[q, col]])
        order = np.lexsort((pid, -score, q))
        q = q[order]
        starts = np.searchsorted(q, np.arange(self.n))
        place = np.arange(len(q)) - starts[q]
        keep = order[place < self.k]
        last = place == self.k - 1
        self.least[q[last], 0] = score[order[last]]
        self.q, self.pid, self.score = q[place < self.k], pid[keep], score[keep]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.q.astype(np.int32)), pa.array(self.pid), pa.array(self.score)], ["q", "pid", "score"])


def labelled(found: DataFrame, questions: DataFrame, q_id: str, qids: list) -> DataFrame:
    label = questions.sparkSession.createDataFrame(list(enumerate(qids)), f"q int, qid {questions.schema[q_id].dataType.simpleString()}")
    return found.join(F.broadcast(label), "q").select("qid", *[c for c in found.columns if c != "q"])


def stated(questions: DataFrame, columns: list, most: int) -> list:
    """The rows of a stated question set; more than ``most`` are refused, as they go to every task."""
    rows = questions.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} questions: ask them in parts")
    return rows


def hash_topk(questions: DataFrame, passages: DataFrame, *, q_id: str, q_text: str, id_col: str, text_col: str, k: int = 30, dim: int = 256) -> DataFrame:
    """(qid, pid, score, rank): the ``k`` passages with the highest cosine of hashed vectors; ties go to the lower pid.

    The question set goes to every worker, so it has to be a stated one;
    passages are scored where they lie and only each batch's best shuffle.
    """
    if k < 1:
        return nothing(questions, q_id)
    asked = stated(questions, [F.col(q_id).alias("qid"), F.coalesce(F.col(q_text), F.lit("")).alias("q")], 20_000)
    qids, wanted = [r.qid for r in asked], hash_vectors([r.q for r in asked], dim, {})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        top_rows = TopRows(len(qids), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                score = np.rint(wanted @ hash_vectors(part.column(1).to_pylist(), dim, known).T * 1e6) / 1e6
                top_rows.add(part.column(0).to_numpy(), score)
        yield top_rows.batch()

    rows = passages.select(F.col(id_col).cast("bigint").alias("pid"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("pid is not null")
    scored = rows.mapInArrow(best, "q int, pid bigint, score double").withColumnRenamed("q", "qid")
    found = top(scored, [F.desc("score"), "pid"], k).withColumnRenamed("qid", "q")
    return labelled(found, questions, q_id, qids).select("qid", "pid", "score", "rank")


def nothing(questions: DataFrame, q_id: str) -> DataFrame:
    """No rows, as for less than one result asked."""
    return questions.where("false").select(F.col(q_id).alias("qid"), F.lit(0).cast("bigint").alias("pid"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


#: Weights of the fields of a chunk in keyword search.
WEIGHTS = {"text": 1.0, "section": 2.0, "chapter": 0.5}


class Terms:
    """What is asked for by keyword, and how often a passage holds each."""

    def __init__(self, terms: list[tuple[tuple[str, ...], bool]]):
        self.words: dict[str, list[int]] = {}
        self.begins: dict[str, list[tuple[str, int]]] = {}
        self.phrases: dict[str, list[tuple[tuple[str, ...], int]]] = {}
        for no, (words, prefix) in enumerate(terms):
            if len(words) > 1:
                self.phrases.setdefault(words[0], []).append((words, no))
            elif prefix:
                # prefixes have four letters or more
                self.begins.setdefault(words[0][:4], []).append((words[0], no))
            else:
                self.words.setdefault(words[0], []).append(no)
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, token: str) -> tuple[int, ...]:
        if token not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            begun = [no for word, no in self.begins.get(token[:4], ()) if token.startswith(word)]
            self.known[token] = (*self.words.get(token, ()), *begun)
        return self.known[token]

    def count(self, tokens: list[str], weight: float, into: dict[int, float]) -> None:
        for token in tokens:
            for no in self.of(token):
                into[no] = into.get(no, 0.0) + weight
        for at, token in enumerate(tokens):
            for words, no in self.phrases.get(token, ()):
                if tuple(tokens[at : at + len(words)]) == words:
                    into[no] = into.get(no, 0.0) + weight


def keyword_topk(questions: DataFrame, chunks: DataFrame, *, q_id: str = "id", q_text: str = "question", id_col: str = "chunk_id", k: int = 30, sources: list[str] | None = None) -> DataFrame:
    """(qid, pid, score, rank): the ``k`` best chunks by weighted BM25 over text, section and chapter.

    A question's terms are those of ``match_terms``: phrases, words and
    beginnings of words. A term's idf is never under 1e-6; a term asked twice
    counts twice. Statistics are those of all chunks; ``sources`` (a column
    ``source`` of ``chunks``) restricts only what is returned. Nulls are empty
    fields; ties go to the lower pid.

    Terms of the stated question set go to every task. Chunks are read twice,
    once to count and once to score, and never shuffle: a task sends its counts
    per term and its ``k`` best per question.
    """
    terms = F.transform(match_terms(F.col(q_text)), lambda t: F.struct(F.array_join(t["words"], " ").alias("w"), t["prefix"].alias("p")))
    fields = [lowered(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in WEIGHTS]
    rows = chunks.select(F.col(id_col).cast("bigint").alias("pid"), *fields, (F.coalesce(F.col("source").isin(sources), F.lit(False)) if sources else F.lit(True)).alias("wanted"))

    def idf(n: float, df: np.ndarray) -> np.ndarray:
        plain = np.log((n - df + 0.5) / (df + 0.5))
        return np.where(plain > 0, plain, 1e-6)

    return scored_topk(questions.select(F.col(q_id).alias("qid"), terms.alias("terms")), rows, WEIGHTS, k=k, token=r"[^\W_]+", idf=idf)


def scored_topk(questions: DataFrame, rows: DataFrame, field_weights: dict[str, float], *, k: int, token: str, idf) -> DataFrame:
    """(qid, pid, score, rank) of (qid, terms) against (pid, wanted, fields in lower case); see ``keyword_topk``."""
    if k < 1:
        return nothing(questions, "qid")
    asked = stated(questions, ["qid", "terms"], 20_000)
    qids = [r.qid for r in asked]
    numbers: dict[tuple, int] = {}
    held = np.array([(q, numbers.setdefault((tuple(t.w.split(" ")), t.p), len(numbers))) for q, r in enumerate(asked) for t in r.terms], np.int64).reshape(-1, 2)
    terms = list(numbers)
    fields = list(field_weights)
    split = re.compile(token)

    def counted(batch: pa.RecordBatch, look: Terms) -> Iterator[tuple[int, dict[int, float]]]:
        for values in zip(*(batch.column(c).to_pylist() for c in fields)):
            into: dict[int, float] = {}
            size = 0
            for weight, value in zip(field_weights.values(), values):
                if value:
                    tokens = split.findall(value)
                    size += len(tokens)
                    look.count(tokens, weight, into)
            yield size, into

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, df, n, total = Terms(terms), np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for size, into in counted(batch, look):
                n, total = n + 1, total + size
                df[list(into)] += 1
        at = np.concatenate([[-2, -1], np.flatnonzero(df)])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.concatenate([[n, total], df[df > 0]]))], ["term", "n"])

    # a row for each term of the stated set and two more
    counts = {r.term: r.n for r in rows.mapInArrow(tally, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = counts.get(-2, 0), counts.get(-1, 0)
    df = np.array([counts.get(i, 0) for i in range(len(terms))], np.float64)
    mean = total / n if n else 1.0
    weights = np.zeros((len(qids), len(terms)))
    np.add.at(weights, (held[:, 0], held[:, 1]), 1.0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, top_rows = Terms(terms), TopRows(len(qids), k)
        asks = weights * idf(n, df)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                wanted = np.array(part.column("wanted").to_pylist(), bool)
                value = np.zeros((len(terms), part.num_rows))
                for col, (size, into) in enumerate(counted(part, look)):
                    if wanted[col]:
                        grain = K1 * (1 - B + B * size / mean)
                        for no, f in into.items():
                            value[no, col] = f * (K1 + 1) / (f + grain)
                used = np.flatnonzero(value.any(axis=1))
                score = asks[:, used] @ value[used]
                top_rows.add(part.column("pid").to_numpy(), np.where(score > 0, np.rint(score * 1e6) / 1e6, -np.inf))
        yield top_rows.batch()

    scored = rows.where("pid is not null").mapInArrow(best, "q int, pid bigint, score double").withColumnRenamed("q", "qid")
    found = top(scored, [F.desc("score"), "pid"], k).withColumnRenamed("qid", "q")
    return labelled(found, questions, "qid", qids).select("qid", "pid", "score", "rank")


def ranked_passages(questions: DataFrame, chunks: DataFrame, *, q_id: str = "id", q_text: str = "question", pool: int = 30, k: int = 4, hybrid: bool = True) -> DataFrame:
    """(qid, rank, pid, fused, vector_rank, keyword_rank, boosted): the search as a whole.

    Pools of ``pool`` chunks by hashed vectors and, unless ``hybrid`` is off, by
    keywords are fused by reciprocal ranks. Every chunk of a pool whose section
    holds one of the question's names, or a variant of one, gets one first rank
    more. Order: fused score, better vector rank, lower id. Of the best 2 ``k``
    equal texts count once, and ``k`` at most come out.
    """
    passages = with_headings(chunks)
    vector = hash_topk(questions, passages, q_id=q_id, q_text=q_text, id_col="pid", text_col="full", k=max(pool, k))
    ranked = vector.select("qid", "pid", "rank", F.col("rank").alias("vector_rank"))
    if hybrid:
        keyword = keyword_topk(questions, chunks, q_id=q_id, q_text=q_text, k=max(pool, k))
        ranked = ranked.unionByName(keyword.select("qid", "pid", "rank", F.col("rank").alias("keyword_rank")), allowMissingColumns=True)
    else:
        ranked = ranked.withColumn("keyword_rank", F.lit(None).cast("int"))
    # at most 2 * pool rows for each question of the stated set
    fused = ranked.groupBy("qid", "pid").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("fused"), F.min("vector_rank").alias("vector_rank"), F.min("keyword_rank").alias("keyword_rank"))
    variants = questions.select(F.col(q_id).alias("qid"), name_variants(names(F.col(q_text))).alias("variants"))
    kept = passages.join(F.broadcast(fused), "pid").join(F.broadcast(variants), "qid")
    boosted = F.exists("variants", lambda v: F.contains(F.lower("section"), v))
    score = F.round(F.col("fused") + F.when(boosted, F.lit(1 / (RRF_K + 1))).otherwise(0.0), 9)
    body = F.md5(F.regexp_replace("text", r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$", ""))
    cols = ["qid", "pid", "vector_rank", "keyword_rank"]
    order = [F.desc("fused"), F.asc_nulls_last("vector_rank"), "pid"]
    first = top(kept.select(*cols, score.alias("fused"), boosted.alias("boosted"), body.alias("body")), order, 2 * k)
    once = first.withColumn("r", F.row_number().over(Window.partitionBy("qid", "body").orderBy("rank"))).where("r = 1")
    return top(once.drop("rank"), order, k).select("qid", "rank", "pid", "fused", "vector_rank", "keyword_rank", "boosted")


def shown_passages(ranked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``ranked`` with what a reader sees: source, citation, label, path of headings, text and by which ranking it was found."""
    one = chunks.join(F.broadcast(ranked), F.col("chunk_id") == F.col("pid"))
    sourced = one.join(documents.select(F.col("doc_id").alias("document_id"), "source"), "document_id")
    cited = citation(F.col("source"), F.col("page_start"), F.col("page_end"))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), cited)
    section = F.coalesce("section", F.lit(""))
    by = F.array_compact(F.array(F.concat(F.lit("vector #"), F.col("vector_rank").cast("string")), F.concat(F.lit("keyword #"), F.col("keyword_rank").cast("string"))))
    return sourced.select(
        *ranked.columns, "source", cited.alias("citation"), F.when(section == "", head).otherwise(F.concat(head, F.lit(" - "), section)).alias("label"),
        heading_path(F.col("chapter"), F.col("section")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.array_join(by, ", ").alias("found_by"),
    )


def hybrid_passages(questions: DataFrame, chunks: DataFrame, *, q_id: str = "id", q_text: str = "question", pool: int = 30, k: int = 5) -> DataFrame:
    """(qid, pid, score, rank): the ``k`` best chunks by vector and keyword ranks together.

    Both pools hold ``pool`` chunks. Every chunk of a pool whose section holds
    one of the question's names, or a variant of one, counts as first in one
    more ranking, whatever their number. Ties go to the better vector rank,
    then the lower id; of the best 2 ``k``, equal texts are kept once.
    """
    passages = with_headings(chunks)
    given = {"q_id": q_id, "q_text": q_text, "id_col": "pid", "text_col": "full", "k": pool}
    vector, keyword = hash_topk(questions, passages, **given), bm25(questions, passages, **given)
    ranked = vector.select("qid", "pid", "rank", F.col("rank").alias("vector_rank")).unionByName(keyword.select("qid", "pid", "rank"), allowMissingColumns=True)
    fused = ranked.groupBy("qid", "pid").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("fused"), F.min("vector_rank").alias("vector_rank"))
    variants = questions.select(F.col(q_id).alias("qid"), name_variants(names(F.col(q_text))).alias("variants"))
    # at most 2 * pool rows for each question
    kept = passages.join(F.broadcast(fused), "pid").join(F.broadcast(variants), "qid")
    held = F.exists("variants", lambda v: F.contains(F.lower("section"), v))
    score = F.round(F.col("fused") + F.when(held, F.lit(1 / (RRF_K + 1))).otherwise(0.0), 9)
    body = F.md5(F.regexp_replace("text", r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$", ""))
    first = top(kept.select("qid", "pid", "vector_rank", score.alias("score"), body.alias("body")), [F.desc("score"), F.asc_nulls_last("vector_rank"), "pid"], 2 * k)
    once = first.withColumn("r", F.row_number().over(Window.partitionBy("qid", "body").orderBy("rank"))).where("r = 1")
    return top(once.withColumnRenamed("rank", "before"), ["before"], k).select("qid", "pid", "score", "rank")
