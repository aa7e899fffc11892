"""From ranked passages to answers: gate, context, messages, extracted answers, citations, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import DECLINES, cited_ranks, collapsed, contains_all, is_fallback
from docquarry.operators.search import hash_topk, with_headings

__all__ = ["DECLINES", "FALLBACK", "RULES", "best_scores", "contexts", "extractive_answers", "finalize", "gate", "messages", "verdicts"]

# Fixed value: the answer where nothing relevant was found.
FALLBACK = "I don't have that information in the provided documents."
#: What the model is told; callers may give their own.
RULES = "Answer from the numbered passages only and cite them as [n]. If they do not hold the answer, say: " + FALLBACK


def best_scores(questions: DataFrame, chunks: DataFrame, *, q_id: str = "id", q_text: str = "question") -> DataFrame:
    """(qid, best_score): the highest cosine of a question's hashed vector to any chunk, not only to those returned."""
    return hash_topk(questions, with_headings(chunks), q_id=q_id, q_text=q_text, id_col="pid", text_col="full", k=1).select("qid", F.col("score").alias("best_score"))


def gate(scores: DataFrame, *, least: float) -> DataFrame:
    """``scores`` with ``fallback``: the answer given without a model where the best score is under ``least`` (0: never)."""
    return scores.withColumn("fallback", F.when(F.lit(least > 0) & (F.col("best_score") < least), FALLBACK))


def contexts(shown: DataFrame) -> DataFrame:
    """(qid, context, texts, n_passages): a question's passages in one text, each under its number, citation and headings."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("citation"))
    block = F.concat(F.when(F.col("path") == "", head).otherwise(F.concat(head, F.lit(" - "), F.col("path"))), F.lit("\n"), F.col("text"))
    # as many as passages are returned for a question
    rows = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), "text"))).alias("b"))
    return rows.select("qid", F.array_join(F.col("b.block"), "\n\n").alias("context"), F.array_join(F.col("b.text"), "\n").alias("texts"), F.size("b").cast("bigint").alias("n_passages"))


def messages(questions: DataFrame, context: DataFrame, *, q_id: str = "id", q_text: str = "question", rules: str = RULES) -> DataFrame:
    """(qid, messages): what a chat model is sent, an array of (role, content); questions without passages send nothing."""
    asked = questions.select(F.col(q_id).alias("qid"), collapsed(F.coalesce(F.col(q_text), F.lit(""))).alias("asked")).join(context, "qid")
    user = F.concat(F.lit("Context passages:\n\n"), F.col("context"), F.lit("\n\n---\nQuestion: "), F.col("asked"), F.lit("\nAnswer (with [n] citations):"))
    sent = [F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", F.lit(rules)), ("user", user))]
    return asked.select("qid", F.array(*sent).alias("messages"))


def extractive_answers(questions: DataFrame, shown: DataFrame, *, q_id: str = "id", sentences: int = 2) -> DataFrame:
    """(qid, answer) without a model: the first sentences of the first passage and its number, or the fallback."""
    first = shown.where("rank = 1").select("qid", "text")
    parts = F.slice(F.split(collapsed(F.col("text")), r"(?<=[.!?])\s+"), 1, sentences)
    answer = F.trim(F.concat(F.array_join(parts, " "), F.lit(" [1]")))
    return questions.select(F.col(q_id).alias("qid")).join(first, "qid", "left").select("qid", F.when(F.col("text").isNull(), FALLBACK).otherwise(answer).alias("answer"))


def finalize(answered: DataFrame, shown: DataFrame, gated: DataFrame) -> DataFrame:
    """(qid, answer, llm_called, declined, sources, best_score) of each question.

    A gated question gets the fallback; an empty answer becomes it. Declined is
    what was not asked of the model or says so. Sources are the labels of cited
    passages in the order of first use, none if declined.
    """
    asked = answered.join(gated, "qid", "left")
    called = F.col("fallback").isNull()
    text = F.trim(F.coalesce("fallback", "answer"))
    final = asked.select("qid", F.when(text == "", FALLBACK).otherwise(text).alias("answer"), called.alias("llm_called"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))
    final = final.withColumn("declined", ~F.col("llm_called") | is_fallback(F.col("answer")))
    held = shown.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("rank", "label"))).alias("by_rank"))
    ranks = cited_ranks(F.col("answer"), F.coalesce(F.size("by_rank"), F.lit(0)))
    used = F.filter(F.transform(ranks, lambda n: F.try_element_at("by_rank", n)), lambda x: x.isNotNull())
    with_sources = final.join(held, "qid", "left").withColumn("sources", F.when(F.col("declined") | F.col("by_rank").isNull(), "").otherwise(F.array_join(used, "; ")))
    return with_sources.select("qid", "answer", "llm_called", "declined", "sources", F.round("best_score", 4).alias("best_score"))


def verdicts(questions: DataFrame, final: DataFrame, context: DataFrame, *, q_id: str = "id") -> DataFrame:
    """``final`` judged: ``keywords_ok``, ``retrieval_hit`` and ``correct``.

    An answerable question is right if it was not declined and its answer holds
    a word of every group of ``must_include``; a hit is the same of its
    passages, null without groups. Another is right if declined, the rest null.
    """
    asked = questions.select(F.col(q_id).alias("qid"), "answerable", F.coalesce("must_include", F.array()).alias("must_include"))
    rows = final.join(asked, "qid").join(context.select("qid", "texts"), "qid", "left")
    ok = ~F.col("declined") & contains_all(F.col("answer"), F.col("must_include"))
    hit = F.when(F.size("must_include") > 0, contains_all(F.coalesce("texts", F.lit("")), F.col("must_include")))
    return rows.select(*final.columns, F.when(F.col("answerable"), ok).alias("keywords_ok"), F.when(F.col("answerable"), hit).alias("retrieval_hit"), F.when(F.col("answerable"), ok).otherwise(F.col("declined")).alias("correct"))
