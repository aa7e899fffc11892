"""Retrieval and answer metrics of logged runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.text import collapsed, contains_all, is_fallback, markdown_cell


def share(num: Column, den: Column) -> Column:
    """``3/4 (75%)``, or ``n/a`` of none."""
    percent = F.bround(100.0 * num / den, 0).cast("int").cast("string")
    return F.when(den == 0, "n/a").otherwise(F.concat(num.cast("string"), F.lit("/"), den.cast("string"), F.lit(" ("), percent, F.lit("%)")))


def judged(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Logged answers judged anew by the question set: ``result_id``, ``declined_now``, ``keywords_now``, ``correct_now``.

    Declined is what was not asked of the model or says so; null answers are
    empty. Answers to questions that are not in the set are left out.
    """
    asked = questions.select("id", F.col("answerable").alias("can"), F.coalesce("must_include", F.array()).alias("groups"))
    text = F.coalesce("answer", F.lit(""))
    rows = results.select("result_id", "id", "answer", "llm_called").join(F.broadcast(asked), "id")  # the stated question set
    declined = ~F.coalesce("llm_called", F.lit(False)) | is_fallback(text)
    ok = ~declined & contains_all(text, F.col("groups"))
    return rows.select("result_id", declined.alias("declined_now"), F.when(F.col("can"), ok).alias("keywords_now"), F.when(F.col("can"), ok).otherwise(declined).alias("correct_now"))


def eval_summary(results: DataFrame) -> DataFrame:
    """Per run: questions and shares of right answers, hits, declines and citations, each with its own denominator.

    Right answers and false declines count among the answerable, hits among
    those of them with one known, right declines among the others, citations
    among the replies. Nulls count as false.
    """

    def count(*conditions: Column) -> Column:
        every = conditions[0]
        for c in conditions[1:]:
            every = every & c
        return F.count_if(F.coalesce(every, F.lit(False)))

    can, cannot = F.coalesce("answerable", F.lit(False)), ~F.coalesce("answerable", F.lit(False))
    declined, hit = F.coalesce("declined", F.lit(False)), F.col("retrieval_hit")
    return results.groupBy("run_id").agg(
        F.count("*").alias("questions"),
        share(count(F.col("correct")), F.count("*")).alias("overall"),
        share(count(can, F.col("keywords_ok")), count(can)).alias("answer_accuracy"),
        share(count(can, hit), count(can, hit.isNotNull())).alias("retrieval_hit"),
        share(count(can, declined), count(can)).alias("false_declines"),
        share(count(cannot, declined), count(cannot)).alias("decline_accuracy"),
        share(count(~declined, F.col("cited")), count(~declined)).alias("citation_rate"),
    )


def nearest_rank(values: DataFrame, group: str, value: str, place: Column, bins: int = 1000) -> DataFrame:
    """(group, value): of each group the value at 0-based ``place`` (of its count ``n``) in ascending order.

    Values are counted in ``bins`` equal bins between each group's least and
    greatest; only the values of the bin that holds the place are ordered, so no
    task sees all values of a group. Repeated values are counted, not kept.
    """
    per = values.groupBy(group, value).agg(F.count("*").alias("c"))
    span = per.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("c").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = per.join(F.broadcast(span), group).withColumn("bin", F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width))).otherwise(0).cast("int"))
    before = Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = binned.groupBy(group, "bin").agg(F.sum("c").alias("in_bin"), F.max("n").alias("n"))  # at most ``bins`` rows a group
    held = counted.withColumn("before", F.coalesce(F.sum("in_bin").over(before), F.lit(0))).withColumn("place", place.cast("bigint"))
    held = held.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("in_bin"))).select(group, "bin", "before", "place")
    upto = Window.partitionBy(group).orderBy(value)
    inside = binned.join(F.broadcast(held), [group, "bin"]).withColumn("upto", F.col("before") + F.sum("c").over(upto))
    return inside.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place"))).select(group, value)


def latency_stats(results: DataFrame, value: str = "total_s") -> DataFrame:
    """Per run, of the rows asked of the model: mean, median (between two of an even number) and 95th percentile by nearest rank.

    The rank is 0.95 of the last, rounded half to even. Nulls and NaN do not count.
    """
    rows = results.where(F.col("llm_called") & F.col(value).isNotNull() & ~F.isnan(value)).select("run_id", value)
    n = F.col("n")

    def at(place: Column, name: str) -> DataFrame:
        return nearest_rank(rows, "run_id", value, place).withColumnRenamed(value, name)

    low, high = at(F.floor((n - 1) / 2), "low"), at(F.floor(n / 2), "high")
    p95 = at(F.bround(F.lit(0.95) * (n - 1), 0), "p95")
    mean = rows.groupBy("run_id").agg(F.round(F.avg(value), 6).alias("mean_s"))
    every = mean.join(low, "run_id").join(high, "run_id").join(p95, "run_id")
    return every.select("run_id", "mean_s", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median_s"), F.round("p95", 6).alias("p95_s"))


def suggest_threshold(results: DataFrame) -> DataFrame:
    """(run_id, threshold, n_right, n): per run the score from which questions should be let through.

    Scores are taken with four digits, so a run has at most a few tens of
    thousands of them. Candidates lie between two scores and beyond both ends;
    of those that judge most questions rightly (answerable at or above, others
    below) the middle one is given, rounded to three digits. A run with only
    one of both kinds has no row. Null and NaN scores do not count.
    """
    scored = results.where("best_score is not null and not isnan(best_score) and answerable is not null")
    per = scored.groupBy("run_id", F.round("best_score", 4).alias("s")).agg(F.count_if(F.col("answerable")).alias("a"), F.count_if(~F.col("answerable")).alias("u"))
    totals = per.groupBy("run_id").agg(F.sum("a").alias("all_a"), F.sum("u").alias("all_u"), F.min("s").alias("s0")).where("all_a > 0 and all_u > 0")
    order = Window.partitionBy("run_id").orderBy("s")
    run = per.join(totals, "run_id").withColumn("upto_a", F.sum("a").over(order)).withColumn("upto_u", F.sum("u").over(order)).withColumn("after", F.lead("s").over(order))
    mid = F.coalesce((F.col("s") + F.col("after")) / 2, F.col("s") + 0.01)
    above = run.select("run_id", mid.alias("t"), (F.col("all_a") - F.col("upto_a") + F.col("upto_u")).alias("n_right"), (F.col("all_a") + F.col("all_u")).alias("n"))
    first = totals.select("run_id", (F.col("s0") - 0.01).alias("t"), F.col("all_a").alias("n_right"), (F.col("all_a") + F.col("all_u")).alias("n"))
    every = above.unionByName(first)
    best = every.groupBy("run_id").agg(F.max("n_right").alias("n_right"))
    good = every.join(best, ["run_id", "n_right"])
    w = Window.partitionBy("run_id")
    placed = good.withColumn("r", F.row_number().over(w.orderBy("t"))).withColumn("c", F.count("*").over(w))
    return placed.where(F.col("r") == F.floor(F.col("c") / 2) + 1).select("run_id", F.round("t", 3).alias("threshold"), "n_right", "n")


def report_rows(results: DataFrame) -> DataFrame:
    """Rows of a report for reading: question and answer as table cells, a verdict, and an empty column for remarks."""
    verdict = F.when(F.col("correct"), "right").when(F.col("correct").isNull(), "open").otherwise("wrong")
    cell = F.replace(collapsed(F.coalesce("question", F.lit(""))), F.lit("|"), F.lit("\\|"))
    return results.select("result_id", "id", cell.alias("question"), markdown_cell(F.coalesce("answer", F.lit(""))).alias("answer"), verdict.alias("verdict"), F.lit("").alias("manual_review"))


def threshold_curve(results: DataFrame, step: float = 0.05) -> DataFrame:
    """Per score bin: answerable and other questions, from which a relevance threshold is read."""
    binned = results.where("best_score is not null and not isnan(best_score)").withColumn("bin", F.floor(F.col("best_score") / step).cast("bigint"))
    return binned.groupBy("bin").agg(F.count_if(F.col("answerable")).alias("n_answerable"), F.count_if(~F.col("answerable")).alias("n_other"))
