"""Report summaries: totals, counts per model and trend, questions, cross-question merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerlens import schemas as S
from answerlens.functions import scores as SC
from answerlens.operators.mentions import ANSWERS_PER_LIST, excerpt_parts, share_of_voice


MINUTES_PER_ITEM = 5  # fixed value


def report_totals(metrics: DataFrame) -> DataFrame:
    """Items per section of a snapshot and over all sections (section null), and hours saved."""
    counts = metrics.groupBy(*S.SECTION).agg(F.count(F.lit(1)).alias("items"))
    total = counts.groupBy(*S.SNAPSHOT).agg(F.sum("items").alias("items")).withColumn(
        "section", F.lit(None).cast("string")
    )
    hours = F.ceil(F.col("items") * MINUTES_PER_ITEM / 60)
    return counts.unionByName(total).withColumn("hours_saved", hours.cast("long"))


def report_dates(metrics: DataFrame) -> DataFrame:
    """Distinct dates per question, newest first."""
    return metrics.select(*S.SNAPSHOT).distinct().groupBy("project", "question_id").agg(
        F.sort_array(F.collect_list("date"), asc=False).alias("dates")
    )


def items_per_model(facts: DataFrame, models: DataFrame) -> DataFrame:
    """Entities each model mentions per section, with 0 for the project's other models."""
    counts = facts.filter(F.col("mentions") > 0).groupBy(*S.SECTION, "model_id").agg(
        F.countDistinct("entity").alias("items")
    )
    cells = facts.select(*S.SECTION).distinct().join(
        models.select("project", "model_id"), "project"
    )
    return cells.join(counts, S.SECTION + ["model_id"], "left").withColumn(
        "items", F.coalesce("items", F.lit(0)).cast("long")
    )


def items_per_trend(trends: DataFrame) -> DataFrame:
    """Entities per section and rank-trend code; missing or 0 counts as unknown."""
    code = F.coalesce(F.nullif(F.col("rank_trend"), F.lit(0)), F.lit(S.TREND_UNKNOWN))
    return trends.groupBy(*S.SECTION, code.alias("trend")).agg(F.count(F.lit(1)).alias("items"))


def question_summary(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Number, text and answers per question and date; (project, date) totals in ``total_answers``."""
    counts = answers.groupBy(*S.SNAPSHOT).agg(F.count(F.lit(1)).alias("answers"))
    dates = counts.select("project", "date").distinct()
    totals = counts.groupBy("project", "date").agg(F.sum("answers").alias("total_answers"))
    number = F.coalesce(F.expr("try_cast(regexp_extract(question_id, '^(\\\\d+)-', 1) AS INT)"), F.lit(0))
    return (
        questions.join(dates, "project").join(counts, S.SNAPSHOT, "left").join(totals, ["project", "date"])
        .select(
            *S.SNAPSHOT, number.alias("question_no"), "text",
            F.coalesce("answers", F.lit(0)).cast("long").alias("answers"), "total_answers",
        )
    )


def merge_questions(facts: DataFrame, metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per lower-cased name over all questions of a date.

    Mentions: sum over models of the largest count any question has; per model the sum over
    questions; rank: mean of the positive ranks; share of voice is recomputed from the sums.
    ``facts`` carries ``model_rank`` for the recomputation.
    """
    item = ["project", "date", "section", "key"]
    keyed = facts.withColumn("key", F.lower("entity"))
    by_model = keyed.groupBy(*item, "model_id").agg(
        F.max("mentions").alias("most"), F.sum("mentions").alias("mentions"),
        F.min(F.when(F.col("model_rank") > 0, F.col("model_rank"))).alias("model_rank"),
    )
    weighted = by_model.join(
        weights.select("project", "model_id", "weight"), ["project", "model_id"], "left"
    )
    prom = weighted.filter(F.col("mentions") > 0).select(
        "project", F.lit(S.ALL_QUESTIONS).alias("question_id"), "date", "section", F.col("key").alias("entity"),
        "model_id", "mentions", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        SC.prominence(F.col("mentions"), F.col("model_rank")).alias("prominence"),
    )
    voice = share_of_voice(prom).select("project", "date", "section", F.col("entity").alias("key"), "share_of_voice")
    merged = by_model.groupBy(*item).agg(
        F.sum("most").alias("mentions"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model_id", "mentions")))).alias("mentions_by_model"),
    )
    by_question = metrics.withColumn("key", F.lower("entity")).groupBy(*item, "question_id").agg(
        F.max("entity").alias("entity"), F.sum("mentions").alias("mentions"),
        F.sum("influence").alias("influence"), F.min("rank").alias("rank"),
    ).groupBy(*item).agg(
        F.min_by("entity", "question_id").alias("entity"),
        SC.rounded(F.avg(F.when(F.col("rank") > 0, F.col("rank"))), 2).alias("rank"),
        F.count(F.lit(1)).alias("questions"),
        F.sort_array(F.collect_list(F.struct("question_id", "mentions", "influence", "rank"))).alias("by_question"),
    )
    return merged.join(by_question, item).join(voice, item, "left").select(
        "project", "date", "section", "entity", "mentions", "rank", "questions",
        F.coalesce("share_of_voice", F.lit(0.0)).alias("share_of_voice"),
        "mentions_by_model", "by_question",
    )


def merged_excerpts(excerpts: DataFrame, per_part: int = ANSWERS_PER_LIST) -> DataFrame:
    """Excerpts of a name over all questions of a date, per model, each tagged with its question.

    One row for every ``per_part`` answers of (project, date, term, model_id) that hold the name, numbered by ``part_no``.
    """
    keys, answer = ["project", "date", "term", "model_id"], ["question_id", "answer_id"]
    return excerpt_parts(excerpts, keys, answer, [*answer, "hit_no", "excerpt", "line", "col"], per_part)


def latest_reports(reports: DataFrame) -> DataFrame:
    """Newest report date per project and all dates, newest first."""
    return reports.select("project", "date").distinct().groupBy("project").agg(
        F.max("date").alias("latest"), F.sort_array(F.collect_list("date"), asc=False).alias("dates")
    )
