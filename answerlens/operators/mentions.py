"""Mention facts, shares, appearance rank and share of voice.

``hits`` below are sparse facts (mentions > 0) at grain project, question_id, date, section,
entity, model_id with ``mentions`` and ``pos``.  Unmentioned cells are added only where an output
asks for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerlens import schemas as S
from answerlens.functions import scores as SC
from answerlens.functions import urls as U
from answerlens.operators import matching
from answerlens.operators.scale import materialize, ranked_evenly, with_group_total
from answerlens.operators.trends import earlier_values

# Reach at which a model has full weight, and the weight without known reach.
FULL_REACH = 1_000_000_000
DEFAULT_WEIGHT = 0.5
# Answers whose excerpts of a name are listed in one row.
ANSWERS_PER_LIST = 64


def mention_hits(answers: DataFrame, entities: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Sparse facts: hits summed over the answers of a snapshot, and the earliest position.

    ``matched`` are the matches of these entities, and maybe of more, where they are known.
    """
    keys = matching._group_keys(answers, entities)
    by_term = (
        (matching.match_entities(answers, entities) if matched is None else matched)
        .groupBy(*S.SNAPSHOT, "model_id", "term")
        .agg(F.sum("mentions").alias("mentions"), F.min("pos").alias("pos"))
    )
    term = F.when(F.col("section") == "links", F.coalesce(
        F.nullif(U.hostname(F.col("entity")), F.lit("")), F.lower("entity")
    )).otherwise(F.lower("entity"))
    named = entities.select(*keys, "section", "entity", "ord", term.alias("term"))
    return by_term.join(named, keys + ["term"]).select(
        *S.ENTITY, "ord", "model_id", "mentions", "pos"
    )


def mention_facts(
    hits: DataFrame, entities: DataFrame, models: DataFrame, dates: DataFrame
) -> DataFrame:
    """Dense facts: every entity with every model of its project, 0 / -1 where not mentioned.

    ``dates`` lists the snapshots (project, question_id, date) to fill.
    """
    per_snapshot = entities.join(dates, [c for c in S.SNAPSHOT if c in entities.columns])
    cells = per_snapshot.select(*S.ENTITY, "ord").join(
        models.select("project", "model_id"), "project"
    )
    found = hits.select(*S.ENTITY, "model_id", "mentions", "pos")
    return cells.join(found, S.ENTITY + ["model_id"], "left").select(
        *S.ENTITY, "ord", "model_id",
        F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"),
        F.coalesce("pos", F.lit(S.NOT_MENTIONED)).cast("long").alias("pos"),
    )


def excerpt_parts(excerpts: DataFrame, keys: list[str], answer: list[str], fields: list[str], per_part: int) -> DataFrame:
    """(keys, ``part_no``, ``excerpts``): excerpts per ``keys`` in order of answer and hit, at most ``per_part`` answers a row.

    ``answer`` are the columns that tell the answers of a group apart, ``fields`` those of a list entry; they begin with
    ``answer`` and ``hit_no``.  An answer has as many excerpts of a name as were asked for, so every list is bounded; the lists of a
    group follow each other by ``part_no``, from 0.
    """
    each = materialize(excerpts.groupBy(*keys, *answer).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("own")))
    placed = ranked_evenly(each, keys, F.struct(*answer), "__n")
    return (
        placed.withColumn("part_no", F.floor((F.col("__n") - 1) / per_part).cast("long"))
        .groupBy(*keys, "part_no").agg(F.array_sort(F.collect_list(F.struct("__n", "own"))).alias("parts"))
        .select(*keys, "part_no", F.flatten(F.transform("parts", lambda p: p["own"])).alias("excerpts"))
    )


def with_excerpts(facts: DataFrame, excerpts: DataFrame, per_part: int = ANSWERS_PER_LIST) -> DataFrame:
    """Mention facts with the excerpts of their answers, in order of answer and hit (null where not mentioned).

    Excerpts are found by the searched name, the lower-cased entity.  A fact has a row for every ``per_part`` answers
    that hold the name, numbered by ``part_no`` (0 where not mentioned).
    """
    keys = S.SNAPSHOT + ["model_id", "term"]
    listed = excerpt_parts(excerpts, keys, ["answer_id"], ["answer_id", "hit_no", "excerpt"], per_part)
    found = facts.withColumn("term", F.lower("entity")).join(listed, keys, "left").drop("term")
    return found.withColumn("part_no", F.coalesce("part_no", F.lit(0)).cast("long"))


def coverage(facts: DataFrame) -> DataFrame:
    """Per entity: the models that mention it (list and csv), their number, and all mentions."""
    mentioned = F.collect_set(F.when(F.col("mentions") > 0, F.col("model_id")))
    return (
        facts.groupBy(*S.ENTITY)
        .agg(
            F.sum("mentions").alias("mentions"),
            F.array_sort(mentioned).alias("models"),
        )
        .select(
            *S.ENTITY, "mentions", "models",
            F.size("models").cast("long").alias("model_count"),
            F.array_join("models", ",").alias("bots"),
        )
    )


def mention_share(facts: DataFrame) -> DataFrame:
    """Share of an entity in the mentions of its section, overall and per model."""
    by_model = facts.groupBy(*S.ENTITY, "model_id").agg(F.sum("mentions").alias("mentions"))
    by_model = with_group_total(
        by_model, S.SECTION + ["model_id"], model_total=F.sum("mentions")
    )
    totals = by_model.groupBy(*S.ENTITY).agg(F.sum("mentions").alias("entity_mentions"))
    totals = with_group_total(totals, S.SECTION, section_total=F.sum("entity_mentions"))
    return by_model.join(totals, S.ENTITY).select(
        *S.ENTITY, "model_id", "mentions",
        SC.ratio(F.col("mentions"), F.col("model_total")).alias("model_share"),
        SC.ratio(F.col("entity_mentions"), F.col("section_total")).alias("share"),
    )


def model_ranks(hits: DataFrame) -> DataFrame:
    """Mentioned facts with each entity's rank in its section and model, by first position.

    Facts without a known position (pos <= 0) keep a null rank.
    """
    placed = F.coalesce(F.col("pos") > 0, F.lit(False))
    last = F.lit(2**62)
    # Written, since ranks read them three times and hits may be measured from texts.
    return ranked_evenly(
        materialize(hits.filter(F.col("mentions") > 0)),
        S.SECTION + ["model_id"],
        F.struct(F.when(placed, F.col("pos")).otherwise(last).alias("pos"), "ord", "entity"),
        "model_rank",
    ).withColumn("model_rank", F.when(placed, F.col("model_rank")))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("mentions") > 0) if "model_rank" in hits.columns else model_ranks(hits)


def appearance_rank(facts: DataFrame, agg: str = "min") -> DataFrame:
    """Entity rank over models: minimum, or with ``agg='avg'`` the mean to two digits.

    999 where mentioned without position, -1 where not mentioned.
    """
    ranks = _ranked(facts).groupBy(*S.ENTITY).agg(
        (F.min("model_rank") if agg == "min" else SC.rounded(F.avg("model_rank"), 2)).alias("placed")
    )
    totals = facts.groupBy(*S.ENTITY).agg(F.sum("mentions").alias("mentions"))
    unplaced = F.when(F.col("mentions") > 0, S.UNKNOWN_RANK).otherwise(S.NOT_MENTIONED)
    rank = F.coalesce(F.col("placed"), unplaced)
    return totals.join(ranks, S.ENTITY, "left").select(
        *S.ENTITY, "mentions",
        rank.cast("long" if agg == "min" else "double").alias("rank"),
    )


def model_weights(models: DataFrame) -> DataFrame:
    """Reach weight per model of a project, summing to 1."""
    mau = F.col("estimated_mau")
    raw = F.when(mau > 0, F.least(mau / F.lit(FULL_REACH), F.lit(1.0))).otherwise(
        F.lit(DEFAULT_WEIGHT)
    )
    weighted = models.select("project", "model_id", "estimated_mau", raw.alias("raw"))
    return with_group_total(weighted, ["project"], total=F.sum("raw")).select(
        "project", "model_id", "estimated_mau", (F.col("raw") / F.col("total")).alias("weight")
    )


def prominences(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """Mentioned facts with rank, model weight and prominence; a ``model_rank`` that is there already is taken."""
    return (
        _ranked(hits)
        .join(weights.select("project", "model_id", "weight"),
              ["project", "model_id"], "left")
        .select(
            *S.ENTITY, "model_id", "mentions", "model_rank",
            F.coalesce("weight", F.lit(0.0)).alias("weight"),
            SC.prominence(F.col("mentions"), F.col("model_rank")).alias("prominence"),
        )
    )


def _with_section_max(prom: DataFrame) -> DataFrame:
    per_entity = prom.groupBy(*S.ENTITY).agg(
        F.sum("weight").alias("model_coverage"),
        F.sum("prominence").alias("prominence"),
        F.sum("mentions").alias("mentions"),
        F.sum(F.col("prominence") * F.col("weight")).alias("weighted"),
    )
    return with_group_total(per_entity, S.SECTION, top=F.max("prominence"))


def share_of_voice(prom: DataFrame) -> DataFrame:
    """Weight of the mentioning models x prominence relative to the section's best."""
    quality = F.when(F.col("top") > 0, F.col("prominence") / F.col("top")).otherwise(F.lit(0.0))
    return _with_section_max(prom).select(
        *S.ENTITY, "mentions",
        SC.rounded(F.col("model_coverage"), 5).alias("model_coverage"),
        SC.rounded(F.col("prominence"), 5).alias("prominence"),
        SC.rounded(F.col("model_coverage") * quality, 5).alias("share_of_voice"),
    )


def sov_by_model(prom: DataFrame) -> DataFrame:
    """A model's part: weight x prominence relative to the section's best."""
    per_entity = prom.groupBy(*S.ENTITY).agg(F.sum("prominence").alias("prominence"))
    tops = per_entity.groupBy(*S.SECTION).agg(F.max("prominence").alias("top"))
    return prom.join(tops, S.SECTION).select(
        *S.ENTITY, "model_id",
        F.when(
            F.col("top") > 0,
            SC.rounded(F.col("weight") * F.col("prominence") / F.col("top"), 5),
        ).otherwise(F.lit(0.0)).alias("share_of_voice"),
    )


def weighted_influence(prom: DataFrame) -> DataFrame:
    """Older formula: weighted sum of prominence, without the coverage factor."""
    return prom.groupBy(*S.ENTITY).agg(
        SC.rounded(F.sum(F.col("prominence") * F.col("weight")), 5).alias("influence")
    )


def normalize_to_max(df: DataFrame, value: str, keys: list[str] = S.SECTION) -> DataFrame:
    """Divide by the maximum of the group; unchanged where that is 0."""
    top = with_group_total(df, keys, __top=F.max(value))
    return top.withColumn(
        value, F.when(F.col("__top") > 0, SC.rounded(F.col(value) / F.col("__top"), 5)).otherwise(F.col(value))
    ).drop("__top")


def normalize_to_sum(df: DataFrame, value: str, keys: list[str] = S.SECTION) -> DataFrame:
    """Divide by the group total; unchanged where that is 0."""
    total = with_group_total(df, keys, __total=F.sum(value))
    return total.withColumn(
        value, F.when(F.col("__total") > 0, SC.rounded(F.col(value) / F.col("__total"), 5)).otherwise(F.col(value))
    ).drop("__total")


def entity_metrics(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """Entity grain: mentions, coverage, rank and share of voice in one frame."""
    prom = prominences(hits, weights)
    ranks = prom.groupBy(*S.ENTITY).agg(
        F.min("model_rank").alias("placed"),
        F.array_sort(F.collect_set("model_id")).alias("models"),
    )
    return share_of_voice(prom).join(ranks, S.ENTITY).select(
        *S.ENTITY, "mentions",
        F.coalesce("placed", F.lit(S.UNKNOWN_RANK)).cast("long").alias("rank"),
        "share_of_voice", "models", F.size("models").cast("long").alias("model_count"),
    )


def drop_unmentioned(metrics: DataFrame, lookback: int = 3) -> DataFrame:
    """Keep an entity with mentions now or on one of the ``lookback`` earlier snapshots."""
    past = earlier_values(metrics.select(*S.ENTITY, "mentions"), ["section", "entity"], lookback)
    seen = past.filter(F.col("mentions") > 0).select(*S.ENTITY).distinct()
    now = F.col("mentions") > 0
    gone = metrics.filter(~now).join(seen, S.ENTITY, "left_semi")
    return metrics.filter(now).unionByName(gone)
