"""View queries over entity metrics: search, filter, sort, top-k, compare, graph.

``metrics`` here also has ``rank_trend``, ``mentions_change`` and ``models`` (array of the model ids
that mention the entity).  Every view works on all snapshots at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from answerlens import schemas as S
from answerlens.functions import scores as SC
from answerlens.operators.scale import ranked_evenly, top_k, with_group_total

# How many rows a view shows.
GRAPH_ITEMS = CHART_ITEMS = TABLE_MAX = 12
TABLE_MIN, TABLE_PERCENT = 3, 30
TOP_PER_SECTION, TOP_OVERALL, COMPETITORS = 1, 7, 5


def search(df: DataFrame, term: str, fields: list[str], model_names: DataFrame | None = None) -> DataFrame:
    """Rows with the term in any field, ignoring case; ``models`` is searched by display name."""
    if not term:
        return df
    needle = F.lit(term.lower())
    plain = [c for c in fields if c != "models"]
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle) for c in plain], F.lit(False))
    if "models" not in fields or model_names is None:
        return df.filter(hit)
    named = model_names.filter(F.lower("display_name").contains(needle)).groupBy("project").agg(
        F.collect_set("model_id").alias("__ids")
    )
    return (
        df.join(named, "project", "left")
        .filter(hit | F.coalesce(F.arrays_overlap("models", "__ids"), F.lit(False))).drop("__ids")
    )


def filter_models(df: DataFrame, selected: list[str] | None) -> DataFrame:
    """Entities mentioned by any selected model; none selected keeps all."""
    if not selected:
        return df
    return df.filter(F.arrays_overlap("models", F.array(*[F.lit(m) for m in selected])))


def filter_trends(df: DataFrame, codes: list[int] | None) -> DataFrame:
    """Entities whose rank trend is among the codes; none selected keeps all."""
    return df.filter(F.col("rank_trend").isin([int(c) for c in codes])) if codes else df


def filter_question(df: DataFrame, known: DataFrame, question_id: str | None) -> DataFrame:
    """Combined-level entities that the given question knows."""
    if question_id is None:
        return df
    keys = ["project", "date", "section", "entity"]
    return df.join(known.filter(F.col("question_id") == question_id).select(*keys), keys, "left_semi")


def sort_order(column: str, descending: bool = True, text: bool = False) -> list[Column]:
    """Sort key of a view: missing numbers count as 0; text ignores case; ties by entity."""
    key = F.lower(F.col(column)) if text else F.coalesce(F.col(column), F.lit(0))
    return [key.desc() if descending else key.asc(), F.col("entity").asc()]


def visible_rows(df: DataFrame, keys: list[str], order: list[Column], value: str | None = None) -> DataFrame:
    """Rows a table shows at first: 30 % of the group, between 3 and 12."""
    listed = top_k(df, keys, order, TABLE_MAX)
    limit = F.greatest(F.lit(TABLE_MIN), F.least(F.floor(F.col("__n") * TABLE_PERCENT / 100), F.lit(TABLE_MAX)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return listed.join(sizes, keys).filter(F.col("rank") <= limit).drop("__n")


def entity_view(df: DataFrame, spec: dict, model_names: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Declarative view: search, model, trend and question filter, sort, top-k per snapshot and section.

    spec keys: search, search_fields, models, trends, question, sort_by, descending, limit.
    """
    out = search(df, spec.get("search", ""), spec.get("search_fields", ["entity"]), model_names)
    out = filter_models(out, spec.get("models"))
    out = filter_trends(out, spec.get("trends"))
    if known is not None:
        out = filter_question(out, known, spec.get("question"))
    order = sort_order(spec.get("sort_by", "influence"), spec.get("descending", True))
    return top_k(out, S.SECTION, order, spec.get("limit", GRAPH_ITEMS), "place")


def top_influencers(metrics: DataFrame) -> DataFrame:
    """Best entity of each section with influence > 0, then the best seven of a snapshot."""
    live = metrics.filter(F.col("influence") > 0)
    order = [F.desc("influence"), F.asc("entity")]
    best = top_k(live, S.SECTION, order, TOP_PER_SECTION, "__r").drop("__r")
    return top_k(best, S.SNAPSHOT, [F.desc("influence"), F.asc("section"), F.asc("entity")], TOP_OVERALL, "place")


def compare_entities(metrics: DataFrame, names: DataFrame, models: DataFrame) -> DataFrame:
    """Side-by-side figures of the named entities; coverage is the share of the project's models."""
    wanted = names.select("project", "section", "entity").distinct()
    totals = models.groupBy("project").agg(F.countDistinct("model_id").alias("all_models"))
    percent = F.when(F.col("influence") <= 1, F.col("influence") * 100).otherwise(F.col("influence"))
    return (
        metrics.join(wanted, ["project", "section", "entity"], "left_semi").join(totals, "project", "left")
        .select(
            *S.ENTITY, "mentions", percent.cast("double").alias("influence"), F.col("rank_trend").alias("trend"),
            "mentions_change", F.size("models").cast("long").alias("model_count"),
            SC.ratio(F.size("models") * 100, F.col("all_models"), 2).alias("coverage"),
        )
    )


def competitors(metrics: DataFrame, targets: DataFrame, k: int = COMPETITORS) -> DataFrame:
    """Best ``k`` other entities of each target's section by influence.

    ``targets``: project, section, entity.  Only the section's best k + 1 are needed, since at
    most one of them is the target itself.  ``leads`` tells whether the target has more influence
    than the first; ``rising`` counts competitors whose trend is UP.
    """
    order = [F.desc("influence"), F.asc("entity")]
    best = top_k(metrics, S.SECTION, order, k + 1, "__place").select(
        *S.SECTION, "__place", F.col("entity").alias("competitor"), F.col("influence").alias("competitor_influence"),
        F.col("mentions").alias("competitor_mentions"), F.col("rank_trend").alias("competitor_trend"),
    )
    mine = metrics.join(targets.select("project", "section", "entity").distinct(), ["project", "section", "entity"]).select(
        *S.ENTITY, "influence"
    )
    others = mine.join(best, S.SECTION).filter(F.col("competitor") != F.col("entity"))
    # At most k + 1 rows per target.
    first = top_k(others, S.ENTITY, [F.asc("__place")], k, "place").drop("__place")
    summary = first.groupBy(*S.ENTITY).agg(
        F.count_if(F.col("competitor_trend") == S.TREND_UP).alias("rising"),
        F.max("competitor_influence").alias("__best"),
    )
    return first.join(summary, S.ENTITY).withColumn("leads", F.col("influence") > F.col("__best")).drop("__best")


def mention_graph(facts: DataFrame, metrics: DataFrame, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) linking entities to the models that mention them.

    Entity size is its influence (mentions of one model if selected); degree is the edge count.
    """
    mentioned = facts.filter(F.col("mentions") > 0)
    if model is not None:
        mentioned = mentioned.filter(F.col("model_id") == model)
    edges = mentioned.select(*S.ENTITY, "model_id", "mentions")
    degree = edges.groupBy(*S.ENTITY).agg(F.count(F.lit(1)).alias("degree"), F.sum("mentions").alias("selected"))
    sized = degree.join(metrics.select(*S.ENTITY, "influence"), S.ENTITY)
    entities = sized.select(
        *S.SECTION, F.lit("entity").alias("kind"), F.col("entity").alias("node"), "degree",
        (F.col("influence") if model is None else F.col("selected")).cast("double").alias("size"),
    )
    models = edges.groupBy(*S.SECTION, "model_id").agg(F.count(F.lit(1)).alias("degree")).select(
        *S.SECTION, F.lit("model").alias("kind"), F.col("model_id").alias("node"), "degree",
        F.lit(None).cast("double").alias("size"),
    )
    return entities.unionByName(models), edges


def sources_for_model(sources: DataFrame, model: str | None) -> DataFrame:
    """Sources whose model list contains the model."""
    return sources if model is None else sources.filter(F.array_contains("models", model))


def all_entities(metrics: DataFrame) -> DataFrame:
    """All sections of a snapshot in one list by influence; place 1 is the default selection."""
    place = F.struct((-F.coalesce("influence", F.lit(0))).alias("influence"), "section", "entity")
    return ranked_evenly(metrics, S.SNAPSHOT, place, "place")


def question_view(questions: DataFrame, term: str = "", sort_by: str = "question_no", descending: bool = False) -> DataFrame:
    """Questions with the term in text, id or number, sorted."""
    out = questions
    if term:
        needle = F.lit(term.lower())
        fields = [F.lower("text"), F.lower("question_id"), F.col("question_no").cast("string")]
        out = out.filter(reduce(lambda a, b: a | b, [c.contains(needle) for c in fields]))
    col = F.lower(sort_by) if dict(out.dtypes)[sort_by] == "string" else F.col(sort_by)
    return out.orderBy(col.desc() if descending else col.asc(), "question_id")


def total_reach(models: DataFrame) -> DataFrame:
    """Monthly users of all models of a project."""
    return models.groupBy("project").agg(F.sum("estimated_mau").alias("reach"))


def chart_series(metrics: DataFrame, y: list[str], k: int = CHART_ITEMS) -> DataFrame:
    """Label and y values of the best ``k`` entities of each section by the first y column."""
    return top_k(metrics, S.SECTION, sort_order(y[0]), k, "place").select(
        *S.SECTION, "place", F.col("entity").alias("label"), *y
    )


def question_breakdown(metrics: DataFrame, questions: DataFrame) -> DataFrame:
    """Per entity over questions: those with mentions, with count and text."""
    texts = questions.select("project", "question_id", "text")
    return metrics.filter(F.col("mentions") > 0).join(texts, ["project", "question_id"], "left").select(
        "project", "date", "section", "entity", "question_id", "mentions", "text"
    )


def coverage_weight(metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight of the models mentioning an entity relative to all models, within 0..1."""
    w = with_group_total(weights.select("project", "model_id", "weight"), ["project"], total=F.sum("weight"))
    share = w.select("project", "model_id", (F.col("weight") / F.col("total")).alias("part"))
    listed = metrics.select(*S.ENTITY, F.explode(F.array_distinct("models")).alias("model_id"))
    return listed.join(share, ["project", "model_id"], "left").groupBy(*S.ENTITY).agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.coalesce("part", F.lit(0.0))))).alias("coverage_weight")
    )
