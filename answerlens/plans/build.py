"""Project build: answers and entities in, all report tables out, for all snapshots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerlens import schemas as S
from answerlens.operators import attribution as A
from answerlens.operators import citations as C
from answerlens.operators import entities as E
from answerlens.operators import links as L
from answerlens.operators import matching
from answerlens.operators import mentions as M
from answerlens.operators import reports as R
from answerlens.operators import trends as T
from answerlens.operators.scale import materialize


def measure(
    answers: DataFrame, entities: DataFrame, all_answers: DataFrame | None = None, all_entities: DataFrame | None = None
) -> dict[str, DataFrame]:
    """What has to be read from the texts of a snapshot: ``links``, ``hits`` and ``excerpts``, from written links and matches.

    ``all_answers`` and ``all_entities`` are the all-questions level, measured beside the questions.
    """
    # Written, since the names to look for are gathered from them in several steps, each of which would read the texts anew.
    links = materialize(L.extract_links(answers))
    found = links.select(
        *S.SNAPSHOT, F.lit("links").alias("section"), F.col("link").alias("entity"),
        F.lit(0).cast("long").alias("ord"),
    )
    keys = [c for c in S.SNAPSHOT if c in entities.columns]
    given = entities.select(*keys, "section", "entity", "ord")
    matched, excerpts = matching.matches_and_excerpts(answers, given)
    hits = M.mention_hits(answers, given, matched).unionByName(M.mention_hits(answers, found))
    if all_answers is not None:
        hits = hits.unionByName(M.mention_hits(all_answers, all_entities))
    return {"links": links, "hits": hits, "excerpts": excerpts}


def derive(
    hits: DataFrame, links: DataFrame, excerpts: DataFrame, models: DataFrame, patterns: DataFrame
) -> dict[str, DataFrame]:
    """All report tables from what was measured; no text is read.  Facts and metrics are written."""
    links = L.classify_links(links, patterns)
    weights = M.model_weights(models)
    facts = materialize(M.model_ranks(hits))
    prom = M.prominences(facts, weights)
    by_model = M.sov_by_model(prom).withColumnRenamed("share_of_voice", "influence")
    metrics = materialize(M.entity_metrics(facts, weights)).withColumnRenamed(
        "share_of_voice", "influence"
    )
    trends = T.entity_trends(metrics)
    model_facts = facts.join(by_model, S.ENTITY + ["model_id"]).withColumnRenamed("model_rank", "rank")
    link_facts = (
        model_facts.filter(F.col("section") == "links")
        .select(*S.SNAPSHOT, F.col("entity").alias("link"), "model_id", "mentions", "rank", "influence")
        .join(links, S.SNAPSHOT + ["link"])
    )
    single = F.col("question_id") != S.ALL_QUESTIONS
    return {
        "facts": facts,
        "metrics": metrics,
        "coverage": M.coverage(facts),
        "shares": M.mention_share(facts),
        "influence_by_model": by_model,
        "links": links,
        "link_types": L.rollup_links(link_facts, "link_type"),
        "link_domains": L.rollup_links(link_facts, "domain"),
        "trends": trends,
        "model_trends": T.entity_model_trends(metrics, model_facts, models),
        "totals": R.report_totals(metrics),
        "items_per_model": R.items_per_model(facts, models),
        "items_per_trend": R.items_per_trend(trends),
        "excerpts": excerpts,
        "fact_excerpts": M.with_excerpts(facts.filter(single & (F.col("section") != "links")), excerpts),
        "merged_questions": R.merge_questions(facts.filter(single), metrics.filter(single), weights),
        "merged_excerpts": R.merged_excerpts(excerpts),
    }


def build(
    answers: DataFrame, entities: DataFrame, models: DataFrame, patterns: DataFrame,
    combined: bool = True, responses: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Lazy plans per output table; the mention facts, entity metrics and excerpts are written.

    ``entities`` needs ``question_no`` for the all-questions level.  Links found in the answers are
    measured like entities and rolled up to types and domains.  With ``responses`` the sources of each entity are
    attributed too, also to names that are not mentioned in their snapshot, and their answers come with citations.
    Excerpts come by answer, listed per fact and per name over all questions; ``merged_questions`` has one row per name
    of a date.
    """
    level = (E.combined_answers(answers), E.combine_questions(entities)) if combined else (None, None)
    parts = measure(answers, entities, *level)
    tables = derive(parts["hits"], parts["links"], parts["excerpts"], models, patterns)
    if responses is not None:
        dates = answers.select("project", "question_id", "date").distinct()
        named = entities.select("project", "question_id", "section", "entity").distinct()
        tables["sources"] = A.attribute_sources(
            responses, named.join(dates, ["project", "question_id"]), tables["facts"], dates.select("project", "date").distinct()
        )
        if "message" in responses.columns:
            cited = S.SNAPSHOT + ["model_id", "answer_id"]
            tables["citations"] = C.citations(responses, cited)
            tables["cited_answers"] = C.answers_with_citations(responses, cited)
    return tables
