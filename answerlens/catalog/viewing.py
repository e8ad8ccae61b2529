"""Queries over report summaries and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.catalog.history import _PAST, _code
from answerlens.catalog.measure import _FACT_SOV
from answerlens.catalog.registry import query
from answerlens.functions import scores as SC
from answerlens.operators import mentions as M
from answerlens.operators import reports as R
from answerlens.operators import trends as T
from answerlens.operators import views as V

_KEY = "project, question_id, date, section"


def _metrics(i):
    m = i.view_metrics
    return m.withColumn("models", F.split("bots", ",")).drop("bots")


def _flat(df):
    return df.withColumn("bots", F.array_join("models", ",")).drop("models")


@query("report_totals", ["metrics"], """
with c as (select project, question_id, date, section, count(*) as items from metrics group by 1, 2, 3, 4)
select *, CAST(ceil(items * 5 / 60) AS BIGINT) as hours_saved from (
  select * from c union all select project, question_id, date, null, CAST(sum(items) AS BIGINT) from c group by 1, 2, 3)""")
def _totals(i):
    return R.report_totals(i.metrics)


@query("report_dates", ["metrics"], """
select project, question_id, string_agg(CAST(date AS VARCHAR), ',' order by date desc) as dates
from (select distinct project, question_id, date from metrics) group by 1, 2""")
def _dates(i):
    return R.report_dates(i.metrics).withColumn("dates", F.array_join(F.col("dates").cast("array<string>"), ","))


@query("items_per_model", ["facts", "fact_models"], f"""
with s as (select distinct {_KEY} from facts),
c as (select {_KEY}, model_id, count(distinct entity) as items from facts where mentions > 0 group by all)
select s.project, s.question_id, s.date, s.section, m.model_id, coalesce(c.items, 0) as items
from s join fact_models m on m.project = s.project
left join c on c.project = s.project and c.question_id = s.question_id and c.date = s.date and c.section = s.section and c.model_id = m.model_id""")
def _per_model(i):
    return R.items_per_model(i.facts, i.fact_models)


@query("items_per_trend", ["metrics"], _PAST + f"""
select m.project, m.question_id, m.date, m.section, {_code('m.rank', 'pr')} as trend, count(*) as items
from m left join agg using (project, question_id, date, section, entity) group by all""")
def _per_trend(i):
    t = T.entity_trends(i.metrics.withColumn("influence", F.col("influence").cast("double")))
    return R.items_per_trend(t)


@query("question_summary", ["named_answers"], """
with q as (select distinct project, question_id, 'About ' || lang as text from named_answers),
d as (select distinct project, date from named_answers),
c as (select project, question_id, date, count(*) as n from named_answers group by all)
select q.project, q.question_id, d.date, coalesce(try_cast(regexp_extract(q.question_id, '^(\\d+)-', 1) as int), 0) as question_no, q.text,
       coalesce(c.n, 0) as answers, CAST(sum(coalesce(c.n, 0)) over (partition by q.project, d.date) AS BIGINT) as total_answers
from q join d on d.project = q.project left join c on c.project = q.project and c.question_id = q.question_id and c.date = d.date""".replace("\\\\d", "\\d"))
def _questions(i):
    questions = i.named_answers.select("project", "question_id", F.concat(F.lit("About "), "lang").alias("text")).distinct()
    return R.question_summary(questions, i.named_answers)


@query("merge_questions", ["facts", "fact_models", "metrics"], _FACT_SOV + """,
bm as (
  select project, date, section, lower(entity) as key, model_id, max(mentions) as most, sum(mentions) as mentions, min(model_rank) as model_rank
  from ranked group by all
),
pm as (
  select b.*, w.weight, b.mentions / log2(b.model_rank + 1) as p from bm b join weights w on w.project = b.project and w.model_id = b.model_id
),
pe as (select project, date, section, key, CAST(sum(most) AS BIGINT) as mentions, sum(weight) as cov, sum(p) as p from pm group by all),
v as (select *, round(cov * p / max(p) over (partition by project, date, section), 5) as share_of_voice from pe),
mm as (
  select project, date, section, key, string_agg(concat(model_id, '=', CAST(mentions AS BIGINT)), ',' order by model_id) as by_model from bm group by all
),
bq as (
  select project, date, section, lower(entity) as key, arg_min(entity, question_id) as entity, round(avg(rank), 2) as rank, count(*) as questions,
         string_agg(concat(question_id, '=', mentions, '=', influence, '=', rank), ',' order by question_id) as by_question
  from metrics group by 1, 2, 3, 4
)
select project, date, section, bq.entity, v.mentions, bq.rank, bq.questions, v.share_of_voice, mm.by_model, bq.by_question
from v join bq using (project, date, section, key) join mm using (project, date, section, key)""")
def _merge(i):
    weights = M.model_weights(i.fact_models)
    ranked = M.model_ranks(i.facts)
    pairs = F.transform(F.array_sort(F.map_entries("mentions_by_model")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    parts = F.transform("by_question", lambda q: F.concat_ws(
        "=", q["question_id"], q["mentions"].cast("string"), q["influence"].cast("string"), q["rank"].cast("string")
    ))
    return R.merge_questions(ranked, i.metrics, weights).withColumns({
        "by_model": F.array_join(pairs, ","), "by_question": F.array_join(parts, ","),
    }).drop("mentions_by_model")


@query("latest_reports", ["metrics"], """
select project, max(date) as latest, count(distinct date) as reports from metrics group by 1""")
def _latest(i):
    return R.latest_reports(i.metrics).select("project", "latest", F.size("dates").cast("long").alias("reports"))


_VM = ["view_metrics"]


@query("entity_view", ["view_metrics", "fact_models"], f"""
with f as (
  select * from view_metrics v
  where (contains(lower(entity), '2') or exists (select 1 from fact_models m where m.project = v.project
          and contains(lower(m.display_name), '2') and list_contains(string_split(v.bots, ','), m.model_id)))
    and list_has_any(string_split(bots, ','), ['m1', 'm3']) and rank_trend in (10, 1)
)
select *, row_number() over (partition by {_KEY} order by influence desc, entity) as place from f qualify place <= 12""")
def _view(i):
    spec = {"search": "2", "search_fields": ["entity", "models"], "models": ["m1", "m3"], "trends": [10, 1]}
    return _flat(V.entity_view(_metrics(i), spec, i.fact_models)).withColumn("place", F.col("place").cast("long"))


@query("search", _VM, "select * from view_metrics where contains(lower(entity), 'd#1')")
def _search(i):
    return _flat(V.search(_metrics(i), "D#1", ["entity"]))


@query("filter_models", _VM, "select * from view_metrics where list_has_any(string_split(bots, ','), ['m0', 'm4'])")
def _filter_models(i):
    return _flat(V.filter_models(_metrics(i), ["m0", "m4"]))


@query("filter_trends", _VM, "select * from view_metrics where rank_trend in (-1, 0)")
def _filter_trends(i):
    return _flat(V.filter_trends(_metrics(i), [-1, 0]))


@query("filter_question", _VM, """
select * from view_metrics v where exists (select 1 from view_metrics k where k.question_id = 'q1' and k.project = v.project
  and k.date = v.date and k.section = v.section and k.entity = v.entity)""")
def _filter_question(i):
    m = _metrics(i)
    return _flat(V.filter_question(m, m, "q1"))


@query("sort_view", _VM, f"""
select {_KEY}, entity, row_number() over (partition by {_KEY} order by coalesce(mentions_change, 0) asc, entity) as place
from view_metrics qualify place <= 5""")
def _sort(i):
    from answerlens.operators.scale import top_k

    order = V.sort_order("mentions_change", descending=False)
    keys = ["project", "question_id", "date", "section"]
    return top_k(_metrics(i), keys, order, 5, "place").select(*keys, "entity", F.col("place").cast("long"))


@query("visible_rows", _VM, f"""
select {_KEY}, entity, row_number() over (partition by {_KEY} order by influence desc, entity) as rank
from view_metrics qualify rank <= greatest(3, least(floor(count(*) over (partition by {_KEY}) * 30 / 100), 12))""")
def _visible(i):
    keys = ["project", "question_id", "date", "section"]
    return V.visible_rows(_metrics(i), keys, V.sort_order("influence")).select(*keys, "entity", F.col("rank").cast("long"))


@query("top_influencers", _VM, f"""
with b as (
  select * from view_metrics where influence > 0
  qualify row_number() over (partition by {_KEY} order by influence desc, entity) = 1
)
select {_KEY}, entity, influence, row_number() over (partition by project, question_id, date order by influence desc, section, entity) as place
from b qualify place <= 7""")
def _top(i):
    return V.top_influencers(_metrics(i)).select(
        "project", "question_id", "date", "section", "entity", "influence", F.col("place").cast("long")
    )


@query("compare_entities", ["view_metrics", "fact_models"], f"""
with n as (select distinct project, section, entity from view_metrics where entity like 'Brand#1%' and section <> 'N')
select {_KEY}, entity, mentions, CAST(case when influence <= 1 then influence * 100 else influence end AS DOUBLE) as influence,
       rank_trend as trend, mentions_change, CAST(len(string_split(bots, ',')) AS BIGINT) as model_count,
       round(len(string_split(bots, ',')) * 100 / (select count(distinct model_id) from fact_models f where f.project = v.project), 2) as coverage
from view_metrics v join n using (project, section, entity)""")
def _compare(i):
    m = _metrics(i)
    names = m.filter(F.col("entity").like("Brand#1%") & (F.col("section") != "N")).select("project", "section", "entity")
    return V.compare_entities(m, names, i.fact_models)


@query("competitors", _VM, f"""
with t as (select distinct project, section, entity from view_metrics where entity in ('Brand#12', 'Brand#7')),
mine as (select v.* from view_metrics v join t using (project, section, entity)),
o as (
  select m.project, m.question_id, m.date, m.section, m.entity, m.influence, c.entity as competitor, c.influence as ci, c.rank_trend as ct,
         row_number() over (partition by m.project, m.question_id, m.date, m.section, m.entity order by c.influence desc, c.entity) as place
  from mine m join view_metrics c on c.project = m.project and c.question_id = m.question_id and c.date = m.date and c.section = m.section and c.entity <> m.entity
  qualify place <= 5
)
select project, question_id, date, section, entity, competitor, place, ci as competitor_influence,
       count(*) filter (where ct = 10) over (partition by project, question_id, date, section, entity) as rising,
       influence > max(ci) over (partition by project, question_id, date, section, entity) as leads
from o""")
def _competitors(i):
    m = _metrics(i)
    targets = m.filter(F.col("entity").isin("Brand#12", "Brand#7"))
    return V.competitors(m, targets).select(
        "project", "question_id", "date", "section", "entity", "competitor", F.col("place").cast("long"),
        "competitor_influence", "rising", "leads",
    )


@query("graph_nodes", ["facts", "metrics"], f"""
with e as (select * from facts where mentions > 0)
select e.project, e.question_id, e.date, e.section, 'entity' as kind, e.entity as node, count(*) as degree, CAST(max(m.influence) AS DOUBLE) as size
from e join metrics m using (project, question_id, date, section, entity) group by 1, 2, 3, 4, 5, 6
union all
select {_KEY}, 'model', model_id, count(*), null from e group by 1, 2, 3, 4, 5, 6""")
def _nodes(i):
    return V.mention_graph(i.facts, i.metrics)[0]


@query("graph_edges", ["facts"], f"select {_KEY}, entity, model_id, mentions from facts where mentions > 0 and model_id = 'm2'")
def _edges(i):
    return V.mention_graph(i.facts, i.metrics, "m2")[1]


@query("sources_for_model", _VM, "select * from view_metrics where list_contains(string_split(bots, ','), 'm2')")
def _sources(i):
    return _flat(V.sources_for_model(_metrics(i), "m2"))


@query("all_entities", _VM, f"""
select {_KEY}, entity, influence, row_number() over (partition by project, question_id, date order by influence desc, section, entity) as place
from view_metrics""")
def _all(i):
    return V.all_entities(_metrics(i)).select(
        "project", "question_id", "date", "section", "entity", "influence", "place"
    )


@query("question_view", ["question_texts"], """
select project, question_id, CAST(split_part(long_id, '-', 1) AS BIGINT) as question_no, text from question_texts where contains(lower(text), 'q1')""")
def _question_view(i):
    q = i.question_texts.select(
        "project", "question_id", F.split_part("long_id", F.lit("-"), F.lit(1)).cast("long").alias("question_no"), "text"
    )
    return V.question_view(q, "Q1")


@query("total_reach", ["fact_models"], "select project, CAST(sum(estimated_mau) AS BIGINT) as reach from fact_models group by 1")
def _reach(i):
    return V.total_reach(i.fact_models)


@query("chart_series", _VM, f"""
select {_KEY}, entity as label, mentions, influence, row_number() over (partition by {_KEY} order by mentions desc, entity) as place
from view_metrics qualify place <= 12""")
def _chart(i):
    return V.chart_series(_metrics(i), ["mentions", "influence"]).withColumn("place", F.col("place").cast("long"))


@query("question_breakdown", ["metrics", "question_texts"], """
select m.project, m.date, m.section, m.entity, m.question_id, m.mentions, t.text
from metrics m left join question_texts t using (project, question_id) where m.mentions > 0""")
def _breakdown(i):
    return V.question_breakdown(i.metrics, i.question_texts)


@query("coverage_weight", ["view_metrics", "facts", "fact_models"], _FACT_SOV + f""",
l as (select {_KEY}, entity, unnest(string_split(bots, ',')) as model_id from view_metrics)
select l.project, l.question_id, l.date, l.section, l.entity, round(sum(w.weight), 6) as coverage_weight
from l join weights w on w.project = l.project and w.model_id = l.model_id group by all""")
def _coverage(i):
    return V.coverage_weight(_metrics(i), M.model_weights(i.fact_models)).withColumn(
        "coverage_weight", SC.rounded(F.col("coverage_weight"), 6)
    )
