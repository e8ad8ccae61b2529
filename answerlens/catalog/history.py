"""Queries over trends and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.catalog.registry import query
from answerlens.functions import scores as SC
from answerlens.operators import mentions as M
from answerlens.operators import trends as T

_PAST = """
with snaps as (
  select project, question_id, date, row_number() over (partition by project, question_id order by date) as no
  from (select distinct project, question_id, date from metrics)
),
m as (select t.*, s.no from metrics t join snaps s using (project, question_id, date)),
past as (
  select c.project, c.question_id, c.date, c.section, c.entity, p.date as pdate, p.mentions as pm,
         p.influence as pi, p.rank as pr, p.model_count as pc
  from m c join m p on p.project = c.project and p.question_id = c.question_id and p.section = c.section
   and lower(p.entity) = lower(c.entity) and p.no between c.no - 3 and c.no - 1
),
agg as (
  select project, question_id, date, section, entity, arg_max(pm, pdate) as pm, arg_max(pi, pdate) as pi,
         arg_max(pr, pdate) as pr, arg_max(pc, pdate) as pc, min(pdate) as oldest, max(pdate) as newest,
         count(*) as n, sum(pm) as s1, sum(pm * pm) as s2
  from past group by 1, 2, 3, 4, 5
)"""


def _code(cur: str, prev: str) -> str:
    return (
        f"CAST(case when coalesce({prev}, 0) = 0 then case when {cur} > 0 then 999 else -9999 end "
        f"when {cur} = 0 and {prev} > 0 then -99 when {cur} > {prev} then 10 when {cur} < {prev} then -1 else 1 end AS INT)"
    )


_MET = ["metrics"]


@query("entity_trends", _MET, _PAST + f"""
select m.project, m.question_id, m.date, m.section, m.entity, m.mentions, m.influence, m.rank, m.model_count,
       {_code('m.mentions', 'pm')} as mentions_trend, {_code('m.influence', 'pi')} as influence_trend,
       {_code('m.rank', 'pr')} as rank_trend, {_code('m.model_count', 'pc')} as model_count_trend,
       coalesce(pm, 0) as previous_mentions, m.mentions - coalesce(pm, 0) as mentions_change,
       case when coalesce(pm, 0) > 0 then round((m.mentions - pm) / pm * 100, 1)
            when m.mentions > 0 then 100.0 else 0.0 end as change_percent,
       coalesce(oldest, m.date) as first_seen, m.date as last_seen,
       round(sqrt(((coalesce(n, 0) + 1) * (coalesce(s2, 0) + m.mentions * m.mentions)
             - (coalesce(s1, 0) + m.mentions) * (coalesce(s1, 0) + m.mentions))
             / ((coalesce(n, 0) + 1) * (coalesce(n, 0) + 1))), 2) as volatility
from m left join agg using (project, question_id, date, section, entity)""")
def _trends(i):
    t = T.entity_trends(i.metrics.withColumn("influence", F.col("influence").cast("double")))
    return t.drop("mentions_series", "influence_series", "rank_series", "model_count_series").withColumn(
        "influence", F.col("influence").cast("long")
    )


@query("trend_series", _MET, _PAST + """
select project, question_id, date, section, entity, pdate as series_date, CAST(pm AS DOUBLE) as value from past
union all select project, question_id, date, section, entity, date, CAST(mentions AS DOUBLE) from metrics""")
def _series(i):
    t = T.entity_trends(i.metrics.withColumn("influence", F.col("influence").cast("double")))
    return t.select(
        "project", "question_id", "date", "section", "entity", F.explode("mentions_series").alias("p")
    ).select("project", "question_id", "date", "section", "entity",
             F.col("p.date").alias("series_date"), F.col("p.value").alias("value"))


@query("entity_model_trends", ["metrics", "facts", "fact_models"], _PAST + f"""
select m.project, m.question_id, m.date, m.section, m.entity, x.model_id,
       {_code('coalesce(c.mentions, 0)', 'coalesce(p.mentions, 0)')} as mentions_trend,
       {_code('coalesce(c.mentions * 2, 0)', 'coalesce(p.mentions * 2, 0)')} as influence_trend,
       case when c.pos is null then CAST(-9999 AS INT) else {_code('c.pos', 'coalesce(p.pos, -1)')} end as rank_trend
from m join fact_models x on x.project = m.project
left join agg a on a.project = m.project and a.question_id = m.question_id and a.date = m.date and a.section = m.section and a.entity = m.entity
left join facts c on c.project = m.project and c.question_id = m.question_id and c.date = m.date and c.section = m.section
  and c.entity = m.entity and c.model_id = x.model_id
left join facts p on p.project = m.project and p.question_id = m.question_id and p.date = a.newest and p.section = m.section
  and p.entity = m.entity and p.model_id = x.model_id""")
def _model_trends(i):
    facts = i.facts.withColumn("influence", F.col("mentions") * 2).withColumn("rank", F.col("pos"))
    return T.entity_model_trends(i.metrics, facts, i.fact_models)




@query("drop_unmentioned", _MET, _PAST.replace("from metrics t", "from sparse t").replace("with snaps", """with sparse as (
  select * replace (case when extract(month from date) % 6 = 0 then mentions else 0 end as mentions) from metrics
),
snaps""") + """
select m.project, m.question_id, m.date, m.section, m.entity, m.mentions from m
where m.mentions > 0 or exists (
  select 1 from past p where p.project = m.project and p.question_id = m.question_id and p.date = m.date
   and p.section = m.section and p.entity = m.entity and p.pm > 0)""")
def _drop(i):
    sparse = i.metrics.withColumn(
        "mentions", F.when(F.month("date") % 6 == 0, F.col("mentions")).otherwise(F.lit(0).cast("long"))
    )
    return M.drop_unmentioned(sparse).select(
        "project", "question_id", "date", "section", "entity", "mentions"
    )


_HISTORY = """
with numbered as (
  select *, row_number() over (partition by project, question_id, section, entity order by date) - 1 as idx from metrics
),
grouped as (
  select project, question_id, section, entity, min(date) as first_seen, max(date) as last_seen,
         count(*) as reports, CAST(sum(mentions) AS BIGINT) as total_mentions, avg(mentions) as average_mentions,
         max(mentions) as peak_mentions, arg_min(date, (-mentions, date)) as peak_date,
         regr_slope(CAST(mentions AS DOUBLE), CAST(idx AS DOUBLE)) as slope, stddev_pop(mentions) as sd
  from numbered group by 1, 2, 3, 4
),
scored as (
  select *, case when reports >= 2 and average_mentions > 0 then greatest(-1.0, least(1.0, slope / average_mentions)) else 0.0 end as trend_score,
         case when reports >= 2 and average_mentions > 0 then sd / average_mentions else 0.0 end as variation
  from grouped
),
listed_history as (
  select project, question_id, section, entity,
         string_agg(concat(CAST(date AS VARCHAR), '=', mentions, '=', influence, '=', rank), ',' order by date) as history from metrics group by 1, 2, 3, 4
),
hist as (
  select *, case when variation > 0.5 then 'volatile' when trend_score > 0.2 then 'rising'
                 when trend_score < -0.2 then 'falling' else 'stable' end as trend
  from scored
)"""


def _hist(i):
    return T.item_history(i.metrics)


@query("item_history", _MET, _HISTORY + """
select project, question_id, section, entity, first_seen, last_seen, reports, total_mentions,
       round(average_mentions, 6) as average_mentions, peak_mentions, peak_date,
       round(trend_score, 6) as trend_score, round(variation, 6) as variation, trend, history
from hist join listed_history using (project, question_id, section, entity)""")
def _item_history(i):
    h = _hist(i).withColumn("history", F.array_join(F.transform("history", lambda x: F.concat_ws(
        "=", x["date"].cast("string"), x["mentions"].cast("string"), x["influence"].cast("string"), x["rank"].cast("string")
    )), ","))
    for c in ("average_mentions", "trend_score", "variation"):
        h = h.withColumn(c, SC.rounded(F.col(c), 6))
    return h


@query("item_history_by_model", ["facts"], """
select project, question_id, section, entity, model_id, CAST(sum(mentions) AS BIGINT) as mentions from facts group by 1, 2, 3, 4, 5""")
def _history_model(i):
    return T.item_history_by_model(i.facts)


@query("trend_score", _MET, _HISTORY + """
select project, trend, count(*) as items, round(min(trend_score), 6) as lowest, round(max(trend_score), 6) as highest
from hist group by 1, 2""")
def _score(i):
    return _hist(i).groupBy("project", "trend").agg(
        F.count(F.lit(1)).alias("items"),
        SC.rounded(F.min("trend_score"), 6).alias("lowest"),
        SC.rounded(F.max("trend_score"), 6).alias("highest"),
    )


@query("top_movers", _MET, _HISTORY + """,
sorted as (
  select *, case trend when 'rising' then trend_score when 'falling' then -trend_score
                       when 'volatile' then variation else average_mentions end as sort_value
  from hist where trend <> 'stable' or average_mentions > 0
)
select project, trend, question_id, section, entity,
       row_number() over (partition by project, trend order by round(sort_value, 9) desc, entity, section, question_id) as rank
from sorted qualify rank <= 10""")
def _movers(i):
    # Equal scores may differ in their last digit between engines.
    h = _hist(i)
    for c in ("average_mentions", "trend_score", "variation"):
        h = h.withColumn(c, F.round(c, 9))
    return T.top_movers(h).select("project", "trend", "question_id", "section", "entity", F.col("rank").cast("long"))


@query("entrants_leavers", ["shifting"], _HISTORY.replace(" metrics", " shifting") + """,
dates as (select distinct project, date from shifting),
numbered_dates as (
  select project, date, row_number() over (partition by project order by date) as no,
         count(*) over (partition by project) as n from dates
),
threshold as (select project, date as threshold from numbered_dates where no = floor(n * 0.75) + 1),
listed as (
  select h.*, case when first_seen >= threshold then 'entrant' when last_seen < threshold then 'leaver' end as list
  from hist h join threshold t using (project)
)
select project, list, question_id, section, entity,
       row_number() over (partition by project, list order by round(average_mentions, 9) desc, entity, section, question_id) as rank
from listed where list is not null qualify rank <= 10""")
def _entrants(i):
    h = T.item_history(i.shifting).withColumn("average_mentions", F.round("average_mentions", 9))
    return T.entrants_leavers(h, i.shifting).select(
        "project", "list", "question_id", "section", "entity", F.col("rank").cast("long")
    )


@query("category_summary", _MET, _HISTORY + """
select project, section, count(*) as total_items, round(avg(trend_score), 6) as average_growth,
       CAST(sum(total_mentions) AS BIGINT) as total_mentions from hist group by 1, 2""")
def _category(i):
    return T.category_summary(_hist(i)).withColumn("average_growth", SC.rounded(F.col("average_growth"), 6))


_D1, _D2 = "1996-03-01", "1996-04-01"
_COMPARE = f"""
with a as (select project, question_id, section, lower(entity) as key, entity as e1, mentions as m1 from metrics where date = DATE '{_D1}'),
b as (select project, question_id, section, lower(entity) as key, entity as e2, mentions as m2 from metrics where date = DATE '{_D2}'),
both_sides as (select * from a full outer join b using (project, question_id, section, key)),
cmp as (
  select project, question_id, section,
         case when e1 is null then 'new' when e2 is null then 'removed' when m1 <> m2 then 'changed' end as status,
         coalesce(e2, e1) as entity,
         case when e1 is not null and e2 is not null then m2 - m1 end as change,
         case when m2 > m1 then '↑' when m2 < m1 then '↓' end as arrow
  from both_sides
)"""


@query("compare_dates", _MET, _COMPARE + " select * from cmp where status is not null")
def _compare(i):
    return T.compare_dates(i.metrics, _D1, _D2)


@query("compare_summary", _MET, _COMPARE + """
select *, row_number() over (partition by project, question_id, section, status order by abs(coalesce(change, 0)) desc, entity) as rank,
       greatest(0, count(*) over (partition by project, question_id, section, status) - 5) as more
from cmp where status is not null qualify rank <= 5""")
def _compare_summary(i):
    return T.compare_summary(T.compare_dates(i.metrics, _D1, _D2)).withColumn("rank", F.col("rank").cast("long"))


@query("report_history", _MET, """
with d as (
  select project, date, row_number() over (partition by project order by date desc) as no
  from (select distinct project, date from metrics)
)
select project, strftime(date, '%Y-%m') as month, count(*) as reports, string_agg(CAST(date AS VARCHAR), ',' order by date) as dates
from d where no <= 24 group by 1, 2""")
def _report_history(i):
    return T.report_history(i.metrics, 24).select(
        "project", "month", "reports", F.array_join(F.col("dates").cast("array<string>"), ",").alias("dates")
    )


@query("trend_by_regression", _MET, """
with s as (
  select project, question_id, section, entity, date, CAST(mentions AS DOUBLE) as v,
         CAST(date - DATE '1970-01-01' AS DOUBLE) as x,
         max(date) over (partition by project, question_id, section, entity) as last_date
  from metrics
),
g as (
  select project, question_id, section, entity, count(*) as n, arg_max(v, date) as latest,
         coalesce(max(case when date < last_date then abs(v) end), 0) as before,
         regr_slope(v, x) as slope, regr_intercept(v, x) as icept, avg(v) as mean
  from s group by 1, 2, 3, 4
),
r as (
  select s.project, s.question_id, s.section, s.entity, sqrt(avg(pow(v - (slope * x + icept), 2))) as sd
  from s join g using (project, question_id, section, entity) group by 1, 2, 3, 4
)
select project, question_id, section, entity,
       CAST(case when n < 2 then -9999 when latest <> 0 and before = 0 then 999 when latest = 0 and before <> 0 then -99
            when abs(slope) < 0.01 then case when sd > mean * 0.1 then 0 else 1 end
            when slope > 0 then 10 else -1 end AS INT) as trend
from g join r using (project, question_id, section, entity)""")
def _regression(i):
    series = i.metrics.select(
        "project", "question_id", "section", "entity", "date", F.col("mentions").alias("value")
    )
    return T.trend_by_regression(series, ["project", "question_id", "section", "entity"])


@query("cadence", _MET, """
with c as (select project, count(distinct date) as points, max(date) - min(date) + 1 as day_span from metrics group by 1)
select project, points, day_span,
       case when points < 2 then null when points >= day_span * 0.8 then 'Daily monitoring'
            when points >= day_span / 7 * 0.8 then 'Weekly monitoring'
            when points >= day_span / 14 * 0.8 then 'Bi-weekly monitoring'
            when points >= day_span / 30 * 0.8 then 'Monthly monitoring'
            else concat('Every ~', CAST(round(day_span / points) AS INT), ' days') end as cadence
from c""")
def _cadence(i):
    return T.cadence(i.metrics)
