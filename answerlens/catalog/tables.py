"""Queries over entity tables, dates and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.catalog.registry import query
from answerlens.operators import entities as E
from answerlens.operators import mentions as M

from answerlens.sources import ingest as I


@query("explode_entities", ["extracted"], """
with l as (
  select *, 'products' as section, products as items, 'product' as type from extracted
  union all select *, 'organizations', organizations, 'organization' from extracted
  union all select *, 'persons', persons, 'person' from extracted
),
u as (select project, question_id, date, doc_id, section, unnest(items) as entity, CAST(unnest(range(1, len(items) + 1)) AS BIGINT) as ord, type from l)
select * from u where length(entity) > 1 and trim(entity) <> ''""")
def _explode(i):
    return E.explode_entities(i.extracted.drop("colours"))


@query("empty_keys", ["answers", "entities"], """
select distinct project, question_id, date from answers a
where extract(day from date) > 7 and not exists (
  select 1 from entities e where e.project = a.project and e.question_id = a.question_id and e.section = 'places' and extract(day from a.date) > 14)""")
def _empty(i):
    expected = i.answers.filter(F.dayofmonth("date") > 7)
    present = i.answers.filter(F.dayofmonth("date") > 14).join(
        i.entities.filter(F.col("section") == "places").select("project", "question_id").distinct(),
        ["project", "question_id"], "left_semi",
    )
    return E.empty_keys(expected, present, ["project", "question_id", "date"])


_NO = "case question_id when 'en' then 1 when 'de' then 2 when 'fr' then 3 else 4 end"
_COMBINED = f"""
comb as (
  select project, '_all' as question_id, section, lower(entity) as key,
         arg_min(entity, ({_NO}, ord, entity)) as entity, CAST(min({_NO} * 4294967296 + ord) AS BIGINT) as ord
  from entities group by 1, 3, 4
)"""


def _combined(i):
    no = F.expr(_NO)
    return E.combine_questions(i.entities.withColumn("question_no", no))


@query("combine_questions", ["entities"], f"with {_COMBINED} select project, question_id, section, entity, ord from comb")
def _combine(i):
    return _combined(i).select("project", "question_id", "section", "entity", "ord")


@query("combined_mentions", ["answers", "entities"], f"""
with {_COMBINED},
base as (select project, '_all' as question_id, date, model_id, answer_id, lower(text) as low from answers),
terms as (select distinct project, key as term from comb),
pats as (select *, replace(replace(replace(replace(replace(term, 'é', '(?:é|%c3%a9)'), 'ó', '(?:ó|%c3%b3)'), '-', '\x01'), ' ', '(?:[\\s\\-_.,;:!?''\\"()\\[\\]{{}}]+|(?: |%20))'), '\x01', '(?:[\\s\\-_.,;:!?''\\"()\\[\\]{{}}]+|\\-)') as pattern from terms),
m as (
  select b.project, b.question_id, b.date, b.model_id, term, len(regexp_extract_all(low, pattern)) as n
  from base b join pats p on p.project = b.project where regexp_matches(low, pattern)
)
select m.project, m.question_id, m.date, c.section, c.entity, m.model_id, CAST(sum(n) AS BIGINT) as mentions
from m join comb c on c.project = m.project and c.key = m.term group by all""")
def _combined_mentions(i):
    return M.mention_hits(E.combined_answers(i.answers), _combined(i)).drop("ord", "pos")


@query("carry_forward", ["metrics"], """
with seen as (select distinct project, question_id, date, section, entity from metrics),
dates as (select project, date, row_number() over (partition by project order by date) as no from (select distinct project, date from seen)),
s as (select seen.*, no from seen join dates using (project, date)),
p as (
  select distinct d.project, o.question_id, d.date, o.section, o.entity
  from dates d join s o on o.project = d.project and o.no between d.no - 10 and d.no - 1
)
select p.project, p.question_id, p.date, p.section, p.entity, p.section || '!' as type from p
where not exists (select 1 from seen x where x.project = p.project and x.question_id = p.question_id and x.date = p.date
  and x.section = p.section and x.entity = p.entity)""")
def _carry(i):
    seen = i.metrics.select("project", "question_id", "date", "section", "entity").withColumn(
        "type", F.concat("section", F.lit("!"))
    )
    return E.carry_forward(seen, seen, seen.select("project", "date"))


@query("complete_dates", ["facts"], """
with wanted as (select project, count(distinct question_id) * count(distinct model_id) as n from facts where mentions > 1 group by 1),
got as (select project, date, count(distinct (question_id, model_id)) as n from facts where mentions > 1 group by 1, 2)
select g.project, g.date from got g join wanted w on w.project = g.project and w.n = g.n""")
def _complete(i):
    seen = i.facts.filter("mentions > 1")
    return E.complete_dates(seen, seen, seen)


@query("resolve_date", ["answers"], """
select project, date from (
  select project, date, row_number() over (partition by project order by date desc) as no from (select distinct project, date from answers)
) where no = 2""")
def _resolve(i):
    return E.resolve_date(i.answers.select("project", "date"), "-2")


@query("snapshot_status", ["answers"], """
select project, date, case when extract(day from date) < 8 then 'complete' when extract(day from date) < 20 then 'incomplete' else 'missing' end as status
from (select distinct project, date from answers)""")
def _status(i):
    day = F.dayofmonth("date")
    return E.snapshot_status(i.answers, i.answers.filter(day < 20), i.answers.filter(day < 8))


@query("previous_snapshots", ["metrics"], """
with s as (
  select *, row_number() over (partition by project, question_id order by date) as no
  from (select distinct project, question_id, date from metrics)
)
select c.project, c.question_id, c.date, p.date as prev_date
from s c join s p on p.project = c.project and p.question_id = c.question_id and p.no between c.no - 3 and c.no - 1""")
def _previous(i):
    return E.previous_snapshots(i.metrics)


@query("latest_snapshot", ["metrics"], "select project, question_id, max(date) as date from metrics group by 1, 2")
def _latest(i):
    return E.latest_snapshot(i.metrics)


@query("needs_attribute", ["metrics"], """
select project, question_id, date, section, entity, row_number() over (
  partition by project, question_id, date, section order by mentions % 5, entity) as item_no
from metrics where (mentions % 3 = 0 or mentions % 3 = 1) and section in ('A', 'R')""")
def _needs(i):
    link = F.when(F.col("mentions") % 3 == 0, F.lit("  ")).when(F.col("mentions") % 3 == 2, F.lit("https://x.org"))
    rows = i.metrics.withColumn("link", link).withColumn("value", F.col("entity")).withColumn("ord", F.col("mentions") % 5)
    gaps = E.needs_attribute(rows, "link", include=["A", "R"])
    return gaps.select("project", "question_id", "date", "section", "entity", "item_no")


@query("valid_answers", ["answers"], """
select answer_id, question_id, length(text) as n from answers
where strlen(text) >= 200 and length(trim(text)) >= 200""")
def _valid(i):
    return I.valid_answers(i.answers).select("answer_id", "question_id", F.length("text").cast("long").alias("n"))


_LINES = r"""
lines as (
  select project, line_no, trim(line) as q from question_lines where trim(line) <> '' and not starts_with(trim(line), '#')
),
hashed as (
  select *, substr(sha1(trim(regexp_replace(lower(q), '\s+', ' ', 'g'))), 1, 8) as hash from lines
),
firsts as (
  select project, hash, min(line_no) as line_no, arg_min(q, line_no) as text from hashed group by 1, 2
),
fresh as (
  select * from firsts where length(text) % 4 <> 0
),
existing as (select project, hash, line_no * 2 + 1 as question_no from firsts where length(text) % 4 = 0)"""


@query("ingest_questions", ["question_lines"], f"""
with {_LINES},
free as (
  select project, n as question_no, row_number() over (partition by project order by n) as k
  from (select distinct project from firsts) pr, range(1, 1 + (select max(line_no) * 2 + 2 + count(*) from firsts)) as r(n)
  where not exists (select 1 from existing e where e.project = pr.project and e.question_no = n)
),
placed as (select *, row_number() over (partition by project order by line_no) as k from fresh)
select p.project, hash, text, free.question_no from placed p join free on free.project = p.project and free.k = p.k""")
def _ingest(i):
    parsed = I.hashed_questions(i.question_lines)
    firsts = parsed.groupBy("project", "hash").agg(
        F.min("line_no").alias("line_no"), F.min_by("text", "line_no").alias("text")
    )
    existing = firsts.filter(F.length("text") % 4 == 0).select(
        "project", "hash", (F.col("line_no") * 2 + 1).alias("question_no")
    )
    return I.ingest_questions(i.question_lines, existing)


@query("resolve_models", ["models"], """
with m as (
  select project, model_id, estimated_mau, case when model_id in ('src3', 'src7') then 'src1' end as alias_of, concat('Name ', model_id) as display_name
  from models
)
select m.project, m.model_id, m.estimated_mau, coalesce(t.display_name, m.display_name) as display_name
from m left join m t on t.project = m.project and t.model_id = m.alias_of""")
def _models(i):
    m = i.models.withColumn("display_name", F.concat(F.lit("Name "), F.col("model_id"))).withColumn(
        "alias_of", F.when(F.col("model_id").isin("src3", "src7"), "src1")
    )
    return I.resolve_models(m, ["display_name"]).select("project", "model_id", "estimated_mau", "display_name")


@query("merge_patterns", ["page_links"], """
with hosts as (select distinct split_part(split_part(link, '/', 3), '?', 1) as host from page_links),
base as (select concat('c', length(host) % 9) as code, host, length(host) as ord, 'endswith' as kind from hosts),
ov as (select code, concat('Type ', code) as name, ord, kind, concat('.', host) as pattern from base where code in ('c1', 'c4', 'c7')
       union all select 'xtr', 'Extra', 99, 'contains', 'extra.')
select code, concat('Type ', code) as name, ord, kind, host as pattern from base where code not in (select code from ov) union all select * from ov""")
def _merge_patterns(i):
    base = i.page_links.select(F.regexp_extract("link", r"^[^/]*//([^/?]*)", 1).alias("host")).distinct().select(
        F.concat(F.lit("c"), (F.length("host") % 9).cast("string")).alias("code"), "host", F.length("host").cast("long").alias("ord"),
    ).select("code", F.concat(F.lit("Type "), "code").alias("name"), "ord", F.lit("endswith").alias("kind"), F.col("host").alias("pattern"))
    changed = base.filter(F.col("code").isin("c1", "c4", "c7")).withColumn("pattern", F.concat(F.lit("."), "pattern"))
    extra = i.spark.createDataFrame([("xtr", "Extra", 99, "contains", "extra.")], "code string, name string, ord long, kind string, pattern string")
    return I.merge_patterns(base, changed.unionByName(extra))
