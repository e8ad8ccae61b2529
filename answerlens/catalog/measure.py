"""Queries over mention measurement and share of voice."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.catalog.registry import query
from answerlens.functions import text as TX
from answerlens.operators import matching as MA
from answerlens.operators import mentions as M
from answerlens.operators import reports as R
from answerlens.operators.scale import new_folder
from answerlens.plans.incremental import build_new

_SEP = r"[\s\-_.,;:!?''\"()\[\]{}]"
# The pattern of a name, for the shapes that occur in the entity view.
_PATTERN = (
    "replace(replace(replace(replace(replace(term, 'é', '(?:é|%c3%a9)'), 'ó', '(?:ó|%c3%b3)'), "
    f"'-', '\x01'), ' ', '(?:{_SEP}+|(?: |%20))'), '\x01', '(?:{_SEP}+|\\-)')"
)
_MATCHED = f"""
terms as (select distinct project, question_id, lower(entity) as term from entities),
pats as (select *, {_PATTERN} as pattern from terms),
pairs as (
  select a.project, a.question_id, a.date, a.model_id, a.answer_id, term, pattern, lower(a.text) as low
  from answers a join pats p on a.project = p.project and a.question_id = p.question_id
),
matched as (
  select project, question_id, date, model_id, answer_id, term,
         CAST(len(regexp_extract_all(low, pattern)) AS BIGINT) as mentions,
         CAST(strpos(low, regexp_extract(low, pattern)) AS BIGINT) as pos
  from pairs where regexp_matches(low, pattern)
)"""
_HITS = _MATCHED + """,
hits as (
  select m.project, m.question_id, m.date, e.section, e.entity, e.ord, m.model_id,
         CAST(sum(m.mentions) AS BIGINT) as mentions, min(m.pos) as pos
  from matched m join entities e
    on m.project = e.project and m.question_id = e.question_id and m.term = lower(e.entity)
  group by all
)"""
_AW = ["answers", "entities", "models"]


@query("match_entities", _AW, f"with {_MATCHED} select * from matched")
def _match(i):
    return MA.match_entities(i.answers, i.entities)


@query("mention_hits", _AW, f"with {_HITS} select * from hits")
def _hits(i):
    return M.mention_hits(i.answers, i.entities)


@query("incremental_facts", _AW + ["patterns"], f"with {_HITS} select * from hits where section <> 'links'")
def _incremental(i):
    """The newest date is added to a store that holds the others."""
    newest = i.answers.agg(F.max("date")).first()[0]
    store = new_folder(i.spark)
    entities = i.entities.withColumn("question_no", F.lit(1))
    for answers in (i.answers.filter(F.col("date") < newest), i.answers):
        tables = build_new(answers, entities, i.models, i.patterns, store, combined=False)
    return tables["facts"].filter("section <> 'links'").select(
        "project", "question_id", "date", "section", "entity", "ord", "model_id", "mentions", "pos"
    )


@query("mention_facts", _AW, f"""
with {_HITS},
cells as (
  select distinct e.project, e.question_id, d.date, e.section, e.entity, e.ord, m.model_id
  from entities e
  join (select distinct project, question_id, date from answers) d
    on d.project = e.project and d.question_id = e.question_id
  join models m on m.project = e.project
)
select c.*, coalesce(h.mentions, 0) as mentions, coalesce(h.pos, -1) as pos
from cells c left join hits h
  on h.project = c.project and h.question_id = c.question_id and h.date = c.date
 and h.section = c.section and h.entity = c.entity and h.model_id = c.model_id""")
def _facts(i):
    dates = i.answers.select("project", "question_id", "date").distinct()
    return M.mention_facts(M.mention_hits(i.answers, i.entities), i.entities, i.models, dates)


_SOV = """
wraw as (
  select project, model_id, estimated_mau,
         case when estimated_mau > 0 then least(estimated_mau / 1e9, 1.0) else 0.5 end as raw
  from {models}
),
weights as (select project, model_id, estimated_mau, raw / sum(raw) over (partition by project) as weight from wraw),
ranked as (
  select *, row_number() over (partition by project, question_id, date, section, model_id
                               order by pos, ord, entity) as model_rank
  from {hits} where mentions > 0
),
prom as (
  select r.*, coalesce(w.weight, 0) as weight, mentions / log2(model_rank + 1) as prominence
  from ranked r left join weights w on w.project = r.project and w.model_id = r.model_id
),
per as (
  select project, question_id, date, section, entity, sum(weight) as model_coverage,
         sum(prominence) as prominence, CAST(sum(mentions) AS BIGINT) as mentions,
         sum(prominence * weight) as weighted
  from prom group by all
),
sov as (
  select *, max(prominence) over (partition by project, question_id, date, section) as top from per
)"""


@query("share_of_voice_answers", _AW, f"""
with {_HITS}, {_SOV.format(models='models', hits='hits')}
select project, question_id, date, section, entity, mentions, round(model_coverage, 5) as model_coverage,
       round(prominence, 5) as prominence, round(model_coverage * prominence / top, 5) as share_of_voice
from sov""")
def _sov_answers(i):
    hits = M.mention_hits(i.answers, i.entities)
    return M.share_of_voice(M.prominences(hits, M.model_weights(i.models)))


_POS = ["answers", "entities"]
_SPLIT_HITS = f"""
with {_MATCHED},
parts as (
  select p.*, regexp_split_to_array(p.low, p.pattern) as gaps, regexp_extract_all(p.low, p.pattern) as found
  from pairs p where regexp_matches(p.low, p.pattern)
),
each_hit as (
  select *, unnest(range(1, len(found) + 1)) as hit_no from parts
),
placed as (
  select *, CAST(1 + list_sum(list_transform(gaps[1:hit_no], lambda g: length(g)))
         + coalesce(list_sum(list_transform(found[1:hit_no - 1], lambda f: length(f))), 0) AS BIGINT) as pos,
         CAST(length(found[hit_no]) AS BIGINT) as hit_len
  from each_hit
)"""


@query("hit_positions", _POS, _SPLIT_HITS + """
select project, question_id, date, model_id, answer_id, term, CAST(hit_no AS BIGINT) as hit_no, pos, hit_len
from placed""")
def _positions(i):
    return MA.hit_spans(i.answers, i.entities)


@query("excerpts", _POS, _SPLIT_HITS + """
select p.project, p.question_id, p.date, p.model_id, p.answer_id, p.term, CAST(hit_no AS BIGINT) as hit_no, pos,
       trim(substr(a.text, CAST(greatest(1, pos - 100) AS BIGINT),
            CAST(least(length(a.text) + 1, pos + hit_len + 100) - greatest(1, pos - 100) AS BIGINT)), ' ') as excerpt,
       CAST(1 + length(substr(a.text, 1, pos - 1)) - length(replace(substr(a.text, 1, pos - 1), chr(10), '')) AS BIGINT) as line,
       CAST(1 + length(list_extract(string_split(substr(a.text, 1, pos - 1), chr(10)), -1)) AS BIGINT) as col
from placed p join answers a on a.answer_id = p.answer_id where hit_no <= 5""")
def _excerpts(i):
    return MA.excerpts(i.answers, i.entities)


_LISTED = """,
cut as (
  select p.project, p.question_id, p.date, p.model_id, p.answer_id, p.term, hit_no,
         trim(substr(a.text, CAST(greatest(1, pos - 100) AS BIGINT),
              CAST(least(length(a.text) + 1, pos + hit_len + 100) - greatest(1, pos - 100) AS BIGINT)), ' ') as excerpt
  from placed p join answers a on a.answer_id = p.answer_id where hit_no <= 5
)"""


@query("merged_excerpts", _POS, _SPLIT_HITS + _LISTED + """,
numbered as (
  select *, CAST((dense_rank() over (partition by project, date, term, model_id order by question_id, answer_id) - 1) // 64 AS BIGINT) as part_no
  from cut
)
select project, date, term, model_id, part_no, string_agg(concat(question_id, '/', answer_id, '/', hit_no, '/', excerpt), '|' order by question_id, answer_id, hit_no) as excerpts
from numbered group by 1, 2, 3, 4, 5""")
def _merged_excerpts(i):
    found = R.merged_excerpts(MA.excerpts(i.answers, i.entities))
    return found.withColumn("excerpts", F.array_join(F.transform("excerpts", lambda e: F.concat_ws(
        "/", e["question_id"], e["answer_id"].cast("string"), e["hit_no"].cast("string"), e["excerpt"]
    )), "|"))


@query("fact_excerpts", _POS, _SPLIT_HITS + _LISTED + """,
numbered as (
  select *, CAST((dense_rank() over (partition by project, question_id, date, model_id, term order by answer_id) - 1) // 64 AS BIGINT) as part_no
  from cut
),
ex as (
  select project, question_id, date, model_id, term, part_no, string_agg(concat(answer_id, '/', hit_no, '/', excerpt), '|' order by answer_id, hit_no) as excerpts
  from numbered group by 1, 2, 3, 4, 5, 6
)
select distinct e.project, e.question_id, x.date, e.section, e.entity, x.model_id, x.part_no, x.excerpts
from entities e join ex x on x.project = e.project and x.question_id = e.question_id and x.term = lower(e.entity)
where e.section <> 'links'""")
def _fact_excerpts(i):
    named = i.entities.filter("section <> 'links'")
    matched, excerpts = MA.matches_and_excerpts(i.answers, i.entities)
    found = M.with_excerpts(M.mention_hits(i.answers, named, matched), excerpts).filter("excerpts is not null")
    return found.select(
        "project", "question_id", "date", "section", "entity", "model_id", "part_no",
        F.array_join(F.transform("excerpts", lambda e: F.concat_ws(
            "/", e["answer_id"].cast("string"), e["hit_no"].cast("string"), e["excerpt"]
        )), "|").alias("excerpts"),
    ).distinct()


@query("mask_link_urls", ["linked_answers"], r"""
with pieces as (
  select answer_id, text, regexp_extract_all(text, '\[[^\]]+\]\([^)]+\)') as links,
         regexp_split_to_array(text, '\[[^\]]+\]\([^)]+\)') as gaps
  from linked_answers
)
select answer_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda k:
         gaps[k] || case when k <= len(links) then
           regexp_extract(links[k], '^(\[[^\]]+\]\()', 1)
           || repeat('#', CAST(length(links[k]) - length(regexp_extract(links[k], '^(\[[^\]]+\]\()', 1)) - 1 AS BIGINT)) || ')'
         else '' end), '') as masked
from pieces""")
def _mask(i):
    return i.linked_answers.select("answer_id", TX.mask_link_urls(F.col("text")).alias("masked"))


@query("match_domains", ["linked_answers", "link_entities"], r"""
with terms as (select distinct regexp_replace(entity, '^www\.', '') as term from link_entities),
-- a name can only be found where its host occurs
pairs as (
  select a.*, t.term, lower(a.text) as low from linked_answers a join terms t on contains(lower(a.text), t.term)
),
urls as (
  select *, regexp_extract_all(low, '(?:\[([^\]]+)\]\()?((?:https?://)?(?:www\.)?[a-z0-9][-a-z0-9._]*\.[a-z]{2,}(?:/[^\s)]*)?)') as raw,
         regexp_split_to_array(low, '(?:\[([^\]]+)\]\()?((?:https?://)?(?:www\.)?[a-z0-9][-a-z0-9._]*\.[a-z]{2,}(?:/[^\s)]*)?)') as gaps,
         '\b' || replace(replace(term, '.', '\.'), '-', '\-') || '\b' as plain
  from pairs
),
judged as (
  select *, list_transform(list_transform(raw, lambda u:
      split_part(split_part(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(u, '^\[[^\]]*\]\(', ''), '^https?://', ''), '^www\.', ''), '/$', ''), '?', 1), '#', 1)),
      lambda u: u = term or starts_with(u, term || '/')) as same
  from urls
),
matched as (
  select *, list_filter(raw, lambda u, k: same[k]) as hits, list_position(same, true) as first_hit from judged
)
select project, question_id, date, model_id, answer_id, term,
       CAST(len(hits) + len(regexp_extract_all(low, plain))
         - coalesce(list_sum(list_transform(hits, lambda u: len(regexp_extract_all(u, plain)))), 0) AS BIGINT) as mentions,
       CAST(least(
         case when first_hit > 0 then 1 + list_sum(list_transform(gaps[1:first_hit], lambda g: length(g)))
           + coalesce(list_sum(list_transform(raw[1:first_hit - 1], lambda u: length(u))), 0) end,
         case when regexp_matches(low, plain) then 1 + length(regexp_split_to_array(low, plain)[1]) end) AS BIGINT) as pos
from matched
where len(hits) + len(regexp_extract_all(low, plain)) > 0""")
def _domains(i):
    return MA.match_entities(i.linked_answers, i.link_entities)


@query("coverage", ["facts"], """
select project, question_id, date, section, entity, CAST(sum(mentions) AS BIGINT) as mentions,
       count(distinct model_id) as model_count, string_agg(distinct model_id, ',' order by model_id) as bots
from facts where mentions > 0 group by all""")
def _coverage(i):
    return M.coverage(i.facts).drop("models")


@query("mention_share", ["facts"], """
select project, question_id, date, section, entity, model_id, mentions,
       round(mentions / sum(mentions) over (partition by project, question_id, date, section, model_id), 5) as model_share,
       round(sum(mentions) over (partition by project, question_id, date, section, entity)
             / sum(mentions) over (partition by project, question_id, date, section), 5) as share
from facts""")
def _share(i):
    return M.mention_share(i.facts)


_RANKS = """
with ranked as (
  select *, row_number() over (partition by project, question_id, date, section, model_id order by pos, ord, entity) as model_rank
  from facts where mentions > 0
)"""


@query("appearance_rank_by_model", ["facts"], _RANKS + """
select project, question_id, date, section, entity, model_id, model_rank from ranked""")
def _model_rank(i):
    return M.model_ranks(i.facts).select(
        "project", "question_id", "date", "section", "entity", "model_id", "model_rank"
    )


@query("appearance_rank", ["facts"], _RANKS + """
select project, question_id, date, section, entity, CAST(sum(mentions) AS BIGINT) as mentions, min(model_rank) as rank
from ranked group by all""")
def _rank(i):
    return M.appearance_rank(i.facts)


@query("appearance_rank_avg", ["facts"], _RANKS + """
select project, question_id, date, section, entity, CAST(sum(mentions) AS BIGINT) as mentions, round(avg(model_rank), 2) as rank
from ranked group by all""")
def _rank_avg(i):
    return M.appearance_rank(i.facts, agg="avg")


_FM = ["facts", "fact_models"]
_FACT_SOV = f"with {_SOV.format(models='fact_models', hits='facts')}"
_PER = "project, question_id, date, section, entity"


@query("model_weights", _FM, _FACT_SOV + """
select project, model_id, estimated_mau, round(weight, 8) as weight from weights""")
def _weights(i):
    return M.model_weights(i.fact_models).withColumn("weight", F.round("weight", 8))


def _prom(i):
    return M.prominences(i.facts, M.model_weights(i.fact_models))


@query("prominence", _FM, _FACT_SOV + f"""
select {_PER}, model_id, mentions, model_rank, round(prominence, 6) as prominence from prom""")
def _prominence(i):
    return _prom(i).drop("weight").withColumn("prominence", F.round("prominence", 6))


@query("share_of_voice", _FM, _FACT_SOV + f"""
select {_PER}, mentions, round(model_coverage, 5) as model_coverage, round(prominence, 5) as prominence,
       round(model_coverage * prominence / top, 5) as share_of_voice from sov""")
def _sov(i):
    return M.share_of_voice(_prom(i))


@query("sov_by_model", _FM, _FACT_SOV + f"""
select p.project, p.question_id, p.date, p.section, p.entity, p.model_id,
       round(p.weight * p.prominence / s.top, 5) as share_of_voice
from prom p join sov s using (project, question_id, date, section, entity)""")
def _sov_model(i):
    return M.sov_by_model(_prom(i))


@query("weighted_influence", _FM, _FACT_SOV + f"select {_PER}, round(weighted, 5) as influence from sov")
def _influence(i):
    return M.weighted_influence(_prom(i))


@query("normalize_to_max", _FM, _FACT_SOV + f"""
, base as (select {_PER}, round(weighted, 5) as influence from sov)
select {_PER}, round(influence / max(influence) over (partition by project, question_id, date, section), 5) as influence
from base""")
def _norm_max(i):
    return M.normalize_to_max(M.weighted_influence(_prom(i)), "influence")


@query("normalize_to_max_by_model", _FM, _FACT_SOV + f"""
, base as (select {_PER}, model_id, round(prominence * weight, 5) as influence from prom)
select {_PER}, model_id, round(influence / max(influence) over (partition by {_PER}), 5) as influence
from base""")
def _norm_max_model(i):
    per_model = _prom(i).select(
        "project", "question_id", "date", "section", "entity", "model_id",
        F.round(F.col("prominence") * F.col("weight"), 5).alias("influence"),
    )
    return M.normalize_to_max(
        per_model, "influence", ["project", "question_id", "date", "section", "entity"]
    )


@query("normalize_to_sum", ["metrics"], """
select project, question_id, date, section, entity,
       round(mentions / sum(mentions) over (partition by project, question_id, date, section), 5) as market_share
from metrics""")
def _norm_sum(i):
    m = i.metrics.select(
        "project", "question_id", "date", "section", "entity", F.col("mentions").alias("market_share")
    )
    return M.normalize_to_sum(m, "market_share")
