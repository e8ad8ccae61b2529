"""Queries over links."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.catalog.fixtures import _HOST
from answerlens.catalog.registry import query
from answerlens.functions import urls as U
from answerlens.operators import links as L

_H = "lower(regexp_replace(" + _HOST.replace("url", "link") + ", '^www\\.', ''))"
_TRACK = "(" + ", ".join(f"'{p}'" for p in U.TRACKING_PARAMS) + ")"


def _clean(u: str) -> str:
    """Canonical URL in SQL, for URLs without percent escapes."""
    frag = f"regexp_extract({u}, '(#.*)$', 1)"
    bare = f"regexp_replace({u}, '#.*$', '')"
    base = f"split_part({bare}, '?', 1)"
    base = f"case when regexp_matches({base}, '^https?://[^/]*$') then {base} || '/' else {base} end"
    query_ = f"substr({bare}, length(split_part({bare}, '?', 1)) + 2)"
    kept = f"list_filter(string_split({query_}, '&'), lambda p: p <> '' and split_part(p, '=', 1) not in {_TRACK})"
    s = f"({base}) || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end || {frag}"
    for pat in (r"[),.:;!?*\[\]_]+$", "^https?://", r"^www\.", "/+$", r"[),.:;!?*\[\]_]+$"):
        s = f"regexp_replace({s}, '{pat}', '')"
    return s


_LINKS = f"""
with t as (select * from linked_answers),
one as (
  select *, regexp_extract_all(text, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2) as md,
         regexp_replace(text, '\\[([^\\]]+)\\]\\(([^)]+)\\)', ' ', 'g') as text2 from t
),
two as (
  select *, regexp_extract_all(text2, 'https?://[^\\s<>"{{}}|\\\\^`\\[\\]]+') as urls,
         lower(regexp_replace(text2, 'https?://[^\\s<>"{{}}|\\\\^`\\[\\]]+', ' ', 'g')) as text3 from one
),
raw as (
  select project, question_id, date, model_id, answer_id, text3, unnest(list_concat(
           list_transform(list_filter(md, lambda m: not starts_with(m, '#')), lambda m: m), urls)) as raw_url from two
),
full_links as (select *, {_clean('raw_url')} as link from raw),
domains as (select distinct answer_id, regexp_replace(split_part(split_part(split_part(link, '/', 1), '?', 1), '#', 1), '^www\\.', '') as d from full_links),
bare as (
  select project, question_id, date, model_id, answer_id,
         unnest(regexp_extract_all(text3, '\\b(?:[a-z0-9][-a-z0-9]*\\.)+[a-z]{{2,}}\\b')) as link from two
),
found as (
  select distinct project, question_id, date, model_id, answer_id, link from full_links
  union
  select distinct b.* from bare b where not regexp_matches(link, '\\.(md|js|ts|json)$')
    and not exists (select 1 from domains d where d.answer_id = b.answer_id and d.d = b.link)
),
answer_links as (select * from found where not regexp_matches(link, '\\.(jpg|png|gif|jpeg|webp|svg)$'))
"""


@query("answer_links", ["linked_answers"], _LINKS + "select * from answer_links")
def _answer_links(i):
    return L.answer_links(i.linked_answers).drop("ord")


@query("extract_links", ["linked_answers"], _LINKS + """
, snap as (select distinct project, question_id, date, link from answer_links),
with_path as (
  select distinct project, question_id, date, regexp_replace(split_part(split_part(split_part(link, '/', 1), '?', 1), '#', 1), '^www\\.', '') as link
  from snap where contains(link, '/') or contains(link, '?')
),
roots as (select distinct project, question_id, date, link from full_links where not contains(link, '/') and not contains(link, '?'))
select s.project, s.question_id, s.date, s.link, 'oth' as link_type
from snap s
where contains(s.link, '/') or contains(s.link, '?')
   or not exists (select 1 from with_path w where w.project = s.project and w.question_id = s.question_id and w.date = s.date and w.link = s.link)
   or exists (select 1 from roots r where r.project = s.project and r.question_id = s.question_id and r.date = s.date and r.link = s.link)""")
def _extract(i):
    return L.extract_links(i.linked_answers)


@query("clean_url", [], f"select page_id, {_clean('url')} as cleaned from pages")
def _clean_q(i):
    return i.pages.select("page_id", U.clean_url(F.col("url")).alias("cleaned"))


_QUERIED = """case when contains(url, '?') or contains(url, '#') then url
    when page_id % 4 = 0 then concat(url, '?b=1&&c=2') when page_id % 4 = 1 then concat(url, '?a=1&&utm_source=x&d')
    when page_id % 4 = 2 then concat(url, '?&&#top') else url end"""


@query("strip_tracking", [], f"""
with q as (
  select page_id, u as url, regexp_replace(u, '#.*$', '') as bare, regexp_extract(u, '(#.*)$', 1) as frag
  from (select page_id, {_QUERIED} as u from pages)
),
p as (select *, string_split(substr(bare, length(split_part(bare, '?', 1)) + 2), '&') as parts from q),
k as (
  select *, case when len(list_filter(parts, lambda p: split_part(p, '=', 1) in {_TRACK})) = 0
                  and len(list_filter(parts, lambda p: p <> '')) > 0 then parts
            else list_filter(parts, lambda p: p <> '' and split_part(p, '=', 1) not in {_TRACK}) end as kept from p
)
select page_id, split_part(bare, '?', 1) || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end || frag as url
from k""")
def _strip(i):
    return i.pages.select("page_id", U.strip_tracking(F.expr(_QUERIED)).alias("url"))


@query("hostname", [], f"select page_id, {_H.replace('link', 'url')} as host from pages")
def _hostname(i):
    return i.pages.select("page_id", U.hostname(F.col("url")).alias("host"))


_TYPED = f"""
with l as (select *, {_H} as host, lower(link) as low from page_links),
typed as (
  select l.*, coalesce((select arg_min(p.code, p.ord) from patterns p where
      (p.kind = 'contains' and regexp_matches(p.pattern, '[/?#=]') and contains(l.low, p.pattern))
   or (p.kind = 'contains' and not regexp_matches(p.pattern, '[/?#=]') and contains(l.host, p.pattern))
   or (p.kind = 'endswith' and ends_with(l.host, p.pattern))
   or (p.kind = 'regex' and regexp_matches(l.host, p.pattern))), 'oth') as link_type
  from l
)"""


def _typed(i):
    return L.classify_links(i.page_links.withColumn("link_type", F.lit("oth")), i.patterns)


@query("classify_links", ["page_links", "patterns"], _TYPED + "select ord, link, link_type from typed")
def _classify(i):
    return _typed(i).select("ord", "link", "link_type")


@query("link_type_stats", ["page_links", "patterns"], _TYPED + """
select project, link_type, count(*) as links,
       round(sum(count(*) filter (where link_type <> 'oth')) over (partition by project) * 100.0
             / sum(count(*)) over (partition by project), 1) as classified_percent
from typed group by project, link_type""")
def _stats(i):
    return L.link_type_stats(_typed(i))


_LOOKUP = _TYPED + """,
lookup as (select distinct host, case when length(host) % 2 = 0 then 'blg' else 'oth' end as code from l where length(host) % 3 = 0),
assigned as (select distinct host, case when length(host) % 5 = 0 then 'nonsense' else 'vid' end as code from l),
known as (select host, code from lookup where code <> 'oth'),
accepted as (select a.host, a.code from assigned a where a.code in (select code from patterns)
             and a.host not in (select host from known))"""


def _lookup(i):
    hosts = i.page_links.select(U.hostname(F.col("link")).alias("host")).distinct()
    n = F.length("host")
    lookup = hosts.filter(n % 3 == 0).withColumn("code", F.when(n % 2 == 0, "blg").otherwise("oth"))
    assigned = hosts.withColumn("code", F.when(n % 5 == 0, "nonsense").otherwise("vid"))
    return L.apply_type_lookup(_typed(i), lookup, assigned, i.patterns)


@query("apply_type_lookup", ["page_links", "patterns"], _LOOKUP + """
select ord, link, case when link_type <> 'oth' then link_type else coalesce(k.code, a.code, 'oth') end as link_type,
       case when link_type = 'oth' and k.code is null and a.code is not null then 'AI' end as type_source
from typed t left join known k on k.host = t.host left join accepted a on a.host = t.host""")
def _apply_lookup(i):
    return _lookup(i)[0].select("ord", "link", "link_type", "type_source")


@query("type_lookup", ["page_links", "patterns"], _LOOKUP + """
select host, code from lookup where host not in (select host from accepted) union all select host, code from accepted""")
def _new_lookup(i):
    return _lookup(i)[1]


@query("link_types", ["page_links", "patterns"], _TYPED + """
select distinct project, question_id, date, link_type as code, coalesce(p.name, 'Other') as name
from typed t left join patterns p on p.code = t.link_type""")
def _types(i):
    return L.link_types(_typed(i), i.patterns)


@query("link_domains", ["page_links", "patterns"], _TYPED + """
select project, question_id, date, host as domain, arg_min(link_type, ord) as link_type from typed group by 1, 2, 3, 4""")
def _domains(i):
    return L.link_domains(_typed(i))


def _rollup_sql(by: str) -> str:
    if by == "link_type":
        rank = "coalesce(CAST(floor(sum(rs) / nullif(sum(rn), 0) + 0.5) AS BIGINT), 999)"
        mrank = "coalesce(case when m.mentions > 0 then CAST(floor(rs / nullif(rn, 0) + 0.5) AS BIGINT) end, -1)"
    else:
        rank, mrank = "coalesce(min(rmin), -1)", "rmin"
    return _TYPED + f""",
r as (
  select project, question_id, date, {'link_type' if by == 'link_type' else 'host'} as k, model_id, sum(mentions) as mentions,
         sum(influence) as influence, sum(rank) filter (where rank > 0) as rs, count(*) filter (where rank > 0) as rn,
         min(rank) filter (where rank > 0) as rmin
  from typed group by 1, 2, 3, 4, 5
),
e as (
  select project, question_id, date, k, sum(mentions) as mentions, sum(influence) as influence, {rank} as rank,
         coalesce(string_agg(model_id, ',' order by model_id) filter (where mentions > 0), '') as bots
  from r group by 1, 2, 3, 4
),
es as (select *, sum(mentions) over (partition by project, question_id, date) as tm,
              sum(influence) over (partition by project, question_id, date) as ti from e),
ms as (select *, sum(mentions) over (partition by project, question_id, date, model_id) as tm,
              sum(influence) over (partition by project, question_id, date, model_id) as ti from r)
select m.project, m.question_id, m.date, m.k as {by}, m.model_id, es.bots, CAST(es.mentions AS BIGINT) as mentions,
       CAST(m.mentions AS BIGINT) as model_mentions,
       case when es.tm > 0 then round(es.mentions / es.tm, 5) else 0 end as share,
       case when m.tm > 0 then round(m.mentions / m.tm, 5) else 0 end as model_share,
       es.rank, {mrank} as model_rank,
       case when es.ti > 0 then round(es.influence / es.ti, 5) else 0 end as influence,
       case when m.ti > 0 then round(m.influence / m.ti, 5) else 0 end as model_influence
from ms m join es on es.project = m.project and es.question_id = m.question_id and es.date = m.date and es.k = m.k"""


@query("rollup_link_types", ["page_links", "patterns"], _rollup_sql("link_type"))
def _rollup_types(i):
    return L.rollup_links(_typed(i), "link_type")


@query("rollup_link_domains", ["page_links", "patterns"], _rollup_sql("domain"))
def _rollup_domains(i):
    return L.rollup_links(_typed(i), "domain")


@query("valid_links", [], r"""
with c as (
  select page_id, unnest([url, replace(url, '.example.', '_example.'), split_part(url, '//', 2), split_part(url, '/', 4), 'ftp:' || split_part(url, ':', 2)]) as link
  from pages
)
select page_id, link from c
where length(trim(link)) >= 4 and regexp_matches(
  case when regexp_matches(lower(trim(link)), '^(https?|ftp)://.+$') then regexp_extract(lower(trim(link)), '^(?:https?|ftp)://([^/]+)', 1)
       else split_part(lower(trim(link)), '/', 1) end,
  '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}$')""")
def _valid(i):
    url = F.col("url")
    forms = i.pages.select("page_id", F.explode(F.array(
        url, F.replace(url, F.lit(".example."), F.lit("_example.")), F.split_part(url, F.lit("//"), F.lit(2)),
        F.split_part(url, F.lit("/"), F.lit(4)), F.concat(F.lit("ftp:"), F.split_part(url, F.lit(":"), F.lit(2))),
    )).alias("link"))
    return L.valid_links(forms)


@query("is_url_like_title", [], r"""
with c as (
  select page_id, url, unnest([url, split_part(url, '/', 3), 'Untitled', 'Page ' || page_id, 'WWW.' || split_part(url, '//', 2)]) as title from pages
),
n as (select *, lower(regexp_replace(url, '^https?://', '')) as u, regexp_replace(lower(title), '^https?://', '') as t from c)
select page_id, title, contains(u, t) or title = 'Untitled'
   or regexp_replace(regexp_replace(u, '^www\.', ''), '/$', '') = regexp_replace(regexp_replace(t, '^www\.', ''), '/$', '') as url_like
from n""")
def _like(i):
    url = F.col("url")
    rows = i.pages.select("page_id", "url", F.explode(F.array(
        url, F.split_part(url, F.lit("/"), F.lit(3)), F.lit("Untitled"), F.concat(F.lit("Page "), F.col("page_id")),
        F.concat(F.lit("WWW."), F.split_part(url, F.lit("//"), F.lit(2))),
    )).alias("title"))
    return rows.select("page_id", "title", U.is_url_like_title(url, F.col("title")).alias("url_like"))
