"""Queries over citations, source attribution and model batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.catalog.linking import _clean as _canonical
from answerlens.catalog.registry import query
from answerlens.functions import text as TX
from answerlens.functions import urls as U
from answerlens.operators import attribution as A
from answerlens.operators import citations as C
from answerlens.operators import enrich as X
from answerlens.operators import entities as E
from answerlens.sources import ingest as I
from answerlens.sources import model_output as O
from answerlens.sources import stores as ST

_KEYS = ["project", "question_id", "date", "model_id", "answer_id"]


def _responses(i):
    """Response rows with citation arrays, annotations and a message."""
    note = F.struct(
        F.lit("url_citation").alias("type"),
        F.struct(F.col("cite2").alias("url"), F.col("title1").alias("title"), F.col("note").alias("content")).alias("url_citation"),
    )
    linked = lambda url, title: F.struct(F.col(url).alias("url"), title.alias("title"), F.col("note").alias("content"))
    third = F.col("answer_id") % 3
    return (
        i.responses
        .withColumn("citations", F.array("cite1", "cite2"))
        .withColumn("annotations", F.when(third == 0, F.array(note)).otherwise(F.array().cast(
            "array<struct<type:string,url_citation:struct<url:string,title:string,content:string>>>")))
        .withColumn("message", F.struct(
            "content", "annotations", F.when(third == 1, F.array(linked("cite1", F.lit(None).cast("string")))).alias("citations"),
            F.when(third == 2, F.array(linked("cite1", F.col("title1")), linked("cite1", F.lit("again")))).alias("search_results"),
            F.struct(F.array(linked("cite2", F.col("title2"))).alias("citations")).alias("context"),
        ))
        .select(*_KEYS, "content", "citations", "annotations", "message")
    )


_SEP = "chr(1)"
_SENTS = rf"""
sents as (
  select *, list_filter(list_transform(string_split(
     regexp_replace(regexp_replace(
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(Mr|Mrs|Ms|Dr|Prof)\.', '\1[DOT]', 'g'),
         'U\.S\.', 'US', 'g'), 'U\.K\.', 'UK', 'g'), 'e\.g\.', 'eg', 'g'), 'i\.e\.', 'ie', 'g'),
       '\n([-*]|\d+\.)', chr(1) || '\1', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
     lambda p: trim(replace(p, '[DOT]', '.'), ' ')), lambda p: length(regexp_replace(p, '\s+', '', 'g')) > 0) as s
  from responses
)"""


@query("sentences", ["responses"], f"with {_SENTS} select answer_id, CAST(unnest(range(1, len(s) + 1)) AS BIGINT) as sentence_no, unnest(s) as sentence from sents")
def _sentences(i):
    return A.sentences(_responses(i))


@query("resolve_citations", ["responses"], r"""
with n as (select answer_id, cite1, cite2, unnest(regexp_extract_all(content, '\[(\d+)\]', 1)) as k from responses)
select answer_id, case k when '1' then cite1 else cite2 end as url, count(*) as times from n where k in ('1', '2') group by 1, 2""")
def _resolve(i):
    r = _responses(i)
    return r.select("answer_id", F.explode(A.resolve_citations(F.col("content"), F.col("citations"))).alias("url")).groupBy(
        "answer_id", "url").agg(F.count(F.lit(1)).alias("times"))


_NAMED = r"""
terms as (select distinct project, question_id, lower(entity) as term from entities),
pairs as (select r.*, t.term from responses r join terms t on t.project = r.project and t.question_id = r.question_id)"""


_MD = r"'\[([^\]]+)\]\(([^)]+)\)'"
_URL = r"""'https?://[^\s<>"{}|\\^`\[\]]+'"""
_PLACE = "split_part(split_part(split_part({u}, '/', 1), '?', 1), '#', 1)"


def _gap(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


# Each strategy in steps: sentences, links close to a name, leading links (the next one not yet given, by recursion), the rest.
_STRATEGIES = rf"""
{_SENTS},
terms as (select distinct project, question_id, lower(entity) as term from entities),
sx as (select project, question_id, answer_id, cite1, cite2, unnest(s) as text, unnest(range(1, len(s) + 1)) as i from sents),
ps as (select sx.*, t.term from sx join terms t on t.project = sx.project and t.question_id = sx.question_id and contains(lower(sx.text), t.term)),
mk as (
  select answer_id, term, text, '[' || n || ']' as marker, case n when '1' then cite1 when '2' then cite2 end as url, false as titled
  from (select *, unnest(regexp_extract_all(text, '\[(\d+)\]', 1)) as n from ps)
  union all
  select answer_id, term, text, m, trim(regexp_extract(m, {_MD}, 2)), lower(regexp_extract(m, {_MD}, 1)) = term
  from (select *, unnest(regexp_extract_all(text, {_MD})) as m from ps)
  union all
  select answer_id, term, text, u, u, false from (select *, unnest(regexp_extract_all(text, 'https?://[^\s)\[\]]+')) as u from ps)
),
ml as (
  select *, strpos(text, marker) as place, substr(lower(text), 1, CAST(strpos(text, marker) - 2 + length(term) AS BIGINT)) as upto,
    strpos(substr(lower(text), strpos(text, marker)), term) as ahead
  from mk where url is not null
),
mg as (
  select *, case when contains(upto, term) then substr(text, length(upto) - strpos(reverse(upto), reverse(term)) - length(term) + 2,
      place - (length(upto) - strpos(reverse(upto), reverse(term)) - length(term) + 2)) end as lt,
    case when ahead > 0 then substr(text, place, ahead - 1) end as rt
  from ml
),
near as (
  select distinct answer_id, term, {_canonical('url')} as url from mg
  where (titled or (least({_gap('lt', r'\S+')}, {_gap('rt', r'\S+')}) <= 250 and least({_gap('lt', '[.!?]+')}, {_gap('rt', '[.!?]+')}) <= 2))
    and (starts_with(url, 'http') or starts_with(marker, '[') and not contains(marker, '](')) and {_canonical('url')} <> ''
),
lead as (
  select *, regexp_extract_all(text, {_MD}, 2) as md, regexp_replace(text, {_MD}, ' ', 'g') as t2
  from sx where regexp_matches(text, '(?i)^\s*(https?://|www\.|[a-z0-9][-a-z0-9]*\.[a-z]{{2,}})')
),
seen as (
  select answer_id, i, t2, list_filter(list_concat(list_transform(md, lambda m: {_canonical('m')}), list_transform(regexp_extract_all(t2, {_URL}), lambda m: {_canonical('m')})),
    lambda u: u <> '' and not starts_with(u, '#')) as known
  from lead
),
lall as (
  select answer_id, i, list_concat(known, list_filter(regexp_extract_all(lower(regexp_replace(t2, {_URL}, ' ', 'g')), '\b(?:[a-z0-9][-a-z0-9]*\.)+[a-z]{{2,}}\b'),
    lambda d: not list_contains(list_transform(known, lambda u: regexp_replace({_PLACE.format(u='u')}, '^www\.', '')), d) and not list_contains(known, d)
      and not regexp_matches(d, '\.(md|js|ts|json)$'))) as listed
  from seen
),
leads as (select answer_id, i, list_filter(listed, lambda u: not regexp_matches(u, '\.(jpg|png|gif|jpeg|webp|svg)$')) as links from lall),
ah as (
  select p.answer_id, p.term, p.i, row_number() over (partition by p.answer_id, p.term order by p.i) as m,
    (select arg_min(l.links, l.i) from leads l where l.answer_id = p.answer_id and l.i between p.i and p.i + 2) as first,
    (select arg_min(l.links, l.i) from leads l where l.answer_id = p.answer_id and l.i between p.i and p.i + 2 and len(l.links) > 0) as filled,
    (select max(l.i) from leads l where l.answer_id = p.answer_id and l.i < p.i) as j,
    coalesce((select max(x.i) from sx x where x.answer_id = p.answer_id and x.i < p.i and length(x.text) < 10), 0) as short
  from ps p
),
av as (select ah.*, case when j > short then (select any_value(l.links) from leads l where l.answer_id = ah.answer_id and l.i = ah.j) end as behind from ah),
walk as (
  with recursive w(answer_id, term, m, acc) as (
    select answer_id, term, m, case when filled is not null then [filled[1]] else coalesce(list_distinct(behind), []) end from av where m = 1
    union all
    select v.answer_id, v.term, v.m, case when len(w.acc) = 0 then case when v.filled is not null then [v.filled[1]] else coalesce(list_distinct(v.behind), []) end
      else list_concat(w.acc, coalesce(list_filter(v.first, lambda u: not list_contains(w.acc, u))[1:1], [])) end
    from w join av v on v.answer_id = w.answer_id and v.term = w.term and v.m = w.m + 1
  )
  select answer_id, term, arg_max(acc, m) as acc from w group by 1, 2
),
starting as (select answer_id, term, unnest(acc) as url from walk),
{_NAMED.strip()[len("terms as (select distinct project, question_id, lower(entity) as term from entities),"):].strip()},
annotated as (
  select answer_id, term, {_canonical('cite2')} as url from pairs where answer_id % 3 = 0 and (contains(lower(title1), trim(term)) or contains(lower(coalesce(note, '')), trim(term))
    or contains(lower(cite2), trim(term)) or contains(lower(cite2), replace(trim(term), ' ', '-')) or contains(lower(cite2), replace(trim(term), ' ', '_')))
),
hit as (select answer_id, term, case when contains(lower(cite1), trim(term)) or contains(lower(cite1), replace(trim(term), ' ', '-')) or contains(lower(cite1), replace(trim(term), ' ', '_')) then cite1
    when contains(lower(cite2), trim(term)) or contains(lower(cite2), replace(trim(term), ' ', '-')) or contains(lower(cite2), replace(trim(term), ' ', '_')) then cite2 end as raw from pairs),
cited as (select answer_id, term, {_canonical('raw')} as url from hit where raw is not null),
both_first as (select * from annotated union select * from near),
with_leading as (select * from both_first union all select * from starting l where not exists (select 1 from both_first b where b.answer_id = l.answer_id and b.term = l.term)),
sources as (
  select distinct r.project, r.question_id, r.date, r.model_id, x.answer_id, x.term, x.url from (
    select * from with_leading union all
    select * from cited c where not exists (select 1 from with_leading b where b.answer_id = c.answer_id and b.term = c.term)
  ) x join responses r on r.answer_id = x.answer_id
)"""


@query("links_in_annotations", ["responses", "entities"], f"with {_STRATEGIES} select answer_id, term, url from annotated")
def _annotated(i):
    found = A.links_by_strategy(_responses(i), i.entities)
    return found.select("answer_id", "term", F.explode("annotated").alias("url"))


@query("links_in_citations", ["responses", "entities"], f"with {_STRATEGIES} select answer_id, term, url from cited")
def _cited(i):
    found = A.links_by_strategy(_responses(i), i.entities)
    return found.select("answer_id", "term", F.explode("cited").alias("url"))


@query("links_near_entity", ["responses", "entities"], f"with {_STRATEGIES} select answer_id, term, url from near")
def _near(i):
    found = A.links_by_strategy(_responses(i), i.entities)
    return found.select("answer_id", "term", F.explode(F.array_distinct("near")).alias("url"))


@query("links_at_sentence_start", ["responses", "entities"], f"with {_STRATEGIES} select answer_id, term, url from starting")
def _leading(i):
    found = A.links_by_strategy(_responses(i), i.entities)
    return found.select("answer_id", "term", F.explode("leading").alias("url"))


@query("answer_sources", ["responses", "entities"], f"with {_STRATEGIES} select * from sources")
def _answer_sources(i):
    return A.answer_sources(_responses(i), i.entities)


@query("attribute_sources", ["responses", "entities"], f"""
with {_STRATEGIES},
snaps as (select distinct project, question_id, date from responses),
e as (select x.project, x.question_id, s.date, x.section, x.entity, lower(x.entity) as term from entities x join snaps s using (project, question_id)),
days as (select project, date, row_number() over (partition by project order by date) as no from (select distinct project, date from responses)),
now as (select e.*, s.model_id, s.date as seen_date, s.url from e join sources s using (project, question_id, date, term)),
needy as (
  select e.* from e where length(e.entity) % 2 = 0 or not exists (
    select 1 from now n where n.project = e.project and n.question_id = e.question_id and n.date = e.date and n.section = e.section and n.entity = e.entity)
),
earlier as (
  select n.*, s.model_id, s.date as seen_date, s.url
  from needy n join days d on d.project = n.project and d.date = n.date
  join days b on b.project = n.project and b.no between d.no - 10 and d.no - 1
  join sources s on s.project = n.project and s.question_id = n.question_id and s.date = b.date and s.term = n.term
),
every as (select * from now union all select * from earlier)
select project, question_id, date, section, entity, {_canonical('url')} as url, string_agg(distinct model_id, ',' order by model_id) as models,
  string_agg(distinct CAST(seen_date AS VARCHAR), ',' order by CAST(seen_date AS VARCHAR)) as dates
from every group by 1, 2, 3, 4, 5, 6""")
def _attribute(i):
    r = _responses(i)
    dates = r.select("project", "date").distinct()
    entities = i.entities.join(r.select("project", "question_id", "date").distinct(), ["project", "question_id"])
    # Names of even length count as never mentioned.
    facts = entities.withColumn("mentions", F.length("entity") % 2)
    return A.attribute_sources(r, entities, facts, dates).withColumn("models", F.array_join("models", ",")).withColumn(
        "dates", F.array_join(F.col("dates").cast("array<string>"), ","))


@query("dedupe_sources", ["linked_answers"], r"""
with l as (
  select project, question_id, date, model_id, unnest([concat('https://www.', split_part(split_part(split_part(text, 'https://www.', 2), '/', 1), ' ', 1), '/a/'),
            concat('http://', split_part(split_part(split_part(text, 'https://www.', 2), '/', 1), ' ', 1), '/a')]) as url
  from linked_answers
)
select project, question_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '/+$', '') as url,
       string_agg(distinct model_id, ',' order by model_id) as models, string_agg(distinct CAST(date AS VARCHAR), ',' order by CAST(date AS VARCHAR)) as dates
from l group by 1, 2, 3""")
def _dedupe(i):
    host = F.split_part(F.split_part(F.split_part("text", F.lit("https://www."), F.lit(2)), F.lit("/"), F.lit(1)), F.lit(" "), F.lit(1))
    rows = i.linked_answers.select("project", "question_id", F.col("date").alias("seen_date"), "model_id", F.explode(F.array(
        F.concat(F.lit("https://www."), host, F.lit("/a/")), F.concat(F.lit("http://"), host, F.lit("/a")),
    )).alias("url"))
    out = A.dedupe_sources(rows, ["project", "question_id"])
    return out.withColumn("models", F.array_join("models", ",")).withColumn("dates", F.array_join(F.col("dates").cast("array<string>"), ","))


@query("context_windows", ["responses", "entities"], f"""
with {_SENTS},
terms as (select distinct project, question_id, lower(entity) as term from entities),
p as (select r.answer_id, r.s, t.term from sents r join terms t on t.project = r.project and t.question_id = r.question_id where contains(lower(r.content), t.term)),
m as (select answer_id, term, s, unnest(list_filter(range(1, len(s) + 1), lambda i: contains(lower(s[i]), term))) as i from p),
r as (select distinct answer_id, term, s, greatest(1, i - 2) as a, least(len(s), i + 2) as b from m)
select answer_id, term, a as first_sentence, b as last_sentence, md5(array_to_string(s[a:b], ' ')) as context from r""")
def _windows(i):
    return A.context_windows(_responses(i), i.entities).select(
        "answer_id", "term", "first_sentence", "last_sentence", F.md5("context").alias("context")
    )


_DEC = "replace(replace(replace(note, '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"


@query("citations", ["responses"], f"""
select answer_id, true as numbered, CAST(1 AS INT) as pos, case when answer_id % 3 = 0 then cite2 else cite1 end as url,
       case when answer_id % 3 = 0 then title1 else cite1 end as title, case when answer_id % 3 = 0 then {_DEC} end as content from responses
union all select answer_id, true, CAST(2 AS INT), cite2, cite2, null from responses
union all select answer_id, false, CAST(1 AS INT), case when answer_id % 3 = 0 then cite2 else cite1 end,
       case answer_id % 3 when 0 then title2 when 1 then 'Untitled' else title1 end, {_DEC} from responses
union all select answer_id, false, CAST(2 AS INT), cite2, title2, {_DEC} from responses where answer_id % 3 <> 0 and cite1 <> cite2""")
def _citations(i):
    return C.citations(_responses(i), ["answer_id"])


def _like(url: str, title: str) -> str:
    plain = lambda c: f"regexp_replace(regexp_replace({c}, '^www\\.', ''), '/$', '')"
    u, t = f"lower(regexp_replace({url}, '^https?://', ''))", f"regexp_replace(lower({title}), '^https?://', '')"
    return f"(contains({u}, {t}) or {plain(u)} = {plain(t)} or {title} = 'Untitled')"


@query("answers_with_citations", ["responses"], rf"""
with c as (
  select *, case when answer_id % 3 = 0 then cite2 else cite1 end as u1, case when answer_id % 3 = 0 then title1 else cite1 end as t1,
         case when answer_id % 3 = 0 then {_DEC} end as c1 from responses
),
l as (
  select *, case when {_like('u1', 't1')} then '[[1]](' || u1 || ')' else '[' || t1 || '](' || u1 || ')' end as r1,
            case when {_like('cite2', 'cite2')} then '[[2]](' || cite2 || ')' else '[' || cite2 || '](' || cite2 || ')' end as r2 from c
)
select answer_id, md5(replace(replace(content, '[1].', r1 || '.'), '[2] and', r2 || ' and')
  || chr(10) || chr(10) || '# CITATIONS' || chr(10) || chr(10) || '1. [' || t1 || '](' || u1 || ')' || chr(10) || case when c1 is not null then chr(10) || c1 || chr(10) else '' end
  || chr(10) || '2. [' || cite2 || '](' || cite2 || ')' || chr(10)) as text
from l""")
def _with_citations(i):
    return C.answers_with_citations(_responses(i), ["answer_id"]).withColumn("text", F.md5("text"))


@query("parse_responses", ["responses"], """
select answer_id, content, cite1 || ' ' || cite2 as cited from responses where answer_id % 5 < 3""")
def _parse(i):
    body = F.to_json(F.struct(
        F.when(F.col("answer_id") % 5 != 3, F.array(F.struct(F.struct("content").alias("message")))).otherwise(
            F.array().cast("array<struct<message:struct<content:string>>>")).alias("choices"),
        "citations",
    ))
    texts = _responses(i).select("answer_id", F.when(F.col("answer_id") % 5 == 4, F.lit("{broken")).otherwise(body).alias("json"))
    return I.parse_responses(texts).select(
        "answer_id", F.col("message.content").alias("content"), F.array_join("citations", " ").alias("cited")
    )


@query("entity_links_from_answers", ["titled_answers", "link_entities"], """
with e as (select distinct entity, lower(entity) as term from link_entities),
l as (
  select a.*, e.entity, e.term, text[strpos(text, '](') + 2 : strpos(text, ') or') - 1] as url
  from titled_answers a join e on contains(lower(text[1 : strpos(text, '](')]), e.term)
)
select project, question_id, date, entity, arg_min(url, answer_id) as link from l group by 1, 2, 3, 4""")
def _links_answers(i):
    return X.entity_links_from_answers(i.link_entities, i.titled_answers).drop("section")


@query("entity_links_from_domains", ["link_items", "short_links"], r"""
with d as (select distinct project, question_id, date, regexp_replace(lower(split_part(link, '/', 3)), '^www\.', '') as dom from short_links),
g as (select e.*, unnest([1, 2, 3, 4]) as o, unnest(['.com', '.org', '.ai', '.io']) as ending from link_items e)
select project, question_id, date, section, entity, arg_min(d.dom, o) as link
from g join d using (project, question_id, date) where d.dom = lower(replace(entity, ' ', '')) || ending group by 1, 2, 3, 4, 5""")
def _links_domains(i):
    return X.entity_links_from_domains(i.link_items, i.short_links)


@query("build_batches", ["metrics"], """
with n as (
  select project, section, question_id, date, entity, CAST(dense_rank() over (partition by project, section, question_id, date order by entity) AS BIGINT) as item_no from metrics
)
select project, section, question_id, date, CAST(floor((item_no - 1) / 15) AS BIGINT) as batch_no, count(*) as items,
       string_agg(item_no || ',' || entity, chr(10) order by item_no) as request
from n group by 1, 2, 3, 4, 5""")
def _batches(i):
    keys = ["project", "section", "question_id", "date"]
    from answerlens.operators.scale import ranked

    items = ranked(i.metrics, keys, ["entity"], F.substring("entity", 1, 7), "item_no").withColumn("item_name", F.col("entity"))
    return X.build_batches(items, keys, X.BATCH_LINK_TYPES)


@query("answer_context", ["answers"], """
with n as (
  select *, row_number() over (partition by project, question_id, date order by model_id, CAST(answer_id AS VARCHAR)) - 1 as k from answers
)
select project, question_id, date, CAST(floor(k / 64) AS BIGINT) as part_no, count(*) as answers,
       md5(string_agg('<answer model_id="' || model_id || '">' || chr(10) || text || chr(10) || '</answer model_id="' || model_id || '">', chr(10) order by k)) as context
from n group by 1, 2, 3, 4""")
def _context(i):
    return X.answer_context(i.answers).withColumn("context", F.md5("context"))


@query("summary_context", ["named_answers"], """
with s as (select project, question_id, date, 'About ' || lang as question, CAST(count(*) AS VARCHAR) || ' answers' as summary from named_answers group by 1, 2, 3, 4)
select project, date, CAST(0 AS BIGINT) as part_no,
       string_agg('The summary of answers from AIs to the question: "' || question || '":' || chr(10) || summary || chr(10) || chr(10), '' order by question_id) as context
from s group by 1, 2""")
def _summary_context(i):
    s = i.named_answers.groupBy("project", "question_id", "date", F.concat(F.lit("About "), "lang").alias("question")).agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" answers")).alias("summary"))
    return X.summary_context(s)


_CACHED = """
with k as (select *, model_id || '::' || md5('{"model":"' || model_id || '","role":"' || role || '","size":"' || length(text) || '"}') as key from requests),
cache as (select key, max(text) filter (where age < 3) as value, min(age) as age from k where age > 0 group by 1),
live as (select key from k where age in (1, 2) group by 1)"""


def _cache_inputs(i):
    r = i.requests.withColumn("request", F.create_map(
        F.lit("role"), F.col("role"), F.lit("size"), F.length("text").cast("string"), F.lit("model"), F.col("model_id"),
        F.lit("timestamp"), F.col("request_id").cast("string"),
    ))
    now = 10_000_000
    cache = r.filter(F.col("age") > 0).select(
        X.request_key(F.col("model_id"), F.col("request")).alias("key"), F.col("text").alias("value"),
        (F.lit(now) - F.col("age") * 1_000_000).alias("ts"),
    )
    return r, cache, F.lit(now)


@query("split_cached_open", ["requests"], _CACHED + " select request_id, key from k where key not in (select key from live)")
def _open(i):
    return X.split_cached(*_cache_inputs(i))[1].select("request_id", "key")


@query("split_cached_hits", ["requests"], _CACHED + " select request_id, key from k where key in (select key from live)")
def _hits(i):
    return X.split_cached(*_cache_inputs(i))[0].select("request_id", "key")


@query("merge_attribute", ["page_links"], r"""
select ord, case when ord % 4 = 0 then link when ord % 4 = 1 then 'https://new.example.org/' || ord else '  ' end as link,
       case when ord % 4 = 1 then 'AI' end as origin
from page_links""")
def _merge(i):
    k = F.col("ord") % 4
    items = i.page_links.select("ord", F.when(k == 0, F.col("link")).otherwise(F.lit("  ")).alias("link"))
    results = i.page_links.select("ord", F.when(k == 2, "unknown").when(k == 3, "not a link").otherwise(
        F.concat(F.lit("https://new.example.org/"), "ord")).alias("value"))
    out = X.merge_attribute(items, results, "link", ["ord"])
    return out.select("ord", "link", F.try_element_at("sources", F.lit("link")).alias("origin"))


@query("merge_similar", ["answers"], """
with w as (select answer_id, list_filter(list_transform(string_split(case when answer_id % 3 = 0 then null else text end, ','), lambda t: trim(t)), lambda t: t <> '') as old,
             string_split(text, ' ') as new from answers),
p as (select answer_id, v, min(k) as k from (
  select answer_id, unnest(list_concat(coalesce(old, []), new)) as v, unnest(range(1, len(list_concat(coalesce(old, []), new)) + 1)) as k from w
) group by 1, 2),
r as (select *, row_number() over (partition by answer_id order by k) as no from p)
select answer_id, string_agg(v, ',' order by k) as similar from r where no <= 3 group by 1""")
def _similar(i):
    existing = F.when(F.col("answer_id") % 3 != 0, F.col("text"))
    return i.answers.select("answer_id", X.merge_similar(existing, F.split("text", " ")).alias("similar"))


# Two projects that give the same ids different names.
_PARITY = "case when length(text) % 2 = 0 then 'Even' else 'Odd' end"


@query("clean_summaries", ["answers", "models"], rf"""
with s as (select answer_id, text, model_id, {_PARITY} as word from answers)
select answer_id, regexp_replace(regexp_replace(regexp_replace(
   'By ' || word || ' ' || substr(model_id, 4) || ' and x' || model_id || ' <b>  two' || chr(9) || 'tabs ' || text || '  ', '[ \t]+', ' ', 'g'),
   '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as summary
from s""")
def _clean(i):
    ids = i.models.select("model_id").distinct()
    names = ids.select(F.explode(F.array(F.lit("Even"), F.lit("Odd"))).alias("project"), "model_id").withColumn(
        "display_name", F.concat("project", F.lit(" "), F.substring("model_id", 4, 9))
    )
    df = i.answers.select(F.expr(_PARITY).alias("project"), "answer_id", F.concat(
        F.lit("By "), "model_id", F.lit(" and x"), "model_id", F.lit(' <b title="see '), "model_id", F.lit('">'),
        F.lit("  two\ttabs "), "text", F.lit("  "),
    ).alias("summary"))
    return X.clean_summaries(df, names).drop("project")


@query("entity_index", ["entities"], """
select project, question_id, lower(trim(entity)) as value, arg_max(trim(entity), (length(entity), entity, section)) as original,
       substr(arg_max(section, (length(entity), entity, section)), 1, length(arg_max(section, (length(entity), entity, section))) - 1) as type
from entities where length(entity) > 2 group by 1, 2, 3""")
def _index(i):
    return X.entity_index(i.entities, ["project", "question_id"])


_ENTITY_INDEX = """
idx as (
  select project, question_id, lower(trim(entity)) as value, arg_max(trim(entity), (length(entity), entity, section)) as original,
         substr(arg_max(section, (length(entity), entity, section)), 1, length(arg_max(section, (length(entity), entity, section))) - 1) as type
  from entities where length(entity) > 2 group by 1, 2, 3
)"""


@query("annotate_text", ["answers", "entities"], rf"""
with {_ENTITY_INDEX},
pat as (
  select *, '\b' || array_to_string(list_transform(string_split(original, ''), lambda c:
    case when regexp_matches(c, '[A-Za-z]') then '[' || lower(c) || upper(c) || ']' when regexp_matches(c, '[!-/:-@\[-`{{-~]') then '\' || c else c end), '') || '\b' as pattern
  from idx
),
a as (select project, question_id, answer_id, '<p>' || text || '</p><code>the</code>' as text from answers),
tk as (select project, question_id, answer_id, unnest(regexp_extract_all(text, '<[^>]*>|[^<]+|<')) as t,
         unnest(range(1, len(regexp_extract_all(text, '<[^>]*>|[^<]+|<')) + 1)) as k from a),
sg as (
  select *, coalesce(sum(case when regexp_matches(t, '(?i)^<(code|pre|script|style|a)([\s>/]|$)') and not regexp_matches(t, '/>$') then 1
      when regexp_matches(t, '(?i)^</(code|pre|script|style|a)\s*>') then -1 else 0 end)
    over (partition by answer_id order by k rows between unbounded preceding and 1 preceding), 0) as depth from tk
),
nm as (
  select sg.answer_id, sg.k, p.*, row_number() over (partition by sg.answer_id, sg.k order by -length(p.original), p.value, p.original, p.type) as rank
  from sg join pat p on p.project = sg.project and p.question_id = sg.question_id and contains(lower(sg.t), p.value)
  where sg.depth = 0 and not starts_with(sg.t, '<') and regexp_matches(sg.t, p.pattern)
)
select sg.answer_id, string_agg(case when n.pattern is null then sg.t else regexp_replace(sg.t, n.pattern,
    '<span class="clickable-entity" data-entity-type="' || n.type || '" data-entity-value="' || n.value || '">\0</span>', 'g') end, '' order by sg.k) as text
from sg left join nm n on n.answer_id = sg.answer_id and n.k = sg.k and n.rank = 1 group by 1""")
def _annotate(i):
    texts = i.answers.withColumn("text", F.concat(F.lit("<p>"), "text", F.lit("</p><code>the</code>")))
    return X.annotate_text(texts, i.entities).select("answer_id", "text")


@query("parse_batch_csv", ["outputs"], """
select conv_id, turn, CAST(turn AS INT) as id, name, 'x' || conv_id || '|y|z' as similar from outputs
union all select conv_id, turn, CAST(turn + 1 AS INT), 'plain', 'last' from outputs""")
def _csv(i):
    out = O.parse_batch_output(i.outputs, "csv", ["name", "similar"], ["conv_id", "turn"], "csv_text")
    return out.withColumn("similar", F.array_join("similar", "|"))


@query("parse_batch_json", ["outputs"], """
select conv_id, turn, CAST(turn AS INT) as id, raw as name, 'a|b' as similar from outputs""")
def _json(i):
    out = O.parse_batch_output(i.outputs, "json", ["name", "similar"], ["conv_id", "turn"], "json_text")
    return out.withColumn("similar", F.array_join("similar", "|"))


@query("answer_bundle", ["answers"], """
with n as (
  select *, row_number() over (partition by project, question_id, date order by model_id, CAST(answer_id AS VARCHAR)) - 1 as k from answers
)
select project, question_id, date, CAST(floor(k / 64) AS BIGINT) as part_no, count(*) as answers, CAST(sum(length(text)) AS BIGINT) as chars
from n group by 1, 2, 3, 4""")
def _bundle(i):
    return ST.answer_bundle(i.answers).select(
        "project", "question_id", "date", "part_no", F.size("answers").cast("long").alias("answers"),
        F.aggregate("answers", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("chars"),
    )


@query("trend_export", ["metrics"], """
select project, question_id, section as category, entity as "Name", count(*) as reports, printf('%.2f', floor(avg(mentions) * 100 + 0.5 + 1e-9) / 100) as "Average Mentions" from metrics group by 1, 2, 3, 4""")
def _export(i):
    from answerlens.operators import trends as T

    h = T.item_history(i.metrics)
    rows = ST.trend_export_rows(h.withColumn("project", F.concat_ws("|", "project", "question_id", F.col("reports").cast("string"))))
    p = F.split("project", r"\|")
    return rows.select(
        p[0].alias("project"), p[1].alias("question_id"), "category", "Name", p[2].cast("long").alias("reports"), "Average Mentions"
    )
