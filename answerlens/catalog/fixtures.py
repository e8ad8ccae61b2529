"""Input views for the registered queries, derived from the given tables.

Each view is SQL that Spark and DuckDB evaluate alike, so one text feeds a query and its check.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_HOST = "split_part(split_part(url,'/',3),':',1)"

# name -> (views it builds on, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "answers": ([], """
select case when lang in ('en','de') then 'p1' else 'p2' end as project, lang as question_id,
       source as model_id, make_date(2024, 1, 1 + CAST(doc_id % 4 AS INT) * 7) as date,
       doc_id as answer_id, text
from documents"""),
    "entities": ([], f"""
select distinct case when lang in ('en','de') then 'p1' else 'p2' end as project,
       lang as question_id, section, entity, CAST(ord AS BIGINT) as ord
from (
  select split_part(url,'/',4) as lang, split_part({_HOST},'.',-3) as entity,
         case length({_HOST}) % 3 when 0 then 'products' when 1 then 'organizations' else 'persons' end as section,
         100 + length({_HOST}) as ord
  from pages
  union all
  select * from (values
    ('en','the','keywords',1), ('en','Tion','keywords',2), ('en','of the','keywords',3),
    ('en','on-the','products',4), ('en','absent-name','products',5), ('en','ing','keywords',6),
    ('de','lich','keywords',1), ('de','und','keywords',2), ('de','der die','keywords',3),
    ('de','ung','products',4), ('de','absent-name','products',5),
    ('fr','ment','keywords',1), ('fr','de la','keywords',2), ('fr','écé','keywords',3),
    ('fr','é','places',4), ('fr','absent-name','products',5),
    ('es','mente','keywords',1), ('es','de la','keywords',2), ('es','ción','keywords',3)
  ) as v(lang, entity, section, ord)
) as s"""),
    "models": ([], """
select distinct case when lang in ('en','de') then 'p1' else 'p2' end as project,
       source as model_id, CAST(substr(source,4) AS BIGINT) * 50000000 as estimated_mau
from documents"""),
    "questions": ([], """
select distinct case when lang in ('en','de') then 'p1' else 'p2' end as project,
       lang as question_id from documents"""),
    "facts": ([], """
select case when l_orderkey % 3 = 0 then 'p0' else 'p1' end as project,
       concat('q', l_orderkey % 3) as question_id,
       CAST(date_trunc('month', l_shipdate) AS DATE) as date, l_returnflag as section,
       p_brand as entity, concat('m', l_suppkey % 5) as model_id,
       CAST(count(*) AS BIGINT) as mentions, CAST(min(l_orderkey) + 1 AS BIGINT) as pos,
       CAST(1 AS BIGINT) as ord
from lineitem join part on l_partkey = p_partkey
group by 1, 2, 3, 4, 5, 6"""),
    "fact_models": (["facts"], """
select distinct project, model_id,
       CAST(substr(model_id,2) AS BIGINT) * 120000000 as estimated_mau,
       concat('Model ', upper(model_id)) as display_name
from facts"""),
    # One row per entity and snapshot, integer measures only.
    "metrics": (["facts"], """
select project, question_id, date, section, entity, CAST(sum(mentions) AS BIGINT) as mentions,
       CAST(min(pos) % 40 + 1 AS BIGINT) as rank,
       CAST(sum(mentions) * 10 + count(*) AS BIGINT) as influence,
       CAST(count(*) AS BIGINT) as model_count
from facts group by 1, 2, 3, 4, 5"""),
    # Entities that come late, go early or pause, for the look-back and trend queries.
    "shifting": (["metrics"], """
select * from metrics
where not (CAST(substr(entity, 7) AS INT) % 5 = 1 and date < DATE '1997-06-01')
  and not (CAST(substr(entity, 7) AS INT) % 5 = 2 and date >= DATE '1995-03-01')
  and not (CAST(substr(entity, 7) AS INT) % 6 = extract(month from date) % 6)"""),
    "view_metrics": (["facts"], """
select project, question_id, date, section, entity, CAST(sum(mentions) AS BIGINT) as mentions,
       CAST(sum(mentions) * 10 + count(*) AS BIGINT) as influence, CAST(sum(mentions) - 2 AS BIGINT) as mentions_change,
       CAST(case when sum(mentions) % 4 = 0 then 10 when sum(mentions) % 4 = 1 then -1 when sum(mentions) % 4 = 2 then 1 else 0 end AS INT) as rank_trend,
       substr(concat(case when max(case when model_id = 'm0' then 1 else 0 end) = 1 then ',m0' else '' end, case when max(case when model_id = 'm1' then 1 else 0 end) = 1 then ',m1' else '' end, case when max(case when model_id = 'm2' then 1 else 0 end) = 1 then ',m2' else '' end, case when max(case when model_id = 'm3' then 1 else 0 end) = 1 then ',m3' else '' end, case when max(case when model_id = 'm4' then 1 else 0 end) = 1 then ',m4' else '' end), 2) as bots
from facts group by 1, 2, 3, 4, 5"""),
    "question_texts": (["facts"], """
select distinct project, question_id, concat(CAST(length(question_id) AS STRING), '-', question_id) as long_id,
       concat('What about ', upper(question_id), '?') as text
from facts"""),
    "named_answers": ([], """
select project, concat(CAST(no AS STRING), '-', lang) as question_id, date, model_id, answer_id, lang, no, text from (
  select case when lang in ('en','de') then 'p1' else 'p2' end as project, lang,
         case lang when 'en' then 1 when 'de' then 2 when 'fr' then 3 else 4 end as no,
         make_date(2024, 1, 1 + CAST(doc_id % 4 AS INT) * 7) as date, source as model_id, doc_id as answer_id, text
  from documents
) as d"""),
    "question_lines": ([], """
select case when turn % 2 = 0 then 'p1' else 'p2' end as project, conv_id * 1000 + turn as line_no,
       case when turn % 5 = 0 then concat('# ', text) when turn % 7 = 0 then '  ' else text end as line
from conversations"""),
    "extracted": ([], """
select case when lang in ('en','de') then 'p1' else 'p2' end as project, lang as question_id,
       make_date(2024, 1, 1 + CAST(doc_id % 4 AS INT) * 7) as date, doc_id,
       split(text, ' ') as products, split(text, ',') as organizations, split(text, chr(10)) as persons, split(text, ';') as colours
from documents"""),
    # Whole documents with links put in behind their sentences.
    "linked_answers": ([], f"""
select 'p' as project, concat('q', d.doc_id % 3) as question_id,
       make_date(2024, 2, 1 + CAST(d.doc_id % 2 AS INT)) as date,
       concat('m', d.doc_id % 5) as model_id, d.doc_id as answer_id,
       concat('See [page ', page_id, '](', url, ') or https://www.', lower({_HOST}),
              '/a/?utm_source=x&id=', page_id, '. Plain ', lower({_HOST}),
              ' too. Also [top](#top), notes.md, and ![img](https://cdn.', lower({_HOST}),
              '/pic.png), then other', page_id % 11, '.org. ',
              replace(d.text, '. ', concat(' [more](', url, '?n=', d.doc_id, '&utm_medium=y). '))) as text
from documents d cross join (select count(*) as n from pages) c join pages p on p.page_id = d.doc_id % c.n"""),
    "link_entities": ([], f"""
select distinct 'p' as project, 'links' as section, lower({_HOST}) as entity,
       CAST(length({_HOST}) AS BIGINT) as ord
from pages"""),
    "page_links": ([], f"""
select 'p' as project, concat('q', page_id % 3) as question_id,
       make_date(2024, 2, 1 + CAST(page_id % 2 AS INT)) as date, url as link,
       page_id as ord, CAST(page_id % 7 AS BIGINT) as mentions,
       CAST(case when page_id % 5 = 0 then -1 else page_id % 13 + 1 end AS BIGINT) as rank,
       CAST(page_id % 17 AS BIGINT) as influence, concat('m', page_id % 5) as model_id
from pages"""),
    "patterns": ([], """
select code, name, CAST(ord AS BIGINT) as ord, kind, pattern from (values
  ('vid','Video',1,'contains','tube'),
  ('blg','Blog',2,'contains','blog.'),
  ('mob','Mobile',3,'regex','^m[.]'),
  ('spm','Junk',4,'contains','cheap-pills'),
  ('spm','Junk',4,'contains','spam-farm'),
  ('doc','Document',5,'contains','/fr/8'),
  ('org','Organisation',6,'endswith','.org'),
  ('com','Commercial',7,'regex','[.]com$')
) as v(code, name, ord, kind, pattern)"""),
    "captures": ([], f"""
select site, url, page_id, variant, robots_tag, content_type,
       CAST(case when page_id % 11 = 0 and variant = 'mobile' then 503 else 200 end AS INT) as status,
       CAST(length(html) % 4000 AS INT) as ms,
       case when variant = 'mobile' and page_id % 3 = 0 then replace(replace(html, '<p>', ''), 'e', '')
            when variant = 'mobile' and page_id % 4 = 0 then replace(html, '</head>', '<meta name="viewport" content="width=device-width"></head>')
            else html end as html
from (
  select {_HOST} as site, concat(url, '~', page_id) as url, page_id, v.variant,
         case page_id % 7 when 0 then 'noindex, nofollow' when 1 then 'max-snippet:5' end as robots_tag,
         case page_id % 13 when 0 then 'application/pdf' else 'text/html; charset=utf-8' end as content_type,
         case page_id % 6
           when 1 then replace(html, '</head>', '<meta name="description" content="d"><meta property="og:title" content="t"><meta property="og:image" content="https://x.org/i.png"><link rel="canonical" href="u"></head>')
           when 2 then replace(html, '</head>', '<script type="application/ld+json">{{"@type": "Article", "name": "n"}}</script><script type="application/ld+json">{{broken</script></head>')
           when 3 then replace(html, '</head>', '<script type="application/ld+json">{{"@type": ["FAQPage", "Thing"]}}</script><script type="application/ld+json"> {{"@type":"WebPage"}} </script></head>')
           when 4 then replace(html, '</head>', case when page_id % 4 = 0 then '<meta name="robots" content="noindex"></head>' else '<meta name="GPTBot" content="noai"><meta name="ccbot" content="x, nosnippet"></head>' end)
           when 5 then replace(html, '</article>', '<div id="root"></div><h2>a</h2><h3>b</h3><table><tr></tr></table><img src="a" alt="x" loading="lazy"><img src="b"><img src="c" alt="y" loading="lazy"></article>')
           else html end as html
  from pages cross join (values ('desktop'),('mobile')) as v(variant)
) as c"""),
    "bot_captures": (["captures", "bots"], """
select c.site, c.url, b.bot, CAST(case when c.page_id % 5 = length(b.bot) % 5 then 403 else 200 end AS INT) as status,
       case when c.page_id % 9 = length(b.bot) % 9 then replace(c.html, 'a', '') else c.html end as html
from captures c cross join bots b where c.variant = 'desktop'"""),
    "sitemaps": ([], f"""
select {_HOST} as site,
       case length({_HOST}) % 5 when 0 then null
         when 1 then concat('<?xml version="1.0"?><urlset>', string_agg(concat('<url><loc>', url, '</loc></url>'), ''), '</urlset>')
         when 2 then '<?xml version="1.0"?><sitemapindex></sitemapindex>'
         when 3 then '<html>no map</html>' else 'plain text <urlset>' end as sitemap
from pages group by {_HOST}"""),
    "guide_files": ([], f"""
select distinct {_HOST} as site, CAST(case length({_HOST}) % 4 when 0 then 404 when 1 then 500 else 200 end AS INT) as status,
       case length({_HOST}) % 4 when 2 then concat('# ', {_HOST}) else ' ' end as content
from pages"""),
    "crawl_index": ([], f"""
select distinct concat('crawl-', 10 + page_id % 6) as crawl_id, regexp_replace({_HOST}, '^www[.]', '') as domain
from pages"""),
    "result_pages": ([], f"""
select {_HOST} as site, case page_id % 2 when 0 then 'alpha' else 'beta' end as engine,
       CAST(case when page_id % 10 = 9 then 429 else 200 end AS INT) as status, page_id,
       case page_id % 3 when 0 then concat(html, '<div class="result">', url, '</div>')
         when 1 then concat(html, '<p>No results found for this</p>') else html end as html
from pages"""),
    "markers": ([], """
select engine, pattern from (values ('alpha','class="result"'), ('beta','<li class="hit"'), ('beta','class="res[a-z]+"')) as v(engine, pattern)"""),
    "robots": ([], f"""
select distinct {_HOST} as site, concat('# file', chr(10), 'User-agent: *', chr(10), 'Disallow: /private', chr(10),
  case when length({_HOST}) % 3 = 0 then concat('User-agent: GPTBot', chr(10), 'Disallow: /', chr(10)) else '' end,
  case when length({_HOST}) % 4 = 0 then concat('User-agent: CCBot', chr(10), 'Disallow:', chr(10), 'Allow: /', chr(10)) else '' end,
  case when length({_HOST}) % 5 = 0 then concat('user-agent: *', chr(10), 'disallow: ', chr(10)) else '' end) as robots,
  CAST(case when length({_HOST}) % 7 = 0 then 404 when length({_HOST}) % 11 = 0 then 500 else 200 end AS INT) as status
from pages"""),
    "bots": ([], """
select bot, tag, user_agent from (values
  ('GPTBot','training','GPTBot'), ('CCBot','training','CCBot'), ('OAI-SearchBot','search','OAI-SearchBot'),
  ('PerplexityBot','search','PerplexityBot'), ('ChatGPT-User','user','ChatGPT-User')
) as v(bot, tag, user_agent)"""),
    "bot_products": ([], """
select bot, product from (values
  ('GPTBot','chat'), ('OAI-SearchBot','chat'), ('ChatGPT-User','chat'), ('PerplexityBot','finder'),
  ('CCBot','chat'), ('CCBot','finder'), ('CCBot','open'), ('GPTBot','trainer')
) as v(bot, product)"""),
    "responses": ([], """
select case when d.lang in ('en','de') then 'p1' else 'p2' end as project, d.lang as question_id,
       make_date(2024, 1, 1 + CAST(d.doc_id % 4 AS INT) * 7) as date, d.source as model_id, d.doc_id as answer_id,
       concat(replace(d.text, '. ', ' [1]. '), ' Seen at [2] and [9]. See ', p2.url, ' now. Www.',
              split_part(split_part(p1.url,'/',3),':',1), ' covers this. A [The page](', p1.url, ') too. Fine end.') as content,
       p1.url as cite1, p2.url as cite2, concat('Page ', p1.page_id) as title1, p2.url as title2,
       case when d.doc_id % 3 = 0 then 'A &lt;b&gt; &amp; c' end as note
from documents d
cross join (select count(*) as n from pages) c
join pages p1 on p1.page_id = d.doc_id % c.n
join pages p2 on p2.page_id = (d.doc_id + 7) % c.n"""),
    "link_items": ([], f"""
select distinct 'p' as project, concat('q', page_id % 3) as question_id, make_date(2024, 2, 1 + CAST(page_id % 2 AS INT)) as date,
       case length({_HOST}) % 2 when 0 then 'products' else 'organizations' end as section,
       split_part(replace({_HOST}, '.example', ''), '.', -2) as entity, CAST(length({_HOST}) AS BIGINT) as ord
from pages"""),
    "short_links": ([], f"""
select 'p' as project, concat('q', page_id % 3) as question_id, make_date(2024, 2, 1 + CAST(page_id % 2 AS INT)) as date,
       concat('https://www.', replace(replace({_HOST}, '.example', ''), 'www.', ''), '/x?ref=1') as link
from pages"""),
    "titled_answers": ([], f"""
select 'p' as project, concat('q', page_id % 3) as question_id, make_date(2024, 2, 1 + CAST(page_id % 2 AS INT)) as date,
       concat('m', page_id % 5) as model_id, page_id as answer_id,
       concat('See [About ', upper({_HOST}), '](', url, ') or [', {_HOST}, '](/local) and [other](', url, '?z)') as text
from pages"""),
    "outputs": ([], """
select conv_id, turn, line as name, raw,
       concat('```csv', chr(10), turn, ',"', replace(line, '"', '""'), '",x', conv_id, ',y, z', chr(10), 'bad,b,c', chr(10), chr(10),
              turn + 1, ', plain ,last', chr(10), '```') as csv_text,
       concat('```json', chr(10), '[{"id": ', turn, ', "name": "',
              replace(replace(replace(replace(replace(raw, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')), chr(10), concat(chr(92), 'n')), chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't')),
              '", "similar": "a, b"}, {"name": "no id"}]', chr(10), '```') as json_text
from (select conv_id, turn, coalesce(text, '') as raw, replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ') as line from conversations) as c"""),
    "requests": ([], """
select concat('m', conv_id % 3) as model_id, conv_id * 1000 + turn as request_id, role, text, CAST(conv_id % 4 AS BIGINT) as age
from conversations"""),
}


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for dep in _closure(VIEWS[name][0]) + [name]:
            if dep not in ordered:
                ordered.append(dep)
    return ordered


def with_views(names: list[str], body: str) -> str:
    """``WITH`` the views a statement uses in front of it."""
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1].strip()})" for n in _closure(names))
    body = body.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        raise ValueError("recursive statements cannot be prefixed")
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def _scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_LOADED: dict[tuple[str, str, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or derived view as a DataFrame over the given folder.

    The unevaluated frame is kept per application, so files are listed and footers read once.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LOADED:
        _LOADED[key] = _load(spark, sf_dir, name)
    return _LOADED[key]


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return _scan(spark, sf_dir, name)
    for table in TABLES:
        if any(re.search(rf"\b{table}\b", VIEWS[v][1]) for v in _closure([name])):
            load(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(with_views([name], f"select * from {name}"))
