"""Queries over page audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.catalog.registry import query
from answerlens.operators import audit as A
from answerlens.plans.audit import audit


def _captures(i):
    """Captures with headers as a map of lists."""
    return i.captures.withColumn("headers", F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("Content-Type").alias("key"), F.array("content_type").alias("value")),
        F.when(F.col("robots_tag").isNotNull(), F.struct(
            F.lit("X-Robots-Tag").alias("key"), F.array("robots_tag").alias("value"),
        )),
    ))))


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _n(pattern: str, text: str = "html") -> str:
    return f"len(regexp_extract_all({text}, {_lit(pattern)}))"


def _sum(parts: list[str]) -> str:
    return " + ".join(parts)


_PARTS = [
    f"least(({_sum([_n(p) for p in patterns])}) / {float(n)}, 1.0)" for _, patterns, n in A.STRUCTURE
] + [
    f"greatest(0.0, 1.0 - least({_n(A.LAZY_IMAGE)} / 5.0, 1.0))",
    f"case when {_n(A.IMAGE)} = 0 then 1.0 else len(list_filter(regexp_extract_all(html, {_lit(A.IMAGE)}), "
    f"lambda x: regexp_matches(x, {_lit(A.IMAGE_ALT)}))) / {_n(A.IMAGE)} end",
]
_STRUCTURE = f"""
structure_scored as (
  select site, url, round(({_sum(_PARTS)}) / 12 * 5.0, 1) as score from captures where variant = 'desktop'
)"""
_SEMANTIC = " or ".join(
    f"regexp_matches(body, '(?i)<{t}[^>]*>[\\s\\S]*?</{t}>')"
    for t in ["main", "article", "section", "p", "h1", "h2", "h3", "h4", "h5", "h6"]
)
_SSR = f"""
bodies as (
  select site, url, html, case when regexp_matches(html, '(?i)<body[^>]*>[\\s\\S]*</body>')
    then regexp_extract(html, '(?i)<body[^>]*>([\\s\\S]*)</body>', 1) else html end as body
  from captures where variant = 'desktop'
),
measured as (
  select *, regexp_replace(body, '(?i)<script[\\s\\S]*?</script>', '', 'g') as plain from bodies
),
ssr_measures as (
  select site, url, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(plain, '(?i)<style[\\s\\S]*?</style>', '', 'g'),
           '<[^>]+>', '', 'g'), '^\\s+', ''), '\\s+$', '')) as text_length,
         length(plain) as content_size, length(body) - length(plain) as script_size,
         {' or '.join(f"regexp_matches(html, {_lit(p)})" for p in A.EMPTY_ROOT)} as empty_root,
         {_SEMANTIC} as semantic
  from measured
),
ssr_scored as (
  select site, url, CAST(round(greatest(0.0, 1.0 - case when empty_root then 0.5 else 0.0 end
      - case when text_length < 500 then 0.3 when text_length < 2000 then 0.1 else 0.0 end
      - case when not semantic then 0.2 else 0.0 end - case when script_size > content_size then 0.1 else 0.0 end) * 8.0, 1) AS DOUBLE) as score
  from ssr_measures
)"""
_JSONLD = f"""
blocks as (
  select site, url, regexp_extract_all(html, {_lit(A.JSONLD_BLOCK)}, 1) as b from captures where variant = 'desktop'
),
block_types as (
  select site, url, flatten(list_transform(list_filter(b, lambda x: json_valid(x)),
    lambda x: case when json_type(x, '$."@type"') = 'ARRAY' then CAST(json_extract(x, '$."@type"') AS VARCHAR[])
              when json_extract_string(x, '$."@type"') is not null then [json_extract_string(x, '$."@type"')] else [] end)) as types
  from blocks
),
jsonld_scored as (
  select site, url, types, case when list_has_any(types, {A.HIGH_VALUE_TYPES}) then least(least(len(types), 3) / 3.0 * 5.0 * 1.1, 5.0)
         else least(len(types), 3) / 3.0 * 5.0 end as score
  from block_types
)"""
_META = r"""
meta_tags_scored as (
  select site, url, case when regexp_matches(html, '(?i)<meta\s+name=["''](robots)["'']\s+content=["''][^"'']*\b(?:noindex|noai|noimageai|nosnippet)\b[^"'']*["'']') then 0.0
    else greatest(0.0, 8.0 - len(list_distinct(list_transform(regexp_extract_all(html,
      '(?i)<meta\s+name=["''](CCBot|ChatGPT\-User|GPTBot|OAI\-SearchBot|PerplexityBot)["'']\s+content=["''][^"'']*\b(?:noindex|noai|noimageai|nosnippet)\b[^"'']*["'']', 1),
      lambda x: lower(x)))) * (8.0 / 5)) end as score
  from captures where variant = 'desktop'
)"""
_MOBILE = r"""
mobile_scored as (
  select d.site, d.url, CAST((case when m.status = 200 then 0.3 else 0 end + case when length(m.html) >= 500 then 0.3 else 0 end
    + case when regexp_matches(m.html, '(?i)<meta\s+name=["'']viewport["'']') then 0.2 else 0 end
    + case when abs(length(d.html) - length(m.html)) <= (length(d.html) + length(m.html)) / 2.0 * 0.2 then 0.2 else 0 end) AS DOUBLE) as share
  from captures d join captures m on m.url = d.url and m.site = d.site and m.variant = 'mobile' where d.variant = 'desktop'
)"""
_HEADERS = r"""
headers_scored as (
  select site, url, case when regexp_matches(coalesce(robots_tag, ''), '(?i)\b(noindex|noai|noimageai|nosnippet)\b') then 0.0 else CAST(15.0 AS DOUBLE) end as score
  from captures where variant = 'desktop'
)"""
_SPEED = """
speed_scored as (
  select site, url, sum(case when ms > 0 then case when ms < 500 then 5 when ms < 1000 then 4 when ms < 2000 then 3 when ms < 3000 then 2 else 1 end end) / 10.0 * 7 as score
  from captures group by 1, 2
)"""
_BLOCKED = r"""
lines as (
  select site, unnest(string_split(robots, chr(10))) as line, generate_subscripts(string_split(robots, chr(10)), 1) as n
  from robots
),
rules as (
  select site, n, trim(line) as line,
         coalesce(last_value(case when lower(trim(line)) like 'user-agent:%' then lower(trim(substr(trim(line), 12))) end ignore nulls)
           over (partition by site order by n rows between unbounded preceding and current row), '*') as agent
  from lines where trim(line) <> '' and not starts_with(trim(line), '#')
),
root_rules as (
  select site, n, agent, lower(line) like 'disallow:%' as blocked from rules
  where regexp_matches(lower(line), '^(disallow|allow):\s*/?\s*$')
),
blocked as (
  select s.site, b.bot, coalesce((select arg_max(r.blocked, r.n) from root_rules r
      where r.site = s.site and (r.agent = '*' or r.agent = lower(b.bot))), false) as blocked
  from robots s cross join (select distinct bot from bots) b
)"""
_VISIBLE = """
visible as (
  select site, product, bool_or(not blocked) as visible from blocked join bot_products using (bot) group by 1, 2
)"""
_ROBOTS = _BLOCKED + "," + _VISIBLE + """,
robots_scored as (
  select r.site, CAST(case when r.status = 404 then 15 when r.status = 200 then
     (select floor(count(*) filter (where visible) / count(*) * 15 + 0.5) from visible v where v.site = r.site) else -1 end AS DOUBLE) as score,
     r.status not in (200, 404) as error
  from robots r
)"""
_SITEMAP = r"""
sitemap_scored as (
  select site, CAST(case when sitemap is null or trim(sitemap) = '' then 0
    when not (starts_with(ltrim(sitemap), '<') and regexp_matches(sitemap, '(?i)<urlset|<sitemapindex')) then 2
    when len(regexp_extract_all(sitemap, '(?i)<loc[^>]*>(.*?)</loc>')) = 0 then 3 else 5 end AS DOUBLE) as score
  from sitemaps
)"""
_GUIDE = """
guide_scored as (
  select site, case when status = 200 and trim(content) <> '' then CAST(1.0 AS DOUBLE) else 0.0 end as score, status not in (200, 404) as error from guide_files
)"""
_CRAWL = r"""
crawl_scored as (
  select distinct site, case when regexp_replace(lower(site), '^www\.', '') in (
    select domain from crawl_index where crawl_id in (select crawl_id from (select distinct crawl_id from crawl_index) order by crawl_id desc limit 3))
    then CAST(3.0 AS DOUBLE) else 0.0 end as score
  from captures
)"""
_ACCESS = """
access as (
  select b.site, b.url, b.bot, not (b.status = 200 and length(b.html) >= 500
     and abs(length(c.html) - length(b.html)) <= (length(c.html) + length(b.html)) / 2.0 * 0.03) as blocked
  from bot_captures b join captures c on c.site = b.site and c.url = b.url and c.variant = 'desktop'
)"""


def _bots_scored(tag: str, top: int) -> str:
    return f"""
bots_{tag}_scored as (
  select site, url, CAST(floor(count(*) filter (where visible) / count(*) * {top} + 0.5) AS DOUBLE) as score
  from (
    select a.site, a.url, p.product, bool_or(not coalesce(x.blocked, false)) as visible
    from (select distinct site, url from access) a cross join bot_products p
    left join (select access.* from access join bots using (bot) where tag = '{tag}') x
      on x.site = a.site and x.url = a.url and x.bot = p.bot
    group by 1, 2, 3
  ) group by 1, 2
)"""


_PAGE = ["captures"]


def _plain(df):
    return df.drop("details", "max_score", "check")


@query("check_structure", _PAGE, f"with {_STRUCTURE} select site, url, score, score >= 3.5 as passed, false as error from structure_scored")
def _structure(i):
    return _plain(A.check_structure(i.captures))


@query("script_measures", _PAGE, f"with {_SSR} select * from ssr_measures")
def _measures(i):
    m = i.captures.filter(F.col("variant") == "desktop").select(
        "site", "url", A.script_measures(F.col("html")).alias("s")
    ).select("site", "url", "s.*").drop("frameworks")
    return m.select(*[F.col(n).cast("long").alias(n) if t == "int" else F.col(n) for n, t in m.dtypes])


@query("check_ssr", _PAGE, f"with {_SSR} select site, url, score, score >= 6.4 as passed, false as error from ssr_scored")
def _ssr(i):
    return _plain(A.check_ssr(i.captures))


@query("check_jsonld", _PAGE, f"""with {_JSONLD}
select site, url, round(score, 6) as score, score = 5.0 as passed, array_to_string(types, ', ') as types from jsonld_scored""")
def _jsonld(i):
    return A.check_jsonld(i.captures).select(
        "site", "url", F.round("score", 6).alias("score"), "passed", F.col("details").alias("types")
    )


@query("check_meta_tags", _PAGE + ["bots"], f"with {_META} select site, url, round(score, 6) as score, score = 8.0 as passed, false as error from meta_tags_scored")
def _meta(i):
    return _plain(A.check_meta_tags(i.captures, i.bots)).withColumn("score", F.round("score", 6))


@query("check_mobile", _PAGE, f"with {_MOBILE} select site, url, round(share * 7, 6) as score, share >= 0.8 - 1e-9 as passed, false as error from mobile_scored")
def _mobile(i):
    return _plain(A.check_mobile(i.captures)).withColumn("score", F.round("score", 6))


@query("check_headers", _PAGE, f"with {_HEADERS} select site, url, score, score > 0 as passed, false as error from headers_scored")
def _headers(i):
    return _plain(A.check_headers(_captures(i)))


@query("check_speed", _PAGE, f"with {_SPEED} select site, url, round(coalesce(score, 0), 6) as score, coalesce(score, 0) >= 6 as passed, score is null as error from speed_scored")
def _speed(i):
    return _plain(A.check_speed(i.captures)).withColumn("score", F.round("score", 6))


@query("robots_blocked", ["robots", "bots"], f"with {_BLOCKED} select * from blocked")
def _blocked(i):
    return A.robots_blocked(i.robots, i.bots)


@query("product_visibility", ["robots", "bots", "bot_products"], f"with {_BLOCKED}, {_VISIBLE} select * from visible")
def _visible(i):
    return A.product_visibility(A.robots_blocked(i.robots, i.bots), i.bot_products)


@query("check_robots", ["robots", "bots", "bot_products"], f"with {_ROBOTS} select site, score, score >= 7 as passed, error from robots_scored")
def _robots(i):
    return _plain(A.check_robots(i.robots, i.bots, i.bot_products))


@query("check_sitemap", ["sitemaps"], f"with {_SITEMAP} select site, score, score = 5 as passed, false as error from sitemap_scored")
def _sitemap(i):
    return _plain(A.check_sitemap(i.sitemaps))


@query("check_llms_txt", ["guide_files"], f"with {_GUIDE} select site, score, score > 0 as passed, error from guide_scored")
def _guide(i):
    return _plain(A.check_llms_txt(i.guide_files))


@query("bot_access", ["captures", "bot_captures"], f"with {_ACCESS} select * from access")
def _access(i):
    return A.bot_access(i.captures, i.bot_captures)


def _bot_query(tag: str):
    top = A.MAX_SCORES[f"bots_{tag}"]

    @query(f"check_bot_access_{tag}", ["captures", "bot_captures", "bots", "bot_products"],
           f"with {_ACCESS}, {_bots_scored(tag, top)} select site, url, score, score >= {int(top * 0.7 + 0.5)} as passed, false as error from bots_{tag}_scored")
    def _check(i):
        return _plain(A.check_bot_access(i.captures, i.bot_captures, i.bots, i.bot_products, f"bots_{tag}"))


for _tag in ("training", "search", "user"):
    _bot_query(_tag)


@query("check_crawl_presence", ["captures", "crawl_index"], f"with {_CRAWL} select site, score, score > 0 as passed, false as error from crawl_scored")
def _crawl(i):
    return _plain(A.check_crawl_presence(i.captures.select("site"), i.crawl_index))


_ERR = " ".join(f"when regexp_matches(html, {_lit('(?i)' + t)}) then {_lit('error page: ' + t)}" for t in A.ERROR_TEXTS)


@query("check_search_presence", ["result_pages", "markers"], f"""
select site, engine, page_ok as passed, case when page_ok then CAST(1.0 AS DOUBLE) else 0.0 end as score from (
  select site, engine, status = 200 and length(html) >= 500 and (case {_ERR} end) is null
     and not regexp_matches(html, {_lit('(?i)' + '|'.join(A.NO_RESULTS))})
     and exists (select 1 from markers m where m.engine = r.engine and regexp_matches(r.html, m.pattern)) as page_ok
  from result_pages r)""")
def _search(i):
    return A.check_search_presence(i.result_pages, i.markers).select("site", "engine", "passed", "score")


@query("valid_pages", _PAGE, f"""
select url, variant, case when length(html) < 500 then 'too small'
  when content_type <> '' and not contains(content_type, 'text/html') then 'content type'
  when regexp_matches(robots_tag, '(?i)noindex') then 'noindex header' {_ERR} end as reason
from captures""")
def _valid(i):
    return A.valid_pages(i.captures).select("url", "variant", "reason")


_ALL = f"""with {_STRUCTURE}, {_SSR}, {_JSONLD}, {_META}, {_MOBILE}, {_HEADERS}, {_SPEED}, {_ROBOTS}, {_SITEMAP}, {_GUIDE}, {_CRAWL},
{_ACCESS}, {', '.join(_bots_scored(t, A.MAX_SCORES['bots_' + t]) for t in ('training', 'search', 'user'))},
pages_only as (select site, url from captures where variant = 'desktop'),
results as (
  select site, url, 'structure' as chk, score, 5.0 as top, false as error from structure_scored
  union all select site, url, 'ssr', score, 8.0, false from ssr_scored
  union all select site, url, 'jsonld', score, 5.0, false from jsonld_scored
  union all select site, url, 'meta_tags', score, 8.0, false from meta_tags_scored
  union all select site, url, 'mobile', share * 7, 7.0, false from mobile_scored
  union all select site, url, 'headers', score, 15.0, false from headers_scored
  union all select site, url, 'speed', coalesce(score, 0), 7.0, score is null from speed_scored
  union all select site, url, 'bots_training', score, 12.0, false from bots_training_scored
  union all select site, url, 'bots_search', score, 10.0, false from bots_search_scored
  union all select site, url, 'bots_user', score, 8.0, false from bots_user_scored
  union all select p.site, p.url, 'robots', score, 15.0, error from pages_only p join robots_scored using (site)
  union all select p.site, p.url, 'sitemap', score, 5.0, false from pages_only p join sitemap_scored using (site)
  union all select p.site, p.url, 'llms_txt', score, 1.0, error from pages_only p join guide_scored using (site)
  union all select p.site, p.url, 'crawl_presence', score, 3.0, false from pages_only p join crawl_scored using (site)
),
sums as (
  select site, url, coalesce(sum(score) filter (where not error), 0) as total, CAST(coalesce(sum(top) filter (where not error), 0) AS DOUBLE) as max_score,
         count(*) filter (where error) as errors
  from results group by 1, 2
),
graded as (select *, CAST(floor(round(total / max_score * 100, 6) + 0.5) AS BIGINT) as percentage from sums)
"""
_ALL_VIEWS = ["captures", "bot_captures", "robots", "bots", "bot_products", "sitemaps", "guide_files", "crawl_index"]


def _audit(i):
    return audit(_captures(i), i.robots, i.bots, i.bot_products, i.sitemaps, i.guide_files, i.bot_captures, i.crawl_index)


@query("audit_results", _ALL_VIEWS, _ALL + 'select site, url, chk as "check", round(score, 4) as score, CAST(top AS DOUBLE) as max_score, error from results')
def _results(i):
    return _audit(i)[0].select("site", "url", "check", F.round("score", 4).alias("score"), "max_score", "error")


@query("audit_score", _ALL_VIEWS, _ALL + f"""
select site, url, errors, max_score, percentage,
       case {' '.join(f"when percentage >= {p} then '{g}'" for p, g in A.GRADES)} else 'F' end as grade
from graded""")
def _score(i):
    return _audit(i)[1].select("site", "url", "errors", "max_score", "percentage", "grade")
