"""Checks of captured pages and the site score.

``captures``: site, url, variant ('desktop' | 'mobile'), status, ms, headers
(MAP<STRING, ARRAY<STRING>>), html.  Page checks yield one row per (site, url); site checks one per
site.  Result columns: keys, check, score, max_score, passed, error, details.
Each page is scored by expressions over its own row; only small flags are ever shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from answerlens.functions import scores as SC
from answerlens.functions import urls as U
from answerlens.functions.text import bind


# Checks and the most points each can give.
MAX_SCORES = {
    "robots": 15, "sitemap": 5, "headers": 15, "speed": 7, "jsonld": 5, "meta_tags": 8, "ssr": 8,
    "structure": 5, "mobile": 7, "llms_txt": 1, "bots_training": 12, "bots_search": 10,
    "bots_user": 8, "crawl_presence": 3, "search_presence": 1,
}
# Lowest percentage of each grade.
GRADES = [
    (97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"),
    (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (63, "D"), (60, "D-"),
]
# Parts of a well-structured page: label, patterns, number wanted.
STRUCTURE = [
    ("H1 tag", [r"(?i)<h1[^>]*>"], 1),
    ("H2/H3 headings", [r"(?i)<h2[^>]*>", r"(?i)<h3[^>]*>"], 5),
    ("meta description", [r"(?i)<meta\s+name=[\"']description[\"']\s+content=[\"'][^\"']+[\"']"], 1),
    ("Open Graph title", [r"(?i)<meta\s+property=[\"']og:title[\"']\s+content=[\"'][^\"']+[\"']"], 1),
    ("Open Graph description", [r"(?i)<meta\s+property=[\"']og:description[\"']\s+content=[\"'][^\"']+[\"']"], 1),
    ("Open Graph image", [r"(?i)<meta\s+property=[\"']og:image[\"']\s+content=[\"']https?://[^\"']+[\"']"], 1),
    ("canonical URL", [r"(?i)<link\s+rel=[\"']canonical[\"']"], 1),
    ("language declaration", [r"(?i)<html[^>]+lang=[\"'][a-zA-Z-]+[\"']"], 1),
    ("lists", [r"(?i)<(?:ul|ol)[^>]*>"], 1),
    ("tables", [r"(?i)<table[^>]*>"], 1),
]
LAZY_IMAGE = r"(?i)loading=[\"']lazy[\"']"
IMAGE, IMAGE_ALT = r"(?i)<img[^>]*>", r"(?i)alt=[\"'][^\"']+[\"']"
# Pages whose content needs scripts, and how to recognise frameworks.
EMPTY_ROOT = [
    r"(?i)<div\s+id=[\"'](?:root|app)[\"']\s*>\s*</div>",
    r"(?i)<div\s+id=[\"']__next[\"']\s*>",
    r"(?i)<div\s+id=[\"']__nuxt[\"']\s*>",
]
FRAMEWORKS = [
    ("React", r"(?i)react|ReactDOM"), ("Vue", r"(?i)vue\.js|createApp|Vue\.createApp"),
    ("Angular", r"(?i)ng-app|angular|@angular"), ("Svelte", r"(?i)svelte"),
]
SEMANTIC = r"(?i)<(main|article|section|p|h[1-6])[^>]*>[\s\S]*?</\1>"
# Structured data.
JSONLD_BLOCK = r"(?i)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>([\s\S]*?)</script>"
HIGH_VALUE_TYPES = ["FAQPage", "QAPage", "Article", "NewsArticle", "BlogPosting", "HowTo", "Recipe"]
VIEWPORT = r"(?i)<meta\s+name=[\"']viewport[\"']"
# Directives that keep a page out of AI answers.
BLOCKING = r"(?i)\b(noindex|noai|noimageai|nosnippet)\b"
# Sizes, tolerances and times.
MIN_PAGE_SIZE = 500
MOBILE_TOLERANCE, BOT_TOLERANCE = 0.20, 0.03
SPEED_STEPS = [(500, 5), (1000, 4), (2000, 3), (3000, 2)]
# Texts of error, captcha and blocking pages.
ERROR_TEXTS = [
    "too many requests", "rate limit", "try again later", "captcha", "recaptcha",
    "verify you(?:'re| are) (not )?a (robot|human)", "access denied", "403 forbidden",
    "you don't have permission", "blocked", "unusual traffic", "automated requests",
    "suspicious activity",
]
# Texts of result pages without results.
NO_RESULTS = [
    "No results found", "couldn't find any results", "didn't match any results", "0 results",
    "Too few matches were found", "No results found for", "There are no results for",
]
BOT_TAGS = {"bots_training": "training", "bots_search": "search", "bots_user": "user"}

PAGE = ["site", "url"]


# Rows of a configuration table that share a number when a result has one row for each of them.
PER_LIST = 64


def with_each(df: DataFrame, config: DataFrame) -> DataFrame:
    """Each row of ``df`` beside each row of ``config``, for results that hold every combination.

    ``config`` is dealt to numbered lists of about PER_LIST rows and met by equality of the number, so Spark may broadcast
    or shuffle it by its size and no value holds the table.
    """
    lists = config.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PER_LIST)).cast("int").alias("n")).scalar()
    dealt = config.withColumn("__list", F.pmod(F.xxhash64(*config.columns), lists).cast("int"))
    return df.withColumn("__list", F.explode(F.sequence(F.lit(0), lists - 1))).join(dealt, "__list").drop("__list")


def _result_columns(check: str, score: Column, passed: Column, details: Column | None, error: Column | None) -> list[Column]:
    return [
        F.lit(check).alias("check"), score.cast("double").alias("score"),
        F.lit(float(MAX_SCORES[check])).alias("max_score"), passed.alias("passed"),
        (F.lit(False) if error is None else error).alias("error"),
        (F.lit(None).cast("string") if details is None else details).alias("details"),
    ]


def _result(df: DataFrame, keys: list[str], check: str, score: Column, passed: Column,
            details: Column | None = None, error: Column | None = None) -> DataFrame:
    return df.select(*keys, *_result_columns(check, score, passed, details, error))


def _desktop(captures: DataFrame) -> DataFrame:
    return captures.filter(F.col("variant") == "desktop")


def _points(share: Column, check: str) -> Column:
    return SC.rounded(share * F.lit(float(MAX_SCORES[check])), 1)


def structure_score(html: Column) -> Column:
    """struct(score, missing) of the twelve equal parts."""
    count = lambda patterns: reduce(lambda a, b: a + b, [F.regexp_count(html, F.lit(p)) for p in patterns])
    parts = [F.least(count(p) / F.lit(float(n)), F.lit(1.0)) for _, p, n in STRUCTURE]
    counted = F.array(*parts)
    lazy = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(count([LAZY_IMAGE]) / F.lit(5.0), F.lit(1.0)))
    with_alt = bind(F.regexp_extract_all(html, F.lit(IMAGE), F.lit(0)), lambda images: F.when(
        F.size(images) == 0, F.lit(1.0)
    ).otherwise(F.try_divide(F.size(F.filter(images, lambda i: i.rlike(IMAGE_ALT))), F.size(images))))

    def scored(p: Column) -> Column:
        total = reduce(lambda a, b: a + b, [p[k] for k in range(len(STRUCTURE))])
        missing = F.array_compact(F.array(*[F.when(p[k] < 1, F.lit(d[0])) for k, d in enumerate(STRUCTURE)]))
        return F.struct(_points((total + lazy + with_alt) / 12, "structure").alias("score"), missing.alias("missing"))

    return bind(counted, scored)


def structure_result(measured: Column) -> tuple:
    score = measured["score"]
    return ("structure", score, score >= MAX_SCORES["structure"] * 0.7,
            F.concat(F.lit("Missing: "), F.array_join(measured["missing"], ", ")))


def check_structure(captures: DataFrame) -> DataFrame:
    """Twelve equal parts: headings, descriptions, canonical, language, lists, tables, images."""
    measured = _desktop(captures).select(*PAGE, structure_score(F.col("html")).alias("structure"))
    return _result(measured, PAGE, *structure_result(F.col("structure")))


def script_measures(html: Column) -> Column:
    """struct of text, script and body sizes and signs of client-side rendering."""
    body = F.when(
        html.rlike(r"(?i)<body[^>]*>[\s\S]*</body>"), F.regexp_extract(html, r"(?i)<body[^>]*>([\s\S]*)</body>", 1)
    ).otherwise(html)

    def measured(b: Column, plain: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(plain, r"(?i)<style[\s\S]*?</style>", ""), r"<[^>]+>", "")
        return F.struct(
            F.length(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("text_length"),
            F.length(plain).alias("content_size"),
            (F.length(b) - F.length(plain)).alias("script_size"),
            reduce(lambda x, y: x | y, [html.rlike(p) for p in EMPTY_ROOT]).alias("empty_root"),
            b.rlike(SEMANTIC).alias("semantic"),
            F.array_compact(F.array(*[F.when(html.rlike(p), F.lit(n)) for n, p in FRAMEWORKS])).alias("frameworks"),
        )

    without_scripts = lambda b: F.regexp_replace(b, r"(?i)<script[\s\S]*?</script>", "")
    return bind(body, lambda b: bind(without_scripts(b), lambda plain: measured(b, plain)))


def ssr_result() -> tuple:
    share = (
        F.lit(1.0)
        - F.when(F.col("empty_root"), 0.5).otherwise(0.0)
        - F.when(F.col("text_length") < 500, 0.3).when(F.col("text_length") < 2000, 0.1).otherwise(0.0)
        - F.when(~F.col("semantic"), 0.2).otherwise(0.0)
        - F.when(F.col("script_size") > F.col("content_size"), 0.1).otherwise(0.0)
    )
    score = _points(F.greatest(F.lit(0.0), share), "ssr")
    return ("ssr", score, score >= MAX_SCORES["ssr"] * 0.8,
            F.concat(F.col("text_length"), F.lit(" chars; frameworks: "), F.array_join("frameworks", ", ")))


def check_ssr(captures: DataFrame) -> DataFrame:
    """Readable without scripts: full points less penalties for empty roots, little text, …"""
    m = _desktop(captures).select(*PAGE, script_measures(F.col("html")).alias("s")).select(*PAGE, "s.*")
    return _result(m, PAGE, *ssr_result())


def jsonld_types(html: Column) -> Column:
    """array<string> of the top-level ``@type`` values of all parseable JSON-LD blocks."""
    blocks = F.regexp_extract_all(html, F.lit(JSONLD_BLOCK), F.lit(1))
    types = F.transform(blocks, lambda b: F.get_json_object(F.trim(b), "$.@type"))
    listed = F.transform(
        F.filter(types, lambda t: t.isNotNull() & (t != "")),
        lambda t: F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>")).otherwise(F.array(t)),
    )
    return F.flatten(listed)


def jsonld_result() -> tuple:
    top = float(MAX_SCORES["jsonld"])
    base = F.least(F.size("types"), F.lit(3)) / F.lit(3.0) * top
    valued = F.arrays_overlap("types", F.array(*[F.lit(t) for t in HIGH_VALUE_TYPES]))
    score = F.when(valued, F.least(base * 1.1, F.lit(top))).otherwise(base)
    return "jsonld", score, score == top, F.array_join("types", ", ")


def check_jsonld(captures: DataFrame) -> DataFrame:
    """Up to three structured-data types; a tenth more with one that AI systems favour."""
    typed = _desktop(captures).select(*PAGE, jsonld_types(F.col("html")).alias("types"))
    return _result(typed, PAGE, *jsonld_result())


def blocking_tags(html: Column) -> tuple[Column, Column]:
    """(whether a ``robots`` tag blocks, array of the lower-cased names of all blocking tags)."""
    tag = r"(?i)<meta\s+name=[\"'](NAMES)[\"']\s+content=[\"'][^\"']*\b(?:noindex|noai|noimageai|nosnippet)\b[^\"']*[\"']"
    named = F.transform(F.regexp_extract_all(html, F.lit(tag.replace("NAMES", "[^\"']+")), F.lit(1)), F.lower)
    return html.rlike(tag.replace("NAMES", "robots")), F.array_distinct(named)


def with_bot_tags(pages: DataFrame, bots: DataFrame) -> DataFrame:
    """``named`` reduced to names of ``bots``, in order; ``n_bots`` is their number.  ``pages`` has one row a page.

    The names of a page meet the bots by equality; the page is put together again by its key.
    """
    known = bots.select(F.lower("bot").alias("__name")).distinct().withColumn("__known", F.lit(True))
    others = [c for c in pages.columns if c not in (*PAGE, "named")]
    each = pages.select(*PAGE, F.struct(*others).alias("__row"), F.posexplode_outer("named").alias("__at", "__name"))
    found = F.array_sort(F.collect_list(F.when(F.col("__known"), F.struct("__at", "__name"))))
    return each.join(known, "__name", "left").groupBy(*PAGE).agg(
        F.first("__row").alias("__row"), F.transform(found, lambda x: x["__name"]).alias("named")
    ).select(*PAGE, "__row.*", "named", bots.agg(F.countDistinct("bot").alias("n")).scalar().alias("n_bots"))


def meta_result(n_bots: Column) -> tuple:
    top = float(MAX_SCORES["meta_tags"])
    score = F.when(F.col("all_bots"), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(top) - F.size("named") * (F.lit(top) / F.greatest(F.lit(1), n_bots)))
    )
    return "meta_tags", score, score == top, F.array_join("named", ", ")


def check_meta_tags(captures: DataFrame, bots: DataFrame) -> DataFrame:
    """A blocking ``robots`` tag costs all points, each blocking bot tag its part."""
    all_bots, named = blocking_tags(F.col("html"))
    tagged = _desktop(captures).select(*PAGE, all_bots.alias("all_bots"), named.alias("named"))
    return _result(with_bot_tags(tagged, bots), PAGE, *meta_result(F.col("n_bots")))


def _similar(a: Column, b: Column, tolerance: float) -> Column:
    mean = (a + b) / F.lit(2.0)
    return F.when(mean == 0, a == b).otherwise(F.abs(a - b) <= mean * tolerance)


def mobile_result() -> tuple:
    size, status = F.col("mobile_size"), F.col("mobile_status")
    present = F.coalesce(size > 0, F.lit(False)) & status.isNotNull()
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    share = (
        flag(status == 200, 0.3) + flag(size >= MIN_PAGE_SIZE, 0.3) + flag(F.col("mobile_viewport"), 0.2)
        + flag(_similar(F.col("desktop_size"), size, MOBILE_TOLERANCE), 0.2)
    )
    lacking = F.coalesce(F.col("desktop_size"), F.lit(0)) == 0
    share = F.when(present & ~lacking, share).otherwise(F.lit(0.0))
    return ("mobile", share * MAX_SCORES["mobile"], share >= 0.8 - 1e-9,
            F.when(~present, F.lit("Mobile version not accessible")), lacking)


def check_mobile(captures: DataFrame) -> DataFrame:
    """Mobile answers with 200, has content and a viewport tag, and is about as large as desktop."""
    # Both variants of a page meet as two small summaries; the HTML itself is not shuffled.
    of = lambda v, c: F.max(F.when(F.col("variant") == v, c))
    sized = captures.select(
        *PAGE, "variant", "status", F.length("html").alias("size"), F.col("html").rlike(VIEWPORT).alias("viewport"),
    )
    both = sized.groupBy(*PAGE).agg(
        of("desktop", F.col("size")).alias("desktop_size"), of("mobile", F.col("size")).alias("mobile_size"),
        of("mobile", F.col("status")).alias("mobile_status"), of("mobile", F.col("viewport")).alias("mobile_viewport"),
    )
    return _result(both, PAGE, *mobile_result())


def blocking_headers() -> Column:
    """array<string>: directives of X-Robots-Tag headers that block; empty if headers are unknown."""
    values = F.flatten(F.filter(
        F.transform(F.map_entries("headers"), lambda e: F.when(F.lower(e["key"]) == "x-robots-tag", e["value"])),
        lambda v: v.isNotNull(),
    ))
    directives = F.flatten(F.transform(values, lambda v: F.transform(F.split(v, ","), lambda d: F.trim(d))))
    return F.coalesce(F.filter(directives, lambda d: d.rlike(BLOCKING)), F.array().cast("array<string>"))


def headers_result() -> tuple:
    open_ = F.size("blocking") == 0
    return ("headers", F.when(open_, MAX_SCORES["headers"]).otherwise(0), open_, F.array_join("blocking", ", "))


def check_headers(captures: DataFrame) -> DataFrame:
    """No blocking X-Robots-Tag directive; unknown headers count as open."""
    found = _desktop(captures).select(*PAGE, blocking_headers().alias("blocking"))
    return _result(found, PAGE, *headers_result())


def _speed_step(ms: Column) -> Column:
    """5 (fast) to 1 (slow); null without a time."""
    first = F.when(ms < SPEED_STEPS[0][0], SPEED_STEPS[0][1])
    return F.when(ms > 0, reduce(lambda c, s: c.when(ms < s[0], s[1]), SPEED_STEPS[1:], first).otherwise(1))


def speed_result(steps: Column) -> tuple:
    score = F.coalesce(steps, F.lit(0)) / F.lit(10.0) * MAX_SCORES["speed"]
    return "speed", score, score >= 6, None, steps.isNull()


def check_speed(captures: DataFrame) -> DataFrame:
    """Response time of desktop and mobile, half of the points each."""
    per_page = captures.filter(F.col("variant").isin("desktop", "mobile")).groupBy(*PAGE, "variant").agg(
        F.max(_speed_step(F.col("ms"))).alias("step")
    ).groupBy(*PAGE).agg(F.sum("step").alias("steps"))
    return _result(per_page, PAGE, *speed_result(F.col("steps")))


def robots_rules(robots: Column, strict: bool = False) -> Column:
    """array<struct(agent, blocked)>: rules about the whole site in file order.

    The latest ``User-agent`` line applies.  An empty ``Disallow`` blocks unless ``strict``.
    """
    lines = F.filter(
        F.transform(F.split(robots, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")),
        lambda s: (s != "") & ~F.startswith(s, F.lit("#")),
    )
    value = lambda s: F.trim(F.regexp_replace(s, r"^[^:]*:", ""))
    low = lambda s: F.lower(s)
    root = lambda s: (value(s) == "/") | (value(s) == "")
    blocks = (lambda s: value(s) == "/") if strict else root
    empty = F.expr("cast(array() as array<struct<agent:string,blocked:boolean>>)")
    start = F.struct(F.lit("*").alias("agent"), empty.alias("rules"))

    def step(acc, s):
        agent = F.when(low(s).startswith("user-agent:"), F.lower(value(s))).otherwise(acc["agent"])
        add = lambda flag: F.array_append(acc["rules"], F.struct(acc["agent"].alias("agent"), F.lit(flag).alias("blocked")))
        rules = (
            F.when(low(s).startswith("disallow:") & blocks(s), add(True))
            .when(low(s).startswith("allow:") & root(s), add(False))
            .otherwise(acc["rules"])
        )
        return F.struct(agent.alias("agent"), rules.alias("rules"))

    return F.aggregate(lines, start, step, lambda acc: acc["rules"])


def robots_blocked(robots: DataFrame, bots: DataFrame, strict: bool = False) -> DataFrame:
    """(site, bot, blocked): the last root rule for the bot or for ``*`` decides.  ``robots`` has one file a site.

    The agents of a file meet the bots by equality; a bot that no rule names goes by the last rule for ``*``.
    """
    bots = bots.select("bot").filter("bot is not null").distinct()
    rules = robots.select("site", F.posexplode(robots_rules(F.col("robots"), strict)).alias("pos", "rule")).select(
        "site", "pos", F.col("rule.agent").alias("agent"), F.col("rule.blocked").alias("blocked")
    )
    last = F.max(F.struct("pos", "blocked"))
    general = rules.filter(F.col("agent") == "*").groupBy("site").agg(last.alias("general"))
    named = rules.join(bots.withColumn("agent", F.lower("bot")), "agent").groupBy("site", "bot").agg(last.alias("own"))
    each = with_each(robots.select("site"), bots).join(general, "site", "left").join(named, ["site", "bot"], "left")
    return each.select(
        "site", "bot", F.coalesce(F.greatest("general", "own")["blocked"], F.lit(False)).alias("blocked")
    )


def _closed(blocked: DataFrame, bot_products: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(products with the number of their bots, keys and products with the number of bots kept out)."""
    listed = bot_products.select("product", "bot").distinct()
    products = listed.groupBy("product").agg(F.count("bot").alias("bots"))
    closed = blocked.filter("blocked").select(*keys, "bot").distinct().join(listed, "bot")
    return products, closed.groupBy(*keys, "product").agg(F.count(F.lit(1)).alias("closed"))


def product_visibility(blocked: DataFrame, bot_products: DataFrame, keys: list[str] = ["site"]) -> DataFrame:
    """(keys, product, visible): visible if any bot of the product is not blocked.

    Bots of a product that ``blocked`` does not mention count as open.
    """
    products, closed = _closed(blocked, bot_products, keys)
    each = with_each(blocked.select(*keys).distinct(), products).join(closed, [*keys, "product"], "left")
    return each.select(*keys, "product", (F.coalesce("closed", F.lit(0)) < F.col("bots")).alias("visible"))


def _visible_share(blocked: DataFrame, bot_products: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seen, products) from the products kept out alone, which are few; nothing where there is no product."""
    products, closed = _closed(blocked, bot_products, keys)
    hidden = closed.join(products, "product").filter("closed = bots").groupBy(*keys).agg(F.count(F.lit(1)).alias("hidden"))
    total = products.agg(F.struct(F.count(F.lit(1)).alias("all"), F.count_if(F.col("bots") > 0).alias("some")).alias("t")).scalar()
    return blocked.select(*keys).distinct().join(hidden, keys, "left").withColumn("total", total).select(
        *keys, (F.col("total.some") - F.coalesce("hidden", F.lit(0))).alias("seen"), F.col("total.all").alias("products")
    ).filter("products > 0")


def check_robots(robots: DataFrame, bots: DataFrame, bot_products: DataFrame) -> DataFrame:
    """Products that may read the site; no file means all may, another status is an error."""
    shares = _visible_share(robots_blocked(robots.filter(F.col("status") == 200), bots), bot_products, ["site"])
    joined = robots.select("site", "status").join(shares, "site", "left")
    top = MAX_SCORES["robots"]
    score = (
        F.when(F.col("status") == 404, top)
        .when(F.col("status") == 200, F.floor(F.col("seen") / F.col("products") * top + 0.5))
        .otherwise(-1)
    )
    return _result(joined, ["site"], "robots", score, score >= 7,
                   F.concat_ws("/", F.col("seen").cast("string"), F.col("products").cast("string")),
                   ~F.col("status").isin(200, 404))


def check_sitemap(sitemaps: DataFrame) -> DataFrame:
    """``sitemaps``: site, sitemap (null if missing)."""
    xml = F.col("sitemap")
    top = MAX_SCORES["sitemap"]
    valid = F.ltrim(xml).startswith("<") & xml.rlike(r"(?i)<urlset|<sitemapindex")
    entries = F.regexp_count(xml, F.lit(r"(?i)<loc[^>]*>(.*?)</loc>"))
    half_up = lambda x: int(x + 0.5)
    score = (
        F.when(xml.isNull() | (F.trim(xml) == ""), 0).when(~valid, half_up(top * 0.3))
        .when(entries == 0, half_up(top * 0.5)).otherwise(top)
    )
    kind = F.when(xml.rlike("(?i)<sitemapindex"), "sitemap index").otherwise("sitemap")
    return _result(sitemaps, ["site"], "sitemap", score, score == top,
                   F.concat(kind, F.lit(" with "), entries.cast("string"), F.lit(" entries")))


def check_llms_txt(files: DataFrame) -> DataFrame:
    """``files``: site, status, content of the captured site guide."""
    size = F.length(F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", ""))
    found = (F.col("status") == 200) & (size > 0)
    return _result(files, ["site"], "llms_txt", F.when(found, MAX_SCORES["llms_txt"]).otherwise(0), found,
                   F.concat(size.cast("string"), F.lit(" chars")), ~F.col("status").isin(200, 404))


def bot_access(captures: DataFrame, bot_captures: DataFrame) -> DataFrame:
    """(site, url, bot, blocked) from captures made as each bot against the desktop capture."""
    baseline = _desktop(captures).select(*PAGE, F.length("html").alias("base"))
    sized = bot_captures.select(*PAGE, "bot", "status", F.length("html").alias("size"))
    size, base = F.col("size"), F.coalesce("base", F.lit(0))
    ok = (F.col("status") == 200) & (size >= MIN_PAGE_SIZE) & ((base == 0) | _similar(base, size, BOT_TOLERANCE))
    return sized.join(baseline, PAGE, "left").select(*PAGE, "bot", (~F.coalesce(ok, F.lit(False))).alias("blocked"))


def check_bot_access(captures: DataFrame, bot_captures: DataFrame, bots: DataFrame,
                     bot_products: DataFrame, check: str) -> DataFrame:
    """One check per kind of bot; products keep their untested bots as open."""
    return check_all_bots(captures, bot_captures, bots.filter(F.col("tag") == BOT_TAGS[check]), bot_products)


def check_all_bots(captures: DataFrame, bot_captures: DataFrame, bots: DataFrame, bot_products: DataFrame) -> DataFrame:
    """The checks of all kinds of bots; the captures are measured once and rated per kind."""
    kinds = F.create_map(*[F.lit(x) for check, tag in BOT_TAGS.items() for x in (tag, check)])
    tested = bots.select("bot", kinds[F.col("tag")].alias("check")).filter("check is not null").distinct()
    access = bot_access(captures, bot_captures.join(tested.select("bot").distinct(), "bot", "left_semi"))
    shares = _visible_share(access.join(tested, "bot"), bot_products, [*PAGE, "check"])
    top = F.create_map(*[F.lit(x) for check in BOT_TAGS for x in (check, float(MAX_SCORES[check]))])[F.col("check")]
    score = F.floor(F.col("seen") / F.col("products") * top + 0.5).cast("double")
    return shares.select(
        *PAGE, "check", score.alias("score"), top.alias("max_score"), (score >= F.floor(top * 0.7 + 0.5)).alias("passed"),
        F.lit(False).alias("error"),
        F.concat_ws("/", F.col("seen").cast("string"), F.col("products").cast("string")).alias("details"),
    )


def check_crawl_presence(sites: DataFrame, crawl_index: DataFrame, newest: int = 3) -> DataFrame:
    """Site domain present in one of the newest crawl indexes (``crawl_id``, ``domain``)."""
    ids = crawl_index.select("crawl_id").distinct().orderBy(F.desc("crawl_id")).limit(newest)
    domains = crawl_index.join(ids, "crawl_id", "left_semi").select("domain").distinct()
    found = sites.select("site", U.hostname(F.col("site")).alias("domain")).distinct().join(
        domains.withColumn("found", F.lit(True)), "domain", "left"
    )
    present = F.coalesce("found", F.lit(False))
    return _result(found, ["site"], "crawl_presence", F.when(present, MAX_SCORES["crawl_presence"]).otherwise(0), present)


def invalid_reason(html: Column, content_type: Column | None = None, robots_tag: Column | None = None) -> Column:
    """Why a response is no real page; null if it is one."""
    reason = F.when(F.length(html) < MIN_PAGE_SIZE, "too small")
    if content_type is not None:
        reason = reason.when((content_type != "") & ~content_type.contains("text/html"), "content type")
    if robots_tag is not None:
        reason = reason.when(robots_tag.rlike("(?i)noindex"), "noindex header")
    for text in ERROR_TEXTS:
        reason = reason.when(html.rlike("(?i)" + text), "error page: " + text)
    return reason


def valid_pages(captures: DataFrame) -> DataFrame:
    """Captures with ``reason`` (null = valid); needs content_type and robots_tag columns."""
    return captures.withColumn(
        "reason", invalid_reason(F.col("html"), F.col("content_type"), F.col("robots_tag"))
    )


def check_search_presence(result_pages: DataFrame, markers: DataFrame) -> DataFrame:
    """Stored result pages (site, engine, status, html): found if any engine lists the site.

    ``markers`` (engine, pattern) are configuration.  Informational: not part of ``audit_score``
    unless its rows are added.
    """
    patterns = markers.groupBy("engine").agg(F.array_join(F.sort_array(F.collect_set(
        F.concat(F.lit("(?:"), "pattern", F.lit(")"))
    )), "|").alias("listed"))
    html = F.col("html")
    marked = F.coalesce(F.regexp_like(html, F.col("listed")), F.lit(False))
    ok = (
        (F.col("status") == 200) & invalid_reason(html).isNull()
        & ~html.rlike("(?i)" + "|".join(NO_RESULTS)) & marked
    )
    found = result_pages.join(patterns, "engine", "left").select("site", "engine", F.coalesce(ok, F.lit(False)).alias("ok"))
    return _result(found, ["site", "engine"], "search_presence",
                   F.when(F.col("ok"), MAX_SCORES["search_presence"]).otherwise(0), F.col("ok"))


def page_checks(captures: DataFrame, bots: DataFrame) -> DataFrame:
    """All checks of single pages in one scan: the HTML is measured where it is read, and only
    the measured values of a page's two variants are shuffled together."""
    html = F.col("html")
    desktop = F.col("variant") == "desktop"
    all_bots, named = blocking_tags(html)
    measures = {
        "structure": structure_score(html), "types": jsonld_types(html), "all_bots": all_bots, "named": named,
        "blocking": blocking_headers(), "scripts": script_measures(html),
    }
    measured = captures.filter(F.col("variant").isin("desktop", "mobile")).select(
        *PAGE, "variant", "status", "ms", F.length(html).alias("size"),
        html.rlike(VIEWPORT).alias("viewport"),
        *[F.when(desktop, c).alias(n) for n, c in measures.items()],
    )
    page = measured.groupBy(*PAGE).agg(
        *[F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{c}")
          for v in ("desktop", "mobile") for c in ("status", "ms", "size", "viewport")],
        F.first(F.when(desktop, F.struct(*measures)), ignorenulls=True).alias("m"),
    ).select("*", "m.*").select("*", "scripts.*")
    page = with_bot_tags(page, bots)
    known = [_speed_step(F.col(f"{v}_ms")) for v in ("desktop", "mobile")]
    results = [
        _as_row(*structure_result(F.col("structure"))),
        _as_row(*ssr_result()), _as_row(*jsonld_result()), _as_row(*meta_result(F.col("n_bots"))),
        _as_row(*mobile_result()), _as_row(*headers_result()),
        _as_row(*speed_result(F.when(known[0].isNotNull() | known[1].isNotNull(),
                                     F.coalesce(known[0], F.lit(0)) + F.coalesce(known[1], F.lit(0))))),
    ]
    listed = page.filter(F.col("m").isNotNull()).select(*PAGE, F.explode(F.array(*results)).alias("r"))
    return listed.select(*PAGE, "r.*")


def _as_row(check: str, score: Column, passed: Column, details: Column | None = None, error: Column | None = None) -> Column:
    return F.struct(*_result_columns(check, score, passed, details, error))


def audit_score(results: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Points, percentage and grade over all checks without error."""
    ok = ~F.col("error")
    sums = results.groupBy(*keys).agg(
        F.sum(F.when(ok, F.col("score")).otherwise(0.0)).alias("total"),
        F.sum(F.when(ok, F.col("max_score")).otherwise(0.0)).alias("max_total"),
        F.count_if("passed").alias("passed_checks"), F.count_if("error").alias("errors"),
    )
    percent = F.when(F.col("max_total") > 0, F.floor(F.round(F.col("total") / F.col("max_total") * 100, 6) + 0.5)).otherwise(0)
    grade = reduce(lambda c, g: c.when(F.col("percentage") >= g[0], g[1]), GRADES[1:],
                   F.when(F.col("percentage") >= GRADES[0][0], GRADES[0][1])).otherwise("F")
    return sums.select(
        *keys, SC.rounded(F.col("total"), 1).alias("score"), F.col("max_total").alias("max_score"),
        "passed_checks", "errors", percent.cast("long").alias("percentage"),
    ).withColumn("grade", grade)
