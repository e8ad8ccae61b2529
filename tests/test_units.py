"""Hand-made cases per operator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from answerlens.functions import scores as SC
from answerlens.functions import text as TX
from answerlens.functions import urls as U
from answerlens.operators import audit as A
from answerlens.operators import entities as E
from answerlens.operators import links as L
from answerlens.operators import matching as MA
from answerlens.operators import mentions as M
from answerlens.operators import scale
from answerlens.operators import trends as T

D = dt.date(2024, 1, 1)
ANSWER = "project string, question_id string, date date, model_id string, answer_id long, text string"
ENTITY = "project string, question_id string, section string, entity string, ord long"
HIT = "project string, question_id string, date date, section string, entity string, ord long, model_id string, mentions long, pos long"


def counts(spark, texts, terms, section="products", **kw):
    answers = spark.createDataFrame([("p", "q", D, f"m{i}", i, t) for i, t in enumerate(texts)], ANSWER)
    entities = spark.createDataFrame([("p", "q", section, t, i) for i, t in enumerate(terms)], ENTITY)
    return {(r.answer_id, r.term): (r.mentions, r.pos) for r in MA.match_entities(answers, entities, **kw).collect()}


@pytest.mark.parametrize("text,term,expected", [
    ("I like C++ and c.", "c++", (2, 8)),
    ("AT&T and at&amp;t", "at&t", (1, 1)),
    ("open source, open-source", "open-source", (2, 1)),
    ("a start of art", "art", (2, 5)),
    ("Café and caf%C3%A9", "café", (2, 1)),
    ("日本 and %E6%97%A5%E6%9C%AC", "日本", (2, 1)),
    ("x --- y", "---", None),
    ("see [Acme](https://x.org/acme) by Acme", "acme", (2, 6)),
    ("Anna's and Anna", "anna", (2, 1)),
])
def test_term_pattern(spark, text, term, expected):
    got = counts(spark, [text], [term]).get((0, term))
    if expected is not None:
        assert got == expected
    else:
        assert got is not None


def test_whole_word(spark):
    assert counts(spark, ["a start of art"], ["art"], whole_word=True)[(0, "art")] == (1, 12)


@pytest.mark.parametrize("text,n", [
    ("https://www.acme.com/a", 1), ("blog.acme.com", 1), ("acme.com.au", 1), ("acme.com?x=1 and acme.com", 2),
    ("nothing here", None), ("[x](https://acme.com/)", 1),
])
def test_domains(spark, text, n):
    got = counts(spark, [text], ["acme.com"]).get((0, "acme.com"))
    assert (got and got[0]) == n


def test_common_run_is_not_the_anchor(spark):
    texts = [f"host{i}.example.com" for i in range(20)]
    got = counts(spark, texts, texts)
    assert len(got) == 20 and all(v[0] == 1 for v in got.values())


def test_excerpt_line_and_column(spark):
    answers = spark.createDataFrame([("p", "q", D, "m", 1, "one\ntwo acme\nacme")], ANSWER)
    entities = spark.createDataFrame([("p", "q", "products", "Acme", 1)], ENTITY)
    rows = [(r.pos, r.line, r.col) for r in MA.excerpts(answers, entities).orderBy("hit_no").collect()]
    assert rows == [(9, 2, 5), (14, 3, 1)]


def test_rank_ties_and_unknown_positions(spark):
    rows = [("p", "q", D, "s", e, o, "m", n, p) for e, o, n, p in
            [("b", 1, 1, 5), ("a", 2, 1, 5), ("c", 3, 2, 1), ("d", 4, 1, -1), ("e", 5, 0, -1)]]
    got = {r.entity: r["rank"] for r in M.appearance_rank(spark.createDataFrame(rows, HIT)).collect()}
    assert got == {"c": 1, "b": 2, "a": 3, "d": 999, "e": -1}


def test_share_of_voice_examples(spark):
    assert spark.range(1).select(SC.prominence(F.lit(1), F.lit(1)), F.round(SC.prominence(F.lit(1), F.lit(2)), 2)).first()[:] == (1.0, 0.63)
    prom = spark.createDataFrame(
        [("p", "q", D, "s", "x", "m1", 1, .6, 1.0), ("p", "q", D, "s", "top", "m2", 10, .4, 10.0)],
        "project string, question_id string, date date, section string, entity string, model_id string, mentions long, weight double, prominence double",
    )
    got = {r.entity: r.share_of_voice for r in M.share_of_voice(prom).collect()}
    assert got == {"x": 0.06, "top": 0.4}


def test_weights_default_and_cap(spark):
    models = spark.createDataFrame([("p", "a", 2_000_000_000), ("p", "b", 0), ("p", "c", None)], "project string, model_id string, estimated_mau long")
    got = {r.model_id: r.weight for r in M.model_weights(models).collect()}
    assert got == {"a": .5, "b": .25, "c": .25}


def test_ranked_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    for n in (1, 7):
        out = scale.ranked(df.repartition(n), ["k"], ["v"], F.floor(F.col("v") / 100), "r")
        assert out.filter(F.col("r") != F.col("v") + 1).count() == 0


@pytest.mark.parametrize("url,expected", [
    ("https://example.com/page/", "example.com/page"), ("http://www.example.com/page", "example.com/page"),
    ("https://example.com/a).", "example.com/a"), ("https://example.com/%zz", "https://example.com/%zz"),
    ("https://example.com/?utm_source=x&ref=y", "example.com"), ("https://example.com/?a=1+2&utm_id=3", "example.com/?a=1+2"),
    ("#top", "#top"),
])
def test_clean_url(spark, url, expected):
    assert spark.range(1).select(U.clean_url(F.lit(url))).first()[0] == expected


@pytest.mark.parametrize("link,ok", [
    ("example.com", True), ("sub.example.org/x", True), ("my-site.co.uk", True), ("to", False), ("min", False),
    ("https://word", False), ("ftp://a.bc", True),
])
def test_valid_link(spark, link, ok):
    assert spark.range(1).select(U.is_valid_link(F.lit(link))).first()[0] is ok


def test_links_in_text(spark):
    text = "[a](https://x.org/1)[b](http://www.y.com) [t](#top) (https://z.net/p). node.js x.org w.io https://i.org/a.png"
    got = spark.range(1).select(L.links_in(F.lit(text))).first()[0]
    assert got == ["x.org/1", "y.com", "z.net/p", "w.io"]


def test_trend_codes(spark):
    cases = [(1, None, 999), (0, None, -9999), (1, 0, 999), (0, 2, -99), (3, 2, 10), (1, 2, -1), (2, 2, 1)]
    df = spark.createDataFrame(cases, "c int, p int, e int")
    assert df.filter(SC.trend_code(F.col("c"), F.col("p")) != F.col("e")).count() == 0


def test_trend_skips_snapshot_without_entity(spark):
    rows = [("p", "q", dt.date(2024, m, 1), "s", e, n, 1.0, 1, 1) for m, e, n in
            [(1, "a", 4), (1, "b", 1), (2, "b", 1), (3, "A", 5), (3, "b", 1), (7, "b", 1)]]
    df = spark.createDataFrame(rows, "project string, question_id string, date date, section string, entity string, mentions long, influence double, rank long, model_count long")
    got = {(r.entity, r.date.month): r for r in T.entity_trends(df).collect()}
    assert got[("A", 3)].previous_mentions == 4 and got[("A", 3)].first_seen == dt.date(2024, 1, 1)
    assert got[("A", 3)].change_percent == 25.0 and got[("A", 3)].volatility == 0.5
    assert got[("b", 7)].mentions_trend == 1 and len(got[("b", 7)].mentions_series) == 4


def test_robots_quirks(spark):
    cases = {
        "a": "Disallow:", "b": "User-agent: *\nDisallow: /\nAllow: /", "c": "User-agent: GPTBot\nUser-agent: Other\nDisallow: /",
        "d": "# Disallow: /\nUser-agent: gptbot\nDisallow: /", "e": "",
    }
    robots = spark.createDataFrame(list(cases.items()), "site string, robots string")
    bots = spark.createDataFrame([("GPTBot",)], "bot string")
    got = {r.site: r.blocked for r in A.robots_blocked(robots, bots).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": False}
    strict = {r.site: r.blocked for r in A.robots_blocked(robots, bots, strict=True).collect()}
    assert strict["a"] is False


def test_configuration_meets_rows_without_an_array(spark):
    """Several lists of bots; a bot's own rule after the general one decides, an earlier one does not."""
    bots = spark.range(300).selectExpr("concat('Bot', id) as bot")
    robots = spark.createDataFrame([
        ("late", "User-agent: *\nDisallow: /\nUser-agent: BOT7\nAllow: /"), ("early", "User-agent: bot7\nAllow: /\nUser-agent: *\nDisallow: /"),
        ("none", "User-agent: bot7\nDisallow: /"), ("empty", None),
    ], "site string, robots string")
    blocked = A.robots_blocked(robots, bots)
    got = {(r.site, r.bot): r.blocked for r in blocked.collect()}
    assert len(got) == blocked.count() == 1200
    assert {s: got[(s, "Bot7")] for s in ("late", "early", "none", "empty")} == {"late": False, "early": True, "none": True, "empty": False}
    assert {s: got[(s, "Bot8")] for s in ("late", "early", "none", "empty")} == {"late": True, "early": True, "none": False, "empty": False}
    products = spark.createDataFrame([("Bot7", "one"), ("Bot7", "two"), ("Bot8", "two"), ("other", "open")], "bot string, product string")
    seen = {(r.site, r.product): r.visible for r in A.product_visibility(blocked, products).collect()}
    assert len(seen) == 12 and [k for k, v in sorted(seen.items()) if not v] == [("early", "one"), ("early", "two"), ("none", "one")]
    shares = {r.site: (r.seen, r.products) for r in A._visible_share(blocked, products, ["site"]).collect()}
    assert shares == {"late": (3, 3), "early": (1, 3), "none": (2, 3), "empty": (3, 3)}
    assert A._visible_share(blocked, products.limit(0), ["site"]).count() == 0


def test_tags_of_unknown_bots_do_not_count(spark):
    tag = '<meta name="{}" content="noai">'
    pages = [("s", "a", "desktop", tag.format("gptbot") + tag.format("Other") + tag.format("GPTBOT")), ("s", "b", "desktop", tag.format("robots")), ("s", "c", "desktop", None)]
    captures = spark.createDataFrame(pages, "site string, url string, variant string, html string")
    bots = spark.createDataFrame([("GPTBot",), ("CCBot",)], "bot string")
    got = {r.url: (r.score, r.details) for r in A.check_meta_tags(captures, bots).collect()}
    assert got == {"a": (4.0, "gptbot"), "b": (0.0, ""), "c": (8.0, "")}


def test_grades_and_errors(spark):
    rows = [(f"s{p}", "u", "x", float(p), 100.0, True, False, None) for p in (100, 97, 96, 90, 83, 70, 60, 59)]
    rows.append(("s100", "u", "y", 0.0, 50.0, False, True, None))
    df = spark.createDataFrame(rows, "site string, url string, check string, score double, max_score double, passed boolean, error boolean, details string")
    got = {r.site: r.grade for r in A.audit_score(df).collect()}
    assert got == {"s100": "A+", "s97": "A+", "s96": "A", "s90": "A-", "s83": "B", "s70": "C-", "s60": "D-", "s59": "F"}


def test_carry_forward_adds_no_present_key(spark):
    cur = spark.createDataFrame([("p", "q", dt.date(2024, 3, 1), "s", " Acme", "x")], "project string, question_id string, date date, section string, entity string, type string")
    old = spark.createDataFrame([("p", "q", dt.date(2024, 2, 1), "s", e, "x") for e in ("ACME", "Beta")], cur.schema)
    dates = cur.select("project", "date").union(old.select("project", "date"))
    assert [r.entity for r in E.carry_forward(cur, old, dates).collect()] == ["Beta"]


def test_sentence_guards(spark):
    text = "Dr. Smith met Mr. Jones in the U.S. Then he left. ok go! Yes\n- item one\n2. item two"
    got = spark.range(1).select(TX.split_sentences(F.lit(text))).first()[0]
    assert got == ["Dr. Smith met Mr. Jones in the US Then he left. ok go!", "Yes", "- item one", "2. item two"]
