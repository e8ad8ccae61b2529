"""Building blocks under uneven data, and plans that must not move texts."""

import datetime
import re
import time

import pytest
from pyspark.sql import functions as F

from answerlens.catalog.registry import Inputs
from answerlens.functions import text as TX
from answerlens.operators import links as L
from answerlens.operators import matching as MA
from answerlens.operators import mentions as M
from answerlens.operators import reports as R
from answerlens.operators import scale
from answerlens.plans.build import measure

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("value", ["rand(3)", "case when id % 3 = 0 then 0.0 else rand(3) * 1e-6 end", "0.5"])
def test_even_buckets(spark, value):
    """Shares within 0..1, piled up near zero or all equal, and ids with one long common prefix."""
    rows = spark.range(20_000).selectExpr("'g' as g", f"{value} as v", "concat('file:/a/b/', lpad(id, 9, '0')) as name")
    place = F.struct("v", "name")
    ranked = scale.ranked_evenly(rows, ["g"], place, "rank").toPandas().sort_values(["v", "name"])
    assert (ranked["rank"].to_numpy() == range(1, 20_001)).all()
    seen = []
    inner = scale.ranked

    def spy(df, keys, order, bucket, out):
        seen.append(df.groupBy(*keys, bucket).count().agg(F.max("count")).first()[0])
        return inner(df, keys, order, bucket, out)

    scale.ranked = spy
    try:
        scale.ranked_evenly(rows, ["g"], place, "rank").count()
    finally:
        scale.ranked = inner
    assert seen[0] < 4 * 20_000 / scale.BUCKETS


def test_many_hits_are_quick_and_right(spark):
    text = "ab c " * 32_000
    df = spark.createDataFrame([(text,)], "t string").select(TX.hits(F.col("t"), F.lit("c")).alias("h"))
    df.select(F.size("h")).first()
    start = time.perf_counter()
    hits = df.first().h
    assert time.perf_counter() - start < 4
    assert [(h.pos, h.len) for h in hits] == [(4 + 5 * k, 1) for k in range(32_000)]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 100, 1000])
def test_hit_offsets(spark, n):
    text = "".join(f"{'y' * (k % 7)}xx" for k in range(n)) + "end"
    want, at = [], 1
    for k in range(n):
        want.append((at + k % 7, 2))
        at += k % 7 + 2
    got = spark.createDataFrame([(text,)], "t string").select(TX.hits(F.col("t"), F.lit("xx")).alias("h")).first().h
    assert [(h.pos, h.len) for h in got] == want


def test_link_types_with_many_patterns(spark):
    rows = [(f"c{k}", f"N{k}", k, "contains" if k % 2 else "endswith", f"host{k}.exa" if k % 2 else f"host{k}.org") for k in range(1900)]
    rows += [("rx", "R", 5000, "regex", r"^m\d+\."), ("path", "P", 1, "contains", "/FR/8"), ("early", "E", -1, "endswith", "7.org")]
    patterns = spark.createDataFrame(rows, "code string, name string, ord long, kind string, pattern string")
    links = [f"https://host{k}.{'example.com' if k % 2 else 'org'}/x" for k in range(0, 1900, 19)] + ["m5.net/fr/8", "m6.net", "none.net"]
    df = spark.createDataFrame([("p", "q", u, "oth") for u in links], "project string, question_id string, link string, link_type string")
    got = {r.link: r.link_type for r in L.classify_links(df, patterns).collect()}
    for u in links:
        best = []
        name = u.removeprefix("https://").split("/")[0]
        for code, _, order, kind, pattern in rows:
            hit = (pattern.lower() in u.lower() if kind == "contains" and "/" in pattern else pattern in name if kind == "contains"
                   else name.endswith(pattern) if kind == "endswith" else bool(re.search(pattern, name)))
            if hit:
                best.append((order, code))
        assert got[u] == (min(best)[1] if best else "oth"), u


@pytest.mark.parametrize("apply", [MA.match_entities, MA.excerpts])
def test_texts_are_not_moved(spark, apply):
    i = Inputs(spark, SF)
    plan = apply(i.answers, i.entities)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "text" not in line


def hit_rows(df):
    return {(r.answer_id, r.term): (r.mentions, r.pos) for r in df.collect()}


def answers_of(spark, texts):
    rows = [("p", "q", datetime.date(2024, 1, 1), "m", k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "project string, question_id string, date date, model_id string, answer_id long, text string")


def names_of(spark, names):
    rows = [("p", "q", "names", n, k) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "project string, question_id string, section string, entity string, ord long")


def test_domains_in_all_places(spark):
    """Domains as URL, as plain text, inside longer hosts, cut off by odd characters, and as longer or shorter paths."""
    texts = [
        "See https://www.example.org/a?x=1, _example.org and my-example.org-x.", "[page](http://Example.org/a/b) xhttps://sub.example.org2 é.example.org",
        "example.orgs example.org/ a.b.c.d.e.example.org.uk 1.2.3", "foo@example.org://example.org|example.org", "x.net ,.net. .é.é", "nothing here", "a.b.c.d.e.org/x",
        "www.example.org/a/b/c and EXAMPLE.ORG/a", None, "",
    ]
    names = ["example.org", "example.org/a/b", "www.example.org", "sub.example.org", ".net", "a.b.c.d.e.org", "example.org.uk", "é.é", "b.c.d", "absent.example.org", "org2.x"]
    answers, entities = answers_of(spark, texts), names_of(spark, names)
    got = hit_rows(MA.match_entities(answers, entities))
    pairs = answers.join(MA.search_terms(entities, ["project", "question_id"]), ["project", "question_id"]).filter("text is not null")
    slow = pairs.withColumn("h", MA.domain_hits(F.lower("text"), F.col("term"), F.col("pattern"))).filter("size(h) > 0")
    want = {(r.answer_id, r.term): (len(r.h), r.h[0].pos) for r in slow.collect()}
    assert got == want and len(want) > 15


def test_names_meet_texts_without_common_letters(spark):
    """Names without a gram, of other scripts, or whose gram stands in another run, beside a thousand absent ones."""
    texts = ["C++ and é-learning, Ab-Cd's, 中文 go", "abcd's ABCDE ab cd", "The other; ab.cd", "", None]
    names = ["C++", "é", "ab cd", "中文", "go", "abcd", "the other", "?!", *[f"absent{k}name" for k in range(1000)]]
    answers, entities = answers_of(spark, texts), names_of(spark, names)
    pairs = answers.join(MA.search_terms(entities, ["project", "question_id"]), ["project", "question_id"]).filter("text is not null")
    slow = pairs.withColumn("h", MA.name_hits(TX.mask_link_urls(F.lower("text")), F.col("term"), F.col("pattern"))).filter("size(h) > 0")
    want = {(r.answer_id, r.term): (len(r.h), r.h[0].pos) for r in slow.collect()}
    assert hit_rows(MA.match_entities(answers, entities)) == want and len(want) > 8
    terms = MA.search_terms(entities, ["project", "question_id"])
    looked = MA.candidate_pairs(answers.filter("text <> ''"), terms, ["project", "question_id"]).collect()
    assert max(len(r.terms) for r in looked) < 12


@pytest.mark.parametrize("k", [1, 5])
def test_first_hits_are_the_first_of_all(spark, k):
    rows = [("xx", "x"), ("abab", "ab"), ("", "a"), ("aéa a", "a"), ("nothing", "z"), ("a.b a.b a.ba.b", r"(?<![a-z0-9_])a\.b(?![a-z0-9_])"), ("ab " * 9, r"ab(?= )")]
    df = spark.createDataFrame(rows, "t string, p string")
    got = df.select(TX.first_hits(F.col("t"), F.col("p"), k).alias("a"), F.slice(TX.hits(F.col("t"), F.col("p")), 1, k).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    text = "The's a-a-a's "
    names = df.limit(1).select(*[c for n in ("the", "a-a", "a-a-a", "'s a") for c in (
        MA.first_name_hits(F.lower(F.lit(text * 30)), F.lit(n), TX.term_pattern(F.lit(n)), k).alias("a" + n),
        F.slice(MA.name_hits(F.lower(F.lit(text * 30)), F.lit(n), TX.term_pattern(F.lit(n))), 1, k).alias("b" + n),
    )]).first()
    assert all(names[2 * i] == names[2 * i + 1] for i in range(4))


def test_excerpt_lists_are_bounded_parts(spark):
    """150 answers hold one name: lists of 64 answers follow each other; parts of any size hold the same rows in order."""
    answers = answers_of(spark, [f"Acme {k} acme, " + "acme " * (k % 9) for k in range(150)] + ["none", None])
    entities = names_of(spark, ["Acme", "absent"])
    found = MA.excerpts(answers, entities)
    want = [tuple(r) for r in found.orderBy("answer_id", "hit_no").select("answer_id", "hit_no", "excerpt").collect()]
    facts = M.mention_facts(
        M.mention_hits(answers, entities), entities, spark.createDataFrame([("p", "m")], "project string, model_id string"),
        answers.select("project", "question_id", "date").distinct(),
    )
    for per_part, parts in ((64, 3), (7, 22), (1000, 1)):
        rows = M.with_excerpts(facts, found, per_part).orderBy("part_no").collect()
        assert [(r.part_no, r.excerpts) for r in rows if r.entity == "absent"] == [(0, None)]
        named = [r for r in rows if r.entity == "Acme"]
        assert [r.part_no for r in named] == list(range(parts)) and max(len(r.excerpts) for r in named) <= 5 * per_part
        assert [tuple(e) for r in named for e in r.excerpts] == want
        merged = R.merged_excerpts(found, per_part).orderBy("part_no").collect()
        assert [(e.answer_id, e.hit_no, e.excerpt) for r in merged for e in r.excerpts] == want


def test_excerpts_of_many_hits_are_as_quick_as_of_few(spark):
    """Both texts have the same length; one holds the name 32,000 times."""
    def seconds(text):
        df = spark.createDataFrame([(text,)] * 8, "t string").select(TX.first_hits(F.col("t"), F.lit("word"), 5).alias("h"))
        df.select(F.sum(F.size("h"))).first()
        start = time.perf_counter()
        assert df.select(F.sum(F.size("h"))).first()[0] == 40
        return time.perf_counter() - start

    assert seconds("word c " * 32_000) < 3 * seconds("word c " * 5 + "none c " * 31_995) + 0.3


LITERALS = {
    "^m[.]": "m", "[.]com$": "com", "news": "news", r"blog\.example": "blog.example", "colou?r-shop": "r-shop", "a(b|c)d": "", "shop(s)?-online": "-online",
    "(?:wiki)pedia": "pedia", "x{0,2}store": "store", r"\d+abc\w": "abc", r"\x41bc": "", "(?=foo)bar": "", "ab+cde": "cde", "a.bcd*": "bc", "((inner)+x)*tail": "tail",
    r"fo\(o": "fo", "UPPER.x": "upper", "": "", "[^]]abc": "abc", r"[\]]def": "def", "(a[)]b)xyz": "xyz", r"net\.?work": "work", "long?er": "lon",
}


def test_required_literals(spark):
    df = spark.createDataFrame([(p,) for p in LITERALS], "p string")
    got = {r.p: r.l for r in df.select("p", L.required_literal(F.col("p")).alias("l")).collect()}
    assert got == LITERALS


def typed_hosts(spark, patterns, hosts):
    rules = spark.createDataFrame([(f"c{k}", f"N{k}", k, kind, p) for k, (kind, p) in enumerate(patterns)], "code string, name string, ord long, kind string, pattern string")
    links = spark.createDataFrame([("p", "q", f"https://{h}/", "oth") for h in hosts], "project string, question_id string, link string, link_type string")
    return {r.link[8:-1]: r.link_type for r in L.classify_links(links, rules).collect()}


def test_many_expressions_and_beginnings(spark):
    """Patterns that all begin alike, expressions with and without a literal, against one by one; 1,000 expressions beside 10."""
    hosts = [f"www.host{k}.example{k % 7}.com" for k in range(300)] + ["m.x.org", "shop12.net", "zzz.de"]
    patterns = [("contains", f"www.host{k}.") for k in range(0, 1900, 3)] + [("regex", rf"host{k}\.example\d+") for k in range(0, 1000)]
    patterns += [("regex", rf"^{c}[.]") for c in "abcdefghijklmnopqrstuvwxyz"] + [("regex", rf"[{k % 10}]\.n.t$") for k in range(100)] + [("regex", "(shop|store)[0-9]+")]
    got = typed_hosts(spark, patterns, hosts)
    for h in hosts:
        hit = [f"c{k}" for k, (kind, p) in enumerate(patterns) if (p in h.removeprefix("www.") if kind == "contains" else re.search(p, h.removeprefix("www.")))]
        assert got[h] == (hit[0] if hit else "oth"), h

    def seconds(n):
        rules = [("regex", rf"host{k}\.example\d+") for k in range(n)]
        start = time.perf_counter()
        typed_hosts(spark, rules, hosts)
        return time.perf_counter() - start

    seconds(10)
    assert seconds(1000) < 2 * seconds(10) + 1


def _planned(df, name):
    """How often an expression's name stands in the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_url_steps_are_computed_once(spark):
    """A cleaned URL is decoded once, however many steps use it, and a text's links are cleaned in one pass."""
    from answerlens.functions import urls as U
    from answerlens.operators import links as L

    df = spark.createDataFrame([("p", "q", "m", 1, "See [a](https://www.x.org/?utm_id=1&b=2#t), https://y.org and y.org.")],
                               "project string, question_id string, model_id string, answer_id long, text string")
    assert _planned(df.select(U.clean_url(F.col("text"))), "try_url_decode") <= 1
    found = L.extract_links(df.withColumn("date", F.to_date(F.lit("2024-01-01"))))
    assert _planned(found.filter("root" if "root" in found.columns else "true"), "try_url_decode") <= 4
    assert sorted(r.link for r in found.collect()) == ["x.org/?b=2#t", "y.org"]


def test_summaries_with_long_blanks_and_ids_of_all_kinds(spark):
    """Runs of blanks cost their length, and ids with marks at their ends are told apart as before."""
    from answerlens.operators import enrich as X

    models = spark.createDataFrame(
        [("p", m, n) for m, n in [("gpt", "G"), ("gpt-4", "G4"), ("-x", "X"), ("a.b", "AB"), ("[k]", "K")]],
        "project string, model_id string, display_name string",
    )
    long = "a" + "\r" * 60_000 + "b"
    rows = spark.createDataFrame([
        ("p", 1, "gpt gpt-4 gpt-4o a-x -x a.b axb z[k]z [k] gpt"), ("p", 2, long), ("none", 3, 'gpt <b  title="see">x\n \n\n y '),
    ], "project string, id long, summary string")
    start = time.time()
    got = {r.id: r.summary for r in X.clean_summaries(rows, models).collect()}
    assert got[1] == "G G4 G-4o aX -x AB axb zKz [k] G"
    assert got[2] == long
    assert got[3] == "gpt <b>x\n\n y"
    assert time.time() - start < 10


def test_links_of_sentences_are_cleaned_once_for_all_names(spark):
    from answerlens.catalog.sourcing import _responses
    from answerlens.operators import attribution as A

    i = Inputs(spark, "/root/testdata/sf0.001")
    assert _planned(A.answer_sources(_responses(i), i.entities), "try_url_decode") < 40


def test_texts_are_searched_in_linear_time(spark):
    """Long runs without a dot, and many hits far behind in a long text: no step starts anew at every letter or hit."""
    texts = ["b" * 60_000, ("word " * 20 + "\n") * 3_000 + "acme.com " + "Acme Corp! " * 5]
    answers, entities = answers_of(spark, texts), names_of(spark, ["acme.com", *[f"acme{'-' * k}corp" for k in range(1, 40)]])
    MA.excerpts(answers.limit(0), entities).count()
    start = time.perf_counter()
    rows = MA.excerpts(answers, entities).filter("term = 'acme-corp'").orderBy("hit_no").collect()
    assert time.perf_counter() - start < 25
    assert [(r.pos, r.line, r.col) for r in rows] == [(303_010 + 11 * k, 3_001, 10 + 11 * k) for k in range(5)]


def test_hits_of_texts_that_hold_the_mark(spark):
    """A text is cut at marks set round its matches, and by two scans where it holds the mark itself."""
    rows = [("a.bc  a.bc", "bc"), ("", ""), ("a", "a"), ("", "a"), ("aa", "a")]
    df = spark.createDataFrame(rows, "t string, p string").select(TX.hits(F.col("t"), F.col("p")).alias("h"))
    got = [[(h.pos, h.len) for h in r.h] for r in df.collect()]
    assert got == [[(3, 2), (10, 2)], [(1, 1), (2, 1)], [(2, 1)], [], [(1, 1), (2, 1)]]


def test_one_reading_gives_matches_and_excerpts(spark):
    """Counts and excerpts of one reading equal those of two, for few heads and for many."""
    texts = ["Acme's acme, ACME at acme.org and https://acme.org/a", "the other's (acme)", "éa 中文", "", None]
    for names in (["Acme", "acme.org", "the other", "中文"], ["Acme", "acme.org", "the other", *[f"{a}{b}x" for a in "abcdefghijklm" for b in "abcdefghijklm"]]):
        answers, entities = answers_of(spark, texts), names_of(spark, names)
        both = MA.matches_and_excerpts(answers, entities)
        for got, want in zip(both, (MA.match_entities(answers, entities), MA.excerpts(answers, entities))):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_texts_are_read_once_for_links_and_excerpts(spark):
    """What a build measures reads no text any more beyond the links' own names."""
    answers, entities = answers_of(spark, ["Acme https://acme.org/a"]), names_of(spark, ["Acme"])
    parts = measure(answers, entities)
    for name in ("links", "excerpts"):
        plan = parts[name]._jdf.queryExecution().executedPlan().toString()
        assert "Scan ExistingRDD" not in plan and "FileScan parquet" in plan
