"""Source attribution against a plain brute-force reading of the rules."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from answerlens.operators import attribution as A
from answerlens.operators import enrich as X

D = dt.date(2024, 1, 1)
SCHEMA = (
    "project string, question_id string, date date, model_id string, answer_id long, content string, citations array<string>, "
    "annotations array<struct<type:string,url_citation:struct<url:string,title:string,content:string>>>"
)
LONG = "word " * 260
TEXTS = [
    "Acme is good [1]. Beta Corp leads [2][9]. Nothing here [1].",
    "See [Acme](https://acme.org/x) and [other](https://o.org/y). Beta Corp is at https://beta.net/z now.",
    f"Acme {LONG} [1] and [src](https://far.org/a). Acme near [2].",
    "www.lead.com - a list of things\nand more about Acme in one sentence. Then Beta Corp.",
    "Www.start.org covers it. This sentence says nothing at all. Here is Acme again. Short. And Beta Corp too.",
    "Nothing. Acme ok! Really? Yes. So [1] after.",
    "No sources for Acme or Beta Corp at all.",
    "Acme a. b! c? d [1] e.",
]
CITES = ["https://one.com/acme-page", "https://two.com/beta-corp/x"]


def near(sentence, term, marker):
    at = sentence.find(marker)
    low, places, p = sentence.lower(), [], 0
    while (p := low.find(term, p)) != -1:
        places.append(p)
        p += len(term)
    if at < 0 or not places:
        return False
    gaps = [sentence[min(p, at):max(p, at)] for p in places]
    return min(len(g.split()) for g in gaps) <= 250 and min(len(re.findall(r"[.!?]+", g)) for g in gaps) <= 2


def expected_near(sentences, term, cites):
    out = set()
    for s in sentences:
        if term not in s.lower():
            continue
        for n in re.findall(r"\[(\d+)\]", s):
            if near(s, term, f"[{n}]") and 0 < int(n) <= len(cites):
                out.add(cites[int(n) - 1])
        for m in re.finditer(r"\[([^\]]+)\]\(([^)]+)\)", s):
            if m[1].lower() == term or near(s, term, m[0]):
                out.add(m[2])
        for u in re.findall(r"https?://[^\s)\[\]]+", s):
            if near(s, term, u):
                out.add(u)
    return {re.sub(r"[/.]+$", "", re.sub(r"^https?://(www\.)?", "", u)) for u in out}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [("p", "q", D, f"m{i}", i, t, CITES, []) for i, t in enumerate(TEXTS)]
    responses = spark.createDataFrame(rows, SCHEMA)
    entities = spark.createDataFrame(
        [("p", "q", "products", "Acme", 1), ("p", "q", "organizations", "Beta Corp", 2), ("p", "q", "products", "one", 3)],
        "project string, question_id string, section string, entity string, ord long",
    )
    return responses, entities


def test_near_links(spark, frames):
    responses, entities = frames
    sents = {}
    for r in A.sentences(responses).orderBy("answer_id", "sentence_no").collect():
        sents.setdefault(r.answer_id, []).append(r.sentence)
    got = {(r.answer_id, r.term): set(r.near) for r in A.links_by_strategy(responses, entities).collect()}
    for i, text in enumerate(TEXTS):
        for term in ("acme", "beta corp", "one"):
            want = expected_near(sents[i], term, CITES)
            assert got.get((i, term), set()) == want, (text[:40], term)


def test_leading_links(frames):
    got = {(r.answer_id, r.term): r.leading for r in A.links_by_strategy(*frames).collect()}
    assert got[(3, "acme")] == ["www.lead.com"]
    assert got[(4, "acme")] == ["www.start.org"]
    # The one-word sentence ends the paragraph.
    assert got[(4, "beta corp")] == []


def test_precedence(frames):
    got = {}
    for r in A.answer_sources(*frames).collect():
        got.setdefault((r.answer_id, r.term), set()).add(r.url)
    assert got[(0, "beta corp")] == {"two.com/beta-corp/x"}
    assert got[(4, "acme")] == {"www.start.org"}
    # Only the last resort finds something.
    assert got[(6, "acme")] == {"one.com/acme-page"} and got[(6, "beta corp")] == {"two.com/beta-corp/x"}
    # The name is only in a citation URL, not in the text.
    assert got[(6, "one")] == {"one.com/acme-page"}


def test_annotations(spark, frames):
    note = lambda url, title, content: ("url_citation", (url, title, content))
    row = ("p", "q", D, "m", 99, "plain", [], [
        note("https://a.org/1", "About ACME", None), note("https://b.org/2", None, "acme inside"),
        note("https://c.org/beta%20corp", "t", "c"), ("other", ("https://d.org", "acme", None)), note("", "acme", None),
    ])
    found = A.answer_sources(spark.createDataFrame([row], SCHEMA), frames[1])
    assert {(r.term, r.url) for r in found.collect()} == {
        ("acme", "a.org/1"), ("acme", "b.org/2"), ("beta corp", "c.org/beta corp"),
    }


def test_history_fallback(spark, frames):
    rows = [("p", "q", dt.date(2024, 1, 1), "m1", 1, "Acme [1].", CITES, []), ("p", "q", dt.date(2024, 1, 8), "m2", 2, "Beta Corp [2]. Acme.", [], [])]
    responses = spark.createDataFrame(rows, SCHEMA)
    entities = frames[1].filter(F.col("entity") == "Acme").withColumn("date", F.lit(dt.date(2024, 1, 8)))
    dates = responses.select("project", "date")
    got = A.attribute_sources(responses, entities, None, dates).collect()
    assert [(r.url, r.models, r.dates) for r in got] == [("one.com/acme-page", ["m1"], [dt.date(2024, 1, 1)])]


def test_context_windows(frames):
    rows = A.context_windows(*frames, radius=1).filter("answer_id = 5 and term = 'acme'").collect()
    assert [(r.first_sentence, r.last_sentence, r.context) for r in rows] == [(1, 3, "Nothing. Acme ok! Really?")]


def test_context_windows_leave_links_alone(frames):
    """Contexts are cut on the answer's row: its sentences are exploded by no name, and no link is looked for."""
    plan = A.context_windows(*frames)._jdf.queryExecution().optimizedPlan().toString()
    assert "https?:" not in plan and plan.count("Generate explode") <= 2


def test_annotate_text(spark):
    texts = spark.createDataFrame([("p", "q", 1, "<p>Acme Inc and acme</p><code>acme</code> Acme <a href='#'>Acme</a>")],
                                  "project string, question_id string, answer_id long, text string")
    entities = spark.createDataFrame([("p", "q", "products", "Acme", 1), ("p", "q", "organizations", "Acme Inc", 2)],
                                     "project string, question_id string, section string, entity string, ord long")
    out = X.annotate_text(texts, entities).first().text
    span = lambda t, v, s: f'<span class="clickable-entity" data-entity-type="{t}" data-entity-value="{v}">{s}</span>'
    assert out == (f"<p>{span('organization', 'acme inc', 'Acme Inc')} and acme</p><code>acme</code> "
                   f"{span('product', 'acme', 'Acme')} <a href='#'>Acme</a>")
