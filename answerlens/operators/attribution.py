"""Which links an answer gives as sources for an entity.

``responses``: project, question_id, date, model_id, answer_id, content, citations (array of URLs)
and annotations (array of ``url_citation`` structs).  Names meet answers through the inverted index
of ``matching`` built over content, citation URLs and annotation texts; each surviving pair is then
judged on its own row, from the answer's sentence and citation arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from answerlens import schemas as S
from answerlens.functions import text as TX
from answerlens.functions import urls as U
from answerlens.operators.links import links_in
from answerlens.operators.scale import materialize
from answerlens.operators.matching import _group_keys, search_terms, with_candidates

# How far a link may be from the name it is a source for.
MAX_SENTENCE_MARKS, MAX_WORDS = 2, 250
# Look-ahead of leading links, shortest sentence that is not a paragraph break.
FORWARD_SENTENCES, MIN_SENTENCE = 2, 10
HISTORY_DATES = 10  # fixed value

_CITATION = r"\[(\d+)\]"
_PLAIN_URL = r"https?://[^\s)\[\]]+"
_STARTS_WITH_LINK = r"(?i)^\s*(https?://|www\.|[a-z0-9][-a-z0-9]*\.[a-z]{2,})"


def sentences(answers: DataFrame, column: str = "content") -> DataFrame:
    """One row per sentence with its number from 1."""
    split = answers.select("answer_id", F.posexplode(TX.split_sentences(F.col(column))).alias("n", "sentence"))
    return split.select("answer_id", (F.col("n") + 1).cast("long").alias("sentence_no"), "sentence")


def _gap(between: Column) -> tuple[Column, Column]:
    """Words and sentence marks of a text; null for null."""
    return F.regexp_count(between, F.lit(r"\S+")), F.regexp_count(between, F.lit(r"[.!?]+"))


def near_name(sentence: Column, low: Column, term: Column, at: Column) -> Column:
    """Whether a marker at an offset lies close enough to some mention of the lower-cased term.

    Only the nearest mention on each side matters, since both distances grow with the gap.
    """

    def left(upto: Column) -> Column:
        # Text from the last mention that starts before the marker.
        from_ = F.length(upto) - F.length(F.call_function("substring_index", upto, term, F.lit(-1))) - F.length(term) + 1
        return TX.bind(from_, lambda k: F.when(upto.contains(term), F.substring(sentence, k, at - k)))

    def right(ahead: Column) -> Column:
        return F.when(ahead > 0, F.substring(sentence, at, ahead - 1))

    before = TX.bind(F.substring(low, F.lit(1), at - 2 + F.length(term)), left)
    behind = TX.bind(F.instr(F.substring(low, at, F.length(low)), term), right)
    return TX.bind(before, lambda x: TX.bind(behind, lambda y: _within(x, y)))


def _within(left: Column, right: Column) -> Column:
    lw, lm = _gap(left)
    rw, rm = _gap(right)
    return F.coalesce((F.least(lw, rw) <= MAX_WORDS) & (F.least(lm, rm) <= MAX_SENTENCE_MARKS), F.lit(False))


def _cleaned(urls: Column) -> Column:
    return F.filter(F.transform(urls, U.clean_url), lambda u: u.isNotNull() & (u != ""))


def resolve_citations(text: Column, citations: Column) -> Column:
    """array<string>: the citation of each ``[n]`` in the text, unknown numbers left out."""
    numbers = F.regexp_extract_all(text, F.lit(_CITATION), F.lit(1))
    return F.filter(
        F.transform(numbers, lambda n: _nth(citations, n)), lambda u: u.isNotNull() & (u != "")
    )


def _nth(citations: Column, number: Column) -> Column:
    n = number.try_cast("int")
    return F.when(n > 0, F.try_element_at(citations, F.when(n > 0, n).otherwise(F.lit(1))))


def _marks(s: Column, citations: Column) -> Column:
    """array<struct(at, title, url)> of a sentence: numbered citations, markdown links, plain URLs, with cleaned URLs."""
    titled = lambda m: F.lower(F.regexp_extract(m, U.MARKDOWN_LINK, 1))
    mark = lambda marker, title, url: F.struct(F.instr(s, marker).alias("at"), title.alias("title"), url.alias("url"))
    http = lambda u: F.when(F.startswith(u, F.lit("http")), u)
    plain = F.lit(None).cast("string")
    cited = F.transform(F.regexp_extract_all(s, F.lit(_CITATION), F.lit(1)), lambda n: mark(
        F.concat(F.lit("["), n, F.lit("]")), plain, _nth(citations, n)
    ))
    marked = F.transform(F.regexp_extract_all(s, F.lit(U.MARKDOWN_LINK), F.lit(0)), lambda m: mark(
        m, titled(m), http(F.trim(F.regexp_extract(m, U.MARKDOWN_LINK, 2)))
    ))
    urls = F.transform(F.regexp_extract_all(s, F.lit(_PLAIN_URL), F.lit(0)), lambda u: mark(u, plain, u))
    given = F.filter(F.concat(cited, marked, urls), lambda m: m["url"].isNotNull())
    cleaned = F.transform(given, lambda m: F.struct(m["at"].alias("at"), m["title"].alias("title"), U.clean_url(m["url"]).alias("url")))
    return F.filter(cleaned, lambda m: m["url"] != "")


def links_near(sents: Column, term: Column) -> Column:
    """Links in the sentences that contain the term, close to it.

    ``sents`` is an array of (text, low, marks).  Numbered citations, links titled with the name, other
    markdown links and plain URLs.
    """

    def in_sentence(x: Column) -> Column:
        near = lambda m: F.coalesce(m["title"] == term, F.lit(False)) | near_name(x["text"], x["low"], term, m["at"])
        return F.transform(F.filter(x["marks"], near), lambda m: m["url"])

    holding = F.filter(sents, lambda x: (F.size(x["marks"]) > 0) & x["low"].contains(term))
    return F.flatten(F.transform(holding, in_sentence))


def _leading_lists(sents: Column) -> Column:
    """Per sentence: links it leads with (null if it does not begin with a link)."""
    return F.transform(sents, lambda x: F.when(x["text"].rlike(_STARTS_WITH_LINK), links_in(x["text"])))


def _leading_places(sents: Column, leads: Column) -> Column:
    """Per sentence the leading sentences, by number from 0, that a name in it looks at, found once for all names.

    ``first``: of itself and the next two the first that begins with a link; ``filled``: the first of them that has any;
    ``behind``: the nearest before it in its paragraph.
    """
    numbers = F.sequence(F.lit(0), F.size(leads) - 1)
    among = lambda i, good: F.array_min(F.transform(
        F.sequence(i, F.least(i + FORWARD_SENTENCES, F.size(leads) - 1)), lambda k: F.when(good(F.get(leads, k)), k)
    ))
    start = F.struct(F.lit(-1).alias("lead"), F.lit(-1).alias("short"), F.expr("cast(array() as array<int>)").alias("out"))
    behind = F.aggregate(numbers, start, lambda acc, i: F.struct(
        F.when(F.get(leads, i).isNotNull(), i).otherwise(acc["lead"]).alias("lead"),
        F.when(F.length(F.get(sents, i)["text"]) < MIN_SENTENCE, i).otherwise(acc["short"]).alias("short"),
        F.array_append(acc["out"], F.when(acc["lead"] > acc["short"], acc["lead"])).alias("out"),
    ), lambda acc: acc["out"])
    places = TX.bind(behind, lambda by: F.transform(numbers, lambda i: F.struct(
        among(i, lambda l: l.isNotNull()).alias("first"),
        among(i, lambda l: F.coalesce(F.size(l) > 0, F.lit(False))).alias("filled"), F.get(by, i).alias("behind"),
    )))
    # Most answers have no leading sentence at all.
    return F.when(F.exists(leads, lambda l: l.isNotNull()), places)


def links_at_sentence_start(sents: Column, term: Column, leads: Column, places: Column) -> Column:
    """Leading links.  Each sentence with the name gives the next link not yet given of the first sentence, among it
    and the next two, that begins with a link; while there is none, all links of the nearest such
    sentence before it in the paragraph.  ``leads`` holds the links of each leading sentence, null for others,
    ``places`` is ``_leading_places``, null without any."""
    none = F.expr("cast(array() as array<string>)")
    holding = F.filter(F.transform(sents, lambda x, i: F.when(x["low"].contains(term), F.get(places, i))), lambda p: p.isNotNull())
    fresh = lambda acc, links: F.slice(F.filter(links, lambda u: ~F.array_contains(acc, u)), 1, 1)
    return F.when(places.isNull(), none).otherwise(F.aggregate(
        holding, none,
        lambda acc, p: F.when(
            F.size(acc) == 0,
            F.coalesce(F.slice(F.get(leads, p["filled"]), 1, 1), F.array_distinct(F.get(leads, p["behind"])), none),
        ).otherwise(F.concat(acc, F.coalesce(fresh(acc, F.get(leads, p["first"])), none))),
    ))


def _url_variants(url: Column, term: Column, joins: list[str]) -> Column:
    decoded = F.lower(F.coalesce(U.percent_decode(url), url))
    hit = decoded.contains(term)
    for j in joins:
        hit = hit | decoded.contains(F.replace(term, F.lit(" "), F.lit(j)))
    return hit


def links_in_annotations(annotations: Column, term: Column) -> Column:
    """URLs of annotations whose title, else content, else URL names the entity."""
    has = lambda c: F.coalesce(F.lower(c).contains(term), F.lit(False))
    named = F.filter(annotations, lambda a: F.coalesce(
        (a["type"] == "url_citation") & (a["url_citation"]["url"] != "") & (
            has(a["url_citation"]["title"]) | has(a["url_citation"]["content"])
            | _url_variants(a["url_citation"]["url"], term, ["-", "_", "%20"])
        ), F.lit(False)))
    return F.coalesce(_cleaned(F.transform(named, lambda a: a["url_citation"]["url"])), F.expr("cast(array() as array<string>)"))


def links_in_citations(citations: Column, term: Column) -> Column:
    """The first citation whose URL contains the name."""
    named = F.filter(citations, lambda u: F.coalesce((u != "") & _url_variants(u, term, ["-", "_"]), F.lit(False)))
    return F.coalesce(F.slice(_cleaned(named), 1, 1), F.expr("cast(array() as array<string>)"))


def _searched_text() -> Column:
    """All an entity may be found in: content, citation URLs, annotation texts."""
    decoded = lambda u: F.coalesce(U.percent_decode(u), u)
    notes = F.transform("annotations", lambda a: F.concat_ws(
        " ", a["url_citation"]["title"], a["url_citation"]["content"], decoded(a["url_citation"]["url"])
    ))
    return F.concat_ws(
        " ", F.col("content"), F.array_join(F.transform("citations", decoded), " "), F.array_join(notes, " ")
    )


def _named_sentences(responses: DataFrame, entities: DataFrame, searched: Column) -> DataFrame:
    """One row per answer and list of names with ``sents``, its sentences (text, low), and ``terms``, the names ``searched`` may hold."""
    keys = _group_keys(responses, entities)
    named = entities.withColumn("section", F.lit("name"))  # links are matched by their full text here
    sents = F.transform(TX.split_sentences(F.coalesce("content", F.lit(""))), lambda s: F.struct(s.alias("text"), F.lower(s).alias("low")))
    found = with_candidates(responses, search_terms(named, keys), keys, searched)
    return found.withColumn("sents", sents).withColumn("terms", F.array_distinct(F.transform("terms", lambda t: t["term"])))


def _pairs(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """``_named_sentences`` with the links of the sentences and all else that the strategies need."""
    linked = lambda x: x["text"].rlike(r"\[\d+\]|\]\(|https?://")
    marked = F.transform("sents", lambda x: x.withField("marks", F.when(linked(x), _marks(x["text"], F.col("citations")))))
    return (
        _named_sentences(responses, entities, _searched_text())
        .withColumn("leads", _leading_lists(F.col("sents")))
        .withColumn("places", _leading_places(F.col("sents"), F.col("leads")))
        .withColumn("sents", marked)
        .select(*S.SNAPSHOT, "model_id", "answer_id", "sents", "leads", "places", "citations", "annotations", "terms")
    )


def links_by_strategy(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """(answer, term) with the links of each strategy: annotated, near, leading, cited."""
    term = F.col("term")
    return _pairs(responses, entities).withColumn("term", F.explode("terms")).select(
        *S.SNAPSHOT, "model_id", "answer_id", "term",
        links_in_annotations(F.col("annotations"), F.trim(term)).alias("annotated"),
        links_near(F.col("sents"), term).alias("near"),
        links_at_sentence_start(F.col("sents"), term, F.col("leads"), F.col("places")).alias("leading"),
        links_in_citations(F.col("citations"), F.trim(term)).alias("cited"),
    )


def answer_sources(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """(answer, term, url): annotations and near links; if none leading links; if none citations."""
    # Later strategies only run where the earlier ones found nothing.
    or_else = lambda found, other: F.when(F.size(found) > 0, found).otherwise(other)

    def chosen(term: Column) -> Column:
        first = F.concat(
            links_in_annotations(F.col("annotations"), F.trim(term)),
            links_near(F.col("sents"), term),
        )
        leading = links_at_sentence_start(F.col("sents"), term, F.col("leads"), F.col("places"))
        cited = links_in_citations(F.col("citations"), F.trim(term))
        return TX.bind(first, lambda a: or_else(a, TX.bind(leading, lambda b: or_else(b, cited))))

    given = F.transform("terms", lambda t: F.struct(t.alias("term"), F.array_distinct(chosen(t)).alias("urls")))
    return _pairs(responses, entities).select(
        *S.SNAPSHOT, "model_id", "answer_id", F.explode(F.filter(given, lambda g: F.size(g["urls"]) > 0)).alias("g")
    ).select(*S.SNAPSHOT, "model_id", "answer_id", "g.term", F.explode("g.urls").alias("url"))


def dedupe_sources(sources: DataFrame, keys: list[str]) -> DataFrame:
    """One row per entity and cleaned URL with sorted models and dates; needs ``seen_date``."""
    return (
        sources.withColumn("url", U.clean_url(F.col("url"))).groupBy(*keys, "url")
        .agg(F.array_sort(F.collect_set("model_id")).alias("models"),
             F.array_sort(F.collect_set("seen_date")).alias("dates"))
    )


def attribute_sources(
    responses: DataFrame, entities: DataFrame, facts: DataFrame | None = None,
    complete_dates: DataFrame | None = None, history: int = HISTORY_DATES,
) -> DataFrame:
    """Sources per entity and snapshot with models and dates.

    ``entities`` has a date.  With ``complete_dates`` an entity without source, or without mentions
    in ``facts``, is also given the sources of its name from the ``history`` complete dates before.
    """
    dateless = entities.select("project", "question_id", "section", "entity").distinct()
    found = materialize(answer_sources(responses, dateless))  # read by every step below
    term = F.lower("entity").alias("term")
    wanted = entities.select(*S.ENTITY, term)
    key = ["project", "question_id", "date", "term"]
    now = wanted.join(found, key).select(*S.ENTITY, "model_id", F.col("date").alias("seen_date"), "url")
    if complete_dates is None:
        return dedupe_sources(now, S.ENTITY)
    with_source = now.select(*S.ENTITY).distinct()
    needy = wanted.join(with_source, S.ENTITY, "left_anti")
    if facts is not None:
        mentioned = facts.filter(F.col("mentions") > 0).select(*S.ENTITY).distinct()
        needy = needy.unionByName(
            wanted.join(with_source, S.ENTITY, "left_semi").join(mentioned, S.ENTITY, "left_anti")
        )
    by_date = Window.partitionBy("project").orderBy("date")
    numbered = complete_dates.select("project", "date").distinct().withColumn("no", F.row_number().over(by_date))
    offered = (
        found.join(numbered, ["project", "date"]).withColumnRenamed("date", "seen_date")
        .withColumn("no", F.explode(F.sequence(F.col("no") + 1, F.col("no") + history)))
        .join(numbered, ["project", "no"])
    )
    before = needy.join(offered, key).select(*S.ENTITY, "model_id", "seen_date", "url")
    return dedupe_sources(now.unionByName(before), S.ENTITY)


def context_windows(responses: DataFrame, entities: DataFrame, radius: int = 2) -> DataFrame:
    """Text of the sentences round each sentence with the name; each range once."""
    n = F.size("sents")
    index = F.when(n > 0, F.sequence(F.lit(1), n))
    def ranges(term: Column) -> Column:
        holding = F.filter(index, lambda i: F.element_at("sents", i)["low"].contains(term))
        return F.array_distinct(F.transform(holding, lambda i: F.struct(
            F.greatest(F.lit(1), i - radius).alias("first"), F.least(n, i + radius).alias("last")
        )))

    # Contexts are cut on the answer's row, which multiplies by neither names nor ranges.
    cut = lambda r: F.array_join(F.transform(F.slice("sents", r["first"], r["last"] - r["first"] + 1), lambda x: x["text"]), " ")
    each = F.flatten(F.transform("terms", lambda t: F.transform(ranges(t), lambda r: F.struct(
        t.alias("term"), r["first"].cast("long").alias("first_sentence"), r["last"].cast("long").alias("last_sentence"),
        cut(r).alias("context"),
    ))))
    return _named_sentences(responses, entities, F.col("content")).select(
        *S.SNAPSHOT, "model_id", "answer_id", F.explode(each).alias("c")
    ).select(*S.SNAPSHOT, "model_id", "answer_id", "c.*")
