"""Citations of raw responses, and answers with their citations written in.

``responses``: keys, message (see ``schemas.MESSAGE``), citations (root array of URLs).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from answerlens.functions import urls as U
from answerlens.functions.text import bind

# The form of the citation list.
HEADER = "# CITATIONS"
UNTITLED = "Untitled"
# HTML entities decoded in citation texts.
HTML_ENTITIES = [
    ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
]

_LIST = "array<struct<pos:int,url:string,title:string,content:string>>"
_REFERENCE = r"\[(\d+)\](?!\()"


def decode_html(text: Column) -> Column:
    """Replace the common HTML entities."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), HTML_ENTITIES, text)


def _numbered(root: Column, annotations: Column) -> Column:
    """Citations by position: root URLs, overridden by annotations at the same place."""
    size = F.greatest(F.coalesce(F.size(root), F.lit(0)), F.coalesce(F.size(annotations), F.lit(0)))

    def at(i: Column) -> Column:
        note = F.try_element_at(annotations, i)
        named = F.coalesce((note["type"] == "url_citation") & (note["url_citation"]["url"] != ""), F.lit(False))
        url = F.when(named, note["url_citation"]["url"]).otherwise(F.nullif(F.try_element_at(root, i), F.lit("")))
        title = F.when(named, F.coalesce(F.nullif(note["url_citation"]["title"], F.lit("")), url)).otherwise(url)
        content = F.when(named, decode_html(F.nullif(note["url_citation"]["content"], F.lit(""))))
        return F.struct(i.cast("int").alias("pos"), url.alias("url"), title.alias("title"), content.alias("content"))

    listed = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), at)
    return F.filter(listed, lambda c: c["url"].isNotNull())


def _unnumbered(message: Column) -> Column:
    """Citations without a number, the first of each URL, from the three places that hold them."""
    empty = F.expr("cast(array() as array<struct<url:string,title:string,content:string>>)")
    all_ = F.concat(
        F.coalesce(message["citations"], empty), F.coalesce(message["search_results"], empty),
        F.coalesce(message["context"]["citations"], empty),
    )
    known = F.filter(all_, lambda c: F.coalesce(c["url"] != "", F.lit(False)))
    urls = F.transform(known, lambda c: c["url"])
    first = F.filter(known, lambda c, i: F.array_position(urls, c["url"]) == i + 1)
    return F.transform(first, lambda c, i: F.struct(
        (i + 1).cast("int").alias("pos"), c["url"].alias("url"),
        F.coalesce(F.nullif(c["title"], F.lit("")), F.lit(UNTITLED)).alias("title"),
        decode_html(F.nullif(c["content"], F.lit(""))).alias("content"),
    ))


def _with_lists(responses: DataFrame) -> DataFrame:
    return responses.withColumn(
        "numbered", _numbered(F.col("citations"), F.col("message.annotations"))
    ).withColumn("unnumbered", _unnumbered(F.col("message")))


def citations(responses: DataFrame, keys: list[str]) -> DataFrame:
    """One row per citation: ``numbered`` ones by position, the others by first occurrence."""
    kind = lambda name: F.struct(F.lit(name == "numbered").alias("numbered"), F.col(name).alias("items"))
    lists = _with_lists(responses).select(*keys, F.explode(F.array(kind("numbered"), kind("unnumbered"))).alias("k"))
    return lists.select(*keys, F.col("k.numbered").alias("numbered"), F.explode("k.items").alias("c")).select(
        *keys, "numbered", "c.pos", "c.url", "c.title", "c.content"
    )


def _linked(text: Column, numbered: Column) -> Column:
    """Replace each unlinked ``[n]`` by its citation, titled unless the title only repeats the URL.

    The text is cut at its references and put together again, so inserted titles are never
    searched themselves.
    """
    parts = F.split(text, r"\[\d+\](?!\()", -1)
    numbers = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1))

    def link(n: Column) -> Column:
        same = F.filter(numbered, lambda c: c["pos"] == n.try_cast("int"))
        return F.coalesce(F.get(F.transform(same, lambda c: F.concat(
            F.lit("["), F.when(c["bare"], F.concat(F.lit("["), n, F.lit("]"))).otherwise(c["title"]),
            F.lit("]("), c["url"], F.lit(")"),
        )), F.lit(0)), F.concat(F.lit("["), n, F.lit("]")))

    joined = lambda ns: F.array_join(F.transform(parts, lambda p, i: F.concat(
        p, F.coalesce(bind(F.get(ns, i), link), F.lit(""))
    )), "")
    return bind(numbers, joined)


def _footer(items: Column, indent: str) -> Column:
    entry = lambda c, i, no: F.concat(
        F.lit("\n"), no.cast("string"), F.lit(". ["), c["title"], F.lit("]("), c["url"], F.lit(")\n"),
        F.when(c["content"].isNotNull(), F.concat(F.lit("\n" + indent), c["content"], F.lit("\n"))).otherwise(F.lit("")),
    )
    return F.when(F.size(items) > 0, F.concat(
        F.lit(f"\n\n{HEADER}\n"),
        F.array_join(F.transform(items, lambda c, i: entry(c, i, c["pos"] if not indent else i + 1)), ""),
    )).otherwise(F.lit(""))


def answers_with_citations(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Answer text with linked references and the list of its citations.

    With numbered citations all are listed in order; otherwise those whose URL the text lacks.
    """
    lists = _with_lists(responses).withColumn("content", F.coalesce("message.content", F.lit("")))
    has_numbers = F.size("numbered") > 0
    # Whether a title only repeats its URL is found once per citation, not once per reference.
    targets = F.transform("numbered", lambda c: F.struct(
        c["pos"].alias("pos"), c["url"].alias("url"), c["title"].alias("title"),
        U.is_url_like_title(c["url"], c["title"]).alias("bare"),
    ))
    linked = bind(targets, lambda t: _linked(F.col("content"), t))
    body = F.when(has_numbers & F.col("content").rlike(_REFERENCE), linked).otherwise(
        F.col("content")
    )
    unused = F.filter("unnumbered", lambda c: ~F.col("content").contains(c["url"]))
    footer = F.when(has_numbers, _footer(F.col("numbered"), "")).otherwise(_footer(unused, "  "))
    return lists.select(*keys, F.concat(body, footer).alias("text"))
