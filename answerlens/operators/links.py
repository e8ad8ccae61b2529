"""Link extraction, typing and rollups.

Texts are split and scanned in one map stage; typing works on distinct hosts, so patterns never
meet link rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerlens import schemas as S
from answerlens.functions import scores as SC
from answerlens.functions import text as TX
from answerlens.functions import urls as U
from answerlens.operators.scale import materialize, with_group_total

OTHER_CODE, OTHER_NAME = "oth", "Other"  # fixed values
PIECE = 4


def _listed(text: Column) -> Column:
    """struct(full, bare) of a text: its cleaned Markdown targets and URLs, then its other domains, each link once."""
    blank = lambda t, p: F.regexp_replace(t, p, " ")
    cleaned = lambda found: F.transform(found, U.clean_url)
    targets = F.filter(
        cleaned(F.regexp_extract_all(text, F.lit(U.MARKDOWN_LINK), F.lit(2))), lambda u: (u != "") & ~F.startswith(u, F.lit("#"))
    )

    def found(without_markdown: Column) -> Column:
        # Anchors such as [top](#top) stay in the text but hold no URL of their own.
        full = F.filter(cleaned(F.regexp_extract_all(without_markdown, F.lit(U.ANY_URL), F.lit(0))), lambda u: u != "")
        rest = F.lower(blank(without_markdown, U.ANY_URL))
        bare = F.filter(F.array_distinct(F.regexp_extract_all(rest, F.lit(U.DOMAIN), F.lit(0))), lambda d: ~d.rlike(U.FILE_SUFFIX))
        # Lists are bound, since a lambda would build them anew for every element.
        return TX.bind(F.array_distinct(F.concat(targets, full)), lambda seen: F.struct(
            seen.alias("full"), F.array_except(bare, F.concat(seen, F.transform(seen, U.domain_of))).alias("bare")
        ))

    no_image = lambda links: F.filter(links, lambda u: ~u.rlike(U.IMAGE_SUFFIX))
    return TX.bind(TX.bind(blank(text, U.MARKDOWN_LINK), found), lambda l: F.struct(
        no_image(l["full"]).alias("full"), no_image(l["bare"]).alias("bare")
    ))


def links_in(text: Column) -> Column:
    """array<string> of the distinct links of a text.

    Markdown targets first, then URLs, then bare domains; each pass works on the text with the
    earlier hits blanked out, exactly at their length.  Bare domains already covered and file
    names are skipped, image links dropped.
    """
    return TX.bind(_listed(text), lambda l: F.concat(l["full"], l["bare"]))


def answer_links(answers: DataFrame) -> DataFrame:
    """One row per answer and link, ``ord`` giving the place in the answer's list."""
    return answers.select(
        *S.SNAPSHOT, "model_id", "answer_id", F.posexplode(links_in(F.col("text"))).alias("ord", "link")
    )


def extract_links(answers: DataFrame) -> DataFrame:
    """Distinct links of a snapshot's answers, unclassified.

    A bare domain is left out if another answer of the snapshot gives it as part of a URL; one given by its root URL is
    the same link as the bare domain and stays.  Each text is scanned once: a link comes with a mark whether the text
    gives it as a root URL.
    """
    no_path = lambda u: ~u.contains("/") & ~u.contains("?")
    marked = TX.bind(_listed(F.col("text")), lambda l: F.concat(
        F.transform(l["full"], lambda u: F.struct(u.alias("link"), no_path(u).alias("root"))),
        F.transform(l["bare"], lambda u: F.struct(u.alias("link"), F.lit(False).alias("root"))),
    ))
    found = answers.select(*S.SNAPSHOT, F.explode(marked).alias("l")).groupBy(*S.SNAPSHOT, "l.link").agg(
        F.bool_or("l.root").alias("root")
    )
    bare = ~F.col("link").contains("/") & ~F.col("link").contains("?")
    # Bare domains and URLs of a snapshot meet on their domain; only the domain's flag is needed.
    urls = found.filter(~bare).select(*S.SNAPSHOT, U.domain_of(F.col("link")).alias("link")).distinct()
    kept = found.join(urls.withColumn("covered", F.lit(True)), S.SNAPSHOT + ["link"], "left").filter(
        ~bare | F.col("covered").isNull() | F.col("root")
    )
    return kept.select(*S.SNAPSHOT, "link", F.lit(OTHER_CODE).alias("link_type"))


def _pieces(text: Column) -> Column:
    """Distinct runs of up to PIECE characters of a text."""
    runs = lambda n: F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.array_distinct(F.concat(*[runs(n) for n in range(1, PIECE + 1)]))


def _met(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items and rules (with ``literal``, lower-cased) where the item contains the literal.

    Both meet on the piece of the literal that the fewest items have, so a beginning that many patterns and
    hosts share, like ``www.``, is no hot key.
    """
    full = F.regexp_extract_all("literal", F.lit(f"(?s)(?=(.{{{PIECE}}}))"), F.lit(1))
    own = F.when(F.length("literal") < PIECE, F.array("literal")).otherwise(F.array_distinct(full))
    wanted = rules.filter("literal <> ''").select("*", F.explode(own).alias("piece"))
    pieces = items.select("item", F.explode(_pieces(F.col("item"))).alias("piece"))
    counts = pieces.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("__items"))
    # Written, so that its size is known: the pieces of all items pass for as small as the items, and would be broadcast.
    chosen = materialize(wanted.join(counts, "piece", "left").groupBy(*rules.columns).agg(
        F.min_by("piece", F.struct(F.coalesce("__items", F.lit(0)), "piece")).alias("piece")
    ))
    return pieces.join(chosen, "piece").filter(F.col("item").contains(F.col("literal"))).drop("piece")


def _containing(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """(item, ord, code) where the item contains the pattern."""
    return _met(items, patterns.select("ord", "code", F.lower("pattern").alias("literal"))).select("item", "ord", "code")


def _ending(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """(item, ord, code) where the item ends with the pattern: its endings equal it."""
    ends = F.transform(F.sequence(F.lit(1), F.length("item")), lambda k: F.expr("item").substr(k, F.length("item")))
    met = items.filter("item <> ''").select("item", F.explode(ends).alias("pattern"))
    return met.join(patterns.select("ord", "code", "pattern"), "pattern").select("item", "ord", "code")


# Expressions whose literals are not read: alternatives, look-around and flags, quoting, and characters by number or class name.
_UNREAD = r"\||\(\?(?!:)|\\[QExupPkNcX0-9]"
# What holds no character for certain, innermost groups first: optional and repeated groups, classes, optional characters.
_OPEN_GROUP, _GROUP = r"\([^()]*\)(?:[?*]|\{[^}]*\})[?+]?", r"\((?:\?:)?([^()]*)\)\+?"
_UNCERTAIN = r"\[\^?\]?(?:\\.|[^\]\\])*\](?:[?*+]|\{[^}]*\})?[?+]?|(?:\\.|[^\\])(?:[?*]|\{[^}]*\})[?+]?|\\[A-Za-z]|(?<!\\)[.^$]"
_BREAK = "\x00"
#: Shortest literal by which an expression is looked up, and expressions without one that travel in one row.
LITERAL, LISTED = 3, 64


def required_literal(pattern: Column) -> Column:
    """The longest run of characters, lower-cased, that every match of a regular expression holds; empty if none is found.

    Only plain structure is read, so a literal may be missed but is never wrong.
    """
    # Escaped brackets and braces become breaks first, so that those left are structure.
    rest = F.regexp_replace(pattern, r"\\[\[\](){}|\\^$?*+](?:[?*+]|\{[^}]*\})?", _BREAK)
    rest = F.regexp_replace(rest, r"\[\^?\]?(?:\\.|[^\]\\])*\](?:[?*+]|\{[^}]*\})?[?+]?", _BREAK)
    for _ in range(3):
        rest = F.regexp_replace(F.regexp_replace(rest, _OPEN_GROUP, _BREAK), _GROUP, _BREAK + "$1" + _BREAK)
    rest = F.regexp_replace(rest, _UNCERTAIN, _BREAK)
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?:^|(?<=.))\+[?+]?", _BREAK), r"\\(.)", "$1")
    runs = F.transform(F.split(rest, _BREAK), lambda r: F.struct(F.length(r).alias("n"), F.lower(r).alias("run")))
    found = F.coalesce(F.array_max(runs)["run"], F.lit(""))
    return F.when(pattern.rlike(_UNREAD) | rest.rlike(r"[()\[\]{}]"), F.lit("")).otherwise(found)


def _matching(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """(item, ord, code) where a regular expression is found.

    An expression only meets items that contain its literal.  Those without one are dealt to all items in lists
    of LISTED.
    """
    rules = patterns.select("ord", "code", "pattern", required_literal(F.col("pattern")).alias("literal"))
    found = lambda pattern: F.regexp_like(F.col("item"), F.concat(F.lit("(?i)"), pattern))
    by_literal = _met(items, rules.filter(F.length("literal") >= LITERAL)).filter(found(F.col("pattern")))
    apart = rules.filter(F.length("literal") < LITERAL)
    parts = F.ceil(apart.agg(F.count(F.lit(1))).scalar() / LISTED).cast("int")
    part = F.pmod(F.xxhash64("ord", "code", "pattern"), F.greatest(parts, F.lit(1))).cast("int")
    lists = apart.groupBy(part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("ord", "code", "pattern"))).alias("rules"))
    dealt = items.select("item", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))).alias("part")).join(lists, "part")
    first = F.try_element_at(F.filter("rules", lambda r: found(r["pattern"])), F.lit(1))
    by_list = dealt.select("item", F.explode(F.filter(F.array(first), lambda r: r.isNotNull())).alias("r"))
    return by_literal.select("item", "ord", "code").unionByName(by_list.select("item", "r.ord", "r.code"))


def classify_links(links: DataFrame, patterns: DataFrame) -> DataFrame:
    """Type of each link still unclassified: the first type by order with a matching pattern.

    Host patterns meet distinct hosts, patterns with a path distinct links, by equality on endings and pieces, regular
    expressions by a literal they require; so the work follows the matches, not patterns times links.
    """
    keyed = links.withColumn("host", U.hostname(F.col("link"))).withColumn("full", F.lower("link"))
    todo = keyed.filter(F.coalesce("link_type", F.lit(OTHER_CODE)) == OTHER_CODE)
    of = lambda kind: patterns.filter(F.col("kind") == kind)
    on_path = F.col("pattern").rlike(r"[/?#=]")
    best = lambda found: found.groupBy("item").agg(F.min(F.struct("ord", "code")).alias("best"))
    hosts = todo.select(F.col("host").alias("item")).distinct()
    by_host = best(
        _containing(hosts, of("contains").filter(~on_path)).unionByName(_ending(hosts, of("endswith")))
        .unionByName(_matching(hosts, patterns.filter(~F.col("kind").isin("contains", "endswith"))))
    ).withColumnRenamed("item", "host")
    urls = todo.select(F.col("full").alias("item")).distinct()
    by_url = best(_containing(urls, of("contains").filter(on_path))).toDF("full", "url_best")
    open_type = F.coalesce("link_type", F.lit(OTHER_CODE)) == OTHER_CODE
    return (
        keyed.join(by_host, "host", "left").join(by_url, "full", "left")
        .withColumn("link_type", F.when(
            open_type, F.coalesce(F.least("best", "url_best")["code"], F.lit(OTHER_CODE))
        ).otherwise(F.col("link_type")))
        .drop("host", "full", "best", "url_best")
    )


def link_type_stats(links: DataFrame) -> DataFrame:
    """Links per type, and the classified percentage of the project."""
    counts = links.groupBy("project", "link_type").agg(F.count(F.lit(1)).alias("links"))
    known = F.sum(F.when(F.col("link_type") != OTHER_CODE, F.col("links")).otherwise(0))
    return with_group_total(
        counts, ["project"], all_links=F.sum("links"), known=known
    ).select(
        "project", "link_type", "links",
        SC.ratio(F.col("known") * 100, F.col("all_links"), 1).alias("classified_percent"),
    )


def apply_type_lookup(
    links: DataFrame, lookup: DataFrame, assigned: DataFrame, valid_codes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Fill links still ``oth`` from known host types, then from model-assigned ones.

    ``lookup`` and ``assigned`` are (host, code).  Codes outside ``valid_codes`` are ignored;
    accepted assignments extend the lookup.  Returns (links, lookup); links filled from the model
    carry ``type_source = 'AI'``.
    """
    known = lookup.filter(F.col("code") != OTHER_CODE).select("host", F.col("code").alias("known_code"))
    accepted = (
        assigned.join(valid_codes.select("code").distinct(), "code", "left_semi")
        .join(known, "host", "left_anti")
        .groupBy("host").agg(F.min("code").alias("new_code"))
    )
    open_type = F.coalesce("link_type", F.lit(OTHER_CODE)) == OTHER_CODE
    filled = (
        links.withColumn("host", U.hostname(F.col("link")))
        .join(known, "host", "left").join(accepted, "host", "left")
        .withColumn("type_source", F.when(open_type & F.col("known_code").isNull() & F.col("new_code").isNotNull(), "AI"))
        .withColumn("link_type", F.when(
            open_type, F.coalesce("known_code", "new_code", F.lit(OTHER_CODE))
        ).otherwise(F.col("link_type")))
        .drop("host", "known_code", "new_code")
    )
    extended = lookup.join(accepted, "host", "left_anti").select("host", "code").unionByName(
        accepted.select("host", F.col("new_code").alias("code"))
    )
    return filled, extended


def link_types(links: DataFrame, types: DataFrame) -> DataFrame:
    """One row per type used in a snapshot with its name."""
    used = links.select(*S.SNAPSHOT, F.coalesce("link_type", F.lit(OTHER_CODE)).alias("code")).distinct()
    names = types.select("code", "name").distinct()
    return used.join(names, "code", "left").select(
        *S.SNAPSHOT, "code", F.coalesce("name", F.lit(OTHER_NAME)).alias("name")
    )


def link_domains(links: DataFrame) -> DataFrame:
    """One row per domain of a snapshot with the type of its first link."""
    return (
        links.withColumn("domain", U.hostname(F.col("link"))).filter(F.col("domain") != "")
        .groupBy(*S.SNAPSHOT, "domain")
        .agg(F.min_by(F.coalesce("link_type", F.lit(OTHER_CODE)), "ord").alias("link_type"))
    )


def rollup_links(facts: DataFrame, by: str) -> DataFrame:
    """Link facts (link grain, per model) rolled up to ``link_type`` or ``domain`` and model.

    Rank of a type: rounded mean of the positive ranks, else 999 (per model -1); of a domain:
    their minimum, else -1 (per model absent).  Mention share and influence share are relative to
    the snapshot.
    """
    if by not in ("link_type", "domain"):
        raise ValueError(by)
    df = facts
    if by == "domain":
        df = df.withColumn("domain", U.hostname(F.col("link"))).filter(F.col("domain") != "")
    else:
        df = df.withColumn("link_type", F.coalesce("link_type", F.lit(OTHER_CODE)))
    keys = S.SNAPSHOT + [by]
    placed = F.when(F.col("rank") > 0, F.col("rank"))
    # Sum and count travel together so the entity level can be built from the model level.
    per_model = df.groupBy(*keys, "model_id").agg(
        F.sum("mentions").alias("mentions"), F.sum("influence").alias("influence"),
        F.sum(placed).alias("rank_sum"), F.count(placed).alias("rank_n"), F.min(placed).alias("rank_min"),
    )
    per_key = per_model.groupBy(*keys).agg(
        F.sum("mentions").alias("all_mentions"), F.sum("influence").alias("all_influence"),
        F.sum("rank_sum").alias("all_rank_sum"), F.sum("rank_n").alias("all_rank_n"),
        F.min("rank_min").alias("all_rank_min"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("mentions") > 0, F.col("model_id")))), ",").alias("bots"),
    )
    totals = per_key.groupBy(*S.SNAPSHOT).agg(
        F.sum("all_mentions").alias("snapshot_mentions"), F.sum("all_influence").alias("snapshot_influence")
    )
    model_totals = per_model.groupBy(*S.SNAPSHOT, "model_id").agg(
        F.sum("mentions").alias("by_model_mentions"), F.sum("influence").alias("by_model_influence")
    )
    mean = lambda s, n: F.floor(F.col(s) / F.col(n) + 0.5).cast("long")
    if by == "link_type":
        rank = F.coalesce(F.when(F.col("all_rank_n") > 0, mean("all_rank_sum", "all_rank_n")), F.lit(S.UNKNOWN_RANK))
        model_rank = F.coalesce(F.when(
            (F.col("mentions") > 0) & (F.col("rank_n") > 0), mean("rank_sum", "rank_n")
        ), F.lit(S.NOT_MENTIONED))
    else:
        rank = F.coalesce("all_rank_min", F.lit(S.NOT_MENTIONED))
        model_rank = F.col("rank_min")
    return (
        per_model.join(per_key, keys).join(totals, S.SNAPSHOT).join(model_totals, S.SNAPSHOT + ["model_id"])
        .select(
            *keys, "model_id", "bots",
            F.col("all_mentions").alias("mentions"), F.col("mentions").alias("model_mentions"),
            SC.ratio(F.col("all_mentions"), F.col("snapshot_mentions")).alias("share"),
            SC.ratio(F.col("mentions"), F.col("by_model_mentions")).alias("model_share"),
            rank.cast("long").alias("rank"), model_rank.cast("long").alias("model_rank"),
            SC.ratio(F.col("all_influence"), F.col("snapshot_influence")).alias("influence"),
            SC.ratio(F.col("influence"), F.col("by_model_influence")).alias("model_influence"),
        )
    )


def valid_links(df: DataFrame, link: str = "link") -> DataFrame:
    """Rows whose link has a valid domain."""
    return df.filter(U.is_valid_link(F.col(link)))
