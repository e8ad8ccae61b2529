"""Preparing and merging the batches a model works on, and links, summaries and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerlens import schemas as S
from answerlens.functions import text as TX
from answerlens.functions import urls as U
from answerlens.operators.matching import _group_keys, candidate_pairs, search_terms, with_candidates
from answerlens.operators.scale import materialize, ranked_evenly

# Domain endings tried for a name, in this order.
ENDINGS = [".com", ".org", ".ai", ".io"]
# Items per request.
BATCH_LINK_TYPES, BATCH_LINKS, BATCH_SIMILAR = 15, 20, 30
MAX_SIMILAR = 3  # fixed value
CACHE_TTL = 2_592_000  # fixed value: seconds
# Request fields that differ between identical requests.
VOLATILE_FIELDS = [
    "x-request-id", "request-id", "requestId", "trace-id", "traceId", "span-id", "spanId",
    "timestamp", "requestTimestamp",
]
ANSWERS_PER_PART = 64


def entity_links_from_answers(entities: DataFrame, answers: DataFrame) -> DataFrame:
    """(entity keys, link): target of the first markdown link whose text contains the name.

    Only entities without a link.  Names meet link texts, answers are
    taken in ``answer_id`` order.
    """
    todo = entities.filter(F.trim(F.coalesce("link", F.lit(""))) == "") if "link" in entities.columns else entities
    keys = _group_keys(answers, todo)
    found = F.regexp_extract_all("text", F.lit(U.MARKDOWN_LINK), F.lit(0))
    links = (
        answers.select(*S.SNAPSHOT, F.col("answer_id").alias("__answer"), F.posexplode(found).alias("pos", "md"))
        .select(
            *S.SNAPSHOT, "__answer", "pos",
            F.regexp_extract("md", U.MARKDOWN_LINK, 1).alias("text"),
            F.trim(F.regexp_extract("md", U.MARKDOWN_LINK, 2)).alias("url"),
        )
        .filter(F.startswith("url", F.lit("http")))
        .withColumn("answer_id", F.struct("__answer", "pos"))
    )
    named = todo.withColumn("section_", F.col("section")).withColumn("section", F.lit("name"))
    terms = search_terms(named, keys)
    pairs = with_candidates(links, terms, keys, F.col("text")).withColumn(
        "term", F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"])))
    ).filter(F.lower("text").contains(F.col("term")))
    best = pairs.groupBy(*S.SNAPSHOT, "term").agg(F.min_by("url", "answer_id").alias("link"))
    wanted = todo.select(*keys, "section", "entity", F.lower("entity").alias("term"))
    return best.join(wanted, keys + ["term"]).select(*S.ENTITY, "link")


def entity_links_from_domains(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(entity keys, link): the name without blanks plus a usual ending, if a link has that domain."""
    keys = [k for k in S.SNAPSHOT if k in entities.columns and k in links.columns]
    domains = links.select(*keys, U.domain_of(U.clean_url(F.col("link"))).alias("domain")).distinct()
    name = F.lower(F.replace("entity", F.lit(" "), F.lit("")))
    guesses = entities.select(
        *keys, "section", "entity",
        F.posexplode(F.array(*[F.concat(name, F.lit(e)) for e in ENDINGS])).alias("ord", "domain"),
    )
    return guesses.join(domains, keys + ["domain"]).groupBy(*keys, "section", "entity").agg(
        F.min_by("domain", "ord").alias("link")
    )


def build_batches(items: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Items (``item_no``, ``item_name``) in batches of ``size``, rendered ``id,value`` per line."""
    placed = ranked_evenly(items, keys, F.struct("item_no", "item_name"), "__n")
    line = F.concat(F.col("item_no").cast("string"), F.lit(","), F.col("item_name"))
    return (
        placed.withColumn("batch_no", F.floor((F.col("__n") - 1) / size).cast("long"))
        .groupBy(*keys, "batch_no")
        .agg(F.count(F.lit(1)).alias("items"), F.sort_array(F.collect_list(F.struct("__n", line.alias("line")))).alias("l"))
        .select(*keys, "batch_no", "items", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("request"))
    )


def in_model_order(answers: DataFrame) -> DataFrame:
    """Number a snapshot's answers by model and id."""
    place = F.struct("model_id", F.col("answer_id").cast("string").alias("id"))
    return ranked_evenly(answers, S.SNAPSHOT, place, "__n")


def answer_context(answers: DataFrame, per_part: int = ANSWERS_PER_PART) -> DataFrame:
    """Answers of a snapshot as ``<answer>`` blocks in model order.

    A prompt is the parts in order; each part holds up to ``per_part`` answers, so the answers of
    one question never have to meet in one row.
    """
    block = F.concat(
        F.lit('<answer model_id="'), F.col("model_id"), F.lit('">\n'), F.col("text"),
        F.lit('\n</answer model_id="'), F.col("model_id"), F.lit('">'),
    )
    placed = in_model_order(answers)
    return (
        placed.select(*S.SNAPSHOT, "__n", block.alias("block"), F.floor((F.col("__n") - 1) / per_part).cast("long").alias("part_no"))
        .groupBy(*S.SNAPSHOT, "part_no")
        .agg(F.count(F.lit(1)).alias("answers"), F.sort_array(F.collect_list(F.struct("__n", "block"))).alias("b"))
        .select(*S.SNAPSHOT, "part_no", "answers", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("context"))
    )


def summary_context(summaries: DataFrame, per_part: int = ANSWERS_PER_PART) -> DataFrame:
    """Question summaries of a project and date as one text, in parts like ``answer_context``."""
    keys = ["project", "date"]
    line = F.concat(
        F.lit('The summary of answers from AIs to the question: "'), F.col("question"), F.lit('":\n'),
        F.col("summary"), F.lit("\n\n"),
    )
    present = summaries.filter(F.trim(F.coalesce("summary", F.lit(""))) != "")
    placed = ranked_evenly(present, keys, F.struct("question_id"), "__n")
    return (
        placed.select(*keys, "__n", line.alias("line"), F.floor((F.col("__n") - 1) / per_part).cast("long").alias("part_no"))
        .groupBy(*keys, "part_no").agg(F.sort_array(F.collect_list(F.struct("__n", "line"))).alias("l"))
        .select(*keys, "part_no", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("context"))
    )


def request_key(model: Column, request: Column) -> Column:
    """Model id and md5 of the request (a string map) with sorted keys and no volatile fields."""
    kept = F.filter(F.map_entries(request), lambda e: ~e["key"].isin(VOLATILE_FIELDS))
    canonical = F.to_json(F.map_from_entries(F.array_sort(kept)))
    return F.concat(model, F.lit("::"), F.md5(canonical))


def split_cached(requests: DataFrame, cache: DataFrame, now: Column, ttl: int = CACHE_TTL) -> tuple[DataFrame, DataFrame]:
    """(answered, open) requests by a cache of (key, value, ts).

    An entry counts up to ``ttl`` seconds, one without time (0) always; ``ttl`` 0 turns the cache
    off.  The newest entry of a key wins.
    """
    keyed = requests.withColumn("key", request_key(F.col("model_id"), F.col("request")))
    fresh = F.lit(ttl > 0) & ((F.coalesce("ts", F.lit(0)) == 0) | (now - F.col("ts") <= ttl))
    live = cache.filter(fresh).groupBy("key").agg(F.max_by("value", "ts").alias("value"))
    return keyed.join(live, "key"), keyed.join(live.select("key"), "key", "left_anti")


def merge_attribute(items: DataFrame, results: DataFrame, attr: str, keys: list[str]) -> DataFrame:
    """Fill a missing link-like attribute from model results (keys + ``value``).

    Kept where present; ``unknown`` and invalid links are refused.  ``sources`` (a string map)
    records the model as origin.
    """
    valid = results.filter((F.col("value") != "unknown") & U.is_valid_link(F.col("value"))).select(
        *keys, F.col("value").alias("__new")
    )
    missing = F.trim(F.coalesce(F.col(attr), F.lit(""))) == ""
    fill = missing & F.col("__new").isNotNull()
    joined = items.join(valid, keys, "left")
    base = F.col("sources") if "sources" in items.columns else F.expr("cast(map() as map<string,string>)")
    kept = F.map_filter(F.coalesce(base, F.expr("cast(map() as map<string,string>)")), lambda k, v: k != attr)
    marked = F.map_concat(kept, F.create_map(F.lit(attr), F.lit("AI")))
    return joined.withColumn("sources", F.when(fill, marked).otherwise(base)).withColumn(
        attr, F.when(fill, F.col("__new")).otherwise(F.col(attr))
    ).drop("__new")


def merge_similar(existing: Column, new: Column, most: int = MAX_SIMILAR) -> Column:
    """csv of existing terms, then new ones, each once, at most three."""
    old = F.filter(F.transform(F.split(F.coalesce(existing, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.array_join(F.slice(F.array_distinct(F.concat(old, new)), 1, most), ",")


def _id_pattern(names: Column) -> Column:
    """One pattern for all ids of array<struct(model_id, display_name)>, the longest first.

    Ids that begin with a letter or digit share one look at the character before and one at the first of theirs, so at most
    places of a text no id is tried.
    """
    by_size = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n["model_id"])).alias("size"), n["model_id"].alias("id"))))
    after = lambda i: F.when(i.rlike("[A-Za-z0-9_]$"), F.lit("(?![A-Za-z0-9_])")).otherwise(F.lit("(?=[A-Za-z0-9_])"))

    def of(rows: Column, before: str) -> Column:
        firsts = F.array_join(F.array_distinct(F.transform(rows, lambda r: TX.regex_quote(F.left(r["id"], F.lit(1))))), "")
        each = F.array_join(F.transform(rows, lambda r: F.concat(TX.regex_quote(r["id"]), after(r["id"]))), "|")
        return F.when(F.size(rows) > 0, F.concat(F.lit(before + "(?=["), firsts, F.lit("])(?:"), each, F.lit(")")))

    word = lambda r: r["id"].rlike("^[A-Za-z0-9_]")
    return TX.bind(by_size, lambda rows: F.concat_ws(
        "|", of(F.filter(rows, word), "(?<![A-Za-z0-9_])"), of(F.filter(rows, lambda r: ~word(r)), "(?<=[A-Za-z0-9_])")
    ))


def _shown_names(names: Column) -> Column:
    """struct(ids, shown): the pattern of all ids and a map to their names; null without ids."""
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.struct(
        _id_pattern(names).alias("ids"),
        F.map_from_entries(F.transform(names, lambda r: F.struct(r["model_id"], r["display_name"]))).alias("shown"),
    ))


def clean_summary(text: Column, names: Column) -> Column:
    """Strip broken HTML attributes, show model names for ids (longest first), squeeze blanks.

    ``names`` is struct(ids, shown) of ``_shown_names`` or null.  All ids are found in one pass and looked up in a map.
    Runs of blanks are entered at their beginning only, so long ones cost no more than their length.
    """
    c = F.regexp_replace(text, r'(?:(?<!\s)\s++)?+(title|alt|data-[a-z-]+)="[^"]*">', ">")
    c = F.regexp_replace(c, r'"\s*+>', "")

    def named(t: Column) -> Column:
        return TX.bind(
            F.regexp_extract_all(t, F.concat(F.lit("("), names["ids"], F.lit(")")), F.lit(1)),
            lambda found: F.array_join(F.transform(F.split(t, names["ids"], -1), lambda p, i: F.concat(
                p, F.coalesce(F.try_element_at(names["shown"], F.get(found, i)), F.lit(""))
            )), ""),
        )

    c = TX.bind(c, lambda t: F.when(names.isNotNull(), named(t)).otherwise(t))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n(?:[\s&&[^\n]]*+\n){2,}+", "\n\n")
    return F.regexp_replace(c, r"^\s+|(?<!\s)\s++$", "")


def clean_summaries(df: DataFrame, models: DataFrame, column: str = "summary") -> DataFrame:
    """Clean a summary column with the model names of each row's project.

    Of several names for an id the last by code point is shown; empty ids are never replaced.  The pattern of a project's
    ids is made once and written, so that it goes to the texts and they stay where they lie.
    """
    known = models.filter("model_id <> ''").groupBy("project", "model_id").agg(F.max("display_name").alias("display_name"))
    listed = known.groupBy("project").agg(F.collect_list(F.struct("model_id", "display_name")).alias("names"))
    names = materialize(listed.select("project", _shown_names(F.col("names")).alias("__names")))
    return df.join(names, "project", "left").withColumn(column, clean_summary(F.col(column), F.col("__names"))).select(*df.columns)


def entity_index(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Names of more than two characters by lower-cased form, the longest original kept."""
    return (
        entities.filter(F.length("entity") > 2).withColumn("value", F.lower(F.trim("entity")))
        .groupBy(*keys, "value")
        .agg(F.max_by(F.struct(F.trim("entity").alias("original"), "section"),
                      F.struct(F.length("entity"), "entity", "section")).alias("e"))
        .select(*keys, "value", "e.original", F.expr("substring(e.section, 1, length(e.section) - 1)").alias("type"))
    )


_SKIP_OPEN = r"(?i)^<(code|pre|script|style|a)(?:[\s>/]|$)"
_SKIP_CLOSE = r"(?i)^</(code|pre|script|style|a)\s*>"


def annotate_text(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """Wrap names in HTML text, outside code, pre, script, style and a elements.

    In each text segment only the longest name that occurs is wrapped, everywhere in it.  A
    text is tested only for names it can hold.
    """
    keys = _group_keys(texts, entities)
    index = entity_index(entities, keys)
    named = index.select(*keys, F.lit("name").alias("section"), F.col("value").alias("entity"))
    candidates = candidate_pairs(texts.select("answer_id", *keys, "text"), search_terms(named, keys), keys)
    pairs = candidates.select("answer_id", F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("value"))
    known = texts.select("answer_id", *keys).join(pairs, "answer_id").join(index, keys + ["value"])
    names = known.groupBy("answer_id").agg(F.sort_array(F.collect_set(F.struct(
        (-F.length("original")).alias("rank"), "value", "original", "type"
    ))).alias("names"))
    bounded = lambda t: F.concat(F.lit("(?i)"), TX.word_bounded(t))
    tokens = F.regexp_extract_all("text", F.lit(r"<[^>]*>|[^<]+|<"), F.lit(0))
    # Per token whether it is text outside the skipped elements.
    start = F.struct(F.lit(0).alias("depth"), F.expr("cast(array() as array<struct<t:string,open:boolean>>)").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        opens = t.rlike(_SKIP_OPEN) & ~t.rlike(r"/>$")
        depth = acc["depth"] + F.when(opens, 1).when(t.rlike(_SKIP_CLOSE), -1).otherwise(0)
        item = F.struct(t.alias("t"), (~F.startswith(t, F.lit("<")) & (acc["depth"] == 0)).alias("open"))
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), F.array_append(acc["out"], item).alias("out"))

    def wrap(segment: Column) -> Column:
        # Names are sorted longest first; the plain test spares most of the pattern matching.
        fits = lambda low: F.filter(
            "names", lambda n: low.contains(n["value"]) & F.regexp_like(segment, bounded(n["original"]))
        )
        return TX.bind(TX.bind(F.lower(segment), fits), lambda names: TX.bind(
            F.try_element_at(names, F.lit(1)), lambda n: F.when(n.isNull(), segment).otherwise(_marked(segment, n, bounded))
        ))

    pieces = F.transform(F.aggregate(tokens, start, step, lambda acc: acc["out"]),
                         lambda x: F.when(x["open"], wrap(x["t"])).otherwise(x["t"]))
    joined = texts.join(names, "answer_id", "left")
    return joined.withColumn(
        "text", F.when(F.col("names").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text"))
    ).drop("names")


def _marked(segment: Column, name: Column, bounded) -> Column:
    mark = F.concat(
        F.lit('<span class="clickable-entity" data-entity-type="'), name["type"],
        F.lit('" data-entity-value="'), F.regexp_replace(name["value"], r"([\\$])", r"\\$1"), F.lit('">$0</span>'),
    )
    return F.regexp_replace(segment, bounded(name["original"]), mark)
