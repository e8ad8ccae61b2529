"""Finding entity names in answers.

``answers``: project, question_id, date, model_id, answer_id, text (``answer_id`` is unique).
``entities``: project, question_id[, date], section, entity, ord.

The names of a question go to its answers, never the texts to the names: names are gathered into lists of bounded length per
question, a small table that Spark broadcasts while its size allows, and each text is read once, where it
lies.  A list is looked up by heads that a text must hold: for a plain name the rarest three letters or digits in a row of it,
for a domain its host as a URL of the text gives it, or its first labels.  The heads of a text are extracted once, and
only names whose head is among them are looked at; a name that is absent costs nothing beyond its place in the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerlens import schemas as S
from answerlens.functions import text as TX
from answerlens.functions import urls as U
from answerlens.operators.scale import materialize

# Names of a question that travel in one row.
LIST_NAMES = 512
# Letters and digits one by one: Java looks single characters up in a table, ranges of a class one after another.
_LETTER = "abcdefghijklmnopqrstuvwxyz"
_SIGN = _LETTER + "0123456789"
# URL shapes searched when the name itself is a domain or URL, in lower-cased text.  Inside a run of letters and digits
# none can begin that does not begin with the run, but for a scheme; without a dot behind its first label there is none.
_URL_IN_TEXT = (
    rf"(?:\[[^\]]++\]\((?:https?://)?|(?<![{_SIGN}])(?:https?://)?|https?://)"
    rf"[{_SIGN}][-{_SIGN}_]*+\.(?:[-{_SIGN}._]*\.)?[{_LETTER}]{{2}}[{_LETTER}]*+(?:/[^\s)]*+)?"
)
# Every three letters or digits in a row.
_GRAMS = rf"(?=([{_SIGN}]{{3}}))"
# Labels joined by dots or hyphens, and the numbers of them by which a domain is looked up.
_LABELS = rf"(?<![{_SIGN}_])[{_SIGN}_]++(?:[.-][{_SIGN}_]++)+"
_LABEL_NUMBERS = (2, 3, 4)
# Up to this many heads are searched in a text one by one; from more on its grams are extracted, which costs about as much.
FEW_HEADS = 128
# Letters by how often texts hold them, the most frequent first: of equally rare grams of names the least usual is taken.
_USUAL = "etaoinsrhldcumfpgwybvkxjqz"


def _runs(term: Column, is_url: Column) -> Column:
    """Runs of letters and digits that every matching answer holds.

    Null for a name without any.
    """
    place = F.when(is_url, U.hostname(term)).otherwise(term)
    found = F.array_distinct(F.regexp_extract_all(place, F.lit(r"[a-z0-9]+"), F.lit(0)))
    return TX.bind(found, lambda runs: F.when(F.size(runs) > 0, runs))


def _either(term: Column) -> Column:
    """For names without letters and digits: pieces of which one is in every matching answer."""
    other = F.regexp_extract(term, r"[^\x00-\x7f]", 0)
    # The first other character, or the first byte of its encoding; else any text.
    return F.when(other != "", F.array(other, F.lower(F.substring(F.url_encode(other), 2, 2)))).otherwise(
        F.array(F.lit(""))
    )


def _group_keys(answers: DataFrame, entities: DataFrame) -> list[str]:
    return [k for k in S.SNAPSHOT if k in answers.columns and k in entities.columns]


def search_terms(entities: DataFrame, keys: list[str], whole_word: bool = False) -> DataFrame:
    """Distinct searched names per group: term, is_url, pattern and the runs to find it by.

    Links are searched by their host.
    """
    term = F.when(F.col("section") == "links", F.coalesce(
        F.nullif(U.hostname(F.col("entity")), F.lit("")), F.lower("entity")
    )).otherwise(F.lower("entity"))
    terms = entities.select(*keys, term.alias("term")).filter(F.trim("term") != "").distinct()

    def searched(t: Column) -> Column:
        is_url = TX.is_url_term(t)
        pattern = F.when(is_url, TX.word_bounded(t)).otherwise(TX.term_pattern(t, whole_word))
        return TX.bind(_runs(t, is_url), lambda runs: F.struct(
            is_url.alias("is_url"), pattern.alias("pattern"), runs.isNotNull().alias("choose"),
            F.coalesce(runs, _either(t)).alias("runs"),
        ))

    # One nested value per name keeps the generated code of this small table short.
    return terms.select(*keys, "term", TX.bind(F.col("term"), searched).alias("s")).select(*keys, "term", "s.*")


def _url_heads(term: Column) -> Column:
    """What a text holds wherever it holds a domain or URL: its host as part of a URL, or its first labels.

    The empty head, which every text has, for terms without labels.
    """
    host = F.substring_index(U.normalized_url(term), "/", 1)
    labels = F.regexp_extract(term, r"[a-z0-9_]+(?:[.-][a-z0-9_]+){1,3}", 0)
    return F.when(labels == "", F.array(labels)).otherwise(F.array_distinct(F.array(host, labels)))


def _gram_heads(terms: DataFrame, keys: list[str]) -> DataFrame:
    """The rarest gram among all names of each term; terms without one have no row."""
    grams = F.flatten(F.transform("runs", lambda r: F.regexp_extract_all(r, F.lit(_GRAMS), F.lit(1))))
    each = terms.filter("choose").select(*keys, "term", F.explode(F.array_distinct(grams)).alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    place = lambda k: F.instr(F.lit(_USUAL), F.substring("gram", k, 1))  # 0 for digits, which are left as they come
    rare = place(1) + place(2) + place(3)
    return each.join(counts, "gram").groupBy(*keys, "term").agg(
        F.min_by("gram", F.struct("names", (-rare).alias("rare"), "gram")).alias("gram")
    )


def _lists(terms: DataFrame, keys: list[str], domains: bool) -> DataFrame:
    """The names of each group in lists: heads, and beside each head the names to look at where a text holds it.

    With ``domains`` URL terms go by their host and labels, else by a gram like all others.  Lists are written,
    so that their size is known when the join is planned and the texts need not move.
    """
    number = F.pmod(F.xxhash64("term"), F.ceil(F.col("names") / LIST_NAMES).cast("long")).alias("part")
    counts = terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("names"))
    gram = F.array(F.coalesce("gram", F.lit("")))
    heads = F.when(F.col("is_url"), _url_heads(F.col("term"))).otherwise(gram) if domains else gram
    headed = terms.join(_gram_heads(terms, keys), [*keys, "term"], "left").join(counts, keys)
    name = F.struct("term", "is_url", "pattern", "choose", "runs")
    per_head = headed.select(*keys, number, F.explode(heads).alias("head"), name.alias("name")).groupBy(*keys, "part", "head").agg(
        F.collect_list("name").alias("names")
    )
    listed = per_head.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("head", "names"))).alias("l"))
    return materialize(listed.select(
        *keys, F.transform("l", lambda x: x["head"]).alias("heads"), F.transform("l", lambda x: x["names"]).alias("named"),
        F.exists("l", lambda x: F.exists(x["names"], lambda n: n["is_url"])).alias("domains"),
        F.exists("l", lambda x: F.exists(x["names"], lambda n: ~n["is_url"])).alias("plain"),
    ))


def url_table(low: Column) -> Column:
    """array<struct(pos, len, url)> of the URLs in a lower-cased text, normalised; found once for all names."""
    # The URL of a markdown link begins behind the first "](", as its title holds no bracket.
    url = lambda m: F.when(F.startswith(m, F.lit("[")), F.substring(m, F.instr(m, "](") + 2, F.length(m))).otherwise(m)
    return TX.bind(TX.pieces(low, F.lit(_URL_IN_TEXT)), lambda cut: F.transform(TX.spans(cut), lambda h, k: F.struct(
        h["pos"].alias("pos"), h["len"].alias("len"), U.normalized_url(url(F.get(cut, 2 * k + 1))).alias("url")
    )))


def _words(low: Column) -> Column:
    """The distinct words of a text: any piece without a blank is in them if it is in the text, and most are repeated."""
    return F.array_join(F.array_distinct(F.split(low, " ")), " ")


def _label_heads(words: Column) -> Column:
    """All runs of a few labels that begin and end with a label."""
    joint = F.filter(F.split(words, " "), lambda w: w.contains(".") | w.contains("-"))
    joined = F.array_join(F.regexp_extract_all(F.array_join(joint, " "), F.lit(_LABELS), F.lit(0)), " ")
    runs = lambda n: rf"(?<![{_SIGN}_])(?=([{_SIGN}_]++(?:[.-][{_SIGN}_]++){{{n - 1}}}))"
    return TX.bind(joined, lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(runs(n)), F.lit(1)) for n in _LABEL_NUMBERS]))


def _looked_up(words: Column, heads: Column, domains: bool, few: bool) -> Column:
    """The names of a list whose head is among those of the text, and that it can hold; ``heads`` and ``words`` are the text's.

    With ``few`` heads the text's are those of domains alone, and grams are searched in its words.
    """
    present = F.array_intersect("heads", heads)
    if few:
        short = F.filter("heads", lambda h: (F.length(h) <= 3) & words.contains(h))
        present = F.array_union(present, short) if domains else short
    names = F.flatten(F.transform(present, lambda h: F.get("named", (F.array_position("heads", h) - 1).cast("int"))))
    holds = lambda r: words.contains(r)
    tested = lambda n: F.when(n["choose"], F.forall(n["runs"], holds)).otherwise(F.exists(n["runs"], holds))
    possible = F.filter(names, (lambda n: n["is_url"] | tested(n)) if domains else tested)
    return F.transform(F.array_distinct(possible) if domains else possible, lambda n: F.struct(
        n["term"].alias("term"), n["is_url"].alias("is_url"), n["pattern"].alias("pattern")
    ))


def _if_any(names: Column) -> Column:
    """Rows with names only.  A filter would be pushed below the column and compute it twice."""
    return F.explode(F.filter(F.array(names), lambda x: F.size(x) > 0))


def _gram_texts(words: Column) -> Column:
    return F.concat(F.array(F.lit("")), F.regexp_extract_all(words, F.lit(_GRAMS), F.lit(1)))


def _few(lists: DataFrame) -> bool:
    return (lists.agg(F.max(F.size("heads"))).first()[0] or 0) <= FEW_HEADS


def with_candidates(texts: DataFrame, terms: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Add ``terms``, the names of the row's group that its text may hold, as array<struct(term, is_url, pattern)>.

    A row comes once for each list of its group that has such a name.  Every name that occurs in the text at all is among them.
    """
    lists = _lists(terms, keys, False).select(*keys, "heads", "named")
    few = _few(lists)
    placed = texts.withColumn("__words", _words(F.lower(text)))
    placed = placed.withColumn("__heads", F.array(F.lit("")) if few else _gram_texts(F.col("__words")))
    found = _looked_up(F.col("__words"), F.col("__heads"), False, few)
    return placed.join(lists, keys).withColumn("terms", _if_any(found)).drop("heads", "named", "__words", "__heads")


def candidate_pairs(answers: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(answer_id, terms) of ``with_candidates``, one row per answer."""
    found = with_candidates(answers, terms, keys, F.col("text")).select("answer_id", F.explode("terms").alias("t"))
    return found.groupBy("answer_id").agg(F.collect_set("t").alias("terms"))


def domain_spans(text: Column, urls: Column, term: Column, pattern: Column) -> Column:
    """array<struct(pos, len)> for a domain name or URL in a text with its ``url_table``.

    URLs in the text count when, normalised, they equal the term or one is a path-prefix of the
    other; plain occurrences count unless they lie inside a counted URL.
    """
    same = lambda u, t: (u == t) | F.startswith(u, F.concat(t, F.lit("/"))) | F.startswith(t, F.concat(u, F.lit("/")))
    matched = TX.bind(U.normalized_url(term), lambda t: F.transform(
        F.filter(urls, lambda u: same(u["url"], t)), lambda u: F.struct(u["pos"].alias("pos"), u["len"].alias("len"))
    ))

    def with_plain(found: Column) -> Column:
        ends = F.transform(found, lambda m: F.struct(m["pos"].alias("pos"), (m["pos"] + m["len"]).alias("end")))
        plain = TX.bind(ends, lambda e: F.filter(TX.hits(text, pattern), lambda p: ~TX.bind(
            p["pos"] + p["len"], lambda end: F.exists(e, lambda m: (m["pos"] <= p["pos"]) & (m["end"] >= end))
        )))
        return F.array_sort(F.concat(found, plain))

    return TX.bind(matched, with_plain)


def domain_hits(text: Column, term: Column, pattern: Column) -> Column:
    """``domain_spans`` of a text whose URLs are not known yet."""
    return TX.bind(url_table(text), lambda urls: domain_spans(text, urls, term, pattern))


def _possessive(term: Column) -> Column:
    return TX.word_bounded(F.concat(term, F.lit("'s")))


def _has_possessive(text: Column, term: Column, any_: Column | None = None) -> Column:
    """``any_`` tells whether the text has a possessive form of anything."""
    own = (F.length(term) > 3) & ~term.contains(".") & text.contains(F.concat(term, F.lit("'s")))
    return own if any_ is None else any_ & own


def _with_extra(hits: Column, possessive: Column) -> Column:
    """Hits and those possessive forms that none of them counts."""
    return F.array_sort(F.concat(hits, F.filter(
        possessive, lambda p: ~F.exists(hits, lambda m: F.abs(m["pos"] - p["pos"]) < 2)
    )))


def name_hits(text: Column, term: Column, pattern: Column) -> Column:
    """array<struct(pos, len)> for a plain name, including possessive forms not yet counted."""
    main = TX.hits(text, pattern)
    extra = lambda hits: _with_extra(hits, TX.hits(text, _possessive(term)))
    return F.when(_has_possessive(text, term), TX.bind(main, extra)).otherwise(main)


def first_name_hits(text: Column, term: Column, pattern: Column, k: int, any_: Column | None = None) -> Column:
    """The first ``k`` of ``name_hits``, found without the rest.

    A possessive form holds the name, so a hit lies in or over each; up to the k-th hit there are at most two for every one.
    """
    main = TX.first_hits(text, pattern, k)
    extra = lambda hits: F.slice(_with_extra(hits, TX.first_hits(text, _possessive(term), 2 * k + 2)), 1, k)
    return F.when(_has_possessive(text, term, any_), TX.bind(main, extra)).otherwise(main)


def _searched(answers: DataFrame, entities: DataFrame, whole_word: bool) -> DataFrame:
    """Answers with ``low``, ``masked`` (null if only domains are looked for), ``urls`` and the ``terms`` to search, a row for each list."""
    keys = _group_keys(answers, entities)
    lists = _lists(search_terms(entities, keys, whole_word), keys, True)
    # URLs are only looked for where some name is one, grams where some is none.
    domains, plain = (bool(x) for x in lists.agg(F.max("domains"), F.max("plain")).first())
    placed = answers.select(*S.SNAPSHOT, "model_id", "answer_id", "text", F.lower("text").alias("low"))
    placed = placed.withColumn("urls", url_table(F.col("low")) if domains else F.lit(None))
    placed = placed.withColumn("__words", _words(F.col("low")))
    few = plain and _few(lists)
    heads = _gram_texts(F.col("__words")) if plain and not few else F.array(F.lit(""))
    if domains:
        hosts = F.transform("urls", lambda u: F.substring_index(u["url"], "/", 1))
        heads = F.concat(heads, hosts, _label_heads(F.col("__words")))
    met = placed.withColumn("__heads", heads).join(lists.drop("domains", "plain"), keys)
    met = met.withColumn("terms", _if_any(_looked_up(F.col("__words"), F.col("__heads"), domains, few)))
    return met.withColumn("masked", F.when(F.exists("terms", lambda t: ~t["is_url"]), TX.mask_link_urls(F.col("low")))).select(
        *S.SNAPSHOT, "model_id", "answer_id", "text", "low", "masked", "urls", "terms"
    )


def _counted(rows: DataFrame, whole_word: bool):
    """Function of a name and whether the text has possessives: struct(mentions, pos) of the name in a row of ``_searched``."""
    domains = rows.schema["urls"].dataType.typeName() == "array"
    low, masked = F.col("low"), F.col("masked")
    listed = lambda spans: F.struct(F.size(spans).alias("mentions"), F.get(spans, F.lit(0))["pos"].alias("pos"))

    def first(t: Column, found: Column) -> Column:
        # Without boundaries a name is found wherever the text of its first match stands.
        if not whole_word:
            return F.instr(masked, F.get(found, F.lit(0)))
        return F.length(F.get(F.split(masked, t["pattern"], 2), F.lit(0))) + 1

    def of_name(t: Column, any_: Column) -> Column:
        counted = TX.bind(F.regexp_extract_all(masked, t["pattern"], F.lit(0)), lambda found: F.struct(
            F.size(found).alias("mentions"), F.when(F.size(found) > 0, first(t, found)).alias("pos")
        ))
        return F.when(
            _has_possessive(masked, t["term"], any_), TX.bind(name_hits(masked, t["term"], t["pattern"]), listed)
        ).otherwise(counted)

    def of_any(t: Column, any_: Column) -> Column:
        if not domains:
            return of_name(t, any_)
        of_domain = TX.bind(domain_spans(low, F.col("urls"), t["term"], t["pattern"]), listed)
        return F.when(t["is_url"], of_domain).otherwise(of_name(t, any_))

    return of_any


def match_entities(answers: DataFrame, entities: DataFrame, whole_word: bool = False) -> DataFrame:
    """(answer, term) pairs with mentions > 0: number of hits and offset of the first.

    All names of a list are measured on the row of the text, which never multiplies by them.
    For the all-questions level pass answers and entities whose ``question_id`` is the combined
    one (see ``entities.combine_questions``).
    """
    rows = _searched(answers, entities, whole_word)
    counted = _counted(rows, whole_word)
    measured = lambda any_: lambda t: TX.bind(counted(t, any_), lambda f: F.struct(
        t["term"].alias("term"), f["mentions"].cast("long").alias("mentions"), f["pos"].cast("long").alias("pos")
    ))
    each = TX.bind(F.col("masked").contains("'s"), lambda any_: F.transform("terms", measured(any_)))
    found = F.filter(each, lambda f: f["mentions"] > 0)
    return rows.select(*S.SNAPSHOT, "model_id", "answer_id", F.explode(found).alias("f")).select(
        *S.SNAPSHOT, "model_id", "answer_id", "f.term", "f.mentions", "f.pos"
    )


def hit_spans(answers: DataFrame, entities: DataFrame, whole_word: bool = False) -> DataFrame:
    """Every hit of a term's own pattern: hit_no, pos, hit_len."""
    rows = _searched(answers, entities, whole_word)
    spans = F.transform("terms", lambda t: F.struct(
        t["term"].alias("term"),
        TX.hits(F.when(t["is_url"], F.col("low")).otherwise(F.col("masked")), t["pattern"]).alias("hits"),
    ))
    each = rows.select(*S.SNAPSHOT, "model_id", "answer_id", F.explode(spans).alias("s"))
    return each.select(*S.SNAPSHOT, "model_id", "answer_id", "s.term", F.posexplode("s.hits").alias("n", "h")).select(
        *S.SNAPSHOT, "model_id", "answer_id", "term", (F.col("n") + 1).cast("long").alias("hit_no"),
        F.col("h.pos").cast("long").alias("pos"), F.col("h.len").cast("long").alias("hit_len"),
    )


def _cut(rows: DataFrame, k: int, context: int):
    """Function of a name and what is known of the text: its first ``k`` hits in a row of ``_searched``, cut out of the text."""
    domains = rows.schema["urls"].dataType.typeName() == "array"
    text = F.col("text")

    def found(t: Column, any_: Column) -> Column:
        names = first_name_hits(F.col("masked"), t["term"], t["pattern"], k, any_)
        if not domains:
            return names
        return F.when(t["is_url"], F.slice(domain_spans(F.col("low"), F.col("urls"), t["term"], t["pattern"]), 1, k)).otherwise(names)

    cut = lambda of: lambda h: F.struct(
        h["pos"].cast("long").alias("pos"), TX.excerpt(text, h["pos"], h["len"], context).alias("excerpt"),
        TX.line_and_column(of, h["pos"]).alias("at"),
    )
    return lambda t, w: F.transform(found(t, w["any"]), cut(w["layout"]))


def _whole() -> Column:
    """What is found out once for all names of a text: its lines, and whether it has possessives."""
    return F.struct(TX.layout(F.col("text")).alias("layout"), F.col("masked").contains("'s").alias("any"))


def _each_hit(listed: DataFrame) -> DataFrame:
    return listed.select(*S.SNAPSHOT, "model_id", "answer_id", "term", F.posexplode("hits").alias("i", "h")).select(
        *S.SNAPSHOT, "model_id", "answer_id", "term", (F.col("i") + 1).cast("long").alias("hit_no"),
        "h.pos", "h.excerpt", "h.at.line", "h.at.col",
    )


def excerpts(
    answers: DataFrame,
    entities: DataFrame,
    k: int = TX.EXCERPTS_PER_ANSWER,
    context: int = TX.EXCERPT_CONTEXT,
) -> DataFrame:
    """First ``k`` hits of each term in each answer with surrounding text, line and column.

    Hits of a name are stepped through and end with the k-th, however many there are.
    """
    rows = _searched(answers, entities, False)
    cut = _cut(rows, k, context)
    each = TX.bind(_whole(), lambda w: F.transform("terms", lambda t: F.struct(t["term"].alias("term"), cut(t, w).alias("hits"))))
    return _each_hit(rows.select(*S.SNAPSHOT, "model_id", "answer_id", F.explode(each).alias("e")).select(
        *S.SNAPSHOT, "model_id", "answer_id", "e.term", "e.hits"
    ))


def matches_and_excerpts(
    answers: DataFrame,
    entities: DataFrame,
    k: int = TX.EXCERPTS_PER_ANSWER,
    context: int = TX.EXCERPT_CONTEXT,
) -> tuple[DataFrame, DataFrame]:
    """``match_entities`` and ``excerpts`` from one reading of the texts, whose result is written."""
    rows = _searched(answers, entities, False)
    counted, cut = _counted(rows, False), _cut(rows, k, context)
    # Two columns, since lambdas in one are resolved a level at a time.
    measured = lambda any_: lambda t: TX.bind(counted(t, any_), lambda f: F.struct(
        t["term"].alias("term"), t["is_url"].alias("is_url"), t["pattern"].alias("pattern"),
        f["mentions"].cast("long").alias("mentions"), f["pos"].cast("long").alias("pos"),
    ))
    each = TX.bind(F.col("masked").contains("'s"), lambda any_: F.transform("terms", measured(any_)))
    rows = rows.withColumn("found", F.filter(each, lambda f: f["mentions"] > 0))
    listed = TX.bind(_whole(), lambda w: F.transform("found", lambda t: F.struct(
        t["term"].alias("term"), t["mentions"].alias("mentions"), t["pos"].alias("pos"), cut(t, w).alias("hits")
    )))
    listed = materialize(rows.select(*S.SNAPSHOT, "model_id", "answer_id", F.explode(listed).alias("f")).select(
        *S.SNAPSHOT, "model_id", "answer_id", "f.*"
    ))
    return listed.drop("hits"), _each_hit(listed)
