"""Term patterns, masking, positions, excerpts and sentences as column expressions.

Offsets are 1-based.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters a separator run in a name may stand for in running text.
SEPARATORS = r"[\s\u00a0\u2000-\u200a\u202f\u3000\-_.,;:!?'\"()\[\]{}]"
# Characters left as they are by percent-encoding.
UNENCODED = r"[A-Za-z0-9\-_.!~*'()]"
# Word boundary over ASCII word characters only (Java's \b also counts accented letters).
ASCII_BOUNDARY = (
    r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def word_bounded(term: Column) -> Column:
    """Quoted pattern of a term between ASCII word boundaries.

    What lies before is looked at behind the term, so that the pattern begins with its text and Java leaps to it.
    """
    before = F.when(term.rlike("^[A-Za-z0-9_]"), F.lit("(?<![A-Za-z0-9_]")).otherwise(F.lit("(?<=[A-Za-z0-9_]"))
    after = F.when(term.rlike("[A-Za-z0-9_]$"), F.lit("(?![A-Za-z0-9_])")).otherwise(F.lit("(?=[A-Za-z0-9_])"))
    return bind(regex_quote(term), lambda quoted: F.concat(quoted, before, quoted, F.lit(")"), after))


# Excerpt size.
EXCERPTS_PER_ANSWER = 5
EXCERPT_CONTEXT = 100


def regex_quote(c: Column) -> Column:
    """Backslash-escape ASCII punctuation."""
    return F.regexp_replace(c, r"([!-/:-@\[-`{-~])", r"\\$1")


def _encoded(c: Column) -> Column:
    return (
        F.when(c.rlike("^" + UNENCODED + "$"), c)
        .when(c == " ", F.lit("%20"))
        .otherwise(F.lower(F.url_encode(c)))
    )


def _char_alternatives(run: Column) -> Column:
    chars = F.filter(F.split(run, ""), lambda c: c != "")
    return F.array_join(
        F.transform(
            chars,
            lambda c: F.when(c == _encoded(c), regex_quote(c)).otherwise(
                F.concat(F.lit("(?:"), regex_quote(c), F.lit("|"), regex_quote(_encoded(c)), F.lit(")"))
            ),
        ),
        "",
    )


def term_pattern(term: Column, whole_word: bool = False) -> Column:
    """Java pattern for a lower-cased name.

    Letters and digits match themselves.  A run of ASCII separators also matches any separator
    run, or its percent-encoded form; other characters match themselves or their encoding.
    There are no word boundaries unless ``whole_word``.
    """
    runs = F.regexp_extract_all(F.lower(term), F.lit(r"([a-z0-9]+|[^a-z0-9]+)"), 1)
    body = F.array_join(
        F.transform(
            runs,
            lambda r: F.when(r.rlike("^[a-z0-9]"), r)
            .when(r.rlike(r"[^\x00-\x7f]"), _char_alternatives(r))
            .otherwise(F.concat(F.lit(f"(?:{SEPARATORS}+|"), _char_alternatives(r), F.lit(")"))),
        ),
        "",
    )
    if whole_word:
        return F.concat(F.lit(ASCII_BOUNDARY), body, F.lit(ASCII_BOUNDARY))
    return body


def is_url_term(term: Column) -> Column:
    """Names with a dot and no blank are searched as domains or URLs."""
    return term.contains(".") & ~term.contains(" ")


def mask_link_urls(text: Column) -> Column:
    """Overwrite the URL of each ``[text](url)`` with ``#``, keeping all offsets."""
    masked = F.regexp_replace(text, r"(?:(\[[^\]]+\]\((?=[^)]+\)))|\G(?!^))[^)]", "$1#")
    return F.when(text.contains("]("), masked).otherwise(text)


_SPANS = "cast(array() as array<struct<pos:int,len:int>>)"


# Set on both sides of each match where a text is cut; one that holds it itself is cut by two scans.
_MARK = "\ue000"


def pieces(text: Column, pattern: Column) -> Column:
    """array<string>: gap, match, gap, … gap of a text, found in one scan."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    twice = F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda gap, match: F.when(
        match.isNull(), F.array(gap)
    ).otherwise(F.array(gap, match))))
    return F.when(text.contains(_MARK), twice).otherwise(marked)


def hits(text: Column, pattern: Column) -> Column:
    """array<struct(pos, len)> of all non-overlapping matches in order."""
    return bind(pieces(text, pattern), spans)


def spans(cut: Column) -> Column:
    """``hits`` of a text in its ``pieces``.

    Offsets are running sums.  They are formed in blocks of about the root of their number, first inside each block
    and then over the blocks, since every append copies its array.
    """
    steps = F.transform(F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)), lambda k: F.struct(
        F.length(F.get(cut, k - 1)).alias("gap"), F.length(F.get(cut, k)).alias("len")
    ))

    def run(block: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.expr(_SPANS).alias("out"))
        return F.aggregate(block, start, lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["len"]).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + s["gap"]).alias("pos"), s["len"].alias("len"))).alias("out"),
        ))

    def joined(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        shifts = F.aggregate(blocks, start, lambda acc, b: F.struct(
            (acc["at"] + b["at"] - 1).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")
        ), lambda acc: acc["out"])
        return bind(shifts, lambda by: F.flatten(F.transform(blocks, lambda b, k: F.transform(b["out"], lambda h: F.struct(
            (h["pos"] + F.get(by, k)).alias("pos"), h["len"].alias("len")
        )))))

    def in_blocks(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(all_), size)
        return bind(F.transform(firsts, lambda k: run(F.slice(all_, k, size))), joined)

    return F.when(F.size(cut) == 1, F.expr(_SPANS)).otherwise(
        bind(steps, lambda s: F.when(F.size(s) <= 64, run(s)["out"]).otherwise(in_blocks(s)))
    )


def first_hits(text: Column, pattern: Column, k: int) -> Column:
    """The first ``k`` of ``hits``: the text is cut ``k`` times at most, and only what lies before the last cut is measured.

    One more character is kept, since a pattern may look at it.
    """
    cuts = F.split(text, pattern, k + 1)
    before = lambda parts: F.substring(text, F.lit(1), F.length(text) - F.length(F.element_at(parts, F.lit(-1))) + 1)
    return bind(bind(cuts, lambda parts: F.when(F.size(parts) > k, before(parts)).when(F.size(parts) > 1, text)), lambda part: F.when(
        part.isNull(), F.expr(_SPANS)
    ).otherwise(F.slice(hits(part, pattern), 1, k)))


def hit_positions(text: Column, pattern: Column) -> Column:
    """Start offsets of all matches."""
    return F.transform(hits(text, pattern), lambda h: h["pos"])


def excerpt(text: Column, pos: Column, length: Column, context: int = EXCERPT_CONTEXT) -> Column:
    """Text around a hit, trimmed."""
    start = F.greatest(F.lit(1), pos - context)
    return F.trim(F.substring(text, start, pos + length + context - start))


def layout(text: Column) -> Column:
    """struct(chars, breaks) of a text: its length and the offsets of its line breaks, by which ``line_and_column`` finds places."""
    return F.struct(F.length(text).alias("chars"), hit_positions(text, F.lit("\n")).alias("breaks"))


def line_and_column(of: Column, pos: Column) -> Column:
    """struct(line, col), both 1-based, of an offset in the text with a ``layout``."""
    before = F.size(F.filter(of["breaks"], lambda b: b < pos))
    return bind(before, lambda n: F.struct(
        (n + 1).cast("long").alias("line"),
        (F.least(pos - 1, of["chars"]) - F.coalesce(F.get(of["breaks"], n - 1), F.lit(0)) + 1).cast("long").alias("col"),
    ))


# Abbreviations whose dots do not end a sentence.
_KEEP_DOT = r"(Mr|Mrs|Ms|Dr|Prof)\."
_DROP_DOTS = [(r"U\.S\.", "US"), (r"U\.K\.", "UK"), (r"e\.g\.", "eg"), (r"i\.e\.", "ie")]
_DOT = "[DOT]"


def split_sentences(text: Column) -> Column:
    """array<string>: cut at list items, then after ``.!?`` followed by blanks and a capital."""
    guarded = F.regexp_replace(text, _KEEP_DOT, "$1\\" + _DOT.replace("]", "\\]"))
    for pattern, plain in _DROP_DOTS:
        guarded = F.regexp_replace(guarded, pattern, plain)
    parts = F.split(guarded, r"\n(?=[-*]|\d+\.)\s*|(?<=[.!?])\s+(?=[A-Z])")
    restored = F.transform(parts, lambda p: F.trim(F.replace(p, F.lit(_DOT), F.lit("."))))
    return F.filter(restored, lambda p: F.length(F.regexp_replace(p, r"\s+", "")) > 0)
