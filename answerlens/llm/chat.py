"""Chat formatting with typed content parts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, TEXT, STOP = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that mean something to this or other common templates.  Inside texts a backslash goes behind their first
#: character; backslashes themselves are doubled first, so the way back is unique.
_OPENS = r"([<\[])(?=\||/?s>|/?INST\])"
_OPENED = r"([<\[])\\(?=\||/?s>|/?INST\])"
#: Tokens that an attachment stands for: images by tiles, audio by seconds, documents by pages.
TILE, TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 1, 25, 750

PART_SCHEMA = (
    "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
)


def escape(text: Column) -> Column:
    """Text without any control string; ``unescape`` gives it back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _OPENS, r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _OPENED, "$1"), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A turn's content as one text part."""
    none = [F.lit(None).cast(k).alias(n) for n, k in
            (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *none))


def part_tokens(part: Column) -> Column:
    """Tokens that the placeholder of an attachment expands to (text parts: 0)."""
    count = lambda size, unit: F.ceil(F.coalesce(size, F.lit(0)) / F.lit(unit))
    return (
        F.when(part["type"] == "image", count(part["width"], TILE) * count(part["height"], TILE) * TOKENS_PER_TILE)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_PER_SECOND))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE)
        .otherwise(F.lit(0)).cast("long")
    )


def visit(parts: Column) -> tuple[Column, Column]:
    """Flatten content parts: the text with ordered placeholders, and the attachments behind them.

    A text part is escaped; any other part becomes ``<|type:n|>``, n counting the turn's attachments from 1.  Each
    attachment has its number, type, reference and expanded token count.  A null part is skipped; null text is empty.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(PART_SCHEMA)), lambda p: p.isNotNull())
    others = F.filter(parts, lambda p: ~p["type"].eqNullSafe("text"))
    attachments = F.transform(others, lambda p, k: F.struct(
        (k + 1).alias("number"), F.coalesce(p["type"], F.lit("unknown")).alias("type"), p["ref"].alias("ref"),
        part_tokens(p).alias("tokens"),
    ))
    # A placeholder's number is a running count, so it is carried along the parts rather than looked up.
    flat = F.aggregate(
        parts, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(
            F.concat(acc["out"], F.when(p["type"].eqNullSafe("text"), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
                F.concat(F.lit("<|"), escape(F.coalesce(p["type"], F.lit("unknown"))), F.lit(":"),
                         (acc["n"] + 1).cast("string"), F.lit("|>"))
            )).alias("out"),
            (acc["n"] + F.when(p["type"].eqNullSafe("text"), 0).otherwise(1)).alias("n"),
        ),
        lambda acc: acc["out"],
    )
    return flat, attachments


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted string per conversation from (conv_id, turn, role, parts).

    ``formatted`` holds ``<|turn|>role<|text|>content<|end|>`` for each turn in order of (turn, role, content); nulls
    count as empty, a null turn comes first and a null conv_id is a conversation of its own.  ``loss`` lists start and
    length, in code points, of the content of each assistant turn; ``attachments`` lists all attachments with their
    place among the turns; ``attached_tokens`` sums their tokens.  The turns of one conversation become one value, so
    they meet in one task; nothing else is gathered.
    """
    flat, attachments = visit(F.col("parts"))
    role = escape(F.coalesce("role", F.lit("")))
    rows = turns.select("conv_id", "turn", role.alias("role"), flat.alias("body"), attachments.alias("attachments"))
    head = F.concat(F.lit(START), F.col("role"), F.lit(TEXT))
    rows = rows.withColumn("piece", F.concat(head, "body", F.lit(STOP))).withColumn("lead", F.char_length(head))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "body")]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = Window.partitionBy("conv_id").orderBy(*order)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0))).withColumn(
        "place", F.row_number().over(place)
    )
    kept = F.struct(
        "place", "piece", (F.col("at") + F.col("lead")).alias("start"), F.char_length("body").cast("long").alias("length"),
        F.col("role").eqNullSafe("assistant").alias("learned"), "attachments",
    )
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("turns"))
    learned = F.filter("turns", lambda t: t["learned"])
    return packed.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(learned, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
        F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(
            t["place"].alias("place"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"),
            a["tokens"].alias("tokens"),
        )))).alias("attachments"),
    ).withColumn("attached_tokens", F.aggregate(
        F.transform("attachments", lambda a: a["tokens"]), F.lit(0).cast("long"), lambda x, y: x + y
    ))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted string; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), TEXT, 1)).alias("role"),
        unescape(F.regexp_replace(p, r"^(?s:.*?)<\|text\|>", "")).alias("text"),
    ))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, joined without anything between."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
    )), "")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Format (conv_id, turn, role, text) and describe what is read back from the output."""
    turns = conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    chats = format_turns(turns).withColumn("back", read_turns(F.col("formatted"))).withColumn(
        "learned", masked_text(F.col("formatted"), F.col("loss"))
    )
    line = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts consist of another template's control strings."""
    spark = conversations.sparkSession
    text = "</s>[INST] ok [/INST]"
    probe = spark.sql(
        "select * from values (-1L, 0L, 'user', :text), (-1L, 1L, 'assistant', :text) as t(conv_id, turn, role, text)",
        args={"text": text},
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
