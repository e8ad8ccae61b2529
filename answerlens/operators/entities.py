"""Entity tables: ingest, combination over questions, carry-forward, dates and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from answerlens import schemas as S
from answerlens.operators.scale import ranked_evenly
from answerlens.operators.trends import earlier_values

HISTORY_DATES = 10  # fixed value: earlier complete dates searched


def explode_entities(raw: DataFrame) -> DataFrame:
    """Per-section string arrays (columns named like sections) to one row per entity.

    Only strings of two or more characters that are not blank; unknown sections are ignored.  The
    item type is the section name without its last letter.
    """
    sections = [s for s in S.ENTITY_SECTIONS if s in raw.columns]
    arrays = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("items")) for s in sections])
    keys = [c for c in raw.columns if c not in S.ENTITY_SECTIONS]
    return (
        raw.select(*keys, F.explode(arrays).alias("s"))
        .select(*keys, F.col("s.section").alias("section"), F.posexplode("s.items").alias("pos", "entity"))
        .filter((F.length("entity") > 1) & (F.trim("entity") != ""))
        .select(
            *keys, "section", "entity", (F.col("pos") + 1).cast("long").alias("ord"),
            F.expr("substring(section, 1, length(section) - 1)").alias("type"),
        )
    )


def empty_keys(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys for which there is no row at all; a non-empty result is an error."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def assert_non_empty(expected: DataFrame, present: DataFrame, keys: list[str]) -> None:
    """Raise when a key has no rows, naming up to five of them."""
    missing = empty_keys(expected, present, keys).limit(5).collect()
    if missing:
        raise ValueError(f"no rows for {[tuple(r) for r in missing]}")


def combine_questions(entities: DataFrame) -> DataFrame:
    """All-questions level: one row per lower-cased name and section, the first occurrence kept.

    Needs ``question_no``; the result carries the combined question id.
    """
    keys = [k for k in ("project", "date") if k in entities.columns] + ["section", "key"]
    first = F.min_by(
        F.struct("entity", "ord", "question_no"), F.struct("question_no", "ord", "entity")
    )
    return (
        entities.withColumn("key", F.lower("entity")).groupBy(*keys).agg(first.alias("f"))
        .select(
            *[k for k in keys if k != "key"], F.lit(S.ALL_QUESTIONS).alias("question_id"),
            F.col("f.entity").alias("entity"),
            # Order of the union: by question, then place in it.
            (F.shiftleft(F.col("f.question_no").cast("long"), 32) + F.col("f.ord")).alias("ord"),
        )
    )


def combined_answers(answers: DataFrame) -> DataFrame:
    """All answers re-keyed to the combined question, to be matched with its entities."""
    return answers.withColumn("question_id", F.lit(S.ALL_QUESTIONS))


def carry_forward(current: DataFrame, history: DataFrame, dates: DataFrame, n: int = HISTORY_DATES) -> DataFrame:
    """Entities of up to ``n`` earlier complete dates that are absent now, newest spelling first.

    ``dates`` lists (project, date) of complete dates; each current (project, date) looks back
    over the newest ``n`` before it.
    """
    order = Window.partitionBy("project").orderBy("date")
    numbered = dates.select("project", "date").distinct().withColumn("no", F.row_number().over(order))
    now = current.select("project", "date").distinct().join(numbered, ["project", "date"])
    key = F.lower(F.trim("entity"))
    # A dated row is offered to each of the next n dates that is being built.
    offered = (
        history.join(numbered, ["project", "date"])
        .withColumnRenamed("date", "seen")
        .withColumn("no", F.explode(F.sequence(F.col("no") + 1, F.col("no") + n)))
        .join(now, ["project", "no"])
        .withColumn("key", key)
    )
    item = ["project", "question_id", "date", "section", "key"]
    newest = offered.groupBy(*item).agg(
        F.max_by(F.struct("entity", "type"), F.struct("seen", "entity")).alias("e")
    )
    present = current.select("project", "question_id", "date", "section", key.alias("key"))
    return newest.join(present, item, "left_anti").select(
        "project", "question_id", "date", "section", F.col("e.entity").alias("entity"), F.col("e.type").alias("type")
    )


def complete_dates(answers: DataFrame, questions: DataFrame, models: DataFrame) -> DataFrame:
    """(project, date) on which every question has an answer from every model of the project."""
    wanted = (
        questions.groupBy("project").agg(F.countDistinct("question_id").alias("q"))
        .join(models.groupBy("project").agg(F.countDistinct("model_id").alias("m")), "project")
        .select("project", (F.col("q") * F.col("m")).alias("wanted"))
    )
    listed = answers.select("project", "question_id", "model_id", "date").join(
        questions.select("project", "question_id").distinct(),
        ["project", "question_id"], "left_semi",
    ).join(
        models.select("project", "model_id").distinct(), ["project", "model_id"], "left_semi"
    )
    # Distinct cells first, so a date with many answers is spread over (question, model).
    got = listed.distinct().groupBy("project", "date").agg(F.count(F.lit(1)).alias("got"))
    return got.join(wanted, "project").filter(F.col("got") == F.col("wanted")).select("project", "date")


def resolve_date(dates: DataFrame, spec: str | None = None) -> DataFrame:
    """Target date per project: newest, ``-N`` = N-th newest, or an explicit complete date.

    Projects without such a date are missing from the result.
    """
    if spec is not None and not spec.startswith("-"):
        return dates.filter(F.col("date") == F.lit(spec).cast("date")).select("project", "date").distinct()
    nth = 1 if spec is None else int(spec[1:])
    order = Window.partitionBy("project").orderBy(F.desc("date"))
    return (
        dates.select("project", "date").distinct()
        .withColumn("no", F.row_number().over(order)).filter(F.col("no") == nth)
        .select("project", "date")
    )


def snapshot_status(answers: DataFrame, compiled: DataFrame, enriched: DataFrame) -> DataFrame:
    """Each known (project, date): complete (enriched), incomplete (compiled only) or missing."""
    keys = ["project", "date"]
    flag = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(True))
    joined = (
        flag(answers, "answered").join(flag(compiled, "compiled"), keys, "full_outer")
        .join(flag(enriched, "enriched"), keys, "full_outer").fillna(False)
    )
    status = F.when(F.col("enriched"), "complete").when(F.col("compiled"), "incomplete").otherwise("missing")
    return joined.select(*keys, status.alias("status"))


def previous_snapshots(snapshots: DataFrame, n: int = 3) -> DataFrame:
    """(project, question_id, date, prev_date): the newest ``n`` snapshots before each one."""
    return earlier_values(snapshots.select(*S.SNAPSHOT).distinct(), [], n)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot date per question."""
    return snapshots.groupBy("project", "question_id").agg(F.max("date").alias("date"))


NAME_FIELDS = ["value", "name", "keyword", "title", "label", "text", "link"]  # fixed values


def needs_attribute(
    df: DataFrame, attr: str, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """Rows whose attribute is missing or blank, with the item's name and a running id in item order."""
    value = F.trim(F.coalesce(F.col(attr).cast("string"), F.lit("")))
    rows = df.filter(value == "")
    if include:
        rows = rows.filter(F.col("section").isin(include))
    if exclude:
        rows = rows.filter(~F.col("section").isin(exclude))
    names = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in NAME_FIELDS if c in df.columns]
    named = rows.withColumn("item_name", F.coalesce(*names)).filter(F.col("item_name").isNotNull())
    return ranked_evenly(named, S.SECTION, F.struct("ord", "item_name"), "item_no")
