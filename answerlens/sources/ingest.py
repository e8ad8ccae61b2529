"""Reading answers, responses, questions, models and link patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerlens import schemas as S
from answerlens.operators.scale import materialize, ranked, ranked_evenly, running_max
from answerlens.sources.files import list_files, read_texts

_BLOCK = 1024  # rows numbered together in one task
MIN_ANSWER = 200  # fixed value: bytes, and characters once trimmed

# <project>/<question>/answers/<date>/<model>/answer.md, or the folders that Spark writes by these columns
_ANSWER_PATH = (
    r"/(?:project=)?([^/]+)/(?:question_id=)?([^/]+)/(?:answers/|date=)(\d{4}-\d{2}-\d{2})/(?:model_id=)?([^/]+)/[^/]+$"
)


def _file_path() -> Column:
    """Path of the file that a row was read from."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _path_keys(df: DataFrame, path: Column) -> DataFrame:
    part = lambda n: F.regexp_extract(path, _ANSWER_PATH, n)
    return df.select(
        "*", part(1).alias("project"), part(2).alias("question_id"),
        F.to_date(part(3)).alias("date"),
        part(4).alias("model_id"), path.alias("answer_id"),
    ).filter(F.col("project") != "")


def read_answers(spark: SparkSession, path: str, models: DataFrame | None = None, name: str = "answer.md") -> DataFrame:
    """One row per answer file of a name pattern below ``path``; with ``models`` only those of the project.

    Model ids are compared ignoring case.  On a local disk the files are listed and read by the tasks, and the models are
    compared by path before a file is opened.
    """
    kept = lambda answers: keep_models(answers, models) if models is not None else answers
    columns = [*S.SNAPSHOT, "model_id", "answer_id", "text"]
    paths = list_files(spark, path, name)
    if paths is None:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(
            path, wholetext=True
        )
        return kept(_path_keys(files, _file_path()).withColumnRenamed("value", "text").select(columns))
    files = _path_keys(paths, F.concat(F.lit("file:"), F.col("path").cast("string")))
    return read_texts(kept(files), paths.count()).select(columns)


def keep_models(answers: DataFrame, models: DataFrame) -> DataFrame:
    """Rows of the project's models, ids compared ignoring case.

    The models are written first, so that Spark knows how few they are and leaves the answers where they lie.
    """
    allowed = materialize(models.select("project", F.lower("model_id").alias("__id")).distinct())
    return answers.withColumn("__id", F.lower("model_id")).join(
        allowed, ["project", "__id"], "left_semi"
    ).drop("__id")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON responses with their first choice; files that do not parse or lack one are left out."""
    files = (
        spark.read.schema(S.RESPONSE).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )
    return responses_with_choice(_path_keys(files, _file_path()))


def responses_with_choice(df: DataFrame) -> DataFrame:
    """Take ``choices[0].message`` as ``message``; rows without one are dropped."""
    ok = F.col("_corrupt_record").isNull() if "_corrupt_record" in df.columns else F.lit(True)
    message = F.try_element_at("choices", F.lit(1))["message"]
    return df.filter(ok & message.isNotNull()).withColumn("message", message).drop("choices", "_corrupt_record")


def parse_responses(df: DataFrame, column: str = "json") -> DataFrame:
    """Responses held as JSON text in a column, parsed with the declared schema."""
    parsed = F.from_json(F.col(column), S.RESPONSE, {"columnNameOfCorruptRecord": "_corrupt_record"})
    rest = [c for c in df.columns if c != column]
    flat = df.select(*rest, parsed.alias("r")).select(*rest, "r.choices", "r.citations", "r._corrupt_record")
    return responses_with_choice(flat)


def valid_answers(df: DataFrame, minimum: int = MIN_ANSWER) -> DataFrame:
    """Answers of enough bytes, and enough characters once trimmed."""
    return df.filter((F.octet_length("text") >= minimum) & (F.length(F.trim("text")) >= minimum))


def hashed_questions(lines: DataFrame) -> DataFrame:
    """Question lines (project, line_no, line) without blanks and comments, with their hash."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    canonical = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return (
        lines.select("project", "line_no", text.alias("text"))
        .filter((F.col("text") != "") & ~F.col("text").startswith("#"))
        .withColumn("hash", F.substring(F.sha1(canonical), 1, 8))
    )


def ingest_questions(lines: DataFrame, existing: DataFrame) -> DataFrame:
    """New questions of a project with the smallest unused numbers, in line order.

    ``existing`` is (project, hash, question_no).  A question's text counts once.  The k-th new
    question gets the k-th free number; free numbers are counted from the gaps between used ones,
    so no number list is generated.
    """
    firsts = hashed_questions(lines).groupBy("project", "hash").agg(
        F.min("line_no").alias("line_no"), F.min_by("text", "line_no").alias("text")
    )
    fresh = firsts.join(existing.select("project", "hash"), ["project", "hash"], "left_anti")
    block = lambda c: F.floor(F.col(c) / _BLOCK)
    placed = ranked(fresh, ["project"], ["line_no", "hash"], block("line_no"), "k")
    used = existing.select("project", "question_no").distinct().filter(F.col("question_no") > 0)
    # Before the j-th used number u there are u - j free ones; new questions past them move by j.
    gaps = ranked(used, ["project"], ["question_no"], block("question_no"), "j").select(
        "project", (F.col("question_no") - F.col("j") + 1).cast("long").alias("at"), F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("text"),
        F.col("j").alias("shift"),
    )
    steps = placed.select(
        "project", F.col("k").alias("at"), F.lit(1).alias("kind"), "hash", "text",
        F.lit(0).cast("long").alias("shift"),
    ).unionByName(gaps)
    moved = running_max(steps, ["project"], ["at", "kind"], block("at"), "shift")
    return moved.filter(F.col("kind") == 1).select(
        "project", "hash", "text", (F.col("at") + F.col("shift")).alias("question_no")
    )


def resolve_models(models: DataFrame, settings: list[str]) -> DataFrame:
    """Aliases keep their own id and reach and take the target's ``settings``."""
    target = models.select(
        "project", F.col("model_id").alias("alias_of"), *[F.col(c).alias(f"__{c}") for c in settings]
    )
    joined = models.join(target, ["project", "alias_of"], "left")
    for c in settings:
        joined = joined.withColumn(c, F.when(
            F.col("alias_of").isNotNull(), F.coalesce(F.col(f"__{c}"), F.col(c))
        ).otherwise(F.col(c))).drop(f"__{c}")
    return joined


def preset_models(presets: DataFrame) -> DataFrame:
    """(preset, purpose, model_ids array) to one row per model with its place in the list."""
    return presets.select("preset", "purpose", F.posexplode("model_ids").alias("pos", "model_id")).select(
        "preset", "purpose", "model_id", (F.col("pos") + 1).cast("long").alias("ord")
    )


DEFAULT_PATTERN_ORDER = 999  # fixed value


def load_link_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Pattern files (one per type; the file name, or a folder ``code=``, is the code) as a pattern table."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    path_ = F.col("_metadata.file_path")
    folder = F.regexp_extract(path_, r"/code=([^/]+)/[^/]+$", 1)
    code = F.when(folder != "", folder).otherwise(F.regexp_extract(path_, r"([^/]+)\.txt$", 1))
    return parse_link_patterns(files.select(code.alias("code"), F.col("value").alias("body")))


# Marks that make a pattern a regex, or an ending.
_REGEX_MARK = r"[\[\](){}+?|\\^$]|\.\*"
_ENDING_MARK = r"^[*.]"


def parse_link_patterns(files: DataFrame) -> DataFrame:
    """(code, body) to code, name, description, ord, kind, pattern.

    First line: name; second: ``order: N`` (999 if absent); third: description; then one pattern
    per line, ``#`` lines being comments.  Types without a pattern disappear; ``ord`` numbers the
    types by order, then code.
    """
    line = lambda n: F.coalesce(F.trim(F.try_element_at("lines", F.lit(n))), F.lit(""))
    rest = F.filter(
        F.transform(F.slice("lines", F.lit(4), F.greatest(F.lit(0), F.size("lines") - 3)), lambda s: F.trim(s)),
        lambda s: (s != "") & ~F.startswith(s, F.lit("#")),
    )
    order = F.regexp_extract(line(2), r"order:\s*(\d+)", 1)
    typed = files.withColumn("lines", F.split("body", r"\r?\n")).select(
        "code", line(1).alias("name"), F.regexp_replace(line(3), r"^description:\s*", "").alias("description"),
        F.coalesce(order.try_cast("bigint"), F.lit(DEFAULT_PATTERN_ORDER).cast("bigint")).alias("file_order"),
        rest.alias("patterns"),
    ).filter(F.size("patterns") > 0)
    numbered = ranked_evenly(typed.withColumn("all", F.lit(1)), ["all"], F.struct("file_order", "code"), "ord")
    pattern = F.col("pattern")
    return numbered.select("code", "name", "description", "ord", F.explode("patterns").alias("pattern")).select(
        "code", "name", "description", "ord",
        F.when(pattern.rlike(_REGEX_MARK), "regex").when(pattern.rlike(_ENDING_MARK), "endswith")
        .otherwise("contains").alias("kind"),
        # Slashes round a regex and the star of an ending are only marks.
        F.when(pattern.rlike(_REGEX_MARK), F.regexp_replace(pattern, "^/(.*)/$", "$1"))
        .otherwise(F.regexp_replace(pattern, r"^\*", "")).alias("pattern"),
    )


def merge_patterns(base: DataFrame, override: DataFrame) -> DataFrame:
    """Types of ``override`` replace those of the same code, others are added."""
    return base.join(override.select("code").distinct(), "code", "left_anti").unionByName(override)
