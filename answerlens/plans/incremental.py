"""A build that measures only the snapshots whose answers, names or level it has not measured yet.

The store holds one folder per measured table and one for the manifest, each with a folder ``build_no=N`` per run.  A run
writes its tables first and its manifest rows last, so a run that breaks off leaves nothing behind that a later one
reads.  Nothing is overwritten: the newest manifest row of a snapshot says which run's rows are valid.  One run at
a time may write to a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from answerlens import schemas as S
from answerlens.operators import entities as E
from answerlens.operators.scale import materialize, ranked_evenly, remove, written
from answerlens.plans.build import derive, measure

_MANIFEST = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("question_id", T.StringType()),
    T.StructField("date", T.DateType()), T.StructField("inputs", T.StringType()), T.StructField("build_no", T.IntegerType()),
])


def _exists(spark: SparkSession, path: str) -> bool:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """(project, question_id, date, inputs, build_no): the newest finished run of each snapshot; empty for a new store."""
    if not _exists(spark, f"{store}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    rows = spark.read.schema(_MANIFEST).parquet(f"{store}/manifest")
    return rows.groupBy(*S.SNAPSHOT).agg(F.max_by("inputs", "build_no").alias("inputs"), F.max("build_no").alias("build_no"))


def with_carried(entities: DataFrame, dates: DataFrame, n: int = E.HISTORY_DATES) -> DataFrame:
    """Dated entities and those of the ``n`` complete dates before that a date lacks, placed behind its own.

    ``dates`` lists the complete (project, date).  What was itself carried is not carried further, so the result of a date
    depends on the extracted names of its window alone, whenever it is built.
    """
    if "type" not in entities.columns:
        entities = entities.withColumn("type", F.expr("substring(section, 1, length(section) - 1)"))
    carried = E.carry_forward(entities, entities, dates, n)
    last = entities.groupBy(*S.SECTION).agg(F.max("ord").alias("__last"))
    numbers = entities.groupBy("project", "question_id").agg(F.max("question_no").alias("question_no"))
    placed = (
        ranked_evenly(carried, S.SECTION, F.struct("entity"), "__n").join(last, S.SECTION, "left")
        .join(numbers, ["project", "question_id"])
        .withColumn("ord", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long"))
    )
    columns = [*S.ENTITY, "ord", "question_no"]
    return entities.select(*columns).unionByName(placed.select(*columns))


def _print(df: DataFrame, keys: list[str], columns: list[str], out: str) -> DataFrame:
    """Number and sum of the hashes of the rows of a group, which any added, lost or changed row alters."""
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
    return df.groupBy(*keys).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total).alias(out))


def inputs_of(answers: DataFrame, entities: DataFrame, version: list[str], combined: bool = True) -> DataFrame:
    """(project, question_id, date, inputs): what the measures of each snapshot are made from; reads no text.

    ``version`` are the answer columns that change whenever an answer does.
    """
    told = _print(answers, S.SNAPSHOT, version, "__a")
    named = _print(entities, S.SNAPSHOT, ["section", "entity", "ord"], "__e")
    single = told.join(named, S.SNAPSHOT, "left").select(
        *S.SNAPSHOT, F.concat_ws("|", "__a", F.coalesce("__e", F.lit("0"))).alias("inputs")
    )
    if not combined:
        return single
    # The level of all questions is made from all of a date's, also in their order.
    order = entities.groupBy("project", "question_id").agg(F.max("question_no").alias("__no"))
    level = _print(
        single.join(order, ["project", "question_id"], "left"), ["project", "date"], ["question_id", "inputs", "__no"], "inputs"
    )
    return single.unionByName(level.select("project", F.lit(S.ALL_QUESTIONS).alias("question_id"), "date", "inputs"))


def build_new(
    answers: DataFrame, entities: DataFrame, models: DataFrame, patterns: DataFrame, store: str,
    dates: DataFrame | None = None, version: list[str] = ["model_id", "answer_id"], combined: bool = True,
) -> dict[str, DataFrame]:
    """The tables of ``build``, but texts are read only of snapshots that are new to the store or whose inputs changed.

    ``entities`` has ``question_no`` and may be dated; with ``dates`` (complete dates, ``complete_dates``) dated names are
    carried forward.  An answer counts as changed when one of its ``version`` columns does, so give a file's time or a
    text's digest where answers are edited in place.  Snapshots that ``answers`` no longer has leave the tables.  Models
    and link patterns may change without a new measure: weights, types and trends follow from what is stored.
    Sources and citations are not stored; ``build`` has them.
    """
    spark = answers.sparkSession
    store = store.rstrip("/")
    before = set(written())
    if "date" not in entities.columns:
        entities = answers.select(*S.SNAPSHOT).distinct().join(entities, ["project", "question_id"])
    elif dates is not None:
        entities = with_carried(entities, dates)
    entities = materialize(entities.select(*S.ENTITY, "ord", "question_no"))
    wanted = materialize(inputs_of(answers, entities, version, combined))
    known = manifest(spark, store)
    open_ = materialize(wanted.join(known, [*S.SNAPSHOT, "inputs"], "left_anti"))
    # One entry per calendar day, so that files of finished dates are not even opened.
    days = [r.date for r in open_.select("date").distinct().collect()]
    if days:
        build_no = (known.agg(F.max("build_no")).first()[0] or 0) + 1
        recent = answers.filter(F.col("date").isin(days))
        single = open_.filter(F.col("question_id") != S.ALL_QUESTIONS).select(*S.SNAPSHOT)
        level = open_.filter(F.col("question_id") == S.ALL_QUESTIONS).select("project", "date")
        of = lambda df, keys, columns: df.join(keys, columns, "left_semi")
        whole = (
            E.combined_answers(of(recent, level, ["project", "date"])),
            E.combine_questions(of(entities, level, ["project", "date"])),
        ) if combined else (None, None)
        parts = measure(of(recent, single, S.SNAPSHOT), of(entities, single, S.SNAPSHOT), *whole)
        for name, rows in parts.items():
            rows.hint("rebalance").write.mode("overwrite").parquet(f"{store}/{name}/build_no={build_no}")
        open_.write.mode("overwrite").parquet(f"{store}/manifest/build_no={build_no}")
    elif not _exists(spark, f"{store}/manifest"):
        raise ValueError("no answers to build from and nothing stored")
    finished = [path for path in written() if path not in before]
    valid = materialize(wanted.join(manifest(spark, store), [*S.SNAPSHOT, "inputs"]).select(*S.SNAPSHOT, "build_no"))
    remove(spark, finished)
    stored = [
        spark.read.parquet(f"{store}/{n}").join(valid, [*S.SNAPSHOT, "build_no"], "left_semi").drop("build_no")
        for n in ("hits", "links", "excerpts")
    ]
    return derive(*stored, models, patterns)
