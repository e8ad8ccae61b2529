"""A training-data pipeline over ``documents``: each stage's result is written as Parquet and read as the next one's input."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerlens.llm.forest import distinct_documents
from answerlens.llm.mixing import mix_sources
from answerlens.llm.packing import pack
from answerlens.llm.quality import repetition_rules
from answerlens.llm.substrings import remove_repeats
from answerlens.llm.tables import row_key, small_batches
from answerlens.operators.scale import remove, written
from answerlens.session import shared_dir

_PREVIOUS: list[str] = []


def _stage(work):
    """A stage that first removes the intermediates of the stage before, whose result is written by then."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        remove(spark, _PREVIOUS)
        before = set(written())
        out = work(spark, docs, sf_dir)
        _PREVIOUS[:] = [path for path in written() if path not in before]
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the repetition rules reject.

    Verdict and text come out of the same row, so repeated ids are judged row by row.
    """
    return repetition_rules(docs, keep_rows=True)


@_stage
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays; rows that only share a doc_id, or have none, all do."""
    return distinct_documents(docs)


@_stage
def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the windows that an earlier document holds; texts without a loss stay as they are.

    A text that lost words is its kept words joined by one space; ``n_chars`` follows.  Documents left empty go.
    """
    others = {f"__k{k}": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    plain = docs.select("doc_id", "text", *[F.col(c).alias(a) for a, c in others.items()])
    out = remove_repeats(plain, keep=list(others), with_text=True).filter("n_removed < n_words")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(a) for a, c in others.items()}
    if "n_chars" in columns:
        length = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(columns["n_chars"])
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, also where rows share an id or have none."""
    key = row_key(docs.columns)
    # Rows equal in all columns are one, with the copies of all.
    copies = mix_sources(docs, key).groupBy(F.col("row").alias("__row")).agg(F.sum("copies").alias("__copies"))
    one = docs.withColumn("__row", key).dropDuplicates(["__row"])
    # The keys grow with the documents, so they are merged at every size and never broadcast.
    taken = one.join(copies.filter("__copies > 0").hint("merge"), "__row")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences."""
    return pack(docs)


STAGES = [
    ("quality", quality), ("near_duplicate", near_duplicate), ("substring", substring), ("mixing", mixing),
    ("packing", packing),
]

#: Near-duplicates by minhash, pivotal draws and tokenizers have no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; intermediates go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/corpus_pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
