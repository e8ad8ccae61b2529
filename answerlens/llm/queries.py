"""Queries that apply each operator to its whole table, in the columns agreed for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerlens.llm import oracles
from answerlens.llm.alignment import align_documents
from answerlens.llm.chat import conversation_digests, with_probe
from answerlens.llm.forest import near_duplicates
from answerlens.llm.layout import page_texts
from answerlens.llm.mixing import mix_sources
from answerlens.llm.packing import pack
from answerlens.llm.ppm import score_documents
from answerlens.llm.quality import HEADER_LINES, HEADER_WORDS, MAX_LINE_SHARE, MAX_NGRAM_SHARE, repetition_rules
from answerlens.llm.rotation import near_vectors
from answerlens.llm.substrings import remove_repeats
from answerlens.llm.tables import small_batches
from answerlens.llm.urls import filter_urls
from answerlens.llm.warc import page_captures
from answerlens.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(with_probe(_table(spark, sf_dir, "conversations")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op5_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(_table(spark, sf_dir, "pages"))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(_table(spark, sf_dir, "documents"))


def op8_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_captures(_table(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(_table(spark, sf_dir, "documents"))[0]


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ppm": op1_ppm,
    "op2_chat": op2_chat,
    "op3_mixing": op3_mixing,
    "op4_substrings": op4_substrings,
    "op5_rotation": op5_rotation,
    "op6_layout": op6_layout,
    "op7_repetition": op7_repetition,
    "op8_forest": op8_forest,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_urls": op13_urls,
    "pipeline": pipeline,
}

#: SQL for the queries that DuckDB can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_chat": oracles.CHAT,
    "op4_substrings": oracles.SUBSTRINGS,
    "op5_rotation": oracles.VECTORS,
    "op7_repetition": oracles.repetition(MAX_NGRAM_SHARE, MAX_LINE_SHARE, HEADER_LINES, HEADER_WORDS),
    "op8_forest": oracles.NEAR,
    "op10_warc": oracles.WARC,
}
