"""Snapshot store and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerlens import schemas as S
from answerlens.operators.enrich import in_model_order

BUNDLE_ANSWERS = 64


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write snapshots by date and question, replacing only the partitions present in ``df``.

    Rebalancing splits a large partition over several files and merges small ones.
    """
    (
        df.hint("rebalance", "date", "question_id").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("date", "question_id").parquet(path)
    )


def read_snapshot(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read the store; filters on date and question prune partitions."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).withColumn("question_id", F.col("question_id").cast("string"))


def answer_bundle(answers: DataFrame, per_row: int = BUNDLE_ANSWERS) -> DataFrame:
    """Answers nested as question → date → model → text, in rows of at most ``per_row`` answers."""
    placed = in_model_order(answers)
    cell = F.struct("model_id", "answer_id", "text")
    return placed.groupBy(*S.SNAPSHOT, F.floor((F.col("__n") - 1) / per_row).cast("long").alias("part_no")).agg(
        F.sort_array(F.collect_list(cell)).alias("answers")
    )


def write_answer_bundle(answers: DataFrame, path: str) -> None:
    """JSON lines by project and question; the folder of a project is its combined bundle."""
    rows = answer_bundle(answers)
    models = F.transform("answers", lambda a: F.struct(a["model_id"].alias("model"), a["text"].alias("text")))
    rows.select("project", "question_id", "date", "part_no", models.alias("answers")).write.mode("overwrite").partitionBy(
        "project", "question_id"
    ).json(path)


def trend_export_rows(history: DataFrame) -> DataFrame:
    """Columns of the trend export: means with two digits, scores with three."""
    return history.select(
        "project", F.col("section").alias("category"), F.col("entity").alias("Name"),
        F.col("first_seen").alias("First Seen"), F.col("last_seen").alias("Last Seen"),
        F.col("total_mentions").alias("Total Mentions"),
        F.format_string("%.2f", "average_mentions").alias("Average Mentions"),
        F.col("peak_mentions").alias("Peak Mentions"), F.col("peak_date").alias("Peak Date"),
        F.col("trend").alias("Trend"), F.format_string("%.3f", "trend_score").alias("Trend Score"),
    )


def trend_export_summary(history: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per project: date range, number of reports and of tracked items."""
    items = history.groupBy("project").agg(F.count(F.lit(1)).alias("items"))
    spans = metrics.groupBy("project").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.countDistinct("date").alias("reports")
    )
    return spans.join(items, "project")


def export_trends(history: DataFrame, metrics: DataFrame, path: str, fmt: str = "json") -> None:
    """Trend report as JSON, or as CSV with a summary and one folder per category."""
    base = path.rstrip("/")
    if fmt == "json":
        history.write.mode("overwrite").partitionBy("project").json(f"{base}/items")
        trend_export_summary(history, metrics).write.mode("overwrite").json(f"{base}/summary")
    elif fmt == "csv":
        trend_export_rows(history).write.mode("overwrite").partitionBy("project", "category").option(
            "header", True
        ).csv(f"{base}/categories")
        trend_export_summary(history, metrics).write.mode("overwrite").option("header", True).csv(f"{base}/summary")
    else:
        raise ValueError(fmt)


def export_view_csv(view: DataFrame, path: str) -> None:
    """Rows of a view as fully quoted CSV with raw values; arrays become comma lists."""
    flat = [
        F.array_join(F.col(n).cast("array<string>"), ",").alias(n) if t.startswith("array") else F.col(n)
        for n, t in view.dtypes
    ]
    view.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).csv(path)
