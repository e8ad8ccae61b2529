"""Sources, stores and whole plans."""

import datetime as dt
import json

from pyspark.sql import functions as F

from answerlens.catalog.registry import Inputs
from answerlens.operators import trends as T
from answerlens.plans.build import build
from answerlens.plans.compare import trend_report
from answerlens.sources import ingest as I
from answerlens.sources import stores as ST

SF = "/root/testdata/sf0.001"


def test_read_answers_and_models(spark, tmp_path):
    for q, m, text in [("1-a", "GPT", "hello\nworld"), ("1-a", "other", "x"), ("2-b", "gpt", "y")]:
        d = tmp_path / "proj" / q / "answers" / "2024-01-02" / m
        d.mkdir(parents=True)
        (d / "answer.md").write_text(text)
    models = spark.createDataFrame([("proj", "gpt")], "project string, model_id string")
    rows = I.read_answers(spark, str(tmp_path), models).collect()
    assert sorted((r.question_id, r.model_id, r.text) for r in rows) == [("1-a", "GPT", "hello\nworld"), ("2-b", "gpt", "y")]
    assert {r.date for r in rows} == {dt.date(2024, 1, 2)}


def test_read_responses(spark, tmp_path):
    bodies = {"m1": json.dumps({"choices": [{"message": {"content": "c"}}], "citations": ["u"]}), "m2": "{broken", "m3": json.dumps({"choices": []})}
    for m, body in bodies.items():
        d = tmp_path / "proj" / "1-a" / "answers" / "2024-01-02" / m
        d.mkdir(parents=True)
        (d / "answer.json").write_text(body)
    rows = I.read_responses(spark, str(tmp_path)).collect()
    assert [(r.model_id, r.message.content, r.citations) for r in rows] == [("m1", "c", ["u"])]


def test_link_patterns(spark, tmp_path):
    (tmp_path / "vid.txt").write_text("Video\norder: 2\ndescription: moving\n# no\ntube\n*.tv\n^v[0-9]+\n")
    (tmp_path / "blg.txt").write_text("Blog\norder: 1\n\n.blog\nsite.com/blog\n")
    (tmp_path / "nil.txt").write_text("Empty\norder: 0\n\n# none\n")
    rows = I.load_link_patterns(spark, str(tmp_path)).orderBy("ord", "pattern").collect()
    assert [(r.code, r.ord, r.kind, r.pattern) for r in rows] == [
        ("blg", 1, "endswith", ".blog"), ("blg", 1, "contains", "site.com/blog"),
        ("vid", 2, "endswith", ".tv"), ("vid", 2, "regex", "^v[0-9]+"), ("vid", 2, "contains", "tube"),
    ]


def test_snapshot_store_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    metrics = Inputs(spark, SF).metrics
    ST.write_snapshot(metrics, path)
    one = metrics.filter("question_id = 'q1' and date = date'1996-03-01'").withColumn("mentions", F.lit(0).cast("long"))
    ST.write_snapshot(one, path)
    back = ST.read_snapshot(spark, path)
    assert back.count() == metrics.count()
    assert back.filter("mentions = 0").count() == one.count() > 0


def test_exports(spark, tmp_path):
    i = Inputs(spark, SF)
    history = T.item_history(i.metrics)
    ST.export_trends(history, i.metrics, str(tmp_path / "csv"), "csv")
    ST.export_trends(history, i.metrics, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/categories")).count() == history.count()
    assert spark.read.json(str(tmp_path / "json/items")).count() == history.count()
    ST.write_answer_bundle(i.answers, str(tmp_path / "bundle"))
    bundle = spark.read.json(str(tmp_path / "bundle"))
    assert bundle.select(F.sum(F.size("answers"))).first()[0] == i.answers.count()
    ST.export_view_csv(i.metrics.withColumn("l", F.array(F.lit("a"), F.lit('b"'))), str(tmp_path / "view"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "view"))
    assert back.count() == i.metrics.count() and back.first().l == 'a,b"'


def test_build_plan(spark):
    from answerlens.catalog.sourcing import _responses

    i = Inputs(spark, SF)
    entities = i.entities.withColumn("question_no", F.when(F.col("question_id") == "en", 1).otherwise(2))
    tables = build(i.answers, entities, i.models, i.patterns, responses=_responses(i))
    metrics = tables["metrics"]
    assert metrics.filter("question_id = '_all'").count() > 0
    assert metrics.filter("influence > 1 or influence < 0").count() == 0
    shares = tables["shares"].groupBy("project", "question_id", "date", "section", "model_id").agg(F.sum("model_share").alias("s"))
    assert shares.filter("abs(s - 1) > 0.001").count() == 0
    for name in ("trends", "model_trends", "totals", "items_per_model", "items_per_trend", "link_types", "coverage"):
        tables[name].count()
    assert tables["sources"].count() > 0 and tables["excerpts"].count() > 0
    listed = tables["fact_excerpts"].filter("excerpts is not null")
    assert listed.count() > 0 and listed.filter("size(excerpts) > 320 or question_id = '_all'").count() == 0
    assert tables["merged_excerpts"].agg(F.sum(F.size("excerpts"))).first()[0] == tables["excerpts"].count()
    merged = tables["merged_questions"]
    keys = [F.col(c) for c in ("project", "date", "section")] + [F.lower("entity")]
    assert merged.select(*keys).distinct().count() == merged.count() == metrics.filter("question_id <> '_all'").select(*keys).distinct().count()


def test_trend_report(spark):
    report = trend_report(Inputs(spark, SF).metrics)
    assert report["movers"].filter("rank > 10").count() == 0 and report["categories"].count() > 0


def test_no_cartesian_join_without_key(spark):
    """The core plans hold no product of two large sides."""
    from answerlens.operators import mentions as M

    i = Inputs(spark, SF)
    plan = M.mention_hits(i.answers, i.entities)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
