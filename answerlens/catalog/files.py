"""Queries that write given tables to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.catalog.registry import query
from answerlens.operators.scale import new_folder
from answerlens.sources import ingest as I
from answerlens.sources import stores as ST
from answerlens.sources.files import write_files

_KEYS = ["project", "question_id", "date", "model_id"]


@query("read_answers", ["answers", "models"], """
select project, question_id, date, model_id, coalesce(text, '') || chr(10) as text from answers where model_id <> 'src2'""")
def _answers(i):
    path = new_folder(i.spark)
    # A file for each document; a cell has as many as it has documents.
    write_files(i.answers, path, _KEYS)
    models = i.models.filter("model_id <> 'src2'").select("project", F.upper("model_id").alias("model_id"))
    return I.read_answers(i.spark, path, models, "part-*").drop("answer_id")


@query("load_link_patterns", ["page_links"], """
with h as (select distinct split_part(split_part(link, '/', 3), ':', 1) as host from page_links),
t as (select host, concat('c', length(host) % 9) as code, length(host) % 9 as n from h),
o as (select distinct code, case when n % 3 = 0 then 999 else 10 - n end as file_order from t),
r as (select code, row_number() over (order by file_order, code) as ord from o)
select code, concat('Type ', code) as name, concat('Hosts of ', code) as description, ord,
  case when length(host) % 2 = 0 then 'endswith' else 'contains' end as kind,
  case when length(host) % 2 = 0 then '.' || host else host end as pattern
from t join r using (code)""")
def _patterns(i):
    path = new_folder(i.spark)
    host = F.split_part(F.split_part("link", F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    hosts = i.page_links.select(host.alias("host")).distinct().withColumn("n", F.length("host") % 9)
    line = F.when(F.length("host") % 2 == 0, F.concat(F.lit("*."), "host")).otherwise(F.col("host"))
    code = F.concat(F.lit("c"), F.col("n").cast("string"))
    files = hosts.groupBy(code.alias("code"), "n").agg(F.array_join(F.sort_array(F.collect_set(line)), "\n").alias("lines")).select(
        "code", F.concat_ws(
            "\n", F.concat(F.lit("Type "), "code"),
            F.when(F.col("n") % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("order: "), (10 - F.col("n")).cast("string"))),
            F.concat(F.lit("description: Hosts of "), "code"), F.lit("# a comment"), "lines",
        ).alias("body"),
    )
    files.repartition("code").write.partitionBy("code").option("compression", "none").text(path)
    return I.load_link_patterns(i.spark, path)


@query("snapshot_store", ["metrics"], """
select project, question_id, date, section, entity, mentions + case when date = DATE '1995-03-01' then 100 else 0 end as mentions
from metrics""")
def _store(i):
    path = new_folder(i.spark)
    rows = i.metrics.select("project", "question_id", "date", "section", "entity", "mentions")
    ST.write_snapshot(rows, path)
    # A second run replaces one date only.
    ST.write_snapshot(rows.filter("date = DATE '1995-03-01'").withColumn("mentions", F.col("mentions") + 100), path)
    return ST.read_snapshot(i.spark, path).select(*rows.columns)


@query("view_csv", ["view_metrics"], """
select project, question_id, section, concat(entity, ', "x"') as entity, CAST(mentions AS VARCHAR) as mentions, coalesce(nullif(bots, ''), '') as bots
from view_metrics""")
def _csv(i):
    path = new_folder(i.spark)
    rows = i.view_metrics.select(
        "project", "question_id", "section", F.concat("entity", F.lit(', "x"')).alias("entity"), "mentions",
        F.split("bots", ",").alias("bots"),
    )
    ST.export_view_csv(rows, path)
    text = ", ".join(f"{c} string" for c in rows.columns)
    back = i.spark.read.schema(text).option("header", True).option("escape", '"').csv(path)
    return back.withColumn("bots", F.coalesce("bots", F.lit("")))
