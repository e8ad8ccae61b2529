"""Answer files that the tasks list, read and write, against Spark's own reader and writer."""

import bz2
import datetime as dt
import gzip
import os
import re

import pytest
from pyspark.sql import functions as F

from answerlens.catalog.registry import QUERIES
from answerlens.sources import files as FL
from answerlens.sources import ingest as I


def _put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content)


def _by_spark(spark, path, name):
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(str(path), wholetext=True)
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return sorted((r.at, r.value) for r in files.select(at.alias("at"), "value").collect())


def _store(path):
    day = path / "proj" / "1-a" / "answers" / "2024-01-02"
    _put(day / "gpt", "answer.md", "one\r\ntwo\n\n".encode())
    _put(day / "m+1 é%41;x", "answer.md", "naïve €".encode())
    _put(day / "broken", "answer.md", b"\xff\xfe cut \xc3")
    _put(day / "empty", "answer.md", b"")
    _put(day / "gpt", "answer_md", b"other name")
    _put(day / "_hidden", "answer.md", b"hidden")
    _put(day / ".hidden", "answer.md", b"hidden")
    _put(day / "_m=1", "answer.md", b"not hidden")
    _put(day / "deep" / "er", "answer.md", b"deeper")
    for name in ("_answer.md", ".answer.md", "xanswer.md._COPYING_", "x.answer.md", "_metadata.md"):
        _put(day / "names", name, name.encode())
    _put(path, "answer.md", b"at the top")
    os.symlink(day / "gpt", day / "link")
    os.symlink(day / "nothing", day / "names" / "gone.md")


@pytest.mark.parametrize("name", ["answer.md", "*.md", "?.answer.md", "nothing.md", "{answer,x.answer}.md", "[a-z]nswer.md"])
def test_the_files_that_spark_takes(spark, tmp_path, name, monkeypatch):
    _store(tmp_path)
    expected = _by_spark(spark, tmp_path, name)
    assert _by_spark(spark, f"file://{tmp_path}//", name) == expected
    paths = FL.list_files(spark, f"file://{tmp_path}//", name)
    assert (paths is None) == (name[0] in "{[")
    for folders in (0, 1, 8):  # the driver looks into none of the folders, some or all
        monkeypatch.setattr(FL, "_FOLDERS", folders)
        rows = I.read_answers(spark, str(tmp_path), name=name).collect()
        got = sorted((r.answer_id, r.text) for r in rows)
        assert got == [x for x in expected if "/answers/" in x[0] and "/er/" not in x[0]]
        if paths is not None:
            listed = FL.list_files(spark, str(tmp_path), name)
            read = FL.read_texts(listed.withColumn("at", F.concat(F.lit("file:"), F.col("path").cast("string"))), 1)
            assert sorted((r.at, r.text) for r in read.collect()) == expected


def test_packed_answers_are_unpacked(spark, tmp_path):
    day = tmp_path / "p" / "q" / "answers" / "2024-01-02"
    _put(day / "a", "answer.md.gz", gzip.compress(b"packed"))
    _put(day / "b", "answer.md.bz2", bz2.compress(b"packed too"))
    _put(day / "c", "answer.md", b"plain")
    rows = I.read_answers(spark, str(tmp_path), name="answer.*").collect()
    assert sorted((r.model_id, r.text) for r in rows) == [("a", "packed"), ("b", "packed too"), ("c", "plain")]


def test_a_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        I.read_answers(spark, str(tmp_path / "none")).collect()


def test_many_files_take_few_tasks(spark, tmp_path):
    for k in range(600):
        _put(tmp_path / "p" / f"q{k % 3}" / "answers" / "2024-01-02" / f"m{k}", "answer.md", b"text %d" % k)
    odd = [("p", f"M{k}") for k in range(600) if k % 2]
    models = spark.createDataFrame(odd + odd, "project string, model_id string").repartition(3).groupBy("project", "model_id").count()
    answers = I.read_answers(spark, str(tmp_path), models)
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 1
    # Spark's reader opens 32 files in a task and takes their list from the driver.
    assert answers.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 600 // 32
    assert sorted(r.text for r in answers.collect()) == sorted(f"text {k}" for k in range(600) if k % 2)


def test_files_are_written_as_spark_writes_them(spark, tmp_path):
    days = [dt.date(2024, 1, 2), None]
    names = ["a", "", None, "x/y:z=1", "50% #é+ü \"'*?[^]{}\\\t", "a"]
    rows = [(n, d, t) for n in names for d in days for t in ("one", "", None, "zwei €\nthree")]
    df = spark.createDataFrame(rows, "`the=key` string, date date, text string").coalesce(2)
    keys = ["the=key", "date"]
    df.write.option("maxRecordsPerFile", 1).partitionBy(*keys).text(str(tmp_path / "spark"))
    FL.write_files(df, f"file://{tmp_path}/own", keys)

    def found(root):
        return sorted(
            (os.path.relpath(d, root), open(f"{d}/{x}", "rb").read())
            for d, _, files in os.walk(root) for x in files if x.startswith("part-")
        )

    assert found(tmp_path / "own") == found(tmp_path / "spark")
    assert len(found(tmp_path / "own")) == len(rows)
    assert not [x for d, _, files in os.walk(tmp_path / "own") for x in files if not x.startswith("part-")]


def test_the_query_writes_and_reads_all_rows(spark, tmp_path, monkeypatch):
    rows = [(k % 40, "en", f"src{k % 4}", f"text {k % 40}" if k % 7 else None) for k in range(400)]
    rows += [(1, "fr", "src2", "gone"), (None, "en", "src1", "no date"), (2, "de", None, "no model")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr("answerlens.catalog.files.new_folder", lambda _: f"file://{tmp_path}/answers")
    got = QUERIES["read_answers"](spark, str(tmp_path)).collect()
    expected = [
        ("p1", "en", dt.date(2024, 1, 1 + d % 4 * 7), m, f"{t or ''}\n") for d, _, m, t in rows[:400] if m != "src2"
    ]
    assert sorted(tuple(r) for r in got) == sorted(expected)
    # A file for each row, written by the tasks themselves.
    names = [x for _, _, files in os.walk(tmp_path / "answers") for x in files]
    assert len(names) == len(rows) and all(re.fullmatch(r"part-\d{5}-\d{9}\.txt", x) for x in names)
