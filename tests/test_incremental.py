"""The incremental build: equal to a build of everything, and blind to finished snapshots."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from answerlens.operators import scale
from answerlens.plans.build import build
from answerlens.plans.incremental import build_new, manifest, with_carried

DAYS = [dt.date(2024, 1, d) for d in (1, 8, 15)]
TEXTS = {"q1": "Acme leads, then Beta. See https://acme.org/a and Acme again.", "q2": "Beta's tools beat Gamma; [x](https://beta.com/x)."}
PATTERNS = "code string, name string, ord long, kind string, pattern string"


def _answers(spark, days=DAYS, text=None, more=()):
    rows = [
        ("p", q, d, m, 100 * k + 10 * int(q[1]) + n, text or f"{t} No {k}. " + "Gamma. " * k)
        for k, d in enumerate(DAYS) if d in days for q, t in TEXTS.items() for n, m in enumerate(("m1", "m2"))
    ]
    return spark.createDataFrame(rows + list(more), "project string, question_id string, date date, model_id string, answer_id long, text string")


def _entities(spark):
    rows = [("p", q, "products", e, k, int(q[1])) for q in TEXTS for k, e in enumerate(("Acme", "Beta", "Gamma"), 1)]
    return spark.createDataFrame(rows, "project string, question_id string, section string, entity string, ord long, question_no int")


@pytest.fixture(scope="module")
def config(spark):
    models = spark.createDataFrame([("p", "m1", 9 * 10**8, "One"), ("p", "m2", 2 * 10**8, "Two")], "project string, model_id string, estimated_mau long, display_name string")
    return models, spark.createDataFrame([("org", "Organisation", 1, "endswith", ".org")], PATTERNS)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


NAMES = ["facts", "metrics", "excerpts", "trends", "link_domains", "totals"]


def test_new_date_equals_whole_build_without_old_texts(spark, config, tmp_path):
    store = str(tmp_path / "store")
    build_new(_answers(spark, DAYS[:2]), _entities(spark), *config, store)
    assert manifest(spark, store).count() == 6  # two questions and their common level on two dates
    # Texts of finished dates are replaced: had they been read, the tables would differ.
    blind = _answers(spark, DAYS[:2], "nothing").unionByName(_answers(spark, DAYS[2:]))
    got = build_new(blind, _entities(spark), *config, store)
    want = build(_answers(spark), _entities(spark), *config)
    for name in NAMES:
        assert _rows(got[name]) == _rows(want[name]), name
    assert {tuple(r) for r in manifest(spark, store).select("date", "build_no").distinct().collect()} == {(DAYS[0], 1), (DAYS[1], 1), (DAYS[2], 2)}
    # Nothing new: no run is added.
    again = build_new(blind, _entities(spark), *config, store)
    assert _rows(again["facts"]) == _rows(want["facts"]) and manifest(spark, store).agg(F.max("build_no")).first()[0] == 2


def test_files_of_finished_dates_are_pruned(spark, tmp_path):
    path = str(tmp_path / "answers")
    _answers(spark).write.partitionBy("date").parquet(path)
    plan = spark.read.parquet(path).filter(F.col("date").isin(DAYS[2:]))
    assert [f for f in plan.select("text")._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters: [isnotnull(date" in f]


def test_late_answer_and_lost_snapshot_reopen_only_theirs(spark, config, tmp_path):
    store = str(tmp_path / "store")
    build_new(_answers(spark), _entities(spark), *config, store)
    late = _answers(spark, more=[("p", "q1", DAYS[1], "m1", 999, "Gamma late")])
    got = build_new(late, _entities(spark), *config, store)
    assert _rows(got["facts"]) == _rows(build(late, _entities(spark), *config)["facts"])
    renewed = manifest(spark, store).filter("build_no = 2").select("question_id", "date").collect()
    assert sorted(map(tuple, renewed)) == [("_all", DAYS[1]), ("q1", DAYS[1])]
    fewer = _answers(spark, DAYS[1:])
    got = build_new(fewer, _entities(spark), *config, store)
    assert _rows(got["facts"]) == _rows(build(fewer, _entities(spark), *config)["facts"])


def test_a_run_that_broke_off_is_not_read(spark, config, tmp_path):
    store = str(tmp_path / "store")
    first = build_new(_answers(spark, DAYS[:1]), _entities(spark), *config, store)
    for name in ("hits", "links", "excerpts"):  # tables of a second run without its manifest
        spark.read.parquet(f"{store}/{name}/build_no=1").write.parquet(f"{store}/{name}/build_no=2")
    got = build_new(_answers(spark, DAYS[:2]), _entities(spark), *config, store)
    assert _rows(got["facts"]) == _rows(build(_answers(spark, DAYS[:2]), _entities(spark), *config)["facts"])
    assert first["facts"].count() < got["facts"].count()


def test_dated_names_are_carried(spark, config, tmp_path):
    of = lambda d, *names: [("p", q, d, "products", e, k, int(q[1])) for q in TEXTS for k, e in enumerate(names, 1)]
    schema = "project string, question_id string, date date, section string, entity string, ord long, question_no int"
    entities = spark.createDataFrame(of(DAYS[0], "Acme", "Gamma") + of(DAYS[1], "BETA") + of(DAYS[2], "Acme"), schema)
    dates = entities.select("project", "date").distinct()
    full = with_carried(entities, dates)
    named = {(r.date.day, r.question_id): sorted((x.ord, x.entity) for x in full.filter((F.col("date") == r.date) & (F.col("question_id") == r.question_id)).collect())
             for r in full.select("date", "question_id").distinct().collect()}
    assert named[(8, "q1")] == [(1, "BETA"), (2, "Acme"), (3, "Gamma")]
    assert named[(15, "q2")] == [(1, "Acme"), (2, "BETA"), (3, "Gamma")]
    store = str(tmp_path / "store")
    build_new(_answers(spark, DAYS[:2]), entities.filter(F.col("date") < DAYS[2]), *config, store, dates)
    got = build_new(_answers(spark), entities, *config, store, dates)
    assert _rows(got["facts"]) == _rows(build(_answers(spark), full, *config)["facts"])
    assert manifest(spark, store).filter("build_no = 1").count() == 6
    assert got["facts"].filter((F.col("date") == DAYS[2]) & (F.col("entity") == "Gamma")).count() > 0


def test_empty_names_and_intermediates(spark, config, tmp_path):
    store = str(tmp_path / "store")
    none = _entities(spark).limit(0)
    tables = build_new(_answers(spark), none, *config, store)
    assert tables["links"].count() > 0 and tables["excerpts"].count() == 0
    left = len(scale.written())
    build_new(_answers(spark), none, *config, store)
    assert len(scale.written()) - left == 5  # valid snapshots, facts, metrics and both lists of excerpts: no scratch of the run
    with pytest.raises(ValueError):
        build_new(_answers(spark).limit(0), none, *config, str(tmp_path / "other"))
