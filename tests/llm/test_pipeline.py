"""Pipeline stages on their own inputs, and all queries at the smallest scale."""

import pytest

import brute
import corpus_pipeline
from answerlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_query_runs(spark, name):
    table = {"op2_chat": None, "op5_rotation": "embeddings", "op6_layout": "pages", "op10_warc": "pages"}.get(name, "documents")
    rows = QUERIES[name](spark, SF).count()
    if name == "op9_packing":
        assert rows >= spark.read.parquet(f"{SF}/documents.parquet").count()
    elif table:
        assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        assert rows == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
            assert {r[0] for r in docs.select("doc_id").collect()} == {i for i, _ in before}
            break
        assert docs.columns == columns
        now = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name == "quality":
            assert set(now) <= set(before) and not any(brute.quality(t)["base_failed"] for _, t in now)
        elif name == "near_duplicate":
            groups = brute.near(before)
            assert sorted(now) == sorted((i, t) for i, t in before if groups[i][1] == i)
        elif name == "substring":
            import hashlib

            want = {i: (n, gone, digest) for i, n, gone, digest in brute.substrings(before) if gone < n}
            texts = dict(before)
            assert {i for i, _ in now} == set(want)
            for i, t in now:
                if want[i][1]:
                    assert hashlib.sha256(t.encode()).hexdigest() == want[i][2]
                else:
                    assert t == texts[i]
        elif name == "mixing":
            assert set(now) <= set(before)
        before = now


def test_pipeline_with_odd_rows(spark, tmp_path):
    rows = [(None, None, "x", None, None, 1), (1, "", "x", "s", 0, 2), (2, "w " * 60, "x", None, 120, 3)]
    rows += [(k, " ".join(f"w{k}x{j}" for j in range(80)), None, "s", 5, 4) for k in (3, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed long")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, SF)
            if name != "packing":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}{'e' if part is not docs else ''}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0


def prose(seed, n=80):
    return " ".join(f"w{seed}x{j}" for j in range(n))


def run_stage(spark, name, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return sorted(map(tuple, dict(corpus_pipeline.STAGES)[name](spark, docs, SF).collect()), key=repr)


def test_near_duplicate_keeps_rows_that_only_share_an_id(spark):
    """Rows without an id, or with the same one, are no near duplicates; a group keeps one row, the same each time."""
    rows = [(None, prose(k), "s") for k in range(6)] + [(7, prose(20), "s"), (7, prose(21), "s")]
    rows += [(None, prose(0), "s"), (None, prose(0) + " ", "s"), (3, prose(20) + " end", "s"), (9, prose(3).upper(), "t")]
    rows += [(None, None, "s"), (None, "", "s"), (1, " ", "s"), (1, " ", "s")]
    got = run_stage(spark, "near_duplicate", rows)
    assert got == run_stage(spark, "near_duplicate", rows[::-1])
    zero = [r for r in got if r[1] and r[1].strip() == prose(0)]
    assert len(zero) == 1
    want = [(None, prose(k), "s") for k in (1, 2, 4, 5)] + [(9, prose(3).upper(), "t"), (7, prose(21), "s")]
    want += [(3, prose(20) + " end", "s"), *rows[-4:], *zero]
    assert got == sorted(want, key=repr)


def test_mixing_takes_each_row_of_an_id_by_itself(spark):
    rows = [(None, prose(k), "s") for k in range(40)] + [(7, prose(k), "t") for k in range(40, 60)] + [(None, prose(60), "u")] * 3
    got = run_stage(spark, "mixing", rows)
    assert set(got) <= set(rows)
    taken = {s: sum(r[2] == s for r in got) for s in "stu"}
    want = {s: t / 80 for s, t in brute.mixing_targets({"s": 3200, "t": 1600, "u": 240}).items()}
    assert all(abs(taken[s] - want[s]) < 1 for s in "stu")


def test_substring_deals_rows_without_an_id(spark, monkeypatch):
    """They lie in several ranges, lose to every id and not to each other."""
    from answerlens.llm import substrings

    monkeypatch.setattr(substrings, "NO_ID_WINDOWS", 8)
    common = prose(99, 20)
    rows = [(None, f"{prose(k, 20)} {common}", "s") for k in range(8)] + [(None, f"{prose(k, 9)} {prose(98, 20)}", "s") for k in (8, 9)]
    rows.append((5, common, "s"))
    got = run_stage(spark, "substring", rows)
    assert got == sorted([(None, prose(k, 20), "s") for k in range(8)] + rows[8:], key=repr)
