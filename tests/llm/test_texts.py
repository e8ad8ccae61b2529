"""Operators on texts against brute force and on odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import brute
from answerlens.llm import forest, packing, ppm
from answerlens.llm.mixing import mix_sources, pivot
from answerlens.llm.packing import fit_patterns, few_document_patterns, pack, plan
from answerlens.llm.ppm import score_documents
from answerlens.llm.quality import repetition_rules
from answerlens.llm.substrings import remove_repeats
from answerlens.llm.words import slices

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = "node long, label long, keys string, span long, size long, target double, kept boolean, n_words long"


def prose(seed, n, size=300):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["ab", "Ci", "dö", "e", "fu", "Ga"]) for _ in range(draw.randint(1, 4))) for _ in range(n))[: size * 40]


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeats, every kind of white space."""
    long = prose(1, 30_000, 10_000)
    base = prose(2, 120)
    words = base.split()
    near = " ".join(w if k % 40 else "changed" for k, w in enumerate(words))
    texts = [
        (0, None), (1, ""), (2, " \t\r\n\x0b\x0c "), (3, "one two"), (4, "ONE two"), (5, base), (6, base), (7, near),
        (8, base + " x"), (9, long), (10, long + " tail"), (11, "a b c\n" * 40), (12, "x\ny\nx\n\n\nx"),
        (13, "Ünï # $ | <b> 漢字 \U0001f600 " * 30), (14, "".join(f"w{k}\t\n" for k in range(60))),
        (15, "</s> <|endoftext|> \\ it's 's 12"), (16, " ".join(words[:13])), (17, " ".join(words[:12])), (18, "\n\n"),
        (19, prose(3, 60) + "\n" + base), (20, "one two"),
    ]
    return [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    extra = CLASHING.split(", ")
    df = spark.createDataFrame(odd_rows, SCHEMA).selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in extra])
    return df.repartition(3)


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["odd", "tiny"])
def test_quality(name, request):
    df = request.getfixturevalue(name)
    got = {r.doc_id: r.asDict() for r in repetition_rules(df).collect()}
    for i, text in rows_of(df):
        want = brute.quality(text)
        assert {k: got[i][k] for k in want} == want, i
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_quality_keeps_clean_and_drops_repeats(spark):
    clean, line = prose(5, 200), prose(6, 30)
    texts = [clean, "\n".join([line] * 6), clean + "\n" + "\n".join([line] * 6)]
    got = repetition_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, False, False]
    assert repetition_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep_rows=True).count() == 1


def test_quality_headers_and_limits(spark):
    """A short header may come again; the same share of a text in longer or further repeats may not."""
    draw = random.Random(11)
    words = [f"w{draw.randrange(10 ** 6):06d}" for _ in range(400)]
    header, body = " ".join(words[:9]), " ".join(words[9:70])
    passage, rest = " ".join(words[100:130]), " ".join(words[130:270])
    short = [" ".join(words[k:k + 6]) for k in (300, 306, 312)]
    texts = [
        f"{header}\n{body}\n{header}", f"{passage}\n{rest}\n{passage}", f"{passage} {rest} {passage}",
        "\n".join([*short, " ".join(words[9:80]), *short]),
    ]
    got = repetition_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.base_failed for r in got] == [False] * 4
    assert [r.kept for r in got] == [True, False, False, False]
    assert (got[0].ngram_share, got[0].line_share) == (0.0, 0.0) and 0.14 < got[1].ngram_share < 0.16 < got[3].line_share


@pytest.mark.parametrize("name", ["odd", "tiny"])
@pytest.mark.parametrize("bits", [None, 16])
def test_substrings(name, bits, request):
    df = request.getfixturevalue(name)
    got = sorted(tuple(r) for r in remove_repeats(df, bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == sorted(brute.substrings(rows_of(df)))


def test_substrings_null_and_shared_ids(spark):
    text = prose(8, 20)
    rows = [(None, text), (4, text), (4, text), (2, prose(9, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_removed) for r in remove_repeats(df).collect())
    assert got == sorted((repr(i), n) for i, _, n, _ in [(None, 0, 20, ""), (4, 0, 0, ""), (4, 0, 0, ""), (2, 0, 0, "")])


@pytest.mark.parametrize("name", ["odd", "tiny"])
def test_near_duplicates(name, request):
    df = request.getfixturevalue(name)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in forest.near_duplicates(df).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.near(rows_of(df)).items()}


def test_near_duplicates_dense_region(spark):
    """A large group of near copies: more than a region compares in pairs."""
    draw = random.Random(4)
    words = prose(11, 160).split()
    rows = []
    for i in range(120):
        own = list(words)
        for k in draw.sample(range(160), 3):
            own[k] = f"new{i}x{k}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(df).collect()}
    assert got == {i: c for i, (_, c) in brute.near(rows).items()}


def test_near_duplicates_star(spark, monkeypatch):
    """Copies that link to their original alone, many of them in one region: each has one link to find."""
    monkeypatch.setattr(forest, "BLOCK", 64)
    draw = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 250):
        own = list(base)
        for k in draw.sample(range(200), draw.choice([3, 5, 6, 7, 9, 12])):
            own[k] = f"n{i}x{k}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(df).collect()}
    assert got == {i: c for i, (_, c) in brute.near(rows).items()}


def test_near_duplicates_templates(spark, monkeypatch):
    """Documents of one template are dense but not similar: only the few true pairs meet, in tasks of bounded size."""
    monkeypatch.setattr(forest, "BLOCK", 8)
    template = prose(70, 130)
    rows = [(k, f"{template} {prose(1000 + k, 70)}") for k in range(120)]
    rows += [(200 + k, f"{rows[k][1]} {prose(2000 + k, 3)}") for k in range(0, 120, 10)]
    texts = {i: t for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(df).collect()}
    assert got == {i: c for i, (_, c) in brute.near(rows).items()}
    nodes = spark.createDataFrame([(i, 0) for i in texts], "node long, family long")
    bodies = spark.createDataFrame(rows, "node long, text string")
    none = spark.createDataFrame([], "node long, label long")
    met = [tuple(r) for r in forest.meetings(nodes, none, bodies).select("family", "block", "asking", "side", "node").collect()]
    by_pair = defaultdict(set)
    for family, block, asking, side, node in met:
        by_pair[family, block, asking].add((side, node))
    for k in range(0, 120, 10):
        for a, b in ((k, 200 + k), (200 + k, k)):
            assert any({(1, a), (0, b)} <= x for x in by_pair.values()) or any({(1, b), (0, a)} <= x for x in by_pair.values())
    assert len({node for *_, node in met}) < 60 and len(met) < 600


def test_near_duplicates_repeated_rows(spark):
    text, other = prose(12, 50), prose(13, 50)
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (5, other), (5, text)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in forest.near_duplicates(df).collect())
    assert got == [(-1, 3, False), (3, 3, True), (3, 3, True), (5, 3, False), (5, 5, True)]


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.source].append(r)
    return out


@pytest.mark.parametrize("name", ["odd", "tiny"])
def test_mixing(name, request):
    df = request.getfixturevalue(name)
    rows = mix_sources(df).collect()
    sizes = {i: len(brute.words(t)) for i, t in rows_of(df)}
    assert sorted((r.doc_id, r.size) for r in rows) == sorted(sizes.items())
    groups = by_source(rows)
    want = brute.mixing_targets({s: sum(r.size for r in g) for s, g in groups.items()})
    for s, g in groups.items():
        assert math.isclose(g[0].target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(sum(r.taken for r in g) - want[s]) <= max(r.size for r in g)
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in g)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix_sources(df).collect()), key=repr)


def test_mixing_deals_equal_rows(spark, monkeypatch):
    """Rows without an id and of one size come to no chunk alone, and each is rounded for itself."""
    import answerlens.llm.mixing as mixing

    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = [(None, "one two three", "en", "hot", 0)] * 3000 + [(k, "word " * (k % 5 + 1), "en", "hot", 0) for k in range(1000)]
    rows += [(k, "a b " * 20, "en", "other", 0) for k in range(5000, 5200)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = []
    inner = mixing.dealt

    def spy(frame, own):
        out = inner(frame, own)
        seen.append(out.groupBy("source", "chunk").agg(F.sum("n").alias("n")).agg(F.max("n"), F.sum("n")).first())
        return out

    monkeypatch.setattr(mixing, "dealt", spy)
    got = mixing.mix_sources(df).collect()
    assert seen[0][1] == len(rows) == len(got) and seen[0][0] <= 4 * 64
    assert sum(r.doc_id is None for r in got) == 3000
    for source in ("hot", "other"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert all(abs(r.copies - r.target / r.source_size) < 1 for r in mine)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixing_tree(spark, monkeypatch):
    """Many chunks and levels keep each source near its target."""
    import answerlens.llm.mixing as mixing

    monkeypatch.setattr(mixing, "CHUNK", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = [(i, "w " * (1 + i * 7 % 50), "en", "ab"[i % 10 < 2], 0) for i in range(900)] + [(None, "w", "en", None, 0)] * 2
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 902
    for g in by_source(got).values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= 50


def test_pivot_keeps_mass_and_expectation():
    size, total = np.array([5.0, 3.0, 8.0, 1.0]), np.zeros(4)
    for k in range(4000):
        p = np.array([0.3, 0.6, 0.5, 0.2])
        left = pivot(size, p, np.random.default_rng(k))
        assert abs((size * p).sum() - 7.5) < 1e-9
        assert sum(0 < x < 1 for x in p) == (left >= 0)
        total += p
    assert np.abs(total / 4000 - [0.3, 0.6, 0.5, 0.2]).max() < 0.04


@pytest.mark.parametrize("name", ["odd", "tiny"])
def test_packing(name, request):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for i, text in rows_of(df):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want.append((i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())))
    rows = pack(df).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    check_sequences(rows)


def check_sequences(rows, capacity=2048):
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert len(filled) <= max(least * 1.01, least + 2)


def test_packing_repeated_and_null_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (None, None), (2, "x " * 5000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64).collect()
    assert Counter(r.length for r in got)[3] == 2 and sum(r.length for r in got) == 2 * 3 + 2 + 5001
    check_sequences(got, 64)


def test_plan_places_every_length():
    draw = np.random.default_rng(1)
    lengths = np.clip(draw.lognormal(6, 1, 5000).astype(int) + 1, 1, 2048)
    histogram = dict(Counter(lengths.tolist()))
    placed = Counter()
    for pattern, n in plan(histogram):
        assert sum(pattern) <= 2048
        for length in pattern:
            placed[length] += n
    assert placed == Counter(histogram)


def test_fit_is_non_negative_and_close():
    patterns = few_document_patterns(16)
    assert {tuple(p) for p in patterns} == {(a, b, c) for a in range(17) for b in range(a + 1) for c in range(b + 1) if a + b + c == 16}
    want = np.zeros(17)
    want[[16, 10, 6, 8]] = 4, 5, 5, 6
    fitted = fit_patterns(patterns, want)
    got = np.zeros(17)
    for k, x in fitted.items():
        assert x >= 0
        for b in patterns[k]:
            got[b] += x
    assert np.abs(got[1:] - want[1:]).max() < 0.1


@pytest.mark.parametrize("name", ["odd", "tiny"])
def test_scores(name, request):
    df = request.getfixturevalue(name)
    rows = rows_of(df)
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(brute.words(brute.lower(t)))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in score_documents(df).collect()}
    for i, t in rows:
        own = brute.words(brute.lower(t)) + [None]
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0


def slow_trie(counts, context, symbol):
    """The rule of Trie written out for one byte."""
    p, excluded, came = 1.0, set(), False
    for order in range(len(context), -1, -1):
        seen = counts[order].get(context[len(context) - order:])
        if seen is None:
            continue
        left = {s: 2 * n - 1 for s, n in seen.items() if s not in excluded}
        if left:
            total = sum(left.values()) + len(left)
            if symbol in left:
                return p * left[symbol] / total
            p *= len(left) / total
        excluded, came = set(seen), True
    return p / (256 - len(excluded)) if came else 1 / 256


def test_trie_matches_the_rule_and_sums_to_one():
    texts = [prose(k, 12).lower() for k in range(20)]
    tally = ppm.Tally()
    for part in slices(pa.array(texts[:15])):
        tally.add(ppm.symbols(part)[0])
    keys, n = tally.total()
    edges, order = [(keys, n)], ppm.ORDER
    while order:
        order -= 1
        own = edges[0][0] & np.uint64((1 << 8 * (order + 1)) - 1)
        unique, inverse = np.unique(own, return_inverse=True)
        edges.insert(0, (unique, np.bincount(inverse, edges[0][1]).astype(np.int64)))
    trie = ppm.Trie(edges)
    counts = [defaultdict(dict) for _ in range(ppm.ORDER + 1)]
    for o, (k, c) in enumerate(edges):
        for key, x in zip(k.tolist(), c.tolist()):
            counts[o][(key >> 8).to_bytes(o, "big")][key & 255] = x
    test = np.concatenate([ppm.symbols(part)[0] for part in slices(pa.array(texts[15:]))])[:400]
    got = trie.log10(test)
    for key, score in zip(test.tolist(), got.tolist()):
        want = slow_trie(counts, (key >> 8).to_bytes(ppm.ORDER, "big"), key & 255)
        assert math.isclose(score, math.log10(want), rel_tol=1e-6)
    one = np.uint64(int(test[50]) >> 8 << 8) + np.arange(256, dtype=np.uint64)
    assert math.isclose((10 ** trie.log10(one)).sum(), 1.0, rel_tol=1e-5)


def test_scores_learn(tiny):
    rows = score_documents(tiny).collect()
    uniform = sum(len((t or "").encode()) + 1 for _, t in rows_of(tiny)) * math.log10(1 / 256)
    assert sum(r.score for r in rows) > 0.5 * uniform


@pytest.mark.parametrize("apply", [repetition_rules, remove_repeats, forest.near_duplicates, mix_sources, pack, score_documents])
def test_empty_table(empty, apply):
    assert apply(empty).count() == 0


@pytest.mark.parametrize("apply", [repetition_rules, remove_repeats, forest.near_duplicates, mix_sources, pack, score_documents])
def test_only_nulls(spark, apply):
    df = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert apply(df).count() == 3


@pytest.mark.parametrize("most", [0, 300, 20_000])
def test_scores_do_not_depend_on_what_is_sent(odd, tiny, most):
    texts = odd.filter("doc_id <> 9 and doc_id <> 10").union(tiny.filter("doc_id < 40").selectExpr("*", *[f"null as x{k}" for k in range(8)]))
    whole = sorted(score_documents(texts).collect(), key=lambda r: (r.doc_id, r.score))
    cut = sorted(score_documents(texts, max_edges=most).collect(), key=lambda r: (r.doc_id, r.score))
    assert [r[:6] for r in whole] == [r[:6] for r in cut]
    assert len(whole) > 50 and [r.score for r in cut] == pytest.approx([r.score for r in whole], rel=1e-5)


def test_trie_is_sent_without_a_second_copy_of_its_edges():
    """What a task holds of the model is 12 bytes for each edge and 28 for each context."""
    import pickle

    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(0, 1 << min(63, 8 * (o + 1)), 1 if o == 0 else 40_000).astype(np.uint64)) for o in range(6)]
    trie = ppm.Trie([(k, np.ones(len(k), np.int64)) for k in keys], complete=False)
    held = sum(12 * len(k) for k in keys) + 28 * sum(len(c) for c in trie.contexts)
    assert len(pickle.dumps(trie)) < held + 20_000
