"""Pages, archives, chats and vectors."""

import hashlib
import random
import time

import numpy as np
import pytest

import brute
from answerlens.llm import rotation
from answerlens.llm.chat import conversation_digests, format_turns, with_probe
from answerlens.llm.layout import page_texts, render
from answerlens.llm.rotation import near_vectors, tables_for
from answerlens.llm.warc import captures, page_captures, parse_records, read_archives, write_archives

PAGES = "page_id long, url string, html string, payload string, digest string, label long"


def page_rows():
    big, other = "<p>" + "ä" * 800 + "</p>", "x" * 1000
    texts = [
        (1, "http://a.example/x?y", big), (2, "http://b.example", big), (3, "", other), (4, None, None), (5, "u", ""), (6, "u", "y" * 999),
        (7, "u\r\nEvil: 1", "y" * 999), (8, "u", other), (9, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"),
        (10, "u", "line\r\n\r\nWARC/1.1\r\n" * 100), (11, "u", "z" * 3_000_000), (12, "u", big), (12, "u", big), (None, "u", big),
    ]
    return [(*t, None, "d", 1) for t in texts]


def wanted_captures(rows):
    last = {}
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            last[raw] = max(last.get(raw, i), i)
    out = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        again = raw in last and last[raw] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[raw] if again else None))
    return sorted(out, key=repr)


def test_warc_round_trip(spark):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = page_captures(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == wanted_captures(rows)


def test_warc_records_and_captures(spark):
    df = spark.createDataFrame([r for r in page_rows() if r[0] not in (12, None)], PAGES)
    records = read_archives(spark, write_archives(df), with_payload=True)
    assert records.count() == 3 * 11
    nested = captures(records)
    assert nested.count() == 11
    rows = nested.collect()
    assert all(r.request is not None and r.metadata.fields["pageid"] for r in rows)
    by_page = {int(r.metadata.fields["pageid"]): r.response for r in rows}
    assert bytes(by_page[9].payload).startswith(b"WARC/1.1") and by_page[1].payload is None
    assert by_page[1].refers_to and by_page[7].target_uri == "u%0A%0AEvil: 1"


def test_warc_parser_reads_members_and_rejects_damage():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: resource\r\nX: a\r\n  b\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    both = list(parse_records(gzip.compress(record) + gzip.compress(record)))
    assert [b for _, b in both] == [b"ab\r\n"] * 2 and both[0][0]["x"] == "a b"
    with pytest.raises(ValueError):
        list(parse_records(record[:-6]))
    assert list(parse_records(b"")) == []


def test_warc_empty(spark):
    assert page_captures(spark.createDataFrame([], PAGES)).count() == 0


def test_layout_shows_what_browsers_show():
    def styled(css, body="<p class=x>text</p>", attributes=""):
        return render(f"<style{attributes}>{css}</style>{body}")

    for shown in (
        "@media print{.x{display:none}}", "@media (max-width: 600px){.x{display:none} p{display:none}}", "@media screen and (color){.x{display:none}}",
        "@supports (display: grid){.x{display:none}}", "@keyframes k{from{display:none}} @media print{p{display:none}}",
        ".x{display:none} .x{display:block}", ".x{display:none} #y, p.x{display:block}", "p{display:block!important} .x{display:none}",
        "/* .x{display:none} */", ".y{content:'}.x{display:none}'}", "@layer a{.x{display:none}} p{display:block}", ".x{--display:none}",
        "@layer b, a; @layer a{p{display:block}} @layer b{.x{display:none}}", ".x{display:none} .x{display:none;display:block}",
    ):
        assert styled(shown) == "text", shown
    for gone in (
        ".x{display:none}", "@media screen{.x{display:none}}", "@media all, print{p{display:none}}", "@media print{.x{color:red}} .x{display:none}",
        ".x{display:block} .x{display:none", "p{display:none!important} .x{display:block}", ".x{display:none} .x{display:nonsense}",
        "@import url(a.css); .x{display:none}", "@layer a{.x{color:red}} .x{display:none}", "*{display:none}",
    ):
        assert styled(gone) == "", gone
    assert styled(".x{display:none}", attributes=" media=print") == "text" and styled(".x{display:none}", attributes=" media=screen") == ""
    assert render("<noscript><style>p{display:none}</style></noscript><p>text") == "text"
    assert styled(".x{display:none}", "<p class=x style='display:block'>text") == "text"
    assert styled(".x{display:block!important}", "<p class=x style='display:none'>text") == "text"
    assert styled("p{display:block}", "<p hidden>text") == "text"


def test_layout_math():
    page = "<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>TEX</annotation></semantics></math> holds"
    assert render(page) == "so x=1 holds"


def test_layout_control_characters(spark):
    pages = ["<p>&#1;</p>", "a<b>&#1;</b>c", "<pre>&#1;</pre>", "<td>&#1;</td>", "<title>&#1;</title>&#x1;"]
    assert [render(p) for p in pages] == ["", "ac", "", "", ""]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    assert page_texts(df).count() == len(pages)


def test_layout_rules():
    assert render(None) == render("") == ""
    assert render("<p>one<p>two<br>three") == "one\n\ntwo\nthree"
    assert render("<ul><li>x<li>y<ol start=3><li>n<li>m</ol></ul>z") == "- x\n- y\n  3. n\n  4. m\n\nz"
    table = "<table><tr><td>aa<td>b<tr><td>c<th>dddd<tr><td rowspan=2>r<td>1<tr><td>2</table>after"
    assert render(table) == "aa  b\nc   dddd\nr   1\n    2\n\nafter"
    assert render("<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>").split("\n")[1].split() == ["a", "b", "c"]
    assert render("<pre>a\n  b\n\nc</pre>") == "a\n  b\n\nc"
    assert render("a &lt;b&gt; &amp; c <b>d<i>e</b>f") == "a <b> & c def"
    assert render("<table><tr><td><table><tr><td>in</table></td><td>out</table>") == "in  out"


def test_layout_visibility():
    page = (
        "<html><head><title>t</title><style>.ad, #x{display : none} p.gone{display:none}</style><script>var a='<p>s</p>'</script></head>"
        "<body>see<div class='big ad'>1</div><div id=x>2</div><p class=gone>3</p><p hidden>4</p><p style='display:none'>5</p>"
        "<div style='visibility:hidden'>6<span style='visibility:visible'>shown</span></div><template>7</template>"
        "<noscript>8</noscript><details><summary>sum</summary>9</details><details open>open</details><!-- 10 --><textarea>area</textarea>"
    )
    assert render(page).split() == ["see", "shown", "sum", "open", "area"]


def test_layout_odd_pages(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(1, None, None), (2, None, ""), (3, None, deep), (3, None, deep), (None, None, "< a <3 </ > <p"), (5, None, "<b " * 50 + "x"), (6, None, "</p></td>x")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES)
    got = page_texts(df).collect()
    assert len(got) == 7 and [r.text for r in got if r.page_id == 3] == ["deep", "deep"]
    assert [r.text for r in got if r.page_id == 6] == ["x"]
    assert page_texts(df.limit(0)).count() == 0


CHATS = "conv_id long, turn long, role string, text string, formatted string, place int"


def test_chat_round_trip(spark):
    draw = random.Random(3)
    bits = ["<|turn|>", "<|end|>", "<|text|>", "</s>", "[INST]", "[/INST]", "<s>", "\\", "<", "|", "[", "ü\U0001f600", "\n", "<\\|", "\\\\<|", "a"]
    rows = []
    for c in range(60):
        for t in range(draw.randint(1, 6)):
            text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 12)))
            rows.append((c, t, draw.choice(["user", "assistant", "sys<|tem", "", None]), draw.choice([text, text, None]), "x", 1))
    df = spark.createDataFrame(rows + [(None, None, None, None, None, None)], CHATS).repartition(3)
    got = {r.conv_id: r for r in conversation_digests(with_probe(df)).collect()}
    probe = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    groups = {}
    for c, t, role, text, *_ in rows:
        groups.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[None].n_turns == 1 and len(got) == 62
    assert conversation_digests(df.limit(0)).count() == 0


def test_chat_parts(spark):
    df = spark.sql("""
        select 1L as conv_id, 0L as turn, 'user' as role, array(
            named_struct('type','text','text','see <|image:1|>','ref',null,'width',null,'height',null,'seconds',null,'pages',null),
            named_struct('type','image','text',null,'ref','i.png','width',100,'height',56,'seconds',null,'pages',null),
            named_struct('type','audio','text',null,'ref','a.wav','width',null,'height',null,'seconds',1.5D,'pages',null),
            named_struct('type','document','text',null,'ref',null,'width',null,'height',null,'seconds',null,'pages',2)) as parts
        union all select 1L, 1L, 'assistant', null
    """)
    from answerlens.llm.chat import PART_SCHEMA

    row = format_turns(df.withColumn("parts", df["parts"].cast(PART_SCHEMA))).first()
    assert row.formatted == "<|turn|>user<|text|>see <\\|image:1|><|image:1|><|audio:2|><|document:3|><|end|><|turn|>assistant<|text|><|end|>"
    assert [(a.place, a.number, a.type, a.ref, a.tokens) for a in row.attachments] == [
        (1, 1, "image", "i.png", 8), (1, 2, "audio", "a.wav", 38), (1, 3, "document", None, 1500)
    ]
    assert row.attached_tokens == 1546 and [s.length for s in row.loss] == [0]


def vectors(seed=0, n=300, dim=16):
    draw = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = draw.normal(size=dim)
        rows.append((len(rows), v.tolist(), k % 3))
        if k % 4 == 0:
            for noise in (0.05, 0.3, 0.36, 0.4):
                rows.append((len(rows), (v * 3 + noise * 3 * draw.normal(size=dim) / 1.0).tolist(), k % 3))
    rows += [(len(rows), rows[0][1], 0), (len(rows) + 1, rows[0][1], 0), (len(rows) + 2, rows[0][1], None)]
    rows += [(5000, None, 0), (5001, [0.0] * dim, 0), (5002, [float("nan")] * dim, 0), (5003, [1.0] * (dim - 1) + [None], 0),
             (5004, [float("inf")] + [1.0] * (dim - 1), 0), (5005, [], 0), (5006, [1.0, 2.0], 0), (5007, [2.0, 4.0], 0), (5008, [1e-30, 2e-30], 0)]
    return rows


def wanted_links(rows):
    union, links = brute.Union(), {i: 0 for i, *_ in rows}
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows
            if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for k, (i, v, a) in enumerate(good):
        for j, w, b in good[k + 1:]:
            if a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    return {i: (links[i], union.find(i)) for i, *_ in rows}


@pytest.mark.parametrize("whole,block", [(16_384, 1024), (16_384, 16), (40, 16)])
def test_near_vectors(spark, monkeypatch, whole, block):
    rows = vectors()
    monkeypatch.setattr(rotation, "BLOCK", block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as key").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, whole=whole).collect()}
    assert got == wanted_links(rows)
    assert near_vectors(df.limit(0)).count() == 0


HOSTILE = {
    "unmatched": ("<div>" * 100_000 + "</span>" * 100_000 + "x", "x"),
    "behind a cell": ("<i><table><tr><td>" + "<div>" * 50_000 + "</i>" * 50_000 + "x", "x"),
    "equal rules": ("<style>" + ".a{display:none}" * 4_000 + "</style>" + "<p class=a>x</p>" * 4_000 + "<p>y", "y"),
    "rules of one class": (
        "<style>" + "".join(f".x{k}.a{{display:none}}" for k in range(4_000)) + "</style>"
        + "".join(f"<p class='a x{k}'>x</p>" for k in range(4_000)) + "<p class=a>y", "y",
    ),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_layout_is_linear(name):
    page, text = HOSTILE[name]
    begun = time.process_time()
    assert render(page) == text
    assert time.process_time() - begun < 4


def test_cut_groups_find_pairs_close_to_the_threshold(spark):
    """1,500 vectors of one label in many buckets: every planted pair of a cosine from 0.93 to 0.95 is found."""
    draw, rows, dim = np.random.default_rng(8), [], 32
    for k in range(750):
        x, y = draw.normal(size=(2, dim))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        cosine = draw.uniform(0.9302, 0.95)
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, (cosine * x + np.sqrt(1 - cosine**2) * y).tolist(), 0)]
    bits, tables = tables_for(len(rows), whole=50)
    assert bits >= 5 and tables > 10
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, whole=50).collect()}
    assert got == {i: (1, i - i % 2) for i in range(len(rows))}


def test_tables_cover_the_threshold():
    bits, tables = tables_for(1 << 20)
    assert bits > 0 and (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= 1e-5


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x * 0.95 + draw.normal(size=x.shape) * 0.03
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    _, bits, factor = rotation.encode(x)
    estimate, error = rotation.bounds(bits, factor, y @ rotation.rotation(64))
    assert abs((estimate - x @ y.T).mean()) < 0.01
    assert (np.abs(estimate - x @ y.T) <= error).mean() > 0.999
