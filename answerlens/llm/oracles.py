"""DuckDB SQL for the queries that it can express over the same tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[ \t-\r]+'"

CHAT = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e as (
  select *, 8 + 8 + 7 + length(role) + length(text) + length(role || text) - length(replace(role || text, '\', ''))
    + len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]')) as n from c
),
g as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as learned, sum(n) as n
  from e group by conv_id
)
select conv_id, CAST(n_turns AS BIGINT) as n_turns, sha256(turns) as turns_sha256, CAST(length(learned) AS BIGINT) as loss_chars,
  sha256(learned) as loss_sha256, CAST(n AS BIGINT) as formatted_chars
from g"""

SUBSTRINGS = f"""
with d as (select doc_id, {WORDS} as w from documents),
t as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
k as (select doc_id, i, w[i] as word, case when i + 12 <= len(w) then array_to_string(list_slice(w, i, i + 12), ' ') end as key from t),
f as (select key, min(doc_id) as first from k where key is not null group by key),
j as (select k.doc_id, k.i, k.word, coalesce(f.first < k.doc_id, false) as hit from k left join f on f.key = k.key),
r as (select *, bool_or(hit) over (partition by doc_id order by i rows between 12 preceding and current row) as gone from j),
a as (
  select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed,
    string_agg(case when not gone then word end, ' ' order by i) as kept
  from r group by doc_id
)
select d.doc_id, CAST(coalesce(a.n_words, 0) AS BIGINT) as n_words, CAST(coalesce(a.n_removed, 0) AS BIGINT) as n_removed,
  sha256(coalesce(a.kept, '')) as kept_sha256
from d left join a on a.doc_id = d.doc_id"""

VECTORS = """
with v as (select vec_id, label, CAST(embedding AS DOUBLE[]) as e from embeddings where label is not null),
l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93
),
r as (
  with recursive r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a)
  select a, min(b) as least from r group by a
)
select e.vec_id, CAST((select count(*) from l where l.a = e.vec_id) AS BIGINT) as n_links, r.least as component_id,
  e.vec_id = r.least as kept
from embeddings e join r on r.a = e.vec_id"""

_COVERED = """
s{n} as (select doc_id, i, case when i + {m} <= len(w) then array_to_string(list_slice(w, i, i + {m}), ' ') end as key from t),
o{n} as (select doc_id, i, key is not null and {again} as hit from s{n}),
c{n} as (select doc_id, i, bool_or(hit) over (partition by doc_id order by i rows between {m} preceding and current row) as hit from o{n}),
"""
_LATER = "row_number() over (partition by doc_id, key order by i) > 1"
_TWICE = "count(*) over (partition by doc_id, key) > 1"


def repetition(shares: dict[int, float], line_share: float, header_lines: int, header_words: int) -> str:
    """SQL of the repetition rules under given limits."""
    parts = _COVERED.format(n=3, m=2, again=_TWICE) + "".join(
        _COVERED.format(n=n, m=n - 1, again=_LATER) for n in shares
    )
    sums = "".join(
        f"p{n} as (select t.doc_id, sum(length(t.w[t.i])) as chars from t join c{n} c on c.doc_id = t.doc_id and c.i = t.i where c.hit and not exists (select 1 from f where f.doc_id = t.doc_id and f.i = t.i) group by t.doc_id),\n"
        for n in shares
    )
    room = "greatest(m.word_chars, 1)"
    share = {n: f"coalesce(p{n}.chars, 0) / CAST({room} AS DOUBLE)" for n in shares}
    over = " or ".join(f"{share[n]} > {most}" for n, most in shares.items())
    joins = " ".join(f"left join p{n} on p{n}.doc_id = m.doc_id" for n in shares)
    return f"""
with d as (select doc_id, coalesce(text, '') as text, {WORDS} as w from documents),
t as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from d),
y as (
  select *, length(regexp_replace(line, {_BLANK}, '', 'g')) as chars, len(regexp_extract_all(line, '[^ \t-\r]+')) as size
  from l where length(regexp_replace(line, {_BLANK}, '', 'g')) > 0
),
z as (
  select *, row_number() over (partition by doc_id, line order by i) > 1 as again,
    sum(size) over (partition by doc_id order by i) - size as before
  from y
),
u as (
  select *, again and size <= {header_words} and count(*) filter (where again) over (partition by doc_id) <= {header_lines} as header
  from z
),
f as (select doc_id, before + unnest(range(1, size + 1)) as i from u where header),
n as (select doc_id, count(*) as lines, coalesce(sum(chars) filter (where not header), 0) as chars from u where again group by doc_id),
{parts}{sums}
q as (select doc_id, count(*) as n from c3 where hit group by doc_id),
m as (
  select d.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n.lines, 0) as n_dup_lines, coalesce(n.chars, 0) as line_chars, coalesce(q.n, 0) as n_repeat_words
  from d left join q on q.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
),
x as (
  select m.doc_id, CAST(m.n_words AS BIGINT) as n_words, CAST(m.word_chars AS BIGINT) as word_chars, CAST(m.n_symbols AS BIGINT) as n_symbols,
    CAST(m.n_dup_lines AS BIGINT) as n_dup_lines, CAST(m.n_repeat_words AS BIGINT) as n_repeat_words,
    greatest({", ".join(share.values())}) as ngram_share, m.line_chars / CAST({room} AS DOUBLE) as line_share,
    m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words as base_failed, {over} as too_much
  from m {joins}
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ngram_share, line_share, base_failed,
  not base_failed and not too_much and line_share <= {line_share} as kept
from x"""


NEAR = rf"""
with d as (select doc_id, regexp_extract_all({LOWER}, '[^ \t-\r]+') as w from documents),
s as (
  select distinct doc_id, key from (
    select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
                               when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as key from d)
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.key = b.key and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.common >= 75 * (x.n + y.n - p.common)),
r as (
  with recursive r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a)
  select a, min(b) as least from r group by a
)
select d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) as n_shingles, r.least as component_id, d.doc_id = r.least as kept
from d join r on r.a = d.doc_id left join n on n.doc_id = d.doc_id"""

WARC = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as bytes from pages),
q as (select html, max(page_id) as last from p where bytes >= 1000 group by html)
select p.page_id, CAST(p.bytes AS BIGINT) as payload_bytes, sha1(p.html) as payload_digest,
  case when q.last <> p.page_id then 'revisit' else 'response' end as record_type,
  case when q.last <> p.page_id then q.last end as refers_to
from p left join q on q.html = p.html"""
