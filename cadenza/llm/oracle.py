"""DuckDB SQL for the queries that SQL can express.

Mixing and packing (random or order-dependent choices) and the classifier have none; tests check them.
"""

from . import licenses, quality, secrets, urls

_WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op1_ngram_join"] = rf"""
with recursive t as (select doc_id, translate(coalesce(text, ''), '{urls.UPPER}', '{urls.UPPER.lower()}') as t from documents),
w as (select doc_id, regexp_extract_all(t, '{_WORD}') as w from t),
g as (select distinct doc_id, g from (
  select doc_id, array_to_string(list_slice(w, i, i + 4), chr(1)) as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5) x
  union all select doc_id, array_to_string(w, chr(1)) from w where len(w) between 1 and 4) y),
n as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.c >= 75 * (x.n + y.n - p.c)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select a, min(b) as m from r group by 1) m on m.a = d.doc_id"""

SQL["op3_embedding_dedup"] = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null
 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98e0),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
n as (select a, count(*) as n from l group by 1), m as (select a, min(b) as m from r group by 1)
select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(m.m, e.vec_id)) as component_id, least(e.vec_id, coalesce(m.m, e.vec_id)) = e.vec_id as kept
from embeddings e left join n on n.a = e.vec_id left join m on m.a = e.vec_id"""


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' as kind, k, cast(sum(gap) over w + coalesce(sum(size) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as s, size, n from (
 select doc_id, unnest(range(1, len(m) + 1)) as k, unnest(list_transform(list_slice(b, 1, len(m)), lambda x: length(x))) as gap, unnest(list_transform(m, lambda x: length(x))) as size, unnest(list_transform(c, lambda x: length(x))) as n
 from (select doc_id, string_split_regex(t, '{p}') as b, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {group}) as c from t where regexp_matches(t, '{p}')) z) y
 window w as (partition by doc_id order by k) qualify n >= {least}"""


#: RE2 has no lookbehind, so the SQL keeps \b: unlike the query, it knows no prefixed names (DB_USER) and no bare access ids.
_WEAK = (
    ("identifier", r"""\b(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""),
    ("secret", r"""\b(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|auth|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    ("endpoint", r"""\b(?:(?i:https?|ftp|ssh|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)(?::[a-z]+)?://[^\s"'<>|]+|(?i:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z0-9:/.-]+)"""),
)
_RANK = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(secrets.ORDER)) + " end"
SQL["op5_secret_scans"] = f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
base as ({" union all ".join(f"select doc_id, kind, s, s + size as e from ({_spans(*b)}) q" for b in secrets.BASE)}),
weak as ({" union all ".join(f"select doc_id, kind, s, s + size as e from ({_spans(k, p, 0, 0)}) q" for k, p in _WEAK)}),
near as (select x.doc_id, x.s, x.e, y.kind, arg_min((y.s, y.e), abs(y.s - x.s) * 1000000 + y.s) as o from weak x join weak y on x.doc_id = y.doc_id and x.kind = 'secret' and y.kind <> 'secret' and abs(x.s - y.s) <= 200 group by 1, 2, 3, 4),
full_ as (select doc_id, s, e from near group by 1, 2, 3 having count(*) = 2),
linked as (select doc_id, 'linked_secret' as kind, s, e from full_ union select n.doc_id, 'linked_' || n.kind, n.o[1], n.o[2] from near n join full_ f on f.doc_id = n.doc_id and f.s = n.s and f.e = n.e),
every as (select *, {_RANK} as r from (select * from base union all select * from linked) u),
b as (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
 string_agg(kind || ':' || s || ':' || e, ',' order by s, r) filter (where r < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, r) as spans from every group by 1)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join b on b.doc_id = d.doc_id"""

_FITS = [
    f"case when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {len(h + p) * 100 + k} end" for k, (_, h, p) in enumerate(urls.RULES)
]
_BEST = "greatest(" + ", ".join(f"coalesce({x}, -1)" for x in _FITS) + ")"
SQL["op6_url_filters"] = rf"""
with u as (select page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{urls.UPPER}', '{urls.UPPER.lower()}') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
k as (select *, {_BEST} as best, regexp_replace(host, '^(?:www|m)\.|:\d+$', '', 'g') || regexp_replace(path, '(?:/index)?(?:\.html?)?/*$', '') as url from u),
l as (select distinct url from k where url <> '' and (regexp_matches(host, '(^|[.])({"|".join(urls.SPAM_NAMES)})([.]|$)') or len(regexp_extract_all(coalesce(html, ''), '{urls.JUNK}')) >= {urls.JUNK_RUNS})),
r as (select * from (values {", ".join(f"({len(h + p) * 100 + i}, '{h + p}', '{v}')" for i, (v, h, p) in enumerate(urls.RULES))}) v(best, rule, verdict))
select k.page_id, k.host, k.path, r.rule, coalesce(r.verdict, case when l.url is not null then 'block' else 'allow' end) as verdict
from k left join r on r.best = k.best left join l on l.url = k.url"""

_TEMPLATES = ", ".join(
    f"({i}, '{label}', [{', '.join(repr(w.decode()) for w in sorted(set(licenses.block_words(x))))}])" for i, (label, x) in enumerate(licenses.TEMPLATES)
)
_PHRASES = " union all ".join(
    f"select doc_id, '{label}' as label, i - 1 as pos from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w) z where list_slice(w, i, i + {len(p.split()) - 1}) = [{', '.join(repr(x) for x in p.split())}]"
    for p, label in licenses.PHRASES
)
SQL["op7_license_scans"] = rf"""
with t as (select doc_id, translate(coalesce(text, ''), '{urls.UPPER}', '{urls.UPPER.lower()}') as t from documents),
w as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from t),
hits as ({_PHRASES}),
b as (select doc_id, count(*) as n, min(pos) as f, max(pos) as l, list_sort(list_distinct(list(label))) as labels from hits group by 1),
tm as (select * from (values {_TEMPLATES}) v(id, label, tokens)),
ln as (select doc_id, regexp_extract_all(unnest(string_split(t, chr(10))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as wl from t),
bl as (select doc_id, list_distinct(list_slice(wl, s + 1, s + {2 * licenses.reach_of()})) as own from (select doc_id, wl, unnest(range(0, greatest(len(wl) - {licenses.reach_of()}, 1), {licenses.reach_of()})) as s from ln) x),
m as (select doc_id, label, len(list_intersect(own, tokens)) / cast(len(tokens) as double) as share from bl, tm where len(own) > 0 and 100 * len(list_intersect(own, tokens)) >= 80 * len(tokens)
 and list_has_all(own, list_filter(tokens, lambda x: x in {licenses.MARKS}))),
mm as (select doc_id, list(distinct label) as labels, max(share) as share from m group by 1)
select w.doc_id, len(w.w) as n_words, coalesce(b.n, 0) as n_base, b.f as first_word, b.l as last_word, coalesce(array_to_string(b.labels, ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(mm.labels, [])))), ','), '') as labels,
 case when b.n > 0 then 1e0 else coalesce(mm.share, 0e0) end as score
from w left join b on b.doc_id = w.doc_id left join mm on mm.doc_id = w.doc_id"""

SQL["op8_line_dedup"] = rf"""
with e as (select doc_id, unnest(range(0, len(l))) as k, unnest(l) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents) x),
w as (select *, regexp_extract_all(line, '{_WORD}') as w from e),
c as (select * from w where len(w) >= 5),
f as (select line, w, doc_id, k, row_number() over (order by doc_id, k) as pos from (select *, row_number() over (partition by line order by doc_id, k) as rn from c) y where rn = 1),
v as (select pos, len(w) as n, i, array_to_string(list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, len(w))), chr(1)) as g from (select pos, w, unnest(range(1, len(w) + 1)) as i from f where len(w) >= 10) z),
same as (select pos, min(pos) over (partition by n, i, g) as earlier from v),
less as (select greatest(v.pos, f.pos) as pos, least(v.pos, f.pos) as earlier from v join f on len(f.w) >= 10 and v.n = len(f.w) + 1 and v.g = array_to_string(f.w, chr(1))),
near as (select distinct pos from (select * from same union all select * from less) u where earlier < pos),
gone as (select c.doc_id, c.k, n.pos is not null as near from c join f on f.line = c.line left join near n on n.pos = f.pos where n.pos is not null or (f.doc_id, f.k) <> (c.doc_id, c.k)),
s as (select e.doc_id, count(*) as n_lines, count(*) filter (where g.near is false) as n_exact, count(*) filter (where g.near) as n_near, coalesce(string_agg(e.line, chr(10) order by e.k) filter (where g.k is null), '') as t
 from e left join gone g on g.doc_id = e.doc_id and g.k = e.k group by 1)
select d.doc_id, case when d.text is null then 0 else n_lines end as n_lines, n_exact, n_near, length(t) as n_left, sha256(t) as left_sha256 from documents d join s on s.doc_id = d.doc_id"""

_COUNT = "(length(l) - length(regexp_replace(l, '{}', '', 'g')))"
_BOILER = "|".join(quality.BOILERPLATE)
SQL["op9_quality_rules"] = rf"""
with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{_WORD}') as w from t),
win as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3) x),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from win) y where c > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) z group by 1),
ln as (select doc_id, unnest(string_split(t, chr(10))) as l from t),
lw as (select *, len(regexp_extract_all(l, '{_WORD}')) as n from ln),
lf as (select *, n > 0 and ({_COUNT.format('[#*$%&<>]')} > 0.25e0 * n or {_COUNT.format('!!')} * 3 >= 2 * n or ({_COUNT.format('[|>»·]')} >= 3 and {_COUNT.format('[|>»·]')} * 3 >= n)
 or (n >= 3 and {_COUNT.format(r'\p{Lu}')} > 0.6e0 * {_COUNT.format(r'\p{L}')}) or (n <= {quality.BOILERPLATE_WORDS} and regexp_matches(lower(l), '{_BOILER}'))) as bad from lw),
ls as (select doc_id, count(*) filter (where n > 0) - count(distinct l) filter (where n > 0) as dup, coalesce(sum(n) filter (where bad), 0) as lost from lf group by 1),
f as (select w.doc_id, len(w.w) as n_words, length(regexp_replace(w.t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')) as n_symbols,
 ls.dup as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, cast(ls.lost as bigint) as lost_words from w join ls on ls.doc_id = w.doc_id left join cov on cov.doc_id = w.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_words <= 0.5e0 * n_words as kept from f"""
