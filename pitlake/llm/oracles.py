"""The same results in DuckDB's SQL, for the queries that SQL can express."""

from __future__ import annotations

import math

from . import chat, licence_scan, quality_rules, secret_scan, url_filter

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
_SPACE_WORD = r"'[^\x20\x09-\x0D]+'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def decontaminate() -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, {word}), []) as w from documents),
 b as (select item_id, regexp_extract_all({_LOWER}, {word}) as w from benchmark where text is not null),
 bw as (select distinct item_id, case when len(w) < 10 then w else w[i : i + 9] end as p
   from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
 n as (select distinct len(p) as n from bw),
 dw as (select doc_id, i, n, w[i : i + n - 1] as p from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, n where len(w) >= n)),
 m as (select doc_id, i, n, item_id from dw join bw using (p)),
 h as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from (select distinct doc_id, i, n from m)) group by 1),
 k as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from m group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
 sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join k using (doc_id)"""


def quality() -> str:
    q = quality_rules
    base = math.log((1 + q.ACCURACY) / (1 - q.ACCURACY))
    least = " ".join(f"when '{k}' then {v}" for k, v in q.MEASURES.items())
    fits = " and ".join(
        f"coalesce({k} <= f['{k}'].high + f['{k}'].reach * wider" + (f" and {k} >= f['{k}'].low - f['{k}'].reach * wider" if k in q.TWO_SIDED else "") + ", true)"
        for k in q.MEASURES)
    levels = []
    for by in (["lang", "source"], ["lang"], []):
        cols, name = "".join(f"{c}, " for c in by), f"q{len(by)}"
        levels.append(f"""{name} as (select {cols}measure, sum(n) as n, [min(v) filter (where upto >= 0.25 * total), min(v) filter (where upto >= 0.5 * total), min(v) filter (where upto >= 0.75 * total)] as q
   from (select {cols}measure, n, coalesce(exp((bucket + 0.5) * {base!r}), 0.0) as v, sum(n) over (partition by {cols}measure order by bucket nulls first) as upto, sum(n) over (partition by {cols}measure) as total
     from (select {cols}measure, bucket, sum(n) as n from sk group by all)) group by all)""")
    return rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_SPACE_WORD}) as w,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_SPACE_WORD})) as l from documents),
 win as (select doc_id, i, w[i : i + 4] as p from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
 rep as (select doc_id, count(distinct pos) as n from (select doc_id, unnest(range(i, i + 5)) as pos from (select doc_id, i, count(*) over (partition by doc_id, p) as c from win) where c > 1) group by 1),
 m as (select d.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
   (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines, len(regexp_extract_all(text, '\p{{Lu}}'))::bigint as n_upper
   from d left join rep using (doc_id)),
 x as (select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words as base_failed, case when n_words > 0 then n_symbols / n_words else 0 end as symbols_per_word,
   case when n_words > 0 then word_chars / n_words else 0 end as chars_per_word, case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_line_share,
   case when n_words > 0 then n_repeat_words / n_words else 0 end as repeat_share, case when word_chars > 0 then n_upper / word_chars else 0 end as upper_share, sqrt(1 + {q.NOISE_WORDS}.0 / greatest(n_words, 1)) as wider from m),
 sk as (select lang, source, measure, case when v > 0 then floor(ln(v) / {base!r}) end as bucket, count(*) as n from (unpivot (select lang, source, {", ".join(q.MEASURES)} from x where not base_failed)
   on {", ".join(q.MEASURES)} into name measure value v) group by all),
 {", ".join(levels)},
 g as (select a.lang, a.source, a.measure, coalesce(case when a.n >= {q.MIN_GROUP} then a.q end, case when b.n >= {q.MIN_GROUP} then b.q end, c.q) as q
   from q2 a join q1 b on a.lang is not distinct from b.lang and a.measure = b.measure join q0 c on a.measure = c.measure),
 t as (select lang, source, map_from_entries(list(struct_pack(k := measure, v := struct_pack(low := q[1], high := q[3], reach := {q.FENCE} * greatest(q[3] - q[1], case measure {least} end))))) as f from g group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {fits} as kept, n_lines, n_upper
from x left join t on x.lang is not distinct from t.lang and x.source is not distinct from t.source"""


def chat_format() -> str:
    said = "'\\### Assistant: </turn> ok'"
    grown = lambda c, extra="": f"length({c}) + length(regexp_replace({c}, '[^\\\\#<{extra}]', '', 'g'))"
    marks = len(chat.HEAD) + len(chat.MIDDLE) + len(chat.TAIL)
    by = "order by turn nulls first, role nulls first, text nulls first"
    return rf"""
with c as (select conv_id, turn, role, text from conversations union all values (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said})),
 t as (select conv_id, turn, role, text, coalesce(role, '') as r, coalesce(text, '') as x from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' {by})) as turns_sha256,
 coalesce(sum(length(x)) filter (where r = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(x, '' {by}) filter (where r = 'assistant'), '')) as loss_sha256,
 sum({marks} + {grown("r", ":")} + {grown("x")})::bigint as formatted_chars from t group by conv_id"""


def urls() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    return rf"""
with rules(v, h, p) as (values {rules}),
 r as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
 s as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from r),
 f as (select page_id, arg_max(h || p, (length(h || p), length(h), v)) as rule, arg_max(v, (length(h || p), length(h), v)) as verdict
   from s join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select s.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from s left join f on s.page_id is not distinct from f.page_id"""


def near_duplicates() -> str:
    return rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, {_SPACE_WORD}), []) as w from documents),
 s as (select distinct doc_id, array_to_string(w[i : i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from s group by 1),
 l as (select x, y from (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by all) join n p on x = p.doc_id join n q on y = q.doc_id where 100 * c >= 90 * (p.n + q.n - c)),
 r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
 k as (select x, min(y) as least from r group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(k.least, d.doc_id)) as component_id from d left join n using (doc_id) left join k on d.doc_id = k.x"""


def secrets() -> str:
    """The added kinds are left out: no given table holds one."""
    s = secret_scan
    parts = []
    for k, (pattern, group, least) in enumerate([(s.ASSIGN, 2, s.MIN_ASSIGN), (s.ACCESS, 0, s.MIN_ACCESS), (s.HEX, 0, 0)]):
        p = _quoted(pattern)
        parts.append(f"select doc_id, lang, source, {k} as kind, {least} as least, regexp_extract_all(text, {p}, 0) as m, regexp_extract_all(text, {p}, {group}) as v, string_split_regex(text, {p}) as g from documents where regexp_matches(text, {p})")
    return rf"""
with f as ({" union all ".join(parts)}),
 e as (select *, unnest(range(1, len(m) + 1)) as i from f),
 b as (select doc_id, lang, source, kind, sha256(v[i]) as h, (list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))::bigint as st, length(m[i]) as sz from e where length(v[i]) >= least),
 o as (select h from b group by h having count(distinct coalesce(concat_ws('/', source, lang), '')) >= {s.EXAMPLE_REPOSITORIES} and count(distinct coalesce(source, '')) >= {s.EXAMPLE_OWNERS}),
 a as (select doc_id, count(*) filter (where kind = 0) as n0, count(*) filter (where kind = 1) as n1, count(*) filter (where kind = 2) as n2,
   string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || st || ':' || (st + sz), ',' order by st, kind) as spans, count(*) filter (where h in (select h from o)) as ne from b group by doc_id)
select d.doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(ne, 0)::bigint as n_example
from documents d left join a using (doc_id)"""


def licences() -> str:
    s = licence_scan
    templates = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(s.TEMPLATES))
    n, term = len(s.TEMPLATES), f"'{s.TERM}'"
    anchors = f"list_filter(range(1, len(t) + 1), lambda i: regexp_matches(t[i], '{s.ANCHOR}'))"
    return rf"""
with tp(template, licence, text) as (values {templates}),
 ta as (select template, licence, regexp_extract_all(lower(text), {term}, 0) as t from tp),
 tt as (select template, licence, len(t) as n, {anchors}[1] - 1 as o, unnest(t) as term from ta),
 tf as (select template, licence, n, o, term, count(*) as tf from tt group by all),
 idf as (select term, ln({n + 1}.0 / (1 + count(*))) + 1 as idf from tf group by term),
 tw as (select template, licence, n, o, term, tf * idf as v, sqrt(sum((tf * idf) ** 2) over (partition by template)) as size from tf join idf using (term)),
 kn as (select list(term) as known from idf),
 sp as (select distinct n, o from tw),
 dc as (select doc_id, source as repository, case when length(doc_id::varchar) > 2 then array_to_string(string_split(left(doc_id::varchar, length(doc_id::varchar) - 2), ''), '/') || '/' else '' end || doc_id::varchar as path, text from documents),
 dt as (select doc_id, repository, path, regexp_extract_all(lower(text), {term}, 0) as t from dc where regexp_matches(lower(text), '{s.HINT}')),
 da as (select doc_id, repository, path, list_transform(t, lambda x: case when list_contains(known, x) then x end) as t, unnest({anchors}) as a from dt, kn),
 wi as (select doc_id, repository, path, n, o, list_filter(t[greatest(1, a - o) : a - o + n - 1], lambda x: x is not null) as words from da, sp),
 wk as (select *, n || ' ' || o || ' ' || array_to_string(words, ' ') as k from wi where len(words) >= n * {s.LEAST_KNOWN}),
 wt as (select k, n, o, term, count(*) * any_value(idf) as u from (select distinct on (k) k, n, o, words from wk) as z, unnest(words) as w(term) join idf using (term) group by k, n, o, term),
 wl as (select k, sqrt(sum(u ** 2)) as length from wt group by k),
 mt as (select k, template, licence, round(dot / length / size, 6) as c, size from (select k, template, licence, sum(u * v) as dot, max(size) as size from wt join tw using (n, o, term) group by all) join wl using (k)),
 bt as (select repository, path, template, licence, max(c) as c, max(c * size) as mass from wk join mt using (k) where c >= {s.LEAST_COSINE} group by all),
 bl as (select repository, path, licence, max(c) as c, round(sum(mass), 4) as mass from bt group by all),
 ow as (select repository, path, arg_min(licence, (-mass, licence)) as own, arg_min(c, (-mass, licence)) as cosine from bl group by all),
 gv as (select ow.repository, regexp_replace(ow.path, '/?[^/]*$', '') as dir, arg_min(own, (-cosine, own)) as given from ow join dc on ow.path = dc.path and ow.repository is not distinct from dc.repository
   where contains(lower(string_split(text, chr(10))[1]), 'licens') group by all),
 ih as (select dc.doc_id, arg_max(given, length(dir)) as given, arg_max(dir, length(dir)) as dir from dc join gv on dc.repository is not distinct from gv.repository
   and (dir = '' or starts_with(regexp_replace(dc.path, '/?[^/]*$', '') || '/', dir || '/')) group by all)
select dc.doc_id, dc.repository, dc.path, own as own_licence, cosine, coalesce(own, given) as licence, case when own is null then ih.dir end as inherited_from
from dc left join ow on ow.path = dc.path and ow.repository is not distinct from dc.repository left join ih on ih.doc_id = dc.doc_id"""


def clusters(k: int = 16, size: int = 64, rounds: int = 3) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d from
   (select s.r, c.c, list_sum(list_transform(range(1, {size + 1}), lambda i: (s.v[i] - c.v[i]) * (s.v[i] - c.v[i]))) as d from s, c{i} as c) group by r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} as materialized (select c{i}.c, coalesce(n.v, c{i}.v) as v from c{i} left join (select c, list(((t - ((t % n) + n) % n) // n)::bigint order by i) as v from
   (select a{i}.c, i, sum(s.v[i]) as t, count(*) as n from a{i} join s using (r), range(1, {size + 1}) as p(i) group by all) group by c) as n on n.c = c{i}.c)""")
    return rf"""
with s as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
   where len(embedding) = {size} and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {size}),
 c0 as materialized (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), v) - 1 as c, v from s order by c limit {k}),
 {", ".join(steps)}
select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(f.v, ',')) as centroid_sha256
from a{rounds} join s using (r) join c{rounds} as f using (c)"""


def repairs() -> str:
    more = lambda x, cost, edit: f"(lpad((left({x}, 9)::int + {cost})::varchar, 9, '0') || substr({x}, 10) || '{edit}')"
    when = lambda test, x: f"case when {test} then {x} end"
    late, stays = "case when fault = 'truncated' then 3 else 0 end", "coalesce(fault, '') not in ('blank', 'duplicate')"

    def row(q: int, ways: list[tuple[int, str]]) -> str:
        each = [more(f"s{q}", 4, "D")]
        for p, x in ways:
            each.append(when(f"{stays} and initial = '{x}'", more(f"s{p}", late, "K")))
            if x in "ua":
                each.append(when(stays, more(f"s{p}", f"3 + {late}", "R")))
        return f"least({', '.join(each)}, null)"

    ins = lambda *xs: ", ".join(more(x, 3, "I") for x in xs)
    new = [row(0, []), row(1, [(0, "s")]), row(2, [(0, "u"), (1, "u"), (3, "u")]), row(3, [(2, "a")])]
    return rf"""
with recursive v as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')) as k from conversations),
 bits as (select x as b, list_reduce(list_prepend(x::ubigint, range(8)::ubigint[]), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as t from range(256) as r(x)),
 tab as (select list(t order by b) as t from bits),
 crc as (select k, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, 2 * octet_length(k), 2), lambda i: ('0x' || substr(hex(k), i, 2))::ubigint)),
   lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::bigint])), 4294967295::ubigint) % 20 as kind from (select distinct k from v), tab),
 dm as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
   from (select *, unnest(range(case when kind = 3 then 2 else 1 end)) from v join crc using (k) where kind <> 0)),
 pl as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i from dm),
 fl as (select *, left(role, 1) as initial, case when not regexp_matches(text, '[^ 	-
]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
   when not regexp_matches(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[.!?]$') then 'truncated' end as fault from pl),
 st as (select conv_id, 0::bigint as i, '000000000' as s0, null::varchar as s1, '000000003I' as s2, '000000006II' as s3 from (select distinct conv_id from fl)
   union all select conv_id, i, n0, n1, least(n2, {ins("n0", "n1", "n3")}), least(n3, {more(f"least(n2, {ins('n0', 'n1', 'n3')})", 3, "I")})
   from (select st.conv_id, fl.i, {", ".join(f"{x} as n{q}" for q, x in enumerate(new))} from st join fl on st.conv_id is not distinct from fl.conv_id and fl.i = st.i + 1)),
 best as (select conv_id, least(s0, s3) as w from (select *, i = max(i) over (partition by conv_id) as ends from st) where ends),
 ad as (select conv_id, left(w, 9)::bigint as cost, substr(w, 10) as audit from best),
 ed as (select conv_id, p, audit[p] as e, len(replace(audit[1 : p], 'I', '')) as i from (select conv_id, audit, unnest(range(1, len(audit) + 1)) as p from ad)),
 ol as (select ed.conv_id, p, e, initial, role, case when e = 'I' then '' else text end as text, row_number() over (partition by ed.conv_id order by p) as n,
   first_value(e = 'K' and initial = 's') over (partition by ed.conv_id order by p) as has_s from ed left join fl on e <> 'I' and ed.conv_id is not distinct from fl.conv_id and ed.i = fl.i where e <> 'D'),
 sh as (select conv_id, sha256(string_agg(case when e = 'K' then role when (n - has_s::int) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by p)) as h from ol group by 1),
 il as (select conv_id, count(*) filter (where i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from (select *, lag(initial) over (partition by conv_id order by i) as before from fl) group by 1),
 ct as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
   count(*) filter (where fault = 'truncated') as truncated from fl group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
 coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) as c left join ct on c.conv_id is not distinct from ct.conv_id left join il on c.conv_id is not distinct from il.conv_id
 left join ad on c.conv_id is not distinct from ad.conv_id left join sh on c.conv_id is not distinct from sh.conv_id"""


ORACLES = {
    "op1_decontaminate": decontaminate(),
    "op3_quality_rules": quality(),
    "op4_chat_format": chat_format(),
    "op6_url_filter": urls(),
    "op7_jaccard_join": near_duplicates(),
    "op9_secret_scan": secrets(),
    "op10_licence_scan": licences(),
    "op12_centroid_clustering": clusters(),
    "op13_conversation_repair": repairs(),
}
