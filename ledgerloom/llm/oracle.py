"""SQL (DuckDB) for the operators that SQL can express: the definitions said plainly, without regard to cost."""

from __future__ import annotations

from .rules import CUTOFFS, MEASURES

_WORDS = "docs as (select doc_id, lang, coalesce(text, '') text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') w from documents)"

SUFFIX_ARRAY = """with docs as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
piece as (select doc_id, n, k * 250 base, substr(h, k * 500 + 1, 698) p from (select doc_id, n, h, unnest(range(0, (n + 249) // 250)) k from docs)),
pos as (select doc_id, n, base + j i, p, j from (select doc_id, n, base, p, unnest(range(1, least(250, n - base) + 1)) j from piece)),
win as (select doc_id, i, md5(substr(p, 2 * j - 1, 200)) s from pos where i <= n - 99),
rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) rn from win) where rn > 1),
gone as (select pos.doc_id, pos.i, substr(p, 2 * j - 1, 2) b, coalesce(max(rep.i) over (partition by pos.doc_id order by pos.i) >= pos.i - 99, false) g from pos left join rep on pos.doc_id = rep.doc_id and pos.i = rep.i),
run as (select *, g and not coalesce(lag(g) over (partition by doc_id order by i), false) s from gone),
sums as (select doc_id, count(*) filter (g) n_removed, count(*) filter (s) n_spans, string_agg(b, '' order by i) filter (not g) kept from run group by 1)
select docs.doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from docs left join sums using (doc_id)"""

SUBSTRINGS = f"""with {_WORDS}, pos as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i from docs),
win as (select doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') s from (select doc_id, w, unnest(range(1, len(w) - 18)) i from docs where len(w) >= 20)),
rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) rn from win) where rn > 1),
gone as (select pos.doc_id, pos.i, word, coalesce(max(rep.i) over (partition by pos.doc_id order by pos.i) >= pos.i - 19, false) g from pos left join rep on pos.doc_id = rep.doc_id and pos.i = rep.i),
sums as (select doc_id, count(*) filter (g) n_removed, string_agg(word, ' ' order by i) filter (not g) kept from gone group by 1)
select docs.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from docs left join sums using (doc_id)"""


def sharding(shards: int = 8) -> str:
    """The smallest capacity by dynamic programming over all cuts, then greedy filling under it."""
    steps = ", ".join(f"f{k} as (select b.j, min(greatest(a.c, b.p - s.p)) c from f{k - 1} a join g s on s.j = a.j join g b on b.j >= a.j group by 1)" for k in range(2, shards + 1))
    cuts = ", ".join(f"c{k} as (select max(p) c from g where p <= (select c from f{shards} where j = (select max(j) from g)) + (select c from c{k - 1}))" for k in range(1, shards))
    marks = " + ".join(f"((select c from c{k}) < p)::int" for k in range(1, shards))
    return f"""with texts as (select coalesce(text, '') t, min(doc_id) first, sum(strlen(coalesce(text, '')) + 1)::bigint size from documents group by 1),
g as (select t, first, row_number() over (order by first) j, (sum(size) over (order by first))::bigint p from texts), f1 as (select j, p c from g), {steps}, c0 as (select 0::bigint c), {cuts},
tab as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) t8),
crc as (select t, xor(list_reduce(list_transform(range(1, strlen(t) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint), lambda c, b: xor(c >> 8, t8[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) text_crc32 from (select t, hex(encode(t)) h from g), tab),
placed as (select doc_id, (strlen(g.t) + 1)::bigint size, text_crc32, first, ({marks})::int shard from documents d join g on g.t = coalesce(d.text, '') join crc on crc.t = g.t)
select doc_id, size, text_crc32::bigint text_crc32, 'bytes' law, shard, (row_number() over (partition by shard order by first, doc_id) - 1)::bigint slot, null::int grown_shard from placed"""


def quality_rules(alpha: float = 0.05, delta: float = 0.05) -> str:
    values = ", ".join(f"('{r}', {c}::double)" for r, cuts in CUTOFFS.items() for c in cuts)
    measure = " ".join(f"when '{r}' then {m.replace('0d', '0.0::double')}" for r, m in MEASURES.items()).replace("n_", "m.n_").replace("word_chars", "m.word_chars").replace(" / ", "::double / ")
    p, tests = alpha / len(CUTOFFS), sum(map(len, CUTOFFS.values()))
    return f"""with {_WORDS},
win as (select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') s from (select doc_id, w, unnest(range(1, len(w) - 6)) i from docs where len(w) >= 8)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) c from win) where c > 1),
rep as (select doc_id, count(distinct i + k) n from twice, range(8) t(k) group by 1),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0b\\f\\r]')) l from docs),
m as (select docs.doc_id, coalesce(lang, '') stratum, len(w)::bigint n_words, len(array_to_string(w, ''))::bigint word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, len(l) n_lines,
 coalesce(rep.n, 0)::bigint n_repeat_words, len(regexp_replace(text, '[^A-Z]', '', 'g')) n_upper, len(regexp_replace(text, '[^!]', '', 'g')) n_marks from docs join lines using (doc_id) left join rep using (doc_id)),
cuts(rule, cutoff) as (values {values}),
good as (select m.*, rule, cutoff, (case rule {measure} end) > cutoff as above from m, cuts where doc_id in (select doc_id from labels where quality = 1)),
k as (select stratum, rule, cutoff, count(*) n, count(*) filter (above) k from good m group by 1, 2, 3),
tail as (select stratum, rule, cutoff, n, k, case when k >= n * {p} then 1.0 else (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}::double) + (n - i) * ln(1 - {p}::double))) from range(0, k + 1) t(i)) end pr from k),
limits as (select stratum, rule, min(cutoff) cutoff from tail where pr <= {delta} / ({tests} * (select count(distinct stratum) from k)) group by 1, 2),
failed as (select distinct doc_id from m join limits using (stratum) where (case rule {measure} end) > cutoff),
verdict as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from failed) kept from verdict"""

FILTER_AUDIT = """with d as (select row_number() over () r, doc_id, coalesce(lang, '') part, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') w from documents),
f as (select part, doc_id in (select doc_id from labels where quality = 1) good, doc_id in (select doc_id from labels where toxic = 1) toxic,
 {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': exists (select 1 from d e where e.t = d.t and e.doc_id < d.doc_id)} x from d),
doc as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic, concat(case when x.A then 'A' else '' end, case when x.B then 'B' else '' end, case when x.C then 'C' else '' end, case when x.D then 'D' else '' end, case when x.E then 'E' else '' end) fails from f),
l(c) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (select concat(a.c, b.c, c.c, d.c, e.c) o from l a, l b, l c, l d, l e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
kinds as (select part, good, toxic, fails, count(*)::bigint n from doc group by all),
gone as (select part, good, toxic, fails, n, o, case when fails = '' then 6 else list_min([instr(o, x) for x in string_split(fails, '')]) end place from kinds, orders),
steps as (select distinct part, o, k::int k, o[k] c from gone, range(1, 6) r(k)),
sums as (select s.part, s.o, s.k, s.c, coalesce(sum(n) filter (place > s.k), 0)::bigint kept, coalesce(sum(n) filter (place = s.k), 0)::bigint removed, coalesce(sum(n) filter (place < s.k and contains(fails, s.c)), 0)::bigint redundant,
 coalesce(sum(n) filter (fails = s.c), 0)::bigint unique_fails, coalesce(sum(n) filter (place = s.k and good), 0)::bigint good_lost, coalesce(sum(n) filter (place = s.k and toxic), 0)::bigint toxic_lost from steps s join gone g on g.part = s.part and g.o = s.o group by 1, 2, 3, 4)
select part, o filter_order, k step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, c))::bigint shapley from sums"""

CONVERSATIONS = """with recursive tab as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) t8),
raw as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, hex(encode(concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')))) h from conversations),
crc as (select conv_id, turn, role, text, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint), lambda c, b: xor(c >> 8, t8[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 z from raw, tab),
hit as (select conv_id, turn, case z when 4 then 'user' else role end as role, case z when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case z when 3 then 2 else 1 end)) copy from crc where z <> 0),
conv as (select row_number() over () g, conv_id from (select distinct conv_id from conversations)),
rows as (select g, turn, role, text, left(role, 1) c, row_number() over (partition by g order by turn nulls first, role, text, copy) i, rtrim(text, e' \\t\\n\\x0b\\f\\r') body from hit join conv on hit.conv_id is not distinct from conv.conv_id),
f as (select *, body = '' blank, body <> '' and row_number() over (partition by g, role, text order by i) > 1 dup, body <> '' and right(body, 1) not in ('.', '!', '?') trunc, lag(c) over (partition by g order by i) b from rows),
r as (select *, blank or dup del, case when trunc then 5 else 0 end t from f),
n as (select g, max(i) n from r group by 1),
v as (select g, n + 1 i, 0::bigint v0, 10::bigint vs, 5::bigint vu, 0::bigint va from n union all
 select g, i, least(e0, 5 + eu, 10 + ea), least(es, 5 + eu, 10 + ea), least(eu, 5 + ea, 10 + es), least(ea, 5 + eu) from (select r.g, r.i, least(2 + v0, case when not del and c = 's' then t + vs end, case when not del then t + (c <> 'u')::int + vu end) e0,
 least(2 + vs, case when not del then t + (c <> 'u')::int + vu end) es, least(2 + vu, case when not del then t + (c <> 'a')::int + va end) eu, least(2 + va, case when not del then t + (c <> 'u')::int + vu end) ea from v join r on r.g = v.g and r.i = v.i - 1)),
w as (select g, 1::bigint i, '0' q, '' audit, []::varchar[] lines, false fin from n union all
 select g, case e when 'I' then i when '' then i else i + 1 end, case e when 'D' then q when '' then q when 'K' then c else case q when 'u' then 'a' else 'u' end end, audit || e,
 case e when 'D' then lines when '' then lines when 'K' then list_append(lines, role || ':' || text) when 'R' then list_append(lines, case q when 'u' then 'assistant' else 'user' end || ':' || text) else list_append(lines, case q when 'u' then 'assistant:' else 'user:' end) end, e = ''
 from (select w.*, r.role, r.text, r.c, case when r.i is null then case when q in ('0', 'a') then '' else 'I' end
  when 2 + here(x.v0, x.vs, x.vu, x.va, q) = here(v.v0, v.vs, v.vu, v.va, q) then 'D'
  when 5 + case q when 'u' then v.va else v.vu end = here(v.v0, v.vs, v.vu, v.va, q) then 'I'
  when q = '0' and c = 's' and not del and t + x.vs = v.v0 then 'K'
  when c = case q when 'u' then 'a' else 'u' end and not del and t + case q when 'u' then x.va else x.vu end = here(v.v0, v.vs, v.vu, v.va, q) then 'K' else 'R' end e
  from w join v on v.g = w.g and v.i = w.i left join r on r.g = w.g and r.i = w.i left join v x on x.g = w.g and x.i = w.i + 1 where not fin)),
sums as (select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank, count(*) filter (dup) dup, count(*) filter (trunc and not dup) trunc, count(*) filter (i > 1 and concat(b, c) not in ('su', 'ua', 'au')) illegal from r group by 1)
select conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(dup, 0)::bigint duplicate, coalesce(trunc, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(v.v0, 0)::bigint as cost, coalesce(audit, '') audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) repaired_sha256
from conv left join sums using (g) left join v on v.g = conv.g and v.i = 1 left join w on w.g = conv.g and w.fin"""
#: The cost in state q.
for _a in ("x", "v"):
    CONVERSATIONS = CONVERSATIONS.replace(f"here({_a}.v0, {_a}.vs, {_a}.vu, {_a}.va, q)", f"(case q when '0' then {_a}.v0 when 's' then {_a}.vs when 'u' then {_a}.vu else {_a}.va end)")

NEAR_COPIES = """with recursive d as (select row_number() over () r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') w from documents),
s as (select r, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) x from d),
e as (select r, len(x) n, unnest(x) k from s),
links as (select a.r u, b.r v from e a join e b on a.k = b.k and a.r <> b.r group by a.r, b.r, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select r u, r v from s union select reach.u, links.v from reach join links on links.u = reach.v)
select s.doc_id, len(any_value(s.x))::bigint n_shingles, min(t.doc_id) component_id, s.doc_id = min(t.doc_id) kept from s join reach on reach.u = s.r join s t on t.r = reach.v group by s.r, s.doc_id"""
