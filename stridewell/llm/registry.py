"""Queries of this subpackage, by name, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from .decontaminate import op10_template_windows
from .html_text import op5_best_region
from .jaccard import op1_blocked_product
from .lattice import op11_lattice_edges
from .pii import op13_weak_supervision
from .prefix_tree import op12_patricia
from .quality import op8_token_fertility
from .records import op4_token_records
from .secrets import op2_linked_credentials
from .sharding import op6_slot_table
from .substrings import op7_fm_index
from .toxicity import op3_ngram_nb_toxicity
from .unigram import op9_unigram_pieces

QUERIES = {
    "op1_blocked_product": op1_blocked_product,
    "op2_linked_credentials": op2_linked_credentials,
    "op3_ngram_nb_toxicity": op3_ngram_nb_toxicity,
    "op4_token_records": op4_token_records,
    "op5_best_region": op5_best_region,
    "op6_slot_table": op6_slot_table,
    "op7_fm_index": op7_fm_index,
    "op8_token_fertility": op8_token_fertility,
    "op9_unigram_pieces": op9_unigram_pieces,
    "op10_template_windows": op10_template_windows,
    "op11_lattice_edges": op11_lattice_edges,
    "op12_patricia": op12_patricia,
    "op13_weak_supervision": op13_weak_supervision,
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_blocked_product": f"""with recursive d as (select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
s as (select distinct doc_id, w[i : i + 3] g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) i from d)),
h as (select doc_id, md5(array_to_string(g, ' ')) g from s),
n as (select doc_id, count(*) n from h group by 1),
o as (select a.doc_id a, b.doc_id b, count(*) x from h a join h b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from o join n p on p.doc_id = a join n q on q.doc_id = b where 100 * x >= 85 * (p.n + q.n - x)),
e as (select a, b from l union all select b, a from l),
r(doc_id, low) as (select doc_id, doc_id from d union select e.b, r.low from r join e on e.a = r.doc_id where r.low < e.b)
select d.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(r.low) component_id from d join r using (doc_id) left join n using (doc_id) group by 1""",
    "op7_fm_index": f"""with d as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} w from documents),
f as (select doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 33)) i from d)),
m as (select h from f group by 1 having count(*) > 1),
g as (select distinct doc_id, unnest(range(i, i + 35)) p from f semi join m using (h)),
k as (select doc_id, string_agg(x, ' ' order by p) t, count(*) c from (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from d) anti join g using (doc_id, p) group by 1)
select d.doc_id, len(w) n_words, len(w) - coalesce(c, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join k using (doc_id)""",
    "op11_lattice_edges": f"""with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, {_WORDS.format(text="coalesce(text, '')")} w from documents),
q as (select doc_id i, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by 1),
f as (select part, (case when len(w) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end) || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end)
|| (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end) m, coalesce(good, false)::int good, coalesce(toxic, false)::int toxic from d left join q on i = doc_id),
g as (select part, m, count(*) n, sum(good) good, sum(toxic) toxic from f group by 1, 2), l as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c.x || d.x || e.x o from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select part, o, k, substr(o, k, 1) x, m, n, good, toxic, len(list_intersect(string_split(substr(o, 1, k - 1), ''), string_split(m, ''))) > 0 and k > 1 gone, contains(m, substr(o, k, 1)) fails from g, o, (select unnest([1, 2, 3, 4, 5]) k)),
r as (select part, o filter_order, k::int step, any_value(x) x, sum(n) filter (not gone and not fails) kept, sum(n) filter (not gone and fails) removed, sum(n) filter (gone and fails) redundant, sum(n) filter (m = x) unique_fails, sum(good) filter (not gone and fails) good_lost, sum(toxic) filter (not gone and fails) toxic_lost from s group by 1, 2, 3)
select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails, coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost, coalesce(sum(removed) over (partition by part, x), 0)::bigint shapley from r""",
    "op12_patricia": f"""with t as (select conv_id c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) k, len({_WORDS.format(text="coalesce(text, '')")}) w from conversations where conv_id is not null),
o as (select *, row_number() over (partition by c order by turn nulls first, k) i from t),
h as (select c, c - c % 20 b, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ord(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, case when xor(a, b) % 2 = 1 then 3988292384 else 0 end)), 4294967295) % 4 h from (select distinct c from o)),
l as (select h.c, i d, k, w from h join o on o.c = h.b and o.i <= h.h),
r as (select * from l union all select h.c, (select count(*) from l where l.c = h.c) + i - h.h, k, w from h join o on o.c = h.c and o.i > h.h),
p as (select c, 0 d, '' p, 0 w from h union all select c, d, md5(string_agg(k, '') over (partition by c order by d)), w from r),
n as (select p, d, min(c) conv_id, count(*) n_convs, any_value(w) w from p group by 1, 2),
u as (select n.*, q.p up, q.d ud from n left join p q on q.c = n.conv_id and q.d = n.d - 1),
k as (select up p, ud d, count(*) n_children from u where ud is not null group by 1, 2),
v as (select u.*, coalesce(n_children, 0) n_children from u left join k using (p, d)),
s as (select q.p, q.d, sum((n_children = 0)::int)::bigint n_leaves, sum((n_convs - 1) * v.w)::bigint saved_tokens from v join p q on q.c = v.conv_id and q.d <= v.d group by 1, 2),
m as (select arg_max(p, d) p, max(d) d, c from p group by c),
e as (select p, d, sha256(string_agg(c::varchar, ',' order by c)) x from m group by 1, 2)
select v.conv_id, d depth, a.conv_id parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, coalesce(x, sha256('')) ends_sha256 from v join s using (p, d) left join e using (p, d) left join n a on a.p = v.up and a.d = v.ud""",
}
