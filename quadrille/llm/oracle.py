"""DuckDB SQL that gives the rows of those operators' queries that SQL can express."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = r"'[^\x20\x09-\x0D]+'"
_LETTER_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NGRAM_JACCARD_JOIN = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOW}, {_BLANK_WORDS}) as ws from documents),
s as (select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(list_slice(ws, i, i + 4), ' ') end as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 80 * (a.n + b.n - shared)),
r as (select x as doc_id, least(x, y) as o from l union select r.doc_id, l.y from r join l on l.x = r.o)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(min(r.o), d.doc_id)) as component_id from d left join n using (doc_id) left join r using (doc_id) group by d.doc_id, n.n
"""

SUBSTRING_DEDUP = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK_WORDS}) as ws from documents),
x as (select doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from d where len(ws) >= 35)),
again as (select g from x group by g having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as i from x where g in (select g from again)),
w as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from d),
k as (select w.doc_id, count(*) as n, string_agg(word, ' ' order by w.i) as t from w left join gone on gone.doc_id = w.doc_id and gone.i = w.i where gone.i is null group by w.doc_id)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join k using (doc_id)
"""

BOTTOMK_DEDUP = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOW}, {_BLANK_WORDS}) as ws from documents),
s as (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(list_slice(ws, i, i + 2), ' ') end as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
f as (select g, count(*) as df from s group by g),
o as (select s.doc_id, g, n, row_number() over (partition by s.doc_id order by df, g) as place from s join f using (g) join n using (doc_id)),
h as (select doc_id, g from o where 100 * place <= 100 * n - 85 * n + 100),
c as (select distinct a.doc_id as x, b.doc_id as y from h a join h b on a.g = b.g and a.doc_id < b.doc_id),
p as (select x, y, count(*) as shared from c join s a on a.doc_id = x join s b on b.doc_id = y and b.g = a.g group by all),
k as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 85 * (a.n + b.n - shared)),
l as materialized (select x, y from k union all select y, x from k),
r as (select x as doc_id, least(x, y) as o from l union select r.doc_id, l.y from r join l on l.x = r.o)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(min(r.o), d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(min(r.o), d.doc_id)) as kept from d left join n using (doc_id) left join r using (doc_id) group by d.doc_id, n.n
"""

LEXICAL_SEARCH = rf"""
with d as (select doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
i as (select item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from benchmark),
iw as (select item_id, unnest(ws) as term from i),
q as (select item_id, term, count(*) as qn from iw group by all),
g as (select count(*) as n_docs, sum(len(ws)) as l from d where len(ws) > 0),
w as (select doc_id, len(ws) as n, unnest(ws) as term from d),
tf as (select doc_id, n, term, count(*) as tf from w where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by term),
t as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as weight from df, g),
x as (select doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * cast(75 + (25 * n * n_docs) // l as bigint)) as x from tf, g),
s as (select item_id, doc_id, cast(sum(qn * weight * x) as bigint) as score from q join t using (term) join x using (term) group by all),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 20
"""

FILTER_AUDIT = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
f as (select part, doc_id, len(ws) < 50 as a, 100 * len(list_distinct(ws)) < 65 * len(ws) as b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by t), false) as e from d),
m as (select part, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic, a, b, c, d, e from f left join l using (doc_id) group by part, a, b, c, d, e),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select [p.x, q.x, r.x, s.x, t.x] as o from x p, x q, x r, x s, x t where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s as (select array_to_string(o, '') as filter_order, step, o[step] as mine, list_slice(o, 1, step - 1) as before from o, unnest(range(1, 6)) as u(step)),
y as (select part, n, good, toxic, concat(case when a then 'A' end, case when b then 'B' end, case when c then 'C' end, case when d then 'D' end, case when e then 'E' end) as failed from m),
g as (select part, filter_order, step, mine, n, good, toxic, failed, contains(failed, mine) as fails, len(list_intersect(string_split(failed, ''), before)) > 0 as gone from y, s),
r as (select part, filter_order, step, mine, sum(case when not fails and not gone then n else 0 end) as kept, sum(case when fails and not gone then n else 0 end) as removed, sum(case when fails and gone then n else 0 end) as redundant,
sum(case when fails and length(failed) = 1 then n else 0 end) as unique_fails, sum(case when fails and not gone then good else 0 end) as good_lost, sum(case when fails and not gone then toxic else 0 end) as toxic_lost from g group by part, filter_order, step, mine)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, mine) as bigint) as shapley from r
"""

BENCHMARK_DECONTAMINATION = f"""
with d as (select doc_id, regexp_extract_all({_LOW}, {_LETTER_WORDS}) as ws from documents),
b as (select item_id, regexp_extract_all({_LOW}, {_LETTER_WORDS}) as ws from benchmark),
bw as (select distinct item_id, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') as g from (select item_id, ws, least(len(ws), 10) as m, unnest(range(1, greatest(len(ws) - 8, 2))) as i from b where len(ws) > 0)),
dw as (select doc_id, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') as g from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as i from d, (select distinct m from bw) where len(ws) >= m)),
h as (select doc_id, dw.i, m, item_id from dw join bw using (m, g)),
n as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + m)) as i from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join n using (doc_id) left join t using (doc_id)
"""

SQL = {"op4_ngram_jaccard_join": NGRAM_JACCARD_JOIN, "op5_substring_dedup": SUBSTRING_DEDUP, "op7_benchmark_decontamination": BENCHMARK_DECONTAMINATION, "op11_lexical_search": LEXICAL_SEARCH, "op12_filter_audit": FILTER_AUDIT, "op13_bottomk_dedup": BOTTOMK_DEDUP}
