"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP1 = """
with p as (select page_id, coalesce(html, '') h from pages), g as (select h, max(page_id) top from p where strlen(h) >= 1000 group by 1)
select page_id, strlen(h)::bigint payload_bytes, sha1(h) payload_digest, case when top is null or top = page_id then 'response' else 'revisit' end record_type, case when top <> page_id then top end refers_to
from p left join g using (h)"""

OP4 = r"""
with r as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') txt from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s as (select *, 14 + length(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), ':', '\c')) + length(replace(replace(replace(txt, '\', '\s'), '###', '\h'), '</turn>', '\e')) n,
  row_number() over w i, count(*) over (partition by conv_id) k from r window w as (partition by conv_id order by turn nulls first, role, txt)),
c as (select *, sum(n) over (partition by conv_id order by i) upto from s)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' order by i)) turns_sha256, coalesce(sum(length(txt)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(txt, '' order by i) filter (role = 'assistant'), '')) loss_sha256, sum(upto) filter (role = 'assistant' or i = k)::bigint formatted_chars
from c group by 1"""

OP5 = r"""
with w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (select distinct doc_id, sh from (select doc_id, array_to_string(ws[i:i + 3], ' ') sh from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) i from w where len(ws) > 0))),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l), r as (with recursive q as (select a, b from e union select q.a, e.b from q join e on q.b = e.a) select * from q)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) component_id from w left join n using (doc_id) left join (select a, min(b) m from r group by 1) on a = w.doc_id"""

OP9 = """
with l as (select doc_id, coalesce(source, '') site, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
k as (select *, trim(line, ' ') tr, len(string_split(trim(line, ' '), ' ')) >= 3 ok from l),
b as (select tr, min(doc_id) keeper from k where ok group by 1 having count(distinct site) >= 8),
j as (select k.*, b.keeper is not null and ok and k.doc_id <> keeper gone from k left join b using (tr)),
g as (select doc_id, string_agg(line, chr(10) order by i) filter (not gone) txt, count(*) n, count(*) filter (gone) x from j group by 1)
select d.doc_id, case when d.text is null then null else coalesce(g.txt, '') end text, coalesce(g.n, 0)::bigint n_lines, coalesce(g.x, 0)::bigint n_removed from documents d left join g using (doc_id)"""

OP11 = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ws from documents),
d as (select doc_id, len(ws) n from w where len(ws) > 0), c as (select count(*) cn, sum(n)::bigint cl from d),
tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(ws) term from w) group by 1, 2), df as (select term, count(*) df from tf group by 1),
i as (select item_id, term, count(*) q from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark) group by 1, 2),
x as (select item_id, term, q * floor(1000 * ln((2 * cn + 2) / (2 * df + 1)))::bigint qw from i join df using (term), c),
s as (select item_id, doc_id, sum(qw * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * cn) // cl))))::bigint score from x join tf using (term) join d using (doc_id), c group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10"""

OP12 = r"""
with t as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents), w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from t),
f as (select part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (doc_id > min(doc_id) over (partition by t))::int m,
    exists (select 1 from labels l where l.doc_id = w.doc_id and quality = 1)::int g, exists (select 1 from labels l where l.doc_id = w.doc_id and toxic = 1)::int x from w),
s as (select part, m, count(*) n, sum(g) g, sum(x) x from f group by 1, 2), l as (select unnest(['A', 'B', 'C', 'D', 'E']) c),
o as (select a.c || b.c || d.c || e.c || f.c o from l a, l b, l d, l e, l f where len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
p as (select o, i step, 1 << (ascii(o[i]) - 65) own, coalesce(list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(o[j]) - 65))), 0)::int before from (select o, unnest(range(1, 6)) i from o)),
r as (select part, o filter_order, step::int step, own, coalesce(sum(n) filter (m & (before | own) = 0), 0)::bigint kept, coalesce(sum(n) filter (m & before = 0 and m & own <> 0), 0)::bigint removed,
    coalesce(sum(n) filter (m & before <> 0 and m & own <> 0), 0)::bigint redundant, coalesce(sum(n) filter (m = own), 0)::bigint unique_fails,
    coalesce(sum(g) filter (m & before = 0 and m & own <> 0), 0)::bigint good_lost, coalesce(sum(x) filter (m & before = 0 and m & own <> 0), 0)::bigint toxic_lost from s, p group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint shapley from r"""

ORACLE = {"op1_warc": OP1, "op4_chat": OP4, "op5_jaccard": OP5, "op9_line_dedup": OP9, "op11_lexical": OP11, "op12_audit": OP12}
