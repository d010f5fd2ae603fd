"""SQL twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

_OP3 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bi as (select item_id, w, unnest(range(1, greatest(len(w)-7,1)::bigint+1)) j, least(len(w),8) n from b where len(w)>0),
bw as (select item_id, j, n, array_to_string(w[j:j+7],' ') k from bi),
sizes as (select distinct n from bw),
dw as (select doc_id, n, unnest(range(1, len(w)-n+2)) i, w from d, sizes where len(w)>=n),
dk as (select doc_id, n, i, array_to_string(w[i:i+n-1],' ') k from dw),
m as (select dk.doc_id, dk.i, dk.n, bw.item_id, bw.j from dk join bw on bw.k=dk.k and bw.n=dk.n),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i+n)) p from (select distinct doc_id, i, n from m)) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) l from (select distinct doc_id, item_id::varchar s from m) group by doc_id),
run as (select doc_id, n, i, i - row_number() over (partition by doc_id, item_id, n, i-j order by i) g, item_id, i-j o from (select distinct * from m)),
isl as (select doc_id, min(i) s, count(*)+n-1 c from run group by doc_id, item_id, n, o, g),
lon as (select doc_id, max(c) c, arg_min(s, (-c, s)) s from isl group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit,0)::bigint n_hit, coalesce(n_items,0)::bigint n_items, sha256(coalesce(l,'')) items_sha256, coalesce(n_items,0)>=2 contaminated, coalesce(lon.c,0)::bigint longest_words, (lon.s-1)::bigint longest_start
from d left join hit using (doc_id) left join it using (doc_id) left join lon using (doc_id)
"""

_OP5 = """
with p as (select page_id, coalesce(html,'') h, sha1(coalesce(html,'')) d from pages),
g as (select d, max(page_id) m from p group by d)
select page_id, strlen(h)::bigint payload_bytes,
array_to_string(list_transform(range(0,32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x'||substr(p.d, (1+5*(i//4))::bigint, 5))::bigint >> (15-5*(i%4))) & 31))::bigint, 1)), '') payload_digest,
case when page_id<m then 'revisit' else 'response' end record_type, case when page_id<m then m end refers_to
from p join g on g.d=p.d
"""

_OP6 = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings where embedding is not null and len(embedding)>0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x)))=0 and len(list_filter(embedding, lambda x: x<>0))>0),
p as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id<>b.vec_id and list_cosine_similarity(a.e,b.e)>=0.9),
r(x, c) as (select vec_id, vec_id from embeddings union select r.x, p.b from r join p on p.a=r.c)
select x vec_id, (select count(*) from p where p.a=x) n_links, min(c) component_id, x=min(c) kept from r group by x
"""

_OP7 = rf"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x<>'') w from documents),
s as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w)-4,1)::bigint+1), lambda i: array_to_string(w[i:i+4],' ')))) k from d where len(w)>0),
n as (select doc_id, count(*) n from s group by doc_id),
x as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.k=b.k and a.doc_id<b.doc_id group by 1,2),
l as (select a, b from x join n na on na.doc_id=a join n nb on nb.doc_id=b where 100*c >= 85*(na.n+nb.n-c)),
p as (select a, b from l union all select b, a from l),
r(x, c) as (select doc_id, doc_id from d union select r.x, p.b from r join p on p.a=r.c)
select r.x doc_id, coalesce(any_value(n.n),0)::bigint n_shingles, min(c) component_id, r.x=min(c) kept from r left join n on n.doc_id=r.x group by r.x
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": _OP3, "op5_warc": _OP5, "op6_vectors": _OP6, "op7_near_duplicates": _OP7}
