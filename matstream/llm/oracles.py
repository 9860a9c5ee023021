"""DuckDB SQL for the llm queries that SQL can express."""

from __future__ import annotations

_OP6 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w, row_number() over () as rid
           from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as l, w[i:i + least(len(w), 10) - 1] as g
       from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
ls as (select distinct l from bw),
dw as (select rid, l, i, w[i:i + l - 1] as g
       from (select rid, w, l, unnest(range(1, len(w) - l + 2)) as i from d, ls where len(w) >= l)),
hit as (select rid, i, dw.l as l, item_id from dw join bw on dw.g = bw.g),
pos as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + l)) as p from hit) group by rid),
it as (select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
       from (select distinct rid, item_id from hit) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (rid) left join it using (rid)
"""

_OP3 = r"""
with recursive d as (select doc_id, source, md5(coalesce(text, '')) as text_md5,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
k as (select *, u / (1.0::double - u) / sqrt(greatest(size, 1)::double) as z
      from (select *, ((('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, ''), text_md5,
                                                     coalesce(source, ''))), 1, 13))::bigint) + 0.5::double)
                      / 4503599627370496.0::double as u from d)),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, source_size * 3.0::double as cap,
        ([5.0::double, 2.0, 1.0])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::bigint] as weight
      from s),
lev as (select *, ((sum(source_size) over ())::double
             - coalesce(sum(cap) over (order by cap / weight, source is null, source
                                       rows between unbounded preceding and 1 preceding), 0.0))
           / ((sum(weight) over ())
             - coalesce(sum(weight) over (order by cap / weight, source is null, source
                                          rows between unbounded preceding and 1 preceding), 0.0)) as level from w),
f as (select level as final from lev where level * weight <= cap order by cap / weight, level limit 1),
t as (select source, source_size, coalesce(least((select final from f) * weight, cap), cap) as target from lev),
p as (select *, floor(target / greatest(source_size, 1) + 1e-12) as whole from t),
r as (select *, target - whole * source_size as rest from p),
o as (select k.*, r.source_size, r.target, r.whole, r.rest,
        row_number() over (partition by k.source order by z, doc_id nulls first, text_md5) as rk
      from k join r on k.source is not distinct from r.source),
walk(source, rk, gap, took) as (
  select source, 0::bigint, rest, false from r
  union all
  select o.source, o.rk, case when o.size > 0 and o.size <= walk.gap then walk.gap - o.size else walk.gap end,
         o.size > 0 and o.size <= walk.gap
  from walk join o on o.source is not distinct from walk.source and o.rk = walk.rk + 1),
g as (select source, min(gap) as gap from walk group by source),
ow as (select o.*, walk.took, g.gap from o join walk on o.source is not distinct from walk.source and o.rk = walk.rk
       join g on o.source is not distinct from g.source),
used as (select source, size as a, max(rk) as give, any_value(gap) as gap from ow where took group by source, size
         union all select source, 0, null, gap from g where gap > 0),
free as (select source, size as b, min(rk) as add from ow where size > 0 and not took group by source, size),
x as (select u.source, give, add, row_number() over (partition by u.source order by abs(b - (a + gap)), a, b) as first
      from used u join free f on u.source is not distinct from f.source where abs(b - (a + gap)) < gap),
a as (select ow.*, (case when size = 0 then 0 else whole + case when (took and rk is distinct from x.give) or rk = x.add
                         then 1 else 0 end end)::bigint as copies
      from ow left join x on x.first = 1 and ow.source is not distinct from x.source)
select doc_id, source, size, source_size, target, copies, (copies * size)::bigint as taken from a
"""

_OP12 = r"""
with d as (select doc_id, row_number() over () as rid,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
i as (select item_id, row_number() over () as iid,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
      from (select distinct item_id, text from benchmark where text is not null)),
it as (select iid, t, count(*) as c from (select iid, unnest(ts) as t from i) group by iid, t),
c as (select count(*)::bigint as n_docs, sum(len(ts))::bigint as n_words from d where len(ts) > 0),
tf as (select rid, t, count(*)::bigint as tf from (select rid, unnest(ts) as t from d)
       where t in (select t from it) group by rid, t),
w as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w
      from (select t, count(*) as df from tf group by t), c),
m as (select rid, doc_id, 75 + ((25 * len(ts)::bigint * n_docs) // n_words) as m from d, c where len(ts) > 0),
s as (select iid, rid, sum(it.c * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m)))::bigint as score
      from it join tf using (t) join w using (t) join m using (rid) group by iid, rid),
r as (select iid, rid, score, doc_id, row_number() over (partition by iid order by score desc, doc_id nulls last) as rank
      from s join m using (rid) where score > 0)
select i.item_id, r.rank::integer as rank, r.doc_id, r.score from r join i using (iid) where r.rank <= 20
"""

ORACLES = {"op6_decontamination": _OP6, "op3_source_mixing": _OP3, "op12_lexical_search": _OP12}
