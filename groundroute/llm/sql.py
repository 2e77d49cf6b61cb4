"""DuckDB SQL of the operators whose results SQL can express (documents with distinct ids)."""

from __future__ import annotations

_SPLIT = "[x for x in regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+') if x <> '']"

OP4_SQL = f"""
with recursive words as (select doc_id, {_SPLIT.format("lower(coalesce(text, ''))")} as w from documents),
runs as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as shingle
         from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from runs group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from runs a join runs b using (shingle) where a.doc_id <> b.doc_id group by all),
links as (select a, b, k = x.n and k = y.n as same from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where k >= 0.8::double * (x.n + y.n - k) - 1e-9),
classes(doc_id, class_id) using key (doc_id) as (
  select doc_id, doc_id as class_id from documents
  union
  select l.a, min(c.class_id) from classes c join links l on l.b = c.doc_id join recurring.classes o on o.doc_id = l.a where c.class_id < o.class_id group by l.a)
select c.doc_id, c.class_id, least(c.doc_id, coalesce(min(l.b) filter (l.same), c.doc_id)) as rep_id, count(l.b) as n_links
from classes c left join links l on l.a = c.doc_id group by c.doc_id, c.class_id
"""

OP9_SQL = f"""
with words as (select doc_id, {_SPLIT.format("coalesce(text, '')")} as w from documents),
windows as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as q from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from words where len(w) >= 20)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by q order by doc_id, i) as n from windows) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from later),
kept as (select doc_id, string_agg(x, ' ' order by p) as kept, count(*) as n from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from words) anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(w.w) as n_words, len(w.w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from words w left join kept k on k.doc_id = w.doc_id
"""
