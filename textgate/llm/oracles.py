"""DuckDB SQL for the rows of those operators that SQL can express. Its joins and windows are those of small tables."""

from __future__ import annotations

from .mixing import CAP, SHARE, WEIGHTS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEAR_COPIES = rf"""with recursive w as (select doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as shingle from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(shingle) as n from (select doc_id from documents) left join s using (doc_id) group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (shingle) where a.doc_id < b.doc_id group by all),
links as (select x, y from common join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
both_ as (select x, y from links union all select y, x from links),
reached as (select doc_id, doc_id as other from documents union select doc_id, y from reached join both_ on x = other)
select doc_id, any_value(n)::bigint as n_shingles, min(other) as component_id from reached join n using (doc_id) group by doc_id"""

MIX = rf"""with sized as (select doc_id, source, len({_WORDS.format("coalesce(text, '')")})::bigint as size, md5(coalesce(doc_id::varchar, '-') || '#' || coalesce(text, '')) as k from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, {list(WEIGHTS)}[(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1]::double as w from sources),
full_ as (select *, {CAP} * source_size::double as most, {CAP} * source_size::double / w as stop from weighed),
level as (select *, ({SHARE}::double * sum(source_size::double) over () - coalesce(sum(most) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level from full_
window before as (order by stop, source nulls last rows between unbounded preceding and 1 preceding)),
lowest as (select first(level order by stop, source nulls last) as low from level where level <= stop),
goals as (select source, source_size, case when low is null then most else least(most, w * low) end as target from level cross join lowest),
served as (select s.*, source_size, target, sum(size) over (partition by s.source order by k, doc_id rows unbounded preceding) as served from sized s join goals g on s.source is not distinct from g.source),
timed as (select *, (served + pass * source_size)::double / target as finish from served cross join range({CAP}) p(pass) where size > 0 and target > 0),
placed as (select *, sum(size) over (order by finish, source nulls last, k, doc_id, served, pass rows unbounded preceding) <= {SHARE} * (select sum(size) from sized) as taken from timed),
times as (select doc_id, k, source, served, count(*) filter (taken) as times from placed group by all)
select s.doc_id, s.size, s.source_size, s.target, s.size * coalesce(t.times, 0) as taken, coalesce(t.times, 0)::bigint as times
from served s left join times t on s.doc_id is not distinct from t.doc_id and s.k = t.k and s.source is not distinct from t.source and s.served = t.served and s.size > 0"""

ORACLES = {"op8_ngram_join": NEAR_COPIES, "op10_mixing": MIX}
