"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op5_ann
from .language_id import op3_language_id
from .media import media_pages, op1_media
from .mixing import op4_mixing
from .near_dedup import op9_near_dedup
from .packing import op2_packing
from .quality import op10_quality
from .sharding import op8_sharding
from .token_counts import op7_token_counts
from .toxicity import op6_toxicity

QUERIES = {
    "op1_media": op1_media,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_ann": op5_ann,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "media_pages": media_pages,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Digests, compressed forms, tokenizers and models that are fitted are beyond SQL; those queries are held
#: against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op4_mixing": f"""with d as (select doc_id, source, len({_WORDS.format("coalesce(text, '')")})::bigint as size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) || ':mix') as o from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 2.0::double as cap from s),
r as (select *, cap / weight as ratio from w),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over q, 0)) / (sum(weight) over () - coalesce(sum(weight) over q, 0)) as level
 from r window q as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
water as (select (select level from l where level <= ratio order by ratio, source nulls last limit 1) as level),
t as (select source, source_size, case when water.level is null or ratio < water.level then cap else water.level * weight end as target from l, water),
p as (select d.*, source_size, target, sum(size) over (partition by d.source order by o, doc_id rows unbounded preceding) as played from d join t on d.source is not distinct from t.source),
e as (select *, unnest([played / target, (played + source_size) / target]) as time from p where size > 0),
c as (select doc_id, o, sum(size) over (order by time, source nulls last rows unbounded preceding) as total from e),
k as (select doc_id, o, count(*) as plays from c where total <= (select sum(target) from t) group by 1, 2)
select doc_id, size, source_size, target, (size * coalesce(plays, 0))::bigint as taken from p left join k using (doc_id, o)""",
    "op9_near_dedup": f"""with recursive w as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))
 when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
b as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from b join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach as (select doc_id, doc_id as root from documents union select links.b, reach.root from reach join links on reach.doc_id = links.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) join (select doc_id, min(root) as component_id from reach group by 1) c using (doc_id)""",
}
