"""DuckDB SQL for the queries of this folder that SQL can express: the plain definition of each result, without the operator's method.

They read whole tables and join all that could meet, which is right for a check on small tables and for nothing else.
Formats and classes of secrets are those of the operator; a possessive repeat becomes a plain one, which RE2 knows and which finds the same runs.
"""

from __future__ import annotations

from trackweave.llm import neardup, secrets, urlfilter

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{{}}')"


def _quoted(pattern: str) -> str:
    return "$re$" + pattern.replace("}+", "}") + "$re$"


def _found(name: str, pattern: str) -> str:
    """Rows (r, start, m) of a pattern's matches in the table t."""
    return f"""
{name}_lists as (select r, regexp_extract_all(text, {_quoted(pattern)}) as ms, string_split_regex(text, {_quoted(pattern)}) as sp from t),
{name}_each as (select r, unnest(ms) as m, unnest(range(1, len(ms) + 1)) as i, ms, sp from {name}_lists where len(ms) > 0),
{name} as (select r, m, list_sum(list_transform(sp[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as start from {name}_each)"""


def secret_sql() -> str:
    """The scan's known formats, and by a count of each window's characters, its entropy."""
    parts, known = [], []
    for order, (kind, pattern, group, least) in enumerate(secrets.FORMATS):
        parts.append(_found(f"f{order}", pattern))
        known.append(f"select r, start, {order} as ord, start + length(m) as stop, '{kind}' as kind from f{order} where length(regexp_extract(m, {_quoted(pattern)}, {group})) >= {least}")
    parts.append(_found("c", secrets.CANDIDATE))
    allowed = " or ".join(f"regexp_matches(m, {_quoted(p)})" for p in secrets.ALLOWED)
    case = lambda k: "case " + " ".join(f"when regexp_matches(m, {_quoted(x[1])}) then {x[k]}" for x in secrets.CLASSES) + " end"
    count = ", ".join(f"count(*) filter (kind = '{x[0]}') as n_{x[0]}" for x in secrets.FORMATS)
    base = "kind || ':' || start || ':' || stop"
    return f"""
with t as (select doc_id, row_number() over () as r, coalesce(text, '') as text from documents),{",".join(parts)},
known as ({" union all ".join(known)}),
free as (select r, start, m, row_number() over () as n, {case(3)} as width, {case(4)} as least from c
         where not ({allowed}) and not exists (select 1 from known k where k.r = c.r and k.start < c.start + length(c.m) and k.stop > c.start)),
windows as (select r, start, n, width, least, p, unnest(string_split(substr(m, p + 1, width), '')) as ch
            from (select *, unnest(range(0, length(m) - width + 1)) as p from free where length(m) >= width)),
sums as (select r, start, n, width, least, p, sum(k * log2(k)) as total
         from (select r, start, n, width, least, p, ch, count(*) as k from windows group by all) group by r, start, n, width, least, p),
added as (select r, start + min(p) as start, {len(secrets.FORMATS)} as ord, start + max(p) + any_value(width) as stop, 'entropy' as kind
          from sums where width * (log2(width) - least) + 1e-9 >= total group by r, n, start),
b as (select r, {count}, string_agg({base}, ',' order by start, ord) as said from known group by r),
s as (select r, string_agg({base}, ',' order by start, ord, stop) as spans from (select * from known union all select * from added) group by r)
select doc_id, {", ".join(f"coalesce(n_{x[0]}, 0) as n_{x[0]}" for x in secrets.FORMATS)}, sha256(coalesce(said, '')) as base_sha256, coalesce(spans, '') as spans
from t left join b using (r) left join s using (r)"""


JACCARD = rf"""
with recursive t as (select doc_id, {WORDS.format('[^\x20\x09-\x0D]+')} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as met from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select x, y from p join n i on i.doc_id = x join n j on j.doc_id = y where 100 * met >= 80 * (i.n + j.n - met)),
reach(x, y) as (select x, y from link union select r.x, l.y from reach r join link l on l.x = r.y)
select doc_id, coalesce(any_value(n.n), 0) as n_shingles, least(doc_id, coalesce(min(reach.y), doc_id)) as component_id
from t left join n using (doc_id) left join reach on reach.x = t.doc_id group by doc_id
"""

DECONTAMINATION = rf"""
with t as (select doc_id, row_number() over () as r, {WORDS.format('[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} as w from documents),
b as (select coalesce(item_id::varchar, '') as item, {WORDS.format('[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} as w from benchmark),
bw as (select distinct item, least(len(w), 10) as k, array_to_string(w[i:i + 9], ' ') as win from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
dw as (select r, i, k, array_to_string(w[i:i + k - 1], ' ') as win from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from t, (select distinct k from bw) where len(w) >= k)),
hit as (select r, i, k, item from dw join bw using (k, win)),
h as (select r, count(distinct place) as n from (select r, unnest(range(i, i + k)) as place from (select distinct r, i, k from hit)) group by r),
m as (select r, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select doc_id, len(w) as n_words, coalesce(h.n, 0) as n_hit, coalesce(m.n, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from t left join h using (r) left join m using (r)
"""

#: Every pair of vectors; the operator's passes may miss a link that this has, but have none that it lacks.
NEAR = f"""
with recursive t as (select vec_id, row_number() over () as r, embedding::double[] as v from embeddings),
g as (select r, vec_id, case when len(list_filter(v, lambda x: x <> 0)) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 then list_filter(v, lambda x: x is not null) end as v from t),
u as (select r, vec_id, len(v) as d, v, sqrt(list_inner_product(v, v)) as norm from g where v is not null),
link as (select a.r as x, b.r as y, b.vec_id as id from u a join u b on a.r <> b.r and a.d = b.d where list_inner_product(a.v, b.v) >= {neardup.THRESHOLD} * a.norm * b.norm),
reach(x, y, id) as (select x, y, id from link union select r.x, l.y, l.id from reach r join link l on l.x = r.y),
n as (select x, count(*) as n from link group by x),
c as (select x, min(id) as id from reach group by x)
select vec_id, coalesce(n.n, 0) as n_links, least(vec_id, c.id) as component_id, coalesce(vec_id = least(vec_id, c.id), false) as kept
from t left join n on n.x = t.r left join c on c.x = t.r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_scan": secret_sql(), "op5_jaccard_join": JACCARD, "op7_decontamination": DECONTAMINATION,
        "op9_embedding_near_dedup": NEAR, "op10_url_filter": urlfilter.OP10_SQL,
    }
