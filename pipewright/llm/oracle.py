"""DuckDB SQL for the queries of this package that SQL can express.

Not here, and tested against brute force instead: packing, token-id output and
token counts (byte-pair merges), the quality classifier and the quality rules
(models trained by the query), LM scoring (its trie's score), SimHash (XXH64),
toxicity (compressed lengths) and the pipeline.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, substr(h, 2 * i - 1, 200) as s from d, unnest(range(1, n - 98)) as t(i)),
r as (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from w),
g as (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from r where k > 1),
isl as (select doc_id, i, sum(case when p is null or i > p + 100 then 1 else 0 end) over (partition by doc_id order by i) as run from g),
gone as (select doc_id, run, min(i) as a, max(i) + 99 as b from isl group by doc_id, run),
cut as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as pb from gone),
kept as (select c.doc_id, string_agg(substr(d.h, 2 * c.pb + 1, 2 * (c.a - 1 - c.pb)), '' order by c.a) as k,
    max(c.b) as b, sum(c.b - c.a + 1) as removed, count(*) as spans
  from cut c join d using (doc_id) group by c.doc_id)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(k.removed, 0) as bigint) as n_removed,
  cast(coalesce(k.spans, 0) as bigint) as n_spans,
  sha256(unhex(case when k.b is null then d.h else k.k || substr(d.h, 2 * k.b + 1) end)) as kept_sha256
from d left join kept k using (doc_id)"""

DECONTAMINATION = f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
p as (select distinct item, least(10, len(w)) as m, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') as s
  from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) as t(k) where len(w) > 0),
win as (select doc_id, k, m, array_to_string(list_slice(w, k, k + m - 1), ' ') as s
  from d, (select distinct m from p) as sizes, unnest(range(1, len(w) - m + 2)) as t(k)),
hits as (select doc_id, k, win.m, item from win join p on p.m = win.m and p.s = win.s),
covered as (select doc_id, count(distinct x) as n_hit from hits, unnest(range(k, k + m)) as t(x) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, item from hits) as h group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(i.n_items, 0) as bigint) as n_items, sha256(coalesce(i.names, '')) as items_sha256,
  coalesce(c.n_hit, 0) > 0 as contaminated
from d left join covered c using (doc_id) left join items i using (doc_id)"""

_WHOLE = """coalesce(len(embedding) = 64 and not list_contains(list_transform(embedding, lambda c: c is null or isnan(c) or isinf(c)), true), false)"""
_INTEGERS = "list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint))"


def _clustering(k: int = 40, rounds: int = 5) -> str:
    near = """select vec_id, x, min(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * {k} + c) as m
    from v, c{r} group by vec_id, x"""
    steps = [
        f"v as materialized (select vec_id, {_INTEGERS} as x from embeddings where {_WHOLE})",
        f"c0 as materialized (select row_number() over (order by h) - 1 as c, x as y from (select sha256('2:' || vec_id) as h, x from v order by h limit {k}))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} as materialized ({near.format(k=k, r=r)})",
            f"""m{r} as (select c, list(cast(floor(t / n) as bigint) order by i) as y from (select m % {k} as c, i, cast(sum(x[i]) as double) as t, count(*) as n
    from a{r}, unnest(range(1, 65)) as u(i) group by all) group by c)""",
            f"c{r + 1} as materialized (select c{r}.c, coalesce(m{r}.y, c{r}.y) as y from c{r} left join m{r} using (c))",
        ]
    return f"""with {", ".join(steps)}, a as ({near.format(k=k, r=rounds)}),
f as (select vec_id, cast(m % {k} as int) as cluster, cast(m // {k} as bigint) as distance from a)
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(y, ',')) as centroid_sha256
from f join c{rounds} on cluster = c"""


HARD_NEGATIVES = f"""
with e as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_INTEGERS} as x
  from embeddings where label is not null and {_WHOLE}),
s as materialized (select a.vec_id as anchor_id, e.vec_id as id, e.label = a.label as same,
    cast(list_sum(list_transform(list_zip(a.x, e.x), lambda p: p[1] * p[2])) as bigint) as score
  from e a, e where a.vec_id % 50 = 0 and e.vec_id <> a.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank,
    id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3"""

QUERIES = {"op4_suffix_array_dedup": SUFFIX_DEDUP, "op7_benchmark_decontamination": DECONTAMINATION, "op12_centroid_clustering": _clustering(), "op13_hard_negative_mining": HARD_NEGATIVES}
