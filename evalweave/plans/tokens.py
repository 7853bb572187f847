"""Queries of token selection that reads vectors, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions.maths import keep_count
from evalweave.operators import merging
from evalweave.plans import inputs
from evalweave.plans.register import query, rounded


@query("""with t as (select vec_id // 64 as sample_id, vec_id % 64 as idx, abs(embedding[5]::double) as s, list_transform(embedding, lambda x: x::double) as v, count(*) over (partition by vec_id // 64) as n from embeddings),
k as (select *, greatest(1, least(n, ceil(n * 0.3::double)))::int as k from t), b as (select *, case when k <= 2 then 0 else least(k - 1, greatest(1, round_even(k * 10 / 64.0::double, 0))) end::int as c from k),
r as (select *, row_number() over (partition by sample_id order by s desc, idx) as place, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) as u from b),
d as (select *, place <= k - c or k >= n as dominant from r), a as (select *, row_number() over (partition by sample_id, dominant order by idx) - 1 as nth, greatest(1, (n - (k - c)) // greatest(1, c)) as step from d),
roles as (select *, case when dominant then 'dominant' when nth % step = 0 and nth // step < c then 'contextual' else 'merged' end as role from a),
pairs as (select x.sample_id, x.idx, y.idx as centre, x.v, list_sum(list_transform(list_zip(x.u, y.u), lambda z: z[1] * z[2])) as alike from roles x join roles y on x.sample_id = y.sample_id and x.role = 'merged' and y.role = 'contextual'),
assigned as (select sample_id, idx, v, centre from (select *, row_number() over (partition by sample_id, idx order by round(alike, 12) desc, centre) as p from pairs) where p = 1),
parts as (select sample_id, centre, d, avg(x) as m from (select sample_id, centre, unnest(v) as x, generate_subscripts(v, 1) as d from assigned) group by 1, 2, 3), means as (select sample_id, centre, list(m order by d) as mean from parts group by 1, 2),
lineage as (select sample_id, centre, string_agg(idx::varchar, ',' order by idx) as merged from assigned group by 1, 2),
kept as (select r.sample_id, r.idx, role, coalesce(merged, '') as merged, case when mean is null then v else list_transform(list_zip(v, mean), lambda z: z[1] + z[2]) end as vec from roles r left join lineage l on l.sample_id = r.sample_id and l.centre = r.idx left join means m on m.sample_id = r.sample_id and m.centre = r.idx where role <> 'merged')
select sample_id, idx, role, merged, round(vec[1], 7) as first, round(vec[2], 7) as second, round(list_sum(vec), 7) as total from kept""")
def contextual_merge(spark, sf):
    out = merging.contextual_merge(inputs.tokens(spark, sf), "sample_id", "idx", "saliency", "vec", "vec", keep_count(F.col("n"), 0.3))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("sample_id", "idx", "role", F.array_join(F.col("merged").cast("array<string>"), ",").alias("merged"), F.get("vec", F.lit(0)).alias("first"), F.get("vec", F.lit(1)).alias("second"), total.alias("total")), 7)


@query("""with t as (select vec_id // 64 as sample_id, vec_id % 64 as idx, embedding[3]::double as r, list_transform(embedding, lambda x: x::double) as v, count(*) over (partition by vec_id // 64) as n from embeddings),
u as (select *, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) as u, greatest(1, least(n, ceil(n * 0.5::double)))::int as k, row_number() over (partition by sample_id order by r desc, idx) as place from t),
b as (select *, least(greatest(1, 4), k) as low, least(greatest(least(greatest(1, 4), k), floor(k * 0.5::double)), k) as high from u), pairs as (select x.sample_id, x.idx, min(1 - list_sum(list_transform(list_zip(x.u, y.u), lambda z: z[1] * z[2]))) as novelty from b x join b y on x.sample_id = y.sample_id and y.place <= y.low group by 1, 2),
seen as (select b.sample_id, b.idx, place, (place > low and novelty > 0.9::double)::int as new from b join pairs using (sample_id, idx) where place <= high),
counted as (select *, coalesce(sum(new) over (partition by sample_id order by place rows between unbounded preceding and 1 preceding), 0) as before from seen)
select sample_id, idx, place from counted where before < 3""")
def adaptive_anchors(spark, sf):
    return merging.adaptive_anchors(inputs.tokens(spark, sf), "sample_id", "idx", "relevance", "vec", keep_count(F.col("n"), 0.5), 4, tau=0.9)


@query()
def anchored_expansion(spark, sf):
    """Anchors of adaptive number, then tokens by importance and novelty; each pick depends on all before, so a test holds the result against loops."""
    tokens, keep = inputs.tokens(spark, sf), keep_count(F.col("n"), 0.5)
    anchors = merging.adaptive_anchors(tokens, "sample_id", "idx", "relevance", "vec", keep, 4, tau=0.9)
    return merging.expand_by_importance(tokens, anchors, "sample_id", "idx", "vec", "saliency", keep)
