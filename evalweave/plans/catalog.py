"""Named queries over the driver tables and the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import boxes as bx
from evalweave.functions import hashing, maths, ranks, text
from evalweave.operators import audits, greedy, joins, masks, metrics, policies, probes, replicates, resampling, selection, staged, traces
from evalweave.plans import inputs, reports  # noqa: F401  (reports registers its queries as well)
from evalweave.plans.inputs import BOX_ROWS, PROBE_ROWS, RUNS, SCORED, TOKENS, table
from evalweave.plans.register import QUERIES, SQL, query, rounded, union_sql  # noqa: F401


# rank and selective-risk metrics


@query(f"""with {SCORED}, points as (select lang, score, sum(toxic)::bigint as p, sum(1 - toxic)::bigint as q from scored group by 1, 2),
below as (select *, coalesce(sum(q) over (partition by lang order by score rows between unbounded preceding and 1 preceding), 0) as b from points)
select lang, sum(p)::bigint as positives, sum(q)::bigint as negatives, round(case when sum(p) > 0 and sum(q) > 0 then sum(p * (b + q / 2.0::double)) / (sum(p)::double * sum(q)::double) else 0.5 end, 9) as auc from below group by lang""")
def auc_by_lang(spark, sf):
    return rounded(metrics.auc(inputs.scored(spark, sf), "score", "toxic", ["lang"]))


@query(f"""with {SCORED}, r as (select *, row_number() over w as rn, sum(toxic) over (w rows between unbounded preceding and current row) as hits from scored window w as (partition by source order by score desc, id))
select source, round(coalesce(avg(hits::double / rn) filter (toxic = 1), 0), 9) as ap from r group by source""")
def average_precision_by_source(spark, sf):
    return rounded(metrics.average_precision(inputs.scored(spark, sf), "score", "toxic", "id", ["source"]))


@query(f"""with {SCORED}, r as (select *, row_number() over w as rn, sum(1 - quality) over (w rows between unbounded preceding and current row) as e from scored window w as (partition by source order by risk, id))
select source, round(avg(e::double / rn), 9) as aurc from r group by source""")
def aurc_by_source(spark, sf):
    return rounded(metrics.aurc(inputs.scored(spark, sf).withColumn("error", 1 - F.col("quality")), "risk", "error", "id", ["source"]))


@query(f"""with {SCORED}, r as (select *, row_number() over w as rn, count(*) over (partition by lang) as n, sum(1 - quality) over (w rows between unbounded preceding and current row) as e from scored window w as (partition by lang order by risk, id)),
grid(coverage) as (values (0.1::double), (0.25::double), (0.5::double), (0.75::double), (0.9::double), (1.0::double))
select lang, coverage, rn::int as accepted, round(e::double / rn, 9) as error from r join grid on rn = greatest(1, ceil(round(n * coverage, 9)))""")
def coverage_error_curve(spark, sf):
    rows = inputs.scored(spark, sf).withColumn("error", 1 - F.col("quality"))
    return rounded(metrics.coverage_curve(rows, "risk", "error", "id", ["lang"], [0.1, 0.25, 0.5, 0.75, 0.9, 1.0]))


@query(f"""with {SCORED}, r as (select *, row_number() over (partition by lang order by risk, id) as rn, count(*) over (partition by lang) as n from scored)
select lang, count(*) as accepted, round(coalesce(avg((score >= 0.5)::int::double) filter (toxic = 0), 0), 9) as rate from r where rn <= greatest(1, ceil(round(n * 0.8::double, 9))) group by lang""")
def selective_fpr(spark, sf):
    rows = inputs.scored(spark, sf).withColumn("event", (F.col("score") >= 0.5).cast("int"))
    return rounded(metrics.selective_rate(rows, "risk", "event", F.col("toxic") == 0, "id", ["lang"], 0.8))


@query(f"""with {SCORED}, long as (select lang, toxic, 'score' as feature, score as value from scored union all select lang, toxic, 'risk', risk from scored union all select lang, toxic, 'margin', margin from scored union all select lang, toxic, 'confidence', confidence from scored),
points as (select lang, feature, value, sum(toxic) as p, sum(1 - toxic) as q from long group by 1, 2, 3),
below as (select *, coalesce(sum(q) over (partition by lang, feature order by value rows between unbounded preceding and 1 preceding), 0) as b from points),
a as (select lang, feature, case when sum(p) > 0 and sum(q) > 0 then sum(p * (b + q / 2.0::double)) / (sum(p)::double * sum(q)::double) else 0.5::double end as auc from below group by 1, 2),
r as (select lang, feature, auc, greatest(auc, 1 - auc) as strength, row_number() over (partition by lang order by greatest(auc, 1 - auc) desc, feature) as place from a)
select lang, feature, round(auc, 9) as auc, round(strength, 9) as strength, place::int as place from r where place <= 3""")
def feature_screen(spark, sf):
    return rounded(metrics.screen_features(inputs.scored(spark, sf), ["score", "risk", "margin", "confidence"], "toxic", ["lang"]))


@query("""with o as (select *, count(*) over (partition by o_orderpriority) as n, rank() over (partition by o_orderpriority order by o_totalprice) + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0::double as ra,
  rank() over (partition by o_orderpriority order by k) + (count(*) over (partition by o_orderpriority, k) - 1) / 2.0::double as rb, max(k) over (partition by o_orderpriority) - min(k) over (partition by o_orderpriority) as sk,
  max(o_totalprice) over (partition by o_orderpriority) - min(o_totalprice) over (partition by o_orderpriority) as sp from (select *, o_custkey % 17 as k from orders)),
p as (select o_orderkey, case when sp > 1e-8 and n > 1 then (ra - 1) / (n - 1) else 0 end as price_rank, case when sk > 1e-8 and n > 1 then (rb - 1) / (n - 1) else 0 end as key_rank from o)
select o_orderkey, round(price_rank, 9) as price_rank, round(key_rank, 9) as key_rank, round((price_rank + key_rank) / 2, 9) as mean_risk, round(greatest(price_rank, key_rank), 9) as max_risk from p""")
def rank_norm_composite(spark, sf):
    by = ["o_orderpriority"]
    rows = table(spark, sf, "orders").withColumn("k", F.col("o_custkey") % 17)
    rows = rows.select("o_orderkey", ranks.active_rank_norm("o_totalprice", by).alias("price_rank"), ranks.active_rank_norm("k", by).alias("key_rank"))
    parts = [F.col("price_rank"), F.col("key_rank")]
    return rounded(rows.select("o_orderkey", *parts, ranks.composite(parts).alias("mean_risk"), ranks.composite(parts, "max").alias("max_risk")))


@query("""select o_orderkey, round((row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) - 1)::double / greatest(1, count(*) over (partition by o_orderstatus) - 1), 9) as pct from orders""")
def ordinal_percentile(spark, sf):
    return rounded(table(spark, sf, "orders").select("o_orderkey", ranks.ordinal_percentile("o_totalprice", "o_orderkey", ["o_orderstatus"]).alias("pct")))


# selection


@query("""select l_orderkey, l_linenumber, l_partkey, place::int as place from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey) as place from (select l_orderkey, l_linenumber, l_partkey, max(l_quantity) as l_quantity from lineitem group by all)) where place <= 2""")
def topk_tiebreak(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("q")).withColumn("i", F.struct("l_linenumber", "l_partkey"))
    return selection.top_k(rows, ["l_orderkey"], "q", "i", 2).select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("""select l_orderkey, l_linenumber, l_partkey, place::int as place from (select *, row_number() over (partition by l_orderkey order by l_quantity, l_linenumber, l_partkey) as place from (select l_orderkey, l_linenumber, l_partkey, max(l_quantity) as l_quantity from lineitem group by all)) where place <= 2""")
def bottomk_tiebreak(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("q")).withColumn("i", F.struct("l_linenumber", "l_partkey"))
    return selection.top_k(rows, ["l_orderkey"], "q", "i", 2, largest=False).select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("""select user_id, event_id, place::int as place from (select *, row_number() over (partition by user_id order by sha1(concat_ws(':', '0', user_id::varchar, event_id::varchar)), event_id) as place from events) where place <= 3""")
def hash_random_k(spark, sf):
    return selection.hashed_k(table(spark, sf, "events"), ["user_id"], "event_id", 3).select("user_id", "event_id", "place")


@query(f"""with {TOKENS}, d as (select *, power(x - 0.5::double, 2) + power(y - 0.5::double, 2) as d2 from tokens)
select sample_id, idx, place::int as place from (select *, row_number() over (partition by sample_id order by d2, idx) as place from d) where place <= 5""")
def centre_select(spark, sf):
    return selection.centre_k(inputs.tokens(spark, sf), ["sample_id"], "x", "y", "idx", 5).select("sample_id", "idx", "place")


def _grid_places(source: str, keys: str, out: str, score: str | None, share: float) -> str:
    """CTEs from ``source`` (x, y, idx, k and the score) to ``out``, which has the place of each row by :func:`selection.grid_places`."""
    last = "gplace" if score is None else f"row_number() over (partition by {keys} order by (gplace > g)::int, {score} desc, idx)"
    return f"""{out}_g as (select *, greatest(1, least(k, round_even({share}::double * k, 0)))::int as g from {source}), {out}_s as (select *, ceil(sqrt(g::double))::int as side from {out}_g),
{out}_c as (select *, greatest(0, least(side - 1, floor(x * side)))::int as cx, greatest(0, least(side - 1, floor(y * side)))::int as cy from {out}_s),
{out}_n as (select *, row_number() over (partition by {keys}, cy * side + cx order by power(x - (cx + 0.5::double) / side, 2) + power(y - (cy + 0.5::double) / side, 2), idx) as near from {out}_c),
{out}_p as (select *, row_number() over (partition by {keys} order by (near > 1 or cy * side + cx >= g)::int, y, x, idx) as gplace from {out}_n), {out} as (select *, {last} as place from {out}_p)"""


def _grid_sql(k: int) -> str:
    return f"""with {TOKENS}, wanted as (select *, {k} as k from tokens), {_grid_places("wanted", "sample_id", "placed", None, 1.0)}
select sample_id, idx, place::int as place from placed where place <= {k}"""


@query(_grid_sql(6))
def grid_select(spark, sf):
    return selection.grid_k(inputs.tokens(spark, sf), ["sample_id"], "x", "y", "idx", 6).select("sample_id", "idx", "place")


@query(f"""with {TOKENS}, wanted as (select *, 9 as k from tokens), {_grid_places("wanted", "sample_id", "placed", "relevance", 0.5)}
select sample_id, idx, place::int as place from placed where place <= 9""")
def grid_topk_select(spark, sf):
    return selection.grid_k(inputs.tokens(spark, sf), ["sample_id"], "x", "y", "idx", 9, score="relevance", share=0.5).select("sample_id", "idx", "place")


@query(f"""with {TOKENS}, s as (select *, max(relevance) over w as hi, min(relevance) over w as lo from tokens window w as (partition by sample_id)),
t as (select *, case when hi - lo > 1e-12 then (relevance - lo) / (hi - lo) else 0 end + 0.5::double * (label = 0)::int as soft from s)
select sample_id, idx, place::int as place, round(soft, 9) as soft from (select *, row_number() over (partition by sample_id order by soft desc, idx) as place from t) where place <= 8""")
def minmax_soft_topk(spark, sf):
    rows = selection.soft_top_k(inputs.tokens(spark, sf), ["sample_id"], "relevance", F.col("anchor").cast("int"), "idx", 8)
    return rounded(rows.select("sample_id", "idx", "place", "soft"))


@query(f"""with {TOKENS}, r as (select *, row_number() over (partition by sample_id, label = 0 order by relevance desc, idx) as pr from tokens),
t as (select *, row_number() over (partition by sample_id order by case when label = 0 and pr <= 4 then 0 else 1 end, relevance desc, idx) as place from r)
select sample_id, idx, place::int as place from t where place <= 8""")
def protected_topk(spark, sf):
    return selection.protected_top_k(inputs.tokens(spark, sf), ["sample_id"], F.col("anchor"), "relevance", "idx", 8).select("sample_id", "idx", "place")


@query(f"""with {TOKENS}, r as (select *, row_number() over (partition by sample_id, label order by relevance desc, idx) as turn from tokens)
select sample_id, idx, turn::int as turn, place::int as place from (select *, row_number() over (partition by sample_id order by turn, label) as place from r) where place <= 12""")
def round_robin_select(spark, sf):
    rows = selection.round_robin(inputs.tokens(spark, sf), ["sample_id"], "label", [F.col("relevance").desc(), F.col("idx")], 12)
    return rows.select("sample_id", "idx", "turn", "place")


@query("""with c as (select lang, count(*) as n from documents group by lang), q as (select lang, n, 100 * n::double / (select sum(n) from c) as exact from c),
b as (select *, floor(exact) as base from q), p as (select *, row_number() over (order by round(exact - base, 9) desc, lang) as place from b),
quota as (select lang, least(n, base + (place <= 100 - (select sum(base) from b))::int) as quota from p)
select doc_id, d.lang, place::int as place from (select *, row_number() over (partition by lang order by sha256(concat_ws(':', '0', lang, doc_id::varchar)), doc_id) as place from documents) d join quota on quota.lang = d.lang where place <= quota""")
def stratified_largest_remainder(spark, sf):
    return selection.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 100).select("doc_id", "lang", "place")


@query("""select user_id, event_type, event_id, place::int as place from (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) as place from events) where place <= 1""")
def worst_examples(spark, sf):
    return selection.examples(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("value").desc(), F.col("event_id")], 1).select("user_id", "event_type", "event_id", "place")


@query(f"""with {TOKENS}, e as (select *, exp((relevance - max(relevance) over (partition by sample_id)) / 0.12::double) as e, count(*) over (partition by sample_id) as n from tokens),
p as (select *, e / sum(e) over (partition by sample_id) as p, (greatest(0, least(3, floor(y * 4))) * 4 + greatest(0, least(3, floor(x * 4))))::int as cell from e),
tried as (select *, greatest(1, least(n, ceil(n * ratio)))::int as k from p, (values (0.3::double), (0.5::double), (0.7::double)) r(ratio)), {_grid_places("tried", "sample_id, ratio", "placed", "relevance", 0.5)},
cells as (select sample_id, ratio, cell, sum(p) as m, coalesce(sum(p) filter (place <= k), 0) as kept, max((place <= k)::int) as seen from placed group by 1, 2, 3),
r as (select sample_id, ratio, sum(kept) as mass, case when count(*) filter (m >= 0.02) > 0 then count(*) filter (m >= 0.02 and seen = 1)::double / count(*) filter (m >= 0.02) else 1 end as covered from cells group by 1, 2)
select sample_id, coalesce(min(ratio) filter (mass >= 0.72 and covered >= 0.75), 0.7::double) as ratio, round(max(mass) filter (ratio = 0.7::double), 9) as mass_at_largest from r group by 1""")
def saturation_budget(spark, sf):
    return rounded(selection.saturation_ratio(inputs.tokens(spark, sf), ["sample_id"], "relevance", "x", "y"))


# splits


@query("""select case when ('0x' || substr(sha1(doc_id::varchar), 1, 8))::bigint % 10 < 3 then 'dev' else 'test' end as split, lang, count(*) as n from documents group by 1, 2""")
def stable_split_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(hashing.stable_split(F.col("doc_id")).alias("split"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""select (('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 2)::int as part, source, count(*) as n from documents group by 1, 2""")
def md5_split_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(hashing.md5_split(F.col("doc_id")).alias("part"), "source").agg(F.count(F.lit(1)).alias("n"))


# paired runs and inference


@query(f"""with {RUNS} select flag, count(*) as n, round(avg(rv - lv), 9) as mean_difference, count(*) filter (rv - lv > 1e-12) as wins, count(*) filter (rv - lv < -1e-12) as losses, count(*) filter (abs(rv - lv) <= 1e-12) as ties from runs group by flag""")
def paired_delta_winloss(spark, sf):
    left, right = inputs.run(spark, sf, "left"), inputs.run(spark, sf, "right")
    both = joins.paired(left, right, ["cluster", "line"], "value", equal=["flag"])
    return rounded(resampling.paired_summary(both, "difference", ["flag"]))


@query("""with c as (select d.lang, count(*) filter (quality = 1 and toxic = 0) as b, count(*) filter (toxic = 1 and quality = 0) as c, count(*) filter (quality = 1 and toxic = 1) as bo, count(*) filter (quality = 0 and toxic = 0) as ne from labels l join documents d on d.doc_id = l.doc_id group by 1)
select lang, b as left_only, c as right_only, bo as both, ne as neither, round(case when b + c = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::double))))) end, 9) as p from c""")
def mcnemar_discordance(spark, sf):
    rows = inputs.scored(spark, sf)
    return rounded(metrics.mcnemar(rows, F.col("quality") == 1, F.col("toxic") == 1, ["lang"]))


@query(f"""with {RUNS}, c as (select cluster, avg(rv - lv) as d from runs group by cluster) select count(*) as clusters, round(avg(d), 9) as mean, count(*) filter (d > 1e-9) as above from c""")
def cluster_mean_delta(spark, sf):
    both = joins.paired(inputs.run(spark, sf, "left"), inputs.run(spark, sf, "right"), ["cluster", "line"], "value", strict=False)
    means = resampling.cluster_means(both, "cluster", "difference", [])
    return rounded(means.agg(F.count(F.lit(1)).alias("clusters"), F.avg("value").alias("mean"), F.count_if(F.col("value") > 1e-9).alias("above")))


DRAWS = resampling.DRAWS


def _u(*parts: str) -> str:
    """The uniform number of a key and the replicate b."""
    return hashing.replicate_uniform_sql(*hashing.key_seeds_sql(*parts), "b")


def _w(*parts: str) -> str:
    return hashing.poisson_of_sql("u") if not parts else hashing.poisson_of_sql(_u(*parts))


_R = f"r as (select unnest(range(1, {DRAWS + 1}))::bigint as b)"


def _seeded(source: str, out: str, *keys: tuple[str, ...]) -> str:
    """CTEs that make a row of ``source`` a row a replicate b, with u (and v) from the key's digest, which is made once."""
    seeds = ", ".join(f"{a} as a{i}, {b} as b{i}" for i, k in enumerate(keys) for a, b in [hashing.key_seeds_sql(*k)])
    u = ", ".join(f"{hashing.replicate_uniform_sql(f'a{i}', f'b{i}', 'b')} as {n}" for i, n in zip(range(len(keys)), "uv", strict=False))
    return f"{out}_s as (select *, {seeds} from {source}), {out} as (select *, {u} from {out}_s, r)"


@query(f"""with m as (select event_type, user_id, avg(value) as v from events group by 1, 2), {_R}, {_seeded("m", "d", ("'0'", "user_id::varchar"))}, dw as (select event_type, b, {_w()} as w, v from d),
x as (select event_type, b, sum(w * v) / sum(w) as mean from dw where w > 0 group by 1, 2), q as (select event_type, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from x group by 1)
select m.event_type, count(*) as clusters, round(avg(v), 9) as mean, round(any_value(lo), 9) as low, round(any_value(hi), 9) as high from m join q using (event_type) group by 1""")
def hash_bootstrap_ci(spark, sf):
    return rounded(resampling.bootstrap_mean(table(spark, sf, "events"), "user_id", "value", ["event_type"]))


@query(f"""with e as (select user_id, 'u' || (user_id % 2)::varchar as pol, avg(value) filter (event_type = 'click') as l, avg(value) filter (event_type = 'view') as r from events group by 1),
s as (select user_id, unnest(['all', pol]) as scope, l - r as val from e where l is not null and r is not null), {_R}, {_seeded("s", "d", ("'0'", "user_id::varchar"))}, dw as (select scope, b, {_w()} as w, val from d), x as (select scope, b, sum(w * val) / sum(w) as mean from dw where w > 0 group by 1, 2),
q as (select scope, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi, least(1, 2 * least(avg((mean <= 0)::int), avg((mean >= 0)::int))) as p from x group by 1)
select s.scope, count(*) as n, round(avg(val), 9) as mean, round(quantile_cont(val, 0.5), 9) as median, round(avg((val > 0)::int), 9) as above, round(any_value(lo), 9) as low, round(any_value(hi), 9) as high, round(any_value(q.p), 9) as p from s join q on q.scope = s.scope group by 1""")
def arm_comparison(spark, sf):
    arms = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("support")).withColumn("pol", F.concat(F.lit("u"), (F.col("user_id") % 2).cast("string")))
    return rounded(traces.compare_arms(arms, "click", "view", "user_id", "event_type", "pol"))


@query(f"""with c as (select event_type, user_id, avg(value) as val from events group by 1, 2), {_R}, {_seeded("c", "d", ("'0'", "'first'", "event_type"), ("'0'", "'second'", "user_id::varchar"))},
dw as (select b, {hashing.poisson_of_sql("u")} * {hashing.poisson_of_sql("v")} as w, val from d), x as (select b, sum(w * val) / sum(w) as mean from dw where w > 0 group by b)
select count(*) as draws, round(quantile_cont(mean, 0.025), 9) as low, round(quantile_cont(mean, 0.975), 9) as high from x""")
def two_stage_bootstrap_ci(spark, sf):
    return rounded(resampling.two_stage_bootstrap(table(spark, sf, "events"), "event_type", "user_id", "value"))


@query(f"""with {RUNS}, c as (select cluster, avg(rv - lv) as d from runs group by cluster), p as (select count(*) as n, avg(d) as m from c), {_R}, nz as (select * from c where d <> 0), {_seeded("nz", "s", ("'0'", "cluster::varchar"))},
f as (select b, sum(case when u < 0.5 then d else -d end) as t from s group by b)
select any_value(n) as n, round(any_value(m), 9) as mean, round((count(*) filter (abs(t / n) >= abs(m) - 1e-12) + 1)::double / {DRAWS + 1}, 9) as p from f, p""")
def sign_flip_permutation(spark, sf):
    both = joins.paired(inputs.run(spark, sf, "left"), inputs.run(spark, sf, "right"), ["cluster", "line"], "value", strict=False)
    return rounded(resampling.sign_flip(resampling.cluster_means(both, "cluster", "difference", []), "cluster", "value", []))


@query(f"""with {SCORED}, c as (select source, score, sum(toxic)::bigint as p, sum(1 - toxic)::bigint as q from scored group by 1, 2), {_R}, {_seeded("c", "d", ("'0'", "source"))},
t as (select 0 as b, score, sum(p)::double as p, sum(q)::double as q from c group by score union all select b, score, sum({_w()} * p), sum({_w()} * q) from d where {_w()} > 0 group by 1, 2),
k as (select b, p, q, coalesce(sum(q) over (partition by b order by score rows between unbounded preceding and 1 preceding), 0) as below from t), a as (select b, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) as auc from k group by b)
select round(max(auc) filter (b = 0), 9) as auc, count(auc) filter (b > 0) as draws, round(quantile_cont(auc, 0.025) filter (b > 0 and auc is not null), 9) as low, round(quantile_cont(auc, 0.975) filter (b > 0 and auc is not null), 9) as high from a""")
def auc_bootstrap_ci(spark, sf):
    return rounded(replicates.bootstrap_auc(inputs.scored(spark, sf), "source", "score", "toxic"))


@query(f"""with {SCORED}, c as (select source, quality as x, toxic as y, count(*) as m from scored group by 1, 2, 3), {_R}, {_seeded("c", "d", ("'0'", "source"))},
t as (select 0 as b, x, y, sum(m)::double as n from c group by 2, 3 union all select b, x, y, sum(m * {_w()}) from d where {_w()} > 0 group by 1, 2, 3), n as (select b, sum(n) as n, sum(n) filter (x = y) as same from t group by 1),
l as (select b, x as label, sum(n) as nx from t group by 1, 2), g as (select b, y as label, sum(n) as ny from t group by 1, 2), e as (select b, sum(nx * ny) as e from l join g using (b, label) group by 1),
k as (select n.b, coalesce(same, 0) / n as po, coalesce(e, 0) / (n * n) as pe from n left join e on e.b = n.b), v as (select b, case when abs(1 - pe) < 1e-12 then (po >= 1 - 1e-12)::int else (po - pe) / (1 - pe) end as kappa from k)
select round(max(kappa) filter (b = 0), 9) as kappa, round(quantile_cont(kappa, 0.025) filter (b > 0), 9) as low, round(quantile_cont(kappa, 0.975) filter (b > 0), 9) as high from v""")
def kappa_bootstrap_ci(spark, sf):
    return rounded(resampling.bootstrap_kappa(inputs.scored(spark, sf), "source", "quality", "toxic"))


@query(f"""with c as (select o_custkey, count(*)::double as m, sum(o_totalprice) as x, sum(o_shippriority_like) as y, sum(o_totalprice * o_totalprice) as xx, sum(o_shippriority_like * o_shippriority_like) as yy, sum(o_totalprice * o_shippriority_like) as xy
  from (select o_custkey, o_totalprice / 1000 as o_totalprice, (o_orderkey % 97)::double as o_shippriority_like from orders) group by 1), {_R}, {_seeded("c", "d", ("'0'", "o_custkey::varchar"))},
t as (select b, sum(w * m) as m, sum(w * x) as x, sum(w * y) as y, sum(w * xx) as xx, sum(w * yy) as yy, sum(w * xy) as xy from (select *, {_w()} as w from d) where w > 0 group by b),
v as (select (xy - x * y / m) / sqrt((xx - x * x / m) * (yy - y * y / m)) as r from t where xx - x * x / m > 1e-12 and yy - y * y / m > 1e-12)
select (select round(corr(o_totalprice / 1000, (o_orderkey % 97)::double), 7) from orders) as r, round(quantile_cont(r, 0.025), 7) as low, round(quantile_cont(r, 0.975), 7) as high from v""")
def correlation_bootstrap_ci(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 97).cast("double").alias("y"))
    return rounded(resampling.bootstrap_correlation(rows, "o_custkey", "x", "y"), 7)


@query(f"""with {SCORED}, c as (select source, sum(toxic)::bigint as k, count(*) as n from scored group by 1), z as (select *, k::double / n as p, 1.959963984540054::double as z from c)
select source, k as successes, n, round(p, 9) as rate, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::double * n * n)) / (1 + z * z / n)), 9) as low,
  round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::double * n * n)) / (1 + z * z / n)), 9) as high from z""")
def wilson_by_group(spark, sf):
    return rounded(metrics.wilson_rates(inputs.scored(spark, sf), F.col("toxic") == 1, ["source"]))


@query(f"""with {SCORED}, n as (select lang, count(*)::double as n, avg((quality = toxic)::int::double) as po, avg(quality::double) as a, avg(toxic::double) as b from scored group by 1), e as (select *, a * b + (1 - a) * (1 - b) as pe from n)
select lang, n::bigint as n, round(po, 9) as observed, round(pe, 9) as expected, round(case when abs(1 - pe) < 1e-12 then (po >= 1 - 1e-12)::int else (po - pe) / (1 - pe) end, 9) as kappa from e""")
def cohen_kappa(spark, sf):
    return rounded(metrics.cohen_kappa(inputs.scored(spark, sf), "quality", "toxic", ["lang"]))


@query(f"""with {SCORED}, b as (select source, least(floor(confidence * 15), 14) as bin, count(*) as n, avg(confidence) as c, avg(quality::double) as a from scored group by 1, 2)
select source, round(sum(n * abs(a - c)) / sum(n), 9) as ece from b group by 1""")
def ece_15(spark, sf):
    return rounded(metrics.ece(inputs.scored(spark, sf), "confidence", "quality", ["source"]))


@query(f"""with {SCORED} select source, round(avg(power(confidence - quality, 2)), 9) as brier, round(avg(-(quality * ln(greatest(1e-12, least(1 - 1e-12, confidence))) + (1 - quality) * ln(1 - greatest(1e-12, least(1 - 1e-12, confidence))))), 9) as nll, round(avg(confidence), 9) as mean_confidence from scored group by 1""")
def brier_nll(spark, sf):
    return rounded(metrics.brier_nll(inputs.scored(spark, sf), "confidence", "quality", ["source"]))


@query(f"""with {SCORED}, v as (select distinct lang, margin from scored), m as (select lang, margin, lag(margin) over w as before, lead(margin) over w as after from v window w as (partition by lang order by margin)),
t as (select lang, coalesce((margin + before) / 2, margin - 1) as t from m union all select lang, margin + 1 from m where after is null),
e as (select t.lang, t.t, avg(((margin >= t) = (toxic = 1))::int::double) as accuracy, coalesce(avg((margin >= t)::int::double) filter (toxic = 0), 0) as hfpr, avg((margin >= t)::int::double) as yes_rate from t join scored s on s.lang = t.lang group by 1, 2),
r as (select *, row_number() over (partition by lang order by round(accuracy, 12) desc, round(hfpr, 12), round(abs(yes_rate - 0.5), 12), t) as place from e)
select lang, round(t, 9) as threshold, round(accuracy, 9) as accuracy, round(hfpr, 9) as hfpr, round(yes_rate, 9) as yes_rate from r where place = 1""")
def best_threshold_sweep(spark, sf):
    return rounded(metrics.best_threshold(inputs.scored(spark, sf).withColumn("target", F.col("toxic") == 1), "margin", "target", ["lang"]))


@query(f"""with {SCORED} select lang, round(avg(((margin >= 0.1) = (toxic = 1))::int::double), 9) as accuracy, round(coalesce(avg((margin >= 0.1)::int::double) filter (toxic = 0), 0), 9) as hfpr,
round(coalesce(avg((margin >= 0.1)::int::double) filter (toxic = 1), 0), 9) as positive_accuracy, round(coalesce(avg((margin < 0.1)::int::double) filter (toxic = 0), 0), 9) as negative_accuracy, round(avg((margin >= 0.1)::int::double), 9) as yes_rate from scored group by 1""")
def threshold_confusion(spark, sf):
    return rounded(inputs.scored(spark, sf).groupBy("lang").agg(*metrics.confusion(F.col("margin") >= 0.1, F.col("toxic") == 1)))


@query("""select o_orderstatus, count(*) as n, round(corr(o_totalprice, o_custkey::double), 9) as r from orders group by 1""")
def pearson_by_status(spark, sf):
    return rounded(metrics.pearson(table(spark, sf, "orders"), "o_totalprice", "o_custkey", ["o_orderstatus"]))


@query("""with r as (select l_shipmode_group, rank() over (partition by l_shipmode_group order by l_quantity) + (count(*) over (partition by l_shipmode_group, l_quantity) - 1) / 2.0::double as a,
rank() over (partition by l_shipmode_group order by l_discount) + (count(*) over (partition by l_shipmode_group, l_discount) - 1) / 2.0::double as b from (select *, l_returnflag || l_linestatus as l_shipmode_group from lineitem))
select l_shipmode_group as grp, count(*) as n, round(corr(a, b), 7) as r from r group by 1""")
def spearman_by_flag(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("grp", F.concat("l_returnflag", "l_linestatus"))
    return rounded(metrics.spearman(rows, "l_quantity", "l_discount", ["grp"]), 7)


@query("""with c as (select user_id, event_type, avg(value) as x, count(*)::double as y from events group by 1, 2),
m as (select user_id, event_type, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0::double as x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as y from c), u as (select user_id, avg(x) as x1, avg(y) as y1 from m group by 1), t as (select event_type, avg(x) as x2, avg(y) as y2 from m group by 1), g as (select avg(x) as x0, avg(y) as y0 from m)
select count(*) as n, round(corr(x - x1 - x2 + x0, y - y1 - y2 + y0), 7) as r from m join u using (user_id) join t using (event_type), g""")
def two_way_fe_corr(spark, sf):
    cells = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return rounded(metrics.fixed_effect_correlation(cells, "x", "y", "user_id", "event_type"), 7)


@query(f"""with {SCORED}, r as (select lang, rank() over (partition by lang order by score) + (count(*) over (partition by lang, score) - 1) / 2.0::double as x, rank() over (partition by lang order by confidence) + (count(*) over (partition by lang, confidence) - 1) / 2.0::double as y,
rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0::double as z from scored), c as (select lang, count(*) as n, corr(x, y) as xy, corr(x, z) as xz, corr(y, z) as yz from r group by 1)
select lang, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 7) as r from c""")
def partial_spearman(spark, sf):
    return rounded(metrics.partial_spearman(inputs.scored(spark, sf), "score", "confidence", ["n_chars"], ["lang"]), 7)


# policies


@query(f"""with {SCORED}, s as (select *, case when ('0x' || substr(sha1(id::varchar), 1, 8))::bigint % 10 < 3 then 'dev' else 'test' end as split from scored), g as (select lo, hi from (values (0.2::double), (0.4::double)) a(lo), (values (0.6::double), (0.8::double)) b(hi)),
e as (select lo, hi, split, avg(((margin >= case when risk >= hi then 0.3::double when risk >= lo then 0.1::double else 0.0::double end) = (toxic = 1))::int::double) as accuracy,
  coalesce(avg((margin >= case when risk >= hi then 0.3::double when risk >= lo then 0.1::double else 0.0::double end)::int::double) filter (toxic = 0), 0) as hfpr, avg(case when risk >= hi then 0.7::double when risk >= lo then 0.5::double else 0.3::double end) as cost from s, g group by 1, 2, 3),
o as (select *, accuracy - 1.0::double * greatest(0, hfpr - 0.2::double) - 0.1::double * cost as objective from e), b as (select lo, hi from o where split = 'dev' order by round(objective, 9) desc, lo, hi limit 1)
select o.lo, o.hi, split, round(accuracy, 9) as accuracy, round(hfpr, 9) as hfpr, round(cost, 9) as cost, round(objective, 9) as objective, (b.lo is not null) as chosen from o left join b on b.lo = o.lo and b.hi = o.hi""")
def policy_grid_select(spark, sf):
    rows = inputs.scored(spark, sf).withColumn("split", hashing.stable_split(F.col("id")))
    budgets = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.lit(k).alias("budget")) for c, k in ((0.0, 0.3), (0.1, 0.5), (0.3, 0.7))]))
    rows = rows.select("*", budgets.alias("b")).select("*", "b.*")
    yes, target = F.col("margin") >= F.col("cut"), F.col("toxic") == 1
    found = policies.policy_sweep(rows, policies.fixed_cuts(spark, [0.2, 0.4, 0.6, 0.8]), [(0.3, 0.5, 0.7)], "split", "risk", "budget", yes == target, yes & ~target, ~target)
    out = found.where("lo in (0.2, 0.4) and hi in (0.6, 0.8)")
    best = out.where("split = 'dev'").orderBy(F.round("objective", 9).desc(), "lo", "hi").limit(1).select("lo", "hi", F.lit(True).alias("first"))  # of four policies
    out = out.join(F.broadcast(best), ["lo", "hi"], "left")
    return rounded(out.select("lo", "hi", "split", "accuracy", "hfpr", F.col("keep").alias("cost"), "objective", F.coalesce("first", F.lit(False)).alias("chosen")))


@query("""with s as (select l_orderkey, l_linenumber / 7.0::double as budget, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey rows between unbounded preceding and current row) as score, sum(l_quantity) over (partition by l_orderkey) as total from lineitem)
select l_orderkey, round(coalesce(min(budget) filter (score + 1e-12 >= total - 20), 1.0), 9) as budget from s group by 1""")
def cheapest_budget(spark, sf):
    w = Window.partitionBy("l_orderkey")
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") / 7.0).alias("budget"), F.sum("l_quantity").over(w.orderBy("l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)).alias("score"), F.sum("l_quantity").over(w).alias("total"))
    return rounded(policies.cheapest(rows, ["l_orderkey"], "budget", "score", "total", tolerance=20.0))


@query("""select p_brand, p_partkey, p_size, p_retailprice from part p where not exists (select 1 from part q where q.p_brand = p.p_brand and q.p_retailprice <= p.p_retailprice and q.p_size >= p.p_size and (q.p_retailprice < p.p_retailprice or q.p_size > p.p_size))""")
def skyline(spark, sf):
    return policies.skyline(table(spark, sf, "part"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", "p_partkey", "p_size", "p_retailprice")


@query("""select event_type, count(*) as n, round(avg(value), 9) as mean, round(case when count(*) > 1 then least(1, avg(value) + 1.96::double * sqrt(var_samp(value) / count(*))) else avg(value) end, 9) as upper from (select event_type, value / 1000 as value from events) group by 1""")
def upper95_bound(spark, sf):
    return rounded(policies.upper_bounds(table(spark, sf, "events").withColumn("value", F.col("value") / 1000), "value", ["event_type"]))


# audits


@query("""with t as (select conv_id, role, lead(role) over (partition by conv_id order by turn) as after from conversations), c as (select role as before, coalesce(after, '<end>') as after, count(*) as n from t group by 1, 2)
select before, after, n, round(n::double / sum(n) over (), 9) as fraction from c""")
def transition_matrix(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select(F.col("role").alias("before"), F.coalesce(F.lead("role").over(w), F.lit("<end>")).alias("after"))
    return rounded(audits.transitions(rows, "before", "after"))


@query(f"""with {RUNS} select flag, count(*) as n, count(*) filter (rv > 20 and not lv > 20) as wins, count(*) filter (lv > 20 and not rv > 20) as losses, count(*) filter (lv > 20 and rv > 20) as both_right, count(*) filter (not lv > 20 and not rv > 20) as both_wrong from runs group by 1""")
def win_loss_by_key(spark, sf):
    left, right = inputs.run(spark, sf, "left"), inputs.run(spark, sf, "right")
    both = joins.paired(left, right, ["cluster", "line"], "value", strict=False, equal=["flag"])
    return audits.outcomes(both, F.col("left") > 20, F.col("right") > 20, ["flag"])


@query("""select coalesce(o_orderstatus, '<all>') as o_orderstatus, coalesce(o_orderpriority, '<all>') as o_orderpriority, (2 - grouping(o_orderstatus) - grouping(o_orderpriority))::int as level, count(*) as n, count(distinct o_custkey) as customers, round(avg(o_totalprice), 6) as mean_price from orders group by rollup (o_orderstatus, o_orderpriority)""")
def scope_rollup(spark, sf):
    out = audits.scopes(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], [F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.avg("o_totalprice").alias("mean_price")])
    return rounded(out, 6)


@query("""with l as (select 'lang' as counter, coalesce(nullif(lang, ''), '<empty>') as value from documents union all select 'source', coalesce(nullif(source, ''), '<empty>') from documents), c as (select counter, value, count(*) as n from l group by 1, 2)
select counter, value, n, round(n::double / sum(n) over (partition by counter), 9) as rate from c""")
def counter_audit(spark, sf):
    return rounded(audits.counters(table(spark, sf, "documents"), ["lang", "source"]))


@query("""select source, doc_id, place::int as place from (select source, doc_id, row_number() over (partition by source order by doc_id) as place from documents) where place <= 3""")
def first_n_examples(spark, sf):
    return selection.examples(table(spark, sf, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 3)


@query("""with q as (select o_orderstatus, quantile_cont(o_totalprice, 1.0::double / 3) as a, quantile_cont(o_totalprice, 2.0::double / 3) as b from orders group by 1)
select o.o_orderstatus, case when o_totalprice <= a then 'low' when o_totalprice <= b then 'middle' else 'high' end as stratum, count(*) as n from orders o join q on q.o_orderstatus = o.o_orderstatus group by 1, 2""")
def tercile_strata(spark, sf):
    return audits.tercile_strata(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"]).groupBy("o_orderstatus", "stratum").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select conv_id, count(*) as size from conversations group by 1) select size, count(*) as groups from s group by 1""")
def group_size_histogram(spark, sf):
    return audits.group_sizes(table(spark, sf, "conversations"), "conv_id")


@query(f"""with {SCORED}, b as (select case when score >= 0.5 and confidence >= 0.75 then 'both_yes' when confidence >= 0.75 then 'new_yes' when score >= 0.5 then 'new_no' else 'both_no' end as bucket, margin from scored)
select bucket, count(*) as n, round(avg(margin), 9) as mean_delta, round(quantile_cont(margin, 0.5), 9) as median_delta from b group by 1""")
def flip_decomposition(spark, sf):
    return rounded(audits.flips(inputs.scored(spark, sf), F.col("score") >= 0.5, F.col("confidence") >= 0.75, "margin"))


@query("""with l as (select l_orderkey, list_distinct(list(l_returnflag) filter (l_linenumber <= 3)) as a, list_distinct(list(l_returnflag) filter (l_linenumber >= 2)) as b, min(l_linestatus) as s from lineitem group by 1),
c as (select s, sum(len(list_intersect(coalesce(a, []), coalesce(b, []))))::bigint as shared, sum(len(coalesce(a, [])))::bigint as na, sum(len(coalesce(b, [])))::bigint as nb from l group by 1)
select s as status, shared, na - shared as only_a, nb - shared as only_b, round(shared::double / (na + nb - shared), 9) as jaccard, round(2 * shared::double / (na + nb), 9) as f1 from c""")
def label_agreement(spark, sf):
    flags = lambda c: F.collect_set(F.when(c, F.col("l_returnflag")))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(flags(F.col("l_linenumber") <= 3).alias("a"), flags(F.col("l_linenumber") >= 2).alias("b"), F.min("l_linestatus").alias("status"))
    return rounded(audits.label_agreement(rows, "a", "b", ["status"]))


# text


@query("""select a.p_partkey as a, b.p_partkey as b, levenshtein(a.p_name, b.p_name)::int as distance, round(case when greatest(length(a.p_name), length(b.p_name)) = 0 then 1 when least(length(a.p_name), length(b.p_name)) = 0 then 0 when levenshtein(a.p_name, b.p_name)::double / greatest(length(a.p_name), length(b.p_name)) < 0.5 then 1 - levenshtein(a.p_name, b.p_name)::double / greatest(length(a.p_name), length(b.p_name)) else 0 end, 9) as anls
from part a join part b on b.p_partkey = a.p_partkey + 1""")
def levenshtein_anls(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    b = table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return rounded(a.join(b, "a").select("a", "b", F.levenshtein("x", "y").alias("distance"), text.anls(F.col("x"), F.col("y")).alias("anls")))


_BENCH = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"""with t as (select distinct unnest({_BENCH}) as token from benchmark), d as (select distinct doc_id, unnest({_BENCH}) as token from documents)
select doc_id, count(*) as hits from d join t using (token) group by 1""")
def contamination_collision(spark, sf):
    every = joins.inverted_index(table(spark, sf, "benchmark"), "item_id", text.words(F.col("text")))
    return joins.collisions(table(spark, sf, "documents"), "doc_id", text.words(F.col("text")), every)


@query(f"""with t as (select distinct item_id, unnest({_BENCH}) as token from benchmark), d as (select distinct doc_id, unnest({_BENCH}) as token from documents), tn as (select item_id, count(*) as n from t group by 1), dn as (select doc_id, count(*) as n from d group by 1),
s as (select doc_id, item_id, count(*) as shared from d join t using (token) group by 1, 2)
select s.doc_id, s.item_id, shared, round(shared::double / (dn.n + tn.n - shared), 9) as jaccard, round(shared::double / dn.n, 9) as doc_contained, round(shared::double / tn.n, 9) as item_contained from s join dn on dn.doc_id is not distinct from s.doc_id join tn on tn.item_id = s.item_id""")
def token_jaccard(spark, sf):
    return rounded(joins.shared_tokens(table(spark, sf, "documents"), "doc_id", table(spark, sf, "benchmark"), "item_id", text.words(F.col("text"))))


#: Aliases of part types.
ALIASES = [("brass", "copper alloy"), ("copper", "metal"), ("economy brass", "cheap alloy"), ("nickel", "metal"), ("promo", "offer"), ("standard", "plain"), ("steel", "iron alloy"), ("tin", "metal")]


@query(f"""with a(alias, category) as (values {", ".join(f"('{x}', '{y}')" for x, y in ALIASES)}), h as (select p_partkey, category, row_number() over (partition by p_partkey order by (lower(p_type) <> alias)::int, -length(alias), alias, category) as place from part join a on contains(' ' || lower(p_type) || ' ', ' ' || alias || ' '))
select p.p_partkey, h.category from part p left join h on h.p_partkey = p.p_partkey and place = 1""")
def longest_alias_match(spark, sf):
    aliases = spark.createDataFrame(ALIASES, "alias string, category string")
    return joins.longest_alias(table(spark, sf, "part"), "p_type", aliases).select("p_partkey", "category")


@query("""select distinct c_custkey, s_suppkey from customer c join supplier s on c.c_nationkey = s.s_nationkey or floor(c.c_acctbal) = floor(s.s_acctbal)""")
def multi_key_or_join(spark, sf):
    return joins.any_key(
        table(spark, sf, "customer"), table(spark, sf, "supplier"), "c_custkey", "s_suppkey",
        [("nation", F.col("c_nationkey"), F.col("s_nationkey")), ("balance", F.floor("c_acctbal"), F.floor("s_acctbal"))],
    )


@query("""select p_partkey, case when regexp_full_match(w, '[0-9]+') then 'digits' when regexp_full_match(w, '[A-Z]+') then 'upper' when regexp_full_match(w, '[a-z]+') then 'lower' when regexp_full_match(w, '[A-Z][a-z]+') then 'title' when regexp_matches(w, '[0-9]') and regexp_matches(w, '[A-Za-z]') then 'alnum' else 'mixed' end as shape,
case when length(w) <= 4 then 'short' when length(w) <= 8 then 'medium' else 'long' end as bucket from (select p_partkey, split_part(p_brand, '#', 2) || split_part(p_name, ' ', 1) as w from part)""")
def text_shape_buckets(spark, sf):
    w = F.concat(F.split_part("p_brand", F.lit("#"), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    return table(spark, sf, "part").select("p_partkey", text.shape(w).alias("shape"), text.length_bucket(F.length(w)).alias("bucket"))


@query("""select page_id, array_to_string(list_sort(list_filter([case when contains(url, 'adult') then 'adult' end, case when contains(url, 'spam') then 'spam' end, case when contains(url, '?') then 'query' end, case when starts_with(url, 'http:') then 'plain' end], lambda x: x is not null)), ',') as tags,
case when contains(url, 'spam') then 'block' when contains(url, 'adult') then 'review' when contains(url, '/en/') then 'english' else 'other' end as family from pages""")
def risk_tags(spark, sf):
    u = F.col("url")
    tags = text.tags([("adult", F.contains(u, F.lit("adult"))), ("spam", F.contains(u, F.lit("spam"))), ("query", F.contains(u, F.lit("?"))), ("plain", u.startswith("http:"))])
    family = text.ladder([("block", F.contains(u, F.lit("spam"))), ("review", F.contains(u, F.lit("adult"))), ("english", F.contains(u, F.lit("/en/")))], "other")
    return table(spark, sf, "pages").select("page_id", F.array_join(tags, ",").alias("tags"), family.alias("family"))


def _near_sql() -> str:
    known = "map {" + ", ".join(f"'{k}': {v.split()!r}" for k, v in text.CONFUSABLE.items()) + "}"
    return f"""with names as (select distinct split_part(p_name, ' ', 1) as word from part), places as (select word, unnest(range(1, length(word) + 1)) as i from names),
chars as (select word, i, substr(word, i, 1) as c, lower(substr(word, i, 1)) as l from places),
made as (select *, list_concat(coalesce({known}[l], []), case when regexp_full_match(c, '[A-Za-z]') then [case when l = 'z' then 'a' else chr(ascii(l) + 1) end] when regexp_full_match(c, '[0-9]') then [((c::int + 1) % 10)::varchar] else [] end) as m from chars),
swaps as (select word, substr(word, 1, i - 1) || case when c <> l then upper(r) else r end || substr(word, i + 1) as candidate from (select *, unnest(m) as r from made)),
cuts as (select word, substr(word, 1, i - 1) || substr(word, i + 1) as candidate from chars where length(word) >= 4 and regexp_full_match(c, '[A-Za-z0-9]'))
select distinct word, candidate from (select * from swaps union all select * from cuts) where candidate <> word"""


@query(_near_sql())
def near_miss_candidates(spark, sf):
    names = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    return names.select("word", F.explode(text.near_misses(F.col("word"))).alias("candidate"))


@query("""select doc_id, sha256(nfc_normalize(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'))) as nfc, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) as ascii_only from documents""")
def nfc_forms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[F.sha2(text.NORMALISERS[n](F.col("text")).cast("binary"), 256).alias(n) for n in ("nfc", "ascii_only")])


@query()
def unicode_normalise(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", *[F.sha2(text.NORMALISERS[n](F.col("text")).cast("binary"), 256).alias(n) for n in ("nfc", "nfkc", "casefold", "nospace", "alnum", "ascii")])


# arrays, boxes, vectors


@query("""with b as (select o_custkey, list_distinct(list(l_partkey % 20) filter (l_linenumber <= 3)) as a, list_distinct(list(l_partkey % 20) filter (l_linenumber > 2)) as b from orders join lineitem on l_orderkey = o_orderkey group by 1)
select o_custkey, round(case when len(coalesce(a, [])) + len(coalesce(b, [])) > 0 then len(list_intersect(coalesce(a, []), coalesce(b, [])))::double / (len(coalesce(a, [])) + len(coalesce(b, [])) - len(list_intersect(coalesce(a, []), coalesce(b, [])))) else 0 end, 9) as jaccard, (len(coalesce(b, [])) - len(list_intersect(coalesce(a, []), coalesce(b, []))))::int as fresh from b""")
def array_jaccard_new_fraction(spark, sf):
    lines = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    pick = lambda c: F.collect_set(F.when(c, F.col("l_partkey") % 20))
    rows = lines.groupBy("o_custkey").agg(pick(F.col("l_linenumber") <= 3).alias("a"), pick(F.col("l_linenumber") > 2).alias("b"))
    return rounded(rows.select("o_custkey", text.jaccard(F.col("a"), F.col("b")).alias("jaccard"), F.size(F.array_except("b", "a")).alias("fresh")))


@query(f"""with {BOX_ROWS}, pairs as (select a.l_orderkey, a.i, greatest(0, least(a.x2, b.ex2) - greatest(a.x1, b.ex1)) * greatest(0, least(a.y2, b.ey2) - greatest(a.y1, b.ey1)) as o, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.ex2 - b.ex1) * (b.ey2 - b.ey1) as s from box_rows a join box_rows b on a.l_orderkey = b.l_orderkey),
best as (select l_orderkey, i, max(case when s - o > 0 then o / (s - o) else 0 end) as iou from pairs group by 1, 2), hit as (select l_orderkey, i, max((o > 0)::int) as touched from pairs group by 1, 2)
select best.l_orderkey, round(avg(iou), 9) as mean_iou, sum(touched)::int as touched from best join hit on hit.l_orderkey = best.l_orderkey and hit.i = best.i group by 1""")
def box_iou_patch_recall(spark, sf):
    rows = inputs.boxes(spark, sf)
    return rounded(rows.select("l_orderkey", bx.mean_best_iou(F.col("kept"), F.col("evidence")).alias("mean_iou"), F.size(bx.touched(F.col("kept"), F.col("evidence"))).alias("touched")))


@query(f"""with {BOX_ROWS}, evidence as (select l_orderkey, ex1, ey1, ex2, ey2 from box_rows), cut as (select a.l_orderkey, greatest(a.x1, b.ex1) as x1, greatest(a.y1, b.ey1) as y1, least(a.x2, b.ex2) as x2, least(a.y2, b.ey2) as y2 from box_rows a join box_rows b on a.l_orderkey = b.l_orderkey where least(a.x2, b.ex2) > greatest(a.x1, b.ex1) and least(a.y2, b.ey2) > greatest(a.y1, b.ey1)),
{union_sql("evidence", "l_orderkey", "ex1", "ey1", "ex2", "ey2", "ue")}, {union_sql("cut", "l_orderkey", "x1", "y1", "x2", "y2", "uc")}
select ue.l_orderkey, round(ue.area, 6) as evidence_area, round(least(1, coalesce(uc.area, 0) / ue.area), 6) as ecr from ue left join uc on uc.l_orderkey = ue.l_orderkey""")
def union_area_ecr(spark, sf):
    rows = inputs.boxes(spark, sf)
    return rounded(rows.select("l_orderkey", bx.union_area(F.col("evidence")).alias("evidence_area"), bx.evidence_coverage(F.col("kept"), F.col("evidence")).alias("ecr")), 6)


@query("""with q as (select embedding::double[] as q from embeddings where vec_id = 0), s as (select label, vec_id, list_cosine_similarity(embedding::double[], (select q from q)) as c from embeddings)
select label, vec_id, place::int as place, round(c, 9) as cosine from (select *, row_number() over (partition by label order by round(c, 12) desc, vec_id) as place from s) where place <= 5""")
def cosine_topk_relevance(spark, sf):
    vectors = table(spark, sf, "embeddings")
    asked = F.broadcast(vectors.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one row
    rows = vectors.crossJoin(asked).select("label", "vec_id", F.round(maths.cosine(F.col("embedding"), F.col("q")), 12).alias("cosine"))
    return rounded(selection.top_k(rows, ["label"], "cosine", "vec_id", 5).select("label", "vec_id", "place", "cosine"))


@query()
def facility_location_greedy(spark, sf):
    return greedy.run_selector(inputs.tokens(spark, sf), "facility_location", 8)


@query()
def selector_sweep(spark, sf):
    """Every selector at three budgets, with the evidence that it keeps."""
    boxed = inputs.token_boxes(spark, sf)
    swept = greedy.sweep(boxed, staged.NAMES, [0.15, 0.5, 1.0])
    covered = greedy.sweep_coverage(swept, boxed, inputs.token_regions(boxed))
    return rounded(greedy.sweep_summary(covered))


@query()
def selector_masks(spark, sf):
    """The tokens that every selector keeps at a quarter of the budget."""
    swept = greedy.sweep(inputs.token_boxes(spark, sf), staged.NAMES, [0.25])
    return swept.select("sample_id", "selector", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query()
def orthogonal_greedy(spark, sf):
    return greedy.run_selector(inputs.tokens(spark, sf), "orthogonal", 8)


@query()
def anchor_novelty_greedy(spark, sf):
    return greedy.run_selector(inputs.tokens(spark, sf), "anchor_novelty", 8)


# further operators


@query(f"""with {SCORED}, r as (select lang, toxic, row_number() over (partition by lang order by score desc, id) as rn, count(*) over (partition by lang) as n from scored)
select lang, count(*) as tail, round(avg(toxic::double), 9) as rate from r where rn <= greatest(1, round_even(n * 0.1::double, 0)) group by lang""")
def tail_rate_by_lang(spark, sf):
    return rounded(metrics.tail_rate(inputs.scored(spark, sf), "score", "toxic", "id", ["lang"], 0.1))


@query("""with r as (select o_orderpriority as p, o_totalprice as v, count(*) over (partition by o_orderpriority) as n, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as i from orders)
select p, round(quantile_cont(v, 0.9), 6) as linear, max(v) filter (i = least(n - 1, floor(n * 0.9::double))) as truncated, max(v) filter (i = floor((n - 1) * 0.9::double)) as truncated_inner, max(v) filter (i = round_even((n - 1) * 0.9::double, 0)) as nearest from r group by p""")
def quantile_definitions(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"))
    return rounded(metrics.quantiles(rows, "v", ["p"], 0.9), 6)


@query("""with c as (select user_id, event_type, avg(value) as v from events group by 1, 2) select event_type, count(*) as n, round(avg(v), 9) as mean, round(min(v), 9) as least, round(max(v), 9) as most, round(stddev_pop(v), 7) as sd from c group by 1""")
def seed_summary(spark, sf):
    cells = resampling.cluster_means(table(spark, sf, "events"), "user_id", "value", ["event_type"])
    out = rounded(metrics.seed_summary(cells, ["event_type"], "value"))
    return out.withColumn("sd", F.round("sd", 7))


@query(f"""with {SCORED}, long as (select lang, id, quality, 'risk' as risk, risk as value from scored union all select lang, id, quality, 'score', score from scored union all select lang, id, quality, 'margin', margin from scored),
r as (select *, row_number() over w as rn, sum(1 - quality) over (w rows between unbounded preceding and current row) as e from long window w as (partition by lang, risk order by value, id)), a as (select lang, risk, avg(e::double / rn) as aurc from r group by 1, 2),
points as (select lang, risk, value, sum(1 - quality) as p, sum(quality) as q from long group by 1, 2, 3), below as (select *, coalesce(sum(q) over (partition by lang, risk order by value rows between unbounded preceding and 1 preceding), 0) as b from points),
u as (select lang, risk, sum(p)::bigint as positives, sum(q)::bigint as negatives, case when sum(p) > 0 and sum(q) > 0 then sum(p * (b + q / 2.0::double)) / (sum(p)::double * sum(q)::double) else 0.5::double end as auc from below group by 1, 2),
m as (select a.lang, a.risk, positives, negatives, auc, aurc, row_number() over (partition by a.lang order by round(aurc, 12), a.risk) as place from a join u on u.lang = a.lang and u.risk = a.risk)
select lang, risk, positives, negatives, round(auc, 9) as auc, round(aurc, 9) as aurc from m where place = 1""")
def best_risk_by_lang(spark, sf):
    rows = inputs.scored(spark, sf).withColumn("error", 1 - F.col("quality"))
    return rounded(metrics.risk_table(rows, ["risk", "score", "margin"], "error", "id", ["lang"]))


@query("""with w as (select user_id, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'view') as view from events group by 1) select user_id, click, view from w where click is not null and view is not null""")
def n_way_intersection(spark, sf):
    return joins.common_runs(table(spark, sf, "events"), "user_id", "event_type", ["click", "view"], "value")


@query("""with w as (select user_id, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'view') as view from events group by 1), c as (select distinct c_custkey as user_id from customer)
select user_id, coalesce(click, 0.0) as click, coalesce(view, 0.0) as view from c full outer join w using (user_id)""")
def n_way_full_outer(spark, sf):
    canonical = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return joins.full_runs(canonical, table(spark, sf, "events"), "user_id", "event_type", ["click", "view"], "value", 0.0)


@query("""select c_custkey, coalesce(s_acctbal, c_acctbal) as acctbal, case when s_suppkey is null then 'primary' else 'secondary' end as resolution from customer left join supplier on s_suppkey = c_custkey""")
def override_merge(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("acctbal"))
    return joins.override(a, b, "c_custkey", ["acctbal"])


@query("""with r as (select l_orderkey, l_linenumber, max((l_quantity > 25)::int) as ok from lineitem where l_linenumber in (1, 3) group by 1, 2), w as (select l_orderkey, max(ok) filter (l_linenumber = 1) as a, max(ok) filter (l_linenumber = 3) as b from r group by 1)
select case when a = 1 and b = 1 then 'kept' when b = 1 then 'repaired' when a = 1 then 'broken' else 'persistent' end as state, count(*) as n from w where a is not null and b is not null group by 1""")
def cohort_trajectory(spark, sf):
    rows = table(spark, sf, "lineitem")
    return audits.trajectories(rows, "l_orderkey", "l_linenumber", F.col("l_quantity") > 25, 1, 3).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select o_custkey, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus <> 'F') as o, max(o_totalprice) filter (o_orderstatus = 'F') - max(o_totalprice) filter (o_orderstatus <> 'F') as gap from orders group by 1)
select o_custkey, round(gap, 6) as gap, gap > 0 as win from p where f = 1 and o = 1""")
def pair_gap(spark, sf):
    return rounded(audits.pair_gap(table(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_totalprice"), 6)


@query("""with k as (select l_orderkey, list_sort(list_distinct(list(l_linenumber::int))) as k from lineitem where l_quantity > 20 group by 1)
select l_orderkey, len(k)::int as kept, (1 + len(list_filter(range(2, len(k) + 1), lambda i: k[i] - k[i - 1] > 1)))::int as runs, round((k[len(k)] - k[1] + 1)::double / 7, 9) as span from k""")
def mask_geometry(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_quantity > 20").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("int"))).alias("k"))
    return rounded(rows.select("l_orderkey", F.size("k").alias("kept"), masks.runs(F.col("k")).alias("runs"), masks.spread(F.col("k"), F.lit(7))[0]))


@query("""with t as (select doc_id, lang, source, row_number() over (partition by lang, source order by doc_id) as turn from documents), p as (select *, row_number() over (partition by lang order by turn, source) as place from t)
select doc_id, place::int as place, ((place - 1) // 25)::int as batch from p""")
def interleaved_batches(spark, sf):
    return selection.batches(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang"], "source", [F.col("doc_id")], 25).select("doc_id", "place", "batch")


@query("""select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as r from events) where r = 1""")
def first_record_by_id(spark, sf):
    return selection.first_by_id(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"""with {SCORED} select source, count(*) as n, count(*) filter (quality = 1) as n_condition, round(coalesce(avg(score) filter (quality = 1), 0), 9) as score, round(coalesce(avg(risk) filter (quality = 1), 0), 9) as risk from scored group by 1""")
def conditional_summary(spark, sf):
    return rounded(audits.conditional_means(inputs.scored(spark, sf), ["source"], ["score", "risk"], F.col("quality") == 1))


@query(f"""with {BOX_ROWS}, o as (select a.l_orderkey, a.i as a, b.i as b, (least(a.x2, b.ex2) - greatest(a.x1, b.ex1)) * (least(a.y2, b.ey2) - greatest(a.y1, b.ey1)) as area from box_rows a join box_rows b on a.l_orderkey = b.l_orderkey and least(a.x2, b.ex2) > greatest(a.x1, b.ex1) and least(a.y2, b.ey2) > greatest(a.y1, b.ey1))
select l_orderkey, count(*) as pairs, round(sum(area), 9) as area from o group by 1""")
def spatial_overlap_join(spark, sf):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    l = table(spark, sf, "lineitem").withColumn("i", place)  # noqa: E741
    x, y, w, h = (F.col("l_partkey") % 50) / 100.0, (F.col("l_suppkey") % 50) / 100.0, F.col("l_quantity") / 100.0, F.lit(0.1) + F.col("l_discount")
    a = l.select("l_orderkey", F.col("i").alias("a"), bx.box(x, y, x + w, y + h).alias("box"))
    b = l.select("l_orderkey", F.col("i").alias("b"), bx.box(y, x, y + h, x + w).alias("box"))
    out = masks.spatial_overlaps(a, b, "l_orderkey", "a", "b", cells=2)
    return rounded(out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("area").alias("area")))


def _deletion_sql() -> str:
    u = hashing.uniform_sql("'0'", "k::varchar", "i::varchar")
    shuffled = lambda a: f"list_transform(list_sort(list_transform({a}, lambda i: {{'u': {u}, 'i': i}})), lambda s: s.i)"
    lines = lambda c: f"coalesce(list_sort(list_distinct(list(l_linenumber::int) filter ({c}))), [])"
    variants = {"selected": "kept", "delete_evidence": "list_filter(kept, lambda i: not list_contains(evidence, i))", "delete_control": "list_filter(kept, lambda i: not list_contains(mixed[1 : len(inside)], i))", "restore_evidence": "list_concat(kept, missing)", "restore_control": "list_concat(kept, others[1 : len(missing)])"}
    parts = " union all ".join(f"select k as l_orderkey, '{n}' as variant, coalesce(array_to_string(list_sort({a}), ','), '') as indices from o" for n, a in variants.items())
    return f"""with r as (select l_orderkey as k, {lines("l_quantity > 20")} as kept, {lines("l_discount > 0.05")} as evidence from lineitem group by 1),
m as (select *, list_filter(kept, lambda i: list_contains(evidence, i)) as inside, list_filter(kept, lambda i: not list_contains(evidence, i)) as outside, list_filter(evidence, lambda i: not list_contains(kept, i)) as missing,
  list_filter(range(0, 10), lambda i: not list_contains(kept, i::int) and not list_contains(evidence, i::int)) as spare from r),
o as (select *, {shuffled("outside")} as mixed, list_transform({shuffled("spare")}, lambda i: i::int) as others from m)
{parts}"""


@query(_deletion_sql())
def deletion_variants(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_linenumber").cast("int")))).alias("kept"), F.array_sort(F.collect_set(F.when(F.col("l_discount") > 0.05, F.col("l_linenumber").cast("int")))).alias("evidence"), F.lit(10).alias("total"))
    return masks.deletion_variants(rows, "l_orderkey", "kept", "evidence", "total").select("l_orderkey", "variant", F.array_join("indices", ",").alias("indices"))


@query()
def random_regions(spark, sf):
    rows = inputs.boxes(spark, sf).select("l_orderkey", F.col("evidence")[0].alias("b")).where("b.x2 - b.x1 < 1 and b.y2 - b.y1 < 1")
    out = masks.random_region(rows, "l_orderkey", "b")
    return rounded(out.select("l_orderkey", "region.x1", "region.y1", "region_iou"))


# probe profiles


def _profile_sql() -> str:
    at = lambda p: f"max(m) filter (probe = '{p}') as {p}"
    names = ["orig", *inputs.PROBE_NAMES[:11]]
    side = lambda x: f"(case when orig >= 0 then {x} else -({x}) end)"
    moved = lambda p: f"case when {p} is null then 0 else abs({side('orig')} - {side(p)}) end"
    return f"""{PROBE_ROWS}, wide as (select sample_id, any_value(family) as family, any_value(target) filter (probe = 'orig') as target, {", ".join(map(at, names))}, coalesce(list(m) filter (starts_with(probe, 'prompt_sc_')), []) as sc, count(*) as probes from last_rows group by 1),
base as (select *, (orig >= 0) = (target = 'yes') as correct, {side("orig")} as support_orig, list_concat([{side("orig")}], list_transform(sc, lambda x: {side("x")})) as supports, case when text_only is null then 0 else orig - text_only end as visual_lift,
  abs({side("orig")} - {side("coalesce(flip_mapped, orig)")}) as v_eq, abs({side("orig")} - {side("coalesce(flip_unmapped, orig)")}) as wrong_mapping, {moved("vertical_flip_mapped")} as v_vflip, {moved("vertical_flip_unmapped")} as wrong_vflip,
  {moved("inverse_role")} as v_inverse, {moved("role_reversal")} as wrong_inverse, least(greatest(0, orig), greatest(0, coalesce(role_reversal, 0))) as role_contra, 1 / (1 + exp(-orig)) as yes from wide where orig is not null),
profile as (select sample_id, family, orig as margin, correct, (not correct)::int::double as error, target = 'no' and orig >= 0 as hallucination, support_orig, -support_orig as confidence_risk, -(yes * ln(yes)) - (1 - yes) * ln(1 - yes) as entropy_risk,
  -list_min(supports) as prompt_sc_risk, -list_sum(supports) / len(supports) as prompt_sc_mean_risk, len(list_filter(sc, lambda x: (x >= 0) <> (orig >= 0)))::double / greatest(1, len(sc)) as disagreement,
  coalesce({side("text_only")}, 0) as text_prior, visual_lift, -{side("visual_lift")} as visual_lift_risk, v_eq, wrong_mapping, greatest(0, v_eq - wrong_mapping) as e_spec, greatest(0, v_vflip - wrong_vflip) as e_vflip, greatest(0, v_inverse - wrong_inverse) as e_inverse,
  coalesce(greatest({side("text_only")}, {side("subject_masked")}, {side("object_masked")}), 0) as v_rem, case when crop is null then 0 else abs({side("orig")} - {side("crop")}) + ((crop >= 0) <> (orig >= 0))::int end as v_pres,
  least(greatest(0, orig), greatest(0, coalesce(contra, 0))) as v_contra, role_contra, case family when 'left_right' then greatest(0, v_eq - wrong_mapping) when 'vertical' then greatest(greatest(0, v_vflip - wrong_vflip), role_contra)
  when 'topology' then greatest(greatest(0, v_inverse - wrong_inverse), role_contra) when 'depth' then greatest(greatest(0, v_inverse - wrong_inverse), role_contra) when 'interaction' then role_contra else 0 end as structural_risk, probes as probe_count from base)"""


_PROFILE = ["margin", "error", "support_orig", "confidence_risk", "entropy_risk", "prompt_sc_risk", "prompt_sc_mean_risk", "disagreement", "text_prior", "visual_lift", "visual_lift_risk", "v_eq", "wrong_mapping", "e_spec", "e_vflip", "e_inverse", "v_rem", "v_pres", "v_contra", "role_contra", "structural_risk"]


def _profiles(spark, sf) -> DataFrame:
    return probes.sample_profile(inputs.probe_rows(spark, sf), family=F.col("family"))


@query(f"""with {_profile_sql()} select sample_id, family, correct, hallucination, probe_count, {", ".join(f"case when round({c}, 9) = 0 then 0.0 else round({c}, 9) end::double as {c}" for c in _PROFILE)} from profile""")
def probe_profile(spark, sf):
    unsigned = lambda c: F.when(F.round(c, 9) == 0, 0.0).otherwise(F.round(c, 9)).alias(c)
    return _profiles(spark, sf).select("sample_id", "family", "correct", "hallucination", "probe_count", *map(unsigned, _PROFILE))


_PARTS = sorted({c for cs in probes.RISK_FAMILIES.values() for c in cs})
_part = lambda c: f"case when n > 1 then ({c}_r - 1) / (n - 1) else 0 end"
_on = lambda c: f"case when {c}_s > 1e-8" + (" and wrong_mapping_s > 1e-8" if c == "e_spec" else "") + f" and n > 1 then ({c}_r - 1) / (n - 1) else 0 end"


@query(f"""with {_profile_sql()}, k as (select sample_id, count(*) over () as n, {", ".join(f"rank() over (order by round({c}, 9)) + (count(*) over (partition by round({c}, 9)) - 1) / 2.0::double as {c}_r, max({c}) over () - min({c}) over () as {c}_s" for c in [*_PARTS, "wrong_mapping"])} from profile)
select sample_id, round({" + ".join(_part(c) for c in probes.RISK_FAMILIES["base"])}, 9) as base, round({" + ".join(_part(c) for c in probes.RISK_FAMILIES["base"][1:])}, 9) as base_wo_v_eq,
{", ".join(f"round(list_avg([{', '.join(_on(c) for c in probes.RISK_FAMILIES[f])}]), 9) as {f}_mean, round(list_max([{', '.join(_on(c) for c in probes.RISK_FAMILIES[f])}]), 9) as {f}_max, round(list_avg(list_reverse_sort([{', '.join(_on(c) for c in probes.RISK_FAMILIES[f])}])[1:2]), 9) as {f}_top" for f in ("gated", "profile", "lift"))},
round(list_avg(list_reverse_sort([{", ".join(_on(c) for c in probes.RISK_FAMILIES["gated"] if c != "e_spec")}])[1:2]), 9) as gated_wo_e_spec from k""")
def ranked_risks(spark, sf):
    out = probes.ranked_risks(_profiles(spark, sf).select("sample_id", *[F.round(c, 9).alias(c) for c in [*_PARTS, "wrong_mapping"]]))
    return rounded(out.select("sample_id", "base", "base_wo_v_eq", *[f"{f}_{how}" for f in ("gated", "profile", "lift") for how in ("mean", "max", "top")], "gated_wo_e_spec"))
