"""Queries of sample audits, compact metric maps, run differences by cluster, ablated evidence and positions of target texts, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import text
from evalweave.operators import evidence, summaries
from evalweave.plans import catalog, inputs
from evalweave.plans.inputs import RUNS, table
from evalweave.plans.register import query, rounded


@query("""with d as (select lang, nullif(source, 'src1') as source, n_chars // 1000 as size, list_distinct([case when n_chars > 3000 then 'long' end, case when text ilike '%the%' then 'the' end, case when n_chars % 2 = 0 then 'even' end]) as tags from documents),
k as (select 'lang' as kind, lang as value from d union all select 'source', source from d union all select 'thousands', size::varchar from d union all select 'tag', t from (select unnest(tags) as t from d) where t is not null)
select kind, case when coalesce(value, '') = '' then '<empty>' else value end as value, count(*) as samples from k group by 1, 2""")
def sample_audit(spark, sf):
    docs = table(spark, sf, "documents")
    tag = lambda when, name: F.when(when, name)
    tags = F.array_compact(F.array(tag(F.col("n_chars") > 3000, "long"), tag(F.lower("text").contains("the"), "the"), tag(F.col("n_chars") % 2 == 0, "even")))
    return summaries.sample_audit(docs, {"lang": F.col("lang"), "source": F.nullif(F.col("source"), F.lit("src1")), "thousands": F.floor(F.col("n_chars") / 1000)}, tags)


@query(f"""with {RUNS}, m as (select cluster, avg(lv - rv) as val from runs where flag = 'R' group by 1), {catalog._R}, {catalog._seeded("m", "d", ("'0'", "cluster::varchar"))},
x as (select b, sum(w * val) / sum(w) as mean from (select *, {catalog._w()} as w from d) where w > 0 group by 1), s as (select list(mean order by mean) as m from x)
select (select count(*) from runs) as common, (select count(*) from m) as clusters, (select round(avg(val), 9) from m) as difference, round(m[floor(len(m) * 0.025::double)::int + 1], 9) as low, round(m[floor(len(m) * 0.975::double)::int + 1], 9) as high from s""")
def run_difference_ci(spark, sf):
    side = lambda name: inputs.run(spark, sf, name).select(F.concat_ws(":", "cluster", "line").alias("id"), "cluster", "flag", "value")
    return rounded(summaries.run_difference(side("left"), side("right"), "id", "value", None, ("flag", "R")))


@query("""with m as (select l_returnflag as flag, l_linestatus as status, avg(l_discount) as a, avg(l_tax) as b, avg(l_quantity) as c from lineitem group by 1, 2)
select flag, status, place, risk, metric, round(value, 9) as value from (select flag, status, unnest([{'place': 1, 'risk': 'confidence', 'metric': 'selective_accuracy_80cov', 'value': a}, {'place': 1, 'risk': 'confidence', 'metric': 'error_auroc', 'value': b}, {'place': 2, 'risk': case when flag = 'R' then 'prompt_sc' else 'evidence' end, 'metric': 'error_auroc', 'value': c}], recursive := true) from m)""")
def compact_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg("l_quantity").alias("c"))
    name = F.when(F.col("flag") == "R", "prompt_sc_error_auroc").otherwise("evidence_error_auroc")
    pairs = [(F.lit("confidence_selective_accuracy_80cov"), "a"), (F.lit("confidence_error_auroc"), "b"), (name, "c"), (F.lit("confidence_selective_accuracy_70cov"), "a"), (F.lit("samples"), "b")]
    metrics = F.map_from_arrays(F.array(*[k for k, _ in pairs]), F.array(*[F.col(c) for _, c in pairs]))
    return rounded(summaries.compact_metrics(rows.select("flag", "status", metrics.alias("metrics")), ["flag", "status"]))


_CANDIDATES = """c as (select l_orderkey as k, case l_linenumber when 1 then 'claim' when 2 then 'anti' when 3 then 'anti' when 4 then 'support' else 'other' end as role, case when l_partkey % 11 = 0 then null else max(l_quantity) / 10 - 2.5::double end as img, case when l_suppkey % 5 = 0 then null else max(l_discount) * 10 end as text, max(l_tax) as weight, case when l_orderkey % 2 = 0 then 'Yes' else 'no' end as predicted from lineitem group by all)"""


@query(f"""with {_CANDIDATES.replace("group by all", "group by l_orderkey, l_linenumber, l_partkey, l_suppkey")}, d as (select *, img - coalesce(text, 0) as delta, coalesce(text, 0) as t from c where img is not null),
g as (select k, coalesce(max(img) filter (role = 'claim'), 0) as ci, coalesce(max(t) filter (role = 'claim'), 0) as ct, coalesce(max(delta) filter (role = 'claim'), 0) as cd, coalesce(max(img) filter (role = 'anti'), 0) as ai, coalesce(max(t) filter (role = 'anti'), 0) as at_, coalesce(max(delta) filter (role = 'anti'), 0) as ad,
  coalesce(sum(weight * greatest(0, -delta)) filter (role = 'support'), 0) as pen, count(*) filter (role = 'support') as supports, count(*) filter (role in ('anti', 'support')) as contrast from d group by 1),
s as (select k, max(predicted) as p from c group by 1), f as (select s.k, coalesce(ci, 0) as ci, coalesce(ct, 0) as ct, coalesce(cd, 0) as cd, coalesce(ai, 0) as ai, coalesce(at_, 0) as at_, coalesce(ad, 0) as ad, coalesce(pen, 0) as pen, coalesce(supports, 0) as supports, case when coalesce(contrast, 0) = 0 then 0 when lower(p) = 'yes' then 1 else -1 end as sign, coalesce(contrast, 0) > 0 as has from s left join g using (k))
select k, round(-sign * cd, 9) + 0.0::double as claim_delta_risk, round(sign * ad, 9) + 0.0::double as anti_delta_risk, round(-sign * (cd - ad), 9) + 0.0::double as pair_delta_risk, round(-sign * (ci - ai), 9) + 0.0::double as img_pair_risk, round(-sign * (ct - at_), 9) + 0.0::double as text_pair_risk, round(-sign * ci, 9) + 0.0::double as claim_img_risk,
  round(sign * ct, 9) + 0.0::double as claim_text_prior_risk, round(cd - ad, 9) + 0.0::double as pair_margin, case when has then round(cd - ad - pen, 9) else 0 end + 0.0::double as evidence_margin, supports from f""")
def ablation_risks(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("weight"))  # noqa: E741
    role = F.element_at(F.array(*map(F.lit, ["claim", "anti", "anti", "support", "other", "other", "other"])), F.col("l_linenumber").cast("int"))
    rows = l.select(F.col("l_orderkey").alias("k"), role.alias("role"), F.when(F.col("l_partkey") % 11 != 0, F.col("q") / 10 - 2.5).alias("img"), F.when(F.col("l_suppkey") % 5 != 0, F.col("d") * 10).alias("text"), "weight", F.when(F.col("l_orderkey") % 2 == 0, "Yes").otherwise("no").alias("predicted"))
    out = rounded(evidence.ablation_risks(rows, "k"))
    return out.select("k", *[(F.col(c) + 0.0).alias(c) for c in out.columns if c not in ("k", "supports")], "supports")


@query("""with w as (select conv_id, turn, row_number() over (partition by conv_id, turn order by role, text) as r, string_split(text, ' ') as words from conversations), t as (select conv_id, turn, words, words[greatest(1, len(words) // 2)] as target from w where r = 1)
select conv_id, turn, target, array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: words[i] = target), lambda i: i - 1), ',') as places from t""")
def target_positions(spark, sf):
    """The middle word of each turn among the turn's words, as ids: digests of the words."""
    words = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.split(F.min_by("text", F.struct("role", "text")), " ").alias("words"))
    rows = words.withColumn("target", F.get("words", F.greatest(F.lit(1), F.floor(F.size("words") / 2)).cast("int") - 1))
    ids, candidates = F.transform("words", lambda w: F.xxhash64(w)), F.array(F.array(F.xxhash64(F.concat(F.lit(" "), F.col("target")))), F.array(F.xxhash64("target")))
    return rows.select("conv_id", "turn", "target", F.array_join(text.target_positions(ids, candidates, F.col("words"), F.col("target")).cast("array<string>"), ",").alias("places"))
