"""Queries of budget policies, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import hashing
from evalweave.operators import metrics, policies
from evalweave.plans import inputs
from evalweave.plans.inputs import SCORED
from evalweave.plans.register import query, rounded

_SPLIT = "case when ('0x' || substr(sha1(id::varchar), 1, 8))::bigint % 10 < 3 then 'dev' else 'test' end"
_CUTS = {0.25: 0.35, 0.30: 0.3, 0.35: 0.25, 0.40: 0.2, 0.50: 0.1, 0.70: 0.05, 1.0: 0.0}
_CHAINS = [(0.25, m, h) for m in (0.30, 0.35, 0.40) for h in (0.35, 0.40, 0.50, 0.70, 1.0) if h > m]
_QS = [round(k / 46, 6) for k in range(1, 46)]
_WEIGHTS = {"hfpr": 0.8, "keep": 0.15, "cascade": 0.05, "ecr": 0.1}


def _budget_rows(spark, sf):
    """A row per labelled document and budget: answers get better with the budget, and so does what is covered."""
    rows = inputs.scored(spark, sf).withColumn("split", hashing.stable_split(F.col("id")))
    rows = rows.select("*", F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(c).alias("cut")) for b, c in _CUTS.items()])).alias("b")).select("*", "b.*")
    return rows.withColumns({"yes": F.col("margin") >= F.col("cut"), "target": F.col("toxic") == 1, "ecr": F.least(F.lit(1.0), F.col("score") + F.col("budget"))})


_ROWS = f"""{SCORED}, budgets(budget, cut) as (values {", ".join(f"({b}::double, {c}::double)" for b, c in _CUTS.items())}),
rows as (select id, {_SPLIT} as split, risk, budget, (margin >= cut) = (toxic = 1) as correct, toxic = 0 as negative, toxic = 0 and margin >= cut as wrong, least(1, score + budget) as ecr from scored, budgets)"""


@query(f"""with {_ROWS}, dev as (select distinct id, risk from rows where split = 'dev'), cuts as (select distinct round(unnest(quantile_cont(risk, [{", ".join(map(str, _QS))}])), 12) as t from dev),
chains(base, mid, high) as (values {", ".join(f"({a}::double, {b}::double, {c}::double)" for a, b, c in _CHAINS)}), grid as (select base, mid, high, a.t as lo, b.t as hi from chains, cuts a, cuts b where a.t <= b.t),
each as (select base, mid, high, lo, hi, split, count(*) as n, avg(correct::int::double) as accuracy, coalesce(avg(wrong::int::double) filter (negative), 0) as hfpr, avg(budget) as keep, avg(base + case when budget > base then budget else 0 end) as cascade, avg(ecr) as ecr,
  avg((risk >= lo and risk < hi)::int::double) as mid_rate, avg((risk >= hi)::int::double) as high_rate from grid join rows on budget = case when risk >= hi then high when risk >= lo then mid else base end group by 1, 2, 3, 4, 5, 6),
scores as (select *, accuracy - {_WEIGHTS["hfpr"]}::double * greatest(0, hfpr - 0.2::double) - {_WEIGHTS["keep"]}::double * keep - {_WEIGHTS["cascade"]}::double * cascade + {_WEIGHTS["ecr"]}::double * ecr as objective from each),
best as (select base, mid, high, lo, hi from scores where split = 'dev' order by round(objective, 9) desc, base, mid, high, lo, hi limit 1)
select base, mid, high, round(s.lo, 9) as lo, round(s.hi, 9) as hi, split, n, round(accuracy, 9) as accuracy, round(hfpr, 9) as hfpr, round(keep, 9) as keep, round(cascade, 9) as cascade, round(ecr, 9) as ecr, round(mid_rate, 9) as mid_rate, round(high_rate, 9) as high_rate, round(objective, 9) as objective,
  (base, mid, high, s.lo, s.hi) = (select (base, mid, high, lo, hi) from best) as chosen from scores s""")
def policy_sweep(spark, sf):
    rows = _budget_rows(spark, sf)
    dev = rows.where("split = 'dev' and budget = 1.0")  # a row a document
    cuts = metrics.linear_quantiles(dev, "risk", _QS).select(F.array_distinct(F.transform("_cuts", lambda c: F.round(c, 12))).alias("_cuts"))
    return rounded(policies.policy_sweep(rows, cuts, _CHAINS, "split", "risk", "budget", F.col("yes") == F.col("target"), F.col("yes") & ~F.col("target"), ~F.col("target"), F.col("ecr"), _WEIGHTS))


_EPSILONS = [0.005, 0.01, 0.02, 0.05]


@query(f"""with {SCORED}, s as (select lang as task, {_SPLIT} as split, risk as r, score * 0.5::double as a, score * 0.5::double + case when lang = 'de' then 0.3::double when risk > 0.6 then (n_chars % 5)::double / 50 when risk > 0.3 then (n_chars % 3)::double / 400 else 0 end as b from scored),
d as (select *, greatest(0, b - a) as l from s where split = 'dev'), t as (select distinct task, r as t from d union all select task, max(r) + 1 from d group by 1),
m as (select t.task, t, count(*) as n, avg(case when r < t then l else 0 end) as mean, var_samp(case when r < t then l else 0 end) as v, avg((r >= t)::int::double) as rate, avg(case when r >= t then b else a end) as score from t join d on d.task = t.task group by 1, 2),
u as (select task, t, round(case when n > 1 then least(1, mean + 1.96::double * sqrt(v / n)) else mean end, 9) as upper, round(0.3::double + 0.7::double * rate, 9) as cost, round(score, 9) as score from m),
e as (select *, unnest([{", ".join(f"{x}::double" for x in _EPSILONS)}]) as epsilon from u), k as (select *, case when upper <= epsilon and cost < 0.7::double then 0 when cost < 0.7::double then 1 else 2 end as kind from e),
p as (select *, row_number() over (partition by task, epsilon order by kind, case when kind = 0 then cost else upper end, case when kind = 0 then -score else cost end, t) as place from k),
x as (select p.task, epsilon, t, upper, cost, kind, count(r) as n, coalesce(avg(case when r >= t then b else a end), 0) as ts, coalesce(avg(b), 0) as hs, coalesce(avg((r >= t)::int::double), 0) as fr from p left join s on s.task = p.task and s.split = 'test' where place = 1 group by 1, 2, 3, 4, 5, 6)
select task, epsilon, round(t, 9) as threshold, upper as dev_upper, cost as dev_cost, kind = 0 as feasible, n as test_n, round(ts, 9) as test_score, round(hs, 9) as test_high_score, round(fr, 9) as test_fallback_rate, round(case when n > 0 then 0.3::double + 0.7::double * fr else 0 end, 9) as test_cost,
  kind = 0 and round(ts, 9) >= round(hs - epsilon, 9) and round(case when n > 0 then 0.3::double + 0.7::double * fr else 0 end, 9) < 0.7::double as go from x""")
def conformal_policy(spark, sf):
    rows = inputs.scored(spark, sf).withColumn("split", hashing.stable_split(F.col("id")))
    extra = F.when(F.col("lang") == "de", 0.3).when(F.col("risk") > 0.6, (F.col("n_chars") % 5) / 50).when(F.col("risk") > 0.3, (F.col("n_chars") % 3) / 400).otherwise(0.0)
    rows = rows.withColumn("a", F.col("score") * 0.5).withColumn("b", F.col("a") + extra)
    return rounded(policies.conformal_selection(rows, "lang", "split", "risk", "a", "b", _EPSILONS))
