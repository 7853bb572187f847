"""Queries of correlation grids, their intervals and strata of scale, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.operators import correlations
from evalweave.plans import catalog, inputs
from evalweave.plans.inputs import SCORED, table
from evalweave.plans.register import query, rounded

_PREDICTORS, _OUTCOMES = ["score", "risk", "confidence"], ["margin", "merit"]


def _rows(spark, sf):
    """Scored documents with an outcome that some of them lack."""
    return inputs.scored(spark, sf).withColumn("merit", F.when(F.col("n_chars") % 4 != 0, F.col("quality") + F.col("score")))


_MERIT = "case when n_chars % 4 <> 0 then quality + score end"


def _with_replicates(source: str) -> str:
    """CTEs up to drawn: the rows of ``source`` (key id) with replicate b and weight w; replicate 0 is the sample."""
    keyed = catalog._seeded(source, "d", ("'0'", "id::varchar"))
    return f"{catalog._R}, {keyed}, drawn as (select *, 0::bigint as b, 1::bigint as w from {source} union all select * from (select * exclude (a0, b0, u), {catalog._w()}::bigint as w from d) where w > 0)"


def _rank_sql(column: str, keys: str) -> str:
    """The weighted mid-rank: what lies below, and half of what is equal."""
    return f"(sum(w) over (partition by {keys} order by {column}) - (sum(w) over (partition by {keys}, {column}) - 1) / 2.0::double)"


def _corr_sql(x: str, y: str) -> str:
    cov = lambda p, q: f"(sum(w * {p} * {q})::double - sum(w * {p})::double * sum(w * {q})::double / sum(w))"
    some = lambda p: f"{cov(p, p)} > 1e-9 * greatest(1e-9, sum(w * {p} * {p}))"
    return f"case when {some(x)} and {some(y)} then {cov(x, y)} / sqrt({cov(x, x)} * {cov(y, y)}) end"


@query(f"""with {SCORED}, base as (select id, lang, score, risk, confidence, margin, {_MERIT} as merit from scored),
long as (select id, lang, unnest([{", ".join(f"{{'outcome': '{o}', 'predictor': '{p}', 'x': {p}, 'y': {o}}}" for o in _OUTCOMES for p in _PREDICTORS)}]) as v from base), flat as (select id, lang, v.outcome, v.predictor, v.x, v.y from long where v.x is not null and v.y is not null),
{_with_replicates("flat")}, sizes as (select lang, outcome, predictor, count(*) as n from flat group by 1, 2, 3),
ranked as (select *, {_rank_sql("x", "lang, outcome, predictor, b")} as rx, {_rank_sql("y", "lang, outcome, predictor, b")} as ry from drawn),
sums as (select lang, outcome, predictor, b, {_corr_sql("rx", "ry")} as spearman, {_corr_sql("x", "y")} as pearson from ranked group by 1, 2, 3, 4),
each as (unpivot sums on spearman, pearson into name method value r)
select lang, outcome, predictor, method, n, round(max(r) filter (b = 0), 7) as estimate, round(quantile_cont(r, 0.025) filter (b > 0), 7) as low, round(quantile_cont(r, 0.975) filter (b > 0), 7) as high, count(r) filter (b > 0) as draws from each join sizes using (lang, outcome, predictor) group by 1, 2, 3, 4, 5""")
def correlation_grid(spark, sf):
    return rounded(correlations.correlation_grid(_rows(spark, sf), ["lang"], "id", _PREDICTORS, _OUTCOMES), 7)


def _partial_sql(ab: str, az: str, bz: str) -> str:
    left = f"greatest(0, 1 - {az} * {az}) * greatest(0, 1 - {bz} * {bz})"
    return f"case when {az} is null or {bz} is null then {ab} when {left} > 1e-18 then ({ab} - {az} * {bz}) / sqrt({left}) end"


@query(f"""with {SCORED}, base as (select id, lang, score as x, confidence as y, n_chars as z, risk as v from scored), {_with_replicates("base")},
ranked as (select lang, b, w, {", ".join(f"{_rank_sql(c, 'lang, b')} as r{c}" for c in "xyzv")} from drawn),
c as (select lang, b, {", ".join(f"{_corr_sql(f'r{p}', f'r{q}')} as {p}{q}" for p, q in ("xy", "xz", "yz", "xv", "yv", "zv"))} from ranked group by 1, 2),
z as (select lang, b, {_partial_sql("xy", "xz", "yz")} as xy, {_partial_sql("xv", "xz", "zv")} as xv, {_partial_sql("yv", "yz", "zv")} as yv from c),
pr as (select lang, b, {_partial_sql("xy", "xv", "yv")} as r from z), n as (select lang, count(*) as n from base group by 1)
select lang, n, round(max(r) filter (b = 0), 7) as estimate, round(quantile_cont(r, 0.025) filter (b > 0), 7) as low, round(quantile_cont(r, 0.975) filter (b > 0), 7) as high, count(r) filter (b > 0) as draws from pr join n using (lang) group by 1, 2""")
def partial_spearman_ci(spark, sf):
    return rounded(correlations.partial_spearman_interval(_rows(spark, sf), "score", "confidence", ["n_chars", "risk"], ["lang"], "id"), 7)


@query(f"""with c as (select user_id, event_type, avg(value) as x, count(*)::double as y from events group by 1, 2),
m as (select user_id, event_type, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0::double as x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as y from c), p as (select user_id, avg(x) as x1, avg(y) as y1 from m group by 1), t as (select event_type, avg(x) as x2, avg(y) as y2 from m group by 1), g as (select avg(x) as x0, avg(y) as y0 from m),
f as (select user_id, x - x1 - x2 + x0 as x, y - y1 - y2 + y0 as y from m join p using (user_id) join t using (event_type), g), k as (select user_id, count(*)::double as m, sum(x) as sx, sum(y) as sy, sum(x * x) as xx, sum(y * y) as yy, sum(x * y) as xy from f group by 1),
{catalog._R}, {catalog._seeded("k", "d", ("'0'", "user_id::varchar"))}, s as (select b, sum(w * m) as m, sum(w * sx) as x, sum(w * sy) as y, sum(w * xx) as xx, sum(w * yy) as yy, sum(w * xy) as xy from (select *, {catalog._w()} as w from d) where w > 0 group by 1),
v as (select (xy - x * y / m) / sqrt((xx - x * x / m) * (yy - y * y / m)) as r from s where xx - x * x / m > 1e-12 and yy - y * y / m > 1e-12)
select (select round(corr(x, y), 7) from f) as r, round(quantile_cont(r, 0.025), 7) as low, round(quantile_cont(r, 0.975), 7) as high from v""")
def two_way_fe_ci(spark, sf):
    cells = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return rounded(correlations.fixed_effect_interval(cells, "x", "y", "user_id", "event_type"), 7)


_DIMENSIONS = ["n_chars", "risk", "level"]


@query(f"""with {SCORED}, base as (select *, {_MERIT} as merit, case when n_chars % 3 = 0 then 1 else 0 end as level from scored), long as (select id, lang, score, merit, unnest([{", ".join(f"{{'dimension': '{d}', 'size': {d}::double}}" for d in _DIMENSIONS)}]) as v from base),
flat as (select id, lang, score, merit, v.dimension as dimension, v.size as size from long), q as (select lang, dimension, quantile_cont(size, 1.0::double / 3) as q1, quantile_cont(size, 2.0::double / 3) as q2, count(distinct size) as k, count(*) as n from flat group by 1, 2),
ranked as (select *, (rank() over (partition by lang, dimension order by size) + (count(*) over (partition by lang, dimension, size) - 1) / 2.0::double) / count(*) over (partition by lang, dimension) as place from flat),
s as (select r.*, case when k < 3 then 'constant' when q1 = q2 then case when place <= 1.0::double / 3 then 'small' when place <= 2.0::double / 3 then 'medium' else 'large' end when size <= q1 then 'small' when size <= q2 then 'medium' else 'large' end as stratum from ranked r join q using (lang, dimension)),
bounds as (select lang, dimension, stratum, min(size) as least, max(size) as most from s group by 1, 2, 3), m as (select * from (select lang, dimension, stratum, id, unnest([{{'metric': 'score', 'value': score}}, {{'metric': 'merit', 'value': merit}}], recursive := true) from s) where value is not null),
{catalog._R}, {catalog._seeded("m", "d", ("'0'", "id::varchar"))}, x as (select lang, dimension, stratum, metric, b, sum(w * value)::double / sum(w) as mean from (select *, {catalog._w()} as w from d) where w > 0 group by 1, 2, 3, 4, 5),
e as (select lang, dimension, stratum, metric, quantile_cont(mean, 0.025) as low, quantile_cont(mean, 0.975) as high from x group by 1, 2, 3, 4), p as (select lang, dimension, stratum, metric, count(*) as n, avg(value) as mean from m group by 1, 2, 3, 4)
select lang, dimension, stratum, round(least, 9) as least, round(most, 9) as most, metric, n, round(mean, 9) as mean, round(low, 9) as low, round(high, 9) as high from p join e using (lang, dimension, stratum, metric) join bounds using (lang, dimension, stratum)""")
def scale_strata(spark, sf):
    rows = _rows(spark, sf).withColumn("level", F.when(F.col("n_chars") % 3 == 0, 1).otherwise(0))
    return rounded(correlations.scale_table(rows, ["lang"], "id", _DIMENSIONS, ["score", "merit"]))
