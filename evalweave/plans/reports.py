"""Queries of annotation agreement, provenance, joins of runs and their traces, features and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions import boxes as bx
from evalweave.functions import features, geometry
from evalweave.operators import annotation, traces
from evalweave.plans import inputs
from evalweave.plans.inputs import BOX_ROWS, HALF, PROBE_ROWS, TOKENS, table
from evalweave.plans.register import query, rounded, union_sql

# annotations


def _annotators(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two annotators' rows per order; some orders lack one of them, some a box, some agree in labels."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    labels = l.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_linestatus").alias("states"))
    rows = inputs.boxes(spark, sf).withColumnRenamed("l_orderkey", "sample_id").join(labels, "sample_id")
    k = F.col("sample_id")
    rows = rows.withColumns({"task": F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("t"), (k % 3).cast("string"))), "status": F.lit("done")})
    fewer = F.when(k % 2 == 0, F.col("evidence")).otherwise(F.slice("evidence", F.lit(1), F.size("evidence") - 1))
    a = rows.where(k % 11 != 0).select("sample_id", "task", "status", F.col("kept").alias("boxes"), F.col("flags").alias("labels"))
    return a, rows.where(k % 13 != 0).select("sample_id", "task", "status", fewer.alias("boxes"), F.when(k % 5 == 0, F.col("states")).otherwise(F.col("flags")).alias("labels"))


_O = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_COMPARED = f"""recursive {BOX_ROWS}, sa as (select l_orderkey as k, row_number() over (partition by l_orderkey order by x1, y1, x2, y2) as i, x1, y1, x2, y2 from box_rows where l_orderkey % 11 <> 0),
sb as (select * from (select l_orderkey as k, row_number() over (partition by l_orderkey order by ex1, ey1, ex2, ey2) as i, count(*) over (partition by l_orderkey) as n, ex1 as x1, ey1 as y1, ex2 as x2, ey2 as y2 from box_rows where l_orderkey % 13 <> 0) where k % 2 = 0 or i < n),
su as (select k, x1, y1, x2, y2 from sa union all select k, x1, y1, x2, y2 from sb),
pairs as (select *, row_number() over (partition by k order by iou desc, i desc, j desc) as r from (select a.k, a.i, b.i as j, {_O} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_O}) as iou from sa a join sb b on a.k = b.k)),
taken as (select k, 0::bigint as r, []::bigint[] as ui, []::bigint[] as uj, []::double[] as ious from (select distinct k from pairs) union all
  select t.k, p.r, case when used then ui else list_append(ui, p.i) end, case when used then uj else list_append(uj, p.j) end, case when used then ious else list_append(ious, p.iou) end
  from taken t join (select *, null as unused from pairs) p on p.k = t.k and p.r = t.r + 1, lateral (select list_contains(ui, p.i) or list_contains(uj, p.j) as used)),
matched as (select k, arg_max(ious, r) as ious from taken group by k),
{union_sql("sa", "k", "x1", "y1", "x2", "y2", "ua")}, {union_sql("sb", "k", "x1", "y1", "x2", "y2", "ub")}, {union_sql("su", "k", "x1", "y1", "x2", "y2", "uu")},
lab as (select l_orderkey as k, list_sort(list(distinct l_returnflag)) as flags, list_sort(list(distinct l_linestatus)) as states from lineitem group by 1),
base as (select k, case when k % 7 = 0 then '' else 't' || (k % 3)::varchar end as task, (k % 11 <> 0)::int as pa, (k % 13 <> 0)::int as pb, case when k % 11 <> 0 then flags else [] end as la,
  case when k % 13 = 0 then [] when k % 5 = 0 then states else flags end as lb, coalesce((select count(*) from sa where sa.k = lab.k), 0) as na, coalesce((select count(*) from sb where sb.k = lab.k), 0) as nb from lab where k % 11 <> 0 or k % 13 <> 0),
wide as (select b.*, coalesce(m.ious, []) as ious, coalesce(ua.area, 0) as aa, coalesce(ub.area, 0) as ab, coalesce(uu.area, 0) as au, la = lb as same, len(list_filter(coalesce(m.ious, []), lambda x: x >= 0.5)) as good
  from base b left join matched m on m.k = b.k left join ua on ua.k = b.k left join ub on ub.k = b.k left join uu on uu.k = b.k),
compared as (select k as sample_id, case when pa + pb = 0 then '' else task end as task, case when pa = 1 then 'done' else '' end as status_a, case when pb = 1 then 'done' else '' end as status_b, pa as present_a, pb as present_b,
  na::int as box_count_a, nb::int as box_count_b, (na - nb)::int as box_count_delta, array_to_string(la, ';') as label_types_a, array_to_string(lb, ';') as label_types_b, same::int as label_type_set_match, len(ious)::int as matched_box_pairs, good::int as iou_ge_threshold_pairs,
  case when len(ious) > 0 then list_sum(ious) / len(ious) else 0 end as mean_matched_iou, case when len(ious) > 0 then list_min(ious) else 0 end as min_matched_iou, case when au > 0 then greatest(0, aa + ab - au) / au else 0 end as union_region_iou,
  case when aa > 0 then greatest(0, aa + ab - au) / aa else 0 end as primary_covered_by_secondary, case when ab > 0 then greatest(0, aa + ab - au) / ab else 0 end as secondary_covered_by_primary, (na = nb and na > 0 and good = na)::int as all_boxes_matched_iou,
  (pa = 0 or pb = 0 or na <> nb or not same or (na > 0 and good < greatest(na, nb)) or (na = 0 and nb = 0))::int as needs_adjudication from wide)"""
_FIVE = ["mean_matched_iou", "min_matched_iou", "union_region_iou", "primary_covered_by_secondary", "secondary_covered_by_primary"]


@query(f"with {_COMPARED} select * replace ({', '.join(f'round({c}, 9) as {c}' for c in _FIVE)}) from compared")
def annotation_comparison(spark, sf):
    return rounded(annotation.compared(*_annotators(spark, sf)))


_COUNTS = ["samples", "present_in_both", "box_count_match", "label_type_set_match", "all_boxes_matched_iou", "needs_adjudication"]
_SUMMARY = ", ".join(f"{{'metric': '{n}', 'value': {v}}}" for n, v in zip([*_COUNTS, *annotation.MEANS], ["count(*)::double", "sum(present_a * present_b)::double", "sum((box_count_a = box_count_b)::int)::double", *[f"sum({c})::double" for c in _COUNTS[3:]], *[f"avg({c})" for c in annotation.MEANS.values()]], strict=True))


@query(f"""with {_COMPARED}, scoped as (select 'all' as scope, unnest([{_SUMMARY}]) as m from compared union all select task, unnest([{_SUMMARY}]) from compared where task <> '' group by task)
select scope, m.metric as metric, round(m.value, 6) as value from scoped where scope = 'all' or m.metric <> 'present_in_both'""")
def annotation_summary(spark, sf):
    return rounded(annotation.agreement_summary(annotation.compared(*_annotators(spark, sf))), 6)


@query(f"""with {BOX_ROWS}, b as (select l_orderkey as sample_id, count(*)::int as n_boxes, round(sum(x1), 6) as left_edges from box_rows group by 1)
select sample_id, case when sample_id % 3 = 0 then 'consensus' when sample_id % 7 = 0 then 'unresolved' else 'adjudicated' end as status, case when sample_id % 3 <> 0 and sample_id % 7 = 0 then 0 else n_boxes end as n_boxes,
 case when sample_id % 3 <> 0 and sample_id % 7 = 0 then 0 else left_edges end as left_edges from b""")
def annotation_final(spark, sf):
    rows = inputs.boxes(spark, sf).select(F.col("l_orderkey").alias("sample_id"), F.lit("t").alias("task"), F.col("kept").alias("boxes"))
    k = F.col("sample_id")
    judged = rows.where(k % 3 != 0).select("sample_id", "task", F.when(k % 7 == 0, F.slice("boxes", 1, 0)).otherwise(F.col("boxes")).alias("adjudicated_boxes"))
    out = annotation.final_annotations(rows.where(k % 3 == 0), judged, allow_unresolved=True)
    return rounded(out.select("sample_id", "status", F.size("boxes").alias("n_boxes"), F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b["x1"]).alias("left_edges")), 6)


# geometry

_CUT = """evidence as (select l_orderkey, ex1, ey1, ex2, ey2 from box_rows), cut as (select a.l_orderkey, a.i, greatest(a.x1, b.ex1) as x1, greatest(a.y1, b.ey1) as y1, least(a.x2, b.ex2) as x2, least(a.y2, b.ey2) as y2
  from box_rows a join box_rows b on a.l_orderkey = b.l_orderkey where least(a.x2, b.ex2) > greatest(a.x1, b.ex1) and least(a.y2, b.ey2) > greatest(a.y1, b.ey1)),
near as (select * from box_rows a where exists (select 1 from cut where cut.l_orderkey = a.l_orderkey and cut.i = a.i))"""


@query(f"""with {BOX_ROWS}, {_CUT}, {union_sql("evidence", "l_orderkey", "ex1", "ey1", "ex2", "ey2", "ue")}, {union_sql("cut", "l_orderkey", "x1", "y1", "x2", "y2", "uc")}, {union_sql("near", "l_orderkey", "x1", "y1", "x2", "y2", "un")}
select ue.l_orderkey, round(least(1, coalesce(uc.area / un.area, 0)), 9) as local_precision, case when ue.l_orderkey % 2 = 0 and round(least(1, coalesce(uc.area, 0) / ue.area), 9) >= 0.5 then 1.0::double else 0.0::double end as attributed
from ue left join uc on uc.l_orderkey = ue.l_orderkey left join un on un.l_orderkey = ue.l_orderkey""")
def local_provenance(spark, sf):
    kept, evidence = F.col("kept"), F.col("evidence")
    gate = geometry.attributed_accuracy(F.col("l_orderkey") % 2 == 0, F.round(bx.evidence_coverage(kept, evidence), 9))
    return rounded(inputs.boxes(spark, sf).select("l_orderkey", geometry.local_precision(kept, evidence).alias("local_precision"), gate.alias("attributed")), 9)


@query(f"""with {BOX_ROWS}, evidence as (select l_orderkey, ex1, ey1, ex2, ey2 from box_rows), {union_sql("evidence", "l_orderkey", "ex1", "ey1", "ex2", "ey2", "ue")},
e as (select *, row_number() over (partition by l_orderkey order by ex1, ey1, ex2, ey2) as r, count(*) over (partition by l_orderkey) as n from evidence),
p as (select a.l_orderkey, a.n, (a.ex2 - a.ex1) * (a.ey2 - a.ey1) as sa, coalesce((b.ex2 - b.ex1) * (b.ey2 - b.ey1), 0) as oa, (a.ex1 + a.ex2) / 2 - (b.ex1 + b.ex2) / 2 as dx, (a.ey1 + a.ey2) / 2 - (b.ey1 + b.ey2) / 2 as dy,
  greatest(0, greatest(a.ex1, b.ex1) - least(a.ex2, b.ex2)) as hg, greatest(0, greatest(a.ey1, b.ey1) - least(a.ey2, b.ey2)) as vg, b.r is not null as two from e a left join e b on b.l_orderkey = a.l_orderkey and b.r = 2 where a.r = 1),
q as (select *, case when sa > 0 and oa > 0 then least(sa, oa) else greatest(sa, oa) end as low, greatest(sa, oa) as high from p)
select q.l_orderkey, round(area, 9) as evidence_area, round(sa, 9) as subject_area, round(oa, 9) as object_area, round(low, 9) as min_object_area, round(high, 9) as max_object_area, round(case when low > 0 then high / greatest(1e-12, low) else 0 end, 9) as area_imbalance,
 round(case when two then sqrt(dx * dx + dy * dy) else 0 end, 9) as center_distance, round(case when two then hg else 0 end, 9) as horizontal_gap, round(case when two then vg else 0 end, 9) as vertical_gap, n::double as evidence_region_count from q join ue on ue.l_orderkey = q.l_orderkey""")
def box_pair_geometry(spark, sf):
    found = geometry.box_features(F.col("evidence"))
    return rounded(inputs.boxes(spark, sf).select("l_orderkey", *[c.alias(n) for n, c in found.items()]), 9)


_REGIONS = f"""{TOKENS}, tb as (select *, x - {HALF}::double as x1, y - {HALF}::double as y1, x + {HALF}::double as x2, y + {HALF}::double as y2 from tokens),
ev as (select * from (select sample_id, x1, y1, x2, y2, row_number() over (partition by sample_id order by idx) as r from tb where label = 0) where r <= 2),
ov as (select a.sample_id, a.idx, sum({_O}) as o from tb a join ev b on a.sample_id = b.sample_id group by 1, 2),
sh as (select t.*, coalesce(o, 0) / greatest(1e-12, (x2 - x1) * (y2 - y1)) as share from tb t left join ov on ov.sample_id = t.sample_id and ov.idx = t.idx)"""


def _token_arrays(spark, sf) -> DataFrame:
    t = inputs.token_boxes(spark, sf)
    got = t.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.struct("x1", "y1", "x2", "y2").alias("box"), "relevance"))).alias("t"), F.first("regions").alias("regions"))
    return got.select("sample_id", F.transform("t", lambda s: s["idx"]).alias("ids"), F.transform("t", lambda s: s["box"]).alias("boxes"), F.transform("t", lambda s: s["relevance"]).alias("relevance"), F.coalesce("regions", F.slice(F.transform("t", lambda s: s["box"]), 1, 0)).alias("regions"))


@query(f"""with {_REGIONS} select sample_id, idx, place::int as place from (select *, row_number() over (partition by sample_id order by share desc, relevance desc, idx) as place from sh where share > 0) where place <= 6""")
def evidence_protected_ranking(spark, sf):
    rows = _token_arrays(spark, sf)
    places = geometry.evidence_protected(F.col("boxes"), F.col("regions"), F.col("relevance"), 6)
    return rows.select("sample_id", "ids", F.posexplode(places).alias("at", "i")).select("sample_id", F.expr("ids[i]").alias("idx"), (F.col("at") + 1).alias("place"))


@query(f"""with {_REGIONS}, rel as (select *, case when max(share) over (partition by sample_id) > 0 then share else 1 - least(1, sqrt(power((x1 + x2) / 2 - 0.5::double, 2) + power((y1 + y2) / 2 - 0.5::double, 2)) / 0.70710678118::double) end as evidence_relevance from sh),
near as (select a.sample_id, a.idx, min(power((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + power((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) as d from rel a join rel b on a.sample_id = b.sample_id and b.evidence_relevance > 0 group by 1, 2)
select r.sample_id, r.idx, round(evidence_relevance, 6) as evidence_relevance, round(coalesce(least(1, sqrt(d)), 0), 6) as spatial_uniqueness from rel r left join near n on n.sample_id = r.sample_id and n.idx = r.idx""")
def evidence_relevance(spark, sf):
    rows = _token_arrays(spark, sf).withColumn("e", geometry.evidence_relevance(F.col("boxes"), F.col("regions")))
    rows = rows.withColumn("u", geometry.spatial_uniqueness(F.col("boxes"), F.col("e")))
    zipped = rows.select("sample_id", F.explode(F.arrays_zip("ids", "e", "u")).alias("z"))
    return rounded(zipped.select("sample_id", F.col("z.ids").alias("idx"), F.col("z.e").alias("evidence_relevance"), F.col("z.u").alias("spatial_uniqueness")), 6)


@query("""with t as (select page_id, 1 + page_id % 9 as p, 1 + page_id % 2 as r, 1 + page_id % 4 as c from pages), f as (select *, p in (r * c, r * c + 1) as fits from t),
g as (select *, case when p <= 1 or not fits then 1 else r end as rows, case when p <= 1 then 1 when fits then c else p end as cols, p > 1 and p = r * c + 1 and r * c > 1 as thumb from f)
select page_id, rows::int as rows, cols::int as cols, thumb as thumbnail, (4 * rows * cols + case when thumb then 4 else 0 end)::int as n_boxes, round(rows * cols * 2 * 0.5::double / cols + rows * cols * 4 * (0.5::double * (cols - 1) / cols) + case when thumb then 1 else 0 end, 6) as left_edges from g""")
def tiled_token_boxes(spark, sf):
    k = F.col("page_id")
    made = table(spark, sf, "pages").select("page_id", geometry.tiled_boxes(1 + k % 9, 1 + k % 2, 1 + k % 4, 2, 2).alias("t"))
    return rounded(made.select("page_id", "t.rows", F.col("t.columns").alias("cols"), "t.thumbnail", F.size("t.boxes").alias("n_boxes"), F.aggregate("t.boxes", F.lit(0.0), lambda s, b: s + b["x1"]).alias("left_edges")), 6)


# joins of runs


@query("""with l as (select l_orderkey * 10 + l_linenumber as sample_id, max(l_suppkey) as image_id, sum(l_quantity) as q, sum(l_tax) as t, max(l_returnflag) as f from lineitem group by l_orderkey, l_linenumber)
select image_id, count(*) as n, round(avg(q - t), 6) as mean from l where f <> 'R' group by 1""")
def cluster_differences(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"), "l_linenumber").agg(F.max("l_suppkey").alias("image_id"), F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("t"), F.max("l_returnflag").alias("f"))
    value = lambda a, b: F.when(a("f") != "R", a("q") - b("t"))
    return rounded(traces.cluster_differences(rows.select("sample_id", "image_id", "q", "f"), rows.select("sample_id", "image_id", "t"), "sample_id", "image_id", value), 6)


@query("""select o_orderkey, o_custkey from orders where o_orderstatus <> 'F' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')""")
def split_exclusion(spark, sf):
    orders = table(spark, sf, "orders")
    return traces.unused(orders.where("o_orderstatus <> 'F'"), orders.where("o_orderstatus = 'F'"), "o_custkey").select("o_orderkey", "o_custkey")


@query("""select d.doc_id, lang, coalesce(quality, -1) as quality, coalesce(toxic, 0) as toxic from documents d left join labels l on l.doc_id = d.doc_id""")
def side_table_lookup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    out = traces.with_side_values(docs, table(spark, sf, "labels"), "doc_id", {"quality": -1, "toxic": 0}, {"toxic": lambda c: c.isin(0, 1)})
    return out


_TRACES = f"""{BOX_ROWS}, tk as (select l_orderkey, row_number() over (partition by l_orderkey order by x1, y1, x2, y2) - 1 as i, x1, y1, x2, y2 from box_rows), kp as (select * from tk where i % 2 = 0), ev as (select l_orderkey, ex1, ey1, ex2, ey2 from box_rows),
cut as (select a.l_orderkey, greatest(a.x1, b.ex1) as x1, greatest(a.y1, b.ey1) as y1, least(a.x2, b.ex2) as x2, least(a.y2, b.ey2) as y2 from kp a join ev b on a.l_orderkey = b.l_orderkey and least(a.x2, b.ex2) > greatest(a.x1, b.ex1) and least(a.y2, b.ey2) > greatest(a.y1, b.ey1)),
near as (select * from kp a where exists (select 1 from ev b where a.l_orderkey = b.l_orderkey and least(a.x2, b.ex2) > greatest(a.x1, b.ex1) and least(a.y2, b.ey2) > greatest(a.y1, b.ey1))),
{union_sql("ev", "l_orderkey", "ex1", "ey1", "ex2", "ey2", "ue")}, {union_sql("cut", "l_orderkey", "x1", "y1", "x2", "y2", "uc")}, {union_sql("near", "l_orderkey", "x1", "y1", "x2", "y2", "un")},
cov as (select ue.l_orderkey as sample_id, ue.area as evidence_area, least(1, coalesce(uc.area, 0) / ue.area) as ecr, least(1, coalesce(uc.area / un.area, 0)) as lpp from ue left join uc on uc.l_orderkey = ue.l_orderkey left join un on un.l_orderkey = ue.l_orderkey)"""


def _traces(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every other box of an order as what a mask keeps, and its evidence as the probe's regions."""
    rows = inputs.boxes(spark, sf)
    kept = F.filter(F.sequence(F.lit(0), F.size("kept") - 1), lambda i: i % 2 == 0)
    return rows.select(F.col("l_orderkey").alias("sample_id"), F.col("kept").alias("tokens"), kept.alias("kept")), rows.select(F.col("l_orderkey").alias("sample_id"), F.col("evidence").alias("regions"))


@query(f"""with {_TRACES}, centre as (select e.l_orderkey, e.ex1, e.ey1, e.ex2, e.ey2, max(((k.x1 + k.x2) / 2 between e.ex1 and e.ex2 and (k.y1 + k.y2) / 2 between e.ey1 and e.ey2)::int) as hit, count(distinct e.r) as c
  from (select *, row_number() over () as r from ev) e join kp k on k.l_orderkey = e.l_orderkey group by e.l_orderkey, e.r, 2, 3, 4, 5),
cr as (select l_orderkey, avg(hit::double) as centre_recall from centre group by 1),
hit as (select a.l_orderkey, avg((a.i % 2 = 0)::int::double) as patch_recall from tk a where exists (select 1 from ev b where a.l_orderkey = b.l_orderkey and least(a.x2, b.ex2) > greatest(a.x1, b.ex1) and least(a.y2, b.ey2) > greatest(a.y1, b.ey1)) group by 1)
select sample_id, sample_id % 3 <> 0 as has_evidence, case when sample_id % 3 <> 0 then round(ecr, 9) end as ecr, case when sample_id % 3 <> 0 then round(centre_recall, 9) end as evidence_center_recall,
 case when sample_id % 3 <> 0 then round(coalesce(patch_recall, 0), 9) end as evidence_patch_recall from cov left join cr on cr.l_orderkey = sample_id left join hit on hit.l_orderkey = sample_id""")
def trace_backfill(spark, sf):
    t, probes = _traces(spark, sf)
    out, _ = traces.enriched(t, probes.where("sample_id % 3 <> 0"))
    return rounded(out.select("sample_id", "has_evidence", "ecr", "evidence_center_recall", "evidence_patch_recall"), 9)


@query(f"""with {_TRACES}, cells as (select l_orderkey, count(*)::int as full_tokens, sum((i % 2 = 0)::int)::int as kept_tokens, median((x2 - x1) * (y2 - y1)) as cell from tk group by 1),
o as (select o_orderkey, o_totalprice / 1000 as m, o_custkey % 2 as correct, o_totalprice / 500 as f from orders)
select sample_id, full_tokens, kept_tokens, round(evidence_area, 9) as evidence_area, round(cell, 9) as median_cell_area, round(evidence_area / cell, 9) as box_cell_ratio, round(ecr, 9) as ecr, round(lpp, 9) as local_precision,
 round(case when ecr + lpp > 0 then 2 * ecr * lpp / (ecr + lpp) else 0 end, 9) as geo_f1, round(m, 9) as selected_margin, correct::int as selected_correct, round(f, 9) as full_margin, round(abs(f), 9) as full_abs_margin
from cov join cells on l_orderkey = sample_id join o on o_orderkey = sample_id where o_orderkey % 4 <> 0""")
def model_star_join(spark, sf):
    t, probes = _traces(spark, sf)
    orders = table(spark, sf, "orders")
    probes = probes.join(orders.select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 4 != 0, "positive").otherwise("negative").alias("polarity")), "sample_id")
    stored = t.join(probes.select("sample_id", "regions"), "sample_id").withColumn("_k", F.transform("kept", lambda i: F.col("tokens")[i]))
    stored = stored.select("sample_id", "tokens", "kept", bx.evidence_coverage(F.col("_k"), F.col("regions")).alias("ecr"))
    scores = orders.select(F.col("o_orderkey").alias("sample_id"), (F.col("o_totalprice") / 1000).alias("margin"), (F.col("o_custkey") % 2 == 1).alias("correct"))
    full = orders.select(F.col("o_orderkey").alias("sample_id"), (F.col("o_totalprice") / 500).alias("margin"))
    return rounded(traces.model_rows(stored, probes, scores, full))


@query(f"""with {PROBE_ROWS}, p as (select sample_id, max(abs(m)) as spread, count(*)::double as probes, max(case when probe = 'orig' then abs(m) end) as own from last_rows group by 1), q as (select sample_id, max(abs(m)) as spread, count(*)::double as probes, max(case when probe = 'orig' then abs(m) end) as own from last_rows where probe <> 'crop' group by 1),
r as (select unnest(['spread', 'probes', 'own']) as risk, unnest([coalesce(p.spread, 0), coalesce(p.probes, 0), coalesce(p.own, 0)]) as a, unnest([coalesce(q.spread, 0), coalesce(q.probes, 0), coalesce(q.own, 0)]) as b, p.sample_id is not null as ina, q.sample_id is not null as inb from p full join q on p.sample_id = q.sample_id)
select risk, sum(ina::int)::bigint as full_samples, sum(inb::int)::bigint as low_samples, round(coalesce(avg(abs(a - b)) filter (ina and inb), 0), 9) as mean_difference, round(coalesce(max(abs(a - b)) filter (ina and inb), 0), 9) as largest_difference,
 sum(ina::int) = sum(inb::int) and coalesce(max(abs(a - b)) filter (ina and inb), 0) <= 1e-8 as equivalent from r group by 1""")
def low_cost_equivalence(spark, sf):
    from evalweave.operators.probes import last_record

    last = last_record(inputs.probe_rows(spark, sf), "ord")
    risks = lambda rows: rows.groupBy("sample_id").agg(F.max(F.abs("margin")).alias("spread"), F.count(F.lit(1)).cast("double").alias("probes"), F.max(F.when(F.col("probe") == "orig", F.abs("margin"))).alias("own"))
    return rounded(traces.equivalence(risks(last), risks(last.where("probe <> 'crop'")), "sample_id", ["spread", "probes", "own"]))


@query("""with c as (select o_orderkey, seed, o_totalprice * (1 - seed::double / 10) as v from orders, (select unnest([1, 2, 3]) as seed))
select seed::int as seed, o_custkey, round(avg(o_totalprice - v), 4) as difference from orders o join c on c.o_orderkey = o.o_orderkey group by 1, 2""")
def seed_image_matrix(spark, sf):
    orders = table(spark, sf, "orders")
    runs = orders.select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed"), "o_totalprice").withColumn("o_totalprice", F.col("o_totalprice") * (1 - F.col("seed").cast("double") / 10))
    return rounded(traces.seed_differences(orders, runs, "o_orderkey", "o_custkey", "o_totalprice"), 4)


@query("""with k as (select c_custkey, unnest([case when trim(c_name) <> '' then 'name=' || lower(trim(c_name)) end, case when trim(c_mktsegment) <> '' then 'segment=' || lower(trim(c_mktsegment)) end, 'nation=' || c_nationkey::varchar]) as key from customer) select key, count(*) as n, min(c_custkey) as first from k where key is not null group by 1""")
def external_row_index(spark, sf):
    index = annotation.external_index(table(spark, sf, "customer"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")})
    return index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))


@query("""with t as (select l_orderkey as sample_id, case when l_linenumber = 1 then 'yes' when l_linenumber = 2 then 'no' end as answer, l_quantity as forward_ms, l_tax as selector_ms from lineitem),
w as (select sample_id, coalesce(max(forward_ms) filter (answer = 'yes'), 0) as yes_forward_ms, coalesce(max(forward_ms) filter (answer = 'no'), 0) as no_forward_ms, coalesce(max(selector_ms) filter (answer = 'yes'), 0) as yes_selector_ms, coalesce(max(selector_ms) filter (answer = 'no'), 0) as no_selector_ms from t group by 1)
select *, (yes_forward_ms + no_forward_ms) / 2 as mean_forward_ms, round((yes_selector_ms + no_selector_ms) / 2, 9) as mean_selector_ms from w""")
def trace_pair_means(spark, sf):
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.when(n == 1, "yes").when(n == 2, "no").alias("answer"), F.col("l_quantity").alias("forward_ms"), F.col("l_tax").alias("selector_ms"))
    return rounded(traces.trace_pairs(rows, ["forward_ms", "selector_ms"]))


@query("""with p as (select o_orderkey as k, unnest([{'probe': 'orig', 'masked': 0}, {'probe': 'evidence_masked', 'masked': (o_custkey % 3)::int}, {'probe': 'random_masked', 'masked': 1}]) as v from orders) select k, v.probe as probe, v.masked as masked, 3 as probe_count from p""")
def masked_view_expansion(spark, sf):
    boxes = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("o_custkey") % 3), lambda i: bx.box(i / 4, i / 4, (i + 1) / 4, (i + 1) / 4))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), boxes.alias("evidence"), bx.box(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0.5)).alias("drawn"))
    return traces.masked_views(rows, "evidence", "drawn").select("k", "probe", F.coalesce(F.size("mask_regions"), F.lit(0)).alias("masked"), "probe_count")


@query("""with m as (select vec_id // 2 as image_id, vec_id, 'img' || (vec_id // 2)::varchar as image from embeddings), pairs as (select image_id from m group by 1 having count(*) = 2), n as (select max(image_id) + 1 as n from pairs)
select m.image_id, vec_id, image as original_image, 'shuffle' as control_type, 7 as control_seed, (m.image_id + 1) % n as control_image_id, 'path/' || ((m.image_id + 1) % n)::varchar as image from m join pairs on pairs.image_id = m.image_id, n""")
def control_rewrite(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("image_id"), "vec_id").withColumn("image", F.concat(F.lit("img"), F.col("image_id").cast("string")))
    ids = rows.groupBy("image_id").count().where("count = 2").select("image_id")
    n = ids.agg((F.max("image_id") + 1).alias("n"))
    mapping = ids.crossJoin(F.broadcast(n)).select("image_id", ((F.col("image_id") + 1) % F.col("n")).alias("mapped"))  # n is one row
    paths = mapping.select("image_id", F.concat(F.lit("path/"), F.col("mapped").cast("string")).alias("path"))
    return traces.controlled(rows.join(ids, "image_id"), mapping, paths, "shuffle", 7)


# budgets and features


@query("""with a as (select l_orderkey, coalesce(max(l_returnflag) filter (l_linenumber = 1), '') as x, coalesce(max(l_returnflag) filter (l_linenumber = 2), '') as y, coalesce(max(l_returnflag) filter (l_linenumber = 3), '') as z from lineitem group by 1)
select l_orderkey, case when x = y then 0.3 else 1.0 end::double as pair_budget, round(case when x = y then 0.8 else 1.8 end::double, 9) as pair_cost, case when x = y then 0.3 when y = z then 0.7 else 1.0 end::double as staged_budget, case when x = y then 0.8 when y = z then 1.5 else 2.5 end::double as staged_cost,
 case when x <> '' and (x = y or x = z) then 0.3 when y <> '' and y = z then 0.5 else 1.0 end::double as majority_budget, case when (x <> '' and (x = y or x = z)) or (y <> '' and y = z) then 'majority_answer' else 'no_majority_answer' end as majority_reason from a""")
def answer_stability(spark, sf):
    at = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_returnflag")))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))
    x, y, z = map(F.col, "xyz")
    rows = rows.select("l_orderkey", traces.pair_decision(x, y, 0.3, 1.0).alias("p"), traces.staged_decision(x, y, z).alias("s"), traces.majority_decision(x, y, z).alias("m"))
    return rounded(rows.select("l_orderkey", F.col("p.budget").alias("pair_budget"), F.col("p.cost").alias("pair_cost"), F.col("s.budget").alias("staged_budget"), F.col("s.cost").alias("staged_cost"), F.col("m.budget").alias("majority_budget"), F.col("m.reason").alias("majority_reason")))


@query("""with b as (select p_partkey, p_retailprice as f, p_retailprice / 2 + p_size as q, (p_size % 3)::double as d from part), m as (select *, 'no_detector' as detector_mode, q as base from b union all select *, 'online_detector', q + d from b where d > 0), t as (select *, unnest([8, 32, 128]) as n from m)
select p_partkey, detector_mode, n::int as generated_tokens, round(f + n * 12.5::double, 6) as full_ms, round(base + n * 12.5::double, 6) as pruned_ms, round((f + n * 12.5::double) / (base + n * 12.5::double), 9) as speedup, round(100 * (1 - (base + n * 12.5::double) / (f + n * 12.5::double)), 6) as reduction_pct from t""")
def output_length_sweep(spark, sf):
    p, size = F.col("p_retailprice"), F.col("p_size")
    rows = table(spark, sf, "part").select("p_partkey", p.alias("full_ttft_ms"), (p / 2 + size).alias("pruned_ttft_ms"), (size % 3).cast("double").alias("detector_ms"), (p / 2 + size + size % 3).alias("detector_inclusive_ttft_ms"))
    out = traces.length_sweep(rows, 12.5, [8, 32, 128])
    return out.select("p_partkey", "detector_mode", "generated_tokens", F.round("full_ms", 6).alias("full_ms"), F.round("pruned_ms", 6).alias("pruned_ms"), F.round("speedup", 9).alias("speedup"), F.round("reduction_pct", 6).alias("reduction_pct"))


@query("""with s as (select 'Brand#' || (p_size % 12)::varchar as decoy, p_brand as source, p_retailprice - 1000 as gap, p_size % 3 as seen from part), k as (select *, case when levenshtein(source, decoy) = 1 and length(source) = length(decoy) then 'single_substitution' when levenshtein(source, decoy) = 1 then 'single_deletion_or_insertion' else 'other' end as e from s),
t as (select unnest([{'s': 'edit_type', 'b': e}, {'s': 'source_shape', 'b': 'alpha+digit+punct'}, {'s': 'source_length', 'b': case when length(source) <= 4 then '4_or_less' when length(source) <= 7 then '5_to_7' else '8_or_more' end}, {'s': 'decoy_seen_elsewhere', 'b': case seen when 0 then 'seen' when 1 then 'unseen' end}]) as u, gap from k)
select u.s as stratum, u.b as bucket, count(*) as n, round(avg(gap), 6) as mean, round(avg((gap > 0)::int::double), 9) as win from t where u.b is not null group by 1, 2""")
def lexical_strata(spark, sf):
    size = F.col("p_size")
    pairs = table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.concat(F.lit("Brand#"), (size % 12).cast("string")).alias("decoy"), (F.col("p_retailprice") - 1000).alias("gap"), F.when(size % 3 < 2, size % 3 == 0).alias("seen"))
    out = traces.lexical_strata(pairs, "source", "decoy", "gap", F.col("seen"))
    return out.select("stratum", "bucket", "n", F.round("mean", 6).alias("mean"), F.round("win", 9).alias("win"))


@query("""with r as (select o_orderstatus, o_custkey % 8 as k, o_custkey % 10 as n from orders)
select o_orderstatus, count(*) as samples, round(avg(k), 9) as mean_kept, round(coalesce(avg(k::double / n) filter (n > 0), 0), 9) as mean_ratio, round(avg(case when n > 0 then 1 - greatest(0, least(n, k))::double / n else 0 end), 9) as mean_removed, sum(k)::bigint as total_kept, sum(n)::bigint as total_full from r group by 1""")
def budget_summary(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderstatus", (F.col("o_custkey") % 8).alias("k"), (F.col("o_custkey") % 10).alias("n"))
    return rounded(traces.budget_summary(rows, "k", "n", ["o_orderstatus"]))


@query(f"""with {PROBE_ROWS}, e as (select sample_id, count(distinct probe) as n, count(distinct probe) filter (probe not in ('contra', 'crop')) as m from probe_rows group by 1)
select count(*) as samples, round(avg(n), 9) as probes, round(avg(2 * n), 9) as calls, round(avg(m), 9) as reuse_probes, round(avg(2 * m), 9) as reuse_calls, round(avg(2 * (n - m)), 9) as calls_saved from e""")
def probe_cost(spark, sf):
    return rounded(traces.probe_cost(inputs.probe_rows(spark, sf), ["contra", "crop"]))


_EDGE = r"[^\p{L}\p{M}\p{N}_]"


def _cue(pattern: str) -> str:
    return f"regexp_matches(lower(q), '(^|{_EDGE})({pattern.removeprefix(chr(92) + 'b(').removesuffix(')' + chr(92) + 'b')})($|{_EDGE})')"


def _any(text: str, cues: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{c}')" for c in cues) + ")"


_NUMERIC = _cue(features.NUMERIC_CUES)


@query(rf"""with t as (select u.conv_id, u.turn, coalesce(u.text, '') as q, coalesce(a.text, '') as s, (a.turn is not null)::int as has from (select distinct conv_id, turn, text from conversations where role = 'user') u left join (select distinct conv_id, turn, text from conversations) a on a.conv_id = u.conv_id and a.turn = u.turn + 1),
w as (select *, len(regexp_extract_all(lower(q), '[a-z0-9]+')) as nq, regexp_extract_all(lower(s), '[a-z0-9]+') as sw, {_NUMERIC} as num, regexp_matches(s, '\p{{Nd}}') as dig from t)
select conv_id, turn, nq::double as question_len, length(q)::double as question_chars, ((nq >= 10)::int + (nq >= 18)::int + 2 * num::int + 2 * {_any("lower(q)", features.FIELD_CUES)}::int + {_any("lower(q)", features.PLACE_CUES)}::int + {_any("lower(q)", features.JOIN_CUES)}::int)::double as question_risk_score,
 has::double as target_text_token_count, num::int::double as asks_numeric, {_cue(features.DATE_CUES)}::int::double as asks_date, {_cue(features.LAYOUT_CUES)}::int::double as asks_layout, {_any("lower(q)", features.CONSTRAINT_CUES)}::int::double as question_multi_constraint, len(sw)::double as low_answer_len, length(s)::double as low_answer_chars,
 (trim(s) = '')::int::double as low_answer_empty, dig::int::double as low_answer_has_digit, (len(sw) >= 6 and len(list_distinct(sw[1:6])) <= 2)::int::double as low_answer_repetition, (num and not dig)::int::double as numeric_question_digit_missing, (len(regexp_extract_all(s, '\p{{Nd}}+')) >= 2)::int::double as low_answer_many_numbers,
 len(regexp_extract_all(s, '[^A-Za-z0-9\s]'))::double as low_answer_punctuation from w""")
def question_features(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q")).distinct()
    said = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("s"), F.lit(1).alias("has")).distinct()
    found = features.answer_features(F.col("q"), F.col("s"), F.col("has"))
    return asked.join(said, ["conv_id", "turn"], "left").select("conv_id", "turn", *[c.alias(n) for n, c in found.items()])


@query(r"""with t as (select *, p_name || '|' || p_type || ' ' || p_size::varchar as units, '  "' || p_name || '".' as raw from part)
select p_partkey, case when p_size % 10 = 0 then 'hard_persistent' when regexp_matches(p_type, '[0-9]') or p_size is not null then 'numeric_or_field' end as complexity, trim(p_name) as token, case when p_size % 3 = 0 then 'topk' when p_size % 3 = 1 then 'topk' else 'topk' end as selector, case p_size % 3 when 0 then 'embedding' when 1 then 'target_embedding' else 'evidence_oracle' end as source,
 case when p_size % 2 = 0 then p_partkey when p_partkey >= 0 then (100000 + p_partkey) end as image_number, left(p_brand, length(p_brand) - 1) || ((right(p_brand, 1)::int + 1) % 10)::varchar as wrong_brand, left(p_name, length(p_name) - 1) || case when upper(right(p_name, 1)) = 'X' then 'Z' else 'X' end as wrong_name,
 replace(p_name, ' ', '') as joined, case when p_size % 2 = 0 then 'g' || p_size::varchar else 'p' || p_partkey::varchar end as choice_group from t""")
def sample_names(spark, sf):
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    text = lambda c: c.cast("string")
    units = features.evidence_units(F.concat(name, F.lit("|"), F.col("p_type"), F.lit(" "), text(size)))
    parts = features.selector_parts(F.concat(F.when(size % 3 == 0, " Embed_").when(size % 3 == 1, "target_embed_").otherwise(""), F.lit("topk")))
    number = features.image_number(F.when(size % 2 == 0, key), F.concat(F.lit("train/img_"), text(key + 100000), F.lit(".JPG")))
    group = features.choice_group(F.when(size % 2 == 0, F.concat(F.lit("g"), text(size))), F.concat(F.lit("p"), text(key), F.lit("-"), text(size)), size, F.lit("d"), F.lit("s"), key, F.array(name))
    return table(spark, sf, "part").select(
        "p_partkey", features.complexity(units, F.array(F.lit("x")), F.when(size % 10 == 0, "persistent_failure")).alias("complexity"), features.token_form(F.concat(F.lit('  "'), name, F.lit('".'))).alias("token"), parts["selector"].alias("selector"), parts["source"].alias("source"),
        number.alias("image_number"), features.mutated_answer(F.col("p_brand")).alias("wrong_brand"), features.mutated_answer(name).alias("wrong_name"), F.element_at(features.alias_variants(name), -1).alias("joined"), group.alias("choice_group"),
    )


@query(r"""with w as (select conv_id, unnest(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')) as t from conversations), f as (select conv_id, lower(trim(t, '"''`.,;:!?()[]{}')) as token from w) select conv_id, token, count(*) as n from f where token <> '' group by 1, 2""")
def token_counter(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", F.split("text", r"\s+").alias("tokens"))
    return features.token_counts(rows, "conv_id", "tokens")


@query()
def type_decoys(spark, sf):
    return traces.decoys(table(spark, sf, "part"), "p_partkey", "p_name", "p_type")
