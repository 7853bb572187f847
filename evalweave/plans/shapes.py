"""Queries of records and reports of unknown shape, of trace summaries, masks over budgets, skylines and constrained permutations, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions.relations import PHRASES
from evalweave.operators import assignments, masks, traces
from evalweave.plans.inputs import table
from evalweave.plans.register import query, rounded
from evalweave.sources import records


@query("""with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as i from conversations)
select conv_id, 'turns[' || i || '].' || f.name as path, f.value as value from (select conv_id, i, unnest([{'name': 'role', 'value': role}, {'name': 'said.text', 'value': text}, {'name': 'said.turn', 'value': turn::varchar}]) as f from t)
union all select conv_id, 'size', count(*)::varchar from t group by 1""")
def report_leaves(spark, sf):
    """Conversations folded into one object each, and flat again."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    folded = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    turn = lambda t: F.struct(t["role"].alias("role"), F.struct(t["text"].alias("text"), t["turn"].alias("turn")).alias("said"))
    report = F.to_json(F.struct(F.transform("t", turn).alias("turns"), F.size("t").alias("size")), {"ignoreNullFields": "false"})
    return records.flattened(folded.select("conv_id", F.parse_json(report).alias("report")), ["conv_id"])


@query("""with t as (select role, conv_id, row_number() over (partition by role, conv_id order by turn, text) as place, turn, length(text) as n from conversations)
select role, conv_id::varchar as conv, place::varchar as place, turn, n as length from t""")
def report_curves(spark, sf):
    """A curve a role and conversation, nested in one report a role, as flat rows."""
    rows = table(spark, sf, "conversations").groupBy("role", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    point = F.transform("t", lambda t: F.struct(t["turn"].alias("turn"), F.length(t["text"]).alias("length")))
    folded = rows.groupBy("role").agg(F.map_from_entries(F.collect_list(F.struct(F.col("conv_id").cast("string"), point))).alias("m"))
    reports = folded.select("role", F.parse_json(F.to_json(F.struct(F.col("m").alias("curves")))).alias("report"))
    return records.report_rows(reports, ["role"], "$.curves", ["conv", "place"], {"turn": "bigint", "length": "bigint"})


_BOXES = "select l_orderkey, l_linenumber, l_partkey % 90 as x, l_suppkey % 40 as y, 1 + l_linenumber as w, 1 + l_linenumber % 3 as h from lineitem"


@query(f"""with b as ({_BOXES}), n as (select l_orderkey, x / 100.0::double as x1, y / 50.0::double as y1, least(1, (x + w) / 100.0::double) as x2, least(1, (y + h) / 50.0::double) as y2 from b where l_linenumber % 6 <> 5),
d as (select distinct l_orderkey, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2 from n), o as (select distinct l_orderkey from lineitem)
select 'o' || o.l_orderkey as id, case when count(x1) > 0 then 'ocr_regions' else 'none' end as bbox_source, count(x1) as regions, round(coalesce(sum(x1 + 2 * y1 + 3 * x2 + 4 * y2), 0), 6) as weighed, 'Q' || (o.l_orderkey % 7) as question, 'first' as answer, o.l_orderkey % 3 = 0 as sized_by_pair from o left join d using (l_orderkey) group by o.l_orderkey""")
def region_records(spark, sf):
    """Orders as records in every layout: eight field names, boxes as lists, objects, corners and sizes, polygons, texts, and one item that is no box."""
    l = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "int(l_partkey % 90) x", "int(l_suppkey % 40) y", "int(1 + l_linenumber) w", "int(1 + l_linenumber % 3) h")  # noqa: E741
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    say = lambda form, *cs: F.format_string(form, *[F.col(c) if isinstance(c, str) else c for c in cs])
    kind = F.col("l_linenumber") % 6
    item = (
        F.when(kind == 0, say("[%d, %d, %d, %d]", "x", "y", x2, y2)).when(kind == 1, say('{"text": "t", "bbox": [%d.0, %d, %d, %d]}', "x", "y", x2, y2)).when(kind == 2, say('{"rect": {"x": %d, "y": %d, "width": %d, "height": %d}}', "x", "y", "w", "h"))
        .when(kind == 3, say('{"polygon": [[%d, %d], [%d, %d], {"x": %d, "y": %d}]}', "x", "y", x2, "y", x2, y2)).when(kind == 4, say('{"box": "%d, %d, %d, %d"}', "x", "y", x2, y2)).otherwise(F.lit('{"text": "no box"}'))
    )
    items = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "x", "y", item.alias("item")))).alias("i"))
    joined = F.array_join(F.transform("i", lambda s: s["item"]), ", ")
    field = F.element_at(F.array(*map(F.lit, records.REGION_FIELDS)), (F.col("l_orderkey") % len(records.REGION_FIELDS) + 1).cast("int"))
    size = F.when(F.col("l_orderkey") % 3 == 0, '"image_size": [100, 50]').when(F.col("l_orderkey") % 3 == 1, '"width": 100, "height": "50"').otherwise('"image_width": 100.0, "image_height": 50')
    key = F.col("l_orderkey").cast("string")
    text = F.concat(F.lit('{"id": "o'), key, F.lit('", "ocr_text": [], "evidence_regions_": [1], "query": " Q'), (F.col("l_orderkey") % 7).cast("string"), F.lit(' ", "answers": ["first", "second"], '), size, F.lit(', "'), field, F.lit('": ['), joined, F.lit("]}"))
    out = records.region_samples(items.select(F.col("l_orderkey").alias("ord"), F.parse_json(text).alias("record")))
    weighed = F.aggregate("evidence_regions", F.lit(0.0), lambda a, b: a + F.round(b["x1"], 6) + 2 * F.round(b["y1"], 6) + 3 * F.round(b["x2"], 6) + 4 * F.round(b["y2"], 6))
    return rounded(out.select("id", "bbox_source", F.col("evidence_region_count").cast("long").alias("regions"), weighed.alias("weighed"), "question", "answer", (F.substring("id", 2, 20).cast("long") % 3 == 0).alias("sized_by_pair")), 6)


_SAID = sorted(PHRASES)


@query(f"""with c as (select p_partkey, [{", ".join(f"'{p}'" for p in _SAID)}][(p_partkey % {len(_SAID)} + 1)::int] as phrase, [{", ".join(f"'{PHRASES[p]}'" for p in _SAID)}][(p_partkey % {len(_SAID)} + 1)::int] as relation, p_partkey, p_size from part)
select 'vsr-parts-test-' || p_partkey as id, 'box ' || p_partkey as subject, 'shelf ' || p_size as object, relation, case when p_partkey % 5 in (0, 3) then 'yes' else 'no' end as answer, 'The box ' || p_partkey || ' is ' || phrase || ' a shelf ' || p_size || '.' as source_caption from c
where relation in ('left_of', 'right_of', 'above', 'below', 'on')""")
def caption_records(spark, sf):
    """Captions of every phrase, with labels in five layouts and the relation named in half of the records."""
    p = table(spark, sf, "part")
    at = (F.col("p_partkey") % len(_SAID) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    key = F.col("p_partkey").cast("string")
    label = F.element_at(F.array(*map(F.lit, ["true", "0", '"no"', '" YES "', "false"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    hint = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"relation": "'), pick([PHRASES[s].replace("_", " ") for s in _SAID]), F.lit('", '))).otherwise("")
    text = F.concat(F.lit('{"'), F.when(F.col("p_partkey") % 3 == 0, "caption").when(F.col("p_partkey") % 3 == 1, "sentence").otherwise("text"), F.lit('": "The box '), key, F.lit(" is "), pick(_SAID), F.lit(" a shelf "), F.col("p_size").cast("string"), F.lit('.", '), hint, F.lit('"label": '), label, F.lit("}"))
    out = records.caption_samples(p.select(F.col("p_partkey").alias("ord"), F.parse_json(text).alias("record")), "Parts", "test", left_right_only=False, families=["left_right", "vertical"])
    return out.select("id", "subject", "object", "relation", "answer", "source_caption")


_TRACES = """traces as (select l_returnflag as flag, case when l_linenumber = 7 then 0 else l_quantity * 10 end as f, l_quantity * 4 as k, l_discount * 10 as ecr, case when l_tax > 0.06 then null else l_tax * 10 end as anchor, l_tax > 0.02 as e, l_extendedprice / 1000 as v, l_partkey % 13 as s, l_suppkey % 7 as q from lineitem)"""


@query(f"""with {_TRACES} select flag, count(*) as traces, round(coalesce(avg(k / f) filter (f > 0), 0), 7) as mean_keep_ratio, 0.0::double as mean_full_sequence_tokens, round(avg(k + 5), 7) as mean_pruned_sequence_tokens, round(avg(f), 7) as mean_full_visual_tokens, round(avg(k), 7) as mean_kept_visual_tokens,
round(avg(1 - k / 1000), 7) as mean_removal_fraction, round(coalesce(avg(ecr) filter (e), 0), 7) as mean_ecr, round(coalesce(avg(coalesce(anchor, ecr)) filter (e), 0), 7) as mean_anchor_ecr, round(coalesce(avg(ecr / 2) filter (e), 0), 7) as mean_evidence_center_recall, 0.0::double as mean_evidence_patch_recall,
round(avg(v), 7) as mean_vision_ms, round(avg(s::double), 7) as mean_target_text_ms, 0.0::double as mean_score_compute_ms, round(avg(q::double), 7) as mean_selector_ms, 0.0::double as mean_prune_materialize_ms, round(avg(q + s::double), 7) as mean_prune_overhead_ms, 0.0::double as mean_language_ms, round(avg(v + s), 7) as mean_forward_ms from traces group by 1""")
def trace_summary(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    rows = l.selectExpr(
        "l_returnflag flag", "case when l_linenumber = 7 then 0 else l_quantity * 10 end full_visual_tokens", "l_quantity * 4 kept_visual_tokens", "l_quantity * 4 + 5 pruned_sequence_tokens", "1 - l_quantity * 4 / 1000 removal_fraction", "l_discount * 10 ecr",
        "case when l_tax > 0.06 then null else l_tax * 10 end anchor_ecr", "l_tax > 0.02 has_evidence", "l_discount * 10 / 2 evidence_center_recall", "l_extendedprice / 1000 mean_vision_ms", "-1 vision_ms", "l_partkey % 13 target_text_ms", "l_suppkey % 7 selector_ms",
        "l_suppkey % 7 + l_partkey % 13 mean_prune_overhead_ms", "l_extendedprice / 1000 + l_partkey % 13 mean_forward_ms",
    )
    return rounded(traces.trace_summary(rows, ["flag"]), 7)


_MASKS = """kept as (select user_id, b, event_id % 200 as i from events, (values (0.3::double, 30), (0.5::double, 55), (0.7::double, 80)) t(b, share) where (event_id * 7 + user_id) % 100 < share group by all)"""


@query(f"""with {_MASKS}, s as (select user_id, coalesce(list(distinct i) filter (b = 0.3::double), []) as l, coalesce(list(distinct i) filter (b = 0.5::double), []) as m, coalesce(list(distinct i) filter (b = 0.7::double), []) as h from kept group by 1),
g as (select *, i - lag(i) over (partition by user_id, b order by i) as gap from kept), t as (select user_id, b, least(9, floor(i * 10 / 200.0::double)) as part, count(*) as n from kept group by 1, 2, 3), c as (select user_id, b, sum(n) as n from t group by 1, 2),
e as (select user_id, b, sum(-(t.n / c.n::double) * ln(t.n / c.n::double + 1e-12)) / ln(10.0::double) as e from t join c using (user_id, b) group by 1, 2), f as (select user_id, b, avg((i / 199.0::double <= 0.10 or i / 199.0::double >= 0.90)::int::double) as edge, avg((i / 199.0::double between 0.40 and 0.60)::int::double) as centre from kept group by 1, 2),
w as (select user_id, coalesce(max(e) filter (b = 0.3::double), 0) as el, coalesce(max(e) filter (b = 0.5::double), 0) as em, coalesce(max(e) filter (b = 0.7::double), 0) as eh, coalesce(max(edge) filter (b = 0.7::double), 0) - coalesce(max(edge) filter (b = 0.3::double), 0) as edge, coalesce(max(centre) filter (b = 0.7::double), 0) - coalesce(max(centre) filter (b = 0.3::double), 0) as centre from e join f using (user_id, b) group by 1)
select user_id, round(len(list_intersect(l, m))::double / greatest(1, len(list_distinct(list_concat(l, m)))), 9) as jaccard_low_mid, round(len(list_intersect(m, h))::double / greatest(1, len(list_distinct(list_concat(m, h)))), 9) as jaccard_mid_high, round(len(list_intersect(l, h))::double / greatest(1, len(list_distinct(list_concat(l, h)))), 9) as jaccard_low_high,
round(coalesce((len(m) - len(list_intersect(l, m)))::double / nullif(len(m), 0), 0), 9) as new_low_mid, round(coalesce((len(h) - len(list_intersect(m, h)))::double / nullif(len(h), 0), 0), 9) as new_mid_high,
round(em - el, 9) + 0.0::double as entropy_gain_low_mid, round(eh - em, 9) + 0.0::double as entropy_gain_mid_high, round(edge, 9) + 0.0::double as edge_delta, round(centre, 9) + 0.0::double as centre_delta from s join w using (user_id)""")
def cross_budget_masks(spark, sf):
    budgets = F.inline(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(s).alias("share")) for b, s in ((0.3, 30), (0.5, 55), (0.7, 80))]))
    kept = table(spark, sf, "events").select("user_id", "event_id", budgets).where("(event_id * 7 + user_id) % 100 < share").select("user_id", "b", (F.col("event_id") % 200).alias("i"))
    out = rounded(masks.cross_budget_features(kept, "user_id", "b", "i", F.lit(200), [0.3, 0.5, 0.7]))
    return out.select("user_id", *[(F.col(c) + 0.0).alias(c) for c in out.columns[1:]])


@query("""with p as (select p_brand as b, p_partkey as k, p_retailprice as low, p_size as high from part), f as (select * from p x where not exists (select 1 from p y where y.b = x.b and y.low <= x.low and y.high >= x.high and (y.low < x.low or y.high > x.high))),
d as (select p.b, p.k, f.k as d, row_number() over (partition by p.b, p.k order by f.high, f.low, f.k) as place from p join f on p.b = f.b and f.low <= p.low and f.high >= p.high and (f.low < p.low or f.high > p.high)), n as (select b, k, string_agg(d::varchar, ',' order by place) as d from d where place <= 4 group by 1, 2)
select p.b as p_brand, p.k as p_partkey, n.d is null as front, coalesce(n.d, '') as dominators from p left join n on n.b = p.b and n.k = p.k""")
def skyline_dominators(spark, sf):
    out = assignments.beaten_by(table(spark, sf, "part"), ["p_brand"], "p_partkey", "p_retailprice", "p_size")
    return out.select("p_brand", "p_partkey", "front", F.array_join(F.col("dominators").cast("array<string>"), ",").alias("dominators"))


@query("""select count(distinct conv_id) as sources, count(distinct conv_id) as targets, 0::bigint as fixed, 0::bigint as collisions from conversations""")
def mismatch_controls(spark, sf):
    """Conversations mapped to others that share none of the long words of their first turn: how many, and what is wrong with the result (nothing)."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\\W+")).alias("token"))
    forbidden = turns.withColumn("token", F.when((F.col("turn") == 0) & (F.length("token") >= 10), F.col("token")))
    found = assignments.collision_free_derangement(forbidden, turns.select("key", "token"))
    met = found.join(forbidden.select(F.col("key").alias("source"), "token").where("token is not null").distinct(), "source").join(turns.select(F.col("key").alias("target"), "token").distinct(), ["target", "token"], "left_semi")
    return found.agg(F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"), F.count_if(F.col("source") == F.col("target")).alias("fixed")).crossJoin(F.broadcast(met.agg(F.count(F.lit(1)).alias("collisions"))))  # one row each
