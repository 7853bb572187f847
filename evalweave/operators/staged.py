"""Token selectors by name, as plans. A selector is a list of stages: each puts a sample's tokens in an order and takes the first of them that are still free, up to its quota.

Orders are windows by sample; they share one partitioning, so that however many stages a selector has, tokens are shuffled once. Only what goes token by token (farthest points, turns of regions, gains that depend on earlier picks) is a fold over the sample's array.
What a stage can't fill is left to the next ones, and at last to relevance and distance. With a budget of all tokens, all are kept.

Tokens have x1, y1, x2, y2, relevance, uniqueness and regions (boxes of the sample's evidence, the same in all of its rows; null, empty or no such column without any); a sample has some thousands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import boxes as bx
from evalweave.functions.boxes import bound

TINY = 1e-12
#: How far a relation's corridor reaches beyond the boxes that it joins.
CORRIDOR = 0.04
#: Selectors by name, in the order in which they are tried.
NAMES = [
    "random", "grid", "grid_topk", "center", "topk", "bottomk", "shuffled_topk", "rise", "hybrid", "rel_hybrid", "soft_relboost", "protected_rel_hybrid", "protected_topk", "protected_center_topk", "soft_evidence_topk", "spatial_aware", "coverage_greedy",
]

Order = tuple[DataFrame, list[Column], Column]


def _rounded(share: float, k: Column) -> Column:
    return F.bround(F.lit(share) * k).cast("int")


def _between(low: Column | int, value: Column, high: Column) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, int) else low, F.least(high, value)).cast("int")


class Stages:
    """One run over tokens: ``by`` tells samples (and whatever else) apart, ``rows`` carry _step, the place in the order of the picks, null while a token is free."""

    def __init__(self, tokens: DataFrame, by: list[str], index: str, keep: Column):
        self.by, self.index = by, index
        if "regions" not in tokens.columns:
            tokens = tokens.withColumn("regions", F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
        whole = Window.partitionBy(*by)
        rows = tokens.withColumns({"_n": F.count(F.lit(1)).over(whole), "_cx": (F.col("x1") + F.col("x2")) / 2, "_cy": (F.col("y1") + F.col("y2")) / 2})
        rows = rows.withColumn("_k", F.greatest(F.lit(1), F.least(F.col("_n"), keep)).cast("int")).withColumn("_regions", F.coalesce("regions", F.array().cast(dict(tokens.dtypes)["regions"])))
        every = F.when(F.col("_k") == F.col("_n"), F.row_number().over(whole.orderBy(index)))
        self.rows = rows.withColumn("_step", every.cast("int"))

    # orders: new columns, what to sort by, and which tokens take part

    @property
    def k(self) -> Column:
        return F.col("_k")

    def own(self) -> Window:
        return Window.partitionBy(*self.by)

    def relevance(self, rows: DataFrame) -> Order:
        return rows, [F.col("relevance").desc()], F.lit(True)

    def scored(self, score: Column) -> Callable[[DataFrame], Order]:
        return lambda rows: (rows, [score.desc()], F.lit(True))

    def grid(self, rows: DataFrame) -> Order:
        """Of each of the first cells of a square grid the token nearest to its centre, then the others by row and column."""
        line = lambda v: F.greatest(F.lit(0), F.least(F.col("_side") - 1, F.floor(F.col(v) * F.col("_side")))).cast("int")
        rows = rows.withColumn("_side", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_limit").cast("double")))).cast("int"))
        rows = rows.withColumns({"_gx": line("_cx"), "_gy": line("_cy")}).withColumn("_cell", F.col("_gy") * F.col("_side") + F.col("_gx"))
        off = F.pow(F.col("_cx") - (F.col("_gx") + 0.5) / F.col("_side"), 2) + F.pow(F.col("_cy") - (F.col("_gy") + 0.5) / F.col("_side"), 2)
        near = F.row_number().over(Window.partitionBy(*self.by, "_cell").orderBy(off, self.index))
        rows = rows.withColumn("_late", (near > 1) | (F.col("_cell") >= F.col("_limit")))
        return rows, [F.col("_late"), F.when(~F.col("_late"), F.col("_cell")), F.col("_cy"), F.col("_cx")], F.lit(True)

    def nearest(self, rows: DataFrame, those: Column) -> DataFrame:
        """``rows`` with _d2, the squared distance to the nearest of some tokens' centres; 0 without any."""
        points = F.collect_list(F.when(those, F.struct("_cx", "_cy"))).over(self.own())
        far = F.transform(points, lambda p: F.pow(F.col("_cx") - p["_cx"], 2) + F.pow(F.col("_cy") - p["_cy"], 2))
        return rows.withColumn("_d2", F.coalesce(F.array_min(far), F.lit(0.0)))

    def ring(self, rows: DataFrame) -> Order:
        """Around the relevant tokens: those of positive relevance where not all are, else the best; nothing where none is."""
        own = self.own()
        best = F.row_number().over(own.orderBy(F.col("relevance").desc(), self.index))
        rows = rows.withColumns({"_positive": F.count_if(F.col("relevance") > 0).over(own), "_best": best})
        most = F.greatest(F.lit(1), F.least(F.col("_n"), F.when(F.col("_taken") > 0, F.col("_taken")).otherwise(F.col("_limit"))))
        anchor = F.when(F.col("_positive") < F.col("_n"), F.col("relevance") > 0).otherwise(F.col("_best") <= most)
        return self.nearest(rows, anchor), [F.col("_d2"), F.col("relevance").desc()], F.col("_positive") > 0

    def corridor(self, rows: DataFrame) -> Order:
        """Between the first two regions: what touches their common box first, then by distance to it; nothing with fewer."""
        two, clip = F.slice("_regions", 1, 2), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        side = lambda c, f, by: clip(f(F.transform(two, lambda r: r[c])) + by)
        way = bx.box(side("x1", F.array_min, -CORRIDOR), side("y1", F.array_min, -CORRIDOR), side("x2", F.array_max, CORRIDOR), side("y2", F.array_max, CORRIDOR))
        rows = rows.withColumn("_way", way)
        touches = (F.least("x2", F.col("_way.x2")) > F.greatest("x1", F.col("_way.x1"))) & (F.least("y2", F.col("_way.y2")) > F.greatest("y1", F.col("_way.y1")))
        off = [F.greatest(F.lit(0.0), F.col(f"_way.{a}1") - F.col(f"_c{a}"), F.col(f"_c{a}") - F.col(f"_way.{a}2")) for a in "xy"]
        middle = [F.col(f"_c{a}") - (F.col(f"_way.{a}1") + F.col(f"_way.{a}2")) / 2 for a in "xy"]
        return rows, [~touches, off[0] * off[0] + off[1] * off[1], middle[0] * middle[0] + middle[1] * middle[1], F.col("relevance").desc()], F.size("_regions") >= 2

    def corridor_then_ring(self, rows: DataFrame) -> Order:
        rows, around, some = self.ring(rows)
        rows, way, both = self.corridor(rows)
        first = F.when(both, F.struct(*[c.alias(f"c{i}") for i, c in enumerate([way[0].cast("int"), *way[1:3]])]))
        then = F.when(~both, around[0])
        return rows, [first, then, F.col("relevance").desc()], both | some

    def relevance_and_distance(self, rows: DataFrame) -> Order:
        return self.nearest(rows, F.col("_step").isNotNull()), [F.col("relevance").desc(), F.col("_d2").desc()], F.lit(True)

    def take(self, quota: Column, order: Callable[[DataFrame], Order]) -> Stages:
        """The first free tokens in the order, as many as the quota says and the budget leaves; ``quota`` may look at _taken."""
        names = self.rows.columns
        rows = self.rows.withColumn("_taken", F.count("_step").over(self.own())).withColumn("_limit", F.greatest(F.lit(0), F.least(quota, F.col("_k") - F.col("_taken"))).cast("int"))
        rows, keys, some = order(rows)
        free = F.col("_step").isNull() & F.coalesce(some, F.lit(False))
        place = F.row_number().over(Window.partitionBy(*self.by, free).orderBy(*keys, self.index))
        step = F.when(free & (place <= F.col("_limit")), F.col("_taken") + place).otherwise(F.col("_step"))
        self.rows = rows.select(*[c for c in names if c != "_step"], step.cast("int").alias("_step")).select(*names)
        return self

    # folds over a sample's tokens

    def folded(self, steps: Callable[[Column], Column], when: Column | None = None) -> Stages:
        """``steps`` gives, from the sample's tokens in index order (an array of structs), the 0-based places of tokens in the order of the picks; those that are still free are taken, up to _limit of the sample."""
        names = [c for c in self.rows.columns if c not in self.by]
        rows = self.rows.groupBy(*self.by).agg(F.array_sort(F.collect_list(F.struct(F.col(self.index).alias("_at"), F.struct(*names).alias("_row")))).alias("_t"))
        rows = rows.withColumn("_t", F.transform("_t", lambda t: t["_row"])).withColumn("_picks", steps(F.col("_t")))
        taken = F.size(F.filter("_t", lambda t: t["_step"].isNotNull()))
        stepped = F.transform("_t", lambda t, i: F.struct(*[t[c].alias(c) for c in names if c != "_step"], F.coalesce(t["_step"], F.nullif(F.array_position("_picks", i).cast("int"), F.lit(0)) + taken).alias("_step")))
        self.rows = rows.select(*self.by, F.inline(stepped)).select(*self.rows.columns)
        return self

    def limit(self, t: Column, quota: Callable[[Column, Column], Column]) -> Column:
        """What a quota, of the sample's tokens and the number that is taken, leaves to a fold."""
        taken = F.size(F.filter(t, lambda x: x["_step"].isNotNull()))
        return F.greatest(F.lit(0), F.least(quota(t, taken), t[0]["_k"] - taken)).cast("int")

    def _best(self, scores: Column) -> Column:
        """The 0-based place of the first largest score."""
        return F.array_position(scores, F.array_max(scores)).cast("int") - 1

    def farthest(self, quota: Column) -> Stages:
        """Always the free token farthest from all that is picked; from nothing, the grid."""
        self.rows = self.rows.withColumns({"_empty": F.count("_step").over(self.own()) == 0, "_more": quota.cast("int")})
        self.take(F.when(F.col("_empty"), F.col("_more")).otherwise(0), self.grid)
        d2 = lambda a, b: F.pow(a["_cx"] - b["_cx"], 2) + F.pow(a["_cy"] - b["_cy"], 2)

        def steps(t: Column) -> Column:
            picked = F.filter(t, lambda x: x["_step"].isNotNull())
            start = F.transform(t, lambda x: F.when(x["_step"].isNotNull(), F.lit(-1.0)).otherwise(F.array_min(F.transform(picked, lambda p: d2(x, p)))))
            more = F.when(t[0]["_empty"], 0).otherwise(self.limit(t, lambda t, taken: t[0]["_more"]))
            turn = lambda s: bound(self._best(s["far"]), lambda j: F.struct(F.transform(s["far"], lambda d, i: F.when((i == j) | (d < 0), F.lit(-1.0)).otherwise(F.least(d, d2(F.get(t, i), F.get(t, j))))).alias("far"), F.concat(s["out"], F.array(j)).alias("out")))
            turns = F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(turns, F.struct(start.alias("far"), F.array().cast("array<int>").alias("out")), lambda s, _: turn(s))["out"]

        return self.folded(steps)

    def _shares(self, x: Column, regions: Column) -> Column:
        """The share of a token's area that each region covers."""
        own = bx.box(x["x1"], x["y1"], x["x2"], x["y2"])
        return F.transform(regions, lambda r: bx.overlap(own, r) / F.greatest(F.lit(TINY), bx.area(own)))

    def region_turns(self, quota: Callable[[Column, Column], Column], most: Callable[[Column], Column] | None = None) -> Stages:
        """Regions take turns, each with its token of the largest covered share that no turn has had; ``most`` says after how many tokens the turns end."""

        def steps(t: Column) -> Column:
            regions = t[0]["_regions"]
            shares = F.transform(t, lambda x: self._shares(x, regions))
            queue = lambda r: F.transform(F.array_sort(F.filter(F.transform(t, lambda x, i: F.struct((-F.get(F.get(shares, i), r)).alias("s"), (-x["relevance"]).alias("r"), i.alias("i"))), lambda q: q["s"] < 0)), lambda q: q["i"])
            queues = F.transform(regions, lambda _, r: queue(r))
            rounds = F.coalesce(F.array_max(F.transform(queues, F.size)), F.lit(0)) * F.size(regions)
            turns = F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>"))

            def turn(qs: Column, out: Column, s: Column) -> Column:
                fresh = F.get(F.filter(F.get(qs, s % F.size(qs)), lambda i: ~F.array_contains(out, i)), F.lit(0))
                return bound(fresh, lambda j: F.when(j.isNull(), out).otherwise(F.concat(out, F.array(j))))

            every = bound(queues, lambda qs: F.aggregate(turns, F.array().cast("array<int>"), lambda out, s: turn(qs, out, s)))
            every = F.slice(every, F.lit(1), most(t)) if most else every
            return F.slice(F.filter(every, lambda i: F.get(t, i)["_step"].isNull()), F.lit(1), self.limit(t, quota))

        return self.folded(steps)

    def region_centres(self, quota: Callable[[Column, Column], Column]) -> Stages:
        """For each region in turn the token nearest to its centre that no region has had, one whose own centre lies in it first."""

        def steps(t: Column) -> Column:
            regions = t[0]["_regions"]
            inside = lambda x, r: (x["_cx"] >= r["x1"]) & (x["_cx"] <= r["x2"]) & (x["_cy"] >= r["y1"]) & (x["_cy"] <= r["y2"])
            d2 = lambda x, r: F.pow(x["_cx"] - (r["x1"] + r["x2"]) / 2, 2) + F.pow(x["_cy"] - (r["y1"] + r["y2"]) / 2, 2)
            share = lambda x, r: F.get(self._shares(x, F.array(r)), F.lit(0))
            order = lambda r: F.transform(F.array_sort(F.transform(t, lambda x, i: F.struct((~inside(x, r)).alias("o"), d2(x, r).alias("d"), (-share(x, r)).alias("s"), (-x["relevance"]).alias("r"), i.alias("i")))), lambda q: q["i"])
            turn = lambda out, r: bound(F.get(F.filter(order(r), lambda i: ~F.array_contains(out, i)), F.lit(0)), lambda j: F.when(j.isNull(), out).otherwise(F.concat(out, F.array(j))))
            every = F.aggregate(regions, F.array().cast("array<int>"), turn)
            return F.slice(F.filter(every, lambda i: F.get(t, i)["_step"].isNull()), F.lit(1), self.limit(t, quota))

        return self.folded(steps)

    def rise(self, unique: float = 0.6, spread: float = 0.4, dominant: float = 0.7) -> Stages:
        """A share by relevance and uniqueness, then from the best three times k with a bonus for the distance to what is picked."""
        base = F.col("relevance") + unique * F.col("uniqueness")
        self.rows = self.rows.withColumn("_base", base).withColumn("_short", F.row_number().over(self.own().orderBy(base.desc(), self.index)) <= 3 * F.col("_k"))
        self.take(_rounded(dominant, self.k), self.scored(F.col("_base")))
        d2 = lambda a, b: F.pow(a["_cx"] - b["_cx"], 2) + F.pow(a["_cy"] - b["_cy"], 2)

        def steps(t: Column) -> Column:
            picked = F.filter(t, lambda x: x["_step"].isNotNull())
            near = F.transform(t, lambda x: F.when(x["_step"].isNotNull() | ~x["_short"], F.lit(-1.0)).otherwise(F.coalesce(F.array_min(F.transform(picked, lambda p: d2(x, p))), F.lit(0.0))))
            some = lambda out: F.size(picked) + F.size(out) > 0
            score = lambda s: F.transform(s["near"], lambda d, i: F.when(d < 0, F.lit(float("-inf"))).otherwise(F.get(t, i)["_base"] + spread * F.sqrt(d)))
            after = lambda s, j: F.transform(s["near"], lambda d, i: F.when((i == j) | (d < 0), F.lit(-1.0)).when(some(s["out"]), F.least(d, d2(F.get(t, i), F.get(t, j)))).otherwise(d2(F.get(t, i), F.get(t, j))))
            turn = lambda s: bound(self._best(score(s)), lambda j: F.struct(after(s, j).alias("near"), F.concat(s["out"], F.array(j)).alias("out")))
            more = self.limit(t, lambda t, taken: t[0]["_k"])
            turns = F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(turns, F.struct(near.alias("near"), F.array().cast("array<int>").alias("out")), lambda s, _: turn(s))["out"]

        return self.folded(steps)

    def coverage(self, target: float = 1.0, grid: float = 0.30, evidence: float = 0.50, unique: float = 0.20) -> Stages:
        """Most gain first: scaled relevance and uniqueness, a new cell of a square grid, and what a token adds to the covered share of each region."""
        own = self.own()
        scaled = lambda c: F.when(F.max(c).over(own) - F.min(c).over(own) > TINY, (F.col(c) - F.min(c).over(own)) / (F.max(c).over(own) - F.min(c).over(own))).otherwise(0.0)
        side = F.ceil(F.sqrt(F.col("_k").cast("double"))).cast("int")
        line = lambda v: F.greatest(F.lit(0), F.least(side - 1, F.floor(F.col(v) * side))).cast("int")
        token = bx.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
        share = F.when(F.size("_regions") > 0, F.transform("_regions", lambda r: bx.overlap(token, r) / F.greatest(F.lit(TINY), bx.area(r)))).otherwise(F.array(F.lit(0.0)))
        self.rows = self.rows.withColumns({"_fixed": target * scaled("relevance") + unique * scaled("uniqueness"), "_square": line("_cy") * side + line("_cx"), "_share": share, "_cells": (side * side).cast("double")})

        def steps(t: Column) -> Column:
            gain = lambda s, x: F.aggregate(F.zip_with(s["covered"], x["_share"], lambda c, h: F.least(F.lit(1.0), c + h) - F.least(F.lit(1.0), c)), F.lit(0.0), lambda a, v: a + v) / F.size(x["_share"])
            fresh = lambda s, x: F.when(F.array_contains(s["cells"], x["_square"]), 0.0).otherwise(1.0)
            score = lambda s: F.transform(t, lambda x, i: F.when(F.array_contains(s["out"], i) | x["_step"].isNotNull(), F.lit(float("-inf"))).otherwise(x["_fixed"] + grid * fresh(s, x) / x["_cells"] + evidence * gain(s, x)))
            after = lambda s, j: F.struct(F.zip_with(s["covered"], F.get(t, j)["_share"], lambda c, h: F.least(F.lit(1.0), c + h)).alias("covered"), F.concat(s["cells"], F.array(F.get(t, j)["_square"])).alias("cells"), F.concat(s["out"], F.array(j)).alias("out"))
            start = F.struct(F.transform(t[0]["_share"], lambda _: F.lit(0.0)).alias("covered"), F.array().cast("array<int>").alias("cells"), F.array().cast("array<int>").alias("out"))
            more = self.limit(t, lambda t, taken: t[0]["_k"])
            turns = F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(turns, start, lambda s, _: bound(self._best(score(s)), lambda j: after(s, j)))["out"]

        return self.folded(steps)

    def finished(self) -> DataFrame:
        """(by, index, step) of what is kept."""
        return self.rows.where("_step is not null").select(*self.by, self.index, F.col("_step").alias("step"))


def select(tokens: DataFrame, name: str, sample: str, index: str, keep: Column, by: list[str] | None = None, core: float = 0.5, around: float = 0.25) -> DataFrame:
    """(by, index, step) of the tokens that a named selector keeps, ``keep`` of each sample's _n tokens; ``by`` are the columns that tell samples apart, where it isn't ``sample`` alone.

    Random orders are digests of the selector's name, the sample and the token's place, so that they need no generator's state.
    """
    if name not in NAMES:
        raise ValueError(f"no selector {name}; there are {NAMES}")
    s = Stages(tokens, by or [sample], index, keep)
    k, every = s.k, F.lit(1 << 30)
    place = F.row_number().over(s.own().orderBy(index)) - 1
    digest = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(name), F.col(sample).cast("string"), F.col("_at").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    cored = _between(1, _rounded(core, k), k)
    second = _between(0, _rounded(around, k), k - cored)
    some = F.size("_regions") > 0
    whole, protected = (lambda t, taken: t[0]["_k"]), (lambda t, taken: _between(1, _rounded(core, t[0]["_k"]), t[0]["_k"]))
    contexts = {"hybrid": s.ring, "rel_hybrid": s.corridor_then_ring}
    if name in ("random", "shuffled_topk"):
        s.rows = s.rows.withColumn("_at", place).withColumn("_digest", digest)
        if name == "shuffled_topk":  # the token at a place gets the relevance of the token at that place of the random order
            drawn = F.array_sort(F.collect_list(F.struct("_digest", "_at", "relevance")).over(s.own()))
            s.rows = s.rows.withColumn("_digest", F.get(drawn, F.col("_at"))["relevance"])
        s.take(every, s.scored(F.col("_digest")))
    elif name == "grid":
        s.take(k, s.grid)
    elif name == "grid_topk":
        s.take(_between(1, _rounded(0.5, k), k), s.grid).take(k, s.relevance)
    elif name == "center":
        s.take(every, s.scored(-(F.pow(F.col("_cx") - 0.5, 2) + F.pow(F.col("_cy") - 0.5, 2))))
    elif name in ("topk", "bottomk"):
        s.take(every, s.scored(F.col("relevance") if name == "topk" else -F.col("relevance")))
    elif name == "rise":
        s.rise()
    elif name == "coverage_greedy":
        s.coverage()
    elif name in contexts:
        s.take(cored, s.relevance).take(second, contexts[name]).farthest(k - cored - second).take(k, s.relevance_and_distance)
    elif name == "soft_relboost":
        s.take(cored, s.relevance)
        rows, keys, ringed = s.ring(s.rows.withColumns({"_taken": F.count("_step").over(s.own()), "_limit": second}))
        s.rows = rows.select(*s.rows.columns, F.row_number().over(s.own().orderBy(*keys, index)).alias("_ring"), ringed.alias("_ringed"), (cored + second).alias("_aim"))
        around_it = lambda rows: (rows, [F.col("_ring")], F.col("_ringed"))
        left = F.col("_aim") - F.col("_taken")
        # the last places of the ring's share go to the corridor, and back to the ring where there is none
        s.take(left - F.least(left, F.greatest(F.lit(1), F.bround(F.lit(0.15) * left))), around_it)
        s.take(left, lambda rows: (lambda found: (found[0], found[1], found[2] & F.col("_ringed")))(s.corridor(rows)))
        s.take(left, around_it).farthest(k - cored - second).take(k, s.relevance_and_distance)
    elif name == "protected_rel_hybrid":
        s.region_turns(protected).take(F.when(some, 0).otherwise(cored), s.relevance)
        s.take(F.when(some, _rounded(around, k)).otherwise(second), s.corridor_then_ring).farthest(F.when(some, k).otherwise(k - cored - second)).take(k, s.relevance_and_distance)
    elif name == "protected_topk":
        s.region_turns(protected).take(k, s.relevance)
    elif name == "protected_center_topk":
        s.region_centres(whole).take(k, s.relevance)
    elif name == "soft_evidence_topk":
        own, x = s.own(), F.struct("x1", "y1", "x2", "y2")
        span = F.max("relevance").over(own) - F.min("relevance").over(own)
        scaled = F.when(span > TINY, (F.col("relevance") - F.min("relevance").over(own)) / span).otherwise(0.0)
        holds = F.exists("_regions", lambda r: (F.col("_cx") >= r["x1"]) & (F.col("_cx") <= r["x2"]) & (F.col("_cy") >= r["y1"]) & (F.col("_cy") <= r["y2"]))
        share = F.when(holds, 1.0).otherwise(F.coalesce(F.array_max(s._shares(x, F.col("_regions"))), F.lit(0.0)))
        s.rows = s.rows.withColumn("_soft", F.when(some, scaled + 0.10 * share).otherwise(F.col("relevance")))
        s.take(every, s.scored(F.col("_soft")))
    else:  # spatial_aware: a token for each region's centre, more evidence up to the anchors, the corridor, the rest spread out; without regions the grid
        s.rows = s.rows.withColumn("_anchors", F.greatest(F.least(k, F.size("_regions")), F.least(k, _rounded(0.35, k))))
        s.take(F.when(some, 0).otherwise(k), s.grid)
        s.region_centres(lambda t, taken: t[0]["_anchors"]).region_turns(lambda t, taken: t[0]["_anchors"] - taken, lambda t: t[0]["_anchors"])
        s.take(F.when(some, _rounded(around, k)).otherwise(0), s.corridor_then_ring).farthest(k)
    return s.finished()


def parse(names: str | list[str] | None) -> list[str]:
    """Known names from a list or a text with commas."""
    found = ["random", "grid", "center"] if names is None else [n.strip() for n in (names.split(",") if isinstance(names, str) else names) if n.strip()]
    if not found or set(found) - set(NAMES):
        raise ValueError(f"selectors are {NAMES}")
    return found
