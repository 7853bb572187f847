"""Deterministic selection: top-k, grids, strata, quotas, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.maths import keep_count
from evalweave.functions.ranks import min_max


def _place(rows: DataFrame, by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def top_k(rows: DataFrame, by: list[str], score: str, index: str, k: int, largest: bool = True) -> DataFrame:
    """The k largest (smallest) scores of each group, ties to the smaller index. Spark keeps k rows a group and task before it shuffles."""
    first = F.col(score).desc() if largest else F.col(score).asc()
    return rows.withColumn("place", _place(rows, by, [first, F.col(index)])).where(F.col("place") <= k)


def keep_ratio(rows: DataFrame, by: list[str], score: str, index: str, ratio: float) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = rows.withColumn("n", n).withColumn("place", _place(rows, by, [F.col(score).desc(), F.col(index)]))
    return placed.where(F.col("place") <= keep_count(F.col("n"), ratio))


def hashed_k(rows: DataFrame, by: list[str], index: str, k: int, seed: int = 0) -> DataFrame:
    """k rows a group in the order of a salted digest: a random choice that needs no state."""
    digest = F.sha1(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*by, index]]).cast("binary"))
    return rows.withColumn("place", _place(rows, by, [digest, F.col(index)])).where(F.col("place") <= k)


def centre_k(rows: DataFrame, by: list[str], x: str, y: str, index: str, k: int) -> DataFrame:
    d2 = F.pow(F.col(x) - 0.5, 2) + F.pow(F.col(y) - 0.5, 2)
    return rows.withColumn("d2", d2).withColumn("place", _place(rows, by, [F.col("d2"), F.col(index)])).where(F.col("place") <= k)


def grid_places(rows: DataFrame, by: list[str], x: str, y: str, index: str, k: Column, score: str | None = None, share: float = 1.0) -> DataFrame:
    """``rows`` with ``place``: the first k of a group are its choice. k may differ from group to group.

    Of the first cells of a square grid each gives, of the rows that lie in it, the one nearest to its centre; empty cells are made up for by (y, x, index). Without ``score`` that goes on to k;
    with it, only ``share`` of k is grid and the rest goes by score.
    """
    wanted = F.greatest(F.lit(1), F.least(k, F.bround(F.lit(share) * k))).cast("int")
    side = F.ceil(F.sqrt(F.col("_g").cast("double"))).cast("int")
    line = lambda v: F.greatest(F.lit(0), F.least(F.col("_side") - 1, F.floor(F.col(v) * F.col("_side")))).cast("int")
    placed = rows.withColumn("_g", wanted).withColumn("_side", side).withColumn("_cx", line(x)).withColumn("_cy", line(y)).withColumn("_cell", F.col("_cy") * F.col("_side") + F.col("_cx"))
    far = F.pow(F.col(x) - (F.col("_cx") + 0.5) / F.col("_side"), 2) + F.pow(F.col(y) - (F.col("_cy") + 0.5) / F.col("_side"), 2)
    placed = placed.withColumn("_near", _place(placed, [*by, "_cell"], [far, F.col(index)]))
    late = ((F.col("_near") > 1) | (F.col("_cell") >= F.col("_g"))).cast("int")
    placed = placed.withColumn("_grid", _place(placed, by, [late, F.col(y), F.col(x), F.col(index)]))
    if score is None:
        placed = placed.withColumn("place", F.col("_grid"))
    else:
        placed = placed.withColumn("place", _place(placed, by, [(F.col("_grid") > F.col("_g")).cast("int"), F.col(score).desc(), F.col(index)]))
    return placed.drop("_g", "_side", "_cx", "_cy", "_cell", "_near", "_grid")


def grid_k(rows: DataFrame, by: list[str], x: str, y: str, index: str, k: int, score: str | None = None, share: float = 1.0) -> DataFrame:
    """The k rows of :func:`grid_places`."""
    return grid_places(rows, by, x, y, index, F.lit(k), score, share).where(F.col("place") <= k)


def soft_top_k(rows: DataFrame, by: list[str], relevance: str, bonus: Column, index: str, k: int, beta: float = 0.5) -> DataFrame:
    """Top-k of the group's min-max relevance plus a weighted evidence bonus."""
    scored = rows.withColumn("soft", min_max(relevance, by) + beta * bonus)
    return top_k(scored, by, "soft", index, k)


def protected_top_k(rows: DataFrame, by: list[str], protected: Column, score: str, index: str, k: int, floor_ratio: float = 0.5) -> DataFrame:
    """Protected rows first, for at most the floor's share of k, then the best of the rest."""
    floor = max(1, round(floor_ratio * k))
    ranked = rows.withColumn("_p", protected.cast("int"))
    ranked = ranked.withColumn("_pr", _place(ranked, [*by, "_p"], [F.col(score).desc(), F.col(index)]))
    late = F.when((F.col("_p") == 1) & (F.col("_pr") <= floor), 0).otherwise(1)
    ranked = ranked.withColumn("_late", late)
    return ranked.withColumn("place", _place(ranked, by, [F.col("_late"), F.col(score).desc(), F.col(index)])).where(F.col("place") <= k).drop("_p", "_pr", "_late")


def round_robin(rows: DataFrame, by: list[str], bucket: str, order: list[Column], k: int) -> DataFrame:
    """First of each bucket, then second of each, up to k a group."""
    turned = rows.withColumn("turn", _place(rows, [*by, bucket], order))
    return turned.withColumn("place", _place(turned, by, [F.col("turn"), F.col(bucket)])).where(F.col("place") <= k)


def batches(rows: DataFrame, by: list[str], bucket: str, order: list[Column], size: int) -> DataFrame:
    turned = rows.withColumn("turn", _place(rows, [*by, bucket], order))
    return turned.withColumn("place", _place(turned, by, [F.col("turn"), F.col(bucket)])).withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int"))


def stratified_sample(rows: DataFrame, stratum: str, identifier: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows with quotas by largest remainder (ties: first stratum), in digest order within a stratum.

    Quotas come from one row per stratum; the sampled rows are the smallest digests, kept per task before they are shuffled.
    """
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    quota = counts.crossJoin(F.broadcast(total)).withColumn("exact", F.lit(size) * F.col("n") / F.col("all")).withColumn("base", F.floor("exact"))
    missing = quota.agg((F.lit(size) - F.sum("base")).alias("missing"))
    place = F.row_number().over(Window.orderBy((F.round(F.col("exact") - F.col("base"), 9)).desc(), F.col(stratum)))  # one row per stratum
    quota = quota.withColumn("place", place).crossJoin(F.broadcast(missing))
    quota = quota.select(F.col(stratum).alias("_s"), F.least(F.col("n"), F.col("base") + (F.col("place") <= F.col("missing")).cast("int")).alias("quota"))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(stratum), F.col(identifier).cast("string")).cast("binary"), 256)
    placed = rows.withColumn("place", _place(rows, [stratum], [digest, F.col(identifier)])).where(F.col("place") <= size)
    return placed.join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).where(F.col("place") <= F.col("quota")).drop("_s")


def first_by_id(rows: DataFrame, identifier: str, order: str) -> DataFrame:
    """The first record of each id."""
    names = [c for c in rows.columns if c != identifier]
    return rows.groupBy(identifier).agg(F.min_by(F.struct(*names), F.col(order)).alias("_r")).select(identifier, "_r.*")


def examples(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("place", _place(rows, by, order)).where(F.col("place") <= n)


def quota_by_reason(rows: DataFrame, identifier: str, reason: str, priority: str, quotas: dict[str, int], total: int) -> DataFrame:
    """Reasons in order take their quota of ids by priority, no id twice; what is missing comes from the rest by priority."""
    taken: DataFrame | None = None
    for name, quota in quotas.items():
        pool = rows.where(F.col(reason) == name)
        pool = pool if taken is None else pool.join(taken.select(identifier), identifier, "left_anti")
        step = pool.dropDuplicates([identifier]).orderBy(priority, identifier).limit(quota)
        taken = step if taken is None else taken.unionByName(step)
    if taken is None:
        return rows.orderBy(priority, identifier).limit(total)
    rest = rows.join(taken.select(identifier), identifier, "left_anti").dropDuplicates([identifier]).withColumn("_late", F.lit(1))
    return taken.withColumn("_late", F.lit(0)).unionByName(rest).orderBy("_late", priority, identifier).limit(total).drop("_late")


def clean_indices(indices: Column, n: Column) -> Column:
    """Distinct valid indices in order; an error where none is left."""
    kept = F.array_sort(F.array_distinct(F.filter(indices, lambda i: (i >= 0) & (i < n))))
    return F.when(F.size(kept) > 0, kept).otherwise(F.raise_error(F.lit("no valid index")).cast("array<int>"))


def saturation_ratio(rows: DataFrame, by: list[str], relevance: str, x: str, y: str, index: str = "idx", ratios: tuple[float, ...] = (0.3, 0.5, 0.7), mass: float = 0.72, cells: float = 0.75, temperature: float = 0.12, least: float = 0.02, side: int = 4, share: float = 0.5) -> DataFrame:
    """The smallest ratio whose grid-and-top rows hold enough softmax mass and lie in enough of the cells of at least ``least`` mass, else the largest."""
    w = Window.partitionBy(*by)
    e = F.exp((F.col(relevance) - F.max(relevance).over(w)) / temperature)
    line = lambda v: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(F.col(v) * side)))
    p = rows.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).withColumn("cell", line(y) * side + line(x)).withColumn("n", F.count(F.lit(1)).over(w))
    tried = p.withColumn("ratio", F.explode(F.array(*map(F.lit, sorted(ratios))))).withColumn("k", keep_count(F.col("n"), F.col("ratio")))
    kept = grid_places(tried, [*by, "ratio"], x, y, index, F.col("k"), relevance, share).withColumn("kept", F.col("place") <= F.col("k"))
    per_cell = kept.groupBy(*by, "ratio", "cell").agg(F.sum("p").alias("m"), F.sum(F.when(F.col("kept"), F.col("p")).otherwise(0.0)).alias("kept_mass"), F.max("kept").alias("seen"))
    active = F.col("m") >= least
    per_ratio = per_cell.groupBy(*by, "ratio").agg(F.sum("kept_mass").alias("mass"), F.when(F.count_if(active) > 0, F.count_if(active & F.col("seen")) / F.count_if(active)).otherwise(1.0).alias("covered"))
    passed = (F.col("mass") >= mass) & (F.col("covered") >= cells)
    return per_ratio.groupBy(*by).agg(F.coalesce(F.min(F.when(passed, F.col("ratio"))), F.lit(max(ratios))).alias("ratio"), F.max(F.when(F.col("ratio") == max(ratios), F.col("mass"))).alias("mass_at_largest"))
