"""Resampling inference with hashed weights.

A resample draws each cluster a Poisson(1) number of times, read off a number hashed from (seed, cluster) and the replicate. Draws need no cluster numbering, no random state and no
collection: a cluster is digested once, its replicates are compiled arithmetic, a replicate's sums are partial aggregates of each task, and a retry repeats the same draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.hashing import key_seeds, poisson_of, replicate_uniform

#: Replicates where nothing else is asked for.
DRAWS = 1000


def replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate")


def drawn(units: DataFrame, keys: dict[str, list], n: int, names: dict[str, str] | None = None) -> DataFrame:
    """``units`` once a replicate with the uniform number of each named key; a key is what is hashed, from the seed on."""
    kept = units.columns
    for name, parts in keys.items():
        a, b = key_seeds(*parts)
        units = units.withColumns({f"_a_{name}": a, f"_b_{name}": b})
    units = units.select("*", replicates(n))
    return units.select(*kept, "replicate", *[replicate_uniform(F.col(f"_a_{k}"), F.col(f"_b_{k}"), F.col("replicate")).alias(k) for k in keys])


def weighted(units: DataFrame, cluster: str, n: int, seed: int) -> DataFrame:
    """``units`` once a replicate, with the number of times w that it draws their cluster; w may be 0, as a filter would make the number anew."""
    return drawn(units, {"_u": [seed, F.col(cluster)]}, n).withColumn("w", poisson_of(F.col("_u"))).drop("_u")


def weighted_mean() -> Column:
    """The mean of value by w; null where nothing is drawn."""
    return F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w").cast("double")).alias("mean")


def cluster_means(rows: DataFrame, cluster: str, value: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, cluster).agg(F.avg(value).alias("value"))


def percentiles(value: str, low: float = 0.025, high: float = 0.975) -> list[Column]:
    return [F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high")]


def spread(point: DataFrame, draws: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A point estimate with the percentiles of its draws, a row a replicate."""
    ends = draws.groupBy(*by).agg(*percentiles(value))
    return point.join(ends, by) if by else point.crossJoin(F.broadcast(ends))  # without keys each side is one row


def bootstrap_mean(rows: DataFrame, cluster: str, value: str, by: list[str], n: int = DRAWS, seed: int = 0) -> DataFrame:
    """Mean over clusters of their means, with a percentile interval over resampled clusters."""
    means = cluster_means(rows, cluster, value, by)
    draws = weighted(means, cluster, n, seed).groupBy(*by, "replicate").agg(weighted_mean()).where("mean is not null")
    return spread(means.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), F.avg("value").alias("mean")), draws, "mean", by)


def two_stage_bootstrap(rows: DataFrame, first: str, second: str, value: str, n: int = DRAWS, seed: int = 0) -> DataFrame:
    """Both keys are drawn independently; a cell weighs the product."""
    cells = rows.groupBy(first, second).agg(F.avg(value).alias("value"))
    both = drawn(cells, {"u": [seed, "first", F.col(first)], "v": [seed, "second", F.col(second)]}, n).withColumn("w", poisson_of(F.col("u")) * poisson_of(F.col("v")))
    draws = both.groupBy("replicate").agg(weighted_mean()).where("mean is not null")
    return draws.agg(F.count(F.lit(1)).alias("draws"), *percentiles("mean"))


def sign_flip(rows: DataFrame, unit: str, difference: str, by: list[str], n: int = DRAWS, seed: int = 0) -> DataFrame:
    """Two-sided permutation p: (flipped means at least as far from 0 + 1) / (n + 1)."""
    point = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(difference).alias("mean"))
    signed = drawn(rows.where(F.col(difference) != 0).select(*by, unit, difference), {"u": [seed, F.col(unit)]}, n)
    flips = signed.groupBy(*by, "replicate").agg(F.sum(F.when(F.col("u") < 0.5, F.col(difference)).otherwise(-F.col(difference))).alias("total"))
    far = F.abs(F.col("total") / F.col("n")) >= F.abs(F.col("mean")) - 1e-12
    joined = flips.join(point, by) if by else flips.crossJoin(F.broadcast(point))  # without keys point is one row
    counts = joined.groupBy(*by).agg(F.count_if(far).alias("exceed"))
    out = point.join(counts, by, "left") if by else point.crossJoin(F.broadcast(counts))
    return out.select(*by, "n", "mean", ((F.coalesce("exceed", F.lit(n)) + 1) / F.lit(n + 1)).alias("p"))


def kappa_of(cells: DataFrame, a: str, b: str, by: list[str], n: Column) -> DataFrame:
    """Cohen's kappa of weighted label pairs; 1 or 0 where chance agreement is 1."""
    cells = cells.groupBy(*by, a, b).agg(F.sum(n).alias("_n"))
    left = cells.groupBy(*by, F.col(a).alias("_label")).agg(F.sum("_n").alias("_x"))
    right = cells.groupBy(*by, F.col(b).alias("_label")).agg(F.sum("_n").alias("_y"))
    chance = left.join(right, [*by, "_label"]).groupBy(*by).agg(F.sum(F.col("_x").cast("double") * F.col("_y")).alias("_e"))
    seen = cells.groupBy(*by).agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col(a) == F.col(b), F.col("_n")).otherwise(0)).alias("_same"))
    n = F.when(F.col("_n") > 0, F.col("_n").cast("double"))  # a replicate may draw nothing
    po, pe = F.col("_same") / n, F.coalesce("_e", F.lit(0.0)) / (n * n)
    kappa = F.when(F.abs(1 - pe) < 1e-12, F.when(po >= 1 - 1e-12, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return seen.join(chance, by, "left").select(*by, kappa.alias("kappa"))


def bootstrap_kappa(rows: DataFrame, cluster: str, a: str, b: str, n: int = DRAWS, seed: int = 0) -> DataFrame:
    """Cohen's kappa with a percentile interval over resampled clusters; rows without either label don't count."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(cluster, a, b).agg(F.count(F.lit(1)).alias("m"))
    point = kappa_of(cells.withColumn("_one", F.lit(1)), a, b, ["_one"], F.col("m")).select("kappa")
    draws = kappa_of(weighted(cells, cluster, n, seed), a, b, ["replicate"], F.col("m") * F.col("w"))
    return spread(point, draws, "kappa", [])


def bootstrap_correlation(rows: DataFrame, cluster: str, x: str, y: str, n: int = DRAWS, seed: int = 0) -> DataFrame:
    """Pearson correlation with a percentile interval over resampled clusters; draws without variation don't count."""
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    some = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    parts = {"m": F.lit(1.0), "x": u, "y": v, "xx": u * u, "yy": v * v, "xy": u * v}
    cells = some.groupBy(cluster).agg(*[F.sum(c).alias(f"_{k}") for k, c in parts.items()])
    draws = weighted(cells, cluster, n, seed).groupBy("replicate").agg(*[F.sum(F.col("w") * F.col(f"_{k}")).alias(k) for k in parts])
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / F.col("m"), F.col("yy") - F.col("y") * F.col("y") / F.col("m")
    draws = draws.where("m > 0").where((vx > 1e-12) & (vy > 1e-12)).select(((F.col("xy") - F.col("x") * F.col("y") / F.col("m")) / F.sqrt(vx * vy)).alias("r"))
    return spread(some.agg(F.corr(u, v).alias("r")), draws, "r", [])


def bootstrap_p(draws: DataFrame, value: str, by: list[str]) -> DataFrame:
    below, above = F.avg((F.col(value) <= 0).cast("double")), F.avg((F.col(value) >= 0).cast("double"))
    return draws.groupBy(*by).agg(F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"))


def paired_summary(rows: DataFrame, difference: str, by: list[str], tie: float = 1e-12) -> DataFrame:
    d = F.col(difference)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_difference"), F.count_if(d > tie).alias("wins"), F.count_if(d < -tie).alias("losses"), F.count_if(F.abs(d) <= tie).alias("ties")
    )
