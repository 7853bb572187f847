"""Counters, crosstabs, transitions and scope rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(counter, value, n, rate): counts of every value of several columns in one pass over unpivoted columns."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("<empty>")).alias("value")) for c in columns])).alias("e")).select("e.*")
    counts = long.groupBy("counter", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("counter")))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    """How many groups have each size."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def transitions(rows: DataFrame, before: str, after: str) -> DataFrame:
    counts = rows.groupBy(before, after).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select(before, after, "n", (F.col("n") / F.col("all")).alias("fraction"))


def outcomes(rows: DataFrame, left: Column, right: Column, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right & ~left).alias("wins"), F.count_if(left & ~right).alias("losses"), F.count_if(left & right).alias("both_right"), F.count_if(~left & ~right).alias("both_wrong")
    )


def scopes(rows: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """One ROLLUP: all, then each longer prefix of the keys; ``level`` tells how many keys are in force, others read "<all>"."""
    out = rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("<empty>")) for k in keys}).rollup(*keys).agg(*aggregates, F.grouping_id().alias("_g"))
    level = F.lit(len(keys)) - F.bit_count(F.col("_g"))
    return out.select(*[F.coalesce(k, F.lit("<all>")).alias(k) for k in keys], level.cast("int").alias("level"), *[c for c in out.columns if c not in (*keys, "_g")])


def flips(rows: DataFrame, before: Column, after: Column, delta: str) -> DataFrame:
    bucket = F.when(before & after, "both_yes").when(after, "new_yes").when(before, "new_no").otherwise("both_no")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(delta).alias("mean_delta"), F.percentile(delta, F.lit(0.5)).alias("median_delta"))


def pair_gap(rows: DataFrame, group: str, positive: Column, margin: str) -> DataFrame:
    """Margin of the positive minus that of the negative, for groups with one of each."""
    pairs = rows.groupBy(group).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"), (F.max(F.when(positive, F.col(margin))) - F.max(F.when(~positive, F.col(margin)))).alias("gap"))
    return pairs.where("p = 1 and q = 1").select(group, "gap", (F.col("gap") > 0).alias("win"))


def label_agreement(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Jaccard and F1 of the presence of labels in two label arrays."""
    common, only_a, only_b = F.size(F.array_intersect(a, b)), F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    out = rows.groupBy(*by).agg(F.sum(common).alias("shared"), F.sum(only_a).alias("only_a"), F.sum(only_b).alias("only_b"))
    union = F.col("shared") + F.col("only_a") + F.col("only_b")
    return out.select(*by, "shared", "only_a", "only_b", F.when(union > 0, F.col("shared") / union).otherwise(0.0).alias("jaccard"), F.when(union > 0, 2 * F.col("shared") / (union + F.col("shared"))).otherwise(0.0).alias("f1"))


def tercile_strata(rows: DataFrame, value: str, by: list[str], tie: list[str] | None = None) -> DataFrame:
    """"low", "middle", "high" by interpolated terciles; by rank where both cuts coincide, equal values by ``tie`` or all other columns."""
    tie = tie or [c for c in rows.columns if c not in (value, *by)]
    cuts = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_q"), F.count(F.lit(1)).alias("_n"))
    joined = rows.join(cuts, by)
    low, high = F.col("_q")[0], F.col("_q")[1]
    third = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(value, *tie)) - 1) * 3 / F.col("_n"))
    stratum = F.when(low < high, F.when(F.col(value) <= low, "low").when(F.col(value) <= high, "middle").otherwise("high")).otherwise(F.element_at(F.array(F.lit("low"), F.lit("middle"), F.lit("high")), third.cast("int") + 1))
    return joined.withColumn("stratum", stratum).drop("_q", "_n")


def trajectories(rows: DataFrame, key: str, budget: str, correct: Column, low: float, high: float) -> DataFrame:
    """Keys seen at both budgets by what became of them: kept right, repaired, broken or persistently wrong."""
    at = lambda b: F.max(F.when(F.col(budget) == b, correct.cast("int")))
    wide = rows.groupBy(key).agg(at(low).alias("_a"), at(high).alias("_b")).dropna(subset=["_a", "_b"])
    state = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "kept").when(F.col("_b") == 1, "repaired").when(F.col("_a") == 1, "broken").otherwise("persistent")
    return wide.select(key, state.alias("state"))


def conditional_means(rows: DataFrame, by: list[str], values: list[str], condition: Column) -> DataFrame:
    """Counts, and means over the rows that meet the condition; 0 where none does."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("n_condition"), *[F.coalesce(F.avg(F.when(condition, F.col(v))), F.lit(0.0)).alias(v) for v in values])
