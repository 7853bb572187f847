"""Rank, selective-risk, threshold, agreement and calibration metrics, grouped by any keys.

Metrics that order rows do so by buckets (:mod:`evalweave.operators.ordered`), others sum equal scores first; no task sees a whole group. ``by`` may be empty for one overall row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import maths
from evalweave.operators.ordered import ordered_ranks, running

TINY = 1e-12


def _window(by: list[str]):
    return Window.partitionBy(*by)


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def auc(rows: DataFrame, score: str, label: str, by: list[str], one_class: float = 0.5) -> DataFrame:
    """ROC AUC with ties at half; ``one_class`` where only one class occurs. Equal scores are summed before the running count."""
    points = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    points = running(points, by, score, [], {"_upto": F.col("q")})
    points = points.withColumn("wins", F.col("p") * (F.col("_upto") - F.col("q") / 2.0))
    out = points.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum("wins").alias("wins"))
    value = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("wins") / (F.col("positives") * F.col("negatives"))).otherwise(one_class)
    return out.select(*by, "positives", "negatives", value.alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str, order: str, by: list[str]) -> DataFrame:
    ranked = running(rows.select(*by, score, label, order), by, score, [F.col(order)], {"hits": F.col(label).cast("long")}, descending=True)
    return ranked.groupBy(*by).agg(mean_or_zero(F.when(F.col(label).cast("int") == 1, F.col("hits") / F.col("rn"))).alias("ap"))


def ranked_errors(rows: DataFrame, risk: str, error: str, order: str, by: list[str]) -> DataFrame:
    """Rows with their place by ascending risk and the running error before and with them."""
    return running(rows, by, risk, [F.col(order)], {"cum": F.col(error).cast("double")})


def aurc(rows: DataFrame, risk: str, error: str, order: str, by: list[str]) -> DataFrame:
    ranked = ranked_errors(rows, risk, error, order, by)
    return ranked.groupBy(*by).agg(F.avg(F.col("cum") / F.col("rn")).alias("aurc"))


def accepted(n: Column, coverage: Column) -> Column:
    """Rows that a coverage accepts: the ceiling, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.round(n * coverage, 9))).cast("int")


def coverage_curve(rows: DataFrame, risk: str, error: str, order: str, by: list[str], grid: list[float]) -> DataFrame:
    """Mean error of the lowest-risk rows at each coverage."""
    ranked = ranked_errors(rows, risk, error, order, by)
    points = F.filter(F.array(*map(F.lit, grid)), lambda c: accepted(F.col("n"), c) == F.col("rn"))
    return ranked.select(*by, "n", "rn", "cum", F.explode(points).alias("coverage")).select(*by, "coverage", F.col("rn").alias("accepted"), (F.col("cum") / F.col("rn")).alias("error"))


def selective_rate(rows: DataFrame, risk: str, event: str, eligible: Column, order: str, by: list[str], coverage: float) -> DataFrame:
    """Mean of ``event`` among the eligible of the accepted rows; 0 where none is eligible."""
    ranked = ranked_errors(rows, risk, event, order, by).where(F.col("rn") <= accepted(F.col("n"), F.lit(coverage)))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("accepted"), mean_or_zero(F.when(eligible, F.col(event).cast("double"))).alias("rate"))


def confusion(predicted: Column, target: Column) -> list[Column]:
    """Accuracy, false-positive rate, positive and negative accuracy, yes rate; 0 where nothing counts."""
    count = lambda c: F.count_if(c)
    every = F.count(F.lit(1))
    return [
        ratio(count(predicted == target), every).alias("accuracy"),
        ratio(count(predicted & ~target), count(~target)).alias("hfpr"),
        ratio(count(predicted & target), count(target)).alias("positive_accuracy"),
        ratio(count(~predicted & ~target), count(~target)).alias("negative_accuracy"),
        ratio(count(predicted), every).alias("yes_rate"),
    ]


def best_threshold(rows: DataFrame, margin: str, target: str, by: list[str]) -> DataFrame:
    """The threshold (a midpoint of neighbouring margins, or one step outside) with the best (accuracy, -false-positive rate, -|yes rate - 1/2|), the smallest among equals.

    Equal margins are summed first; running sums then give every threshold at once.
    """
    points = rows.groupBy(*by, margin).agg(F.count_if(F.col(target)).alias("p"), F.count_if(~F.col(target)).alias("q"))
    up = _window(by).orderBy(margin)
    points = points.withColumn("all_p", F.sum("p").over(_window(by))).withColumn("all_q", F.sum("q").over(_window(by)))
    before = lambda c: F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    points = points.withColumn("pb", before("p")).withColumn("qb", before("q")).withColumn("lag", F.lag(margin).over(up)).withColumn("last", F.lead(margin).over(up).isNull())
    at = F.struct(F.coalesce((F.col(margin) + F.col("lag")) / 2, F.col(margin) - 1.0).alias("t"), F.col("pb").alias("fn"), F.col("qb").alias("tn"))
    end = F.struct((F.col(margin) + 1.0).alias("t"), F.col("all_p").alias("fn"), F.col("all_q").alias("tn"))
    cuts = points.select(*by, "all_p", "all_q", F.explode(F.when(F.col("last"), F.array(at, end)).otherwise(F.array(at))).alias("c")).select(*by, "all_p", "all_q", "c.*")
    n = F.col("all_p") + F.col("all_q")
    cuts = cuts.withColumn("accuracy", (F.col("all_p") - F.col("fn") + F.col("tn")) / n).withColumn("hfpr", ratio(F.col("all_q") - F.col("tn"), F.col("all_q"))).withColumn("yes_rate", (n - F.col("fn") - F.col("tn")) / n)
    key = F.struct(F.col("accuracy"), -F.col("hfpr"), -F.abs(F.col("yes_rate") - 0.5), -F.col("t"))
    return cuts.groupBy(*by).agg(F.max_by(F.struct("t", "accuracy", "hfpr", "yes_rate"), key).alias("b")).select(*by, F.col("b.t").alias("threshold"), "b.accuracy", "b.hfpr", "b.yes_rate")


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs; terms in log space, so thousands of pairs do not overflow."""
    n, k = b + c, F.least(b, c)
    first = -n * F.lit(0.6931471805599453)
    step = lambda a, i: F.struct((a["t"] + F.ln((n - i + 1) / i)).alias("t"), (a["s"] + F.exp(a["t"] + F.ln((n - i + 1) / i))).alias("s"))
    start = F.struct(first.cast("double").alias("t"), F.exp(first.cast("double")).alias("s"))
    tail = F.aggregate(F.when(k >= 1, F.transform(F.sequence(F.lit(1).cast("long"), k.cast("long")), lambda i: i.cast("double"))).otherwise(F.array().cast("array<double>")), start, step)["s"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(rows: DataFrame, left: Column, right: Column, by: list[str]) -> DataFrame:
    counts = rows.groupBy(*by).agg(F.count_if(left & ~right).alias("left_only"), F.count_if(right & ~left).alias("right_only"), F.count_if(left & right).alias("both"), F.count_if(~left & ~right).alias("neither"))
    return counts.withColumn("p", mcnemar_p(F.col("left_only"), F.col("right_only")))


def cohen_kappa(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Agreement beyond chance; when chance agreement is 1 it is 1 or 0. Only counts of label pairs are shuffled on."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    left = cells.groupBy(*by, F.col(a).alias("label")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*by, F.col(b).alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("products"))
    seen = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agree"))
    both = seen.join(chance, by, "left") if by else seen.crossJoin(chance)
    po, pe = F.col("agree") / F.col("n"), F.coalesce("products", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(F.abs(1 - pe) < TINY, F.when(po >= 1 - TINY, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return both.select(*by, "n", po.alias("observed"), pe.alias("expected"), kappa.alias("kappa"))


def ece(rows: DataFrame, confidence: str, correct: str, by: list[str], bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins, the last one closed."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    binned = rows.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return binned.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def brier_nll(rows: DataFrame, confidence: str, correct: str, by: list[str]) -> DataFrame:
    p, y = F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), F.col(confidence))), F.col(correct).cast("double")
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col(confidence) - y, 2)).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("nll"), F.avg(confidence).alias("mean_confidence"))


def wilson_rates(rows: DataFrame, event: Column, by: list[str]) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count_if(event).alias("successes"), F.count(F.lit(1)).alias("n"))
    low, high = maths.wilson(F.col("successes"), F.col("n"))
    return out.select(*by, "successes", "n", (F.col("successes") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def pearson(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """NaN with fewer than two usable rows or without variation."""
    fine = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    return fine.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.corr(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(float("nan"))).alias("r"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = ordered_ranks(ranked, by, {x: "_rx", y: "_ry"})
    return pearson(ranked, "_rx", "_ry", by)


def partial_of(table: DataFrame, keep: list[str], value: dict[tuple[int, int], Column], m: int) -> DataFrame:
    """``keep`` and r, the partial correlation of columns 0 and 1 given columns 2 to m - 1, from the correlations of all pairs, by recursion over the controls; a control without variation has null correlations and drops out."""
    name = lambda i, j: f"_c{min(i, j)}_{max(i, j)}"
    table = table.select(*keep, *[c.alias(name(*ij)) for ij, c in value.items()])
    for z in range(2, m):
        r = lambda i, j: F.col(name(i, j))
        left_over = lambda i, j: F.greatest(F.lit(0.0), 1 - r(i, j) * r(i, j))  # null in the end where a control says everything
        left = [(i, j) for i in range(m) for j in range(i + 1, m) if z not in (i, j) and (i < 2 or i > z) and (j < 2 or j > z)]
        table = table.select(*keep, *[F.when(r(i, z).isNull() | r(j, z).isNull(), r(i, j)).when(left_over(i, z) * left_over(j, z) > 1e-18, (r(i, j) - r(i, z) * r(j, z)) / F.sqrt(left_over(i, z) * left_over(j, z))).alias(name(i, j)) for i, j in left])
    return table.select(*keep, F.col(name(0, 1)).alias("r"))


def partial_spearman(rows: DataFrame, x: str, y: str, controls: list[str], by: list[str]) -> DataFrame:
    """Correlation of the ranks of x and y after least squares on the ranks of the controls; NaN with fewer than five rows.

    Correlations are sums, so one aggregate gives the matrix, and the partial correlation follows from it.
    """
    names = [x, y, *controls]
    ranked = rows.where(" and ".join(f"`{n}` is not null" for n in names)).select(*by, *names)
    ranked = ordered_ranks(ranked, by, {name: f"_r{i}" for i, name in enumerate(names)})
    m = len(names)
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.corr(f"_r{i}", f"_r{j}").alias(f"c{i}_{j}") for i in range(m) for j in range(i + 1, m)])
    found = partial_of(out, [*by, "n"], {(i, j): F.col(f"c{i}_{j}") for i in range(m) for j in range(i + 1, m)}, m)
    return found.withColumn("r", F.when(F.col("n") >= 5, F.coalesce("r", F.lit(float("nan")))).otherwise(float("nan")))


def fixed_effect_residuals(rows: DataFrame, x: str, y: str, first: str, second: str) -> DataFrame:
    """first, _x, _y: the ranks of x and y without the ranks' means over either key; ranks from counted values, means by aggregates, which join back."""
    rows = ordered_ranks(rows.select(first, second, x, y), [], {x: "_rx", y: "_ry"}).select(first, second, F.col("_rx").alias(x), F.col("_ry").alias(y))
    means = lambda key, tag: rows.groupBy(key).agg(F.avg(x).alias(f"x{tag}"), F.avg(y).alias(f"y{tag}"))
    grand = rows.agg(F.avg(x).alias("x0"), F.avg(y).alias("y0"))
    flat = rows.join(means(first, 1), first).join(means(second, 2), second).crossJoin(F.broadcast(grand))  # grand is one row
    return flat.select(first, *[(F.col(v) - F.col(f"{t}1") - F.col(f"{t}2") + F.col(f"{t}0")).alias(f"_{t}") for v, t in ((x, "x"), (y, "y"))])


def fixed_effect_correlation(rows: DataFrame, x: str, y: str, first: str, second: str) -> DataFrame:
    """Correlation of the ranks of x and y without the ranks' means over either key."""
    return pearson(fixed_effect_residuals(rows, x, y, first, second), "_x", "_y", [])


def metric_table(rows: DataFrame, risks: list[str], error: str, order: str, by: list[str]) -> DataFrame:
    """AUC and AURC of every risk column in long form: one plan over unpivoted risks."""
    long = rows.unpivot([*by, error, order], risks, "risk", "value")
    return auc(long, "value", error, [*by, "risk"]).join(aurc(long, "value", error, order, [*by, "risk"]), [*by, "risk"])


def screen_features(rows: DataFrame, features: list[str], label: str, by: list[str], top: int = 3) -> DataFrame:
    """The ``top`` features by direction-free AUC in each group."""
    scored = auc(rows.unpivot([*by, label], features, "feature", "value"), "value", label, [*by, "feature"])
    scored = scored.withColumn("strength", F.greatest("auc", 1 - F.col("auc")))
    place = F.row_number().over(_window(by).orderBy(F.desc("strength"), "feature"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select(*by, "feature", "auc", "strength", "place")


def tail_rate(rows: DataFrame, score: str, label: str, order: str, by: list[str], fraction: float, top: bool = True) -> DataFrame:
    """Mean label of the highest (lowest) fraction of the scores, at least one row; the size rounds half to even."""
    ranked = running(rows.select(*by, score, label, order), by, score, [F.col(order)], {}, descending=top)
    kept = ranked.where(F.col("rn") <= F.greatest(F.lit(1), F.bround(F.col("n") * fraction)))
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("tail"), F.avg(F.col(label).cast("double")).alias("rate"))


def linear_quantiles(rows: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """One row: _cuts, the distinct linear quantiles of a column in ascending order. Equal values are counted first; each counted value knows which of the wanted places it covers."""
    points = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    ranked = running(points, [], "_v", [], {"_upto": F.col("_m")})
    whole = points.agg(F.sum("_m").alias("_size"))
    at = lambda place: (F.col("_upto") - F.col("_m") <= place) & (place < F.col("_upto"))
    found = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_size") - 1) * q).alias("place")) for i, q in enumerate(qs)])
    ends = F.flatten(F.transform(found, lambda w: F.array(F.struct(w["i"].alias("i"), (F.ceil(w["place"]) - w["place"]).alias("low"), F.floor(w["place"]).alias("p")), F.struct(w["i"].alias("i"), F.lit(None).cast("double").alias("low"), F.ceil(w["place"]).alias("p")))))
    parts = ranked.crossJoin(F.broadcast(whole)).select("_v", F.inline(F.filter(ends, lambda e: at(e["p"]))))  # whole is one row
    low, high = F.max(F.when(F.col("low").isNotNull(), F.col("_v"))), F.max(F.when(F.col("low").isNull(), F.col("_v")))
    share = F.max("low")  # of the lower value; 0 where the place is whole, and both values are one
    each = parts.groupBy("i").agg((high + (low - high) * share).alias("q"))
    return each.agg(F.sort_array(F.collect_set("q")).alias("_cuts"))


def quantiles(rows: DataFrame, value: str, by: list[str], q: float) -> DataFrame:
    """The four definitions in use: linear, sorted[int(q n)], sorted[int(q (n - 1))], sorted[round-half-even(q (n - 1))].

    Equal values are counted first; the values that cover the wanted places leave the groups.
    """
    points = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_m"))
    ranked = running(points, by, value, [], {"_upto": F.col("_m")})
    whole = ranked.groupBy(*by).agg(F.max("_upto").alias("_size")).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_size")  # a row a group
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    ranked = ranked.join(whole, same) if by else ranked.crossJoin(F.broadcast(whole))
    n, at = F.col("_size"), lambda i: F.max(F.when((F.col("_upto") - F.col("_m") <= i) & (i < F.col("_upto")), F.col(value)))
    place = (n - 1) * q
    low, high = at(F.floor(place)), at(F.ceil(place))
    return ranked.groupBy(*by).agg(
        (low + (high - low) * F.max(place - F.floor(place))).alias("linear"), at(F.least(n - 1, F.floor(n * q))).alias("truncated"), at(F.floor((n - 1) * q)).alias("truncated_inner"), at(F.bround((n - 1) * q)).alias("nearest")
    )


def seed_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_pop(value).alias("sd"))


def risk_table(rows: DataFrame, risks: list[str], error: str, order: str, by: list[str]) -> DataFrame:
    """The risk of least AURC in each group, ties to the first name, with its metrics."""
    table = metric_table(rows, risks, error, order, by)
    place = F.row_number().over(_window(by).orderBy(F.round("aurc", 12), "risk"))
    return table.withColumn("place", place).where("place = 1").drop("place")
