"""Budget policies: grids on a development split, feasibility, cheapest budgets, Pareto fronts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.functions.maths import finite, sigmoid, upper_bound
from evalweave.operators.metrics import ratio
from evalweave.operators.ordered import places_below, running


def three_way(risk: Column, low: Column, high: Column, budgets: tuple[float, float, float]) -> Column:
    base, mid, top = budgets
    return F.when(risk >= high, top).when(risk >= low, mid).otherwise(base)


#: Weights of the objective's terms after accuracy, and the false-positive rate that costs nothing.
WEIGHTS = {"hfpr": 1.0, "keep": 0.1, "cascade": 0.0, "ecr": 0.0}
TARGET = 0.2


def policy_sweep(rows: DataFrame, cuts: DataFrame, chains: list[tuple[float, float, float]], split: str, risk: str, budget: str, correct: Column, false_positive: Column, eligible: Column, ecr: Column | None = None, weights: dict[str, float] = WEIGHTS, target: float = TARGET) -> DataFrame:
    """Every policy (base, mid, high, lo, hi) on every split: n, accuracy, hfpr, keep, cascade, ecr, mid_rate, high_rate, objective, and whether it is the one chosen by the "dev" split's objective.

    A policy gives a sample the high budget where its risk reaches hi, the mid budget where it reaches lo, else the base; thresholds are all pairs lo <= hi of ``cuts`` (one row with the sorted array _cuts), budgets the ``chains``.
    ``rows`` has a row per sample and budget. Rows are summed once by split, budget and the number of cuts that their risk reaches; a policy is three stretches of the running sums of that small table, so that no row meets a policy and a grid may be of any size.
    Objective: accuracy - hfpr weight * max(0, hfpr - target) - keep weight * keep - cascade weight * cascade + ecr weight * ecr; the first policy in order among equals (to nine digits). A cascade pays the base, and the budget where it goes beyond.
    """
    sums = {"n": F.lit(1), "c": correct.cast("int"), "f": (false_positive & eligible).cast("int"), "g": eligible.cast("int"), "e": finite(ecr) if ecr is not None else F.lit(0.0)}
    flat = rows.select(F.col(split).alias("split"), F.col(budget).cast("double").alias("budget"), F.col(risk).cast("double").alias("_risk"), *[v.alias(f"_{k}") for k, v in sums.items()]).crossJoin(F.broadcast(cuts))  # cuts is one row
    cells = flat.groupBy("split", "budget", places_below("_cuts", F.col("_risk"), equal=True).alias("at")).agg(*[F.sum(f"_{k}").alias(k) for k in sums], F.max(F.size("_cuts")).alias("_t"))
    grid = cells.groupBy("split", "budget").agg(F.max("_t").alias("_t")).select("split", "budget", F.explode(F.sequence(F.lit(0), F.col("_t"))).alias("at"))
    below = Window.partitionBy("split", "budget").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = grid.join(cells.drop("_t"), ["split", "budget", "at"], "left").select("split", "budget", "at", F.struct(*[F.coalesce(F.sum(k).over(below), F.lit(0)).alias(k) for k in sums]).alias("s"))  # a row a split, budget and cut
    whole = upto.groupBy("split", "budget").agg(F.max_by("s", "at").alias("s"))
    spark = rows.sparkSession
    chosen = spark.createDataFrame([tuple(map(float, c)) for c in chains], "base double, mid double, high double")
    places = cuts.select(F.posexplode("_cuts").alias("i", "lo"), "_cuts").select("i", "lo", F.posexplode("_cuts").alias("j", "hi")).where("i <= j")
    out = places.crossJoin(F.broadcast(chosen)).crossJoin(F.broadcast(cells.select("split").distinct()))  # literal tables
    for name, which, place in (("b", "base", "i"), ("ml", "mid", "i"), ("mh", "mid", "j"), ("h", "high", "j")):
        side = upto.select("split", F.col("budget").alias(which), F.col("at").alias(place), F.col("s").alias(f"_{name}"))
        out = out.join(F.broadcast(side), ["split", which, place])  # a row a split, budget and cut
    out = out.join(F.broadcast(whole.select("split", F.col("budget").alias("high"), F.col("s").alias("_w"))), ["split", "high"])
    part = {"base": lambda k: F.col(f"_b.{k}"), "mid": lambda k: F.col(f"_mh.{k}") - F.col(f"_ml.{k}"), "high": lambda k: F.col(f"_w.{k}") - F.col(f"_h.{k}")}
    total = lambda k: part["base"](k) + part["mid"](k) + part["high"](k)
    n = total("n")
    paid = lambda c: F.col("base") + F.when(c > F.col("base"), c).otherwise(0.0)
    mean = lambda value: sum((part[b]("n") * value(F.col(b)) for b in ("mid", "high")), part["base"]("n") * value(F.col("base"))) / n
    out = out.select(
        "base", "mid", "high", "lo", "hi", "split", n.alias("n"), (total("c") / n).alias("accuracy"), ratio(total("f"), total("g")).alias("hfpr"), mean(lambda c: c).alias("keep"), mean(paid).alias("cascade"), (total("e") / n).alias("ecr"),
        (part["mid"]("n") / n).alias("mid_rate"), (part["high"]("n") / n).alias("high_rate"),
    )
    w = WEIGHTS | weights
    out = out.withColumn("objective", F.col("accuracy") - w["hfpr"] * F.greatest(F.lit(0.0), F.col("hfpr") - target) - w["keep"] * F.col("keep") - w["cascade"] * F.col("cascade") + w["ecr"] * F.col("ecr"))
    keys = ["base", "mid", "high", "lo", "hi"]
    best = out.where("split = 'dev'").agg(F.min_by(F.struct(*keys), F.struct((-F.round("objective", 9)).alias("o"), *keys)).alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.coalesce(F.struct(*keys) == F.col("best"), F.lit(False))).drop("best")  # best is one row


def fixed_cuts(spark: SparkSession, values: list[float]) -> DataFrame:
    """Cuts that are given, as :func:`policy_sweep` reads them."""
    return spark.createDataFrame([(sorted(set(map(float, values))),)], "_cuts array<double>")


def conformal_selection(rows: DataFrame, task: str, split: str, risk: str, low_score: str, high_score: str, epsilons: list[float], low: float = 0.30, high: float = 0.70) -> DataFrame:
    """For each task and epsilon the threshold of least serial cost whose loss on the "dev" split is at most epsilon by its 95 % upper bound, and what it gives on the "test" split.

    Samples whose risk reaches the threshold pay a second pass at the high budget; the others lose max(0, high score - low score). Every dev risk is a candidate, as is a threshold above all of them; losses and their squares are running sums over counted
    risks, so that every candidate is judged exactly without meeting a row. A candidate costs less than the high budget or isn't feasible; without a feasible one the cheaper ones, or all where none is cheaper, go by (bound, cost).
    """
    loss = F.greatest(F.lit(0.0), F.col(high_score) - F.col(low_score))
    flat = rows.select(F.col(task).alias("task"), F.col(split).alias("split"), F.col(risk).cast("double").alias("r"), F.col(low_score).cast("double").alias("a"), F.col(high_score).cast("double").alias("b"), loss.cast("double").alias("l"))
    dev = flat.where("split = 'dev'")
    sums = {"n": F.lit(1), "l": F.col("l"), "ll": F.col("l") * F.col("l"), "a": F.col("a"), "b": F.col("b")}
    points = dev.groupBy("task", "r").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    below = running(points, ["task"], "r", [], {f"u{k}": F.col(f"_{k}") for k in sums})
    whole = points.groupBy("task").agg(*[F.sum(f"_{k}").alias(f"w{k}") for k in sums], F.max("r").alias("top"))
    before = below.select("task", F.col("r").alias("t"), *[(F.col(f"u{k}") - F.col(f"_{k}")).alias(k) for k in sums])
    above = whole.select("task", (F.col("top") + 1.0).alias("t"), *[F.col(f"w{k}").alias(k) for k in sums])
    cand = before.unionByName(above).join(whole, "task")
    n = F.col("wn")
    mean = F.col("l") / n
    rate = (n - F.col("n")) / n
    # what is left of sums that cancel is no variance
    spread = F.when(F.col("ll") - F.col("l") * mean > 1e-13 * F.col("ll"), F.col("ll") - F.col("l") * mean).otherwise(0.0)
    cand = cand.select("task", "t", upper_bound(mean, spread / F.greatest(F.lit(1), n - 1), n).alias("upper"), (F.lit(low) + F.lit(high) * rate).alias("cost"), ((F.col("a") + F.col("wb") - F.col("b")) / n).alias("score"))
    eps = F.explode(F.array(*map(F.lit, epsilons))).alias("epsilon")
    r9 = lambda c: F.round(c, 9)
    cheap = r9("cost") < high
    cand = cand.select("*", eps).withColumn("kind", F.when((r9("upper") <= F.col("epsilon")) & cheap, 0).when(cheap, 1).otherwise(2))
    order = F.when(F.col("kind") == 0, F.struct(r9("cost").alias("x"), (-r9("score")).alias("y"))).otherwise(F.struct(r9("upper").alias("x"), r9("cost").alias("y")))
    picked = cand.groupBy("task", "epsilon").agg(F.min_by(F.struct("t", "upper", "cost", "kind"), F.struct("kind", order.alias("o"), "t")).alias("p")).select("task", "epsilon", F.col("p.t").alias("threshold"), F.col("p.upper").alias("dev_upper"), F.col("p.cost").alias("dev_cost"), (F.col("p.kind") == 0).alias("feasible"))
    test = flat.where("split = 'test'").join(picked.select("task", "epsilon", "threshold"), "task")  # a row an epsilon
    over = F.col("r") >= F.col("threshold")
    test = test.groupBy("task", "epsilon").agg(F.count(F.lit(1)).alias("test_n"), F.avg(F.when(over, F.col("b")).otherwise(F.col("a"))).alias("test_score"), F.avg("b").alias("test_high_score"), F.avg(over.cast("double")).alias("test_fallback_rate"))
    out = picked.join(test, ["task", "epsilon"], "left").na.fill(0, ["test_n"]).na.fill(0.0, ["test_score", "test_high_score", "test_fallback_rate"])
    cost = F.when(F.col("test_n") > 0, F.lit(low) + F.lit(high) * F.col("test_fallback_rate")).otherwise(0.0)
    go = F.col("feasible") & (r9("test_score") >= r9(F.col("test_high_score") - F.col("epsilon"))) & (r9(cost) < high)
    return out.withColumn("test_cost", cost).withColumn("go", go)


def cheapest(rows: DataFrame, by: list[str], budget: str, score: str, full: str, tolerance: float = 0.0, default: float = 1.0) -> DataFrame:
    """The smallest budget whose score is within the tolerance of the full one."""
    good = F.col(score) + 1e-12 >= F.col(full) - tolerance
    return rows.groupBy(*by).agg(F.coalesce(F.min(F.when(good, F.col(budget))), F.lit(default)).alias("budget"))


def upper_bounds(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("v"))
    return out.select(*by, "n", "mean", upper_bound(F.col("mean"), F.col("v"), F.col("n")).alias("upper"))


def feasible_or_relaxed(rows: DataFrame, feasible: Column, cost: str, error: str, keys: list[str]) -> DataFrame:
    """The cheapest feasible candidate; without one the candidate of least error."""
    order = lambda late, first, then: F.struct(F.lit(late).alias("late"), F.col(first).alias("first"), F.col(then).alias("then"))
    key = F.when(feasible, order(0, cost, error)).otherwise(order(1, error, cost))
    return rows.agg(F.min_by(F.struct(*keys, cost, error), key).alias("b"), F.max(feasible.cast("int")).alias("f")).select("b.*", (F.col("f") == 1).alias("feasible"))


def skyline(rows: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """Rows that no other of the group beats: none has low <= and high >= with one of them strict.

    Ordered by (low, high descending), a row is on the front when its high is above all before it, or equals the front row that it repeats: a running maximum
    over distinct points, in place of a theta self-join.
    """
    points = rows.select(*by, low, high).distinct()
    w = Window.partitionBy(*by).orderBy(F.col(low), F.col(high).desc()).rowsBetween(Window.unboundedPreceding, -1)
    front = points.withColumn("_best", F.max(high).over(w)).where(F.col("_best").isNull() | (F.col(high) > F.col("_best"))).drop("_best")
    return rows.join(front, [*by, low, high], "left_semi")


def stable_answer(first: Column, second: Column, fallback: Column) -> Column:
    """Two budgets that agree settle the answer, else the fallback does."""
    return F.when(first.eqNullSafe(second), first).otherwise(fallback)


def worst_gap(rows: DataFrame, policy: str, passed: Column, gap: str) -> DataFrame:
    """Policies by: passes everywhere, then largest worst gap, then name."""
    out = rows.groupBy(policy).agg(F.every(passed).alias("feasible"), F.avg(gap).alias("mean_gap"), F.min(gap).alias("worst_gap"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("feasible"), F.desc("worst_gap"), policy)))  # one row per policy


def logistic_newton(rows: DataFrame, features: list[str], label: str, l2: float = 0.01, balanced: bool = False, most: int = 15, close: float = 1e-7) -> dict[str, float]:
    """Weights on z-scored features and "bias" that minimise the mean log loss plus l2 / 2 times the squared weights (the bias is free), where plain descent ends after many steps.

    Newton's method: one aggregate of the gradient and the Hessian a step, whose few numbers are solved on the driver; each step at most halves until the loss falls. A feature without variation has weight 0; ``balanced`` weighs both classes alike. With one class only the bias has no end: an error.
    """
    k = len(features)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("share"), *[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    share = stats["share"]
    if not stats["n"] or not 0 < share < 1:
        raise ValueError("logistic regression needs both classes")
    sd = [stats[f"s{i}"] if stats[f"s{i}"] and stats[f"s{i}"] > 1e-6 else 1.0 for i in range(k)]
    y = F.col(label).cast("double")
    g = F.when(y > 0.5, 0.5 / share).otherwise(0.5 / (1 - share)) if balanced else F.lit(1.0)
    x = [F.lit(1.0), *[(F.col(c).cast("double") - stats[f"m{i}"]) / sd[i] for i, c in enumerate(features)]]
    flat = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], y.alias("y"), g.alias("g")).persist()
    ridge = np.diag([0.0, *[l2] * k])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        score = sum((F.col(f"x{i}") * float(v) for i, v in enumerate(w)), F.lit(0.0))
        fit = flat.withColumn("z", score).withColumn("p", sigmoid(F.col("z")))
        loss = F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))
        curve = F.col("g") * F.col("p") * (1 - F.col("p"))
        found = fit.agg(
            F.avg(F.col("g") * loss).alias("loss"), *[F.avg(F.col("g") * (F.col("p") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(k + 1)],
            *[F.avg(curve * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)],
        ).first()
        hessian = np.array([[found[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        return found["loss"] + l2 / 2 * float(w[1:] @ w[1:]), np.array([found[f"g{i}"] for i in range(k + 1)]) + ridge @ w, hessian + ridge

    w, step = np.zeros(k + 1), np.zeros(k + 1)
    try:
        loss, grad, hessian = at(w)
        for _ in range(most):
            step = np.linalg.lstsq(hessian, grad, rcond=1e-12)[0]
            while True:
                now = at(w - step)
                if now[0] <= loss + 1e-15 or np.abs(step).max() < close:
                    break
                step = step / 2
            w, (loss, grad, hessian) = w - step, now
            if np.abs(step).max() < close:
                break
    finally:
        flat.unpersist()
    return {"bias": float(w[0])} | {c: float(v) for c, v in zip(features, w[1:], strict=True)}
