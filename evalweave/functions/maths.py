"""Scalar formulas of margins, budgets and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.ln(q / (1 - q))


def binary_entropy(margin: Column, clip: float = 60.0) -> Column:
    """Entropy in nats of the sigmoid of a margin."""
    p = sigmoid(F.greatest(F.lit(-clip), F.least(F.lit(clip), margin)))
    part = lambda q: F.when(q > 0, -q * F.ln(q)).otherwise(0.0)
    return part(p) + part(1 - p)


def signed_support(margin: Column, predicted_yes: Column) -> Column:
    return F.when(predicted_yes, margin).otherwise(-margin)


def keep_count(n: Column, ratio: Column | float) -> Column:
    """ceil(n * ratio), at least 1 and at most n."""
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.greatest(F.lit(1), F.least(n, F.ceil(n * ratio))).cast("int")


def adaptive_ratio(risk: Column, low: float = 0.15, high: float = 0.70) -> Column:
    return F.lit(low) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)) * (high - low)


def bucket_ratio(risk: Column, ratios: tuple[float, float, float] = (0.25, 0.50, 0.70)) -> Column:
    return F.when(risk < 1 / 3, ratios[0]).when(risk < 2 / 3, ratios[1]).otherwise(ratios[2])


def removal_fraction(n: Column, kept: Column) -> Column:
    """The share of tokens that a budget removes; 0 without tokens."""
    return F.when(n > 0, 1 - F.greatest(F.lit(0), F.least(n, kept)) / n).otherwise(0.0)


def effective_ratio(mode: Column, ratio: Column, risk: Column, sensitivity: Column | None = None) -> Column:
    """The ratio by budget mode (fixed, risk_adaptive, risk_bucket, sensitivity_policy, full); a missing risk counts as one half, a missing sensitivity as the fixed ratio, and an unknown mode is an error."""
    risk, sensitivity = F.coalesce(risk, F.lit(0.5)), F.coalesce(sensitivity, ratio) if sensitivity is not None else ratio
    known = {"fixed": ratio, "risk_adaptive": adaptive_ratio(risk), "risk_bucket": bucket_ratio(risk), "sensitivity_policy": sensitivity, "full": F.lit(1.0)}
    out = F.when(F.lit(False), ratio)
    for name, value in known.items():
        out = out.when(mode == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("no budget mode "), F.coalesce(mode, F.lit("null")))).cast("double"))


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def softmax(values: Column, temperature: float = 1.0) -> Column:
    high = F.array_max(values)
    e = F.transform(values, lambda x: F.exp((x - high) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def normalised_entropy(weights: Column) -> Column:
    h = F.aggregate(weights, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.ln(p)).otherwise(0.0))
    some = F.size(F.filter(weights, lambda p: p > 0))
    return F.when(some > 1, h / F.ln(some.cast("double"))).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def finite(value: Column) -> Column:
    """A number; null, NaN, infinite and non-numeric values become 0."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def fixed(value: Column) -> Column:
    """Three decimals; magnitudes below 0.0005 show as 0.000."""
    return F.when(F.abs(value) < 0.0005, "0.000").otherwise(F.format_string("%.3f", value))


def closest_factor_grid(n: Column) -> Column:
    """The divisor pair (rows, columns) of n nearest to a square, rows no more than columns."""
    rows = F.array_max(F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(n.cast("double"))).cast("int")), lambda r: n % r == 0))
    return F.struct(rows.alias("rows"), (n / rows).cast("int").alias("columns"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The score interval of a rate; NaN without trials."""
    p, total = successes / n, n.cast("double")
    centre = (p + z * z / (2 * total)) / (1 + z * z / total)
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    none = F.lit(float("nan"))
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(none), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(none)


def upper_bound(mean: Column, variance: Column, n: Column) -> Column:
    """The 95 % upper bound of a mean, 1 at most; the mean itself with fewer than two values."""
    return F.when(n > 1, F.least(F.lit(1.0), mean + 1.96 * F.sqrt(variance / n))).otherwise(mean)
