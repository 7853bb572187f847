"""Ranks and windowed normalisation. ``by`` names the partition columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _all(by: list[str]):
    return Window.partitionBy(*by)


def average_rank(value: str, by: list[str]) -> Column:
    """1-based rank, ties at the mean of their places."""
    ties = F.count(F.lit(1)).over(_all([*by, value]))
    return F.rank().over(_all(by).orderBy(value)) + (ties - 1) / 2.0


def rank_norm(value: str, by: list[str]) -> Column:
    """Average rank scaled to 0..1; 0 for a single row."""
    n = F.count(F.lit(1)).over(_all(by))
    return F.when(n > 1, (average_rank(value, by) - 1) / (n - 1)).otherwise(0.0)


def active_rank_norm(value: str, by: list[str], least: float = 1e-8) -> Column:
    """:func:`rank_norm` where the values vary, else 0."""
    spread = F.max(value).over(_all(by)) - F.min(value).over(_all(by))
    return F.when(spread > least, rank_norm(value, by)).otherwise(0.0)


def ordinal_percentile(value: str, tie: str, by: list[str]) -> Column:
    n = F.count(F.lit(1)).over(_all(by))
    return (F.row_number().over(_all(by).orderBy(value, tie)) - 1) / F.greatest(F.lit(1), n - 1)


def min_max(value: str, by: list[str], least: float = 1e-12) -> Column:
    low, high = F.min(value).over(_all(by)), F.max(value).over(_all(by))
    return F.when(high - low > least, (F.col(value) - low) / (high - low)).otherwise(0.0)


def first_n(order: list[Column | str], by: list[str], n: int) -> Column:
    return F.row_number().over(_all(by).orderBy(*order)) <= n


def composite(parts: list[Column], how: str = "mean", top: int = 2) -> Column:
    """Sum, mean, max or mean of the ``top`` largest of the parts."""
    if how == "sum":
        return sum(parts[1:], parts[0])
    if how == "max":
        return F.greatest(*parts)
    if how == "top":
        return mean_of_top(F.array(*parts), top)
    return sum(parts[1:], parts[0]) / len(parts)


def mean_of_top(values: Column, k: int) -> Column:
    best = F.slice(F.sort_array(values, False), 1, k)
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.lit(1), F.size(best))
