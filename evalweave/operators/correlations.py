"""Grids of correlations and their intervals, and means by strata of scale.

A resample weighs each unit by a Poisson draw; ranks are made anew under the weights, a unit drawn twice ranking as two equal ones. The replicates of a row are a vector (:mod:`evalweave.operators.replicates`): a value's ranks in all of them are
the running vector of the weights below it. Correlations follow from sums of cross-products a group and replicate; replicate 0 is the sample itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.hashing import key_seeds
from evalweave.operators import ordered
from evalweave.operators.metrics import fixed_effect_residuals, partial_of, quantiles
from evalweave.operators.ordered import ordered_ranks
from evalweave.operators.replicates import BLOCK, by_replicate, draws
from evalweave.operators.resampling import DRAWS, bootstrap_correlation, bootstrap_mean, weighted

NAN = float("nan")
#: Groups whose sums a task holds before they leave it.
MOST_HELD = 128
#: Replicates of a block, and weights that a task holds at a time.
REPLICATES = 64
CELLS = 1 << 20


def with_replicates(rows: DataFrame, unit: str, n: int, seed: int) -> DataFrame:
    """``rows`` once as they are (replicate 0, w = 1) and once a replicate that draws their unit: the draws of :func:`cross_products` as rows."""
    return rows.withColumns({"replicate": F.lit(0), "w": F.lit(1)}).unionByName(weighted(rows, unit, n, seed).where("w > 0").select(*rows.columns, "replicate", "w"))


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).ravel()))


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, size)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all columns begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def rank_vectors(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """(by, _value, _bucket, _twice) for each value of a group: twice its mid-rank among the weights of its bucket, in each replicate. ``rows`` carry the seeds _a and _b.

    Equal values are one bucket's; their weights are summed in as many tasks as the number of rows asks for before they meet.
    """
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", " * bool(by)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = rows.select(*by, "_a", "_b", (F.col(value) + 0.0).alias("_value"))
    flat = ordered.bucketed(flat, F.struct(F.col("_value").alias("v")), [], by, ordered.BUCKET_ROWS)
    tasks = flat.agg((1 + F.floor(F.count(F.lit(1)) / ordered.BUCKET_ROWS)).alias("_tasks"))  # one row
    flat = flat.crossJoin(F.broadcast(tasks)).withColumn("_cell", F.xxhash64(*by, "_value", F.pmod("_a", "_tasks"))).drop("_tasks")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                first = _starts(some.column("_cell").to_numpy())
                w = np.add.reduceat(draws(some.column("_a").to_numpy(), some.column("_b").to_numpy(), n), first).astype(np.int64)
                kept = some.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in (*by, "_value", "_bucket")), _lists(w)], names=[*by, "_value", "_bucket", "_w"])

    owns = flat.repartition(parts, "_cell").sortWithinPartitions("_cell").mapInArrow(weigh, f"{keys}_value double, _bucket int, _w array<bigint>")
    owns = owns.withColumn("_cell", F.xxhash64(*by, "_bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = held = None  # the value that isn't over yet: its row, value and weights
        below = np.zeros(n + 1, np.int64)
        out = lambda h: pa.RecordBatch.from_arrays([*(h[0].column(c) for c in (*by, "_value", "_bucket")), _lists((2 * below + h[2] + 1)[None])], names=[*by, "_value", "_bucket", "_twice"])
        for batch in batches:
            cells, values, w = batch.column("_cell").to_numpy(), batch.column("_value").to_numpy(), _matrix(batch.column("_w"), n + 1)
            first = _starts(cells, values)
            for at, own in zip(first.tolist(), np.add.reduceat(w, first) if len(first) else [], strict=True):
                if held and cells[at] == cell and values[at] == held[1]:
                    held = (held[0], held[1], held[2] + own)
                    continue
                if held:
                    yield out(held)
                    below = below + held[2] if cells[at] == cell else np.zeros(n + 1, np.int64)
                cell, held = cells[at], (batch.slice(at, 1), values[at], own)
        if held:
            yield out(held)

    return owns.repartition(parts, "_cell").sortWithinPartitions("_cell", "_value").mapInArrow(run, f"{keys}_value double, _bucket int, _twice array<bigint>")


def cross_products(rows: DataFrame, by: list[str], unit: str, raw: list[str], ranked: list[str], n: int, seed: int) -> tuple[DataFrame, dict[tuple[int, int], Column]]:
    """A row a group and replicate with the weighted sums of the ``raw`` columns, of the ranks of the ``ranked`` ones, and of their products, and the correlation of each pair as a column over it: null without variation.

    The rows of a group that a bucket could hold meet once for each block of replicates, and their ranks need no join (:func:`block_sums`); those of a larger group go by :func:`bucket_sums`. One count a group tells them apart.
    """
    a, b = key_seeds(seed, F.col(unit))
    flat = rows.select(*by, a.alias("_a"), b.alias("_b"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*raw, *ranked])])
    large = flat.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ordered.BUCKET_ROWS).select(*[F.col(c).alias(f"_g{j}") for j, c in enumerate(by)])
    if not large.limit(1).count():
        sums = block_sums(flat, by, raw, ranked, n)
    elif not by:
        sums = bucket_sums(flat, by, raw, ranked, n)
    else:
        of = ordered._same(by, large.columns)
        sums = block_sums(flat.join(large, of, "left_anti"), by, raw, ranked, n).unionByName(bucket_sums(flat.join(large, of, "left_semi"), by, raw, ranked, n))
    s, w, m = lambda i: F.col(f"_s{i}"), F.col("_w"), range(len(raw) + len(ranked))
    cov = lambda i, j: F.col(f"_p{i}_{j}") - s(i) * s(j) / w
    some = lambda i: cov(i, i) > 1e-9 * F.greatest(F.lit(1e-9), F.col(f"_p{i}_{i}"))
    return sums, {(i, j): F.when(some(i) & some(j), cov(i, j) / F.sqrt(cov(i, i) * cov(j, j))) for i in m for j in m if i < j}


def _sum_names(size: int) -> list[str]:
    return ["_w", *[f"_s{i}" for i in range(size)], *[f"_p{i}_{j}" for i in range(size) for j in range(i, size)]]


def block_sums(flat: DataFrame, by: list[str], raw: list[str], ranked: list[str], n: int) -> DataFrame:
    """(by, replicate, sums) of groups that fit a task: a group's rows go to a task for each block of replicates, where a value's ranks are running sums of weights in the order of the values."""
    kinds, names = dict(flat.dtypes), _sum_names(len(raw) + len(ranked))
    columns = list(dict.fromkeys([*raw, *ranked]))
    blocks = flat.sparkSession.range(n // REPLICATES + 1).select(F.col("id").alias("_block"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "_block bigint", *(f"{c} array<double>" for c in names)])

    def summed(rows: pa.Table) -> pa.Table:
        a, b = rows.column("_a").to_numpy(), rows.column("_b").to_numpy()
        given = {c: rows.column(c).to_numpy() + 0.0 for c in columns}
        places = []
        for c in ranked:
            order = np.argsort(given[c], kind="stable")
            first = _starts(given[c][order])
            of = np.empty(len(order), np.int64)  # the number of each row's value
            of[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
            places.append((order, first, of))
        start = int(rows.column("_block")[0].as_py()) * REPLICATES
        wide, out = max(1, CELLS // max(1, len(a))), []
        for at in range(start, min(n + 1, start + REPLICATES), wide):
            w = draws(a, b, min(n + 1, start + REPLICATES, at + wide) - 1, at)
            v = [given[c][:, None] for c in raw]
            for order, first, of in places:
                own = np.add.reduceat(w[order], first, axis=0)
                v.append((np.cumsum(own, axis=0) - (own - 1) / 2)[of])
            weighed = [w * x for x in v]
            out.append([w.sum(0), *[x.sum(0) for x in weighed], *[np.einsum("ij,ij->j", weighed[i], np.broadcast_to(v[j], w.shape)) for i in range(len(v)) for j in range(i, len(v))]])
        vectors = [np.concatenate(parts) for parts in zip(*out, strict=True)]
        key = rows.select([*by, "_block"]).slice(0, 1).combine_chunks()
        return pa.Table.from_arrays([*key.columns, *[_lists(x[None]) for x in vectors]], names=[*by, "_block", *names])

    vectors = flat.crossJoin(F.broadcast(blocks)).groupBy(*by, "_block").applyInArrow(summed, schema)
    return by_replicate(vectors, [*by, "_block"], names).select(*by, (F.col("_block") * REPLICATES + F.col("replicate")).cast("int").alias("replicate"), *names).where("_w > 0")


def bucket_sums(flat: DataFrame, by: list[str], raw: list[str], ranked: list[str], n: int) -> DataFrame:
    """(by, replicate, sums) of groups of any size. A rank is a place in a bucket and what lies in the buckets before. Rows meet the former as vectors and leave a task as sums by group and buckets; the latter is added to those."""
    joined = flat
    for i, c in enumerate(ranked):
        points = rank_vectors(flat.select(*by, "_a", "_b", c), by, c, n).select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(by)], F.col("_value").alias("_k"), F.col("_bucket").alias(f"_b{i}"), F.col("_twice").alias(f"_t{i}"))
        joined = joined.join(points, ordered._same([*by, c], [*[f"_k{j}" for j in range(len(by))], "_k"])).drop(*[f"_k{j}" for j in range(len(by))], "_k")
    cells, size = [f"_b{i}" for i in range(len(ranked))], len(raw) + len(ranked)
    m = range(size)
    names = _sum_names(size)
    kinds = dict(joined.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*by, *cells]), *(f"{c} array<double>" for c in names)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        out = lambda: [pa.RecordBatch.from_arrays([*(key.column(c) for c in (*by, *cells)), *[_lists(v[None]) for v in sums]], names=[*by, *cells, *names]) for key, sums in held.values()]
        for batch in batches:
            of = batch.column("_cell").to_numpy()
            order = np.argsort(of, kind="stable")
            first = _starts(of[order])
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                for at in range(lo, hi, BLOCK):
                    some = batch.take(pa.array(order[at : min(hi, at + BLOCK)]))
                    w = draws(some.column("_a").to_numpy(), some.column("_b").to_numpy(), n)
                    v = [some.column(c).to_numpy()[:, None] for c in raw] + [_matrix(some.column(f"_t{i}"), n + 1) / 2.0 for i in range(len(ranked))]
                    weighed = [w * x for x in v]
                    sums = np.stack([w.sum(0), *[x.sum(0) for x in weighed], *[(weighed[i] * v[j]).sum(0) for i in m for j in m if i <= j]])
                    cell = int(of[order[lo]])
                    if cell in held:
                        held[cell][1] += sums
                    else:
                        held[cell] = [some.slice(0, 1), sums]
            if len(held) > MOST_HELD:
                yield from out()
                held.clear()
        yield from out()

    vectors = joined.withColumn("_cell", F.xxhash64(*by, *cells)).mapInArrow(summed, schema)
    each = by_replicate(vectors, [*by, *cells], names).groupBy(*by, *cells, "replicate").agg(*[F.sum(c).alias(c) for c in names])
    before = lambda c: F.coalesce(F.sum("_w").over(Window.partitionBy(*by, "replicate").orderBy(c).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    each = each.withColumns({f"_o{len(raw) + i}": before(c) for i, c in enumerate(cells)})
    o = lambda i: F.col(f"_o{i}") if i >= len(raw) else F.lit(0.0)
    s, w = lambda i: F.col(f"_s{i}"), F.col("_w")
    every = [F.sum(w).alias("_w"), *[F.sum(s(i) + o(i) * w).alias(f"_s{i}") for i in m], *[F.sum(F.col(f"_p{i}_{j}") + o(i) * s(j) + o(j) * s(i) + o(i) * o(j) * w).alias(f"_p{i}_{j}") for i in m for j in m if i <= j]]
    return each.groupBy(*by, "replicate").agg(*every).where("_w > 0")


def summarised(each: DataFrame, by: list[str], value: str) -> DataFrame:
    """Estimate (replicate 0), low and high, and the number of draws that have a value; NaN where there is none."""
    real = F.when(F.col("replicate") > 0, F.col(value))
    low, high = (F.percentile(real, F.lit(q)) for q in (0.025, 0.975))
    nan = lambda c: F.coalesce(c, F.lit(NAN))
    return each.groupBy(*by).agg(nan(F.max(F.when(F.col("replicate") == 0, F.col(value)))).alias("estimate"), nan(low).alias("low"), nan(high).alias("high"), F.count(real).alias("draws"))


def correlation_grid(rows: DataFrame, by: list[str], unit: str, predictors: list[str], outcomes: list[str], n: int = DRAWS, seed: int = 0, least: int = 4) -> DataFrame:
    """(by, outcome, predictor, method, n, estimate, low, high, draws) for Spearman and Pearson correlations of every predictor with every outcome, over the rows that have both.

    Fewer than ``least`` rows, or a column without variation, give NaN and no draws.
    """
    flat = rows.select(*by, unit, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*predictors, *outcomes])])
    pairs = F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(p).alias("predictor"), F.col(p).alias("x"), F.col(o).alias("y")) for o in outcomes for p in predictors])
    long = flat.select(*by, unit, F.inline(pairs)).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    keys = [*by, "outcome", "predictor"]
    sizes = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sums, value = cross_products(long, keys, unit, ["x", "y"], ["x", "y"], n, seed)
    each = sums.select(*keys, "replicate", value[2, 3].alias("spearman"), value[0, 1].alias("pearson")).unpivot([*keys, "replicate"], ["spearman", "pearson"], "method", "r")
    each = each.join(sizes, keys).withColumn("r", F.when(F.col("n") >= least, F.col("r")))
    found = summarised(each, [*keys, "method", "n"], "r")
    # without a value of the sample itself there is nothing to put an interval around
    ends = {c: F.when(F.isnan("estimate"), NAN).otherwise(F.col(c)) for c in ("low", "high")}
    return found.withColumns({**ends, "draws": F.when(F.isnan("estimate"), 0).otherwise(F.col("draws"))})


def partial_spearman_interval(rows: DataFrame, x: str, y: str, controls: list[str], by: list[str], unit: str, n: int = DRAWS, seed: int = 0) -> DataFrame:
    """(by, n, estimate, low, high, draws) of the partial rank correlation; ranks of all columns are made anew in each draw. NaN with fewer than five rows; controls without variation drop out."""
    names = [x, y, *controls]
    fine = rows.where(" and ".join(f"`{c}` is not null and not isnan(double(`{c}`))" for c in names)).select(*by, unit, *names)
    sizes = fine.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sums, value = cross_products(fine, by, unit, [], names, n, seed)
    each = partial_of(sums, [*by, "replicate"], value, len(names)).withColumn("r", F.when(~F.isnan("r"), F.col("r")))
    each = each.join(sizes, by) if by else each.crossJoin(F.broadcast(sizes))  # without keys one row
    return summarised(each.withColumn("r", F.when(F.col("n") >= 5, F.col("r"))), [*by, "n"], "r")


def fixed_effect_interval(rows: DataFrame, x: str, y: str, first: str, second: str, n: int = DRAWS, seed: int = 0) -> DataFrame:
    """(r, low, high) of the two-way fixed-effect rank correlation, over resampled ``first`` keys: ranks and effects are those of the sample, and a key's cross-products are one row."""
    return bootstrap_correlation(fixed_effect_residuals(rows, x, y, first, second), first, "_x", "_y", n, seed)


def strata(rows: DataFrame, by: list[str], dimensions: list[str]) -> DataFrame:
    """``rows`` once a dimension, with dimension, size (its value) and stratum: small, medium or large by the thirds of the value in the group; by the thirds of its rank where those fall together; constant with fewer than three values."""
    long = rows.select("*", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("size")) for d in dimensions]))).where("size is not null")
    keys = [*by, "dimension"]
    thirds = quantiles(long, "size", keys, 1 / 3).select(*keys, F.col("linear").alias("_q1")).join(quantiles(long, "size", keys, 2 / 3).select(*keys, F.col("linear").alias("_q2")), keys)
    points = long.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("_m"))
    thirds = thirds.join(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values"), F.sum("_m").alias("_n")), keys)
    ranked = ordered_ranks(long, keys, {"size": "_rank"}).join(thirds, keys)
    by_place = lambda at, one, two: F.when(at <= one, "small").when(at <= two, "medium").otherwise("large")
    label = F.when(F.col("_values") < 3, "constant").when(F.col("_q1") == F.col("_q2"), by_place(F.col("_rank") / F.col("_n"), F.lit(1 / 3), F.lit(2 / 3))).otherwise(by_place(F.col("size"), F.col("_q1"), F.col("_q2")))
    return ranked.withColumn("stratum", label).drop("_rank", "_q1", "_q2", "_values", "_n")


def scale_table(rows: DataFrame, by: list[str], unit: str, dimensions: list[str], outcomes: list[str], n: int = DRAWS, seed: int = 0) -> DataFrame:
    """(by, dimension, stratum, least, most, metric, n, mean, low, high): the mean of each outcome in each stratum of each dimension, with an interval over resampled units."""
    placed = strata(rows, by, dimensions)
    keys = [*by, "dimension", "stratum"]
    bounds = placed.groupBy(*keys).agg(F.min("size").alias("least"), F.max("size").alias("most"))
    values = F.array(*[F.struct(F.lit(o).alias("metric"), F.col(o).cast("double").alias("value")) for o in outcomes])
    long = placed.select(*keys, F.col(unit).alias("_unit"), F.inline(values)).where("value is not null")
    found = bootstrap_mean(long, "_unit", "value", [*keys, "metric"], n, seed)
    return found.join(bounds, keys).select(*keys, "least", "most", "metric", F.col("clusters").alias("n"), "mean", "low", "high")
