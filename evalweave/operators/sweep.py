"""Every rank and selective-risk metric of many risks, for all scopes together.

A sample counts once in each scope (overall, and the group that it has in each grouping). Rows aren't made one a risk and scope: they are cut into buckets by ``order``, which ties go by, and a bucket's rows of one cohort and
value of a risk leave its task as one row of sums. Running sums over those give what lies before each, upwards and downwards, whatever the number of buckets that share a value; with them a bucket goes through its rows a second
time and sums each metric's terms. Neither a group nor a tied value is one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.operators import ordered
from evalweave.operators.metrics import accepted, mean_or_zero, ratio

#: Coverages of the selective metrics.
COVERAGES = (0.7, 0.8, 0.9)
EMPTY = "<empty>"
#: Rows that one bucket should hold; a bucket is in memory with a row for each risk, scope, cohort and value that it has.
ROWS = 1 << 15
#: Sampled rows a bucket, from which cuts are made: they decide how even buckets are, never a result.
SAMPLES = 8
FLAGS = ("e", "f", "g", "fg")
#: Place of null values and, negative, of NaN among the parts of a risk's values: null comes first and NaN last in both directions.
_ENDS = -(1 << 30)


def scopes(groupings: dict[str, Column]) -> Column:
    """An array of (scope, cohort) of a row: overall, then each grouping by name; a null or empty group is :data:`EMPTY`."""
    return F.array(F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("cohort")), *[F.struct(F.lit(n).alias("scope"), _cohort(c).alias("cohort")) for n, c in groupings.items()])


def overview(rows: DataFrame, groupings: dict[str, Column], error: Column, false_alarm: Column, negative: Column, calls: Column, detected: Column | None = None, boxed: Column | None = None) -> DataFrame:
    """What doesn't depend on a risk, a row a scope and cohort: samples, accuracy, negatives, false alarms among them, mean calls, and the share of ``detected`` samples that aren't ``boxed``."""
    flat = rows.select(F.explode(scopes(groupings)).alias("_s"), error.cast("double").alias("_e"), false_alarm.alias("_f"), negative.alias("_n"), calls.alias("_c"), (F.lit(False) if detected is None else detected).alias("_d"), (F.lit(True) if boxed is None else boxed).alias("_b"))
    return flat.groupBy(F.col("_s.scope").alias("scope"), F.col("_s.cohort").alias("cohort")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(1 - F.col("_e")).alias("accuracy"), F.count_if("_n").alias("negatives"), mean_or_zero(F.when(F.col("_n"), F.col("_f").cast("double"))).alias("hfpr"),
        F.avg("_c").alias("calls"), mean_or_zero(F.when(F.col("_d"), (~F.col("_b")).cast("double"))).alias("detector_failures"),
    )


def _cohort(group: Column) -> Column:
    return F.when(F.coalesce(group.cast("string"), F.lit("")) == "", EMPTY).otherwise(group.cast("string"))


def _cuts(values: str) -> Column:
    """Each SAMPLES-th of the sampled values, sorted."""
    found = F.sort_array(F.collect_list(values))
    return F.array_distinct(F.filter(found, lambda _, i: i % SAMPLES == SAMPLES - 1)).alias("_cuts")


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list | np.ndarray]:
    """The column as numbers from 0 by ascending value, and the values; null is -1."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        coded = column.combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        return np.argsort(np.argsort(names))[coded.indices.to_numpy()], sorted(names)
    values, codes = np.unique(column.to_numpy(), return_inverse=True)
    return np.where(column.is_null().to_numpy(), -1, codes) if column.null_count else codes, values


def _cells(table: pa.Table, risks: int, scopes: int) -> Iterator[tuple]:
    """For each scope and risk its number, the rows by cohort and value, equal ones as they are, where each cell (rows of one cohort and value) begins, and the cells' cohorts and values as codes with their names."""
    valued = [_codes(table[f"_r{i}"]) for i in range(risks)]
    for s in range(scopes):
        cohort, names = _codes(table[f"_c{s}"])
        for r, (code, values) in enumerate(valued):
            wide = len(values) + 1
            key = cohort.astype(np.int64) * wide + code + 1
            key = key.astype(np.min_scalar_type(int(key.max())))  # small numbers are sorted by their digits
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            of = key[first].astype(np.int64)
            yield s, r, by, first, of // wide, names, of % wide - 1, values


def _flags(table: pa.Table) -> list[np.ndarray]:
    return [table[f].to_numpy().astype(np.int64) for f in FLAGS]


def _summed(risks: list[str], scopes: list[str]) -> Callable[[pa.Table], pa.Table]:
    def summed(table: pa.Table) -> pa.Table:
        """A row a cell: how many rows it has and their flags' sums."""
        flags, bucket, out, seen = _flags(table), table["_bucket"][0].as_py(), [], 0
        for s, r, by, first, cohort, names, value, values in _cells(table, len(risks), len(scopes)):
            size = len(first)
            found = pa.array(np.append(values, np.nan)[value], mask=value < 0)
            cohorts = pa.array(names, pa.string()).take(pa.array(cohort))
            sums = [np.diff(np.append(first, len(by))), *[np.add.reduceat(f[by], first) for f in flags]]
            out.append(pa.table({"scope": pa.array([scopes[s]]).take(pa.array(np.zeros(size, int))), "cohort": cohorts, "risk": pa.array([risks[r]]).take(pa.array(np.zeros(size, int))), "value": found, "_bucket": pa.array(np.full(size, bucket, np.int32)), "_cell": pa.array(np.arange(seen, seen + size)), **dict(zip(("m", *FLAGS), map(pa.array, sums), strict=True))}))
            seen += size
        return pa.concat_tables(out)

    return summed


_SUMMED = "scope string, cohort string, risk string, value double, _bucket int, _cell long, m long, e long, f long, g long, fg long"


def _before(cells: DataFrame, cuts: DataFrame, coverages: tuple[float, ...]) -> DataFrame:
    """For each cell the sums over its cohort's rows before it, upwards (u_) and downwards (d_), and the places that the coverages accept (k0, ...). Equal values go by bucket in both directions."""
    group, sums = ["scope", "cohort", "risk"], ["m", *FLAGS]
    part = F.when(F.col("value").isNull(), _ENDS).when(F.isnan("value"), -_ENDS).otherwise(ordered.places_below("_cuts", F.col("value")))
    cells = cells.join(F.broadcast(cuts.withColumnRenamed("risk", "_risk")), F.col("risk") == F.col("_risk"), "left").select(*cells.columns, part.alias("_part"))
    totals = cells.groupBy(*group, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    turned = F.when(F.abs("_part") == -_ENDS, F.col("_part")).otherwise(-F.col("_part"))
    whole, inside = Window.partitionBy(*group), Window.partitionBy(*group, "_part")
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.select(*group, "_part", F.sum("m").over(whole).alias("_n"), *[earlier(w, c).alias(f"_{side}{c}") for side, w in (("u", whole.orderBy("_part")), ("d", whole.orderBy(turned))) for c in sums])
    ways = (("u", inside.orderBy("value", "_bucket")), ("d", inside.orderBy(-F.col("value"), "_bucket")))
    own = cells.select(*group, "_part", "_bucket", "_cell", *[earlier(w, c).alias(f"{side}_{c}") for side, w in ways for c in sums])
    placed = own.join(parts, [*group, "_part"])
    return placed.select("_bucket", "_cell", *[(F.col(f"{side}_{c}") + F.col(f"_{side}{c}")).alias(f"{side}_{c}") for side in "ud" for c in sums], *[accepted(F.col("_n"), F.lit(c)).cast("long").alias(f"k{i}") for i, c in enumerate(coverages)])


def _terms(risks: list[str], scopes: list[str], coverages: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def terms(table: pa.Table, before: pa.Table) -> pa.Table:
        """A row a scope, cohort and risk: what the bucket's rows add to each metric."""
        table = table.take(pc.sort_indices(table, sort_keys=[("_order", "ascending")], null_placement="at_start"))
        before = before.take(pc.sort_indices(before, sort_keys=[("_cell", "ascending")]))
        base = {c: before[c].to_numpy() for c in before.column_names}
        flags, out, seen = _flags(table), [], 0
        for s, r, by, first, cohort, names, _, _ in _cells(table, len(risks), len(scopes)):
            held = {c: x[seen : seen + len(first)] for c, x in base.items()}
            seen += len(first)
            size = np.diff(np.append(first, len(by)))
            own = [f[by] for f in flags]
            run = [np.cumsum(x) for x in own]
            skip = [c[first] - x[first] for c, x in zip(run, own, strict=True)]
            e, f = own[:2]
            up, down = [np.arange(1, len(by) + 1) + np.repeat(held[f"{w}_m"] - first, size) for w in "ud"]
            upto = {w + c: run[i] + np.repeat(held[f"{w}_{c}"] - skip[i], size) for w in "ud" for i, c in enumerate("ef")}
            rate = upto["ue"] / up
            start = np.flatnonzero(np.concatenate([[True], cohort[1:] != cohort[:-1]]))
            add = lambda x, at=first[start]: pa.array(np.add.reduceat(x, at))
            found = {
                "scope": pa.array([scopes[s]] * len(start)), "cohort": pa.array([names[i] for i in cohort[start]], pa.string()), "risk": pa.array([risks[r]] * len(start)), "m": add(np.ones(len(by), np.int64)), "p_e": add(e), "p_f": add(f),
                "auc_e": add(e * ((up - upto["ue"]) - (down - upto["de"]))), "auc_f": add(f * ((up - upto["uf"]) - (down - upto["df"]))),
                "ap_e": add(e * (upto["de"] / down)), "inverted_e": add(e * rate), "ap_f": add(f * (upto["df"] / down)), "rates": add(rate),
            }
            last = np.cumsum(np.concatenate([[0], cohort[1:] != cohort[:-1]]))  # the cohort's place in start
            for i in range(coverages):
                for w, names_of in (("u", ("e", "g", "fg")), ("d", ("e",))):
                    k, lower = held[f"k{i}"], held[f"{w}_m"]
                    cell = np.flatnonzero((lower < k) & (k <= lower + size))
                    at = first[cell] + (k - lower)[cell] - 1
                    for c in names_of:
                        j = FLAGS.index(c)
                        x, none = np.zeros(len(start), np.int64), np.ones(len(start), bool)
                        x[last[cell]], none[last[cell]] = run[j][at] - skip[j][cell] + held[f"{w}_{c}"][cell], False
                        found[f"{w}{i}_{c}"] = pa.array(x, mask=none)
                    x = np.zeros(len(start), np.int64)
                    x[last[cell]] = k[cell]
                    found[f"{w}{i}_k"] = pa.array(x, mask=none)
            out.append(pa.table(found))
        return pa.concat_tables(out)

    return terms


def metrics_rollup(rows: DataFrame, risks: list[str], order: str, error: Column, false_alarm: Column, negative: Column, groupings: dict[str, Column], coverages: tuple[float, ...] = COVERAGES) -> DataFrame:
    """A row per scope, cohort and risk: AUC and average precision for errors (also with the risk turned round) and false alarms, AURC, and at each coverage the error, accuracy and false alarms among accepted negatives, and the error with the risk turned round.

    AUC is 0.5 where only one class occurs, a mean over nothing 0. ``error``, ``false_alarm`` and ``negative`` are booleans or 0 and 1. Ties go by ``order``.
    """
    flags = {"e": error, "f": false_alarm, "g": negative.cast("boolean"), "fg": false_alarm.cast("boolean") & negative.cast("boolean")}
    scopes = ["overall", *groupings]
    cohorts = [F.lit("all"), *map(_cohort, groupings.values())]
    flat = rows.select(F.col(order).alias("_order"), *[F.coalesce(c.cast("byte"), F.lit(0).cast("byte")).alias(n) for n, c in flags.items()], *[c.alias(f"_c{i}") for i, c in enumerate(cohorts)], *[F.col(r).cast("double").alias(f"_r{i}") for i, r in enumerate(risks)])
    sample = flat.where(F.pmod(F.xxhash64("_order"), F.lit(ordered.RANGE)) < F.lit(int(ordered.RANGE * SAMPLES / min(ROWS, ordered.BUCKET_ROWS))))
    every = F.create_map(*[F.lit(x) for i, r in enumerate(risks) for x in (f"_r{i}", r)])
    cuts = sample.unpivot([], [f"_r{i}" for i in range(len(risks))], "_name", "_value").groupBy("_name").agg(_cuts("_value")).select(every[F.col("_name")].alias("risk"), "_cuts")
    dealt = flat.crossJoin(F.broadcast(sample.agg(_cuts("_order")))).select(ordered.places_below("_cuts", F.col("_order")).alias("_bucket"), *flat.columns).groupBy("_bucket")
    before = _before(dealt.applyInArrow(_summed(risks, scopes), _SUMMED), cuts, coverages)
    places = [f"{x} long" for i in range(len(coverages)) for x in (f"u{i}_e", f"u{i}_g", f"u{i}_fg", f"u{i}_k", f"d{i}_e", f"d{i}_k")]
    kinds = ", ".join(["scope string, cohort string, risk string, m long, p_e long, p_f long, auc_e long, auc_f long, ap_e double, inverted_e double, ap_f double, rates double", *places])
    terms = dealt.cogroup(before.groupBy("_bucket")).applyInArrow(_terms(risks, scopes, len(coverages)), kinds)
    n = F.sum("m")

    def auc(flag: str) -> Column:
        """Ties at half: the negatives before a positive, upwards less downwards, tell the lower from the higher ones, whatever the order of ties."""
        p = F.sum(f"p_{flag}").cast("double")
        pairs = p * (n - p)
        return F.when(pairs > 0, (pairs + F.sum(f"auc_{flag}")) / (2 * pairs)).otherwise(0.5)

    out = [
        n.alias("n"), auc("e").alias("error_auroc"), ratio(F.sum("ap_e"), F.sum("p_e")).alias("error_auprc"), ratio(F.sum("inverted_e"), F.sum("p_e")).alias("inverted_error_auprc"), auc("f").alias("false_alarm_auroc"), ratio(F.sum("ap_f"), F.sum("p_f")).alias("false_alarm_auprc"),
        (F.sum("rates") / n).alias("aurc"),
    ]
    for i, c in enumerate(coverages):
        tag = round(c * 100)
        rate = F.max(f"u{i}_e") / F.max(f"u{i}_k")
        out += [rate.alias(f"error_{tag}"), (1 - rate).alias(f"accuracy_{tag}"), ratio(F.max(f"u{i}_fg"), F.max(f"u{i}_g")).alias(f"hfpr_{tag}"), (F.max(f"d{i}_e") / F.max(f"d{i}_k")).alias(f"inverted_error_{tag}")]
    found = terms.groupBy("scope", "cohort", "risk").agg(*out)
    return found.withColumn("inverted_error_auroc", 1 - F.col("error_auroc"))
