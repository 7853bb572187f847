"""Places, running sums and ranks of whole groups without a task that sees a group.

Rows are cut into buckets at quantiles of the order and its ties together, so that a bucket holds a bounded share of all rows, whatever the groups are and however many rows share a value. A bucket is ordered by
itself; sums over whole buckets, a row a group and bucket, give what lies before each. The cuts come from a sample of the rows, as many as the number of buckets asks for: they decide how even the buckets are, never a result. Cuts are a broadcast
row of an array, in which each row finds its bucket by binary search; nothing runs before the result is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one bucket should hold.
BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 4096
#: Sampled rows a bucket; an array of cuts is made from this many times MOST_BUCKETS keys at most, about.
SAMPLES = 32
#: A row is sampled by a number below this from its hash.
RANGE = 1 << 30


def order_key(rows: DataFrame, order: str, ties: list[Column], descending: bool) -> Column:
    """A struct that sorts as ``order`` and then ``ties`` do; null values order as the smallest, NaN as the largest, ties always ascend."""
    value, rest = F.col(order), [t.alias(f"t{i}") for i, t in enumerate(ties)]
    if not descending:
        return F.struct(value.alias("v"), *rest)
    if not isinstance(rows.schema[order].dataType, (T.IntegralType, T.DecimalType)):
        value = value.cast("double")
        return F.struct(value.isNull().alias("null"), (~F.isnan(value)).alias("number"), (-value).alias("v"), *rest)
    return F.struct(value.isNull().alias("null"), (-value).alias("v"), *rest)


def _same(left: list[str], right: list[str]) -> Column:
    both = F.lit(True)
    for a, b in zip(left, right, strict=True):
        both &= F.col(a).eqNullSafe(F.col(b))
    return both


def cuts(rows: DataFrame, key: Column, kinds: list[str], by: list[str], bucket_rows: int) -> DataFrame:
    """Sorted cuts of the key for each of ``kinds`` (columns _k0, _k1, ... and _cuts); rows are told apart by ``by`` and the key."""
    names = [f"_k{i}" for i in range(len(kinds))]
    keyed = rows.select(*[F.col(c).alias(n) for c, n in zip(kinds, names, strict=True)], key.alias("_key"), F.pmod(F.xxhash64(*by, key), F.lit(RANGE)).alias("_at"))
    wanted = F.greatest(F.lit(2), F.least(F.lit(MOST_BUCKETS), F.floor(F.col("_n") / bucket_rows) + 1))
    total = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(n).alias(f"_t{n}") for n in names], wanted.alias("_wanted"), (F.lit(float(RANGE)) * SAMPLES * wanted / F.col("_n")).alias("_below"))
    sized = keyed.join(F.broadcast(total), _same(names, [f"_t{n}" for n in names])) if kinds else keyed.crossJoin(F.broadcast(total))  # without kinds one row
    found = sized.where("_at < _below").groupBy(*names).agg(F.sort_array(F.collect_list("_key")).alias("_s"), F.max("_wanted").cast("int").alias("_w"))
    every = F.when(F.size("_s") >= F.col("_w"), F.transform(F.sequence(F.lit(1), F.col("_w") - 1), lambda i: F.get("_s", F.floor(F.size("_s") * i / F.col("_w")).cast("int")))).otherwise(F.col("_s"))
    return found.select(*names, every.alias("_cuts"))


def places_below(cuts: str, key: Column, equal: bool = False) -> Column:
    """How many of the sorted array of ``cuts`` lie below the key, or below it or at it; by binary search."""
    size = F.size(cuts)
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    below = lambda c: c <= key if equal else c < key
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(below(F.get(cuts, half(s))), F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))
    turns = F.sequence(F.lit(0), F.ceil(F.log2(size + F.lit(1.0))).cast("int"))
    one = F.when(below(F.get(cuts, F.lit(0))), 1).otherwise(0)  # compiled, as there is nothing to search
    return F.coalesce(F.when(size == 1, one).when(size > 0, F.aggregate(turns, F.struct(F.lit(0).alias("lo"), size.alias("hi")), step)["lo"]), F.lit(0))


def bucketed(rows: DataFrame, key: Column, kinds: list[str], by: list[str], bucket_rows: int) -> DataFrame:
    """``rows`` with ``_bucket``, 0 first in the order: the number of cuts below the row's key."""
    found = F.broadcast(cuts(rows, key, kinds, by, bucket_rows))
    joined = rows.join(found, _same(kinds, [f"_k{i}" for i in range(len(kinds))]), "left") if kinds else rows.crossJoin(found)
    return joined.select(*rows.columns, places_below("_cuts", key).alias("_bucket"))


def running(rows: DataFrame, by: list[str], order: str, ties: list[str | Column], sums: dict[str, Column], descending: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """``rows`` with ``rn``, their place in the group by ``order`` and then ``ties``, ``n``, the group's size, and for each of ``sums`` its running sum up to and with the row.

    ``kinds``, some of ``by``, have cuts of their own each: columns whose values lie in different ranges, few in number.
    """
    key = order_key(rows, order, [F.col(t) if isinstance(t, str) else t for t in ties], descending)
    own = {f"_s{i}": c for i, c in enumerate(sums.values())}
    marked = bucketed(rows, key, kinds or [], by, BUCKET_ROWS).withColumns({"_key": key, **own})
    totals = marked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_count"), *[F.sum(c).alias(f"_t{c}") for c in own])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    whole = Window.partitionBy(*by)
    offsets = totals.select(*[F.col(c).alias(f"_g_{i}") for i, c in enumerate(by)], F.col("_bucket").alias("__bucket"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(whole).alias("n"), *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_o{c}") for c in own])
    place = Window.partitionBy(*by, "_bucket").orderBy("_key")
    sofar = place.rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumns({"_rn": F.row_number().over(place), **{f"_c{c}": F.sum(c).over(sofar) for c in own}})
    placed = placed.join(offsets, _same(["_bucket", *by], ["__bucket", *[f"_g_{i}" for i in range(len(by))]]))
    return placed.select(*rows.columns, (F.col("_rn") + F.col("_before")).alias("rn"), "n", *[(F.col(f"_c{c}") + F.col(f"_o{c}")).alias(name) for name, c in zip(sums, own, strict=True)])


def ordered_ranks(rows: DataFrame, by: list[str], names: dict[str, str], weight: str | None = None) -> DataFrame:
    """``rows`` with the 1-based rank of each numeric column of ``names`` in its group, under its name, ties at the mean of their places: equal values are counted first, those of all columns in one plan.

    A row of a whole ``weight`` above 0 ranks as that many equal rows.
    """
    long = rows.unpivot([*by, weight] if weight else by, list(names), "_column", "_value")
    points = long.groupBy(*by, "_column", "_value").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_m"))
    ranked = running(points, [*by, "_column"], "_value", [], {"_upto": F.col("_m")}, kinds=["_column"])
    out = rows
    for value, name in names.items():
        own = ranked.where(F.col("_column") == value).select(*[F.col(c).alias(f"_k_{i}") for i, c in enumerate([*by, "_value"])], (F.col("_upto") - (F.col("_m") - 1) / 2.0).alias(name))
        out = out.join(own, _same([*by, value], [f"_k_{i}" for i in range(len(by) + 1)])).select(*out.columns, name)
    return out
