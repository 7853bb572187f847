"""Permutations under constraints, found in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the digest by which rows are numbered; a value's rows are numbered by themselves.
PARTS = 1 << 12


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, which ends its lineage: in spark.checkpoint.dir, where it is set; else, in a session of one process, in a folder of this machine. A cluster without the setting is refused."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not own and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(own or f"file:///tmp/checkpoints/{context.applicationId}")
    return df.checkpoint()


def numbered(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, at): distinct keys numbered from 0 in the order of their digests. Only the counts of :data:`PARTS` parts are ordered as a whole."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(PARTS))
    rows = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), F.lit("inside"), F.col(key)), key)) - 1
    return rows.withColumn("_i", inside).join(offsets, "_part").select(key, (F.col("_i") + F.col("_before")).alias("at"))


def conflicts(mapping: DataFrame, forbidden: DataFrame, observed: DataFrame) -> DataFrame:
    """The sources of ``mapping`` (source, target) that map to themselves, to a key without observed tokens, or to one that has a token which they forbid.

    ``forbidden`` and ``observed`` are (key, token).
    """
    known = observed.select(F.col("key").alias("target")).distinct()
    unknown = mapping.join(known, "target", "left_anti").select("source")
    asked = mapping.join(forbidden.select(F.col("key").alias("source"), "token"), "source").select("source", "target", "token")
    met = asked.join(observed.select(F.col("key").alias("target"), "token"), ["target", "token"], "left_semi").select("source")
    return mapping.where("source = target").select("source").unionByName(unknown).unionByName(met).distinct()


def collision_free_derangement(forbidden: DataFrame, observed: DataFrame, seed: int = 0, rounds: int = 100) -> DataFrame:
    """(source, target): a permutation of the keys of ``forbidden`` (key, token) in which no key maps to itself or to a key with an ``observed`` (key, token) token that it forbids.

    Keys begin as a turn by one place in hash order. In each round an equi-join on tokens finds the conflicts, and each conflicting key offers to swap targets with a key at a hashed place; of the offers that share a key the one with the smallest number goes first,
    and a swap is made if fewer conflicts are left by it. Keys without a token to forbid need a row with a null token. An error tells that conflicts remain after ``rounds``: there may be no such permutation.
    """
    forbidden = settled(forbidden.select("key", "token").where("key is not null").distinct())
    places = settled(numbered(forbidden, "key", seed))
    forbidden = forbidden.where("token is not null")
    observed = settled(observed.select("key", "token").where("key is not null").distinct())
    n = places.count()
    turned = places.select(F.col("key").alias("target"), F.pmod(F.col("at") - 1, F.lit(max(1, n))).alias("at"))
    mapping = settled(places.join(turned, "at").select("at", F.col("key").alias("source"), "target"))
    for turn in range(rounds):
        bad = settled(conflicts(mapping.select("source", "target"), forbidden, observed))
        if not bad.limit(1).count():
            return mapping.select("source", "target")
        number: Column = F.xxhash64(F.lit(seed), F.lit(turn), F.col("source"))
        offers = mapping.join(bad, "source").select(F.col("source").alias("a"), F.col("target").alias("ta"), number.alias("u"), F.pmod(F.xxhash64(F.lit(turn), number), F.lit(n)).alias("at"))
        offers = offers.join(mapping.select("at", F.col("source").alias("b"), F.col("target").alias("tb")), "at").where("a <> b")
        ends = offers.select(F.inline(F.array(F.struct(F.col("a").alias("key"), F.struct("u", "a", "b").alias("edge")), F.struct(F.col("b").alias("key"), F.struct("u", "a", "b").alias("edge")))))
        first = ends.groupBy("key").agg(F.min("edge").alias("edge")).groupBy("edge").agg(F.count(F.lit(1)).alias("ends")).where("ends = 2").select("edge.a", "edge.b")
        swaps = settled(offers.join(first, ["a", "b"]).select("a", "b", "ta", "tb"))
        tried = swaps.select(F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("tb").alias("target"), "a"), F.struct(F.col("b").alias("source"), F.col("ta").alias("target"), "a"))).alias("source", "target", "swap"))
        after = conflicts(tried.select("source", "target"), forbidden, observed).join(tried.select("source", "swap"), "source").groupBy("swap").agg(F.count(F.lit(1)).alias("after"))
        before = bad.join(tried.select("source", "swap"), "source").groupBy("swap").agg(F.count(F.lit(1)).alias("before"))
        good = before.join(after, "swap", "left").where("coalesce(after, 0) < before").select("swap")
        moved = tried.join(good, "swap").select("source", F.col("target").alias("_to"))
        mapping = settled(mapping.join(moved, "source", "left").select("at", "source", F.coalesce("_to", "target").alias("target")))
    left = [r.source for r in bad.orderBy("source").limit(5).collect()]
    raise RuntimeError(f"keys still meet tokens that they forbid after {rounds} rounds, among them {left}")


def beaten_by(rows: DataFrame, by: list[str], key: str, low: str, high: str, most: int = 4) -> DataFrame:
    """``rows`` (by, key, low, high) with front, whether no other row of the group has low <= and high >= with one of them strict, and dominators: of a beaten row the first ``most`` front rows that beat it, by high and then low.

    Sorted by high, the front is a staircase: its lows rise, too, so the front rows that beat a row are neighbours on it, from the first whose high reaches the row's. Each front row carries its next ones; a row takes what the nearest front row above it carries, by one ordered pass, without a join of rows with rows.
    """
    w = Window.partitionBy(*by)
    points = rows.select(*by, low, high).distinct()
    above = w.orderBy(low, F.col(high).desc()).rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("_best", F.max(high).over(above)).withColumn("front", F.col("_best").isNull() | (F.col(high) > F.col("_best"))).drop("_best")
    marked = rows.select(*by, key, low, high).join(points, [*by, low, high])
    up = w.orderBy(high, low, key)
    carried = F.array(F.struct(F.col(low).alias("low"), F.col(high).alias("high"), F.col(key).alias("key")), *[F.lead(F.struct(F.col(low).alias("low"), F.col(high).alias("high"), F.col(key).alias("key")), k).over(up) for k in range(1, most)])
    stairs = marked.where("front").withColumn("_next", carried)
    both = stairs.unionByName(marked.where("not front").withColumn("_next", F.lit(None).cast(stairs.schema["_next"].dataType)))
    # from the highest down: the last front row seen is the lowest one that reaches the row; of equal highs all front rows come before, in falling order of the staircase
    down = w.orderBy(F.col(high).desc(), F.col("front").desc(), F.col(low).desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = F.last("_next", ignorenulls=True).over(down)
    beats = lambda d: d.isNotNull() & (d["low"] <= F.col(low)) & (d["high"] >= F.col(high)) & ((d["low"] < F.col(low)) | (d["high"] > F.col(high)))
    names = F.transform(F.filter(F.coalesce("_near", F.array()), beats), lambda d: d["key"])
    out = both.withColumn("_near", near)
    return out.select(*by, key, low, high, "front", F.when(F.col("front"), F.array().cast(f"array<{dict(rows.dtypes)[key]}>")).otherwise(names).alias("dominators"))
