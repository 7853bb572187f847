"""Mixing sources to target weights by Poisson replication.

A source with weight w (weights are scaled to sum 1) and n of N rows gets the mean repetition rate r = w * epochs * N / n. A document's
count is the inverse of the Poisson distribution of mean r at a uniform number hashed from seed, doc_id and text, so it doesn't depend on
partitions, order or retries; its expectation is r, whatever the other documents are. The document is exploded by its count and the
copies are dealt by a second hash and sorted by it: a global shuffle.

Cases: a null source is a source of its own; without given weights a source weighs n ** alpha; a source absent from given weights gets rate 0, so its
rows go, as the caller asked; an empty table stays empty; documents without doc_id, or that share one, are told apart by their texts, and only rows that repeat both share
their number and so their count; null texts are mixed as any other row. Other columns ride along whatever their names; columns of the input named as the two that are added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import columns, others

#: Sources up to which the rate table, one row a source, is broadcast; beyond it Spark joins it by shuffling.
BROADCAST_SOURCES = 10_000
#: The largest mean that one distribution is inverted for; a larger one is split into parts of this size and a rest, each with its own number.
PART = 16.0
TERMS = 80
HEX, UNIT = 13, float(1 << 52)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of the parts joined by a colon."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX), 16, 10).cast("double") / F.lit(UNIT)


def poisson_thresholds(mean: Column) -> Column:
    """The distribution function at 0, 1, ... :data:`TERMS` for a mean of at most :data:`PART`; beyond those terms it is 1 in double precision."""
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda k: k.cast("double")), zero, step)["cdf"]


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """One row per source: n, rate, and the thresholds of its full parts and of the rest."""
    if weights is not None and (any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0):
        raise ValueError("weights must be at least 0, and not all 0")
    sizes = docs.groupBy(columns([source_col])[0].alias("_source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        weight = F.pow("n", F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("w", weight)
    total = sizes.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    out = sizes.crossJoin(F.broadcast(total))  # one row
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.lit(float(epochs)) * F.col("all_n") / F.col("n")).otherwise(0.0)
    out = out.select("_source", "n", rate.alias("rate"))
    full = F.floor(F.col("rate") / PART).cast("int")
    out = out.withColumn("full", full).withColumn("rest", F.col("rate") - F.col("full") * PART)
    return out.withColumn("rest_cdf", poisson_thresholds(F.col("rest"))).withColumn("full_cdf", F.when(F.col("full") > 0, poisson_thresholds(F.lit(PART))))


def document_key(doc_id: Column, text: Column) -> Column:
    """What a document's numbers are hashed from, besides the seed."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def poisson_count(seed: int, key: Column) -> Column:
    """How many copies: per part, the thresholds that the part's number has reached."""
    reached = lambda cdf, u: F.size(F.filter(cdf, lambda c: c <= u))
    rest = reached(F.col("rest_cdf"), uniform(str(seed), key, "rest"))
    parts = F.aggregate(F.sequence(F.lit(1), F.col("full")), F.lit(0), lambda acc, k: acc + reached(F.col("full_cdf"), uniform(str(seed), key, k)))
    return rest + F.when(F.col("full") > 0, parts).otherwise(0)


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    alpha: float = 0.5,
    epochs: float = 1.0,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    partitions: int | None = None,
    copy_name: str = "copy",
    key_name: str = "shuffle_key",
) -> DataFrame:
    """``docs`` repeated to the target mix in a random order; ``copy_name`` counts a document's copies from 0, ``key_name`` is the order."""
    spark = docs.sparkSession
    kept = others(docs.columns, [copy_name, key_name])
    found = rates(docs, weights, alpha, epochs, source_col)
    few = docs.select(*columns([source_col])).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES if weights is None else len(weights) <= BROADCAST_SOURCES
    found = found.filter("rate > 0").select("_source", "full", "rest_cdf", "full_cdf")
    found = F.broadcast(found) if few else found
    # the document's own columns stay together, so that no name of theirs meets one of the plan's
    rows = docs.select(F.struct(*columns(kept)).alias("_row"), columns([source_col])[0].alias("_own"), document_key(columns([id_col])[0], columns([text_col])[0]).alias("_key"))
    rows = rows.join(found, F.col("_own").eqNullSafe(F.col("_source"))).withColumn("_count", poisson_count(seed, F.col("_key")))
    rows = rows.select("_row", "_key", F.explode(F.when(F.col("_count") > 0, F.sequence(F.lit(0), F.col("_count") - 1))).alias("_copy"))
    rows = rows.withColumn("_order", uniform(f"{seed}:order", F.col("_key"), F.col("_copy")))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "_order").sortWithinPartitions("_order")
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_copy").alias(copy_name), F.col("_order").alias(key_name))


def mix_sql(table: str = "documents", alpha: float = 0.5, epochs: float = 1.0, seed: int = 0) -> str:
    """DuckDB SQL for the rows of :func:`mix_sources` without given weights, for rates of at most :data:`PART`."""
    key = "coalesce(d.doc_id::varchar, 'null') || ':' || md5(coalesce(d.text, ''))"
    u = lambda *p: "(('0x' || substr(md5(concat_ws(':', " + ", ".join(p) + f")), 1, {HEX}))::BIGINT::DOUBLE / {UNIT})"
    return f"""
with recursive sizes as (select source as s, count(*)::double as n, pow(count(*)::double, {alpha}) as w from {table} group by source),
rated as (select s, w / (select sum(w) from sizes) * {float(epochs)} * (select sum(n) from sizes) / n as rate from sizes),
terms(s, rate, k, p, cdf) as (
  select s, rate, 0, exp(-rate), exp(-rate) from rated
  union all select s, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) from terms where k < {TERMS}),
counted as (
  select d.*, (select count(*) from terms t where t.s is not distinct from d.source and t.cdf <= {u(f"'{seed}'", key, "'rest'")}) as c from {table} d)
select doc_id, text, lang, source, n_chars, copy::int as copy, {u(f"'{seed}:order'", key, "copy::varchar")} as shuffle_key
from (select *, unnest(range(0, c)) as copy from counted) d
"""
