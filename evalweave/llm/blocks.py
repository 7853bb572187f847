"""A stated query set against all rows: a task holds one shard of rows, and queries stream past it in batches.

A row lies in one shard and moves once; a query moves once a shard that it is asked of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import columns, small_batches

#: Rows of a shard at most and, where tasks are fewer than cores, at least.
SHARD_ROWS = 32_768
LEAST_ROWS = 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """(vec_id, v) as doubles: rows with an id and a vector without null, NaN or infinite components."""
    own, vector = columns([id_col, vector_col])
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(own.cast("long").alias("vec_id"), vector.cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(fine)
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def shard_rows(n: int, cores: int) -> int:
    """Rows a shard: large ones, as queries move once a shard, but enough shards for all cores."""
    return max(LEAST_ROWS, min(SHARD_ROWS, -(-n // max(1, 2 * cores))))


def numbers(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def matrix(lists: pa.ListArray, width: int | None = None, kind: type = np.float64) -> np.ndarray:
    """One row per list, short ones filled with 0, long ones cut at ``width`` if that is given."""
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    flat = lists.flatten().to_numpy()
    if len(lists) and (lengths == width).all():
        return flat.reshape(-1, width).astype(kind, copy=False)
    out = np.zeros((len(lists), width), dtype=kind)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def ask(rows: DataFrame, queries: DataFrame, shards: int, prepare: Callable, answer: Callable, schema: str) -> DataFrame:
    """``answer(prepare(ids, vectors), ids, vectors, own)`` for each shard's rows and each batch of the queries that are asked of it.

    ``rows`` has shard, vec_id, v; ``queries`` also own, the number of rows with the query's id.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["v"].dataType.simpleString()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, ready = None, [], [], None
        for batch in batches:
            key = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("query").to_numpy()
            cuts = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)] if len(key) else []
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(first, last - first)
                if shard != int(key[first]) // 2:
                    shard, ids, vectors, ready = int(key[first]) // 2, [], [], None
                if not key[first] % 2:
                    ids.append(part.column("vec_id"))
                    vectors.append(part.column("v"))
                elif ids:
                    if ready is None:
                        ready = prepare(pa.concat_arrays(ids).to_numpy(zero_copy_only=False), matrix(pa.concat_arrays(vectors)))
                        vectors = []
                    yield from answer(ready, part.column("vec_id").to_numpy(), part.column("v"), part.column("own").to_numpy())

    every = rows.select("shard", F.lit(0).alias("query"), "vec_id", F.col("v").cast(kind).alias("v"), F.lit(0).cast("long").alias("own"))
    every = every.unionByName(queries.select("shard", F.lit(1).alias("query"), "vec_id", "v", F.col("own").cast("long").alias("own")))
    return every.repartition(2 * shards, "shard").sortWithinPartitions("shard", "query", "vec_id").mapInArrow(asked, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query_id, ties to the smaller vec_id; Spark keeps k per task and query before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
