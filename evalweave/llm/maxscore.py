"""Exact top-k by inner product of integer weights with MaxScore over shards of postings.

A dimension is a term; a row's weight on it is floor(scale * x). A query's term d can add at most |q_d| times the largest weight of its sign
in a tile of the shard. Terms sorted by that bound split where the smaller bounds sum to less than the k-th best score so far: rows that only
they would raise can't get in. The essential terms' postings are traversed for the whole tile; the others are probed from the largest
bound down, and only for rows whose score so far plus the bounds still open reaches the threshold. The k-th best score goes on from tile to tile of a shard; shards merge by score and id.

Weights and scores below 2**53 are exact in double precision, in which tiles are multiplied; a query that could exceed that is scored in 64-bit integers.

Cases: vectors null, empty or with null, NaN or infinite components take no part; a shorter vector has weight 0 on the missing
dimensions; a repeated vec_id is a candidate row each time, and as a query one query with the smallest of its vectors; a query's own id is never a
candidate; ties go to the smaller vec_id; with fewer candidates than k all come back; negative scores are ordinary. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.blocks import ask, best, matrix, numbers, shard_rows, usable

#: Rows of a tile: its postings stay in the cache while a batch of queries goes by.
TILE_ROWS = 4096
SEEDS = 256
EXACT = float(1 << 53)


def maxscore(q: np.ndarray, own: int, postings: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, threshold: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a superset of the query's k best rows in the tile: all that reach the k-th best score, of the tile or as given."""
    bound = np.maximum(0, np.where(q > 0, q * high, q * low))
    terms = np.argsort(bound, kind="stable")
    if threshold is None:
        seeds = np.flatnonzero(ids[: SEEDS + k] != own)
        first = q @ postings[:, seeds]
        if len(first) < k:
            rows = np.flatnonzero(ids != own)
            return ids[rows], q @ postings[:, rows]
        threshold = np.partition(first, len(first) - k)[-k]
    # strictly below the threshold: a row that only meets these terms can't even tie
    open_bounds = np.cumsum(bound[terms])
    split = int(np.searchsorted(open_bounds, threshold, side="left")) if threshold > 0 else 0
    split = min(split, len(terms) - 1)
    essential = terms[split:]
    score = q[essential] @ postings[essential] if split else q @ postings
    rest = open_bounds[split - 1] if split else 0
    rows = np.flatnonzero((score + rest >= threshold) & (ids != own))
    score = score[rows]
    for at in range(split - 1, -1, -1):
        d = terms[at]
        score = score + q[d] * postings[d, rows]
        rest -= bound[d]
        if at % 4 == 0:
            keep = score + rest >= threshold
            rows, score = rows[keep], score[keep]
    if len(score) > k:
        threshold = max(threshold, np.partition(score, len(score) - k)[-k])
    keep = score >= threshold
    return ids[rows[keep]], score[keep]


def tiles(ids: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """ids, postings, and each term's largest and smallest weight, tile by tile."""
    by = np.argsort(ids, kind="stable")
    ids, weights = ids[by], weights[by]
    cut = [(ids[at : at + TILE_ROWS], np.ascontiguousarray(weights[at : at + TILE_ROWS].T)) for at in range(0, len(ids), TILE_ROWS)]
    return [(i, p, p.max(axis=1), p.min(axis=1)) for i, p in cut]


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = rows.count()
    shards = max(1, -(-n // shard_rows(n, spark.sparkContext.defaultParallelism)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    queries = queries.select("vec_id", "v", F.lit(1).alias("own"), numbers(shards).alias("shard"))

    def search(ready: list[tuple[np.ndarray, ...]], asked: np.ndarray, lists: pa.ListArray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        width = len(ready[0][1])
        wanted = matrix(lists, width)
        large = np.abs(np.concatenate([t[1] for t in ready], axis=1)).max(axis=1)
        exact = np.abs(wanted) @ large < EXACT
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in asked]
        for ids, postings, high, low in ready:
            for i, own in enumerate(asked.tolist()):
                q, p, h, lo = (wanted[i], postings, high, low) if exact[i] else (x.astype(np.int64) for x in (wanted[i], postings, high, low))
                got, value = held[i]
                found, score = maxscore(q, own, p, ids, h, lo, k, value[-1] if len(value) == k else None)
                found, score = np.concatenate([got, found]), np.concatenate([value.astype(score.dtype), score])
                top = np.lexsort((found, -score))[:k]
                held[i] = found[top], score[top]
        size = [len(f) for f, _ in held]
        columns = np.repeat(asked, size), np.concatenate([f for f, _ in held]), np.concatenate([s.astype(np.int64) for _, s in held])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return best(ask(rows, queries, shards, tiles, search, "query_id long, vec_id long, score long"), k)


def top_k_sql(every: int = 100, k: int = 10, scale: int = 1024) -> str:
    """DuckDB SQL for the rows of :func:`top_k` on vectors of one length with distinct ids."""
    return f"""
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as w from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.w, c.w)::bigint as score
  from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % {every} = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored)
select query_id, r::int as rank, vec_id, score from ranked where r <= {k}
"""
