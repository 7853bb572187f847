"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (``sample`` rows of smallest id hash): the exact neighbour graph of the sample, its balanced partition into
parts that cuts few edges, and a small classifier that learns, for a vector, over which parts its neighbours spread. Index: the classifier puts every row
into its most probable part. Search: a query goes to a ``share`` of the parts, its most probable ones, and to further ones until they hold k rows besides its own, and every row there is ranked by its true
inner product in double precision, summed from the first component to the last.

There are about :data:`PART_ROWS` rows a part, but no more parts than the sample can teach; a part is dealt in shards of bounded size, so a part that gathers a third of all rows is many tasks. Equal vectors of a shard are compared once.

Cases: vectors null, empty, zero or with null, NaN or infinite components take no part; a shorter vector counts as 0 on the missing
components, and the classifier looks at the components that the longest vector of the sample has; a repeated vec_id is a candidate row each time and one query, with the smallest of its vectors;
a query's own id is never a candidate; ties go to the smaller vec_id, however many rows tie; fewer candidates than k all come back; empty input gives no row. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.blocks import ask, best, matrix, shard_rows, usable
from evalweave.llm.common import discard, list_column, ragged, written

SAMPLE = 4096
#: Parts: about one for so many rows, between the least and the most that the sample can teach.
PART_ROWS = 2048
LEAST_PARTS, MOST_PARTS = 32, 128
#: Share of the parts that a query goes to.
SHARE = 26 / 32
NEIGHBOURS = 10
#: Queries that are ranked at a time.
QUERY_ROWS = 256


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product for each row."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each vertex, none above its share by more than ``slack``: parts grow along edges, then vertices move to where most of their neighbours are while there is room."""
    n = len(near)
    room = int(np.ceil(n / parts * slack))
    links: list[list[int]] = [list(r) for r in near.tolist()]
    for i, row in enumerate(near.tolist()):
        for j in row:
            links[j].append(i)
    label, size = [-1] * n, [0] * parts
    for seed in rng.permutation(n).tolist():
        if label[seed] >= 0:
            continue
        part = min(range(parts), key=size.__getitem__)  # the emptiest part grows on from here
        queue, head = [seed], 0
        while head < len(queue) and size[part] * parts < n:
            i, head = queue[head], head + 1
            if label[i] < 0:
                label[i] = part
                size[part] += 1
                queue.extend(j for j in links[i] if label[j] < 0)
        if label[seed] < 0:
            label[seed] = part
            size[part] += 1
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n).tolist():
            count: dict[int, int] = {}
            for j in links[i]:
                count[label[j]] = count.get(label[j], 0) + 1
            own = label[i]
            to = max(count, key=lambda p: (count[p] if p == own or size[p] < room else -1, p == own), default=own)
            if to != own and size[to] < room and count[to] > count.get(own, 0):
                size[own] -= 1
                size[to] += 1
                label[i] = to
                moved += 1
        if moved < n // 200:
            break
    return np.array(label)


class Router:
    """A network of one hidden layer that gives the log odds of each part for a vector."""

    def __init__(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 64, steps: int = 200, rate: float = 0.01):
        self.scale = 1 / max(1e-12, float(np.sqrt((x**2).sum(axis=1).mean())))
        d, p = x.shape[1], target.shape[1]
        self.w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, p)), np.zeros(p)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), min(512, len(x)))
            own, want = x[at] * self.scale * np.sqrt(d), target[at]
            h = np.maximum(0, own @ self.w[0] + self.w[1])
            odds = h @ self.w[2] + self.w[3]
            e = np.exp(odds - odds.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - want) / len(at)
            gh = (g @ self.w[2].T) * (h > 0)
            for k, grad in enumerate((own.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                grad = grad + 1e-4 * self.w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        own = x * self.scale * np.sqrt(x.shape[1])
        # component by component: equal vectors get equal odds wherever they stand in a batch
        h = np.tile(self.w[1], (len(own), 1))
        for d in range(own.shape[1]):
            h += own[:, d : d + 1] * self.w[0][d]
        h = np.maximum(0, h)
        out = np.tile(self.w[3], (len(own), 1))
        for d in range(h.shape[1]):
            out += h[:, d : d + 1] * self.w[2][d]
        return out


def fit(x: np.ndarray, parts: int = LEAST_PARTS, seed: int = 0) -> Router:
    rng = np.random.default_rng(seed)
    near = neighbour_graph(x, NEIGHBOURS)
    label = balanced_parts(near, parts, rng)
    target = np.zeros((len(x), parts))
    target[np.arange(len(x)), label] += 1
    for c in range(near.shape[1]):
        np.add.at(target, (np.arange(len(x)), label[near[:, c]]), 1)
    return Router(x, target / target.sum(axis=1, keepdims=True), rng)


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct vectors, where each one's ids begin, and the ids, ascending within a vector."""
    odd = np.random.default_rng(0).integers(0, 1 << 63, x.shape[1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    hashed = (np.ascontiguousarray(x).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
    by = np.lexsort((ids, hashed))
    x, ids, hashed = x[by], ids[by], hashed[by]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    return x[fresh], np.append(np.flatnonzero(fresh), len(ids)), ids


def nearest(ready: tuple[np.ndarray, ...], asked: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k best rows of a shard for each of some queries, no id of which has more than ``own`` rows."""
    x, starts, ids = ready
    wanted = k + own  # so many vectors hold k ids besides the query's own
    rough = q @ x.T
    if len(x) > wanted:
        least = np.partition(rough, len(x) - wanted, axis=1)[:, -wanted]
        slack = 1e-12 * np.sqrt((x**2).sum(axis=1).max(initial=0.0)) * np.sqrt((q**2).sum(axis=1))
        at, near = np.nonzero(rough >= (least - slack)[:, None])
    else:
        at, near = (z.ravel() for z in np.indices(rough.shape))
    score = np.zeros(len(at))
    for d in range(x.shape[1]):
        score += x[near, d] * q[at, d]
    size = np.minimum(starts[near + 1] - starts[near], wanted)
    found, at, score = ids[ragged(starts[near], size)], np.repeat(at, size), np.repeat(score, size)
    other = found != asked[at]
    found, at, score = found[other], at[other], score[other]
    by = np.lexsort((found, -score, at))
    found, at, score = found[by], at[by], score[by]
    place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
    top = place < k
    return asked[at[top]], found[top], score[top]


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, parts: int | None = None, share: float = SHARE, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, nonzero=True)
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow()["v"].combine_chunks()
    taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(taken):
        return spark.createDataFrame([], schema)
    known = matrix(taken)
    n, width = rows.count(), known.shape[1]
    parts = max(LEAST_PARTS, min(MOST_PARTS, n // PART_ROWS)) if parts is None else parts
    probes = max(1, round(share * parts))
    router = fit(known, parts)

    def routed(batches):
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-router.odds(matrix(batch.column("v"), width)), axis=1, kind="stable").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, list_column(order.ravel(), np.full(len(order), parts), pa.int32())], names=["vec_id", "v", "parts"])

    index = written(rows.mapInArrow(routed, "vec_id long, v array<double>, parts array<int>"), "index")
    sizes = dict(index.groupBy(F.col("parts")[0].alias("p")).count().collect())  # one row a part
    held = shard_rows(n, spark.sparkContext.defaultParallelism)
    blocks = [max(1, -(-int(sizes.get(p, 0)) // held)) for p in range(parts)]
    first = [sum(blocks[:p]) for p in range(parts)]
    literal = lambda values: F.array(*[F.lit(int(v)) for v in values])
    size_of, blocks_of, first_of = literal([sizes.get(p, 0) for p in range(parts)]), literal(blocks), literal(first)
    part = F.col("parts")[0]
    filed = index.select("vec_id", "v", (first_of[part] + F.pmod(F.xxhash64("vec_id", "v"), blocks_of[part])).cast("int").alias("shard"))
    queries = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "parts")).alias("s"), F.count(F.lit(1)).alias("own")).select("vec_id", "s.v", "s.parts", "own")
    before = F.aggregate(F.slice("parts", 1, F.col("at")), F.lit(0).cast("long"), lambda acc, p: acc + size_of[p])
    # the number of parts before this one: probe it while those are few or hold too little
    wanted = queries.select("vec_id", "v", "parts", "own", F.posexplode("parts").alias("at", "part")).where((F.col("at") < probes) | (before < k + F.col("own")))
    wanted = wanted.select("vec_id", "v", "own", F.explode(F.sequence(first_of[F.col("part")], first_of[F.col("part")] + blocks_of[F.col("part")] - 1)).alias("shard"))

    def rank(ready: tuple[np.ndarray, ...], asked: np.ndarray, lists: pa.ListArray, own: np.ndarray):
        q = matrix(lists, ready[0].shape[1])
        for at in range(0, len(q), QUERY_ROWS):
            most = int(own[at : at + QUERY_ROWS].max())
            found = nearest(ready, asked[at : at + QUERY_ROWS], q[at : at + QUERY_ROWS], most, k)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    out = written(best(ask(filed, wanted, sum(blocks), distinct_rows, rank, "query_id long, vec_id long, score double"), k), "nearest")
    discard(index)
    return out
