"""Connected components of an edge table without gathering it anywhere.

Each round every node offers its smallest known neighbour to the others (the alternating large-star and
small-star steps), which halves distances, and each task first reduces its edges to a spanning forest, of :data:`TASK_EDGES` edges at a time; where so few are left that one task holds them all, its forest is the answer. All
rounds read and write tables in the shared folder. Hub nodes are plain joins' keys, which Spark splits at run time, or partially summed minima.

Cases: no edges give no rows; loops, repeated edges and nulls are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import discard, written


#: Edges that a task reduces at once.
TASK_EDGES = 1 << 18


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars around the smallest node that connect what the given edges connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    left, right = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before, label)  # a merged root pulls what hangs on it
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def reduced() -> pa.RecordBatch:
        a, b = _forest(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    for batch in batches:
        if size and size + batch.num_rows > TASK_EDGES:
            yield reduced()
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if size:
        yield reduced()


def _stars(now: DataFrame) -> DataFrame:
    """(node, component) of edges that are stars around their smallest node."""
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that its links reach.

    ``edges`` has long columns a and b. The result is a written table.
    """
    schema = "a long, b long"
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_locally, schema), "cc")
    for _ in range(rounds):
        if now.limit(TASK_EDGES + 1).count() <= TASK_EDGES:
            few, now = now, written(now.coalesce(1).mapInArrow(_locally, schema), "cc")
            discard(few)
            return _stars(now)
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if not ends.where("out > 1 or (out > 0 and into > 0)").limit(1).count():  # all are stars whose centre points nowhere
            return _stars(now)
        # large star: every larger neighbour of u goes to the smallest that u knows
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).mapInArrow(_locally, schema), "cc")
        discard(now)
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
        now = written(small.where("a <> b").distinct().mapInArrow(_locally, schema), "cc")
        discard(large)
    raise RuntimeError("components did not settle")
