"""Incremental scoring: arrivals from a folder, each key scored once, progress kept in a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def run_incremental(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], key: str) -> None:
    """Score what has newly arrived in ``source`` (JSON lines) and add it to ``target`` (Parquet, a folder a batch), without keys that are done.

    The checkpoint holds the files that were read and, in the state store, the keys that were seen, a task's keys in its own partition; so a batch touches the keys that it brings and never reads the target. A replayed batch writes its own folder anew.
    """
    def one(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).json(source).dropDuplicates([key]).writeStream.foreachBatch(one)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def shard(rows: DataFrame, ordinal: str, start: int, end: int) -> DataFrame:
    """Rows whose ordinal lies in [start, end)."""
    return rows.where((rows[ordinal] >= start) & (rows[ordinal] < end))
