"""Shared folders, written intermediate tables and Arrow helpers of the corpus operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a single longer text makes a step of its own.
STEP_BYTES = 1 << 20


#: Bytes of rows that Spark hands to Python at a time; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as texts differ too much in length for a bound on rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", spark.conf.get(key) or "") or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where nobody set it, a folder of this machine serves a session in one process; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            return jvm.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more, and let Spark's cleaner find the shuffle files that only they needed."""
    if tables:
        tables[0].sparkSession._jvm.System.gc()
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(base: str, taken: list[str]) -> str:
    """A column name that isn't taken; Spark compares names without case."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def others(names: list[str], outputs: list[str]) -> list[str]:
    """The names that no output replaces; Spark compares names without case."""
    low = {c.lower() for c in outputs}
    return [c for c in names if c.lower() not in low]


def columns(names: list[str]) -> list:
    """The named columns, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def steps(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column, each of about ``step_bytes`` at most or one row."""
    n = len(column)
    if not n:
        return
    width = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if width else np.int32)[column.offset : column.offset + n + 1]
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + step_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... for counts[0] of them, then those of the next range, and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
