"""Scans and sinks for row sets: JSON lines, CSV, Parquet, run folders, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None, ordinal: str = "ord") -> DataFrame:
    """One object per line, blank lines skipped; the ordinal rises with the place in the input."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path).withColumn(ordinal, F.monotonically_increasing_id())


def write_json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Null fields are left out of their object."""
    rows.write.mode(mode).option("ignoreNullFields", True).json(path)


def read_json_document(spark: SparkSession, path: str, rows_under: tuple[str, ...] = ("data", "examples")) -> DataFrame:
    """A pretty-printed object or array; rows below one of the named keys are unpacked."""
    found = spark.read.option("multiLine", True).json(path)
    for key in rows_under:
        if key in found.columns:
            return found.select(F.explode(key).alias("r")).select("r.*")
    return found


def write_csv(frames: list[DataFrame], path: str, mode: str = "errorifexists") -> None:
    """One header: the union of the columns in the order in which they first occur."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, typed: dict[str, str] | None = None) -> DataFrame:
    """Text columns; named ones cast, with the empty text as null."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns})
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")).try_cast(t) for c, t in (typed or {}).items()})


def read_any(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """By suffix: jsonl, json, csv, parquet; one split if there is such a column."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1]
    readers = {"jsonl": lambda: read_json_lines(spark, path), "json": lambda: read_json_document(spark, path), "csv": lambda: read_csv(spark, path), "parquet": lambda: spark.read.parquet(path)}
    if suffix not in readers:
        raise ValueError(f"no reader for .{suffix}")
    rows = readers[suffix]()
    return rows.where(F.col("split") == split) if split is not None and "split" in rows.columns else rows


def discover_runs(spark: SparkSession, folder: str, metrics: str = "metrics.json", traces: str = "traces.jsonl", skip: str = "smoke") -> DataFrame:
    """(run, metrics columns) of the runs that have traces: one scan over the folders, the run's name from the file's path."""
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    found = spark.read.option("multiLine", True).json(f"{folder}/*/{metrics}").select(run.alias("run"), "*")
    traced = spark.read.text(f"{folder}/*/{traces}").select(run.alias("run")).distinct()
    return found.where(~F.contains("run", F.lit(skip))).join(traced, "run", "left_semi")


def content_digest(rows: DataFrame) -> DataFrame:
    """(rows, digest): independent of row order and partitioning; sums the row digests' leading bits."""
    d = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    part = F.conv(F.substring(d, 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A report of at most ``limit`` rows as Markdown."""
    head = rows.columns
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows.limit(limit).collect()])


def write_report(rows: DataFrame, path: str) -> None:
    """A report of one row as a pretty-printed object, its fields sorted, in whatever store the path names."""
    if rows.limit(2).count() != 1:
        raise ValueError("a report has one row")
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"pretty": "true"})).coalesce(1).write.text(path)
