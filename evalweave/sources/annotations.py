"""Adapters from annotation files to samples with normalised boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.boxes import box, normalised


def xywh(b: Column) -> Column:
    return box(b[0], b[1], b[0] + b[2], b[1] + b[3])


def token_regions(images: DataFrame, annotations: DataFrame, least_area: float = 0.0, most: int | None = None) -> DataFrame:
    """One row per image with its tokens in annotation order: ``array<struct<text, box>>``.

    images: image_id, width, height; annotations: ann_id, image_id, bbox [x, y, w, h], text, area.
    """
    kept = annotations.where((F.col("area") >= least_area) & F.col("text").isNotNull())
    joined = kept.join(images.select("image_id", "width", "height"), "image_id")
    b = normalised(xywh(F.col("bbox")), F.col("width"), F.col("height"))
    tokens = joined.select("image_id", F.struct(F.col("ann_id"), F.col("text"), b.alias("box")).alias("t")).where("t.box is not null")
    out = tokens.groupBy("image_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    ts = F.slice("ts", 1, most) if most else F.col("ts")
    return out.select("image_id", F.transform(ts, lambda t: F.struct(t["text"].alias("text"), t["box"].alias("box"))).alias("tokens"))


def instance_index(images: DataFrame, categories: DataFrame, annotations: DataFrame, least_area: float = 0.0) -> DataFrame:
    """(image_id, file_name, category, box, area): no crowds, no small areas."""
    rows = annotations.where((F.coalesce(F.col("iscrowd"), F.lit(0)) == 0) & (F.col("area") >= least_area))
    rows = rows.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id")
    rows = rows.join(images.select(F.col("id").alias("image_id"), "file_name", "width", "height"), "image_id")
    return rows.select("image_id", "file_name", "category", normalised(xywh(F.col("bbox")), F.col("width"), F.col("height")).alias("box"), "area").where("box is not null")


def caption_options(rows: DataFrame, options: str, identifier: str) -> DataFrame:
    """One row per caption option; the first is the right one."""
    out = rows.select("*", F.posexplode(options).alias("option", "caption")).drop(options)
    return out.withColumn("answer", F.col("option") == 0).withColumn("group_id", F.col(identifier)).withColumn(identifier, F.concat_ws(":", F.col(identifier), F.col("option").cast("string")))
