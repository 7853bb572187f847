"""Records of unknown shape as VARIANT: samples with evidence boxes from many layouts, and nested reports as flat rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.boxes import bound, box, distinct_boxes, normalised
from evalweave.functions.geometry import parsed_box
from evalweave.functions.relations import allowed, normal_relation, parse_caption

#: Fields that hold evidence, the first filled one counts; fields of a box, and of a polygon; keys that hold the rows of a document.
REGION_FIELDS = ["evidence_regions", "evidence_bboxes", "answer_bboxes", "grounding_bboxes", "ocr_regions", "ocr_bboxes", "ocr_boxes", "ocr_tokens"]
BOX_FIELDS = ["bbox", "box", "region", "rect", "bounds"]
POLYGON_FIELDS = ["points", "polygon", "vertices"]
ROW_KEYS = ["data", "examples", "samples", "annotations"]


def get(record: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path, as a type; null where there is none, or it doesn't fit."""
    return F.try_variant_get(record, path, kind)


def first_of(record: Column, names: list[str], kind: str = "variant") -> Column:
    """The first of the named fields that the record has."""
    found = [get(record, f"$.{n}") for n in names]
    return F.try_variant_get(F.coalesce(*found), "$", kind)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(ord, record): the objects of a JSON-lines file, blank lines skipped, or of a .json document that is an array or has one below one of :data:`ROW_KEYS`. Lines that aren't JSON are an error."""
    if path.rstrip("/").endswith(".jsonl"):
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "^﻿", "").alias("value"))
        return lines.where(F.trim("value") != "").select("ord", F.parse_json("value").alias("record"))
    whole = spark.read.text(path, wholetext=True).select(F.parse_json(F.regexp_replace("value", "^﻿", "")).alias("v"))
    rows = F.coalesce(get(F.col("v"), "$", "array<variant>"), *[get(F.col("v"), f"$.{k}", "array<variant>") for k in ROW_KEYS])
    rows = F.coalesce(rows, F.raise_error(F.lit("neither an array nor an object with rows")).cast("array<variant>"))
    return whole.select(F.posexplode(rows).alias("ord", "record"))


def _filled(value: Column) -> Column:
    """The items of a list or the values of an object; an empty array for other values that say something, null for those that don't."""
    none = F.array().cast("array<variant>")

    def read(items: Column, fields: Column) -> Column:
        plain = F.when(items.isNull() & fields.isNull(), F.try_variant_get(value, "$", "string"))
        return F.when(F.size(items) > 0, items).when(F.size(fields) > 0, F.map_values(fields)).when(plain.isNotNull() & ~plain.isin("", "0", "false"), none)

    found = bound(F.try_variant_get(value, "$", "array<variant>"), lambda items: bound(F.try_variant_get(value, "$", "map<string,variant>"), lambda fields: read(items, fields)))
    return F.when(value.isNotNull(), found)


def _points_box(points: Column) -> Column:
    """The bounds of points that are pairs or objects with x and y; others are passed over, and fewer than two give none."""
    x = lambda p: F.coalesce(F.try_variant_get(p, "$[0]", "double"), F.try_variant_get(p, "$.x", "double"), F.try_variant_get(p, "$.X", "double"))
    y = lambda p: F.coalesce(F.try_variant_get(p, "$[1]", "double"), F.try_variant_get(p, "$.y", "double"), F.try_variant_get(p, "$.Y", "double"))
    pairs = F.filter(F.transform(F.try_variant_get(points, "$", "array<variant>"), lambda p: F.struct(x(p).alias("x"), y(p).alias("y"))), lambda s: s["x"].isNotNull() & s["y"].isNotNull())
    return bound(pairs, lambda ps: F.when(F.size(ps) >= 2, box(F.array_min(ps["x"]), F.array_min(ps["y"]), F.array_max(ps["x"]), F.array_max(ps["y"]))))


def _plain_box(value: Column) -> Column:
    """Four numbers, an object of corners or of a corner and a size, pairs of corners, or text with four numbers."""
    every = lambda cs: ~F.greatest(*[c.isNull() for c in cs])
    xywh = lambda v: box(v[0], v[1], v[0] + v[2], v[1] + v[3])

    def read(list_: Column, object_: Column) -> Column:
        four = [F.get(list_, F.lit(i)) for i in range(4)]
        corners, sized, wide = ([object_[n] for n in names] for names in (("x1", "y1", "x2", "y2"), ("x", "y", "w", "h"), ("x", "y", "width", "height")))
        text = F.when(list_.isNull() & object_.isNull(), F.try_variant_get(value, "$", "string"))
        return F.when(every(four), box(*four)).when(every(corners), box(*corners)).when(every(sized), xywh(sized)).when(every(wide), xywh(wide)).when(text.isNotNull(), parsed_box(text)).otherwise(_points_box(value))

    # all numbers by two casts, as each path would search the value anew
    names = ", ".join(f"{n} double" for n in ("x1", "y1", "x2", "y2", "x", "y", "w", "h", "width", "height"))
    return bound(F.try_variant_get(value, "$", "array<double>"), lambda list_: bound(F.try_variant_get(value, "$", f"struct<{names}>"), lambda object_: read(list_, object_)))


def region_box(item: Column) -> Column:
    """The box of a region in any of its layouts: a plain box, an object with a box below one of BOX_FIELDS or with a polygon below one of POLYGON_FIELDS; null where it has none."""
    fields = F.try_variant_get(item, "$", f"struct<{', '.join(f'{n} variant' for n in [*BOX_FIELDS, *POLYGON_FIELDS])}>")
    polygon = lambda f: F.coalesce(*[F.when(f[n].isNotNull(), _points_box(f[n])) for n in POLYGON_FIELDS])
    found = lambda f, inner: F.when(inner.isNotNull(), _plain_box(inner)).otherwise(F.coalesce(polygon(f), _plain_box(item)))
    return bound(fields, lambda f: bound(F.coalesce(*[f[n] for n in BOX_FIELDS]), lambda inner: found(f, inner)))


def image_size(record: Column) -> Column:
    """struct<width, height> from width and height, their image_ forms, or the two numbers of image_size; null unless both are above 0."""
    side = lambda name, at: F.coalesce(first_of(record, [name, f"image_{name}"], "double"), get(record, f"$.image_size[{at}]", "double"))
    w, h = side("width", 0), side("height", 1)
    return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))


def region_samples(records: DataFrame, dataset: str = "OCR-Regions", image_root: str | None = None, record: str = "record", order: str = "ord") -> DataFrame:
    """A row per record: id, dataset, source_dataset, image, image_id, question, answer, task_family, bbox_source, evidence_regions, evidence_region_count, width, height.

    Regions are the boxes of the first filled field of :data:`REGION_FIELDS`, in 0..1, each once; pixel boxes need the image's size. Missing texts are empty; the first of several answers counts; a record without an id is named by its place.
    """
    r = F.col(record)
    text = lambda *names: F.trim(F.coalesce(first_of(r, list(names), "string"), F.lit("")))
    image = text("image", "image_path", "file_name", "filename")
    if image_root:
        image = F.when((image != "") & ~F.startswith(image, F.lit("/")), F.concat(F.lit(image_root.rstrip("/") + "/"), image)).otherwise(image)
    answer = first_of(r, ["answer", "answers", "label"])
    several = F.try_variant_get(answer, "$", "array<variant>")
    said = F.when(several.isNotNull(), F.try_variant_get(answer, "$[0]", "string")).otherwise(F.try_variant_get(answer, "$", "string"))
    items = F.coalesce(*[bound(get(r, f"$.{f}"), _filled) for f in REGION_FIELDS], F.array().cast("array<variant>"))
    size = image_size(r)
    boxes = lambda z: F.transform(items, lambda i: bound(region_box(i), lambda b: F.when(b.isNotNull(), normalised(b, z["width"], z["height"]))))
    regions = bound(size, lambda z: distinct_boxes(F.filter(boxes(z), lambda b: b.isNotNull())))
    rows = records.select(
        F.coalesce(first_of(r, ["id", "sample_id"], "string"), F.concat(F.lit("ocr-region-"), F.col(order).cast("string"))).alias("id"), F.coalesce(F.nullif(get(r, "$.dataset", "string"), F.lit("")), F.lit(dataset)).alias("dataset"), F.lit(dataset).alias("source_dataset"),
        image.alias("image"), F.coalesce(get(r, "$.image_id", "string"), F.lit("")).alias("image_id"), text("question", "query", "prompt").alias("question"), F.coalesce(said, F.lit("")).alias("answer"), F.lit("ocr_text").alias("task_family"),
        regions.alias("evidence_regions"), size.alias("_size"),
    )
    return rows.select("*", F.when(F.size("evidence_regions") > 0, "ocr_regions").otherwise("none").alias("bbox_source"), F.size("evidence_regions").alias("evidence_region_count"), "_size.width", "_size.height").drop("_size")


def flattened(reports: DataFrame, keys: list[str], report: str = "report", deepest: int = 64) -> DataFrame:
    """(keys, path, value): a row for every value of a report that is neither a list nor an object, whatever the report's shape; empty ones have no rows.

    A path joins names by full stops and adds places as [i]. Each level is one explosion of what the level before left nested; the number of levels comes from the data, an error beyond ``deepest``. ``value`` is the value's text, null for a null.
    """
    nested = lambda c: F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)<")
    level = reports.select(*keys, F.lit("").alias("path"), F.col(report).alias("_v")).where("_v is not null")
    leaves = []
    for _ in range(deepest):
        leaves.append(level.where(~nested(F.col("_v"))).select(*keys, "path", F.try_variant_get(F.col("_v"), "$", "string").alias("value")))
        level = level.where(nested(F.col("_v")))
        if not level.limit(1).count():
            out = leaves[0]
            for more in leaves[1:]:
                out = out.unionByName(more)
            return out
        joined = F.when(F.col("_name").isNull(), F.concat(F.col("path"), F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("_name")).otherwise(F.concat("path", F.lit("."), "_name"))
        step = level.lateralJoin(reports.sparkSession.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_name", "_inner"))
        level = step.select(*keys, joined.alias("path"), F.col("_inner").alias("_v"))
    raise ValueError(f"a report of more than {deepest} levels")


def report_rows(reports: DataFrame, keys: list[str], path: str, levels: list[str], fields: dict[str, str], report: str = "report") -> DataFrame:
    """A row per entry ``levels`` deep below ``path``: the levels' names or 1-based places as columns, and the named fields as the given types.

    Curves by risk are levels ["risk", "place"], intervals ["risk", "metric"], cases ["category", "rank"]. An entry that isn't nested deep enough has no row.
    """
    rows = reports.select(*keys, get(F.col(report), path).alias("_v"))
    for i, name in enumerate(levels):
        step = rows.where("_v is not null").lateralJoin(reports.sparkSession.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_name", "_inner"))
        rows = step.select(*keys, *levels[:i], F.coalesce("_name", (F.col("_pos") + 1).cast("string")).alias(name), F.col("_inner").alias("_v"))
    return rows.select(*keys, *levels, *[get(F.col("_v"), f"$.{f}", kind).alias(f) for f, kind in fields.items()])


def caption_samples(records: DataFrame, source: str, split: str, left_right_only: bool = True, relations: list[str] | None = None, families: list[str] | None = None, record: str = "record", order: str = "ord") -> DataFrame:
    """Image captions that are true or false, as yes/no samples of the relation that they state; records whose caption states none, or one that isn't allowed, go.

    The relation is parsed from the caption, by the phrases of the record's own relation where it names one. Images are named, not fetched. Labels are booleans, numbers other than 0, or one of 1, true, yes, y.
    """
    r = F.col(record)
    text = lambda *names: F.trim(F.coalesce(first_of(r, list(names), "string"), F.lit("")))
    rows = records.select(r.alias("_r"), F.col(order).alias("_o"), text("caption", "sentence", "text").alias("source_caption"), text("relation").alias("source_relation"), text("image", "image_id", "image_file").alias("image_id"), text("image_link", "url").alias("image_url"))
    # one phrase after another, bound to a lambda: as a plain expression it would be compiled again at each use, beyond what a method can hold
    parsed = bound(F.struct("source_caption", normal_relation(F.col("source_relation")).alias("hint")), lambda s: parse_caption(s["source_caption"], s["hint"]))
    rows = rows.withColumn("_p", parsed).where("_p is not null").withColumn("relation", normal_relation(F.col("_p.relation")))
    keep = allowed(F.col("relation"), relations, families)
    rows = rows.where(keep & F.col("relation").isin("left_of", "right_of") if left_right_only else keep)
    label = F.lower(F.trim(F.coalesce(first_of(F.col("_r"), ["label", "answer", "target"], "string"), F.lit("false"))))
    number = F.schema_of_variant(first_of(F.col("_r"), ["label", "answer", "target"])).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    true = F.when(F.coalesce(number, F.lit(False)), label.try_cast("double") != 0).otherwise(label.isin("1", "true", "yes", "y"))
    safe = re.sub(r"^-+|-+$", "", "".join(c if c.isalnum() else "-" for c in source.lower()))
    return rows.withColumn("_t", true).select(
        F.concat(F.lit(f"vsr-{safe}-{split}-"), F.col("_o").cast("string")).alias("id"), F.lit("VSR").alias("dataset"), F.lit(source).alias("source_dataset"), F.lit(split).alias("split"), F.col("image_id").alias("image"), "image_id", "image_url",
        F.concat(F.lit("Is this statement true? "), F.col("source_caption")).alias("question"), "source_caption", "source_relation", F.col("_p.subject").alias("subject"), F.col("_p.object").alias("object"), "relation",
        F.when(F.col("_t"), "yes").otherwise("no").alias("answer"), F.when(F.col("_t"), "positive").otherwise("negative").alias("binary_polarity"), F.lit("none").alias("bbox_source"), get(F.col("_r"), "$.reference_frame", "string").alias("reference_frame"),
    )


def export_box(item: Column, export: Column, source: Column, xywh: bool = True) -> Column:
    """struct<x, y, w, h> of an external box item (a VARIANT) in the pixels of an exported image, to two digits; null for an item without four numbers or without an area inside.

    Items are objects with x, y, w, h or with corners, objects with a box or a polygon below a field, or lists of four numbers: a corner and a size (``xywh``) or two corners. Numbers up to 1.5 are shares of the image; others are pixels of the ``source`` image, or of the
    export where its size isn't known. Sizes are struct<width, height>.
    """
    inner = F.coalesce(*[F.try_variant_get(item, f"$.{n}", "variant") for n in BOX_FIELDS if n != "region"])
    polygon = F.coalesce(*[F.try_variant_get(item, f"$.{n}", "variant") for n in POLYGON_FIELDS])
    at = lambda v, *names: [F.try_variant_get(v, f"$.{n}" if isinstance(n, str) else f"$[{n}]", "double") for n in names]
    every = lambda cs: ~F.greatest(*[c.isNull() for c in cs])
    corners = lambda cs: box(cs[0], cs[1], cs[2], cs[3])
    sized = lambda cs: box(cs[0], cs[1], cs[0] + cs[2], cs[1] + cs[3])
    most = lambda cs: F.greatest(*map(F.abs, cs))
    parsed = lambda b, top: F.struct(b.alias("b"), (top <= 1.5).alias("share"))

    def plain(v: Column) -> Column:
        one, two, four = at(v, "x", "y", "w", "h"), at(v, "x1", "y1", "x2", "y2"), at(v, 0, 1, 2, 3)
        return F.when(every(one), parsed(sized(one), most(one))).when(every(two), parsed(corners(two), most(two))).when(every(four), parsed(sized(four) if xywh else corners(four), most(four)))

    own = bound(plain(item), lambda p: p)
    bounds = bound(_points_box(polygon), lambda b: F.when(b.isNotNull(), parsed(b, most([b[c] for c in ("x1", "y1", "x2", "y2")]))))
    found = F.coalesce(own, F.when(inner.isNotNull(), bound(inner, plain)), bounds)
    ew, eh = export["width"].cast("double"), export["height"].cast("double")
    sx, sy = (F.coalesce(F.nullif(source[n].cast("double"), F.lit(0.0)), e) for n, e in (("width", ew), ("height", eh)))

    def scaled(p: Column) -> Column:
        fx, fy = F.when(p["share"], ew).otherwise(ew / sx), F.when(p["share"], eh).otherwise(eh / sy)
        x1, x2, y1, y2 = p["b"]["x1"] * fx, p["b"]["x2"] * fx, p["b"]["y1"] * fy, p["b"]["y2"] * fy
        clip = lambda v, top: F.greatest(F.lit(0.0), F.least(top, v))
        x, y = clip(F.least(x1, x2), ew), clip(F.least(y1, y2), eh)
        w, h = clip(F.abs(x2 - x1), ew - x), clip(F.abs(y2 - y1), eh - y)
        return F.when((w > 0) & (h > 0), F.struct(*[F.round(v, 2).alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))]))

    return F.when((ew > 0) & (eh > 0), bound(found, lambda p: F.when(p.isNotNull(), scaled(p))))


def relabelled(splits: dict[str, DataFrame], prefix: str, constants: dict[str, object], key: str = "id") -> DataFrame:
    """The rows of all splits, with their split, ids behind a prefix and the split's name, and constant columns over what the rows say; a column that some splits lack is null there."""
    out = None
    for name, rows in splits.items():
        own = rows.withColumn("split", F.lit(name)).withColumn(key, F.concat_ws("-", F.lit(prefix), F.lit(name), F.col(key).cast("string"))).withColumns({c: F.lit(v) for c, v in constants.items()})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
