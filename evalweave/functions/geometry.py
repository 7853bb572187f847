"""Regions of evidence: parsing, overlap of whole sets, provenance, tiles, relevance of places; boxes as in :mod:`evalweave.functions.boxes`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.functions.boxes import area, bound, box, clipped, distinct_boxes, normalised, overlap, token_grid, union_area

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"

#: Fields that may hold a sample's evidence, in order of precedence, and those of a role's own box.
REGION_FIELDS = ["evidence_regions", "evidence_bboxes", "evidence_boxes", "answer_bboxes", "grounding_bboxes", "ocr_regions", "ocr_bboxes", "ocr_boxes", "ocr_tokens"]
ROLE_FIELDS = {
    "subject": ["subject_bbox", "bbox_subject", "subject_box", "subjectBox", "subj_bbox", "subj_box"],
    "object": ["object_bbox", "bbox_object", "object_box", "objectBox", "obj_bbox", "obj_box"],
}
BOX_FIELDS = "bbox|box|region|rect|bounds"
POLYGON_FIELDS = "points|polygon|vertices"


def _named(text: Column, field: str) -> Column:
    return F.regexp_extract(text, rf"""["']{field}["']\s*:\s*["']?({_NUMBER})""", 1).try_cast("double")


def parsed_box(text: Column) -> Column:
    """A box from text: four numbers with or without brackets, corners x1..y2, or x, y, w, h; of an object with a box field what that holds, of one with a polygon the bounds of its points.

    Null for null, for text without four numbers and for text that holds letters outside field names.
    """
    inner = F.regexp_extract(text, rf"""["'](?:{BOX_FIELDS})["']\s*:\s*(\[[^\]]*\]|\{{[^}}]*\}}|"[^"]*")""", 1)
    points = F.regexp_extract(text, rf"""["'](?:{POLYGON_FIELDS})["']\s*:\s*(\[(?:[^\[\]]|\[[^\[\]]*\])*\])""", 1)
    polygon = lambda ns: box(F.array_min(_every_other(ns, 0)), F.array_min(_every_other(ns, 1)), F.array_max(_every_other(ns, 0)), F.array_max(_every_other(ns, 1)))
    return F.when(inner != "", bound(inner, _plain_box)).when(points != "", bound(_numbers(points), lambda ns: F.when(F.size(ns) >= 2, polygon(ns)))).otherwise(_plain_box(text))


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, r"""["'][^"']*["']\s*:""", " "), F.lit(f"({_NUMBER})"), 1), lambda n: n.try_cast("double"))


def _every_other(numbers: Column, odd: int) -> Column:
    return F.filter(numbers, lambda _, i: i % 2 == odd)


def _plain_box(text: Column) -> Column:
    corner = box(*[_named(text, c) for c in ("x1", "y1", "x2", "y2")])
    x, y, w, h = (_named(text, c) for c in ("x", "y", "w", "h"))
    every = lambda cs: ~F.greatest(*[c.isNull() for c in cs])
    plain = ~F.regexp_replace(text, r"""["'][^"']*["']\s*:|\d[eE]""", "").rlike("[A-Za-z]")
    four = bound(_numbers(text), lambda ns: F.when(F.size(ns) >= 4, box(*[F.get(ns, F.lit(i)) for i in range(4)])))
    return F.when(every([corner[c] for c in ("x1", "y1", "x2", "y2")]), corner).when(every([x, y, w, h]), box(x, y, x + w, y + h)).when(plain, four)


def evidence_regions(fields: dict[str, str], width: Column, height: Column) -> Column:
    """Distinct normalised boxes of a sample: those of the first filled region field, then the subject's and the object's.

    ``fields`` maps the table's column names to their types (``dict(df.dtypes)``); a field holds texts for :func:`parsed_box` or boxes, a role's field one of them. Boxes without an area, and pixel boxes of an image without a size, go.
    """
    seen = lambda c, kind: parsed_box(c) if kind.endswith("string") else c
    boxes_of = lambda name: F.transform(name, lambda b: seen(b, fields[name][6:-1]))
    lists = [F.when(F.size(name) > 0, boxes_of(name)) for name in REGION_FIELDS if fields.get(name, "").startswith("array")]
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    roles = []
    for names in ROLE_FIELDS.values():
        # the first field that is not empty speaks for the role, readable or not
        held = [F.when((F.col(n).cast("string") != "") if fields[n] == "string" else F.col(n).isNotNull(), F.struct(seen(F.col(n), fields[n]).alias("b"))) for n in names if n in fields]
        roles += [F.coalesce(*held)["b"]] if held else []
    raw = F.concat(F.coalesce(*lists, none), F.array(*roles) if roles else none)
    w, h = (F.when(c > 0, c) for c in (width, height))
    return distinct_boxes(F.filter(F.transform(raw, lambda b: normalised(b, w.cast("double"), h.cast("double"))), lambda b: b.isNotNull()))


def set_overlap(a: Column, b: Column) -> Column:
    """struct(iou, a_in_b, b_in_a) of the areas that two sets of boxes cover; 0 where there is no area to divide by."""
    of_a, of_b, of_both = union_area(a), union_area(b), union_area(F.concat(a, b))
    share = lambda s, whole: F.when(whole > 0, F.greatest(F.lit(0.0), s["a"] + s["b"] - s["u"]) / whole).otherwise(0.0)
    shares = lambda s: F.struct(share(s, s["u"]).alias("iou"), share(s, s["a"]).alias("a_in_b"), share(s, s["b"]).alias("b_in_a"))
    return bound(F.struct(of_a.alias("a"), of_b.alias("b"), of_both.alias("u")), shares)


def greedy_matches(a: Column, b: Column) -> Column:
    """IoUs of pairs taken one by one, largest first (ties: last places first), no box twice: min(size a, size b) of them."""
    pair = lambda x, i: F.transform(b, lambda y, j: F.struct(_iou(x, y).alias("iou"), i.alias("i"), j.alias("j")))
    pairs = F.sort_array(F.flatten(F.transform(a, pair)), asc=False)
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("i"), none.alias("j"), F.array().cast("array<double>").alias("ious"))
    grown = lambda s, p: F.struct(F.array_append(s["i"], p["i"]).alias("i"), F.array_append(s["j"], p["j"]).alias("j"), F.array_append(s["ious"], p["iou"]).alias("ious"))
    return F.aggregate(pairs, start, lambda s, p: F.when(F.array_contains(s["i"], p["i"]) | F.array_contains(s["j"], p["j"]), s).otherwise(grown(s, p)))["ious"]


def _iou(a: Column, b: Column) -> Column:
    common = overlap(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def local_precision(kept: Column, regions: Column) -> Column:
    """Of the area of kept boxes that touch evidence, the share that is evidence; 0 where none does."""
    near = F.filter(kept, lambda k: F.exists(regions, lambda r: overlap(k, r) > 0))
    share = lambda cells, whole: F.when(whole > 0, F.least(F.lit(1.0), union_area(clipped(cells, regions)) / whole)).otherwise(0.0)
    return bound(near, lambda cells: bound(union_area(cells), lambda whole: share(cells, whole)))


def merge_lineage(n: Column, anchors: Column, contextual: Column) -> Column:
    """Source tokens of a selector that merges every token into contextual ones: all of them, or the valid distinct anchors where nothing is merged."""
    valid = F.array_sort(F.array_distinct(F.filter(anchors, lambda i: (i >= 0) & (i < n)))).cast("array<int>")
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n.cast("int") - 1))).otherwise(F.array().cast("array<int>"))
    return F.when(contextual > 0, every).otherwise(valid)


def on_canvas(boxes: Column, tile: Column) -> Column:
    """Boxes of a tile, in its own 0..1, on the canvas where the tile lies."""
    w, h = tile["x2"] - tile["x1"], tile["y2"] - tile["y1"]
    return F.transform(boxes, lambda b: box(tile["x1"] + b["x1"] * w, tile["y1"] + b["y1"] * h, tile["x1"] + b["x2"] * w, tile["y1"] + b["y2"] * h))


def tiled_boxes(patches: Column, rows: Column, columns: Column, grid_rows: int, grid_columns: int) -> Column:
    """struct(boxes, rows, columns, thumbnail): token boxes of an image cut into tiles row by row, each a grid, and of a last thumbnail of the whole where there is one patch more than tiles.

    One patch is the whole image; a number of patches that the canvas can't give is one row of tiles.
    """
    local = token_grid(grid_rows, grid_columns)
    fits = (patches == rows * columns) | (patches == rows * columns + 1)
    r, c = F.when(fits, rows).otherwise(1), F.when(fits, columns).otherwise(patches)
    thumbnail = fits & (patches == rows * columns + 1) & (rows * columns > 1)
    tile = lambda i: box((i % c) / c, F.floor(i / c) / r, (i % c + 1) / c, (F.floor(i / c) + 1) / r)
    tiles = F.flatten(F.transform(F.sequence(F.lit(0), r * c - 1), lambda i: on_canvas(local, tile(i))))
    whole = F.concat(tiles, F.when(thumbnail, local).otherwise(F.slice(local, 1, 0)))
    made = lambda boxes, a, b, t: F.struct(boxes.alias("boxes"), a.cast("int").alias("rows"), b.cast("int").alias("columns"), t.alias("thumbnail"))
    return F.when(patches <= 1, made(local, F.lit(1), F.lit(1), F.lit(False))).otherwise(made(whole, r, c, thumbnail))


def positions(keep: Column, mode: str) -> Column:
    """Position ids after deletion: ``compact`` counts what is kept, ``preserve`` keeps the old places."""
    places = F.filter(F.transform(keep, lambda k, i: F.when(k, i)), lambda i: i.isNotNull())
    if mode == "preserve":
        return places
    if mode != "compact":
        raise ValueError(f"no position mode {mode}")
    return F.transform(places, lambda _, i: i)


def box_features(regions: Column) -> dict[str, Column]:
    """Areas, gaps and distance of the first two regions, the subject and the object; 0 where one is missing."""
    a, b = F.get(regions, F.lit(0)), F.get(regions, F.lit(1))
    size = lambda x: F.coalesce(area(x), F.lit(0.0))
    low = F.coalesce(F.least(F.when(size(a) > 0, size(a)), F.when(size(b) > 0, size(b))), F.lit(0.0))
    high = F.greatest(size(a), size(b))
    gap = lambda lo, hi: F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), F.greatest(a[lo], b[lo]) - F.least(a[hi], b[hi]))), F.lit(0.0))
    apart = lambda lo, hi: (a[lo] + a[hi]) / 2 - (b[lo] + b[hi]) / 2
    dx, dy = apart("x1", "x2"), apart("y1", "y2")
    return {
        "evidence_area": union_area(regions), "subject_area": size(a), "object_area": size(b), "min_object_area": low, "max_object_area": high,
        "area_imbalance": F.when(low > 0, high / F.greatest(F.lit(1e-12), low)).otherwise(0.0), "center_distance": F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)),
        "horizontal_gap": gap("x1", "x2"), "vertical_gap": gap("y1", "y2"), "evidence_region_count": F.size(regions).cast("double"),
    }


def centre_prior(tokens: Column) -> Column:
    """1 at the centre of the image, falling to 0 at its corners."""
    half = lambda b, lo, hi: (b[lo] + b[hi]) / 2 - 0.5
    return F.transform(tokens, lambda b: 1 - F.least(F.lit(1.0), F.sqrt(half(b, "x1", "x2") * half(b, "x1", "x2") + half(b, "y1", "y2") * half(b, "y1", "y2")) / 0.70710678118))


def overlap_share(token: Column, regions: Column) -> Column:
    """Overlaps with the regions, summed up, over the token's area."""
    return F.aggregate(regions, F.lit(0.0), lambda s, r: s + overlap(token, r)) / F.greatest(F.lit(1e-12), area(token))


def evidence_relevance(tokens: Column, regions: Column) -> Column:
    """:func:`overlap_share` of every token; the centre prior where no token meets evidence."""
    chosen = lambda shares: F.when(F.exists(shares, lambda s: s > 0), shares).otherwise(centre_prior(tokens))
    return bound(F.transform(tokens, lambda t: overlap_share(t, regions)), chosen)


def spatial_uniqueness(tokens: Column, relevance: Column) -> Column:
    """Distance of a token's centre to the nearest relevant token's, 1 at most; 0 where none is relevant."""
    centre = lambda b: F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))
    marked = F.filter(F.zip_with(tokens, relevance, lambda b, r: F.when(r > 0, centre(b))), lambda c: c.isNotNull())
    away = lambda b, ms: F.array_min(F.transform(ms, lambda m: F.pow(centre(b)["x"] - m["x"], 2.0) + F.pow(centre(b)["y"] - m["y"], 2.0)))
    return bound(marked, lambda ms: F.transform(tokens, lambda b: F.coalesce(F.least(F.lit(1.0), F.sqrt(away(b, ms))), F.lit(0.0))))


def evidence_protected(tokens: Column, regions: Column, relevance: Column, k: Column | int) -> Column:
    """0-based places of the k tokens of largest :func:`overlap_share`, ties by relevance, then place; only tokens that meet evidence."""
    ranked = F.transform(tokens, lambda t, i: F.struct((-overlap_share(t, regions)).alias("share"), (-F.get(relevance, i)).alias("relevance"), i.alias("i")))
    met = F.array_sort(F.filter(ranked, lambda s: s["share"] < 0))
    return F.transform(F.slice(met, F.lit(1), F.greatest(F.lit(0), k if isinstance(k, Column) else F.lit(k))), lambda s: s["i"])


def attributed_accuracy(correct: Column, coverage: Column, threshold: float = 0.5) -> Column:
    """1 for a right answer whose evidence is kept, else 0."""
    return F.when(correct & (coverage >= threshold), 1.0).otherwise(0.0)
