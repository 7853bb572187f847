"""Random regions by hand, and without making tries that nobody needs."""

import time

import numpy as np
from pyspark.sql import functions as F

from evalweave.functions.boxes import box
from evalweave.functions.hashing import PRIME, key_seeds
from evalweave.operators import masks


def _rows(spark, n):
    size = lambda k: (F.col("id") % k) / 20.0 + 0.2
    return spark.range(n).select("id", box(F.lit(0.1), F.lit(0.05), 0.1 + size(10), 0.05 + size(13)).alias("b"))


def _uniform(a, b, r):
    x = (r * 1103515245 + a) % PRIME
    x = (x * x + b) % PRIME
    x = (x * 48271 + (r * 69621 + b)) % PRIME
    x = (x * x + a) % PRIME
    return (x * 16807 + b) % PRIME / PRIME


def test_the_first_small_try_or_the_least(spark):
    a, b = key_seeds(0, F.col("id"))
    rows = _rows(spark, 60).select("*", a.alias("_sa"), b.alias("_sb"))
    for most, tries in ((0.1, 50), (0.02, 9), (-1.0, 40), (0.1, 1)):
        for r in masks.random_region(rows, "id", "b", most, tries).collect():
            w, h, found = r.b.x2 - r.b.x1, r.b.y2 - r.b.y1, []
            for k in range(1, tries + 1):
                x, y = _uniform(r._sa, r._sb, 2 * k) * (1 - w), _uniform(r._sa, r._sb, 2 * k + 1) * (1 - h)
                over = max(0, min(x + w, r.b.x2) - max(x, r.b.x1)) * max(0, min(y + h, r.b.y2) - max(y, r.b.y1))
                found.append((over / (2 * w * h - over), x, y))
            want = next((f for f in found if f[0] <= most), min(found, key=lambda f: f[0]))
            assert np.allclose((r.region_iou, r.region.x1, r.region.y1), want, atol=1e-9)


def test_later_tries_cost_nothing_where_an_early_one_does(spark):
    """Forty million tries where nearly all rows take one of the first; before, all were made."""
    small = spark.range(100).select("id", box(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.2)).alias("b"))
    masks.random_region(small, "id", "b").collect()
    began = time.time()
    assert max(r.region_iou for r in masks.random_region(small, "id", "b", tries=400_000).collect()) <= 0.1
    assert time.time() - began < 8
