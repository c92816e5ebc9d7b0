import math
import random

import pytest
from pyspark.sql import functions as F

from hazeworks.operators import polygons

L = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
HOLE = [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]


def crossings(x, y, rings):
    """Even-odd rule, edge by edge."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def found(spark, points, rings):
    df = spark.createDataFrame(points, "x double, y double")
    return [r.i for r in df.select(polygons.inside(F.col("x"), F.col("y"), rings).alias("i")).collect()]


@pytest.mark.parametrize("slabs", [1, 3, 4096])
def test_inside(spark, monkeypatch, slabs):
    monkeypatch.setattr(polygons, "SLABS", slabs)
    rng = random.Random(1)
    star = [(2 + r * math.cos(a), 1 + r * math.sin(a)) for i, a in enumerate(2 * math.pi * k / 400 for k in range(400)) for r in [1.0 + (i % 2)]]
    points = [(rng.uniform(-1, 5), rng.uniform(-1, 4)) for _ in range(500)]
    for rings in ([L], [L, HOLE], [star], [star[::-1], HOLE]):
        assert found(spark, points, rings) == [crossings(x, y, rings) for x, y in points]


def test_edges_belong_to_one_side(spark):
    left, right = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]
    points = [(0.0, 0.5), (1.0, 0.5), (2.0, 0.5), (0.5, 0.0), (0.5, 1.0), (None, 0.5), (0.5, None)]
    assert found(spark, points, [left]) == [True, False, False, True, False, False, False]
    assert found(spark, points, [right]) == [False, True, False, False, False, False, False]
    assert found(spark, points, [[(0.0, 0.0), (3.0, 0.0)]]) == [False] * 7


def test_rasters_are_cut(spark):
    degree = 6371007.181 * math.pi / 180
    meta = spark.createDataFrame([("r", degree, 0.0, 0.0, 0.0, -degree, 4 * degree, 4, 4)], "raster_id string, a double, b double, c double, d double, e double, f double, width int, height int")
    pixels = spark.range(16).select(F.lit("r").alias("raster_id"), (F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    cut = polygons.clipped_to(pixels, meta, [L])
    # The lower row, and the column above it but for its top.
    assert sorted((r.row, r.col) for r in cut.collect()) == [(1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (3, 3)]
    nulled = polygons.clipped_to(pixels, meta, [L], ["v"])
    assert sorted((r.row, r.col) for r in nulled.where("v is not null").select("row", "col").collect()) == sorted((r.row, r.col) for r in cut.collect())
    assert nulled.count() == 12
    with pytest.raises(ValueError, match="'far'"):
        polygons.clipped_to(pixels, meta.unionByName(meta.withColumns({"raster_id": F.lit("far"), "c": F.lit(40 * degree)})), [L])
