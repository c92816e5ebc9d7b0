import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeworks.functions import scalar
from hazeworks.operators import raster


def test_utm_round_trip_is_below_a_millimetre(spark):
    places = [(lat, lon) for lat in np.linspace(0.0, 84.0, 43) for lon in np.linspace(119.5, 126.5, 29)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in places], "lat double, lon double")
    x, y = scalar.utm(F.col("lat"), F.col("lon"))
    lat, lon = scalar.from_utm(x, y)
    for r in df.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert abs(r.a - r.lat) * 111_320 < 1e-3 and abs(r.b - r.lon) * 111_320 * math.cos(math.radians(r.lat)) < 1e-3
    # On the central meridian the northing is the meridian arc by the scale; at the equator a known length.
    e, n = spark.range(1).select(*scalar.utm(F.lit(45.0), F.lit(123.0))).first()
    assert abs(e - 500_000) < 1e-6 and abs(n - 0.9996 * 4_984_944.377857987) < 1e-3


@pytest.mark.parametrize("crs", ["degrees", "sinusoidal", "utm:51"])
def test_rotated_rasters_of_other_systems(spark, crs):
    """A coarse raster turned by 30 degrees, in metres or degrees, and a fine one in UTM: each fine cell has the value of the coarse cell around it."""
    scale = 1.0 if crs == "degrees" else 111_000.0
    x0, y0 = (float(v) for v in spark.range(1).select(*raster.point_of(F.lit(14.5), F.lit(121.0), crs)).first())
    turn = math.radians(30)
    meta = {"a": 0.02 * scale * math.cos(turn), "b": 0.02 * scale * math.sin(turn), "c": x0, "d": 0.02 * scale * math.sin(turn), "e": -0.02 * scale * math.cos(turn), "f": y0}
    coarse = spark.range(100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").alias("v"))
    px, py = (float(v) for v in spark.range(1).select(*scalar.utm(F.lit(14.5), F.lit(121.0))).first())
    fine_meta = {"a": 900.0, "c": px - 5_000, "e": -900.0, "f": py + 12_000}
    fine = spark.range(40 * 40).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"))
    got = {(r.row, r.col): r.v for r in raster.aligned(fine, coarse, fine_meta, meta, "v", "utm:51", crs).collect()}
    lat, lon = scalar.from_utm(F.lit(fine_meta["c"]) + (F.col("col") + 0.5) * 900, F.lit(fine_meta["f"]) - (F.col("row") + 0.5) * 900)
    want = {}
    for r in fine.select("row", "col", *(c.alias(n) for c, n in zip(raster.point_of(lat, lon, crs), "xy"))).collect():
        # The coarse cell (i, j) whose corner plus a part of both sides is the point.
        sides = np.array([[meta["b"], meta["a"]], [meta["e"], meta["d"]]])
        i, j = np.floor(np.linalg.solve(sides, [r.x - x0, r.y - y0])).astype(int)
        want[r.row, r.col] = int(i * 10 + j) if 0 <= i < 10 and 0 <= j < 10 else None
    assert got == want and sum(v is not None for v in got.values()) > 200
