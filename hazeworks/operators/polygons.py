"""Points in polygons, and rasters cut to them.

A polygon is a list of rings, each a list of (x, y) corners; a point is inside if a ray from it crosses their edges an odd number of times, so a ring
within another is a hole. Edges are kept by horizontal slabs: a row looks at those of its own slab only, however many the polygon has. All of it is one
native expression. Points on a left or lower edge are inside, on a right or upper one outside, so polygons that share an edge share no point.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeworks.functions.scalar import from_sinusoidal
from hazeworks.operators.raster import pixel_centre

Ring = list[tuple[float, float]]
#: Slabs of a polygon, at most; about one edge each.
SLABS = 4096


def bounds(rings: list[Ring]) -> tuple[float, float, float, float]:
    """(west, south, east, north)."""
    xs, ys = zip(*(p for ring in rings for p in ring))
    return min(xs), min(ys), max(xs), max(ys)


def inside(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Whether (x, y) lies in the polygon; false where one is null."""
    west, south, east, north = bounds(rings)
    edges = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                (xl, yl), (xh, yh) = ((x1, y1), (x2, y2)) if y1 < y2 else ((x2, y2), (x1, y1))
                edges.append({"low": float(yl), "high": float(yh), "x": float(xl), "slope": (xh - xl) / (yh - yl)})
    if not edges:
        return F.lit(False)
    count = min(SLABS, len(edges))
    height = (north - south) / count
    slabs: list[list[dict]] = [[] for _ in range(count)]
    for e in edges:
        # One slab more on either side, for rounding.
        first, last = int((e["low"] - south) / height) - 1, int((e["high"] - south) / height) + 1
        for i in range(max(0, first), min(count, last + 1)):
            slabs[i].append(e)
    table = F.from_json(F.lit(json.dumps(slabs)), "array<array<struct<low: double, high: double, x: double, slope: double>>>")
    own = F.get(table, F.least(F.lit(count - 1), F.floor((y - south) / height)).cast("int"))
    crossed = lambda e: (e["low"] <= y) & (y < e["high"]) & (x < e["x"] + (y - e["low"]) * e["slope"])
    odd = F.size(F.filter(own, crossed)) % 2 == 1
    return F.coalesce((y >= south) & (y < north) & (x >= west) & (x <= east) & odd, F.lit(False))


def _box(meta: DataFrame) -> DataFrame:
    """raster_id and the box of degrees (west, south, east, north) around the corners and edge middles of rasters in the sinusoidal projection."""
    steps = [0.0, 0.5, 1.0]
    spots = F.array(*(F.struct((F.col("width") * u).alias("c"), (F.col("height") * v).alias("r")) for u in steps for v in steps))
    each = meta.select("raster_id", *"abcdef", F.explode(spots).alias("s"))
    x = F.col("a") * F.col("s.c") + F.col("b") * F.col("s.r") + F.col("c")
    y = F.col("d") * F.col("s.c") + F.col("e") * F.col("s.r") + F.col("f")
    lat, lon = from_sinusoidal(x, y)
    placed = each.select("raster_id", lat.alias("lat"), lon.alias("lon"))
    return placed.groupBy("raster_id").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def clipped_to(pixels: DataFrame, meta: DataFrame, rings: list[Ring], values: list[str] | None = None) -> DataFrame:
    """Pixels whose centre lies in a polygon of degrees; with ``values`` all pixels of its box stay and these columns are null outside the polygon.

    Rasters are in the sinusoidal projection. One that doesn't overlap the polygon's box is an error, as it can only be there by mistake.
    """
    west, south, east, north = bounds(rings)
    apart = _box(meta).where((F.col("east") < west) | (F.col("west") > east) | (F.col("north") < south) | (F.col("south") > north))
    missing = [r.raster_id for r in apart.select("raster_id").limit(5).collect()]
    if missing:
        raise ValueError(f"rasters don't overlap the polygon: {missing}")
    x, y = pixel_centre()
    lat, lon = from_sinusoidal(x, y)
    placed = pixels.join(meta.select("raster_id", *"abcdef"), "raster_id").withColumns({"_lon": lon, "_lat": lat}).drop(*"abcdef")
    within = inside(F.col("_lon"), F.col("_lat"), rings)
    if values is None:
        return placed.where(within).drop("_lon", "_lat")
    near = placed.where(F.col("_lon").between(west, east) & F.col("_lat").between(south, north))
    return near.withColumns({v: F.when(within, F.col(v)) for v in values}).drop("_lon", "_lat")
