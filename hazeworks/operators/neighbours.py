"""Which points the places of a tile may have among their nearest ones, by squares that grow until enough points are in reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeworks.shared import written


def _around(x: Column, y: Column, side: Column) -> Column:
    """The square of (x, y) and the eight around it, as structs."""
    square = lambda c, d: F.floor(c / side).cast("long") + d
    return F.array(*(F.struct(square(x, i).alias("sx"), square(y, j).alias("sy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))


def within_reach(tiles: DataFrame, points: DataFrame, keys: list[str], tile_keys: list[str], k: int, side: float, most_rounds: int = 60) -> DataFrame:
    """Adds ``reach`` to tiles (``cx``, ``cy``, ``half``): a distance from the centre within which lie the ``k`` nearest points (``px``, ``py``) of
    the same ``keys`` of every place in the tile, which is ``half`` at most from the centre. Groups must have ``k`` points.

    Round j looks at the nine squares of side ``side * 2^j`` around each tile that is left, which hold all points within that side; where k
    of them are that near the tile is done. So work is near points, doubled squares for tiles far from all.
    """
    left, found = written(tiles, "reach"), []
    for j in range(most_rounds):
        if left.isEmpty():
            break
        size = F.lit(side * 2.0**j)
        each = left.select(*keys, *tile_keys, "cx", "cy", F.explode(_around(F.col("cx"), F.col("cy"), size)).alias("s")).select("*", "s.*").drop("s")
        placed = points.select(*keys, "px", "py", F.floor(F.col("px") / size).cast("long").alias("sx"), F.floor(F.col("py") / size).cast("long").alias("sy"))
        near = F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy")) <= size
        done = each.join(placed, [*keys, "sx", "sy"]).where(near).groupBy(*keys, *tile_keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= k)
        rated = written(left.join(done, [*keys, *tile_keys], "left"), "reach")
        # A place's k nearest points are within size + half of it, so within size + 2 half of the centre.
        found.append(rated.where("_n is not null").withColumn("reach", size + 2 * F.col("half")).drop("_n"))
        left = rated.where("_n is null").drop("_n")
    else:
        raise ValueError(f"{most_rounds} rounds leave tiles without {k} points")
    out = tiles.withColumn("reach", F.lit(0.0)).limit(0)
    for part in found:
        out = out.unionByName(part)
    return out


def in_reach(tiles: DataFrame, points: DataFrame, keys: list[str], tile_keys: list[str], carried: list[str], side: float) -> DataFrame:
    """(keys, tile_keys, ``points``): the points within each tile's ``reach``, as an array of ``carried`` columns.

    An equi-join on squares of the power-of-two multiple of ``side`` that is at least the reach.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("reach") / side))).cast("int")
    sized = written(tiles.withColumn("level", level), "reach")
    levels = [r[0] for r in sized.select("level").distinct().collect()]  # at most one a doubling
    if not levels:
        return tiles.select(*keys, *tile_keys, F.array().cast(points.select(F.array(F.struct(*carried))).schema[0].dataType).alias("points")).limit(0)
    size = F.lit(side) * F.pow(F.lit(2.0), F.col("level"))
    each = sized.select(*keys, *tile_keys, "cx", "cy", "reach", "level", F.explode(_around(F.col("cx"), F.col("cy"), size)).alias("s")).select("*", "s.*").drop("s")
    placed = points.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels))))).withColumns({"sx": F.floor(F.col("px") / size).cast("long"), "sy": F.floor(F.col("py") / size).cast("long")})
    near = F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy")) <= F.col("reach")
    pairs = each.join(placed, [*keys, "level", "sx", "sy"]).where(near)
    return pairs.groupBy(*keys, *tile_keys).agg(F.sort_array(F.collect_list(F.struct(*carried))).alias("points"))
