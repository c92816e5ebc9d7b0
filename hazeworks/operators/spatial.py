"""Grids, radius joins and inverse-distance interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeworks.shared import written


def grid_centres(spark: SparkSession, box: tuple[float, float, float, float], step: float = 0.25) -> DataFrame:
    """Cell centres (latitude, longitude) of a box in degrees, rounded to four digits; a last centre on the edge counts."""
    west, south, east, north = box
    count = lambda low, high: math.floor((high - low - step / 2 + 1e-9) / step) + 1
    rows, cols = max(0, count(south, north)), max(0, count(west, east))
    at = spark.range(rows * cols)
    lat = F.round(F.lit(south + step / 2) + F.floor(F.col("id") / max(1, cols)) * step, 4)
    lon = F.round(F.lit(west + step / 2) + F.col("id") % max(1, cols) * step, 4)
    return at.select(lat.alias("latitude"), lon.alias("longitude"))


def extent(points: DataFrame, x: str, y: str) -> tuple[float, float, float, float] | None:
    """(west, south, east, north) of all points, or None without any."""
    r = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return None if None in r else tuple(map(float, r))


def metric_grid(spark: SparkSession, low: tuple[float, float], high: tuple[float, float], cell: float = 100.0) -> DataFrame:
    """Cells (row, col, x, y) of an extent snapped outwards to ``cell``; rows go from north to south, x and y are centres."""
    x0, y0 = math.floor(low[0] / cell) * cell, math.floor(low[1] / cell) * cell
    cols, rows = round((math.ceil(high[0] / cell) * cell - x0) / cell), round((math.ceil(high[1] / cell) * cell - y0) / cell)
    r, c = F.floor(F.col("id") / cols).cast("int"), (F.col("id") % cols).cast("int")
    at = spark.range(rows * cols).select(r.alias("row"), c.alias("col"))
    return at.select("row", "col", (F.lit(x0) + (F.col("col") + 0.5) * cell).alias("x"), (F.lit(y0 + rows * cell) - (F.col("row") + 0.5) * cell).alias("y"))


#: Points of a leaf, about; and how often a crowded square is halved at most.
CROWD, DEPTH = 20_000, 8
#: Rows of one place that travel as one, at most about; and how many tasks may share a leaf.
MEMBERS, DEALT = 4096, 8


def leaves(points: DataFrame, radius: float, crowd: int = CROWD, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Points with their leaf, and the leaves, of a quadtree over squares of side ``radius``: (sx, sy, level, lx, ly) and a number, ``part``.

    A square of more than ``crowd`` points is quartered, and so on, ``DEPTH`` times at most; what is as crowded then, points in one place, is
    dealt to ``parts`` by hash. Counts are all that the tree is made from, and only those of crowded squares are kept below the square. With
    ``weight`` a row counts as so many points.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    unit = 1 << DEPTH
    inner = lambda c: F.least(F.lit(unit - 1), F.floor((c / radius - F.floor(c / radius)) * unit)).cast("int")
    square = lambda c: F.floor(c / radius).cast("long")
    placed = points.withColumns({"sx": square(F.col("px")), "sy": square(F.col("py")), "_ux": inner(F.col("px")), "_uy": inner(F.col("py"))})
    squares = placed.groupBy("sx", "sy").agg(size.alias("n"))
    crowded = squares.where(F.col("n") > crowd).select("sx", "sy")
    fine = placed.join(crowded, ["sx", "sy"], "left_semi").groupBy("sx", "sy", "_ux", "_uy").agg(size.alias("n"))
    at = lambda c, level: F.shiftright(c, DEPTH - level)
    counts = {f"_c{k}": F.sum("n").over(Window.partitionBy("sx", "sy", at("_ux", k), at("_uy", k))) for k in range(1, DEPTH + 1)}
    level = F.coalesce(*(F.when(F.col(f"_c{k}") <= crowd, k) for k in range(1, DEPTH + 1)), F.lit(DEPTH))
    shift = lambda c: F.expr(f"shiftright({c}, {DEPTH} - level)")
    deep = fine.withColumns(counts).withColumn("level", level).withColumns({"lx": shift("_ux"), "ly": shift("_uy")}).select("sx", "sy", "_ux", "_uy", "n", "level", "lx", "ly")
    found = deep.groupBy("sx", "sy", "level", "lx", "ly").agg(F.sum("n").alias("n"))
    top = squares.where(F.col("n") <= crowd).select("sx", "sy", F.lit(0).alias("level"), F.lit(0).alias("lx"), F.lit(0).alias("ly"), "n")
    tree = top.unionByName(found).select("sx", "sy", "level", "lx", "ly", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
    where = deep.select("sx", "sy", "_ux", "_uy", "level", "lx", "ly")
    dealt = placed.join(where, ["sx", "sy", "_ux", "_uy"], "left").fillna(0, ["level", "lx", "ly"]).drop("_ux", "_uy")
    number = F.pmod(F.xxhash64(*(F.col(c) for c in points.columns)), F.lit(1 << 20)).cast("int")
    return dealt.withColumn("part", number), tree


def places(df: DataFrame, x: str, y: str, members: str) -> DataFrame:
    """One row per place (x, y) with its rows' other columns as an array of structs, ``members``; a place of many rows has several, dealt by hash."""
    others = [F.col(c) for c in df.columns if c not in (x, y)] or [F.lit(0).alias("_")]
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    full = rows.groupBy(x, y).agg(F.count("*").alias("_n")).where(F.col("_n") > MEMBERS)
    number = F.pmod(F.xxhash64(*df.columns), F.coalesce(F.ceil(F.col("_n") / MEMBERS), F.lit(1)))
    return rows.join(full, [x, y], "left").groupBy(x, y, number.alias("_number")).agg(F.collect_list(F.struct(*others)).alias(members)).drop("_number")


def place_pairs(cells: DataFrame, points: DataFrame, radius: float, crowd: int = CROWD, weight: Column | None = None) -> DataFrame:
    """Rows of cells (x, y) and points (px, py) under ``radius`` apart, with their squared distance d2.

    An equi-join: each cell meets the leaves (see ``leaves``) of its square and the eight around it that are in reach, and the points of these. No
    nested loop, whatever the number of points, and no key with more than about ``crowd`` of them, wherever they crowd. The cells of a leaf are
    dealt to ``DEALT`` tasks, as pairs are many more than the rows by which Spark sizes its partitions.
    """
    dealt, tree = leaves(points, radius, crowd, weight)
    side = lambda c, i: (F.floor(c / radius) + i).cast("long")
    around = F.explode(F.array(*(F.struct(side(F.col("x"), i).alias("sx"), side(F.col("y"), j).alias("sy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    near = cells.withColumn("_s", around).withColumns({"sx": F.col("_s.sx"), "sy": F.col("_s.sy")}).drop("_s").join(tree, ["sx", "sy"])
    edge = lambda s, leaf: (F.col(s) + F.col(leaf) / F.pow(F.lit(2.0), "level")) * radius
    off = lambda c, low: F.greatest(low - c, c - low - radius / F.pow(F.lit(2.0), "level"), F.lit(0.0))
    dx, dy = off(F.col("x"), edge("sx", "lx")), off(F.col("y"), edge("sy", "ly"))
    # A little more than the radius, for rounding at a leaf's edges.
    reached = near.where(dx * dx + dy * dy <= radius * radius * (1 + 1e-9)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    leaf = ["sx", "sy", "level", "lx", "ly"]
    own = dealt.join(tree, leaf).withColumn("part", F.pmod("part", "parts")).drop("parts").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    reached = reached.withColumn("_deal", F.pmod(F.xxhash64("x", "y"), F.lit(DEALT)).cast("int"))
    key, n = [*leaf, "part", "_deal"], int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    return reached.repartition(n, *key).join(own.repartition(n, *key), key).drop(*key).withColumn("d2", d2).where(F.col("d2") < radius * radius)


def radius_join(cells: DataFrame, points: DataFrame, radius: float, crowd: int = CROWD) -> DataFrame:
    """Pairs of cells (x, y) and points (px, py) under ``radius`` apart, with their squared distance d2.

    Places are joined (see ``place_pairs``) and then spread to the cells and points in them. The pairs of two places follow each other, so where many
    share a place columns are written as runs.
    """
    pairs = place_pairs(places(cells, "x", "y", "_cells"), places(points, "px", "py", "_points"), radius, crowd, F.size("_points"))
    of = lambda df, name, x, y: [F.col(f"{name}.{c}").alias(c) for c in df.columns if c not in (x, y)]
    spread = pairs.withColumn("_point", F.explode("_points")).drop("_points").withColumn("_cell", F.explode("_cells"))
    return spread.select("x", "y", *of(cells, "_cell", "x", "y"), "px", "py", *of(points, "_point", "px", "py"), "d2")


def idw_mean(value: Column, d2: Column, point: Column, power: float = 2.0) -> Column:
    """Inverse-distance weighted mean; a point on the cell (of least id, if several) gives its value."""
    weight = F.when(d2 > 0, 1 / (d2 if power == 2.0 else F.pow(d2, power / 2)))
    exact = F.min_by(value, F.when((d2 == 0) & value.isNotNull(), point))
    return F.coalesce(exact, F.try_divide(F.sum(F.when(value.isNotNull(), value * weight)), F.sum(F.when(value.isNotNull(), weight))))


def idw_surface(readings: DataFrame, points: DataFrame, cells: DataFrame, cell_keys: list[str], keys: list[str], point: str = "station", value: str = "value", radius: float = 10_000.0) -> DataFrame:
    """Interpolated value per group of ``keys`` (hour, band) and cell in reach of a point.

    Cells of one place have one estimate, and points of one place one weight: distinct places are joined, once for all groups, and readings
    join them as sums by group and place. Work is quadratic in distinct places within ``radius``, not in rows.
    """
    valued = readings.select(*keys, point, value).where(F.col(value).isNotNull()).join(points.select(point, "px", "py"), point)
    sums = valued.groupBy(*keys, "px", "py").agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"), F.min_by(value, point).alias("_first"))
    # Written, so that Spark knows its size: small sums are sent to the pairs, which then stay where they are.
    sums = written(sums, "readings")
    pairs = place_pairs(cells.select("x", "y").distinct(), points.select("px", "py").distinct(), radius)
    weight = F.when(F.col("d2") > 0, 1 / F.col("d2"))
    exact = F.max(F.when(F.col("d2") == 0, F.col("_first")))
    estimate = F.coalesce(exact, F.try_divide(F.sum(F.col("_sum") * weight), F.sum(F.col("_n") * weight)))
    surface = pairs.join(sums, ["px", "py"]).groupBy(*keys, "x", "y").agg(estimate.alias("estimate"))
    return cells.select(*cell_keys, "x", "y").distinct().join(surface, ["x", "y"]).select(*keys, *cell_keys, "estimate")


def leave_one_out(readings: DataFrame, keys: list[str], point: str, x: str, y: str, value: str, least: int = 3, exact: bool = True) -> DataFrame:
    """Prediction of each reading from the other points of its group, by inverse squared distance; small groups leave.

    Where another point is in the same place its value is the prediction or, unless ``exact``, NaN: the quotient of infinite sums.
    """
    real = readings.where(F.col(value).isNotNull())
    big = real.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    real = real.join(big, keys, "left_semi")
    other = real.select(*keys, F.col(point).alias("_p"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(value).alias("_v"))
    pairs = real.join(other, keys).where(F.col(point) != F.col("_p"))
    d2 = (F.col(x) - F.col("_x")) * (F.col(x) - F.col("_x")) + (F.col(y) - F.col("_y")) * (F.col(y) - F.col("_y"))
    mean = idw_mean(F.col("_v"), F.col("_d2"), F.col("_p"))
    mean = mean if exact else F.when(F.min("_d2") == 0, float("nan")).otherwise(mean)
    return pairs.withColumn("_d2", d2).groupBy(*keys, point).agg(F.first(value).alias("observed"), mean.alias("predicted"))


def error_metrics(df: DataFrame, keys: list[str], predicted: str = "predicted", observed: str = "observed") -> DataFrame:
    """mae, rmse, bias (predicted minus observed) and r2 per group; null with fewer than two pairs."""
    p, o = F.col(predicted), F.col(observed)
    sums = df.where(p.isNotNull() & o.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(p - o)).alias("mae"), F.sqrt(F.avg((p - o) * (p - o))).alias("rmse"), F.avg(p - o).alias("bias"), F.sum((o - p) * (o - p)).alias("_res"), F.var_pop(o).alias("_var"),
    )
    r2 = 1 - F.try_divide(F.col("_res"), F.col("_var") * F.col("n"))
    two = F.col("n") >= 2
    return sums.select(*keys, "n", *(F.when(two, F.col(c)).alias(c) for c in ("mae", "rmse", "bias")), F.when(two, r2).alias("r2"))


def overlaps(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> bool:
    """Whether two boxes (west, south, east, north) share a point."""
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
