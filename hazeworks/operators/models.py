"""Kriging and forest downscaling."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeworks.operators.neighbours import in_reach, within_reach
from hazeworks.shared import one_thread, written


def spherical(d: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    """Variogram: nugget + sill * (1.5 h - 0.5 h^3) for h = d / reach up to 1, flat beyond, 0 at distance 0."""
    h = np.minimum(d / reach, 1.0)
    return np.where(d == 0, 0.0, nugget + sill * (1.5 * h - 0.5 * h**3))


def fit_spherical(x: np.ndarray, y: np.ndarray, far: float) -> tuple[float, float, float]:
    """Least squares over lag means (distance x, semivariance y): for each of some reaches up to 1.5 times the farthest pair, the best non-negative nugget and sill.

    Of fits that are as good but for rounding the first is taken, so that the order of sums doesn't decide.
    """
    same = 1e-10 * float(y @ y)
    best = (np.inf, 0.0, max(float(y.mean()), 1e-12), far)
    for reach in np.linspace(far / 10, far * 1.5, 30) if far > 0 else []:
        shape = spherical(x, 0.0, 1.0, reach)
        basis = np.stack([np.ones_like(x), shape], axis=1)
        fits = [np.linalg.lstsq(basis, y, rcond=None)[0], np.array([0.0, y @ shape / max(shape @ shape, 1e-12)]), np.array([y.mean(), 0.0])]
        for nugget, sill in fits:
            if nugget >= 0 and sill >= 0 and nugget + sill > 0:
                error = float(((nugget + sill * shape - y) ** 2).sum())
                if error < best[0] - same:
                    best = (error, float(nugget), float(sill), float(reach))
    return best[1:] if far > 0 else (best[1], best[2], 1.0)


#: Stations whose distances to all others are held at once when a variogram is fitted, and the most of these distances.
ROWS, PAIRS = 512, 1 << 20


def _blocks(n: int) -> Iterator[slice]:
    rows = max(1, min(ROWS, PAIRS // max(n, 1)))
    return (slice(at, min(at + rows, n)) for at in range(0, n, rows))


def _remote(px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Points among which are all of the farthest pairs: those so far from the centre that the way over it to the outermost point is as long as the farthest pair known."""
    r = np.hypot(px - px.mean(), py - py.mean())
    i = int(r.argmax())
    return np.flatnonzero((r + r[i]) * (1 + 1e-9) >= np.hypot(px - px[i], py - py[i]).max())


def fit(px: np.ndarray, py: np.ndarray, v: np.ndarray, lags: int = 4) -> tuple[float, float, float]:
    """Variogram of some points, from lag means over all their pairs; (0, 0, 1) for one point or equal values, whose surface is constant."""
    if len(v) < 2 or np.ptp(v) == 0:
        return 0.0, 0.0, 1.0

    out = _remote(px, py)
    far = max(float(np.hypot(px[out[b], None] - px[out], py[out[b], None] - py[out]).max()) for b in _blocks(len(out)))
    edges = np.linspace(0, far * 1.000001, lags + 1)
    sums = np.zeros((3, lags))
    for b in _blocks(len(v)):
        later = np.arange(b.start, b.stop)[:, None] < np.arange(b.start, len(v))
        d = np.hypot(px[b, None] - px[b.start :], py[b, None] - py[b.start :])[later]
        gamma = 0.5 * (v[b, None] - v[b.start :])[later] ** 2
        lag = np.digitize(d, edges[1:-1])
        sums += [np.bincount(lag, w, lags) for w in (None, d, gamma)]
    n, x, y = sums[:, sums[0] > 0]
    return fit_spherical(x / n, y / n, far)


def _unit(model: tuple[float, float, float]) -> tuple[float, tuple[float, float, float]]:
    """Scale of a variogram, and the variogram of scale 1: beside the ones of a system, large values would hide its smallest eigenvalue in rounding."""
    scale = (model[0] + model[1]) or 1.0
    return scale, (model[0] / scale, model[1] / scale, model[2])


def factor(px: np.ndarray, py: np.ndarray, model: tuple[float, float, float]) -> np.ndarray:
    """Pseudo-inverse of the kriging system of some points (of the last axis), of scale 1: weights are its product with a right side. Points in one place share their weight."""
    n, (_, model) = px.shape[-1], _unit(model)
    left = np.zeros((*px.shape[:-1], n + 1, n + 1))
    left[..., :n, :n] = spherical(np.hypot(px[..., :, None] - px[..., None, :], py[..., :, None] - py[..., None, :]), *model)
    left[..., n, :n] = left[..., :n, n] = 1.0
    return np.linalg.pinv(left, rcond=np.finfo(float).eps * (n + 1), hermitian=True)


#: Systems of more points are factored in panels that a temporary file holds: so many rows at once, and so many numbers in them.
WHOLE, PANEL, NUMBERS = 1000, 1024, 1 << 24


class Panels:
    """Cholesky factor of the covariance of points in distinct places, by panels of rows in a temporary file; memory holds two panels, whatever the number of points.

    Each diagonal block is kept as its inverse. Covariances are the sill and nugget less the variogram.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, model: tuple[float, float, float]):
        self.x, self.y, self.model, self.n = x, y, model, len(x)
        self.rows = max(1, min(PANEL, NUMBERS // len(x)))
        self.file, self.places = tempfile.TemporaryFile(), {}
        for at in range(0, self.n, self.rows):
            panel = self.covariance(x[at : at + self.rows], y[at : at + self.rows], at + self.rows)
            self.forward(panel, 0, at)
            own = panel[:, at:]
            own -= panel[:, :at] @ panel[:, :at].T
            own[:] = np.linalg.inv(self._root(own))
            self.places[at] = (self.file.tell(), panel.shape)
            panel.tofile(self.file)

    def _root(self, own: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.cholesky(own)
        except np.linalg.LinAlgError:  # places so close that rounding hides their distance
            return np.linalg.cholesky(own + np.eye(len(own)) * (self.model[0] + self.model[1]) * np.finfo(float).eps * self.n)

    def covariance(self, x: np.ndarray, y: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Of places and the first points, a row for each place."""
        h = np.hypot(x[:, None] - self.x[:upto], y[:, None] - self.y[:upto])
        same = h == 0
        nugget, sill, reach = self.model
        h /= reach
        np.minimum(h, 1.0, out=h)
        h *= sill * (0.5 * h**2 - 1.5)
        h += sill
        h[same] = nugget + sill
        return h

    def forward(self, rows: np.ndarray, first: int, end: int) -> None:
        """Solve for right sides, the rows, in place, from panel ``first`` (they are 0 before) to ``end``."""
        home = self.file.tell()
        for at in range(first, end, self.rows):
            where, shape = self.places[at]
            self.file.seek(where)
            panel = np.fromfile(self.file, count=shape[0] * shape[1]).reshape(shape)
            own = rows[:, at : shape[1]]
            own -= rows[:, first:at] @ panel[:, first:at].T
            own[:] = own @ panel[:, at:].T
        self.file.seek(home)

    def backward(self, rows: np.ndarray) -> None:
        """Solve for what ``forward`` left, in place: the rows are then products of the inverse covariance."""
        for at in reversed(self.places):
            where, shape = self.places[at]
            self.file.seek(where)
            panel = np.fromfile(self.file, count=shape[0] * shape[1]).reshape(shape)
            own = rows[:, at : shape[1]] @ panel[:, at:]
            rows[:, at : shape[1]] = own
            rows[:, :at] -= own @ panel[:, :at]

    def sides(self, v: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Solved for ones and for the values; products of the first with itself and with the other."""
        both = np.stack([np.ones(self.n), v])
        self.forward(both, 0, self.n)
        return both, float(both[0] @ both[0]), float(both[0] @ both[1])


def krige_panels(px: np.ndarray, py: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, model: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """``krige`` of many points, of which none share a place."""
    n, mean = len(v), v.mean()
    if model[1] == 0:  # all weights are equal, except where a cell is on a point
        places, cells = px + 1j * py, x + 1j * y
        order = np.argsort(places)
        at = order[np.minimum(np.searchsorted(places[order], cells), n - 1)]
        on = places[at] == cells
        return np.where(on, v[at], mean), np.where(on, 0.0, model[0] * (1 + 1 / n))
    panels = Panels(px, py, model)
    both, one, total = panels.sides(v - mean)
    estimate, variance = np.empty(len(x)), np.empty(len(x))
    for at in range(0, len(x), panels.rows):
        cell = slice(at, at + panels.rows)
        rows = panels.covariance(x[cell], y[cell])
        panels.forward(rows, 0, n)
        ones, values = both @ rows.T
        estimate[cell] = mean + values + (1 - ones) * (total / one)
        variance[cell] = model[0] + model[1] - np.einsum("ij,ij->i", rows, rows) + (1 - ones) ** 2 / one
    return estimate, variance


#: Cells that are solved at once.
CELLS = 256


def krige(px: np.ndarray, py: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, model: tuple[float, float, float] | None = None, inverse: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary kriging estimate and variance; one point, or equal values, give a constant surface of variance 0. ``inverse``: the points' ``factor``."""
    if len(v) == 1 or np.ptp(v) == 0:
        return np.full(len(x), v[0]), np.zeros(len(x))
    model = model or fit(px, py, v)
    if inverse is None and len(v) > WHOLE:
        px, py, v, _ = merged(px, py, v)
        if len(v) > WHOLE:
            return krige_panels(px, py, v, x, y, model)
    inverse = factor(px, py, model) if inverse is None else inverse
    scale, model = _unit(model)
    estimate, variance = np.empty(len(x)), np.empty(len(x))
    for at in range(0, len(x), CELLS):
        cell = slice(at, at + CELLS)
        right = np.ones((len(v) + 1, len(x[cell])))
        right[:-1] = spherical(np.hypot(px[:, None] - x[cell], py[:, None] - y[cell]), *model)
        weights = inverse @ right
        estimate[cell], variance[cell] = weights[:-1].T @ v, scale * (weights * right).sum(axis=0)
    return estimate, variance


def merged(px: np.ndarray, py: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places, their mean values, and each point's place. Points in one place share a weight, so kriging needs no more than these."""
    spots, of = np.unique(np.stack([px, py], 1), axis=0, return_inverse=True)
    of = of.ravel()
    return spots[:, 0], spots[:, 1], np.bincount(of, v) / np.bincount(of), of


def krige_nearest(px: np.ndarray, py: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, model: tuple[float, float, float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Kriging of each cell from its ``k`` nearest points (of points as near, the first) with the group's variogram."""
    estimate, variance, (scale, model) = np.empty(len(x)), np.empty(len(x)), _unit(model)
    for at in range(0, len(x), CELLS):
        cell = slice(at, at + CELLS)
        d = np.hypot(px - x[cell, None], py - y[cell, None])
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        right = np.ones((len(near), near.shape[1] + 1))
        right[:, :-1] = spherical(np.take_along_axis(d, near, axis=1), *model)
        weights = (factor(px[near], py[near], model) @ right[:, :, None])[:, :, 0]
        estimate[cell] = (weights[:, :-1] * v[near]).sum(axis=1)
        variance[cell] = scale * (weights * right).sum(axis=1)
    return estimate, variance


#: A network has at most so many stations (with a moving neighbourhood) or places with stations (without: their system has 40 GB in a temporary file), and a grid so many tiles; more are refused, not cut.
MOST_NEAREST, MOST_STATIONS, MOST_TILES = 20_000, 100_000, 100_000
#: Cells that meet a group's stations in one row, about, and the most tasks these rows are spread over.
SLICE, MOST_TASKS = 10_000, 2000
#: Side of a tile of cells, and of the squares that are searched first for neighbours.
TILE = 5000.0


def _networks(readings: DataFrame, keys: list[str], px: str, py: str, value: str, most: int) -> DataFrame:
    """One row per group with its valued stations as an array, empty where there are none; one station stands for a group of equal values."""
    valued = F.when(F.col(value).isNotNull(), F.struct(px, py, value))
    groups = readings.groupBy(*keys).agg(F.sort_array(F.collect_list(valued)).alias("stations"), (F.min(value) == F.max(value)).alias("_equal"))
    one = F.when(F.col("_equal"), F.slice("stations", 1, 1)).otherwise(F.col("stations"))
    return groups.select(*keys, _few(one, F.size(one), most).alias("stations"))


def _few(stations: Column, size: Column, most: int) -> Column:
    return F.when(size <= most, stations).otherwise(F.raise_error(F.lit(f"more than {most} stations in a group")))


def kriged_surface(readings: DataFrame, cells: DataFrame, keys: list[str], cell_keys: list[str], px: str = "px", py: str = "py", value: str = "value", nearest: int | None = None) -> DataFrame:
    """Kriging of every group of ``keys`` (hour, band) onto all cells (x, y): estimate and variance, null for groups without a value.

    Each group's variogram is fitted once. All stations count: those in one place are one, of their mean value, cells of one place are
    solved once, and every group meets every slice of ``SLICE`` places, for which it factors its system (by panels beyond ``WHOLE`` places with stations). Or, with ``nearest``, each cell takes its
    so many nearest stations: tiles of the grid then get the stations that may be among those, found by growing squares, and solve a small system for each cell.
    """
    if nearest is None:
        return _whole_surface(readings, cells, keys, cell_keys, px, py, value)
    tiles = cells.withColumns({"_tx": F.floor(F.col("x") / TILE).cast("long"), "_ty": F.floor(F.col("y") / TILE).cast("long")})
    blocks = tiles.groupBy("_tx", "_ty").agg(F.collect_list(F.struct(*cell_keys, "x", "y")).alias("cells"))
    listed = tiles.select("_tx", "_ty").distinct().orderBy("_tx", "_ty").limit(MOST_TILES + 1).collect()
    if len(listed) > MOST_TILES:
        raise ValueError(f"more than {MOST_TILES} tiles")
    types = dict(readings.dtypes) | dict(cells.dtypes)
    names = ", ".join(f"`{k}` {types[k]}" for k in keys)
    array = lambda s: np.array([(r[px], r[py], r[value]) for r in s], float).reshape(-1, 3)

    def fitted(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                a = array(row.stations)
                model = fit(a[:, 0], a[:, 1], a[:, 2]) if len(a) else (0.0, 0.0, 1.0)
                out.append(list(model))
            yield pdf.assign(model=out)

    points = _networks(readings, keys, px, py, value, MOST_NEAREST)
    models = points.mapInPandas(fitted, f"{names}, stations {points.schema['stations'].dataType.simpleString()}, model array<double>")
    tile = F.explode(F.array(*(F.struct(F.lit(r[0]).alias("_tx"), F.lit(r[1]).alias("_ty")) for r in listed)) if listed else F.array().cast("array<struct<_tx: bigint, _ty: bigint>>")).alias("t")
    if listed:
        models = written(models, "kriging")
        # Constant groups, and such as have no more stations than are asked for, take them all.
        many = (F.size("stations") > nearest) & (F.col("model")[0] + F.col("model")[1] > 0)
        spots = models.where(many).select(*keys, F.explode("stations").alias("s")).select(*keys, F.col(f"s.{px}").alias("px"), F.col(f"s.{py}").alias("py"), F.col(f"s.{value}").alias("_value"))
        wide = models.where(many).select(*keys, "model", tile).select(*keys, "model", "t.*")
        centred = wide.withColumns({"cx": (F.col("_tx") + 0.5) * TILE, "cy": (F.col("_ty") + 0.5) * TILE, "half": F.lit(TILE * 2**0.5 / 2)})
        reach = within_reach(centred.drop("model"), spots, keys, ["_tx", "_ty"], nearest, TILE)
        chosen = in_reach(reach, spots, keys, ["_tx", "_ty"], ["px", "py", "_value"], TILE)
        own = wide.join(chosen, [*keys, "_tx", "_ty"]).select(*keys, F.transform("points", lambda p: F.struct(p["px"].alias(px), p["py"].alias(py), p["_value"].alias(value))).alias("stations"), "model", "_tx", "_ty")
        work = own.unionByName(models.where(~many).select(*keys, "stations", "model", tile).select(*keys, "stations", "model", "t.*"))
    else:
        work = models.select(*keys, "stations", "model", tile).select(*keys, "stations", "model", "t.*")
    work = work.join(blocks, ["_tx", "_ty"])

    def solve(batches):
        numbers = lambda structs, *names: [pc.struct_field(structs, [n]).to_numpy(zero_copy_only=False).astype(float) for n in names]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                spots, places = row.column("stations").flatten(), row.column("cells").flatten()
                n, model = len(places), tuple(row.column("model").flatten().to_pylist())
                estimate = variance = None
                if len(spots):
                    sx, sy, v = numbers(spots, px, py, value)
                    x, y = numbers(places, "x", "y")
                    if len(v) > nearest and model[0] + model[1] > 0:
                        estimate, variance = krige_nearest(sx, sy, v, x, y, model, nearest)
                    else:
                        estimate, variance = krige(sx, sy, v, x, y, model)
                first = pa.array(np.zeros(n, np.int32))
                out = [row.column(k).take(first) for k in keys] + [pc.struct_field(places, [c]) for c in cell_keys]
                out += [pa.nulls(n, pa.float64()) if e is None else pa.array(e) for e in (estimate, variance)]
                yield pa.RecordBatch.from_arrays(out, names=[*keys, *cell_keys, "estimate", "variance"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, *cell_keys]) + ", estimate double, variance double"
    return work.select(*keys, "stations", "model", "cells").mapInArrow(solve, schema)


def _whole_surface(readings: DataFrame, cells: DataFrame, keys: list[str], cell_keys: list[str], px: str, py: str, value: str) -> DataFrame:
    spark, types, most = readings.sparkSession, dict(readings.dtypes), MOST_STATIONS
    names = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def fitted(batches):
        one_thread()
        for pdf in batches:
            out = []
            for stations in pdf.stations:
                a = np.array([(r[px], r[py], r[value]) for r in stations], float).reshape(-1, 3).T
                model = fit(*a) if len(a[2]) else (0.0, 0.0, 1.0)
                x, y, v, _ = merged(*a)
                if len(v) > most:
                    raise ValueError(f"more than {most} stations in a group")
                out.append((x, y, v, np.array(model)))
            yield pdf[keys].assign(**{c: [o[i] for o in out] for i, c in enumerate(("_x", "_y", "_v", "_model"))})

    points = _networks(readings, keys, px, py, value, (1 << 31) - 1).repartition(_tasks(spark))
    # Written, as each slice reads them, and to count them: partitions by size would put all of these few rows into one task.
    models = written(points.mapInPandas(fitted, f"{names}, _x array<double>, _y array<double>, _v array<double>, _model array<double>"), "kriging")
    spots = cells.select("x", "y").where("x is not null and y is not null").distinct()
    n = max(1, -(-spots.count() // SLICE))
    slices = spots.groupBy(F.pmod(F.xxhash64("x", "y"), F.lit(n)).cast("int").alias("_slice")).agg(F.collect_list(F.struct("x", "y")).alias("_cells"))
    work = models.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(slices, "_slice").repartitionByRange(max(1, min(models.count() * n, MOST_TASKS)), *keys, "_slice")

    def solve(batches):
        one_thread()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                sx, sy, v, model = (row.column(c).flatten().to_numpy() for c in ("_x", "_y", "_v", "_model"))
                places = row.column("_cells").flatten()
                x, y = (pc.struct_field(places, [c]) for c in ("x", "y"))
                numbers = [c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y)]
                out = [pa.array(e) for e in krige(sx, sy, v, *numbers, tuple(model))] if len(v) else [pa.nulls(len(x), pa.float64())] * 2
                yield pa.RecordBatch.from_arrays([*(row.column(k).take(pa.array(np.zeros(len(x), np.int32))) for k in keys), x, y, *out], names=[*keys, "x", "y", "estimate", "variance"])

    schema = f"{names}, x {dict(cells.dtypes)['x']}, y {dict(cells.dtypes)['y']}, estimate double, variance double"
    solved = work.select(*keys, "_x", "_y", "_v", "_model", "_cells").mapInArrow(solve, schema)
    return cells.select(*cell_keys, "x", "y").join(solved, ["x", "y"]).select(*keys, *cell_keys, "estimate", "variance")


def _tasks(spark: SparkSession) -> int:
    """Partitions for rows that are few and dear."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _known(px: np.ndarray, py: np.ndarray, v: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Predictions of points from the others as far as no system of all places is needed; points of the farthest pairs, points left, and the variograms that these have."""
    x, y, mean, of = merged(px, py, v)
    m, n, none = np.bincount(of), len(mean), np.empty(0, int)
    out = (np.bincount(of, v)[of] - v) / np.maximum(m[of] - 1, 1)
    distinct, held = np.unique(v, return_counts=True)
    if len(distinct) == 1:
        return v.astype(float), none, none, np.empty((0, 3))
    single = m[of] == 1
    if len(distinct) == 2:
        for i in (0, 1):
            if held[i] == 1:
                alone = int(np.flatnonzero(v == distinct[i])[0])
                out[alone], single[alone] = distinct[1 - i], False
    if not single.any():
        return out, none, none, np.empty((0, 3))
    outer, far, pairs = _remote(x, y), -1.0, none
    for b in _blocks(len(outer)):
        d = np.hypot(x[outer[b], None] - x[outer], y[outer[b], None] - y[outer])
        if d.max() > far:
            far, pairs = float(d.max()), np.zeros(n, int)
        pairs[outer[b]] += (d == far).sum(axis=1)
    ends = (2 * pairs == pairs.sum())[of]
    todo = np.flatnonzero(single & ~ends)
    c = v - v.mean()
    edges = np.linspace(0, far * 1.000001, lags + 1)
    s1, s2 = np.bincount(of, c), np.bincount(of, c * c)
    of_place = np.empty((4, n, lags))
    for b in _blocks(n):
        d = np.hypot(x[b, None] - x, y[b, None] - y)
        lag = np.digitize(d, edges[1:-1])
        for k in range(lags):
            w = (lag == k).astype(float)
            of_place[:, b, k] = w @ m, (w * d) @ m, w @ s1, w @ s2
    count, length, first, second = (p[of] for p in of_place)
    gamma = 0.5 * (count * (c * c)[:, None] - 2 * c[:, None] * first + second)
    count = count - (np.arange(lags) == 0)
    own = np.stack([count, length, gamma])
    sums = 0.5 * own.sum(axis=1)[:, None] - own
    models = np.array([fit_spherical(*(sums[1:, i, k] / sums[0, i, k]), far) for i in todo for k in [sums[0, i] > 0.5]]).reshape(-1, 3)
    flat = models[:, 1] == 0
    out[todo[flat]] = (mean.sum() - mean[of[todo[flat]]]) / (n - 1)
    return out, np.flatnonzero(single & ends), todo[~flat], models[~flat]


def _end_left_out(px: np.ndarray, py: np.ndarray, v: np.ndarray, i: int, lags: int) -> float:
    rest = np.delete(np.stack([px, py, v]), i, axis=1)
    return float(krige(*merged(*rest)[:3], px[i : i + 1], py[i : i + 1], fit(*rest, lags))[0][0])


def left_out(px: np.ndarray, py: np.ndarray, v: np.ndarray, lags: int = 4) -> np.ndarray:
    """Kriging of each point from all others, each time with the variogram that these have (``fit``).

    Lag sums without a point are all sums less its own pairs. A point whose place others share gets their mean. For the rest, with one reach the
    system of all places is diagonal in one basis for any nugget and sill, and a point's error without it is (Q v)_i / Q_ii of its inverse Q: the
    basis is found once for each reach that occurs. Points without which the farthest pair is another one are solved by themselves.
    """
    out, ends, todo, models = _known(px, py, v, lags)
    for i in ends:
        out[i] = _end_left_out(px, py, v, i, lags)
    if not len(todo):
        return out
    x, y, mean, of = merged(px, py, v)
    n, d = len(mean), np.hypot(x[:, None] - x, y[:, None] - y)
    for reach in np.unique(models[:, 2]):
        mine = np.flatnonzero(models[:, 2] == reach)
        s = spherical(d, 0.0, 1.0, reach)
        s = s - s.mean(axis=0) - s.mean(axis=1)[:, None] + s.mean() + 1.0 / n
        value, basis = np.linalg.eigh(s)
        value, basis = value[:-1], basis[:, :-1]  # the last is the constant vector's
        along = basis.T @ mean
        for j in range(0, len(mine), CELLS):
            i = mine[j : j + CELLS]
            gap = value - (models[i, 0] / models[i, 1])[:, None]
            q = np.where(np.abs(gap) > np.finfo(float).eps * (n + 1) * np.abs(gap).max(), 1 / np.where(gap == 0, 1.0, gap), 0.0)
            u = basis[of[todo[i]]]
            out[todo[i]] = v[todo[i]] - (u * q) @ along / (u * u * q).sum(axis=1)
    return out


#: Points of one factored system, where their ratios differ and where they are equal.
SPAN, EQUAL = 512, 4096


def _spans(todo: np.ndarray, models: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Points with variograms of one reach and with ratios of nugget to sill within an octave, rising: reach, points, ratios."""
    spans, ratio = [], models[:, 0] / models[:, 1]
    order = np.lexsort((ratio, models[:, 2]))
    reach, ratio, i = models[order, 2], ratio[order], 0
    while i < len(order):
        same = np.flatnonzero(reach[i:] == reach[i])[-1] + i + 1
        j = min(same, int(np.searchsorted(ratio[i:same], ratio[i], "right")) + i)
        j = min(j, i + EQUAL) if j - i > SPAN else min(int(np.searchsorted(ratio[i:same], 2 * ratio[i], "right")) + i, i + SPAN)
        spans.append((float(reach[i]), todo[order[i:j]], ratio[i:j]))
        i = j
    return spans


def span_left_out(x: np.ndarray, y: np.ndarray, v: np.ndarray, at: np.ndarray, reach: float, ratio: np.ndarray) -> np.ndarray:
    """Prediction of the places ``at`` from all others, each with its ratio of nugget to sill. No places are equal.

    The system is factored for the first ratio; for a greater one, by d, the row of its inverse Q solves (I + d Q) x = Q e. Conjugate gradients
    do that to rounding in some twenty steps, as no eigenvalue is below 1 or above the ratios' quotient.
    """
    panels, error = Panels(x, y, (float(ratio[0]), 1.0, reach)), np.empty(len(at))
    centred = v - v.mean()
    both, one, _ = panels.sides(centred)
    ones = both[:1].copy()
    panels.backward(ones)

    def inverse(rows: np.ndarray) -> np.ndarray:
        rows = rows.copy()
        panels.forward(rows, 0, panels.n)
        panels.backward(rows)
        return rows - rows.sum(axis=1)[:, None] * (ones / one)

    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    step = max(1, panels.rows // 2)
    for i in range(0, len(at), step):
        own, d = at[i : i + step], (ratio[i : i + step] - ratio[0])[:, None]
        rest = np.zeros((len(own), panels.n))
        rest[np.arange(len(own)), own] = 1.0
        rest = inverse(rest)
        if d.any():
            found, along = np.zeros_like(rest), rest.copy()
            first = left = dot(rest, rest)
            for _ in range(100):
                more = along + d * inverse(along)
                far = (left / np.maximum(dot(along, more), np.finfo(float).tiny))[:, None]
                found += far * along
                rest -= far * more
                left, before = dot(rest, rest), left
                if (left <= 1e-29 * first).all():
                    break
                along *= (left / np.maximum(before, np.finfo(float).tiny))[:, None]
                along += rest
            else:
                raise ValueError("conjugate gradients did not converge")
            rest = found
        error[i : i + step] = rest @ centred / rest[np.arange(len(own)), own]
    return v[at] - error


def kriged_leave_one_out(readings: DataFrame, keys: list[str], point: str, px: str = "px", py: str = "py", value: str = "value", least: int = 3, lags: int = 4) -> DataFrame:
    """Prediction of each reading by kriging from the other points of its group, each time with a variogram of their own (``left_out``); small groups leave.

    Of groups of more than ``WHOLE`` points, spans of points with like variograms (``_spans``) are spread over tasks, each of which factors a system.
    """
    spark, types, most, whole = readings.sparkSession, dict(readings.dtypes), MOST_STATIONS, WHOLE
    valued = F.when(F.col(value).isNotNull(), F.struct(F.col(point), F.col(px).alias("x"), F.col(py).alias("y"), F.col(value).alias("v")))
    groups = readings.groupBy(*keys).agg(F.sort_array(F.collect_list(valued)).alias("s")).where(F.size("s") >= least)
    # Written, as the numbers must stay.
    groups = written(groups.withColumn("_group", F.monotonically_increasing_id()), "left_out")
    array = lambda s: np.array([(r["x"], r["y"], r["v"]) for r in s], float).T

    def known(batches):
        one_thread()
        for pdf in batches:
            for group, stations in pdf.itertuples(index=False):
                a = array(stations)
                if len(np.unique(a[:2], axis=1).T) > most:
                    raise ValueError(f"more than {most} stations in a group")
                if len(a.T) <= whole:
                    yield pd.DataFrame({"_group": [group], "out": [left_out(*a, lags)], "reach": None, "points": [[]], "ratios": [[]]})
                    continue
                out, ends, todo, models = _known(*a, lags)
                yield pd.DataFrame({"_group": [group], "out": [out], "reach": None, "points": [[]], "ratios": [[]]})
                for i in ends:
                    yield pd.DataFrame({"_group": [group], "out": None, "reach": None, "points": [[int(i)]], "ratios": [[]]})
                for reach, points, ratios in _spans(todo, models):
                    yield pd.DataFrame({"_group": [group], "out": None, "reach": [reach], "points": [points], "ratios": [ratios]})

    plan = "_group long, out array<double>, reach double, points array<long>, ratios array<double>"
    plans = written(groups.select("_group", "s").repartition(_tasks(spark)).mapInPandas(known, plan), "left_out")
    spans = plans.where("out is null").drop("out")

    def solved(batches):
        one_thread()
        for pdf in batches:
            for group, reach, points, ratios, stations in pdf.itertuples(index=False):
                a = array(stations)
                x, y, mean, of = merged(*a)
                found = span_left_out(x, y, mean, of[points], reach, ratios) if len(ratios) else [_end_left_out(*a, points[0], lags)]
                yield pd.DataFrame({"_group": [group], "points": [points], "found": [found]})

    rows = groups.join(plans.where("out is not null").select("_group", "out"), "_group")
    n = spans.count()
    if n:
        work = spans.join(groups.select("_group", "s"), "_group").repartitionByRange(min(n, MOST_TASKS), "_group", "reach", F.col("points")[0])
        found = work.mapInPandas(solved, "_group long, points array<long>, found array<double>")
        rows = rows.join(found.groupBy("_group").agg(F.flatten(F.collect_list("points")).alias("points"), F.flatten(F.collect_list("found")).alias("found")), "_group", "left")
    else:
        rows = rows.withColumns({"points": F.array().cast("array<long>"), "found": F.array().cast("array<double>")})

    def predicted(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                *own, stations, out, points, found = row
                if points is not None and len(points):
                    out = np.array(out)
                    out[points] = found
                yield pd.DataFrame([(*own, r[point], r["v"], p) for r, p in zip(stations, np.asarray(out).tolist())], columns=[*keys, point, "observed", "predicted"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, point]) + ", observed double, predicted double"
    return rows.select(*keys, "s", "out", "points", "found").mapInPandas(predicted, schema)


def forest_downscaled(train: DataFrame, fine: DataFrame, features: list[str], target: str, trees: int = 100, depth: int = 12, seed: int = 42) -> DataFrame:
    """Random forest from the rows of ``train`` without nulls, predicted on all of ``fine``; rows without features get null."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    rows = assembler.transform(train.na.drop(how="any", subset=[*features, target]))
    if rows.isEmpty():
        raise ValueError("no overlapping valid cells to train on")
    model = RandomForestRegressor(featuresCol="_features", labelCol=target, predictionCol="predicted", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all").fit(rows)
    valid = fine.na.drop(how="any", subset=features)
    predicted = model.transform(assembler.transform(valid)).drop("_features")
    return predicted.unionByName(fine.where(" or ".join(f"{f} is null" for f in features)), allowMissingColumns=True)
