import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeworks.operators import models, neighbours, spatial


def network(rng, n, spread=40_000.0):
    return rng.uniform(0, spread, n), rng.uniform(0, spread, n), rng.normal(20, 5, n)


def dense(px, py, v, x, y, model):
    """The system solved as it is written down."""
    n = len(v)
    left = np.ones((n + 1, n + 1))
    left[n, n] = 0
    left[:n, :n] = models.spherical(np.hypot(px[:, None] - px, py[:, None] - py), *model)
    right = np.ones((n + 1, len(x)))
    right[:n] = models.spherical(np.hypot(px[:, None] - x, py[:, None] - y), *model)
    w = np.linalg.lstsq(left, right, rcond=None)[0]
    return w[:n].T @ v, (w * right).sum(axis=0)


def test_factor_equals_the_dense_solution():
    rng = np.random.default_rng(1)
    for n in (2, 7, 60):
        px, py, v = network(rng, n)
        px[-1], py[-1] = px[0], py[0]  # two stations in one place
        x, y, _ = network(rng, 50)
        for model in ((0.5, 2.0, 9000.0), models.fit(px, py, v)):
            want = dense(px, py, v, x, y, model)
            for got in (models.krige(px, py, v, x, y, model), models.krige_nearest(px, py, v, x, y, model, n), models.krige(px, py, v, x, y, model, models.factor(px, py, model))):
                assert np.abs(got[0] - want[0]).max() < 1e-9 and np.abs(got[1] - want[1]).max() < 1e-9


def test_fit_in_blocks(monkeypatch):
    px, py, v = network(np.random.default_rng(2), 90)
    whole = models.fit(px, py, v)
    monkeypatch.setattr(models, "ROWS", 7)
    assert np.allclose(models.fit(px, py, v), whole)


def surface(spark, stations, cells, **options):
    readings = spark.createDataFrame([(h, float(a), float(b), c) for h, s in stations.items() for a, b, c in s], "hour int, px double, py double, value double")
    grid = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cells)], "cell int, x double, y double")
    return {(r.hour, r.cell): (r.estimate, r.variance) for r in models.kriged_surface(readings, grid, ["hour"], ["cell"], **options).collect()}


def test_surfaces_with_a_moving_neighbourhood(spark):
    """Crowded, sparse, far-off, constant, small and empty groups; each cell has the nearest stations of its group."""
    rng = np.random.default_rng(3)
    x, y, _ = network(rng, 60, 23_000.0)
    groups = {1: np.stack(network(rng, 300, 20_000.0), 1), 2: np.stack(network(rng, 40, 400_000.0), 1), 4: np.array([[1.0, 2.0, 3.0], [9.0, 9.0, 8.0]])}
    groups[3] = groups[1].copy()
    groups[3][:, 2] = 4.0
    stations = {h: [(a, b, float(c)) for a, b, c in g] for h, g in groups.items()} | {5: [(0.0, 0.0, None)]}
    got = surface(spark, stations, list(zip(x, y)), nearest=8)
    assert len(got) == 5 * 60
    for h, g in groups.items():
        g = g[np.lexsort(g.T[::-1])]
        model = models.fit(*g.T)
        for i in range(60):
            if h == 3:
                assert got[h, i] == (4.0, 0.0)
                continue
            near = g[np.argsort(np.hypot(g[:, 0] - x[i], g[:, 1] - y[i]), kind="stable")[:8]]
            want = dense(*near.T, x[i : i + 1], y[i : i + 1], model)
            assert abs(got[h, i][0] - want[0][0]) < 1e-8 and abs(got[h, i][1] - want[1][0]) < 1e-8
    assert {got[5, i] for i in range(60)} == {(None, None)}
    every = surface(spark, stations, list(zip(x, y)))
    g = groups[2]
    want = dense(*g[np.lexsort(g.T[::-1])].T, x, y, models.fit(*g[np.lexsort(g.T[::-1])].T))
    assert max(abs(every[2, i][0] - want[0][i]) for i in range(60)) < 1e-9
    assert surface(spark, stations, [], nearest=8) == {}


def test_too_many_stations_are_refused(spark, monkeypatch):
    monkeypatch.setattr(models, "MOST_STATIONS", 10)
    with pytest.raises(Exception, match="more than 10 stations"):
        surface(spark, {1: [(float(i), 0.0, float(i)) for i in range(11)]}, [(0.0, 0.0)])


def test_reach(spark):
    """Squares grow where points are far; the k nearest of any place of a tile are in reach."""
    rng = np.random.default_rng(4)
    px, py = np.concatenate([rng.normal(0, 300, 200), rng.uniform(-90_000, 90_000, 30)]), np.concatenate([rng.normal(0, 300, 200), rng.uniform(-90_000, 90_000, 30)])
    points = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(px, py)], "g int, px double, py double")
    tiles = spark.createDataFrame([(1, i, float(i) * 7000 - 30_000, 500.0, 700.0) for i in range(10)], "g int, t int, cx double, cy double, half double")
    reach = neighbours.within_reach(tiles, points, ["g"], ["t"], 5, 1000.0)
    found = {r.t: {(p.px, p.py) for p in r.points} for r in neighbours.in_reach(reach, points, ["g"], ["t"], ["px", "py"], 1000.0).collect()}
    for r in reach.collect():
        for angle in np.linspace(0, 6, 9):
            x, y = r.cx + 690 * np.cos(angle), r.cy + 690 * np.sin(angle)
            near = np.argsort(np.hypot(px - x, py - y))[:5]
            assert {(px[i], py[i]) for i in near} <= found[r.t]
    assert len({r.reach for r in reach.collect()}) > 2


def test_grid_of_the_metropolis(spark):
    """An extent of 38.2 by 46.9 km has 382 x 469 cells of 100 m."""
    grid = spatial.metric_grid(spark, (270_013.0, 1_580_050.0), (308_190.0, 1_626_840.0))
    r = grid.agg(F.count("*").alias("n"), F.max("row").alias("row"), F.max("col").alias("col")).first()
    assert (r.n, r.row + 1, r.col + 1) == (382 * 469, 469, 382)


def test_leave_one_out_equals_kriging_from_the_rest():
    """Scattered and crowded networks, stations in one place, few values, on a line."""
    rng = np.random.default_rng(6)
    for n in (3, 4, 9, 30, 80):
        for kind in range(5):
            px, py, v = network(rng, n)
            if kind == 1:
                px[n // 2 :], py[n // 2 :] = px[: n - n // 2], py[: n - n // 2]
            if kind == 2:
                v = np.where(np.arange(n) == 1, 3.0, 5.0)
            if kind == 3:
                py[:] = 0.0
            if kind == 4:
                v = px / 1000 + rng.normal(0, 0.5, n)
            got = models.left_out(px, py, v)
            for i in range(n):
                rest = np.delete(np.stack([px, py, v]), i, axis=1)
                assert abs(got[i] - models.krige(*rest, px[i : i + 1], py[i : i + 1])[0][0]) < 1e-6


def test_stations_in_one_place_count_once(spark, monkeypatch):
    """Limits are on places: more stations than that are taken where they share places or have one value."""
    monkeypatch.setattr(models, "MOST_STATIONS", 10)
    rng = np.random.default_rng(7)
    x, y, _ = network(rng, 8)
    crowd = [(float(x[i % 8]), float(y[i % 8]), float(i % 13)) for i in range(40)]
    cells = [(100.0, 5.0), (9000.0, 800.0), (100.0, 5.0)]
    equal = [(float(i), 0.0, 2.5) for i in range(30)]
    got = surface(spark, {1: crowd, 2: equal}, cells)
    px, py, v = np.array(crowd).T
    want = dense(px, py, v, *np.array(cells).T, models.fit(px, py, v))
    assert all(abs(got[1, i][0] - want[0][i]) < 1e-8 and abs(got[1, i][1] - want[1][i]) < 1e-8 and got[2, i] == (2.5, 0.0) for i in range(3))
    readings = spark.createDataFrame([(1, i, *r) for i, r in enumerate(crowd)], "hour int, station int, px double, py double, value double")
    left = {r.station: r.predicted for r in models.kriged_leave_one_out(readings, ["hour"], "station").collect()}
    assert len(left) == 40 and abs(left[0] - np.mean([c[2] for c in crowd[8::8]])) < 1e-9


def test_panels_equal_the_whole_system(monkeypatch):
    """Kriging and leaving out by panels of a few rows, with and without nugget and sill, cells on stations among them."""
    rng = np.random.default_rng(8)
    px, py, v = network(rng, 150)
    x, y, _ = network(rng, 40)
    x[:4], y[:4] = px[:4], py[:4]
    monkeypatch.setattr(models, "PANEL", 16)
    for model in ((0.5, 2.0, 9000.0), (0.0, 2.0, 50_000.0), (3.0, 0.0, 9000.0), models.fit(px, py, v)):
        for got, want in zip(models.krige_panels(px, py, v, x, y, model), models.krige(px, py, v, x, y, model)):
            assert np.abs(got - want).max() < 1e-8
    for values in (v, px / 1000 + rng.normal(0, 0.5, 150), np.where(px > 20_000, 1.0, 2.0)):
        want = models.left_out(px, py, values)
        got, ends, todo, fits = models._known(px, py, values, 4)
        for i in ends:
            got[i] = want[i]
        for reach, points, ratios in models._spans(todo, fits):
            got[points] = models.span_left_out(px, py, values, points, reach, ratios)
        assert np.abs(got - want).max() < 1e-8


def test_spans():
    """Each point is in one span, of one reach and one octave, and equal ratios stay together up to a limit."""
    rng = np.random.default_rng(9)
    ratio = np.concatenate([rng.uniform(0, 50, 1500), np.full(5000, 7.0)])
    fits = np.stack([ratio * 2, np.full(6500, 2.0), rng.choice([100.0, 200.0], 6500)], 1)
    spans = models._spans(np.arange(6500), fits)
    assert sorted(np.concatenate([p for _, p, _ in spans]).tolist()) == list(range(6500))
    for reach, points, own in spans:
        assert (fits[points, 2] == reach).all() and np.allclose(own, ratio[points]) and own[-1] <= 2 * own[0] and (np.diff(own) >= 0).all()
        assert len(own) <= models.SPAN or own[0] == own[-1] and len(own) <= models.EQUAL


def test_more_than_4000_places_in_a_group(spark):
    """The whole job where one task can't hold a dense system: the surface of all stations, and each station left out."""
    rng = np.random.default_rng(10)
    n = 4100
    px, py, v = np.round(rng.permutation(n) * 9.0), np.round(rng.permutation(n) * 9.0), rng.normal(20, 5, n)
    x, y, _ = network(rng, 12, 36_000.0)
    got = surface(spark, {1: np.stack([px, py, v], 1).tolist()}, list(zip(x, y)))
    order = np.lexsort([py, px])
    model = models.fit(px[order], py[order], v[order])
    assert len(got) == 12
    left = np.ones((n + 1, n + 1))
    left[n, n] = 0
    left[:n, :n] = models.spherical(np.hypot(px[:, None] - px, py[:, None] - py), *model)
    right = np.ones((n + 1, 12))
    right[:n] = models.spherical(np.hypot(px[:, None] - x, py[:, None] - y), *model)
    w = np.linalg.solve(left, right)
    assert max(abs(got[1, i][0] - w[:n, i] @ v) for i in range(12)) < 1e-7 and max(abs(got[1, i][1] - w[:, i] @ right[:, i]) for i in range(12)) < 1e-7
    # All places but eight hold two stations.
    twice = [(1, i, float(px[i % n]), float(py[i % n]), float(v[i % n] + i // n)) for i in range(2 * n - 8)]
    readings = spark.createDataFrame(twice, "hour int, station int, px double, py double, value double")
    left = {r.station: r.predicted for r in models.kriged_leave_one_out(readings, ["hour"], "station").collect()}
    assert len(left) == len(twice) and abs(left[0] - v[0] - 1) < 1e-9
    a = np.array([t[2:] for t in twice]).T
    i = n - 3
    rest = np.delete(a, i, axis=1)
    want = models.krige(*models.merged(*rest)[:3], a[0, i : i + 1], a[1, i : i + 1], models.fit(*rest))[0][0]
    assert abs(left[i] - want) < 1e-7


def test_leave_one_out_of_large_groups(spark, monkeypatch):
    """Spans of points in tasks of their own give what one task gives; groups with and without spans, and keys that are null."""
    rng = np.random.default_rng(11)
    readings = []
    for hour, n in ((1, 60), (2, 5), (None, 40), (4, 30)):
        px, py, v = network(rng, n)
        if hour == 4:
            px, py = px[np.arange(n) // 2 * 2], py[np.arange(n) // 2 * 2]
        readings += [(hour, i, float(px[i]), float(py[i]), float(v[i])) for i in range(n)]
    table = spark.createDataFrame(readings, "hour int, station int, px double, py double, value double")
    rows = lambda: {(r.hour, r.station): (r.observed, r.predicted) for r in models.kriged_leave_one_out(table, ["hour"], "station").collect()}
    want = rows()
    monkeypatch.setattr(models, "WHOLE", 10)
    got = rows()
    assert got.keys() == want.keys() and len(got) == 135 and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in got)


def test_large_values_keep_the_smallest_eigenvalue():
    """Weights don't depend on the variogram's scale, which made the pseudo-inverse drop an eigenvalue of the system."""
    rng = np.random.default_rng(12)
    px, py, v = network(rng, 300)
    x, y, _ = network(rng, 20)
    small = models.krige(px, py, v, x, y, (0.5, 0.5, 5000.0))
    for scale in (1e-6, 1e7):
        for got in (models.krige(px, py, v, x, y, (0.5 * scale, 0.5 * scale, 5000.0)), models.krige_nearest(px, py, v, x, y, (0.5 * scale, 0.5 * scale, 5000.0), 300)):
            assert np.allclose(got[0], small[0], rtol=1e-9) and np.allclose(got[1], small[1] * scale, rtol=1e-9)
