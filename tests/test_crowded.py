import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeworks.operators import spatial


@pytest.mark.parametrize("crowd", [5, 40, 100_000])
def test_crowded_squares(spark, crowd):
    """Nine tenths of all points in one square, a part of them in one place: the same pairs, and no key with many points."""
    rng = np.random.default_rng(crowd)
    crowdy = rng.uniform(1000, 1990, (540, 2))
    crowdy[:60] = (1500.0, 1500.0)
    crowdy[60:120] = rng.uniform(1500, 1510, (60, 2))
    spots = np.concatenate([crowdy, rng.uniform(-3000, 6000, (60, 2))])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "station int, px double, py double")
    grid = rng.uniform(-500, 3500, (150, 2))
    cells = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(grid)], "cell int, x double, y double")
    got = spatial.radius_join(cells, points, 1000.0, crowd)
    assert sorted(got.columns) == ["cell", "d2", "px", "py", "station", "x", "y"]
    d = ((grid[:, None] - spots[None]) ** 2).sum(axis=2)
    assert sorted((r.cell, r.station) for r in got.collect()) == sorted((int(i), int(j)) for i, j in zip(*np.nonzero(d < 1e6)))
    dealt, tree = spatial.leaves(points, 1000.0, crowd)
    leaf = ["sx", "sy", "level", "lx", "ly"]
    sizes = [r["count"] for r in dealt.join(tree, leaf).groupBy(*leaf, F.pmod("part", "parts")).count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 4 * crowd


def test_no_points(spark):
    none = spark.createDataFrame([], "station int, px double, py double")
    cells = spark.createDataFrame([(1, 0.0, 0.0)], "cell int, x double, y double")
    assert spatial.radius_join(cells, none, 10.0).count() == 0
    assert spatial.radius_join(cells.limit(0), none, 10.0).count() == 0


def test_pairs_of_two_places_follow_each_other(spark):
    """200 cells in each of 4 places, 50 points in each of 5: all pairs, in one run for every two places."""
    cells = spark.range(800).selectExpr("id AS cell", "double(id % 4 * 100) AS x", "double(0) AS y")
    points = spark.range(250).selectExpr("id AS station", "double(id % 5 * 90) AS px", "double(10) AS py")
    parts = spatial.radius_join(cells, points, 1000.0).select("x", "px", "cell", "station", "d2").rdd.glom().collect()
    rows = [tuple(r) for part in parts for r in part]
    assert len(rows) == len({(r[2], r[3]) for r in rows}) == 800 * 250
    assert all(r[4] == (r[0] - r[1]) ** 2 + 100 for r in rows)
    assert sum(a[:2] != b[:2] for a, b in zip(rows, rows[1:])) == 4 * 5 - 1


def test_places_of_many_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MEMBERS", 10)
    rows = spark.range(205).selectExpr("id", "double(greatest(id - 199, 0)) AS x", "double(0) AS y", "id % 3 AS other")
    got = spatial.places(rows, "x", "y", "members").collect()
    assert sorted(m.id for r in got for m in r.members) == list(range(205))
    assert max(len(r.members) for r in got) <= 30 and len(got) > 20


def test_idw_joins_places_once(spark, monkeypatch):
    """Many cells and readings in few places: pairs are those of places, estimates those of all readings."""
    cells = spark.range(400).selectExpr("id AS cell", "double(id % 4 * 100) AS x", "double(0) AS y")
    points = spark.range(60).selectExpr("id AS station", "double(id % 5 * 50) AS px", "double(id % 5 % 2) AS py")
    readings = points.selectExpr("station", "explode(array(1, 2)) AS hour", "CASE WHEN station % 7 > 0 THEN double(station % 11) END AS value").withColumn("value", F.col("value") * F.col("hour"))
    seen, pairs = [], spatial.place_pairs
    monkeypatch.setattr(spatial, "place_pairs", lambda *a, **b: seen.append(pairs(*a, **b)) or seen[-1])
    got = {(r.hour, r.cell): r.estimate for r in spatial.idw_surface(readings, points, cells, ["cell"], ["hour"], radius=1000.0).collect()}
    assert seen[0].count() == 4 * 5 and len(got) == 800
    for (hour, cell), estimate in got.items():
        own = [(i % 11 * hour, (cell % 4 * 100 - i % 5 * 50) ** 2 + i % 5 % 2) for i in range(60) if i % 7]
        on = [v for v, d in own if d == 0]
        want = on[0] if on else sum(v / d for v, d in own) / sum(1 / d for _, d in own)
        assert abs(estimate - want) < 1e-9
