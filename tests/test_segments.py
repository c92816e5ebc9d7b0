"""Windows in segments give what windows over whole series give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hazeworks.operators import cleaning, segments

SIZES = [1, 7, 1000, None]


def run_lengths(values, skip):
    """Length of each value's run of equal ones; None where nulls are skipped."""
    out, places = [None if skip and v is None else 1 for v in values], []
    for i, v in enumerate(values):
        if v is None and skip:
            continue
        if places and v is not None and values[places[-1]] == v:
            places.append(i)
        else:
            places = [i]
        for p in places:
            out[p] = len(places)
    return out


def rows_of(seed, n=90):
    rng = random.Random(seed)
    out = []
    for key in ("a", None, "b"):
        t = 0
        while t < (n if key == "a" else n // 3):
            v, w = rng.choice([None, 1.0, 1.0, 2.0, 3.0]), rng.choice([None, 5.0, 6.0])
            for _ in range(rng.choice([1, 1, 2, 3, 9])):
                out.append((key, t, v, w if rng.random() < 0.8 else None))
                t += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, v double, w double").repartition(4)


@pytest.mark.parametrize("rows", SIZES)
@pytest.mark.parametrize("skip", [True, False])
def test_run_lengths(spark, rows, skip):
    data = rows_of(1)
    held = segments.segmented(frame(spark, data), ["k"], ["t"], rows)
    if rows == 1:
        assert held.select("_seg").distinct().count() > len(data) // 2
    got = {(r.k, r.t): (r.nv, r.nw) for r in segments.run_lengths(held, ["t"], {"nv": F.col("v"), "nw": F.col("w")}, skip).collect()}
    want = {}
    for key in ("a", None, "b"):
        own = sorted(r for r in data if r[0] == key)if key else sorted((r for r in data if r[0] is None), key=lambda r: r[1])
        own.sort(key=lambda r: r[1])
        want |= {(key, r[1]): x for r, x in zip(own, zip(run_lengths([r[2] for r in own], skip), run_lengths([r[3] for r in own], skip)))}
    assert got == want


@pytest.mark.parametrize("rows", SIZES)
def test_frames(spark, rows):
    df = frame(spark, rows_of(2))
    w = Window.partitionBy("k").orderBy("t").rowsBetween(-6, 5)
    stats = lambda x: {"n": F.count("v").over(x), "m": F.percentile(F.col("v"), F.lit(0.5)).over(x), "s": F.round(F.stddev_samp("v").over(x), 9)}
    want = {tuple(r) for r in df.withColumns(stats(w)).collect()}
    assert {tuple(r) for r in segments.plain(segments.framed(segments.segmented(df, ["k"], ["t"], rows), ["t"], 6, 5, stats, rows)).collect()} == want


@pytest.mark.parametrize("rows", SIZES)
def test_passes_in_turn(spark, rows):
    """Later passes see the rows that earlier ones left, across segments that have become empty."""
    data = rows_of(3)
    got = cleaning.clean_ten_minute(frame(spark, data), ["k"], "t", {"v": (0.0, 2.5)}, ["v", "w"], ["v"], rows)
    want = []
    for key in ("a", None, "b"):
        own = sorted((r for r in data if r[0] == key and (r[2] is None or 0 <= r[2] <= 2.5)), key=lambda r: r[1])
        for c in (2, 3):
            own = [r for r, n in zip(own, run_lengths([r[c] for r in own], False)) if n < 4]
        left = []
        for i, r in enumerate(own):
            near = sorted(x[2] for x in own[max(0, i - 6) : i + 6] if x[2] is not None)
            if r[2] is None:
                continue
            n = len(near)
            mean = sum(near) / n
            sd = (sum((x - mean) ** 2 for x in near) / (n - 1)) ** 0.5 if n > 1 else None
            median = (near[n // 2] + near[(n - 1) // 2]) / 2
            if not (n >= 6 and sd and abs(r[2] - median) / sd > 3):
                left.append(r)
        want += left
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    stored = cleaning.clean_stored(frame(spark, data), ["k"], "t", {"v": (0.0, 2.5), "w": (0.0, 9.0)}, rows)
    for r in stored.collect():
        assert r.v is None or r.v <= 2.5
    own = sorted((r for r in data if r[0] is None), key=lambda r: r[1])
    v = [None if r[2] is None or r[2] > 2.5 else r[2] for r in own]
    assert {r.t: r.v for r in stored.where("k is null").collect()} == {r[1]: x if n and n < 3 else None for r, x, n in zip(own, v, run_lengths(v, True))}


def test_one_key_with_all_rows_has_many_tasks(spark):
    df = spark.range(3000).select(F.lit("x").alias("k"), F.col("id").alias("t"), (F.col("id") % 1700 < 1500).cast("double").alias("v"))
    held = segments.segmented(df, ["k"], ["t"], 100)
    sizes = [r["count"] for r in held.groupBy("_seg").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 300
    runs = segments.run_lengths(held, ["t"], {"n": F.col("v")}, False)
    assert {r.n for r in runs.select("n").distinct().collect()} == {1500, 200, 1300}


def test_empty(spark):
    none = frame(spark, rows_of(1)).limit(0)
    assert cleaning.clean_ten_minute(none, ["k"], "t", {}, ["v"], ["v"]).count() == 0
    assert cleaning.clean_stored(none, ["k"], "t", {"v": (0.0, 1.0)}).count() == 0
