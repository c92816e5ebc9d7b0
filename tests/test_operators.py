import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeworks.functions import headers, scalar
from hazeworks.operators import cleaning, incremental, merge, models, raster, series, spatial, splits
from hazeworks.sources import files
from hazeworks.streaming import incremental as streaming


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Header matching


def test_headers_with_damage():
    damaged = ["timestamp", "PM1 (��g/", "PM2.5 (��g/m��) c", "PM10 (��g/", "CO2 (ppm) corrected", "TVOC (ppb)", "Temperature (��C) corre", "Humidity (%) corrected"]
    found = headers.sensor_columns(damaged)
    assert found["pm1"] == damaged[1] and found["pm25"] == damaged[2] and found["pm10"] == damaged[3] and found["humidity_pct"] == damaged[7]
    assert headers.pick_pm1(["PM10 raw", "PM100"]) is None
    assert headers.pick(["Temp raw", "Temp corrected"], ["temp"], ["corr"]) == "Temp corrected"
    assert headers.pick(["x"], ["temp"]) is None


def test_sensor_csvs(spark, tmp_path):
    (tmp_path / "north-10MIN.csv").write_bytes(b"timestamp,PM1 (\xb5g/,PM2.5 (\xb5g/m\xb3) c\n2026-01-21 10:10:00+08:00,1.5,2\n2026-01-21 10:20:00+08:00,bad,\nnonsense,1,1\n")
    (tmp_path / "south_a-1HR.csv").write_text("timestamp;CO2 (ppm) corrected\n2026-01-21 11:00:00+08:00;400\n")
    separator = files.sniffed_separator(spark, str(tmp_path / "south_a-1HR.csv"))
    assert separator == ";"
    north = files.sensor_csvs(spark, [str(tmp_path / "north-10MIN.csv")])
    got = rows(north.select(F.col("timestamp_utc").cast("timestamp_ntz"), "pm1", "pm25", "co2", "station"))
    assert (dt.datetime(2026, 1, 21, 2, 10), 1.5, 2.0, None, "north") in got and (dt.datetime(2026, 1, 21, 2, 20), None, None, None, "north") in got
    south = files.sensor_csv(spark, str(tmp_path / "south_a-1HR.csv"), ";")
    assert south.first().co2 == 400.0
    with pytest.raises(ValueError):
        files.sensor_csvs(spark, [])
    (tmp_path / "south_b-1HR.csv").write_text("timestamp;CO2 (ppm) corrected\n2026-01-21 12:00:00+08:00;500\n")
    (tmp_path / "empty-1HR.csv").write_text("")
    assert [len(found) for _, found in files.header_groups(spark, str(tmp_path))] == [1, 2]
    both = files.sensor_csvs(spark, f"{tmp_path}/*.csv")
    assert sorted((r.station, r.co2) for r in both.where("co2 is not null").collect()) == [("south", 400.0), ("south", 500.0)]
    assert both.where("station = 'north'").count() == north.count()


def test_defaults_and_ranges(spark):
    assert headers.pick(["pm25 corr", "PM2.5 x", "pm 25"], ["pm25"], exact=True) == "pm 25" and headers.pick(["pm25b", "pm10"], ["pm25"], exact=True) is None
    assert headers.pick(["PM2.5 (ug)", "pm25-ug"], ["pm25", "ug"], exact=True) == "PM2.5 (ug)"
    assert headers.pick(["temp corr", "temp raw c", "temp corr c"], ["temp"], ["corr", "c"]) == "temp corr" and headers.pick(["temp raw", "temp cal x", "temp cal y"], ["temp"], ["cal", "y"]) == "temp cal y"
    assert headers.sensor_columns(["CO2 raw", "CO2 (ppm)", "CO2 (ppm) raw", "TVOC x", "TVOC (ppb) corrected"]) == {"co2": "CO2 (ppm) raw", "tvoc": "TVOC (ppb) corrected"}
    df = spark.createDataFrame([(1, '{"a": 5}'), (2, '{"a": null}'), (3, '{"b": 1}'), (4, None)], "id int, json string")
    got = df.orderBy("id").select(scalar.field_or_default(F.col("json"), "a", F.lit(9)).alias("a"), scalar.text_or_unknown(F.col("json")).alias("t")).collect()
    assert [r.a for r in got] == ["5", None, "9", "9"] and got[3].t == "unknown"
    days = spark.sql("SELECT id, date(a) AS a, date(b) AS b FROM VALUES (1, '2024-01-01', '2024-01-09'), (2, '2024-01-05', '2024-01-05'), (3, '2024-01-06', '2024-01-07') AS t(id, a, b)")
    parts = incremental.endpoint_ranges(days, "a", "b", F.lit("2024-01-05").cast("date"))
    assert sorted((r.id, r.endpoint, r.a.day, r.b.day) for r in parts.collect()) == [(1, "archive", 1, 5), (1, "forecast", 6, 9), (2, "archive", 5, 5), (3, "forecast", 6, 7)]


def test_location_documents(spark, tmp_path):
    place = {"id": 7, "name": "A", "country": {"id": 1, "code": "PH"}, "provider": {"id": 2, "name": "P"}, "isMonitor": None, "coordinates": {"latitude": 1.5, "longitude": None},
             "sensors": [{"id": 70, "name": "s", "parameter": {"id": 2, "name": "PM25", "units": "x"}}], "datetimeFirst": {"utc": "2020-01-01T00:00:00Z"}}
    (tmp_path / "page.json").write_text(json.dumps({"meta": {"page": 1}, "results": [place]}, indent=1))
    documents = files.location_documents(spark, str(tmp_path / "page.json"))
    flat = files.flat_locations(documents).first()
    assert (flat.location_key, flat.country_iso, flat.is_monitor, flat.geom) == ("openaq:7", "PH", False, None)
    assert tuple(files.location_sensors(documents).first()) == (7, "2020-01-01T00:00:00Z", 70, "pm25")


def test_measurements_from_mixed_json(spark):
    texts = [
        {"value": 3, "parameter": {"name": "PM25"}, "period": {"datetimeTo": {"utc": "2024-01-01T05:40:00Z"}, "datetimeFrom": {"utc": "2024-01-01T04:40:00Z"}}},
        {"value": "5", "parameter": "pm25", "datetime": "2024-01-01T05:10:00Z"}, {"value": 1, "parameter": "pm10", "date": {"utc": "2024-01-01T05:10:00Z"}}, {"value": "x", "parameter": "pm25", "datetimeUtc": "2024-01-01T05:10:00Z"},
        {"value": 1, "parameter": "other", "datetimeUtc": "2024-01-01T05:10:00Z"}, {"value": 1, "parameter": {"id": 3}, "datetime": {"utc": ""}},
    ]
    raw = spark.createDataFrame([("k", json.dumps(t)) for t in texts], "location_key string, json string")
    long = series.normalized_measurements(raw, {"pm25": "pm25", "pm10": "pm10"})
    wide = series.with_flags(series.pivot_mean(long, ["location_key", "timestamp_utc"], "parameter", "value", ["pm25", "pm10", "co2"]), ["co2"])
    assert rows(wide.select(F.col("timestamp_utc").cast("timestamp_ntz"), "pm25", "pm10", "co2", "has_co2")) == [(dt.datetime(2024, 1, 1, 5), 4.0, 1.0, None, False)]


def test_hourly_block_and_units(spark, tmp_path):
    one = {"latitude": 1.0, "longitude": 2.0, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "pm10": [1.0, None]}}
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "many.json").write_text(json.dumps([one, one]))
    for name, n in (("one", 2), ("many", 4)):
        assert files.hourly_block(files.grid_blocks(spark, str(tmp_path / f"{name}.json"), ["pm10"]), ["pm10"]).count() == n
    expected = spark.createDataFrame([("t", "C"), ("p", "hPa")], "variable string, unit string")
    good = spark.createDataFrame([("t", "C"), ("p", "hPa")], "variable string, unit string")
    assert series.require_units(good, good, expected) is good
    with pytest.raises(ValueError, match="p"):
        series.require_units(good, good.where("variable = 't'"), expected)
    with pytest.raises(ValueError, match="zz"):
        series.require_columns(good, ["unit", "zz"])


def test_landed_granules_and_state(spark, tmp_path):
    for name, size in (("A.h29v07.1.hdf", 200_000), ("B.h29v07.2.hdf", 10), ("C.h01v01.3.hdf", 200_000), ("D.h29v07.4.txt", 200_000)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert [r.granule for r in files.landed_granules(spark, str(tmp_path), ".hdf", "h29v07").collect()] == ["A.h29v07.1.hdf"]
    assert files.state(spark, str(tmp_path / "none"), "id string").count() == 0


# Cleaning


def series_of(spark, values, column="v"):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], f"k string, t int, {column} double")


def pandas_runs(values, skip):
    s = pd.Series([round(v * 100) / 100 if v is not None else None for v in values], dtype=float)
    s = s.dropna() if skip else s
    run = (s != s.shift()).cumsum()
    return s.groupby(run).transform("size").reindex(range(len(values)))


def test_flatlines_follow_pandas(spark):
    rng = np.random.default_rng(0)
    values = [None if rng.random() < 0.2 else float(rng.integers(0, 3)) for _ in range(400)]
    df = series_of(spark, values)
    size = pandas_runs(values, False)
    kept = [i for i, v in enumerate(values) if v is None or size[i] < 3]
    assert sorted(r.t for r in cleaning.drop_flatlines(df, ["k"], ["t"], "v", 3).collect()) == kept
    size = pandas_runs(values, True)
    want = [v if v is not None and size[i] < 3 else None for i, v in enumerate(values)]
    assert [r.v for r in cleaning.null_flatlines(df, ["k"], ["t"], "v", 3).orderBy("t").collect()] == want


def test_rolling_follows_pandas(spark):
    rng = np.random.default_rng(1)
    values = [None if rng.random() < 0.1 else float(rng.normal() * (20 if rng.random() < 0.05 else 1)) for _ in range(300)]
    s = pd.Series(values, dtype=float)
    roll = s.rolling(12, center=True, min_periods=6)
    z = (s - roll.median()).abs() / roll.std()
    kept = [i for i in range(300) if not math.isnan(s[i]) and not z[i] > 3]
    assert sorted(r.t for r in cleaning.rolling_outliers(series_of(spark, values), ["k"], ["t"], "v").collect()) == kept


def test_cleaning_chains(spark):
    df = series_of(spark, [1.0, 1.0, 1.0, 1.0, 5.0, 999.0, 2.0, None, 3.0], "pm25")
    limits = {"pm25": (0.0, 500.0)}
    assert [r.t for r in cleaning.clean_hourly(df, ["k"], "t", limits, ["pm25"]).orderBy("t").collect()] == [4, 6, 7, 8]
    assert [r.t for r in cleaning.clean_ten_minute(df, ["k"], "t", limits, ["pm25"], ["pm25"]).orderBy("t").collect()] == [4, 6, 8]
    stored = cleaning.clean_stored(df, ["k"], "t", limits)
    assert [r.pm25 for r in stored.orderBy("t").collect()] == [None] * 4 + [5.0, None, 2.0, None, 3.0]
    cells = cleaning.nulled_cells(df, stored, ["k"], "t", ["pm25"])
    assert rows(cells) == [("s", "pm25", 5)]
    assert rows(cleaning.nulled_totals(cells)) == [("pm25", 5), (None, 5)]


def test_flatline_nulling_is_idempotent(spark):
    df = series_of(spark, [1.0, 1.0, 1.0, None, 2.0, 2.0, 3.0])
    once = cleaning.null_flatlines(df, ["k"], ["t"], "v", 3)
    assert rows(once) == rows(cleaning.null_flatlines(once, ["k"], ["t"], "v", 3))


# Upserts and increments


def test_upsert_modes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0, "first"), (2, "b", 2.0, "first")], "k int, x string, y double, made string")
    new = spark.createDataFrame([(2, None, 20.0, "again", 1), (2, "late", 21.0, "again", 2), (3, "c", None, "again", 1)], "k int, x string, y double, made string, v int")
    out = merge.upsert(old, new, ["k"], "coalesce", ["made"], {"v": F.lit(9)}, [F.desc("v")])
    assert rows(out) == [(1, "a", 1.0, "first", None), (2, "late", 21.0, "first", 9), (3, "c", None, "again", 9)]
    over = merge.upsert(old, new.where("v = 1").drop("v"), ["k"], "overwrite")
    assert rows(over) == [(1, "a", 1.0, "first"), (2, None, 20.0, "again"), (3, "c", None, "again")]
    path = str(tmp_path / "t")
    table = merge.replace_table(old, path)
    assert rows(merge.replace_table(merge.upsert(table, new.drop("v"), ["k"]), path).select("k")) == [(1,), (2,), (3,)]


def test_chunks_cover_the_range(spark):
    jobs = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), dt.datetime(2022, 6, 1)), (2, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1))], "k int, start timestamp, end timestamp")
    got = incremental.chunks(jobs).orderBy("chunk_start").collect()
    assert len(got) == 3 and got[0].chunk_start == got[0].start and got[-1].chunk_end == got[-1].end and all(a.chunk_end == b.chunk_start for a, b in zip(got, got[1:]))
    assert rows(incremental.processed(jobs.select("k"), jobs.select("k"), "k")) == [(1,), (2,)]
    ends = incremental.archive_or_forecast(spark.sql("select date'2024-01-02' d union all select date'2024-01-03'"), "d", F.lit("2024-01-02").cast("date"))
    assert sorted(r.endpoint for r in ends.collect()) == ["archive", "forecast"]
    assert incremental.from_providers(jobs, F.lit("x"), []).count() == 2


# Splits


def test_splits_partition_rows(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 12).alias("station"), F.timestamp_seconds(F.col("id") * 7919 % 1000 * 3600).alias("ts"), F.when(F.col("id") % 12 < 5, "PH").otherwise("SG").alias("country"))
    split = splits.chronological(df, "ts", "id")
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 700, "validation": 150, "test": 150}
    edges = {r["split"]: (r.a, r.b) for r in split.groupBy("split").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    assert edges["train"][1] < edges["validation"][0] and edges["validation"][1] < edges["test"][0]
    left = splits.leave_stations_out(df, "station").groupBy("split").agg(F.countDistinct("station").alias("n"), F.count("*").alias("rows")).collect()
    assert {r["split"]: r.n for r in left} == {"test": 3, "validation": 3, "train": 6} and sum(r["rows"] for r in left) == 1000
    moved = splits.transfer(df, "country", "station", "ts", "PH", df.where("station = 0"))
    assert moved.count() == 1000 and {r["split"] for r in moved.select("split").distinct().collect()} == {"base", "test_stations", "fine_tune", "validation", "test_later"}
    assert sorted(splits.permuted(list("abcdef"))) == list("abcdef") and splits.permuted(list("abcdef")) == splits.permuted(list("abcdef"))


# Space and rasters


def test_projection_and_grid(spark):
    x, y = scalar.utm(F.lit(14.5995), F.lit(120.9842))
    e, n = spark.range(1).select(x, y).first()
    assert abs(e - 282868.6) < 30 and abs(n - 1614793) < 200  # Manila, zone 51 north
    e, n = spark.range(1).select(*scalar.utm(F.lit(0.0), F.lit(123.0))).first()
    assert abs(e - 500000) < 1e-6 and abs(n) < 1e-6
    lat, lon = spark.range(1).select(*scalar.from_sinusoidal(*scalar.sinusoidal(F.lit(14.5), F.lit(121.0)))).first()
    assert abs(lat - 14.5) < 1e-9 and abs(lon - 121) < 1e-9
    grid = spatial.metric_grid(spark, (120.0, 510.0), (590.0, 890.0)).collect()
    assert len(grid) == 20 and max(r.y for r in grid) == 850 and min(r.x for r in grid) == 150
    assert spatial.overlaps((0, 0, 1, 1), (1, 1, 2, 2)) and not spatial.overlaps((0, 0, 1, 1), (1.1, 0, 2, 1))


def test_idw_is_between_its_inputs_and_exact_on_points(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3000.0, 0.0), ("c", 90_000.0, 0.0)], "station string, px double, py double")
    readings = spark.createDataFrame([(1, "a", 10.0), (1, "b", 20.0), (1, "c", 99.0), (2, "a", None), (2, "b", 5.0)], "hour int, station string, value double")
    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, 1000.0, 0.0), (2, 50_000.0, 0.0)], "cell int, x double, y double")
    got = {(r.hour, r.cell): r.estimate for r in spatial.idw_surface(readings, points, cells, ["cell"], ["hour"]).collect()}
    assert got[1, 0] == 10.0 and abs(got[1, 1] - (10 / 1e6 + 20 / 4e6) / (1 / 1e6 + 1 / 4e6)) < 1e-9 and got[2, 0] == 5.0 and (1, 2) not in got


def test_kriging_properties(spark):
    px, py, v = np.array([0.0, 100.0, 50.0, 10.0]), np.array([0.0, 0.0, 80.0, 60.0]), np.array([1.0, 3.0, 2.0, 5.0])
    estimate, variance = models.krige(px, py, v, px, py)
    assert np.allclose(estimate, v, atol=1e-6) and np.allclose(variance, 0, atol=1e-6)
    assert models.krige(px[:1], py[:1], v[:1], px, py)[0].tolist() == [1.0] * 4
    readings = spark.createDataFrame([(1, 0.0, 0.0, 4.0), (2, 0.0, 0.0, 1.0), (2, 100.0, 0.0, 3.0), (2, 0.0, 90.0, 2.0), (3, 0.0, 0.0, None)], "hour int, px double, py double, value double")
    cells = spark.range(40).select(F.col("id").alias("cell"), (F.col("id") * 700.0).alias("x"), F.lit(5.0).alias("y"))
    got = models.kriged_surface(readings, cells, ["hour"], ["cell"]).collect()
    assert len(got) == 120 and {r.estimate for r in got if r.hour == 1} == {4.0} and {r.estimate for r in got if r.hour == 3} == {None}


def test_forest(spark):
    fine = spark.range(200).select(F.col("id").alias("cell"), F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("f"))
    train = spark.range(200).select(F.col("id").cast("double").alias("f"), (F.col("id") * 2.0).alias("target"))
    got = models.forest_downscaled(train, fine, ["f"], "target", trees=10, depth=5).collect()
    assert len(got) == 200 and all((r.predicted is None) == (r.f is None) for r in got) and all(0 <= r.predicted <= 398 for r in got if r.predicted is not None)
    with pytest.raises(ValueError):
        models.forest_downscaled(train.limit(0), fine, ["f"], "target")


def test_rasters(spark):
    pixels = spark.createDataFrame([("r", 0, 0, None, 0), ("r", 1, 2, 5.0, 1), ("r", 2, 1, 6.0, 65535), ("e", 0, 0, None, 4)], "raster_id string, row int, col int, v double, qa int")
    meta = spark.createDataFrame([(i, 10.0, 0.0, 500.0, 0.0, -10.0, 900.0, 3, 3) for i in "re"], "raster_id string, a double, b double, c double, d double, e double, f double, width int, height int")
    assert {(r.row, r.col): r.v for r in raster.masked(pixels.where("raster_id = 'r'"), "qa", ["v"]).collect()} == {(0, 0): None, (1, 2): 5.0, (2, 1): None}
    moved, origin = raster.trimmed(pixels, meta, ["v"])
    assert rows(moved.select("row", "col", "v")) == [(0, 1, 5.0), (1, 0, 6.0)]
    o = origin.first()
    assert (o.c, o.f, o.width, o.height) == (510.0, 890.0, 2, 2)
    assert raster.valid_cells(raster.exported(pixels, ["v"]), "v").count() == 2
    stats = series.band_statistics(spark.createDataFrame([("m", 1.0)] * 26 + [("m", 0.0)] * 19, "band string, v double"), ["band"], "v").first()
    assert abs(stats["mean"] - 0.57777777777778) < 1e-12 and abs(stats["stddev"] - 0.49391357268651) < 1e-12 and stats.valid_percent == 100
    near = raster.clipped(spark.createDataFrame([("r", 0, 0), ("r", 0, 1)], "raster_id string, row int, col int"), meta.withColumns({"c": F.lit(0.0), "a": F.lit(111_195.0 * 2), "f": F.lit(0.0)}).where("raster_id = 'r'"), (0.0, -1.0, 1.5, 1.0))
    assert [(r.row, r.col) for r in near.collect()] == [(0, 0)]


def test_scalars(spark):
    day = F.lit("2024-05-01").cast("date")
    got = spark.range(1).select(
        scalar.day_path(day), scalar.composite_due(day), scalar.round2(F.lit(1.015)), scalar.stem_without(F.lit("a-clean"), "-clean"), scalar.nan_to_null(F.lit(float("nan"))), scalar.month_windows(day, 2, 4),
        scalar.ndvi(F.lit(1.0), F.lit(-1.0)), F.date_format(scalar.history_start(F.lit("junk"), F.lit("2024-01-01").cast("timestamp")), "yyyy"), scalar.by_country(F.lit("XX"), scalar.CITIES),
    ).first()
    assert tuple(got[:5]) == ("2024/122", True, 1.01, "a", None)
    assert [(str(w.start), str(w.end)) for w in got[5]] == [("2024-01-01", "2024-05-01"), ("2023-09-01", "2024-01-01")] and tuple(got[6:]) == (None, "2024", None)
    assert scalar.padded_box("1,2,3,4", 0.5) == (0.5, 1.5, 3.5, 4.5)
    assert spatial.grid_centres(spark, (120.75, 14.25, 121.5, 15.25)).count() == 12


# Streaming


def test_stream_of_new_files(spark, tmp_path):
    folder, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    write = lambda ids: spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i % 5, 30), float(i)) for i in ids], "id long, ts timestamp, v double").write.mode("append").parquet(folder)
    run = lambda: streaming.run_available(streaming.new_files(spark, folder, "id long, ts timestamp, v double"), check, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    write(range(10))
    run()
    write(range(10, 15))
    run()
    run()
    assert spark.read.parquet(out).count() == 15
    means = streaming.hourly_means(streaming.new_files(spark, folder, "id long, ts timestamp, v double"), [], "ts", "v", "1 hour")
    streaming.run_available(means, str(tmp_path / "check2"), lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/means/batch={n}")).awaitTermination()
    closed = spark.read.parquet(f"{tmp_path}/means").collect()
    assert closed and all(r.n == 3 for r in closed)


def test_granule_chain_and_listings(spark):
    raw = spark.createDataFrame([("r", 0, 0, 500, 0), ("r", 0, 1, -28672, 0), ("r", 0, 2, 700, 4), ("r", 0, 3, 900, 1), ("e", 0, 0, 500, 7)], "raster_id string, row int, col int, aod int, qa int")
    meta = spark.createDataFrame([(i, 100.0, 0.0, 0.0, 0.0, -100.0, 0.0, 4, 1) for i in "re"], "raster_id string, a double, b double, c double, d double, e double, f double, width int, height int")
    pixels, origin = raster.processed_granules(raw, meta, (-1.0, -1.0, 1.0, 1.0), ["aod"])
    assert sorted((r.col, None if r.aod is None else round(r.aod, 3)) for r in pixels.collect()) == [(0, 0.5), (1, None), (2, None), (3, 0.9)]
    assert [(r.raster_id, r.width) for r in origin.collect()] == [("r", 4)]
    listing = spark.createDataFrame([("a_NO2_1", dt.datetime(2024, 1, 5), 10.0), ("a_NO2_0", dt.datetime(2023, 1, 5), 90.0), ("a_CO_1", dt.datetime(2024, 1, 5), None)], "granule string, sensed_at timestamp, cloud_cover double")
    done = listing.where("false")
    assert rows(incremental.new_granules(listing, done, "NO2", F.lit("2024-01-01").cast("timestamp")).select("granule")) == [("a_NO2_1",)]
    assert incremental.clear_enough(listing).count() == 1
    jobs = spark.createDataFrame([(1, 5), (0, 9), (0, 3)], "priority int, start int")
    assert [tuple(r) for r in incremental.by_priority(jobs).collect()] == [(0, 3), (0, 9), (1, 5)]


def test_reports_and_columns(spark):
    cells = spark.createDataFrame([("a", "pm25", 2), ("a", "pm10", 1), ("b", "pm25", 4)], "k string, parameter string, nulled long")
    assert cleaning.report(cells, ["k"]).split("\n") == ["a: pm10=1, pm25=2", "b: pm25=4", "total: 7 cells", "  pm10: 1", "  pm25: 6"]
    double = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int").toDF("x", "y", "x")
    assert series.with_unique_columns(double).columns == ["x", "y"] and series.with_unique_columns(double).first().x == 1
    assert series.backfilled(cells, {"pm1": "double", "k": "string"}).dtypes[-1] == ("pm1", "double")


def test_model_queries_take_whole_tables(spark, monkeypatch):
    """Every nation's stations are kriged onto every part, and the forest has the operator's own size."""
    from hazeworks.plans import catalogue

    seen = []
    monkeypatch.setattr(models, "kriged_surface", lambda *a, **b: seen.append((a, b)) or a[0])
    monkeypatch.setattr(models, "forest_downscaled", lambda *a, **b: seen.append((a, b)) or a[0])
    for name in ("kriged_surface", "forest_downscaled"):
        catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    whole = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count()
    (stations, cells, *_), _ = seen[0]
    assert (stations.count(), cells.count()) == (whole("supplier"), whole("part"))
    (train, fine, *rest), options = seen[1]
    assert (train.count(), fine.count()) == (whole("part"), whole("part"))
    assert len(rest) == 2 and not options


def test_a_table_survives_an_interrupted_replacement(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.replace_table(spark.range(3).toDF("k"), path)
    (tmp_path / "t").rename(tmp_path / "t-old")
    assert merge.recovered_table(spark, path).count() == 3
    assert merge.replace_table(merge.recovered_table(spark, path).where("k > 0"), path).count() == 2 and not (tmp_path / "t-old").exists()


def test_kriging_of_empty_groups_and_leave_one_out(spark):
    points = [(h, i, float(i % 5) * 900, float(i // 5) * 800, float(i % 5) + 2.0 * (i // 5) if h else None) for h in (0, 1) for i in range(15)]
    readings = spark.createDataFrame(points, "hour int, station int, px double, py double, value double")
    cells = spark.createDataFrame([(i, 400.0 * i, 300.0 * i) for i in range(20)], "cell int, x double, y double")
    got = models.kriged_surface(readings, cells, ["hour"], ["cell"]).collect()
    assert len(got) == 40 and all((r.estimate is None) == (r.hour == 0) for r in got)
    assert models.kriged_surface(readings, cells.limit(0), ["hour"], ["cell"]).count() == 0
    left = models.kriged_leave_one_out(readings, ["hour"], "station").collect()
    assert {r.hour for r in left} == {1} and len(left) == 15
    one = next(r for r in left if r.station == 7)
    rest = np.array([p[2:] for p in points if p[0] == 1 and p[1] != 7], float)
    want = models.krige(rest[:, 0], rest[:, 1], rest[:, 2], np.array([1800.0]), np.array([800.0]))[0][0]
    assert abs(one.predicted - want) < 1e-9 and abs(one.predicted - one.observed) < 1.5
