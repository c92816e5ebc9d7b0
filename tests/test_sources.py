import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from hazeworks.sources import rest, sinks


class Api(BaseHTTPRequestHandler):
    """Two pages per region; the first call of region 2 fails once; region 9 is rejected, region 8 forbidden."""

    failed: set = set()

    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        code = {"9": 422, "8": 403, "7": 500}.get(q["region"], 200)
        if q["region"] == "2" and "2" not in self.failed:
            self.failed.add("2")
            code = 503
        self.send_response(code)
        self.end_headers()
        if code == 200:
            self.wfile.write(json.dumps({"results": [{"id": f"{q['region']}-{q['page']}-{i}"} for i in range(2)] if int(q["page"]) <= 2 else []}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture()
def url():
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v3"
    server.shutdown()


def test_paged_scan(spark, url):
    rest.register(spark)
    read = lambda regions, **o: spark.read.format("paged_json").options(url=url, requests=json.dumps([{"region": r} for r in regions]), wait="0.01", attempts="2", **o).load()
    everything = read([1, 2, 9])
    assert [(r.request, r.error) for r in everything.where("error is not null").collect()] == [('{"region": 9}', "rejected: 422")]
    got = everything.where("error is null").select(F.get_json_object("json", "$.id").alias("id")).collect()
    assert sorted(r.id for r in got) == sorted(f"{r}-{p}-{i}" for r in (1, 2) for p in (1, 2) for i in (0, 1))
    for found, error in ((read([1, 7], skip_failed="true"), "failed 2 times"), (read([1, 1], max_pages="1"), "ended after 1 pages")):
        assert found.where("json is not null").count() == 4 and found.where(F.col("error").contains(error)).count() > 0
    assert read([1, 2, 1, 2, 1], readers="2").rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="403"):
        read([8]).count()
    assert rest.spacing(45, 1500) == 2.4
    budget = lambda n: rest.PagedReader({"url": url, "requests": json.dumps([{}] * n), "spacing": "1"})
    assert [(budget(n).spacing, len(budget(n).partitions())) for n in (1, 3, 1000)] == [(1, 1), (3, 3), (4, 4)]
    rest.verify(url, "k", region="1")
    rest.verify(url, "k", region="9")
    with pytest.raises(rest.AccessDenied):
        rest.verify(url, "k", region="8")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("h1", "pm25", 1, 2.0), ("h1", "pm25", 2, float("nan")), ("h1", "pm10", 1, 4.0)], "hour string, band string, cell int, estimate double")
    stats = {r.band: r for r in sinks.write_surfaces(df, str(tmp_path / "s"), ["hour", "band"]).collect()}
    assert stats["pm25"].valid_percent == 50.0 and stats["pm10"]["mean"] == 4.0
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("estimate is null").count() == 1
    sinks.create_tables(spark, ["openmeteo_pm10_grid"])
    assert spark.table("openmeteo_pm10_grid").columns[0] == "grid_key"
    spark.sql("DROP TABLE openmeteo_pm10_grid")
    assert sinks.save_state(df.select("cell").distinct(), str(tmp_path / "state")).count() == 2


def test_parents_and_locations(spark, tmp_path):
    from hazeworks.operators import incremental
    from hazeworks.sources import files

    (tmp_path / "m.json").write_text('{"locationId": 5}\n{"locationId": null}\n{"value": 1}\n')
    rows = files.measurement_rows(spark, str(tmp_path / "m.json"), F.lit(7))
    assert sorted(r.location_key for r in rows.collect()) == ["5", "7", "unknown"]
    stations = spark.createDataFrame([("5",), ("7",)], "location_key string")
    with pytest.raises(ValueError, match=r"location_key: unknown \(1\)"):
        incremental.require_parents(rows, stations, "location_key")
    assert incremental.require_parents(rows.where("location_key <> 'unknown'"), stations, "location_key").count() == 2


def test_training_tables(spark, tmp_path):
    from hazeworks.operators import splits
    from hazeworks.sources import files

    (tmp_path / "m.csv").write_text("location_key,timestamp_utc,pm25\n007,2025-01-01 00:00:00,1.5\n007,2025-01-01 01:00:00,n/a\n8,2025-01-01 02:00:00,NaN\n")
    (tmp_path / "l.csv").write_text("location_key,city,latitude\n007,Bonn,50.7\n8,,x\n")
    m, places = files.training_tables(spark, str(tmp_path / "m.csv"), str(tmp_path / "l.csv"))
    assert sorted((r.location_key, str(r.timestamp_utc), r.pm25) for r in m.collect()) == [("007", "2025-01-01 00:00:00", 1.5), ("007", "2025-01-01 01:00:00", None), ("8", "2025-01-01 02:00:00", None)]
    assert sorted(map(tuple, places.collect())) == [("007", "Bonn", 50.7), ("8", None, None)]
    assert splits.at_places(m, places.where("city is null")).count() == 1
    (tmp_path / "bad.csv").write_text("location_key,timestamp_utc\n7,noon\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.training_tables(spark, str(tmp_path / "bad.csv"), str(tmp_path / "l.csv"))[0].collect()
    with pytest.raises(ValueError, match="timestamp_utc"):
        files.training_tables(spark, str(tmp_path / "l.csv"), str(tmp_path / "l.csv"))
