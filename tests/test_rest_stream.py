"""Filters that reach the service, and the paged source as a stream, against a small server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from hazeworks.sources import rest


class Service(BaseHTTPRequestHandler):
    """Places at /places; at /hours readings of (location, parameter), two a page, by time."""

    calls: list = []
    down: set = set()
    hours: dict = {}

    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        self.calls.append(q)
        self.send_response(500 if q.get("parameter") in self.down else 200)
        self.end_headers()
        if q.get("parameter") in self.down:
            return
        page, limit = int(q["page"]), min(2, int(q["limit"]))
        if self.path.startswith("/places"):
            found = [{"id": i, "coordinates": {"longitude": 120 + i, "latitude": i}, "country": {"code": "PH" if i % 2 else None}} for i in range(8)] + [{"id": 99, "coordinates": None}]
        else:
            found = [{"datetime": f"2024-01-01T{h:02d}:00:00Z", "value": h} for h in self.hours[q["parameter"]]]
            if q.get("sort_order") == "desc":
                found.reverse()
            # As services do, it gives the first hour again.
            found = [r for r in found if q.get("datetime_from", "") <= r["datetime"] <= q.get("datetime_to", "9")]
        self.wfile.write(json.dumps({"results": found[(page - 1) * limit : page * limit]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture()
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.calls.clear()
    Service.down.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def places(spark, url, **options):
    rest.register(spark)
    return spark.read.format("paged_json").options(url=f"{url}/places", located="true", wait="0.01", attempts="2", **options).load()


def test_filters_reach_the_service(spark, url, capsys):
    ident = F.get_json_object("json", "$.id").cast("int")
    near = places(spark, url).where("longitude between 121 and 125 and latitude between 2 and 9 and country = 'PH'").where(ident < 5).select(ident.alias("id"))
    near.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "GreaterThanOrEqual" in plan
    assert [r.id for r in near.collect()] == [3]
    assert {(q.get("bbox"), q.get("country")) for q in Service.calls} == {("121.0,2.0,125.0,9.0", None)}
    Service.calls.clear()
    assert sorted(r.id for r in places(spark, url).where("country = 'PH' and longitude > 121").select(ident.alias("id")).collect()) == [3, 5, 7]
    assert {(q.get("bbox"), q.get("country")) for q in Service.calls} == {(None, "PH")}
    Service.calls.clear()
    assert places(spark, url).where("longitude between 121 and 125 or country = 'PH'").count() == 6
    assert all("bbox" not in q for q in Service.calls)
    assert places(spark, url).count() == 9


def test_a_failure_under_a_filter_is_no_silent_end(spark, url):
    Service.down.add("x")
    failing = json.dumps([{"parameter": "x"}, {"parameter": "y"}])
    with pytest.raises(Exception, match="failed 2 times"):
        places(spark, url, requests=failing).where("country = 'PH'").count()
    assert places(spark, url, requests=failing, skip_failed="true").where("country = 'PH'").count() == 4
    assert places(spark, url, requests=failing, skip_failed="true").where("error is not null").count() == 1


REQUESTS = [{"location": 1, "parameter": p} for p in ("pm25", "pm10", "co")]


class Loader:
    """Runs the stream until it has what is there; rows of batches that complete are loaded."""

    def __init__(self, spark, url, folder):
        rest.register(spark)
        self.spark, self.url, self.folder, self.loaded = spark, url, folder, []

    def run(self, kill=False, **options):
        stream = self.spark.readStream.format("paged_json").options(url=f"{self.url}/hours", requests=json.dumps(REQUESTS), wait="0.01", attempts="2", chunk_days="0.2", start="2023-12-31T12:00:00Z", **options).load()

        def each(batch, number):
            rows = [(json.loads(r.request)["parameter"], json.loads(r.json)["value"]) for r in batch.collect()]
            if kill:
                raise RuntimeError("killed")
            self.loaded += rows

        query = stream.writeStream.option("checkpointLocation", str(self.folder)).trigger(availableNow=True).foreachBatch(each).start()
        query.awaitTermination()

    def marks(self):
        last = {}
        for p, v in self.loaded:
            last[p] = max(last.get(p, 0), v)
        return json.dumps({json.dumps({"location": 1, "parameter": p}): f"2024-01-01T{v:02d}:00:00Z" for p, v in last.items()})


def test_stream_loads_each_result_once(spark, url, tmp_path):
    Service.hours = {"pm25": range(1, 8), "pm10": range(1, 4), "co": []}
    loader = Loader(spark, url, tmp_path / "checkpoint")
    with pytest.raises(Exception, match="killed"):
        loader.run(kill=True)
    Service.hours = {"pm25": range(1, 10), "pm10": range(1, 4), "co": []}
    loader.run()  # the killed batch again
    assert sorted(loader.loaded) == [("pm10", h) for h in range(1, 4)] + [("pm25", h) for h in range(1, 8)]
    loader.run()  # what has come since
    want = [("pm10", h) for h in range(1, 4)] + [("pm25", h) for h in range(1, 10)]
    assert sorted(loader.loaded) == want

    # One parameter fails: the others go on, and it is caught up later from where it was.
    Service.hours = {"pm25": range(1, 13), "pm10": range(1, 8), "co": range(3, 5)}
    Service.down.add("pm25")
    loader.run(marks=loader.marks())
    assert sorted(loader.loaded) == sorted(want + [("pm10", h) for h in range(4, 8)] + [("co", 3), ("co", 4)])
    Service.down.clear()
    Service.hours["pm25"] = range(1, 15)
    loader.run(marks=loader.marks())
    assert sorted(loader.loaded) == sorted([("pm25", h) for h in range(1, 15)] + [("pm10", h) for h in range(1, 8)] + [("co", 3), ("co", 4)])

    # A restart without marks knows from the last batch where a failing parameter stands.
    Service.down.add("pm25")
    Service.hours["co"] = range(3, 7)
    loader.run()
    Service.down.clear()
    Service.hours["pm25"] = range(1, 17)
    loader.run()
    assert sorted(loader.loaded) == sorted([("pm25", h) for h in range(1, 17)] + [("pm10", h) for h in range(1, 8)] + [("co", h) for h in range(3, 7)])


def test_a_first_start_needs_every_mark(spark, url, tmp_path):
    Service.hours = {"pm25": range(1, 3), "pm10": range(1, 3), "co": range(1, 3)}
    Service.down.add("co")
    loader = Loader(spark, url, tmp_path / "checkpoint")
    with pytest.raises(Exception, match="failed 2 times"):
        loader.run()
    loader.run(marks=json.dumps({json.dumps(REQUESTS[2]): "2023-12-31T00:00:00Z"}))
    assert {p for p, _ in loader.loaded} == {"pm25", "pm10"}
