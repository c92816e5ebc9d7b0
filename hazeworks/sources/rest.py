"""A Spark data source for paged JSON APIs: one partition per unit of work, raw result objects as rows.

    register(spark)
    spark.read.format("paged_json").option("url", "https://...").option("requests", '[{"countries_id": 1}, ...]').load()

``requests`` are the parameter sets to scan (regions, sensors, date chunks of ``hazeworks.operators.incremental.chunks``). They are
dealt to at most ``readers`` partitions, and each walks its requests' pages until an empty one. ``spacing`` is a key's time between
calls: every reader waits that long times the number of readers, so all of them together keep the budget. ``max_pages`` (none unless
given) ends a request early, with a row that says so.

Rows are ``request`` (JSON) and ``json`` (one result), or ``error`` in its place. Busy or failing servers are tried again with doubling
waits; other refusals are final. Rejected parameters (400, 422) give an error row, rejected credentials (401, 403) fail the query. With
``skip_failed`` a request that fails for good gives an error row too, after the rows of its earlier pages.

With ``located`` rows have ``longitude``, ``latitude`` and ``country`` as well, and filters on these reach the service: four bounds as its
``bbox``, a country as its ``country`` (not beside a bbox, which would lose places without a country). The reader holds every result against the
filters it took, whatever the service makes of them; other filters are left to Spark. A request that fails would give no row under such a filter, so it fails the
query unless ``skip_failed`` says otherwise.

    spark.readStream.format("paged_json").options(url=..., requests=..., time="datetime", start="2024-01-01T00:00:00Z").load()

is the same source as a stream: each request, one for each location and parameter, has an offset of its own, the time of its newest result, and a
batch reads each request's results after its start up to its end. Batches are replayed from the checkpoint exactly. A request whose newest result can't be learned
stays where it is while the others go on. Where that is follows from the batch before, at restarts too; a first start takes it from ``marks`` (JSON: request -> time,
as ``watermarks`` of a loaded table gives them) and is refused without. ``chunk_days`` splits long ranges into partitions.
"""

from __future__ import annotations

import itertools
import json
import operator
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


def spacing(per_minute: int, per_hour: int) -> float:
    """Seconds between calls that keep both budgets."""
    return max(60 / per_minute, 3600 / per_hour)


class AccessDenied(Exception):
    """The service refuses the credentials."""


class Rejected(Exception):
    """The service refuses the parameters."""


def verify(url: str, key: str, header: str = "X-API-Key", **parameters: str) -> None:
    """One small call before a load: raises if the service refuses the key."""
    options = {"url": url, "api_key": key, "key_header": header, "attempts": "1"}
    try:
        PagedReader(options)._page({"limit": 1, "page": 1} | parameters)
    except Rejected:
        pass  # The key was accepted, only the parameters were not.


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.requests = options["url"], json.loads(options.get("requests", "[{}]"))
        self.results, self.page, self.limit = options.get("results", "results"), options.get("page_parameter", "page"), int(options.get("limit", 1000))
        self.max_pages, self.attempts = int(options.get("max_pages", 0)), int(options.get("attempts", 4))
        self.readers = max(1, min(int(options.get("readers", 4)), len(self.requests)))
        self.spacing, self.wait = float(options.get("spacing", 0)) * self.readers, float(options.get("wait", 1))
        self.key, self.header = options.get("api_key"), options.get("key_header", "X-API-Key")
        self.skip_failed = options.get("skip_failed", "false").lower() == "true"
        self.located = options.get("located", "false").lower() == "true"
        self.taken: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if self.located and (type(f) in COMPARED and name in BOX or isinstance(f, EqualTo) and name == "country") and f.value is not None:
                self.taken.append((name, COMPARED.get(type(f), "eq"), f.value))
            else:
                yield f

    def parameters(self) -> dict:
        """What the taken filters are for the service."""
        bound = lambda name, ops, best: best((v for n, op, v in self.taken if n == name and op in ops), default=None)
        box = [bound(n, ops, best) for ops, best in ((("ge", "gt"), max), (("le", "lt"), min)) for n in BOX]
        if None not in box:
            return {"bbox": ",".join(map(str, box))}
        countries = [v for n, _, v in self.taken if n == "country"]
        return {"country": countries[0]} if countries else {}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.requests[i :: self.readers]) for i in range(self.readers)]

    def _page(self, parameters: dict) -> list:
        request = urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(parameters)}", headers={self.header: self.key} if self.key else {})
        for attempt in range(self.attempts):
            time.sleep(self.spacing)
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return json.load(answer).get(self.results) or []
            except urllib.error.HTTPError as e:
                if e.code in (400, 422):
                    raise Rejected(f"rejected: {e.code}") from e
                if e.code in (401, 403):
                    raise AccessDenied(f"{self.url}: {e.code}") from e
                if e.code not in (408, 429) and e.code < 500:
                    raise ConnectionError(f"{self.url}: {e.code}") from e
                failed = e
            except (urllib.error.URLError, TimeoutError) as e:
                failed = e
            if attempt + 1 < self.attempts:
                time.sleep(self.wait * 2**attempt)
        raise ConnectionError(f"{self.url} failed {self.attempts} times") from failed

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for request in partition.value:
            name = json.dumps(request, sort_keys=True)
            try:
                yield from self._pages(name, request)
            except (Rejected, ConnectionError) as e:
                if not self.skip_failed and (self.taken or isinstance(e, ConnectionError)):
                    raise
                if not self.taken:
                    yield self._row(name, None, str(e))

    def _pages(self, name: str, request: dict) -> Iterator[tuple]:
        for page in itertools.count(1):
            if self.max_pages and page > self.max_pages:
                if not self.taken:
                    yield self._row(name, None, f"ended after {self.max_pages} pages")
                return
            found = self._page(request | self.parameters() | {"limit": self.limit, self.page: page})
            yield from (self._row(name, r, None) for r in found if self._wanted(r))
            if not found:
                return

    def _row(self, name: str, result: dict | None, error: str | None) -> tuple:
        row = name, None if result is None else json.dumps(result), error
        return (*row, *(_place(result or {}).values())) if self.located else row

    def _wanted(self, result: dict) -> bool:
        place = _place(result) if self.taken else {}
        return all(place[n] is not None and getattr(operator, op)(place[n], v) for n, op, v in self.taken)


#: Filters that a box takes, by what they compare; and its columns, in its order.
COMPARED = {GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
BOX = ["longitude", "latitude"]


def _place(result: dict) -> dict:
    """Longitude, latitude and country of a location."""
    at, country = result.get("coordinates") or {}, result.get("country")
    number = lambda v: None if v is None else float(v)
    return {"longitude": number(at.get("longitude")), "latitude": number(at.get("latitude")), "country": country.get("code") if isinstance(country, dict) else country}


def _instant(text: str) -> datetime:
    """An ISO time; one without a zone is UTC."""
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


class Stretch(InputPartition):
    """A request's results after ``start`` up to ``end``."""

    def __init__(self, request: dict, start: str, end: str):
        super().__init__(None)
        self.request, self.start, self.end = request, start, end


class PagedStream(DataSourceStreamReader):
    """Offsets are a mapping: request (JSON) -> time of the newest result that is loaded."""

    def __init__(self, options: dict):
        self.pages = PagedReader(options)
        self.requests = {json.dumps(r, sort_keys=True): r for r in self.pages.requests}
        self.time, self.start = options.get("time", "datetime"), options.get("start", "1970-01-01T00:00:00Z")
        self.after, self.until = options.get("from_parameter", "datetime_from"), options.get("to_parameter", "datetime_to")
        self.newest = json.loads(options.get("newest", '{"order_by": "datetime", "sort_order": "desc"}'))
        self.chunk = timedelta(days=float(options.get("chunk_days", 365)))
        self.given = {json.dumps(json.loads(k), sort_keys=True): v for k, v in json.loads(options.get("marks", "{}")).items()}
        self.marks = dict(self.given)

    def _time(self, result: dict) -> str:
        for step in self.time.split("."):
            result = result[step]
        return result

    def initialOffset(self) -> dict:  # noqa: N802
        # Asked for at restarts too, so it tells nothing about where a request stands.
        return {name: self.given.get(name, self.start) for name in self.requests}

    def latestOffset(self) -> dict:  # noqa: N802
        found = {}
        for name, request in self.requests.items():
            try:
                first = self.pages._page(request | self.newest | {"limit": 1, self.pages.page: 1})
                mark = self._time(first[0]) if first else None
            except (Rejected, ConnectionError):
                if name not in self.marks:
                    raise
                mark = None
            known = self.marks.get(name)
            found[name] = known or self.start if mark is None or known and _instant(mark) <= _instant(known) else mark
        self.marks |= found
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.marks |= end
        out = []
        for name, to in end.items():
            at = start.get(name, self.start)
            while name in self.requests and _instant(at) < _instant(to):
                upto = min(_instant(at) + self.chunk, _instant(to))
                upto_text = to if upto == _instant(to) else upto.isoformat()
                out.append(Stretch(self.requests[name], at, upto_text))
                at = upto_text
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        name, low, high = json.dumps(partition.request, sort_keys=True), _instant(partition.start), _instant(partition.end)
        bounded = partition.request | {self.after: partition.start, self.until: partition.end}
        for row in self.pages._pages(name, bounded):
            if row[1] is None or low < _instant(self._time(json.loads(row[1]))) <= high:
                yield row


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        located = str(self.options.get("located", "false")).lower() == "true"
        return "request string, json string, error string" + ", longitude double, latitude double, country string" * located

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PagedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)
