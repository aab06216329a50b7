"""A paged JSON source as a Python data source: a batch reader that passes filters on, and a stream in order of change."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, In, InputPartition, SimpleDataSourceStreamReader

#: Documents of one micro-batch at most.
BATCH_DOCUMENTS = 100


def _instant(text: str | None) -> datetime:
    """The instant of an ISO text; one that cannot be read lies before all others."""
    try:
        t = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return datetime.min.replace(tzinfo=timezone.utc)
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


class Listing:
    """Pages {"results": [rows], "next": text or null, "count": all rows} of an address with {page}."""

    def __init__(self, schema, options):
        self.fields = [(f.name, f.dataType.typeName()) for f in schema.fields]
        self.url, self.headers, self.params = options["url"], json.loads(options.get("headers", "{}")), {}

    def page(self, number: int, **params) -> dict:
        url, params = self.url.replace("{page}", str(number)), self.params | params
        if params:
            url += ("&" if "?" in url else "?") + urlencode(params)
        with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=60) as f:
            return json.load(f)

    def row(self, held: dict) -> tuple:
        return tuple(_instant(held[n]) if kind == "timestamp" and held.get(n) is not None else held.get(n) for n, kind in self.fields)


class PageRange(InputPartition):
    """Pages from ``first`` up to ``last``; without a last one as long as a page names a next one."""

    def __init__(self, first: int, last: int | None):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    """Options: url (with {page}), per_partition, headers (a JSON object).

    The first page tells how many pages there are (count by its rows); the last partition reads on for as long as there
    is a next page, so pages that are added meanwhile, or a listing without a count, are read whole. A page that fails
    fails its task: a partial listing never looks like a whole one.

    Where Spark hands filters on (spark.sql.python.filterPushdown.enabled), ``modified`` after an instant becomes the
    parameter modified__gt and a list of ids id__in; Spark still checks both. ``modified`` has to be a timestamp for that.
    """

    def __init__(self, schema, options):
        self.listing, self.per_partition = Listing(schema, options), int(options.get("per_partition", "8"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThan) and f.attribute == ("modified",) and isinstance(f.value, datetime):
                value = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                self.listing.params["modified__gt"] = value.astimezone(timezone.utc).isoformat()
            elif isinstance(f, In | EqualTo) and f.attribute == ("id",):  # a list of one is an equality
                self.listing.params["id__in"] = ",".join(str(x) for x in sorted(f.value if isinstance(f, In) else [f.value]))
            yield f

    def partitions(self) -> list[PageRange]:
        first = self.listing.page(1)
        rows, count = len(first["results"]), first.get("count")
        if not first.get("next"):
            return [Held(first["results"])]  # one page: asked for once
        pages = -(-int(count) // rows) if rows and count is not None else 1
        starts = range(2, max(pages, 2) + 1, self.per_partition)
        return [Held(first["results"])] + [PageRange(a, a + self.per_partition if a + self.per_partition <= pages else None) for a in starts]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if isinstance(partition, Held):
            yield from map(self.listing.row, partition.rows)
            return
        number = partition.first
        while partition.last is None or number < partition.last:
            body = self.listing.page(number)
            yield from map(self.listing.row, body["results"])
            if not body.get("next"):
                break
            number += 1


class Held(InputPartition):
    """The rows of the page that planning has read."""

    def __init__(self, rows: list[dict]):
        self.rows = rows


class ChangeReader(SimpleDataSourceStreamReader):
    """Documents in order of (modified, id), ``batch`` (100) of them at most for a micro-batch.

    An offset is the place of the last document read, so a restart goes on behind what was committed and reads an
    interrupted batch again. The listing is asked for what changed at or after the offset's instant, ordered by modified;
    documents that share an instant are told apart by id. Options: as for the batch reader, and ``batch``.
    """

    def __init__(self, schema, options):
        self.listing, self.batch = Listing(schema, options), int(options.get("batch", BATCH_DOCUMENTS))

    def initialOffset(self) -> dict:
        return {"modified": None, "id": -1}

    def _after(self, offset: dict) -> Iterator[tuple[tuple, dict]]:
        """(place, document) behind the offset, in order, page by page; a page is sorted within instants that it holds whole."""
        start, number = (_instant(offset["modified"]), offset["id"]), 1
        params = {"ordering": "modified,id"} | ({"modified__gte": offset["modified"]} if offset["modified"] else {})
        held: list[tuple[tuple, dict]] = []
        while True:
            body = self.listing.page(number, **params)
            held += [(place, r) for r in body["results"] if (place := (_instant(r.get("modified")), r["id"])) > start]
            held.sort(key=lambda x: x[0])
            ready = [x for x in held if not body.get("next") or x[0][0] < held[-1][0][0]]  # a listing ordered by modified alone may go on with the last instant
            yield from ready
            held = held[len(ready) :]
            if not body.get("next"):
                return
            number += 1

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], start
        for (_, number), document in self._after(start):
            if len(rows) == self.batch:
                break
            rows.append(self.listing.row(document))
            end = {"modified": document.get("modified"), "id": number}
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        stop = (_instant(end["modified"]), end["id"])
        for place, document in self._after(start):
            if place > stop:
                return
            yield self.listing.row(document)


class PagedSource(DataSource):
    """The format "paged" of spark.read and spark.readStream; see ``paged``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self):
        raise ValueError("give a schema")

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(schema, self.options)


def paged(spark: SparkSession, schema: str, stream: bool = False, **options: str) -> DataFrame:
    """The listing as a frame or as a stream; registers the source and lets the session hand filters on."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (spark.readStream if stream else spark.read).format("paged").schema(schema).options(**options).load()
