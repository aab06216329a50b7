"""A sink that writes documents and named items back to a JSON service, as a Python data source."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Names of the service's fields where they differ from the columns'.
FIELDS = {"correspondent_id": "correspondent", "document_type_id": "document_type", "document_date": "created"}


@dataclass
class Written(WriterCommitMessage):
    """How many requests a task made; rows that needed none are not counted."""

    requests: int


def payload(row: Row) -> dict:
    """What a row sets: the columns that ``changed`` names (all, where there is none), null clears a field.

    Null ``custom_fields`` are left untouched: the service refuses null there, and an empty list clears them.
    """
    held = row.asDict(recursive=True)
    named = held.get("changed")
    names = [n for n in held if n not in ("id", "notes", "changed") and (named is None or n in named)]
    return {FIELDS.get(n, n): held[n] for n in names if not (n == "custom_fields" and held[n] is None)}


class WriteBack(DataSourceWriter):
    """Options: url, headers (a JSON object), kind.

    kind "documents" (the default): each row of (id, fields..., optional ``changed`` and ``notes``) is one PATCH of url/id/; ``notes`` replaces
    the notes there. kind "items": each row of (name, fields...) is made unless an item of that name is there.

    Every request carries an Idempotency-Key made of its content. A task that runs twice (a retry, or a second attempt
    beside the first) sets the same values again, replaces the same notes, and finds the items that it made, so the end
    is the same. A request that fails fails its task.
    """

    def __init__(self, options):
        self.url, self.headers, self.kind = options["url"].rstrip("/"), json.loads(options.get("headers", "{}")), options.get("kind", "documents")

    def ask(self, method: str, path: str, body: dict | None = None):
        data = None if body is None else json.dumps(body, sort_keys=True, default=str).encode()
        key = hashlib.sha256(b"\0".join([method.encode(), path.encode(), data or b""])).hexdigest()
        ask = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json", "Idempotency-Key": key, **self.headers}, method=method)
        with urllib.request.urlopen(ask, timeout=60) as f:
            said = f.read()
        return json.loads(said) if said else None

    def document(self, row: Row) -> int:
        made = 0
        if "notes" in row and (row.__fields__.count("changed") == 0 or row["changed"] is None or "notes" in row["changed"]):
            for note in self.ask("GET", f"/{row['id']}/notes/"):
                self.ask("DELETE", f"/{row['id']}/notes/?id={note['id']}")
            if row["notes"]:
                self.ask("POST", f"/{row['id']}/notes/", {"note": row["notes"]})
            made = 1
        if sets := payload(row):
            self.ask("PATCH", f"/{row['id']}/", sets)
            made += 1
        return made

    def item(self, row: Row) -> int:
        if self.ask("GET", f"/?name__iexact={quote(row['name'])}")["results"]:
            return 0
        try:
            self.ask("POST", "/", payload(row))
        except urllib.error.HTTPError as e:
            if e.code != 400 or not self.ask("GET", f"/?name__iexact={quote(row['name'])}")["results"]:  # another attempt made it meanwhile
                raise
            return 0
        return 1

    def write(self, iterator: Iterator[Row]) -> Written:
        one = self.item if self.kind == "items" else self.document
        return Written(sum(one(row) for row in iterator))

    def commit(self, messages: list[Written | None]) -> None:
        if any(m is None for m in messages):
            raise RuntimeError("a task ended without a message")

    def abort(self, messages: list[Written | None]) -> None:
        """What was sent stays; writing the same rows again leads to the same end."""


class WriteBackSink(DataSource):
    """spark.dataSource.register(WriteBackSink); df.write.format("writeback").mode("append").options(url=...).save()"""

    @classmethod
    def name(cls) -> str:
        return "writeback"

    def writer(self, schema, overwrite: bool) -> WriteBack:
        return WriteBack(self.options)
