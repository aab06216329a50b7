"""A service over HTTP: filters handed on, listings as streams, write-back, retries as keyed state."""

import http.server
import json
import re
import threading
import time
import urllib.parse
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_store import reconciler

from parchmill.sources import writeback
from parchmill.sources.paged import ChangeReader, paged
from parchmill.streaming import failures
from parchmill.streaming.sync import stream_sync

LISTED = "id long, title string, content string, tag_ids array<long>, correspondent_id long, document_type_id long, created string, modified timestamp"


class Service(http.server.ThreadingHTTPServer):
    """Documents and items in memory; every request is kept."""

    def __init__(self, documents=(), page=10):
        super().__init__(("127.0.0.1", 0), Handler)
        self.documents, self.items, self.notes, self.asked, self.size, self.lock = {d["id"]: d for d in documents}, {}, {}, [], page, threading.Lock()
        self.url = f"http://127.0.0.1:{self.server_port}"
        threading.Thread(target=self.serve_forever, daemon=True).start()


class Handler(http.server.BaseHTTPRequestHandler):
    def answer(self, body, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(b"" if body is None else json.dumps(body).encode())

    def handle_one(self, method):
        s, at = self.server, urllib.parse.urlparse(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(at.query).items()}
        body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "null")
        with s.lock:
            s.asked.append((method, at.path, q, body, self.headers.get("Idempotency-Key")))
            if note := re.fullmatch(r"/docs/(\d+)/notes/", at.path):
                held = s.notes.setdefault(int(note[1]), [])
                if method == "GET":
                    return self.answer(held)
                if method == "DELETE":
                    held[:] = [n for n in held if n["id"] != int(q["id"])]
                    return self.answer(None, 204)
                held.append({"id": len(s.asked), "note": body["note"]})
                return self.answer(held[-1], 201)
            if method == "PATCH":
                if body.get("custom_fields", 0) is None:
                    return self.answer({}, 400)
                s.documents[int(at.path.split("/")[2])].update(body)
                return self.answer({})
            if at.path == "/items/":
                if method == "GET":
                    return self.answer({"results": [v for v in s.items.values() if v["name"].lower() == q["name__iexact"].lower()]})
                if any(v["name"].lower() == body["name"].lower() for v in s.items.values()):
                    return self.answer({}, 400)
                s.items[len(s.items) + 1] = body
                return self.answer(body, 201)
            instant = lambda t: datetime.fromisoformat(t)
            rows = sorted(s.documents.values(), key=lambda d: (instant(d["modified"]), -d["id"]))  # ordered by modified alone
            rows = [d for d in rows if ("modified__gt" not in q or instant(d["modified"]) > instant(q["modified__gt"])) and ("modified__gte" not in q or instant(d["modified"]) >= instant(q["modified__gte"])) and ("id__in" not in q or str(d["id"]) in q["id__in"].split(","))]
            n, k = int(q["page"]), s.size
            self.answer({"results": rows[(n - 1) * k : n * k], "next": "more" if n * k < len(rows) else None, "count": len(rows)})

    do_GET = do_PATCH = do_POST = do_DELETE = lambda self: self.handle_one(self.command)

    def log_message(self, *_):
        pass


def document(i, modified, content="some text"):
    return {"id": i, "title": f"t{i}", "content": content, "tag_ids": [], "correspondent_id": None, "document_type_id": None, "created": "2024-01-01", "modified": modified}


@pytest.fixture
def service():
    made = []

    def make(*args, **kw):
        made.append(Service(*args, **kw))
        return made[-1]

    yield make
    for s in made:
        s.shutdown()


def test_cycles_hand_filters_on_and_read_each_page_once(spark, tmp_path, service):
    s = service([document(i, f"2024-01-{i:02d}T00:00:00+00:00") for i in range(1, 26)])
    down = {"failing": True}
    store, r = reconciler(spark, tmp_path / "store")
    r.embed = lambda c: c.withColumns({"embedding": F.array().cast("array<float>"), "error": F.when(F.lit(down["failing"]) & (F.col("document_id") == 3), "down")})
    source = lambda: paged(spark, LISTED, url=f"{s.url}/docs/?page={{page}}", per_partition="1")
    report = r.run(source(), "t1")
    assert (report["indexed"], report["failed"]) == (24, 1) and sorted(q["page"] for _, _, q, *_ in s.asked) == ["1", "2", "3"]
    assert r.meta()["modified_watermark"] == "2024-01-24T23:59:50+00:00"
    s.asked.clear()
    s.documents[25] |= {"title": "renamed", "modified": "2024-02-01T01:00:00+02:00"}
    s.documents[26] = document(26, "2024-01-24T22:30:00-02:00")  # later than the mark, though not as text
    report = r.run(source(), "t2")
    assert (report["seen"], report["indexed"], report["metadata_only"], report["failed"]) == (3, 1, 1, 1)
    assert [(q.get("modified__gt"), q.get("id__in"), q["page"]) for _, _, q, *_ in s.asked] == [("2024-01-24T23:59:50+00:00", None, "1"), (None, "3", "1")]
    down["failing"] = False
    del s.documents[26]
    assert r.run(source(), "t3")["indexed"] == 1 and store.read("failures").isEmpty() and store.read("documents").count() == 26
    down["failing"] = True
    s.documents[3]["modified"], s.documents[3]["content"] = "2024-03-01T00:00:00+00:00", "other"
    r.run(source(), "t4")
    del s.documents[3]
    r.run(source(), "t5")
    assert store.read("failures").isEmpty()  # gone from the service


def test_listing_as_a_stream(spark, tmp_path, service):
    s = service([document(i, f"2024-01-01T00:{i // 40:02d}:00+00:00") for i in range(1, 251)], page=30)
    seen = []

    def run(batches: int):
        docs = paged(spark, LISTED, stream=True, url=f"{s.url}/docs/?page={{page}}")
        q = docs.writeStream.option("checkpointLocation", f"file://{tmp_path}/check").foreachBatch(lambda b, n: seen.append((n, [r.id for r in b.collect()]))).trigger(processingTime="0 seconds").start()
        stop = time.time() + 90
        while len(seen) < batches and time.time() < stop:
            time.sleep(0.2)
        q.processAllAvailable()
        q.stop()

    run(3)
    assert [len(ids) for _, ids in seen] == [100, 100, 50] and sorted(i for _, ids in seen for i in ids) == list(range(1, 251))
    s.documents[7] |= {"modified": "2024-01-02T00:00:00+00:00"}
    s.documents[251] = document(251, "2024-01-01T23:30:00-01:00")
    run(4)
    assert sorted(i for n, ids in seen for i in ids if n > 2) == [7, 251]  # a restart reads nothing twice
    from pyspark.sql.types import StructType

    reader = ChangeReader(StructType.fromDDL("id long, modified string"), {"url": f"{s.url}/docs/?page={{page}}", "batch": "100"})
    rows, end = reader.read(reader.initialOffset())
    held = list(rows)
    assert len(held) == 100 and list(reader.readBetweenOffsets(reader.initialOffset(), end)) == held  # an interrupted batch comes again
    more, last = reader.read({"modified": "2025-01-01T00:00:00Z", "id": 1})
    assert list(more) == [] and last == {"modified": "2025-01-01T00:00:00Z", "id": 1}


def test_write_back(spark, service):
    s = service([document(i, "2024-01-01T00:00:00+00:00") | {"custom_fields": [1], "created": "x"} for i in range(1, 6)])
    spark.dataSource.register(writeback.WriteBackSink)
    schema = "id long, title string, correspondent_id long, custom_fields array<long>, document_date string, notes string, changed array<string>"
    rows = [(1, "new", 5, None, None, "a note", None), (2, None, None, [], "2024-02-02", "", ["custom_fields", "document_date"]), (3, "x", 1, [2], "d", None, []), (4, "é", None, None, None, None, ["title", "custom_fields", "notes"])]
    s.notes[4] = [{"id": 900, "note": "old"}, {"id": 901, "note": "older"}]
    df = spark.createDataFrame(rows, schema)
    write = lambda: df.write.format("writeback").mode("append").options(url=f"{s.url}/docs").save()
    write()
    end = json.dumps(s.documents, sort_keys=True)
    assert (s.documents[1]["title"], s.documents[1]["correspondent"], s.documents[1]["custom_fields"], s.documents[1]["created"]) == ("new", 5, [1], None)
    assert (s.documents[2]["title"], s.documents[2]["custom_fields"], s.documents[2]["created"]) == ("t2", [], "2024-02-02")
    assert s.documents[3]["title"] == "t3" and s.documents[4]["title"] == "é" and s.notes[4] == []
    keys = {k for m, p, _, _, k in s.asked if m == "PATCH"}
    sink, held = writeback.WriteBack({"url": f"{s.url}/docs"}), [Row(**dict(zip(df.columns, r))) for r in rows]
    half = iter(held)
    with pytest.raises(RuntimeError):  # a task that dies on its way, and its next attempt
        sink.write(row if i < 2 else (_ for _ in ()).throw(RuntimeError("killed")) for i, row in enumerate(half))
    assert sink.write(iter(held)).requests == 5
    assert json.dumps(s.documents, sort_keys=True) == end and [n["note"] for n in s.notes[1]] == ["a note"] and {k for m, p, _, _, k in s.asked if m == "PATCH"} == keys
    items = spark.createDataFrame([("Ann", 0), ("bob", 1), ("ANN", 0)], "name string, matching_algorithm int").coalesce(1)
    for _ in range(2):
        items.write.format("writeback").mode("append").options(url=f"{s.url}/items", kind="items").save()
    assert sorted(v["name"] for v in s.items.values()) == ["Ann", "bob"]
    with pytest.raises(Exception):
        spark.createDataFrame([(99, "t")], "id long, title string").write.format("writeback").mode("append").options(url=f"{s.url}/nowhere/x").save()


def test_failed_documents_come_again_without_a_new_version(spark, tmp_path, service):
    s = service([document(1, "2024-01-01T00:00:00+00:00"), document(2, "2024-01-02T00:00:00+00:00", "always broken"), document(3, "2024-01-03T00:00:00+00:00", "broken twice"), document(4, "2024-01-04T00:00:00+00:00", "broken and gone")])
    store, r = reconciler(spark, tmp_path / "store")
    cycle = {"n": 0}

    def embed(c):
        cycle["n"] += 1
        bad = F.col("text").contains("broken") & (~F.col("text").contains("twice") | F.lit(cycle["n"] < 3))
        return c.withColumns({"embedding": F.array().cast("array<float>"), "error": F.when(bad, "down")})

    r.embed, r.results = embed, f"file://{tmp_path}/results"
    source = lambda: paged(spark, LISTED, url=f"{s.url}/docs/?page={{page}}")
    spark.createDataFrame([], failures.RESULTS).write.parquet(r.results)
    listing = paged(spark, LISTED, stream=True, url=f"{s.url}/docs/?page={{page}}")
    first = stream_sync(listing, r, f"file://{tmp_path}/c1", available_now=False, every="1 hour")
    lookup = lambda ids: source().filter(F.col("id").isin([x.id for x in ids.collect()]))
    retries = failures.stream_retries(spark.readStream.schema(failures.RESULTS).parquet(r.results), r, lookup, f"file://{tmp_path}/events", f"file://{tmp_path}/c2", seconds=1, every="1 second")
    stop, given_up = time.time() + 150, []
    try:
        while time.time() < stop and not given_up:
            time.sleep(1)
            assert retries.exception() is None and first.exception() is None
            if 4 in s.documents and cycle["n"] >= 2:
                del s.documents[4]
            try:
                given_up = spark.read.schema(failures.EVENTS).parquet(f"file://{tmp_path}/events").filter("event = 'given_up'").collect()
            except Exception:  # noqa: BLE001  no folder yet
                pass
    finally:
        retries.stop()
        first.stop()
    assert [(e.id, e.failures) for e in given_up] == [(2, 5)]
    assert {d.id for d in store.read("documents").collect()} == {1, 3} and store.read("failures").isEmpty()
