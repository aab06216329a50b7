"""Plans and filters from a model's answer; the paged source."""

import http.server
import json
import threading

import pytest

from parchmill.operators.documents import first_answer, json_object, parse_classification
from parchmill.operators.planning import parse_plan, resolve_filters
from parchmill.operators.ranking import QueryPlan, SearchFilters


def test_parsing():
    plan, wanted = parse_plan('Here: {"semantic_queries": ["a", " ", 3], "keyword_terms": "one", "sub_questions": null, "filter_candidates": {"tags": ["x"]}} end', "q")
    assert plan == QueryPlan(("a", "3"), ("one",), ()) and wanted == {"tags": ["x"]}
    assert parse_plan("no json", "q") == (QueryPlan(("q",)), {}) and parse_plan("[1]", "q")[0] == QueryPlan(("q",))
    assert json_object('{"a": 1}') == {"a": 1} and json_object(None) is None
    assert parse_classification('{"tags": "one", "title": null}')["tags"] == ["one"]


def test_fallback_chain():
    def broken(_):
        raise ValueError

    assert first_answer([broken, lambda _: "", lambda p: p + "!"])("x") == "x!" and first_answer([broken])("x") is None


def test_filters(spark):
    taxonomy = spark.createDataFrame([("correspondent", 1, "British Gas"), ("correspondent", 2, "Привет"), ("document_type", 5, "Invoice"), ("tag", 7, "2024"), ("tag", 8, "bills")], "kind string, id long, name string")
    got = resolve_filters({"correspondent": "british-gas", "document_type": "Letter", "tags": ["Bills", "2024", "none"], "date_to": "2024-01-15"}, taxonomy)
    assert got == SearchFilters(date_to="2024-01-15", correspondent_id=1, tag_ids=(8, 7))
    assert resolve_filters({"correspondent": "Мир"}, taxonomy).correspondent_id is None  # empty keys match nothing
    assert resolve_filters({"correspondent": "British Gas"}, taxonomy, SearchFilters(correspondent_id=9)).correspondent_id == 9


class Pages(http.server.BaseHTTPRequestHandler):
    """Seven pages of three rows, one row on the last; the count lags behind by two pages."""

    counted = True

    def do_GET(self):
        page = int(self.path.rsplit("=", 1)[1])
        held = [{"id": page * 10 + i, "title": f"t{i}"} for i in range(3 if page < 7 else 1)] if page < 8 else []
        body = {"results": held, "next": "more" if page < 7 else None} | ({"count": 13} if self.counted else {})
        self.send_response(404 if page > 7 else 200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.mark.parametrize("counted", [True, False])
def test_paged_source_reads_to_the_end(spark, counted):
    from parchmill.sources.paged import paged

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), type("Own", (Pages,), {"counted": counted}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = paged(spark, "id long, title string, missing string", url=f"http://127.0.0.1:{server.server_port}/x?page={{page}}", per_partition="2")
    assert sorted(r.id for r in rows.collect()) == [p * 10 + i for p in range(1, 8) for i in range(3 if p < 7 else 1)]
    assert rows.rdd.getNumPartitions() == (3 if counted else 2)
    server.shutdown()
