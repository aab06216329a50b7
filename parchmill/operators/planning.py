"""From a model's plan of a question to filters: parsing on the driver, names resolved by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parchmill.operators.documents import json_object, match_names
from parchmill.operators.ranking import QueryPlan, SearchFilters


def texts(value) -> tuple[str, ...]:
    """Texts of a list (or one text) that are not blank, trimmed; numbers as text."""
    items = value if isinstance(value, list) else [value]
    return tuple(t for t in (str(x).strip() for x in items if isinstance(x, str | int | float)) if t)


def parse_plan(said: str | None, question: str) -> tuple[QueryPlan, dict]:
    """(plan without filters, candidate names); what cannot be read becomes a plan of the question itself."""
    got = json_object(said)
    if got is None:
        return QueryPlan((question,)), {}
    wanted = got.get("filter_candidates")
    plan = QueryPlan(texts(got.get("semantic_queries")) or (question,), texts(got.get("keyword_terms")), texts(got.get("sub_questions")))
    return plan, wanted if isinstance(wanted, dict) else {}


def resolve_filters(candidates: dict, taxonomy: DataFrame, chosen: SearchFilters = SearchFilters()) -> SearchFilters:
    """Ids of candidate names; names that match nothing are left out, dates pass as they are, the user's own choice wins.

    A plan names a handful of candidates, so the matches are read by the driver.
    """
    rows = [(kind, name) for kind, key in (("correspondent", "correspondent"), ("document_type", "document_type"), ("tag", "tags")) for name in texts(candidates.get(key))]
    found = {}
    if rows:
        wanted = taxonomy.sparkSession.createDataFrame(rows, "kind string, name string")
        found = {(r["kind"], r["name"]): r["id"] for r in match_names(wanted, taxonomy).collect()}
    first = lambda kind: next((found[k, n] for k, n in rows if k == kind and (k, n) in found), None)
    date = lambda key: next(iter(texts(candidates.get(key))), None)
    return SearchFilters(
        date_from=chosen.date_from or date("date_from"),
        date_to=chosen.date_to or date("date_to"),
        correspondent_id=chosen.correspondent_id if chosen.correspondent_id is not None else first("correspondent"),
        document_type_id=chosen.document_type_id if chosen.document_type_id is not None else first("document_type"),
        tag_ids=chosen.tag_ids or tuple(dict.fromkeys(found[k, n] for k, n in rows if k == "tag" and (k, n) in found)),
    )
