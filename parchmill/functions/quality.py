"""Gates on content and classification results."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill.functions.text import GENERIC_TYPES, _c, normalise_simple, strip

#: Phrases of a model that refuses; compared without case.
REFUSALS = [
    "i can't assist",
    "i cannot assist",
    "i can't help with transcrib",
    "i cannot help with transcrib",
    "i'm sorry, i can't assist with that.",
    "chatgpt refused to transcribe",
]
REDACTED = r"(?i)\[[^\]]*redacted[^\]]*\]"
OCR_ERROR = "[OCR ERROR]"


def contains_any(x: Column | str, phrases: list[str]) -> Column:
    low, out = F.lower(_c(x)), F.lit(False)
    for p in phrases:
        out = out | low.contains(p.lower())
    return out


def is_refusal(x: Column | str, phrases: list[str] = REFUSALS) -> Column:
    """A redaction mark or a refusal phrase."""
    return _c(x).rlike(REDACTED) | contains_any(x, phrases)


def refuses(said: str) -> bool:
    """``is_refusal`` of one answer, for the tasks that call a model."""
    return bool(re.search(REDACTED, said)) or any(p in said.lower() for p in REFUSALS)


def has_ocr_errors(x: Column | str) -> Column:
    return _c(x).contains(OCR_ERROR) | is_refusal(x)


def is_generic_type(x: Column | str) -> Column:
    """Empty or too vague to be of use."""
    n = normalise_simple(F.coalesce(_c(x), F.lit("")))
    return (n == "") | n.isin(GENERIC_TYPES)


def is_empty_classification(scalars: list[Column], tags: Column) -> Column:
    """All scalars blank and no tag that is not blank."""
    blank = lambda c: F.length(strip(F.coalesce(c, F.lit("")))) == 0
    out = ~F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~blank(t))
    for s in scalars:
        out = out & blank(s)
    return out


def is_indexable(content: Column | str, tags: Column | str, error_tag: int | None) -> Column:
    """Content that is not blank, without the error tag."""
    ok = F.length(strip(F.coalesce(_c(content), F.lit("")))) > 0
    return ok if error_tag is None else ok & ~F.coalesce(F.array_contains(_c(tags), error_tag), F.lit(False))
