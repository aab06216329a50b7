"""Tag rules as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill.functions.text import _c, _once, iso_date, normalise_company, normalise_simple

#: Tags that never appear.
BLACKLIST = ["ai", "error", "indexed", "new"]

#: Unicode white space, as ``strip`` takes it.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def dedupe(tags: Column | str) -> Column:
    """Trimmed, blanks dropped, the first of each spelling without case; by sorting, so that long lists stay cheap."""
    clean = F.filter(F.transform(F.array_distinct(_c(tags)), lambda t: F.btrim(t, F.lit(SPACE))), lambda t: F.length(t) > 0)

    def first(s: Column) -> Column:
        kept = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["low"] != x["low"]))
        placed = F.array_sort(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["tag"].alias("tag"))))
        return F.transform(placed, lambda x: x["tag"])

    return _once(F.array_sort(F.transform(clean, lambda t, i: F.struct(F.lower(t).alias("low"), i.alias("at"), t.alias("tag")))), first)


def _squeezed(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def _names(correspondent: Column, document_type: Column, person: Column) -> Column:
    """What a tag may say again: the three names, normalised, and squeezed to letters and digits."""
    names = [normalise_company(F.coalesce(correspondent, F.lit(""))), normalise_simple(F.coalesce(document_type, F.lit(""))), normalise_simple(F.coalesce(person, F.lit("")))]
    inner = _once(F.array(*names), lambda n: F.struct(n[0].alias("company"), n[1].alias("kind"), n[2].alias("who"), _squeezed(n[0]).alias("start"), F.transform(F.filter(F.slice(n, 2, 2), lambda x: x != ""), _squeezed).alias("whole")))
    return inner


def _redundant(t: Column, n: Column) -> Column:
    """Whether a tag says one of the names again; only tags whose letters and digits fit one are normalised and compared."""
    simple = normalise_simple(t)
    same = ((n["company"] != "") & ((simple == n["company"]) | (normalise_company(t) == n["company"]))) | ((n["kind"] != "") & (simple == n["kind"])) | ((n["who"] != "") & (simple == n["who"]))
    fits = _once(_squeezed(t), lambda s: ((n["company"] != "") & s.startswith(n["start"])) | F.array_contains(n["whole"], s))
    return fits & same


def _blacklisted(t: Column) -> Column:
    """Of a stripped tag; the words of the list hold no white space."""
    return F.lower(t).isin(BLACKLIST)


def drop_redundant(tags: Column | str, correspondent: Column, document_type: Column, person: Column) -> Column:
    """Without tags that say the correspondent, the document type or the person again."""
    return _once(_names(correspondent, document_type, person), lambda n: F.filter(dedupe(tags), lambda t: ~_redundant(t, n)))


def drop_blacklisted(tags: Column | str) -> Column:
    return F.filter(dedupe(tags), lambda t: ~_blacklisted(t))


def model_tags(text: Column | str) -> Column:
    """Names after 'Transcribed by model:', of every footer."""
    lines = F.regexp_extract_all(_c(text), F.lit(r"(?i)transcribed by model:\s*(.+)"), F.lit(1))
    return dedupe(F.flatten(F.transform(lines, lambda x: F.split(x, ","))))


def date_for_tags(date: Column | str, existing: Column | str, today: str) -> Column:
    """The first that is a date: the result's, the document's own, today."""
    return F.coalesce(F.date_format(iso_date(date), "yyyy-MM-dd"), F.date_format(iso_date(existing), "yyyy-MM-dd"), F.lit(today))


def _required(text: Column | str, date: Column | str, country: str, today: str) -> Column:
    year = F.coalesce(F.date_format(iso_date(date), "yyyy"), F.lit(today[:4]))
    return dedupe(F.concat(model_tags(text), F.array(year), F.array(F.lit(country)) if country else F.array().cast("array<string>")))


def enrich(tags: Column | str, text: Column | str, date: Column | str, country: str, limit: int, today: str) -> Column:
    """Models, year and country first, then at most ``limit`` of the others; lower case."""
    return _with_required(lowered(tags), text, date, country, limit, today)


def _with_required(low: Column, text: Column | str, date: Column | str, country: str, limit: int, today: str) -> Column:
    def every(required: Column) -> Column:
        return F.concat(required, F.slice(F.array_except(low, required), 1, max(0, limit)) if limit > 0 else F.array().cast("array<string>"))

    return _once(F.transform(_required(text, date, country, today), F.lower), every)


def lowered(tags: Column | str) -> Column:
    """The tags of ``dedupe`` in lower case, by hashing: nothing is sorted."""
    return F.array_distinct(F.filter(F.transform(_c(tags), lambda t: F.lower(F.btrim(t, F.lit(SPACE)))), lambda t: F.length(t) > 0))


def ruled(tags: Column | str, correspondent: Column, document_type: Column, person: Column, text: Column | str, date: Column | str, country: str, limit: int, today: str) -> Column:
    """``drop_blacklisted``, ``drop_redundant`` and ``enrich`` in turn.

    No rule looks at case and the result has none, so a list is lowered first and then passed once.
    """
    kept = _once(_names(correspondent, document_type, person), lambda n: F.filter(lowered(tags), lambda t: ~_blacklisted(t) & ~_redundant(t, n)))
    return _with_required(kept, text, date, country, limit, today)


def parse_ids(x: Column | str) -> Column:
    """Ids of a JSON list, each once; what is no list of numbers is an empty one."""
    return F.coalesce(F.array_distinct(F.filter(F.from_json(_c(x), "array<bigint>"), lambda i: i.isNotNull())), F.array().cast("array<bigint>"))


def swap(tags: Column | str, remove: list[int], add: list[int]) -> Column:
    """Tag ids with pipeline tags taken away and others added, ascending."""
    longs = lambda x: F.array(*[F.lit(i).cast("bigint") for i in x]) if x else F.array().cast("array<bigint>")
    return F.array_sort(F.array_union(F.array_except(F.coalesce(_c(tags), F.array().cast("array<bigint>")), longs(remove)), longs(add)))


def upsert_field(fields: Column | str, field: int, value: Column) -> Column:
    """array<struct<field, value>> with the field replaced in place, or appended."""
    fields = F.coalesce(_c(fields), F.array().cast("array<struct<field:bigint,value:string>>"))
    new = F.struct(F.lit(field).cast("bigint").alias("field"), value.alias("value"))
    swapped = F.transform(fields, lambda f: F.when(f["field"] == field, new).otherwise(f))
    return F.when(F.exists(fields, lambda f: f["field"] == field), swapped).otherwise(F.concat(fields, F.array(new)))
