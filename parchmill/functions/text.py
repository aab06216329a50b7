"""Column functions on text: normalisers, snippets, page headers, footers, truncation, tokens."""

from __future__ import annotations

import string
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of company names; generic document types.
COMPANY_SUFFIXES = "ab as bv co company corp corporation gmbh inc incorporated limited llc ltd oy plc sa sarl spa".split()
GENERIC_TYPES = "document documents general misc miscellaneous n/a na none other unknown unspecified".split()

#: Fixed formats: the model footer and the page headers of transcriptions.
FOOTER = r"(?s)^(.*)(\n\nTranscribed by model:.*)$"
HEADER_LINE = r"--- Page (\d+)(?: \([^)]+\))? ---"
HEADER = f"(?md)^{HEADER_LINE}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without Unicode white space at both ends (trim() knows only the space)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def normalise_simple(x: Column | str) -> Column:
    """Lower case, white space collapsed."""
    return strip(F.regexp_replace(F.lower(_c(x)), r"(?U)\s+", " "))


def normalise_company(x: Column | str) -> Column:
    """Lower case, only a-z, 0-9 and single spaces, without trailing company suffixes."""
    words = normalise_simple(F.regexp_replace(F.lower(_c(x)), r"(?U)[^a-z0-9\s]", ""))
    return F.trim(F.regexp_replace(words, "(?:(?:^| )(?:" + "|".join(COMPANY_SUFFIXES) + "))+$", ""))


@cache
def _compatible():
    """NFKC and lower case as an Arrow function; made when first used, for it needs a session."""

    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(names), dtype=object)
        held = names.notna().to_numpy()  # most are ASCII and come as nulls
        out[held] = [unicodedata.normalize("NFKC", t).lower() for t in names[held]]
        return out

    return fold


def normalise_key(x: Column | str) -> Column:
    """Taxonomy key: compatibility form (NFKC), lower case, only a-z and 0-9.

    ASCII names have that form already. Others go through Python for it, in Arrow batches; Spark has no function for it.
    """
    plain = _c(x).rlike(r"\A\p{ASCII}*\z")
    return F.regexp_replace(F.coalesce(_compatible()(F.when(~plain, _c(x))), F.lower(_c(x))), "[^a-z0-9]", "")


@cache
def mark_table() -> tuple[str, str]:
    """Lower-case letters that are a base letter with marks, with their base letter; built from the Unicode data."""
    pairs = []
    for i in range(128, 0x2000):
        c = unicodedata.normalize("NFD", chr(i))
        if len(c) > 1 and chr(i).islower() and all(unicodedata.combining(m) for m in c[1:]):
            pairs.append((chr(i), c[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(x: Column | str) -> Column:
    """Search tokens: lower case, marks removed, cut where no letter or digit stands."""
    source, target = mark_table()
    folded = F.regexp_replace(F.translate(F.lower(_c(x)), source, target), r"\p{Mn}+", "")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def ascii_lower(x: Column | str) -> Column:
    """Lower case for A-Z only, as the store's LIKE folds."""
    return F.translate(_c(x), string.ascii_uppercase, string.ascii_lowercase)


def snippet(x: Column | str, most: int = 280) -> Column:
    """White space collapsed, at most ``most`` characters and then an ellipsis."""
    flat = strip(F.regexp_replace(_c(x), r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.regexp_replace(F.substring(flat, 1, most), r"(?U)\s+$", ""), F.lit("…"))).otherwise(flat)


def split_footer(x: Column | str) -> tuple[Column, Column]:
    """(body, footer), cut at the last model footer."""
    x = _c(x)
    has = x.rlike(FOOTER)
    return F.when(has, F.regexp_extract(x, FOOTER, 1)).otherwise(x), F.when(has, F.regexp_extract(x, FOOTER, 2)).otherwise(F.lit(""))


def truncate_chars(x: Column | str, most: int) -> Column:
    """At most ``most`` characters of the body; the footer stays. Zero or less: as it is."""
    x = _c(x)
    if most <= 0:
        return x
    body, footer = split_footer(x)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(body, 1, most), footer))


def page_numbers(x: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_c(x), F.lit(HEADER), F.lit(1)), lambda n: n.try_cast("int"))


def page_ranges(pages: Column | str) -> Column:
    """Runs of page numbers as text: [1,2,3,5,7,8] -> '1-3, 5, 7-8'."""

    def runs(p: Column) -> Column:
        first = F.filter(p, lambda n, i: (i == 0) | (F.get(p, i - 1) != n - 1))
        last = F.filter(p, lambda n, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != n + 1))
        return F.array_join(F.zip_with(first, last, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))), ", ")

    return _once(F.array_sort(F.array_distinct(F.filter(_c(pages), lambda n: n.isNotNull()))), runs)


def truncate_pages(x: Column | str, head: int, tail: int, headerless: int) -> tuple[Column, Column]:
    """(text with the first ``head`` and last ``tail`` pages, note or null); without headers a character limit.

    What stands before the first header belongs to the first page. The body is cut once, in front of its headers, and the
    pages kept are its first and last parts, so the work is linear in the text.
    """
    x, none = _c(x), F.lit(None).cast("string")
    if head <= 0:
        return x, none
    tail = max(tail, 0)
    # fixed texts of the notes
    notes = ("NOTE: The document transcription below was truncated to reduce cost. Included pages (from OCR headers): ", ". Total pages with OCR headers: ", ".")
    plain_note = f"NOTE: The document transcription below was truncated because page headers were not found. Included the first {headerless} characters."

    def ends(s: Column) -> Column:
        parts, numbers = s["parts"], s["numbers"]
        total = F.size(numbers)
        first = head + F.size(parts) - total  # parts of the head: one more where a text stands before the first header
        last = lambda a: F.slice(a, F.size(a) - tail + 1, tail) if tail else F.slice(a, 1, 0)
        cut = F.concat(F.array_join(F.slice(parts, 1, first), ""), F.array_join(last(parts), ""), s["footer"])
        note = F.concat(F.lit(notes[0]), page_ranges(F.concat(F.slice(numbers, 1, head), last(numbers))), F.lit(notes[1]), total.cast("string"), F.lit(notes[2]))
        plain = truncate_chars(s["x"], headerless)
        return (
            F.when(total == 0, _once(plain, lambda p: F.struct(p.alias("text"), F.when(p != s["x"], plain_note).alias("note"))))
            .when(total <= head + tail, F.struct(s["x"].alias("text"), none.alias("note")))
            .otherwise(F.struct(cut.alias("text"), note.alias("note")))
        )

    def cut(v: Column) -> Column:
        body, footer = split_footer(v)
        halves = F.struct(body.alias("body"), footer.alias("footer"))
        return _once(halves, lambda h: _once(F.struct(v.alias("x"), h["footer"].alias("footer"), F.split(h["body"], f"(?md)^(?={HEADER_LINE}$)").alias("parts"), page_numbers(h["body"]).alias("numbers")), ends))

    done = _once(x, cut)
    return done["text"], done["note"]


def char_note(most: int) -> str:
    """Fixed text: the note of the character limit."""
    return f"NOTE: The document transcription below was further truncated to the first {most} characters due to the max character limit."


def truncate(x: Column | str, head: int, tail: int, headerless: int, most: int) -> tuple[Column, Column]:
    """(text, notes or null): pages are cut first, then characters; each cut that changes the text adds its note."""
    cut, note = truncate_pages(x, head, tail, headerless)
    note = F.when(cut != _c(x), note)
    over = (F.length(cut) > most) if most > 0 else F.lit(False)
    notes = F.filter(F.array(note, F.when(over, char_note(most))), lambda n: n.isNotNull())
    return truncate_chars(cut, most), F.when(F.size(notes) > 0, F.array_join(notes, "\n"))


def assemble_pages(pages: Column | str, page_count: Column, with_models: bool = False) -> Column:
    """Full text of array<struct<page, text, model>>: headers if there are several pages, blank pages skipped, models below."""
    pages = _c(pages)
    kept = F.filter(pages, lambda p: F.length(strip(p["text"])) > 0)
    model = lambda p: F.when(F.length(F.coalesce(p["model"], F.lit(""))) > 0, F.concat(F.lit(" ("), p["model"], F.lit(")"))).otherwise("") if with_models else F.lit("")
    sections = F.transform(kept, lambda p: F.concat(F.when(page_count > 1, F.concat(F.lit("--- Page "), p["page"].cast("string"), model(p), F.lit(" ---\n"))).otherwise(""), p["text"]))
    models = F.array_sort(F.array_distinct(F.filter(F.transform(kept, lambda p: p["model"]), lambda m: F.length(m) > 0)))
    text = F.array_join(sections, "\n\n")
    footer = F.concat(F.lit("Transcribed by model: "), F.array_join(models, ", "))
    return F.when(F.size(models) == 0, text).when(F.length(text) > 0, F.concat(text, F.lit("\n\n"), footer)).otherwise(footer)


def language_code(x: Column | str) -> Column:
    """Two-letter code or 'und'; null where the value is empty."""
    low = F.lower(strip(x))
    return (
        F.when(F.length(_c(x)) == 0, F.lit(None))
        .when(low.rlike("^[a-z]{2}$"), low)
        .when(low.rlike("^[a-z]{2}[-_]"), F.substring(low, 1, 2))
        .when(_c(x).isNotNull(), F.lit("und"))
    )


#: Fixed formats: what counts as an ISO date and time: extended and basic forms, week dates, any one character between the two.
DATE = r"(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})|(\d{4})-W(\d{2})(?:-(\d))?|(\d{4})W(\d{2})(\d)?"
TIME = r"(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
ZONE = r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?"
STAMP = f"(?s)^(?:{DATE})(?:.{TIME}{ZONE})?$"


PARTS = "$1$4|$2$5|$3$6|$7$10|$8$11|$9$12"


def _once(value: Column, f) -> Column:
    """f(value), the value computed once: inside the lambda it is a variable."""
    return F.transform(F.array(value), f)[0]


def _parts(x: Column, pattern: str, parts: str) -> Column:
    return F.when(x.rlike(pattern), F.split(F.regexp_replace(x, pattern, parts), r"\|"))


def _day(p: Column) -> Column:
    """Date of PARTS: year, month, day or year, week, weekday."""
    week, weekday = p[4].try_cast("int"), F.coalesce(p[5].try_cast("int"), F.lit(1))
    by_week = _once(
        F.try_to_date(F.concat(p[3], F.lit("-01-04")), "yyyy-MM-dd"),
        lambda d: F.when(week.between(1, F.weekofyear(F.make_date(F.year(d), F.lit(12), F.lit(28)))) & weekday.between(1, 7), F.date_add(F.date_sub(d, F.weekday(d)), (week - 1) * 7 + weekday - 1)),
    )  # 4 January lies in week 1, 28 December in the last one
    return F.when(p[3] == "", F.try_to_date(F.concat_ws("-", p[0], p[1], p[2]), "yyyy-MM-dd")).otherwise(by_week)


def iso_date(x: Column | str) -> Column:
    """Date of an ISO text, by what stands before 'T'; null if it is none."""
    return _once(_parts(F.split(strip(x), "T")[0], f"^(?:{DATE})$", PARTS + "|"), _day)


def parse_timestamp(x: Column | str) -> Column:
    """Timestamp of an ISO text (session time zone UTC), null if it is none; no zone means UTC."""
    two = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("00"))

    def stamp(p: Column) -> Column:
        number = lambda i: two(F.substring(p[10], i, 2)).try_cast("int")
        offset = (number(2) * 3600 + number(4) * 60 + number(6)) * F.when(p[10].startswith("-"), -1).otherwise(1)
        text = F.concat(F.date_format(_day(p), "yyyy-MM-dd"), F.lit(" "), two(p[6]), F.lit(":"), two(p[7]), F.lit(":"), two(p[8]), F.lit("."), F.rpad(F.substring(p[9], 1, 6), 6, "0"))
        local = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        return F.when(F.abs(offset) < 86400, F.timestamp_micros(F.unix_micros(local) - offset.cast("bigint") * 1000000))

    parts = _parts(_c(x), STAMP, PARTS + "|$13|$14$17|$15$18|$16$19|$20")
    return _once(F.transform(parts, lambda q, i: F.when(i == 10, F.regexp_replace(q, "[Z:]", "")).otherwise(q)), stamp)


def iso_text(t: Column) -> Column:
    """UTC ISO text of a timestamp; microseconds only where there are some."""
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(t) % 1000000 != 0, F.date_format(t, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def utc_iso(x: Column | str) -> Column:
    """Timestamp text as UTC ISO text; what cannot be read stays as it is; no zone means UTC."""
    t = parse_timestamp(x)
    return F.when(t.isNotNull(), iso_text(t)).otherwise(_c(x))


def relative_time(then: Column, now: Column) -> Column:
    """'just now', '5m ago', '3h ago', 'yesterday', '4 days ago', '2 weeks ago'; '' for null."""
    s = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then))
    n = lambda unit: F.floor(s / unit).cast("string")
    return (
        F.when(then.isNull(), "").when(s < 60, "just now").when(s < 3600, F.concat(n(60), F.lit("m ago"))).when(s < 86400, F.concat(n(3600), F.lit("h ago")))
        .when(s < 172800, "yesterday").when(s < 604800, F.concat(n(86400), F.lit(" days ago"))).otherwise(F.concat(n(604800), F.when(F.floor(s / 604800) == 1, " week").otherwise(" weeks"), F.lit(" ago")))
    )
