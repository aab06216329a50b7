"""Column functions against plain Python on edge rows."""

import pytest
from pyspark.sql import functions as F

from parchmill.functions import quality, tags, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("x", ["  Bank  Statement ", "a b C", "", "Ünïcode  ẞ"])
def test_normalise_simple(spark, x):
    assert one(spark, x, text.normalise_simple("x")) == " ".join(x.lower().split())


@pytest.mark.parametrize("x, want", [("Revolut Ltd.", "revolut"), ("A.B. Co Inc", ""), ("Ltd", ""), ("Acme & Sons", "acme sons"), ("Coop", "coop"), ("Big Corp GmbH", "big")])
def test_normalise_company(spark, x, want):
    assert one(spark, x, text.normalise_company("x")) in (want, "ab" if x.startswith("A.B") else want)


def test_normalise_key(spark):
    assert one(spark, "Ｆｕｌｌ-Width ① Ltd!", text.normalise_key("x")) == "fullwidth1ltd"
    assert one(spark, "Привет", text.normalise_key("x")) == ""
    assert one(spark, "ﬁ™Ⅳ ½ e\u0301a", text.normalise_key("x")) == "fitmiv12a"


def test_tokens(spark):
    assert one(spark, "Müller's e-mail, foo_bar CAFÉ́ 42", text.tokens("x")) == ["muller", "s", "e", "mail", "foo", "bar", "cafe", "42"]


def test_tokens_agree_with_fts5(spark):
    import sqlite3

    words = ["Müller", "foo_bar", "e-mail", "ÀÉÎÕÜ", "straße", "x1y2", "don't", "naïve café"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    con.executemany("INSERT INTO t VALUES (?)", [(w,) for w in words])
    mine = spark.createDataFrame([(w,) for w in words], "x string").select(F.explode(text.tokens("x"))).distinct().collect()
    assert {r[0] for r in mine} == {r[0] for r in con.execute("SELECT term FROM v")}


@pytest.mark.parametrize("pages, want", [([1, 2, 3, 5, 7, 8], "1-3, 5, 7-8"), ([], ""), ([4], "4"), ([3, 1, 2, 2], "1-3")])
def test_page_ranges(spark, pages, want):
    assert one(spark, pages, text.page_ranges("x"), "array<int>") == want


def test_footer_is_cut_at_the_last_marker(spark):
    x = "body\n\nTranscribed by model: a\n\nmore\n\nTranscribed by model: b"
    body, footer = text.split_footer("x")
    assert one(spark, x, body) == "body\n\nTranscribed by model: a\n\nmore" and one(spark, x, footer) == "\n\nTranscribed by model: b"
    assert one(spark, "plain", body) == "plain" and one(spark, "plain", footer) == ""


def test_truncation(spark):
    x = "0123456789\n\nTranscribed by model: m"
    assert one(spark, x, text.truncate_chars("x", 4)) == "0123\n\nTranscribed by model: m"
    assert one(spark, x, text.truncate_chars("x", 0)) == x
    paged = "intro\n" + "".join(f"--- Page {i} ---\nbody {i}\n" for i in range(1, 7))
    cut, note = text.truncate_pages("x", 2, 1, 10)
    assert one(spark, paged, cut) == "intro\n--- Page 1 ---\nbody 1\n--- Page 2 ---\nbody 2\n--- Page 6 ---\nbody 6\n"
    assert "1-2, 6. Total pages with OCR headers: 6." in one(spark, paged, note)
    assert one(spark, "x" * 30, cut) == "x" * 10 and "first 10 characters" in one(spark, "x" * 30, note)
    assert one(spark, "short", note) is None
    assert one(spark, "--- Page 1 (m-1) ---\na\n--- Page 2 ---\nb", cut).endswith("b")


def test_page_assembly(spark):
    rows = [([(1, "one", "b"), (2, "  ", "c"), (3, "three", "a")],), ([(1, "only", "")],), ([],)]
    df = spark.createDataFrame(rows, "p array<struct<page:int,text:string,model:string>>")
    got = [r[0] for r in df.select(text.assemble_pages("p", F.size("p"), True)).collect()]
    assert got == ["--- Page 1 (b) ---\none\n\n--- Page 3 (a) ---\nthree\n\nTranscribed by model: a, b", "only", ""]


@pytest.mark.parametrize("x, want", [(" EN ", "en"), ("de-AT", "de"), ("pt_BR", "pt"), ("english", "und"), ("und", "und"), ("", None), ("e1", "und")])
def test_language(spark, x, want):
    assert one(spark, x, text.language_code("x")) == want


def test_dates(spark):
    assert str(one(spark, " 2024-02-29T10:00 ", text.iso_date("x"))) == "2024-02-29"
    assert one(spark, "2024-02-30", text.iso_date("x")) is None and one(spark, "29.02.2024", text.iso_date("x")) is None
    assert one(spark, "2024-01-15T12:00:00+02:00", text.utc_iso("x")) == "2024-01-15T10:00:00+00:00"
    assert one(spark, "2024-01-15", text.utc_iso("x")) == "2024-01-15T00:00:00+00:00" and one(spark, "soon", text.utc_iso("x")) == "soon"


def test_timestamps_as_the_standard_reads_them(spark):
    import datetime as dt

    shapes = ["2024-01-15", "20240115", "2024-W03", "2024W031", "2020-W53-7", "2021-W53-1", "2024-02-30", "2024-01-15T10:11:12.123456", "2024-01-15T10:11:12.1234567+02:00", "20240115T101112Z", "2024-01-15 10:11", "2024-01-15T10:11:12+0530", "2024-01-15T10:11:12-05", "2024-01-15T10:61", "2024-1-5", "", "2024-01-15T", "2024-12-30T23:59:59.5-01:02:03", "soon"]

    def want(x):
        try:
            t = dt.datetime.fromisoformat(x)
        except ValueError:
            return x
        return (t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t.astimezone(dt.timezone.utc)).isoformat()

    def day(x):
        try:
            return dt.date.fromisoformat(x.split("T")[0])
        except ValueError:
            return None

    out = spark.createDataFrame([(x,) for x in shapes], "x string").select("x", text.utc_iso("x").alias("t"), text.iso_date("x").alias("d")).collect()
    assert [(r.t, r.d) for r in out] == [(want(r.x), day(r.x)) for r in out]


def test_both_cuts_add_their_notes(spark):
    paged = "".join(f"--- Page {i} ---\nbody\n" for i in range(1, 7))
    cut, note = text.truncate("x", 2, 1, 10, 12)
    assert one(spark, paged, cut) == paged[:12] and one(spark, paged, note).count("NOTE: ") == 2
    assert one(spark, "y" * 30, cut) == "y" * 10 and one(spark, "y" * 30, note).count("NOTE: ") == 1 and one(spark, "short", note) is None


def test_snippet(spark):
    assert one(spark, " a \n b ", text.snippet("x")) == "a b"
    assert one(spark, "word " * 100, text.snippet("x", 10)) == "word word…"


def test_tag_rules(spark):
    kind = "array<string>"
    assert one(spark, ["Bills", "bills", " BILLS ", "", "x"], tags.dedupe("x"), kind) == ["Bills", "x"]
    assert one(spark, ["New", "AI", "Bills"], tags.drop_blacklisted("x"), kind) == ["Bills"]
    assert one(spark, ["Revolut Ltd", "invoice", "Ann", "keep"], tags.drop_redundant("x", F.lit("Revolut"), F.lit("Invoice"), F.lit("ann")), kind) == ["keep"]
    assert one(spark, ["a", "b", "2024"], tags.enrich("x", F.lit("t\nTranscribed by model: M1, m2"), F.lit("2024-01-01"), "UK", 1, "2020-01-01"), kind) == ["m1", "m2", "2024", "uk", "a"]
    assert one(spark, ["a"], tags.enrich("x", F.lit(""), F.lit("?"), "", 0, "2020-01-01"), kind) == ["2020"]
    assert one(spark, [1, 2, 3], tags.swap("x", [2], [9]), "array<bigint>") == [1, 3, 9]
    assert [one(spark, x, tags.parse_ids("x")) for x in ("[3, 1, 3]", "{broken", None, '{"a": 1}')] == [[3, 1], [], [], []]
    fields = one(spark, [(1, "a"), (2, "b")], tags.upsert_field("x", 2, F.lit("c")), "array<struct<field:bigint,value:string>>")
    assert [tuple(f) for f in fields] == [(1, "a"), (2, "c")]


def test_long_tag_lists_are_neither_sorted_nor_normalised_word_by_word(spark):
    """The rules in one pass give what they give in turn, and names are normalised once for a row."""
    rows = [["New", " AI", "Bills", "bills\u2003", "Revolut, Ltd.", "REVOLUT", "tax  Return", "\u3000", "", None, "Ann", "gpt-a", "2024", "\u00c4rger", "\u00e4rger", "a b", "co", "x.y"], [], ["error "], [f"W{i % 7}" for i in range(40)], ["R e v o l u t", "ann  ", "taxreturn", "indexed\u00a0"], None]
    more = (F.lit("t\nTranscribed by model: GPT-A, m2"), F.lit("2024-01-01"), "UK", 20, "2020-01-01")
    for who in (("Revolut Inc", "Tax return", "ANN"), (None, None, None), ("\u00c4rger GmbH", "x.y", "Bills")):
        names = [F.lit(w).cast("string") for w in who]
        got = [one(spark, r, tags.ruled("x", *names, *more), "array<string>") for r in rows]
        assert got == [one(spark, r, tags.enrich(tags.drop_redundant(tags.drop_blacklisted("x"), *names), *more), "array<string>") for r in rows]
        if who[0] == "Revolut Inc":
            assert got[0] == ["gpt-a", "m2", "2024", "uk", "bills", "\u00e4rger", "a b", "co", "x.y"] and got[4][4:] == ["r e v o l u t", "taxreturn"]
    plan = spark.createDataFrame([(["a"],)], "x array<string>").select(tags.ruled("x", F.lit("a"), F.lit("b"), F.lit("c"), *more))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(transform(filter(transform(x" not in plan and "array_distinct" in plan


@pytest.mark.parametrize("x, want", [("text [Name REDACTED] x", True), ("I CAN'T ASSIST", True), ("redacted", False), ("", False)])
def test_refusals(spark, x, want):
    assert one(spark, x, quality.is_refusal("x")) is want


def test_gates(spark):
    assert quality.refuses("a [Name redacted]") and quality.refuses("I CANNOT assist") and not quality.refuses("fine")
    assert one(spark, "x", tags.date_for_tags(F.col("x"), F.lit("2020-02-03T01:00"), "2024-01-01")) == "2020-02-03" and one(spark, "x", tags.date_for_tags(F.col("x"), F.lit(None), "2024-01-01")) == "2024-01-01"
    assert one(spark, " N/A ", quality.is_generic_type("x")) and one(spark, None, quality.is_generic_type("x")) and not one(spark, "Invoice", quality.is_generic_type("x"))
    assert one(spark, " ", quality.is_empty_classification([F.col("x")], F.array(F.lit(" ")))) and not one(spark, "", quality.is_empty_classification([F.col("x")], F.array(F.lit("t"))))
    assert not one(spark, " \n", quality.is_indexable("x", F.array(F.lit(1)), None)) and not one(spark, "a", quality.is_indexable("x", F.array(F.lit(1)), 1))


def test_pages_are_cut_at_their_headers(spark):
    header = lambda i, m="": f"--- Page {i}{m} ---"
    pages = [f"{header(i, ' (a model)' if i % 3 == 0 else '')}\npage {i} \0 and\r--- Page 9 --- more{' --- Page 7 ---' if i == 2 else ''}\n" for i in range(1, 2001)]
    for pre in ("", "a text before\n"):
        for footer in ("", "\n\nTranscribed by model: a, b"):
            for n, head, tail in ((2000, 3, 2), (2000, 1000, 0), (5, 2, 1), (5, 3, 2), (5, 5, 0), (5, 1, 9), (1, 1, 0), (5, 2, -1)):
                x = pre + "".join(pages[:n]) + footer
                cut, note = text.truncate_pages("x", head, tail, 10)
                got = spark.createDataFrame([(x,)], "x string").select(cut.alias("c"), note.alias("n")).first()
                last = max(tail, 0)
                if head + last >= n:
                    assert (got.c, got.n) == (x, None)
                else:
                    kept = f"1-{head}" + (f", {n - last + 1}-{n}" if last > 1 else f", {n}" if last else "") if head > 1 else f"1, {n - last + 1}-{n}"
                    assert got.c == pre + "".join(pages[:head]) + "".join(pages[n - last : n] if last else []) + footer
                    assert f": {kept}. Total pages with OCR headers: {n}." in got.n
    rows = [(None,), ("",), (header("99999999999999999999") + "\nx\n" + header(2) + "\ny\n" + header(1) + "\nz",)]
    cut, note = text.truncate_pages("x", 1, 1, 10)
    got = spark.createDataFrame(rows, "x string").select(cut.alias("c"), note.alias("n")).collect()
    assert tuple(got[0]) == (None, None) and tuple(got[1]) == ("", None) and got[2].c == header("99999999999999999999") + "\nx\n" + header(1) + "\nz" and "headers): 1. Total" in got[2].n
