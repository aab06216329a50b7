"""Retrieval, chunks, library, control and reconciliation on small tables."""

import json
import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from parchmill.operators import chunking, control, documents, library, ranking, reconcile
from parchmill.operators.keywords import KeywordIndex
from parchmill.operators.ranking import Answered, NeedsMore, QueryPlan, SearchFilters

CHUNKS = [
    (11, 5, "harbour lamp and tide table", [0.9, 0.1, 0.4]), (12, 5, "the tide table for spring", [0.2, 0.8, 0.1]), (13, 6, "orchard ledger, second copy", [-0.3, 0.5, 0.7]),
    (14, 7, "spring orchard", [0.6, 0.6, -0.2]), (15, 7, "tide and tide again: tide table", [0.1, -0.9, 0.3]), (16, 8, "no vector", [0.0, 0.0, 0.0]), (17, 8, None, None), (18, 8, "short vector", [1.0, 2.0]),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, document_id long, text string, embedding array<float>")


@pytest.fixture(scope="module")
def index(chunks):
    return KeywordIndex.build(chunks)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(5, "Tides", 31, 41, [51], "2021-04-02T00:00:00+00:00"), (6, "orchard", 32, 42, [52, 53], "2022-09-30T00:00:00+00:00"), (7, "Äpfel", None, 41, [53, 99], "2021-04-03T00:00:00+00:00"), (8, "zero", 31, None, [], None)]
    return spark.createDataFrame(rows, "id long, title string, correspondent_id long, document_type_id long, tag_ids array<long>, created string").withColumn("indexed_at", F.lit("x"))


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame([("correspondent", 31, "Port Office"), ("correspondent", 32, "Grove & Sons"), ("document_type", 41, "Table"), ("document_type", 42, "Ledger"), ("tag", 51, "sea"), ("tag", 52, "land"), ("tag", 53, "fruit")], "kind string, id long, name string")


def cosine(a, b):
    return 1 - sum(x * y for x, y in zip(a, b)) / math.dist(a, [0] * len(a)) / math.dist(b, [0] * len(b))


def test_nearest(chunks):
    asked = [[1.0, 0.2, 0.3], [-0.2, 0.1, 0.9], [0.0, 1.0, 0.0]]
    want = []
    for i, q in enumerate(asked):
        near = sorted((round(cosine(q, v), 6), c) for c, _, _, v in CHUNKS if v and len(v) == 3 and any(v))
        want += [(i, n + 1, c, d) for n, (d, c) in enumerate(near[:3])]
    got = ranking.nearest(chunks, asked, 3).collect()
    assert sorted((r.list_no, r.rank, r.chunk_id, round(r.distance, 6)) for r in got) == want
    assert ranking.nearest(chunks, asked, 0).count() == 0 and ranking.nearest(chunks, asked, -2).count() == 0 and ranking.nearest(chunks, [], 5).count() == 0
    assert ranking.nearest(chunks.limit(0), asked, 3).count() == 0


def test_bm25_agrees_with_fts5(spark):
    rng = random.Random(3)
    words = ["tide", "table", "oil", "Lamp", "über", "e-mail", "oil_lamp", "42"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [""]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in texts])
    table = spark.createDataFrame([(i + 1, i // 2, x) for i, x in enumerate(texts)], "chunk_id long, document_id long, text string")
    index = KeywordIndex.build(table)
    cases = [([["tide", "table"]], '"tide table"'), ([["oil"], ["lamp", "tide"]], '"oil" AND "lamp tide"'), ([["e", "mail"], ["42"]], '"e-mail" AND "42"'), ([["oil", "lamp", "oil"]], '"oil_lamp oil"'), ([["uber"]], '"UBER"'), ([["oil"], ["oil"]], '"oil" AND "oil"'), ([["absent"], ["oil"]], '"absent" AND "oil"')]
    for terms, match in cases:
        want = con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t), rowid", (match,)).fetchall()
        got = [(r.chunk_id, r.score) for r in ranking.keyword_search(index, terms, 100).collect()]
        assert sorted(g[0] for g in got) == sorted(w[0] for w in want)
        assert all(math.isclose(g[1], dict(want)[g[0]], rel_tol=1e-9) for g in got) and [g[1] for g in got] == sorted(g[1] for g in got)
    some = spark.createDataFrame([(3,), (4,)], "document_id long")
    assert {r.document_id for r in ranking.keyword_search(index, [["oil"]], 100, some).collect()} <= {3, 4}
    assert ranking.keyword_search(index, [], 5).count() == 0 and ranking.keyword_search(index, [["oil"]], 0).count() == 0
    assert ranking.keyword_search(KeywordIndex.build(table.limit(0)), [["oil"]], 5).count() == 0


def test_search_reads_only_its_terms(index):
    plan = ranking.keyword_search(index, [["tide"], ["table"]], 5)._jdf.queryExecution().toString()
    assert "In(term, [table,tide])" in plan


def test_fusion(spark):
    rows = [(0, 1, 7, 70), (0, 2, 8, 80), (0, 3, 9, 70), (1, 1, 8, 80), (1, 2, 6, 60), (2, 1, 6, 60)]
    want = {}
    for _, rank, chunk, _ in rows:
        want[chunk] = want.get(chunk, 0) + 1 / (60 + rank)
    fused = ranking.fuse(spark.createDataFrame(rows, "list_no int, rank int, chunk_id long, document_id long"))
    got = {r.chunk_id: r.rrf_score for r in fused.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)
    assert {r.chunk_id for r in ranking.top_documents(fused, 2).collect()} == {8, 6}


AXES = {"sea": [1.0, 0.0, 0.2], "land": [0.0, 0.4, 0.9]}


def test_engine(chunks, index, docs, taxonomy):
    engine = ranking.SearchEngine(chunks, index, docs, AXES.__getitem__, top_k=1, taxonomy=taxonomy, base_url="https://a")
    assert [(r.document_id, r.correspondent, r.document_type, r.url) for r in engine.retrieve(QueryPlan(("land",), ("orchard ledger",))).collect()] == [(6, "Grove & Sons", "Ledger", "https://a/documents/6/")]
    assert [r.document_id for r in engine.retrieve(QueryPlan(("land",), filters=SearchFilters(correspondent_id=31, tag_ids=(51,)))).collect()] == [5]
    bare = SearchFilters(date_to="2021-04-02")  # texts compare, so that day's rows are out; nothing is left and the filters go
    assert [r.document_id for r in engine.retrieve(QueryPlan(("land",), filters=bare)).collect()] == [6]

    def broken(_):
        raise ValueError("no model")

    engine.embed = broken
    assert [r.document_id for r in engine.retrieve(QueryPlan(("land",), ("harbour",))).collect()] == [5]


def test_refinement_merges_chunks(chunks, index, docs):
    engine = ranking.SearchEngine(chunks, index, docs, AXES.__getitem__, top_k=1)
    seen = []

    def synthesise(question, context, final):
        seen.append((final, [(r.chunk_id, r.rrf_score) for r in context.collect()]))
        return json.dumps({"outcome": "answered", "answer": " done ", "citations": [6]}) if final else NeedsMore("land")

    answer, found, calls = engine.answer("q", lambda q: QueryPlan(("sea",)), synthesise)
    one = {r.chunk_id: r.rrf_score for r in engine.found(QueryPlan(("sea",))).collect()}
    two = {r.chunk_id: r.rrf_score for r in engine.found(QueryPlan(("sea", "land"))).collect()}
    merged = two | one  # a chunk of both rounds keeps the first round's score
    assert (answer, calls, [f for f, _ in seen]) == ("done", 3, [False, True])
    assert dict(seen[0][1]) == one and dict(seen[1][1]) == merged and [s for _, s in seen[1][1]] == sorted(merged.values(), reverse=True)
    owner = {c: d for c, d, _, _ in CHUNKS}
    assert {r.document_id: r.score for r in found.collect()} == {d: max(s for c, s in merged.items() if owner[c] == d) for d in {owner[c] for c in merged}}
    engine.max_refinements = 0
    answer, found, calls = engine.answer("q", lambda q: QueryPlan(("sea",)), synthesise)
    assert (answer, calls) == ("", 2) and found.count() == 1
    empty = ranking.SearchEngine(chunks.limit(0), KeywordIndex.build(chunks.limit(0)), docs, AXES.__getitem__)
    answer, found, calls = empty.answer("q", lambda q: QueryPlan(("sea",)), synthesise)
    assert (answer, calls, found.count()) == (ranking.NO_MATCH, 1, 0)


def test_outcomes_of_a_model():
    read = ranking.parse_outcome
    assert read('x {"outcome": "answered", "answer": null, "citations": ["3", 4]} y', False) == Answered("", (3, 4))
    assert read('{"outcome": "needs_more", "adjustment": " wider "}', False) == NeedsMore("wider") and read('{"outcome": "needs_more"}', True) == Answered(ranking.NOT_FOUND)
    for said in (None, "", "prose", "[1]", '{"outcome": "else"}', '{"outcome": "answered", "citations": ["x"]}'):
        assert read(said, False) == NeedsMore(ranking.BROADEN) and read(said, True) == Answered(ranking.UNREADABLE)


def test_chunker():
    text = "--- Page 1 (m) ---\n" + "a" * 30 + "\n\n" + "b" * 30 + "\n--- Page 2 ---\n" + "c" * 130
    out = chunking.chunk_text(text, 50, 10)
    assert all(len(t) <= 50 for t, _ in out) and out[0] == ("a" * 30, 1) and out[-1][1] == 2
    assert chunking.chunk_text("  \n ") == [] and chunking.chunk_text(None) == []
    assert chunking.chunk_text("short") == [("short", None)]
    assert chunking.chunk_text("before\n--- Page 1 ---\nbody") == [("before\n\nbody", 1)]  # the first page that is known


def plain_chunks(text, size, overlap):
    """The chunker as a list of steps over (paragraph, page), each window a list of pieces."""
    paragraphs, lines, page = [], [], None

    def flush():
        body = "\n".join(lines).strip()
        if body:
            paragraphs.append((body, page))
        lines.clear()

    for line in text.splitlines():
        header = chunking.HEADER.match(line)
        if header or not line.strip():
            flush()
            page = int(header[1]) if header else page
        else:
            lines.append(line)
    flush()
    out, pieces, where, carried = [], [], None, False
    while paragraphs:
        body, at = paragraphs[0]
        if len("\n\n".join([*pieces, body])) <= size:
            where = at if where is None or not pieces else where
            pieces, carried = [*pieces, body], False
            paragraphs.pop(0)
        elif pieces and not carried:
            whole = "\n\n".join(pieces)
            out.append((whole, where))
            pieces, carried = ([whole[-overlap:]] if overlap else []), True
        elif pieces:
            pieces = []
        else:
            starts = [s for s in range(0, len(body), size - overlap) if s == 0 or s + overlap < len(body)]
            out += [(body[s : s + size], at) for s in starts]
            pieces, carried, where = ([out[-1][0][-overlap:]] if overlap else []), True, at
            paragraphs.pop(0)
    return out + ([("\n\n".join(pieces), where)] if pieces and not carried else [])


def test_chunker_against_plain_steps():
    rng = random.Random(1)
    for _ in range(2000):
        size = rng.randint(2, 40)
        overlap = rng.randint(0, size - 1)
        text = "".join(rng.choice(["a", "b", " ", "\n", "\n\n", "word ", "\n--- Page %d ---\n" % rng.randint(1, 9), "\n--- Page 3 (m-1) ---\n"]) for _ in range(rng.randint(0, 120)))
        out = chunking.chunk_text(text, size, overlap)
        assert out == plain_chunks(text, size, overlap) and all(0 < len(t) <= size for t, _ in out)


def test_embedding_failures_stay_in_their_batch(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [chunking.hash_embedding(t) for t in texts]

    table = spark.createDataFrame([(1, 0, "good", None), (2, 0, "bad", None)], chunking.CHUNKS).coalesce(1)
    out = {r.text: r for r in chunking.embed_chunks(table, model, batch=1).collect()}
    assert out["good"].error is None and len(out["good"].embedding) == 64 and "ValueError" in out["bad"].error


def test_browse(docs, taxonomy):
    run = lambda **k: [r.id for r in library.browse(docs, taxonomy, library.BrowseQuery(**k))[0].collect()]
    assert run() == [6, 7, 5, 8] and run(descending=False) == [8, 5, 7, 6] and run(limit=2, offset=1) == [7, 5]
    assert run(text="PORT") == [5, 8] and run(text="& sons") == [6] and run(text="äpfel") == [] and run(text="Äpfel") == [7] and run(text="%") == [] and run(text="_") == []
    assert library.browse(docs, taxonomy, library.BrowseQuery(text="table"))[1].first().total == 2
    with pytest.raises(ValueError):
        run(sort="nope")
    assert {r.id: r.tag_names for r in library.tag_names(docs, taxonomy).collect()} == {5: ["sea"], 6: ["land", "fruit"], 7: ["fruit"], 8: []}


def test_lookups(docs, taxonomy, chunks):
    got = {r.id: r for r in library.get_documents(docs, taxonomy, [6, 8, 404]).collect()}
    assert got.keys() == {6, 8} and got[6].correspondent == "Grove & Sons" and got[6].tags == ["land", "fruit"] and got[8].document_type is None
    assert library.document_summary(docs, taxonomy, 7).first().page_count is None and library.document_summary(docs, taxonomy, 404).count() == 0
    assert [(r.chunk_id, r.score) for r in library.get_chunks(chunks, [12, 99]).collect()] == [(12, 0.0)]
    assert library.exists(docs, 5) and not library.exists(docs, 404)
    assert [r.name for r in library.get_taxonomy(taxonomy, "tag").collect()] == ["fruit", "land", "sea"]
    assert library.bounded_page(3, 20) == (40, 20) and library.bounded_query("q") == "q"
    for bad in ((0, 20), (1, 0), (1, 101), (10_001, 1)):
        with pytest.raises(ValueError):
            library.bounded_page(*bad)
    for bad in (" ", "x" * 4001):
        with pytest.raises(ValueError):
            library.bounded_query(bad)


def test_library_checks(spark, docs, chunks):
    c = chunks.select("document_id", F.lit(0).alias("chunk_index")).unionByName(spark.createDataFrame([(99, 0)], "document_id long, chunk_index int"))
    assert {r.check: r.n for r in library.quick_check(docs, c).collect()} == {"repeated document ids": 0, "orphan chunks": 1, "chunk index gaps": 3}


def test_control(spark):
    now = F.lit("2024-01-01T00:10:00+00:00").cast("timestamp")
    beats = spark.createDataFrame([("ocr", "2024-01-01T00:00:00+00:00", "busy", 1), ("ocr", "2024-01-01T00:09:30+00:00", "idle", 5), ("index", "nonsense", "busy", 2)], "name string, last_heartbeat string, detail string, processed_count long")
    got = control.latest_heartbeats(beats, ["ocr", "index", "web"], now)
    assert {r.name: r.state for r in got.collect()} == {"ocr": "idle", "index": "stopped", "web": "stopped"}
    assert control.overall_health(got).first().health == "degraded"
    held = {"a": 1, "b": "x", "c": 2.5, "d": -3, "e": True, "f": " +1_0 ", "g": [1], "h": None, "i": {"j": 1}, "k": -7.9, "l": "2.5"}
    numbers = spark.createDataFrame([(json.dumps(held),), ("junk",), (None,), ("[1]",)], "s string").select(control.summary_numbers("s").alias("m")).collect()
    want = {}
    for k, v in held.items():
        try:
            want[k] = int(v)
        except (TypeError, ValueError):
            continue
    assert numbers[0].m == want and not any(n.m for n in numbers[1:])
    searches = spark.createDataFrame([(1, 7, "a", "t1"), (2, 7, "a", "t3"), (3, 7, "b", "t2")], "id long, user_id long, query string, created_at string")
    assert [(r.query, r.n) for r in control.recent_searches(searches, 1).collect()] == [("a", 1)]


def test_failures(spark):
    state = spark.createDataFrame([(1, 4), (2, 2), (3, 1)], "id long, failures int")
    results = spark.createDataFrame([(1, "FAILED"), (2, "INDEXED"), (4, "FAILED")], "id long, outcome string")
    new = reconcile.fold_failures(state, results)
    assert {r.id: r.failures for r in new.collect()} == {3: 1, 4: 1}
    assert [(r.id, r.failures) for r in reconcile.dead_letters(state, results).collect()] == [(1, 5)]
    later = reconcile.fold_failures(new, results.filter("id = 1"))
    assert {r.id: r.failures for r in later.collect()} == {1: 1, 3: 1, 4: 1}  # given up, then changed: it begins anew
    assert {r.id for r in reconcile.retry_ids(new, results.filter("id = 4")).collect()} == {3}
    assert [r.id for r in reconcile.fold_failures(state, results, spark.createDataFrame([(3,)], "id long")).collect()] == [4]
    titles = reconcile.failed_documents(state, spark.createDataFrame([(2, "two")], "id long, title string")).collect()
    assert [tuple(r) for r in titles] == [(1, None, 4), (2, "two", 2), (3, None, 1)]


def test_watermark(spark):
    page = spark.createDataFrame([(1, "2024-01-01T00:00:05+00:00"), (2, "junk"), (3, "2023-01-01T00:00:00+00:00"), (4, None)], "id long, modified string")
    assert reconcile.next_watermark(page).first().watermark == "2023-12-31T23:59:55+00:00"
    assert reconcile.next_watermark(page.withColumn("modified", F.lit("2024-01-01T00:00:05.25+01:00"))).first().watermark == "2023-12-31T22:59:55.250000+00:00"
    assert reconcile.next_watermark(page.filter("id = 2")).first().watermark is None
    assert {r.id for r in reconcile.since(page, "2023-06-01").collect()} == {1, 2}
    offsets = spark.createDataFrame([(1, "2023-12-31T23:30:00-02:00"), (2, "2024-01-01T00:30:00+01:00"), (3, "2024-01-01T00:00:00Z")], "id long, modified string")
    assert {r.id for r in reconcile.since(offsets, "2024-01-01T00:00:00+00:00").collect()} == {1}
    two = offsets.withColumn("content", F.lit("x")).withColumn("id", F.lit(1))
    assert reconcile.newest(two).first().modified == "2023-12-31T23:30:00-02:00"


def one_by_one(wanted, taxonomy, first):
    """Names resolved in order, each created where nothing known matches."""
    from parchmill.functions import text

    names = sorted({(k, n) for k, n, _ in wanted} | {(k, n) for k, _, n in taxonomy})
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.active()
    table = spark.createDataFrame(names, "kind string, name string")
    keyed = table.withColumn("key", F.when(F.col("kind") == "correspondent", text.normalise_company("name")).otherwise(text.normalise_simple("name")))
    key = {(r.kind, r.name): r.key for r in keyed.collect()}
    known, made, out = {}, [], {}
    for kind, i, name in sorted(taxonomy, key=lambda r: r[1]):
        known.setdefault(kind, {})[key[kind, name]] = i
    count = {}
    for kind, name, _ in sorted(wanted, key=lambda r: r[2]):
        own, entries = key[kind, name], known.setdefault(kind, {})
        if not own:
            continue
        hit = own if own in entries else next((e for e in entries if own in e or e in own), None) if kind == "correspondent" else None
        if hit is None:
            entries[own] = first + count.get(kind, 0)
            count[kind] = count.get(kind, 0) + 1
            made.append((kind, entries[own], name))
            hit = own
        out[kind, name] = entries[hit]
    return out, made


@pytest.mark.parametrize("seed", range(3))
def test_get_or_create_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "abc", "b", "cab", "Dover", "dove", "Ltd", "x"])
    taxonomy = [("correspondent", 5, "Dover Port"), ("correspondent", 6, "cab"), ("tag", 7, "Sea"), ("correspondent", 9, "CAB Ltd")] + ([("correspondent", 3, "!!")] if seed == 2 else [])
    wanted = [(rng.choice(["correspondent", "tag"]), " ".join(word() for _ in range(rng.randint(1, 3))), i) for i in range(60)] + [("tag", "  ", 99), ("tag", "SEA ", 100), ("correspondent", "Port", 101)]
    ids, new = documents.get_or_create(spark.createDataFrame(wanted, "kind string, name string, position long"), spark.createDataFrame(taxonomy, "kind string, id long, name string"), 1000)
    want, made = one_by_one(wanted, taxonomy, 1000)
    assert {(r.kind, r.name): r.id for r in ids.collect()} == want
    assert sorted((r.kind, r.id, r.name) for r in new.collect()) == sorted(made)


def test_classification_reads_pages_first(spark):
    pages = "".join(f"--- Page {i} ---\n{'w' * 500}\n" for i in range(1, 41))
    rows = [(1, pages, []), (2, "ok [Name REDACTED] here", []), (3, "I can't assist", []), (4, " ", []), (5, "fine", [9]), (6, None, [])]
    prompts = spark.sparkContext.accumulator(0)

    def model(prompt):
        prompts.add(1)
        return json.dumps({"title": prompt.split("\n\n")[0], "document_type": "Letter", "tags": ["x"]})

    out = {r.id: r for r in documents.classify(spark.createDataFrame(rows, "id long, content string, tag_ids array<long>"), model, error_tag=9, max_chars=700).collect()}
    assert {i: r.disposition for i, r in out.items()} == {1: "applied", 2: "refusal", 3: "refusal", 4: "requeue", 5: "error_tag", 6: "requeue"} and prompts.value == 1
    assert "Included pages (from OCR headers): 1-3, 40. Total pages with OCR headers: 40." in out[1].title and "further truncated to the first 700 characters" in out[1].title


def test_transcription_asks_the_next_model(spark):
    said = {"a": ["page [Name REDACTED]", "I CANNOT ASSIST", "fine", ""], "b": ["whole", "read", "other", "late"]}
    models = [(n, lambda image, n=n: said[n][image[0]]) for n in "ab"]
    rows = [(1, i + 1, bytes([i])) for i in range(4)] + [(1, 5, None), (2, 1, b"\x09")]
    out = {r.id: r for r in documents.transcribe(spark.createDataFrame(rows, "id long, page int, image binary"), models).collect()}
    assert out[1].content == "--- Page 1 ---\nwhole\n\n--- Page 2 ---\nread\n\n--- Page 3 ---\nfine\n\nTranscribed by model: a, b" and not out[1].has_errors
    assert out[2].has_errors and "Failed to OCR page 1." in out[2].content


def test_containments_of_long_names(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab é😀") for _ in range(n))
    outer = [word(rng.randint(0, 40)) for _ in range(60)] + [word(20_000), "ab" * 300]
    inner = [word(rng.randint(0, 9)) for _ in range(150)] + [o[i : i + n] for o in outer for i, n in ((1, 7), (3, 12), (5, 200))] + ["ab" * 200, "ab" * 301, "absent from all of these"]
    a = spark.createDataFrame([(x, i) for i, x in enumerate(inner)], "inner_key string, a int")
    b = spark.createDataFrame([(x, i) for i, x in enumerate(outer)], "outer_key string, b int")
    got = sorted((r.a, r.b) for r in documents.containments(a, b).collect())
    assert got == sorted((i, j) for i, x in enumerate(inner) for j, y in enumerate(outer) if x and y and x in y)
    assert documents.containments(a.limit(0), b).count() == 0 and documents.containments(a, b.limit(0)).count() == 0


def test_chunks_without_owner_are_not_ranked(spark):
    rows = [(1, 10, [1.0, 0.0]), (2, None, [1.0, 0.0]), (None, 11, [1.0, 0.0]), (3, 12, [0.5, 0.5]), (4, 13, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<float>")
    assert [r.chunk_id for r in ranking.nearest(chunks, [[1.0, 0.0]], 5).orderBy("rank").collect()] == [1, 3]
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (None, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.query_id, r.chunk_id) for r in ranking.nearest_of_all(asked, chunks, 5, 2).orderBy("rank").collect()] == [(7, 1), (7, 3)]


def test_deep_pages(spark, taxonomy, monkeypatch):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "c", None]), None, None, rng.choice(["2021", "2022", None])) for i in range(500)]
    docs = spark.createDataFrame(rows, "id long, title string, correspondent_id long, document_type_id long, created string")
    for sort, down in (("title", True), ("title", False), ("created", True)):
        front = [r.id for r in library.browse(docs, taxonomy, library.BrowseQuery(sort=sort, descending=down, limit=500))[0].collect()]
        monkeypatch.setattr(library, "DEEP", 100)
        for offset, limit in ((95, 10), (250, 24), (490, 24), (499, 1), (500, 5), (0, 101)):
            page = library.browse(docs, taxonomy, library.BrowseQuery(sort=sort, descending=down, limit=limit, offset=offset))[0]
            assert [r.id for r in page.collect()] == front[offset : offset + limit]
        monkeypatch.setattr(library, "DEEP", 10_000)
    assert library.SortedPages.build(docs.limit(0), "title").page(0, 5).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these parts are small
    held = library.SortedPages.build(docs, "title")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.id for r in held.page(0, 500).orderBy("__at").collect()] == [r.id for r in library.browse(docs, taxonomy, library.BrowseQuery(sort="title", limit=500))[0].collect()]
    plan = held.page(400, 10)._jdf.queryExecution().executedPlan().toString()
    assert len(held.starts) > 2 and "PartitionFilters" in plan and "__part" in plan


def test_cells_that_cannot_hold_neighbours_are_left_out(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ranking, "PER_PIVOT", 20)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 6))
    x = [*(centres[rng.integers(0, 25, 900)] + rng.normal(size=(900, 6)) * 0.03), *rng.normal(size=(60, 6)), np.zeros(6), centres[3], centres[3], centres[3]]
    rows = [(i, i // 3, [float(c) for c in v]) for i, v in enumerate(x)] + [(None, 1, [1.0] * 6), (5000, None, [1.0] * 6), (5001, 1, [1.0] * 5), (5002, 1, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<double>").repartition(3)
    asked = [(i, v) for i, _, v in rows if i is not None and i % 50 == 0 and v] + [(961, rows[961][2]), (960, rows[960][2])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    held = [(i, np.array(v)) for i, d, v in rows if i is not None and d is not None and v and len(v) == 6 and np.any(v)]
    for k in (1, 4, 2000):
        report, want = {}, []
        for i, v in asked:
            if len(v) == 6 and np.any(v):
                near = sorted((1 - float(np.dot(v, y) / np.linalg.norm(v) / np.linalg.norm(y)), j) for j, y in held)[:k]
                want += [(i, n + 1, round(d, 9)) for n, (d, _) in enumerate(near)]
        got = ranking.nearest_of_all(queries, chunks, k, 6, report).collect()
        assert sorted((r.query_id, r.rank, abs(round(r.distance, 9))) for r in got) == sorted((i, n, abs(d)) for i, n, d in want)
        assert report["made"] < report["all"] / 3 if k < 5 else report["made"] <= report["all"]
    assert ranking.nearest_of_all(queries, chunks.limit(0), 3, 6).count() == 0 and ranking.nearest_of_all(queries.limit(0), chunks, 3, 6).count() == 0


def test_queries_travel_once_to_a_block(spark, monkeypatch):
    """Vectors of no clusters, which bounds cannot prune: a query has a row's place in each block, not in each cell, and copies are ranked by id."""
    import numpy as np

    monkeypatch.setattr(ranking, "PER_PIVOT", 4)
    monkeypatch.setattr(ranking, "LEAST_BLOCK", 100)
    monkeypatch.setattr(ranking, "CHUNK_BLOCK", 150)
    kept = {}
    monkeypatch.setattr(ranking, "materialise", lambda df, name, of=ranking.materialise: kept.setdefault(name, []).append(of(df, name)) or kept[name][-1])
    x = np.random.default_rng(6).normal(size=(1000, 32)).astype(np.float32)
    x[300:700] = x[5]  # more copies than a block holds
    rows = [(i, i, v.tolist()) for i, v in enumerate(x)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<float>").repartition(3)
    queries = chunks.filter("chunk_id % 20 = 5").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in ranking.nearest_of_all(queries, chunks, 7, 32).collect()}
    y = x.astype(np.float64)
    for i in range(5, 1000, 20):
        d = 1 - (y * y[i]).sum(axis=1) / np.linalg.norm(y, axis=1) / np.linalg.norm(y[i])
        assert [got[i, n] for n in range(1, 8)] == np.lexsort((np.arange(1000), np.round(d, 12)))[:7].tolist()
    sent = kept["query-rows"][1].agg(F.sum(F.octet_length("q_ids") / 8)).first()[0]
    assert len(kept["query-rows"]) == 2 and 0 < sent <= 50 * kept["chunk-blocks"][0].select("block").distinct().count() < 50 * 30
    assert kept["chunk-blocks"][0].agg(F.max(F.octet_length("c_ids") / 8)).first()[0] <= 150
