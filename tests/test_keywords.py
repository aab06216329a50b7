"""Block postings against BM25 over all rows, and the keyword index kept with the chunks."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_store import DOC, rows

from parchmill.operators import chunking, keywords, reconcile
from parchmill.sources.snapshots import SnapshotStore


def brute(texts, phrases, k=1000):
    """BM25 of (chunk_id, text) rows, in Python."""
    cut = {c: (t or "").lower().split() for c, t in texts}
    mean = sum(map(len, cut.values())) / max(1, len(cut))
    f = {c: [sum(w[i : i + len(p)] == p for i in range(len(w))) for p in phrases] for c, w in cut.items()}
    idf = [max(math.log((len(cut) - h + 0.5) / (h + 0.5)), 1e-6) for h in (sum(x[i] > 0 for x in f.values()) for i in range(len(phrases)))]
    idf = [x if x > 0 else 1e-6 for x in idf]
    score = {c: -sum(w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(cut[c]) / mean)) for w, n in zip(idf, x)) for c, x in f.items() if all(x)}
    return sorted(((s, c) for c, s in score.items()))[:k]


def same(got, want):
    got = [(r.score, r.chunk_id) for r in got.collect()]
    assert [c for _, c in got] == [c for _, c in want] and all(math.isclose(a, b, rel_tol=1e-9) for (a, _), (b, _) in zip(got, want))


def test_blocks_are_skipped_and_results_are_whole(spark, monkeypatch):
    monkeypatch.setattr(keywords, "BLOCK", 8)
    monkeypatch.setattr(keywords, "FEW", 10)
    rng = random.Random(4)
    words = ["alpha"] * 3 + ["beta", "gamma", "delta", "x", "y", "z", "w"]
    texts = [(i * 7, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30) if i % 90 else 3)) if i % 11 else None) for i in range(1500)]
    texts += [(90001 + i, "beta " * (30 - i) + "gamma gamma") for i in range(12)]
    table = spark.createDataFrame([(c, c // 3, t, "clash") for c, t in texts], "chunk_id long, document_id long, text string, block string")
    index = keywords.KeywordIndex.build(table)
    for phrases in ([["beta"]], [["beta"], ["gamma"]], [["alpha"]], [["beta"], ["beta"]], [["beta", "beta"], ["gamma"]], [["nowhere"]], [["nowhere"], ["beta"]]):
        for k in (1, 5, 2000):
            same(keywords.keyword_search(index, phrases, k), brute(texts, phrases, k))
    report = {}
    same(keywords.keyword_search(index, [["beta"]], 5, report=report), brute(texts, [["beta"]], 5))
    assert report["blocks"] > 150 and report["decoded"] < report["blocks"] / 4
    some = spark.createDataFrame([(c // 3,) for c, _ in texts if c % 5 == 0], "document_id long")
    same(keywords.keyword_search(index, [["beta"]], 5, some), [x for x in brute(texts, [["beta"]]) if any(c // 3 == x[1] // 3 for c, _ in texts if c % 5 == 0)][:5])
    pairs = sum(len(set((t or "").split())) for _, t in texts)
    assert index.postings.agg(F.sum("n")).first()[0] == pairs and index.postings.count() < pairs


def test_empty_index(spark):
    index = keywords.KeywordIndex.build(spark.createDataFrame([], "chunk_id long, document_id long, text string"))
    assert index.size == (0, 0) and keywords.keyword_search(index, [["a"]], 5).count() == 0
    assert keywords.keyword_search(keywords.KeywordIndex(spark), [["a"]], 5).count() == 0
    nulls = keywords.KeywordIndex.build(spark.createDataFrame([(None, None, None), (1, None, ""), (2, 3, "word")], "chunk_id long, document_id long, text string"))
    assert nulls.size == (3, 1 / 3) and [r.chunk_id for r in keywords.keyword_search(nulls, [["word"]], 5).collect()] == [2]


@pytest.fixture
def job(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store", reconcile.KEYS, fanout=3)
    empty = lambda s: spark.createDataFrame([], s)
    kept = keywords.Keywords(store, fanout=3)
    store.commit(replace={"documents": empty(DOC + ", content_hash string, chunk_count int, embed_key string"), "chunks": empty(chunking.CHUNKS + ", embedding array<float>"), "failures": empty("id long, failures int"), "meta": empty("key string, value string"), "taxonomy": empty("kind string, id long, name string"), **kept.empty()})
    model = lambda texts: [chunking.hash_embedding(t) for t in texts]
    return store, kept, reconcile.Reconciler(store, lambda d: chunking.chunk_documents(d, 40, 5), lambda c: chunking.embed_chunks(c, model, batch=1), "hash/64", keywords=kept)


def test_index_follows_the_chunks(spark, job):
    store, kept, r = job
    rng, held, most = random.Random(8), {}, 0
    for n in range(5):
        batch = {rng.randint(1, 30): " ".join(rng.choice(["sea", "lamp", "oil", "tide"]) for _ in range(rng.randint(1, 25))) for _ in range(8)}
        held |= batch
        r.sync(rows(spark, *[(i, f"t{i}", text, [], f"2024-01-0{n + 1}T00:00:00+00:00") for i, text in batch.items()]))
        if n % 2:
            gone = rng.sample(sorted(held), 3)
            held = {i: t for i, t in held.items() if i not in gone}
            r.sweep(rows(spark, *[(i, "", "", [], "") for i in held]), complete=True)
        chunks = [(c.id, c.text) for c in store.read("chunks").select(keywords.chunk_id().alias("id"), "text").collect()]
        assert {c >> keywords.CHUNK_BITS for c, _ in chunks} == held.keys()
        index = kept.index()
        assert index.size == (len(chunks), sum(len(t.split()) for _, t in chunks) / len(chunks))
        for phrases in ([["sea"]], [["lamp", "oil"]], [["sea"], ["tide"]]):
            same(keywords.keyword_search(index, phrases, 100), brute(chunks, phrases))
        most = max(most, len(index.segments))
    assert most <= 3 and kept.collect_garbage() > 0 and kept.collect_garbage() == 0
    same(keywords.keyword_search(kept.index(), [["sea"]], 100), brute(chunks, [["sea"]]))
    r.rebuild()
    assert kept.index().size == (0, 0) and keywords.keyword_search(kept.index(), [["sea"]], 5).count() == 0


def test_a_segment_is_written_once_without_a_shuffle(spark, tmp_path):
    rows = [(i, i, f"the word{i} of the house") for i in range(1300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, text string").repartition(3)
    chunks.write.parquet(f"{tmp_path}/chunks")
    before = spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration())
    index = keywords.KeywordIndex.build(spark.read.parquet(f"{tmp_path}/chunks"), f"{tmp_path}/index")
    assert not before.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{tmp_path}/index/postings")) and index.size == (1300, 5.0)
    for f in (tmp_path / "index").glob("part-*.parquet"):  # each file is sorted by term, its blocks first
        terms = spark.read.parquet(f"file://{f}").select("term").toArrow().column("term").to_pylist()
        kept = [t for t in terms if t is not None]
        assert kept == sorted(kept) and terms[: len(terms) - len(kept)] == [None] * (len(terms) - len(kept))
    assert keywords.KeywordIndex.build(spark.read.parquet(f"{tmp_path}/chunks").limit(0)).size[0] == 0
