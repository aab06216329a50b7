"""Queries that search with every vector whose id is divisible by 50, on vectors of no clusters, which bounds cannot prune."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import plain
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from parchmill.operators import ranking
from parchmill.plans import catalog

VECTORS = 4000


def write_vectors(sf_dir, x, first=0):
    pq.write_table(pa.table({"vec_id": pa.array(range(first, first + len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array([0] * len(x), pa.int32())}), f"{sf_dir}/embeddings.parquet")


@pytest.fixture
def batches(monkeypatch, tmp_path):
    """Bytes of the Arrow batches that a query's Python steps yield."""
    seen, plain = tmp_path / "batches", DataFrame.mapInArrow
    monkeypatch.setattr(ranking, "PER_PIVOT", 4)  # as many cells as a large table has

    def spied(self, func, *args, **kwargs):
        def run(taken):
            for b in func(taken):
                with open(seen, "a") as f:
                    f.write(f"{b.nbytes}\n")
                yield b

        return plain(self, run, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInArrow", spied)
    return lambda: [int(n) for n in seen.read_text().split()]


def test_a_task_holds_no_copy_of_a_query_for_each_cell(spark, tmp_path, batches):
    x = np.random.default_rng(8).normal(size=(VECTORS, 64)).astype(np.float32)
    x[2000:2300] = x[50]  # more copies than a block holds
    write_vectors(tmp_path, x)
    got = {(r.list_no, r["rank"]): r.chunk_id for r in catalog.knn_multi_query(spark, str(tmp_path)).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert len(got) == 20 * VECTORS // 50
    for i in range(0, VECTORS, 50):
        d = 1 - (y * y[i]).sum(axis=1)
        assert [got[i, n] for n in range(1, 21)] == np.lexsort((np.arange(VECTORS), np.round(d, 12)))[:20].tolist()
    assert max(batches()) < 1 << 20  # a copy for each cell: 80 queries, 1,000 cells, over 500 bytes each


def same(spark, name, sf_dir, tables):
    """The query and its SQL over these tables."""
    got = catalog.QUERIES[name](spark, str(sf_dir))
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    rows = [dict(zip([d[0] for d in want.description], r)) for r in want.fetchall()]
    assert sorted(repr([plain(r[c]) for c in got.columns]) for r in got.collect()) == sorted(repr([plain(r[c]) for c in got.columns]) for r in rows)
    return rows


@pytest.mark.parametrize("bad", [0, np.nan, np.inf])
def test_a_vector_without_direction_in_place_of_the_pivot_costs_no_results(spark, tmp_path, bad):
    x = np.random.default_rng(11).normal(size=(100, 64)).astype(np.float32)
    x[spark.range(100).orderBy(F.xxhash64("id")).first().id] = bad
    write_vectors(tmp_path, x)
    assert len(same(spark, "knn_multi_query", tmp_path, ["embeddings"])) == 40


def test_multiples_of_vectors_rank_as_in_the_sql(spark, tmp_path):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    x[101:] = x[50] * rng.uniform(0.1, 9, size=(299, 1)).astype(np.float32)
    write_vectors(tmp_path, x)
    same(spark, "knn_multi_query", tmp_path, ["embeddings"])


@pytest.mark.parametrize("first", [-150, 1 << 60])
def test_documents_of_negative_and_of_large_ids(spark, tmp_path, first):
    write_vectors(tmp_path, np.random.default_rng(13).normal(size=(200, 64)).astype(np.float32), first)
    same(spark, "knn_multi_query", tmp_path, ["embeddings"])


def test_surplus_copies_of_a_vector_stay_out_of_the_blocks(spark, tmp_path, monkeypatch):
    made, block_best = tmp_path / "pairs", ranking._block_best

    def spied(row, *args):
        with open(made, "a") as f:
            f.write(f"{len(row['q_ids']) * len(row['c_ids']) // 64}\n")
        return block_best(row, *args)

    monkeypatch.setattr(ranking, "_block_best", spied)
    x = np.random.default_rng(14).normal(size=(VECTORS, 64)).astype(np.float32)
    x[1000:] = x[1000]
    write_vectors(tmp_path, x)
    same(spark, "knn_multi_query", tmp_path, ["embeddings"])
    assert sum(int(n) for n in made.read_text().split()) < VECTORS // 50 * 2000  # with all copies, 60 queries meet 3,000 of them


def test_fusion_of_many_lists_holds_no_copy_of_a_query_for_each_cell(spark, tmp_path, batches):
    write_vectors(tmp_path, np.random.default_rng(9).normal(size=(VECTORS, 64)).astype(np.float32))
    rows = same(spark, "rrf_fusion", tmp_path, ["embeddings"])
    assert len({r["document_id"] for r in rows}) == 10
    assert max(batches()) < 1 << 20


def test_sums_in_another_order_are_ties(spark):
    """1/61 + 1/67 + 1/62 is less by a bit than 1/61 + 1/62 + 1/67; the document seen first stays first."""
    lists = [(i, rank, chunk, chunk) for chunk, seen in ((1, [(0, 1), (1, 7), (2, 2)]), (2, [(3, 1), (4, 2), (5, 7)])) for i, rank in seen]
    fused = ranking.fuse(spark.createDataFrame(lists, "list_no int, rank int, chunk_id long, document_id long"))
    score = {r.chunk_id: r.rrf_score for r in fused.collect()}
    assert score[1] < score[2]
    assert [r.document_id for r in ranking.top_documents(fused, 1).collect()] == [1]


def test_sources_of_many_lists_shuffle_no_text_and_keep_unknown_documents(spark, tmp_path, batches):
    write_vectors(tmp_path, np.random.default_rng(10).normal(size=(VECTORS, 64)).astype(np.float32))
    ids = [i for i in range(VECTORS // 3 + 50) if i % 2]
    text = [None if i % 5 == 0 else f"Head {i}\n" + f"  word{i}" * (i % 90) for i in ids]
    columns = {"doc_id": pa.array(ids, pa.int64()), "text": text, "lang": ["en"] * len(ids), "source": ["src1"] * len(ids)}
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    rows = same(spark, "source_assembly", tmp_path, ["embeddings", "documents"])
    assert len(rows) == 10 and {bool(r["document_id"] % 2) for r in rows} == {True, False}
    assert max(batches()) < 1 << 20
    plan = catalog.source_assembly(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan  # whole texts are read once, for ten ids
