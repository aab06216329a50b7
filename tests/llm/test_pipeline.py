"""The pipeline over the smallest tables: each stage keeps its promise on its own input."""

import os

import pytest
from test_near_copies import expected

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    from parchmill.llm import line_dedup, quality, secrets
    from parchmill.llm.common import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing"]
    held = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held.append(materialise(stage(spark, held[-1], SF), f"test-{name}"))
        assert held[-1].columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.quality_report(docs, labels).filter("kept").collect()}
    assert {r.doc_id for r in held[1].collect()} == good and 0 < len(good) < docs.count()
    report = {r.doc_id: r.n_dropped for r in line_dedup.line_report(held[1]).collect()}
    before, after = ({r.doc_id: r.text for r in h.collect()} for h in held[1:3])
    assert all(before[i].count("\n") - after[i].count("\n") in (n, n - 1) for i, n in report.items())
    first = set(expected([(r.doc_id, r.text) for r in held[2].sort("doc_id").collect()]))
    assert {r.doc_id for r in held[3].collect()} == first
    forest = secrets.train(spark)[0]
    assert secrets.findings(held[4], forest).filter("is_secret").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, held[4], SF)
    assert {r.doc_id for r in pieces.collect()} == first


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_odd_tables(spark):
    """Null ids and texts, repeated rows and columns of clashing names through all stages, and an empty table."""
    from parchmill.llm.common import materialise

    prose = [" ".join(f"{w}{j}" for j in range(80)) + "\na line that all of these hold" for w in ("river", "stone", "cloud")]
    one, two = 10**9 + 1, 10**9 + 2  # without labels, so that the base rules alone decide
    rows = [(one, prose[0]), (one, prose[0]), (None, prose[1]), (None, prose[1]), (None, None), (two, None), (3, ""), (4, " \n"), (None, prose[2]), (two, prose[2] + " password=b7db7aa4a5fcc78305x")]
    clash = ["__pm_doc", "__pm_text", "__pm_n", "__pm_path", "__pm_row", "__pm_fp", "__pm_root", "__pm_drop", "row", "path", "f"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string" + "".join(f", {c} string" for c in clash)
    for table in (spark.createDataFrame([(i, t, "en", "s", None, "k", *(f"{c}-{n}" for c in clash)) for n, (i, t) in enumerate(rows)], schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF), f"odd-{name}")
            assert name == "packing" or docs.columns == table.columns
            for r in docs.collect() if name != "packing" else []:
                assert {r[c] for c in clash} <= {f"{c}-{n}" for n in range(len(rows)) for c in clash} and len({r[c].split("-")[1] for c in clash}) == 1
            if name == "secret_scan" and table.count():
                left = {(r.doc_id, (r.text.split() or [""])[0]): r.text for r in docs.collect()}
                assert left.keys() == {(one, "river0"), (None, "stone0"), (two, "cloud0"), (None, "")} and "b7db7" not in left[two, "cloud0"]
        assert (docs.count() > 0) == (table.count() > 0)
