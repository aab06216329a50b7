"""The snapshot store, syncs, cycles, streams and the control plane's writes."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from parchmill.operators import accounts, chunking, reconcile, settings
from parchmill.sources import images
from parchmill.sources.snapshots import SnapshotStore
from parchmill.streaming.sync import Cycles, stream_queue, stream_sync

DOC = "id long, title string, content string, tag_ids array<long>, correspondent_id long, document_type_id long, created string, modified string"


def reconciler(spark, root, model=None):
    store = SnapshotStore(spark, f"file://{root}", reconcile.KEYS, fanout=3)
    empty = lambda s: spark.createDataFrame([], s)
    store.commit(replace={"documents": empty(DOC + ", content_hash string, chunk_count int, embed_key string"), "chunks": empty(chunking.CHUNKS + ", embedding array<float>"), "failures": empty("id long, failures int"), "meta": empty("key string, value string"), "taxonomy": empty("kind string, id long, name string")})
    model = model or (lambda texts: [chunking.hash_embedding(t) for t in texts])
    return store, reconcile.Reconciler(store, lambda d: chunking.chunk_documents(d, 40, 5), lambda c: chunking.embed_chunks(c, model, batch=1), "hash/64", error_tag=9)


def rows(spark, *items):
    return spark.createDataFrame([(i, t, c, tags, None, None, "2024-01-01", m) for i, t, c, tags, m in items], DOC)


def test_commits_are_changes(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", {"t": "k"}, fanout=3)
    table = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    store.commit(replace={"t": table(*[(i, f"v{i}") for i in range(40)])})
    held, pinned = {i: [f"v{i}"] for i in range(40)}, []
    for n in range(8):
        store.commit(upsert={"t": table((n, f"a{n}"), (n, f"b{n}"), (100 + n, "new"))}, delete={"t": spark.createDataFrame([(n + 1,), (20 + n,), (n,)], "k long")})
        held = {k: v for k, v in held.items() if k not in (n + 1, 20 + n)} | {n: [f"a{n}", f"b{n}"], 100 + n: ["new"]}
        got = {}
        for r in store.read("t").collect():
            got.setdefault(r.k, []).append(r.v)
        assert {k: sorted(v) for k, v in got.items()} == held
        pinned.append((store.head()[1], len(got)))
    state = store.head()[1]["t"]
    assert len(state["changes"]) < 3 and all(c[1] <= 40 for c in state["changes"])
    assert all(store.read("t", at).select("k").distinct().count() == n for at, n in pinned)
    assert store.collect_garbage() > 0 and store.read("t").select("k").distinct().count() == pinned[-1][1] and store.collect_garbage() == 0


def test_newer_schema_is_refused(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", {})
    spark.createDataFrame([(1, 99, "{}")], "version long, schema_version int, tables string").write.mode("append").parquet(f"{store.root}/log")
    with pytest.raises(ValueError):
        store.head()


def test_sync_and_sweep(spark, tmp_path):
    store, r = reconciler(spark, tmp_path)
    assert r.health() == ("index-not-ready", "never_reconciled") and r.check_model() and not r.check_model()
    first = rows(spark, (1, "one", "some text " * 10, [], "2024-01-01T00:00:00+00:00"), (2, "two", "other", [], "2024-01-02T00:00:00+00:00"), (3, "bad", "x", [9], ""), (4, "blank", " ", [], ""))
    assert r.sync(first, "t1") == {"seen": 4, "indexed": 2, "metadata_only": 0, "skipped": 2, "failed": 0, "given_up": 0}
    assert r.health() == ("ok", "") and r.meta()["modified_watermark"] == "2024-01-01T23:59:50+00:00"
    pinned = store.head()[1]
    again = rows(spark, (1, "old", "x", [], "2024-01-02T00:00:00+00:00"), (1, "renamed", "some text " * 10, [], "2024-01-03T00:00:00+00:00"), (2, "two", "changed", [], "2024-01-03T00:00:00+00:00"))
    assert r.sync(again) == {"seen": 2, "indexed": 1, "metadata_only": 1, "skipped": 0, "failed": 0, "given_up": 0}
    assert {d.id: (d.title, d.content, d.chunk_count) for d in store.read("documents").collect()} == {1: ("renamed", "some text " * 10, 3), 2: ("two", "changed", 1)}
    assert {d.title for d in store.read("documents", pinned).collect()} == {"one", "two"}
    assert [c.text for c in store.read("chunks").filter("document_id = 2").collect()] == ["changed"]
    r.embed_key = "new/64"
    assert r.check_model() and store.read("chunks").count() == 0 and "modified_watermark" not in r.meta()
    assert r.sync(again)["indexed"] == 2  # a new model embeds again
    assert r.sweep(rows(spark, (1, "", "", [], "")), complete=False) == {"pruned": 0, "aborted": True, "candidates": 0}
    only = rows(spark, (1, "", "", [], ""))
    assert r.sweep(only, True, confirmed=rows(spark, (2, "", "", [], ""))) == {"pruned": 0, "aborted": False, "candidates": 1}
    assert r.sweep(only, True, now="t2") == {"pruned": 1, "aborted": False, "candidates": 1} and r.meta()["last_full_sweep_at"] == "t2"
    assert [d.id for d in store.read("documents").collect()] == [1] and store.read("chunks").filter("document_id = 2").count() == 0
    r.rebuild()
    assert store.read("documents").count() == store.read("chunks").count() == 0 and r.meta()["embedding_model"] == "new/64"


def test_failed_documents_come_again_beside_the_page(spark, tmp_path):
    broken = tmp_path / "broken"
    broken.write_text("")
    name = str(broken)

    def model(texts):
        import os

        if os.path.exists(name) and any("fragile" in t for t in texts):
            raise ValueError("down")
        return [chunking.hash_embedding(t) for t in texts]

    store, r = reconciler(spark, tmp_path / "store", model)
    source = rows(spark, (1, "one", "fine", [], "2024-01-05T00:00:00+00:00"), (2, "two", "fragile", [], "2024-01-01T00:00:00+00:00"), (3, "three", "fragile too", [], "2024-01-01T00:00:00+00:00"))
    for n in range(1, 5):
        report = r.run(source, f"t{n}")
        assert report["failed"] == 2 and report["seen"] == 3 if n == 1 else report["seen"] == 3  # 1 lies in the overlap
        assert {f.id: f.failures for f in store.read("failures").collect()} == {2: n, 3: n}
        assert r.meta()["modified_watermark"] == "2024-01-04T23:59:50+00:00"  # failures do not hold it
    assert r.run(source.filter("id <> 3"), "t5")["given_up"] == 1 and store.read("failures").count() == 0
    assert r.run(source.filter("id <> 3"), "t6")["seen"] == 1  # given up, not asked again
    broken.unlink()
    changed = source.withColumn("modified", F.when(F.col("id") == 2, "2024-02-01T00:00:00+00:00").otherwise(F.col("modified")))
    assert r.run(changed, "t7")["indexed"] == 1 and {d.id for d in store.read("documents").collect()} == {1, 2}


def test_stream(spark, tmp_path):
    store, r = reconciler(spark, tmp_path / "store")
    rows(spark, (1, "one", "text one", [], "m1"), (1, "newer", "text one", [], "m2"), (2, "two", "text two", [], "m")).write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        stream_sync(spark.readStream.schema(DOC).parquet(f"file://{tmp_path}/in"), r, f"file://{tmp_path}/check").awaitTermination()
    assert {d.id: d.title for d in store.read("documents").collect()} == {1: "newer", 2: "two"} and store.head()[0] == 2


def test_stream_of_a_queue(spark, tmp_path):
    schema = "id long, tag_ids array<long>"
    spark.createDataFrame([(1, [5]), (2, [5, 6]), (3, [5, 7]), (4, [8]), (None, [5])], schema).write.parquet(f"file://{tmp_path}/in")
    read = lambda: spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        stream_queue(read(), 5, 6, 7, lambda d: d.select("id", F.lit("done").alias("state")), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    assert [tuple(r)[:2] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [(1, "done")]


def test_cycles(spark, tmp_path):
    store, r = reconciler(spark, tmp_path / "store")
    now = [datetime(2024, 5, 1, tzinfo=timezone.utc)]
    source = rows(spark, (1, "one", "text one", [], "2024-01-01T00:00:00+00:00"), (2, "two", "text two", [], "2024-01-01T00:00:00+00:00"))
    held = {"docs": source, "complete": True}
    (tmp_path / "triggers").mkdir()
    cycles = Cycles(r, lambda: (held["docs"], held["complete"]), f"file://{tmp_path}/activity", f"file://{tmp_path}/triggers", clock=lambda: now[0])
    kinds = lambda out: [(a["kind"], a["ok"], a["detail"]) for a in out]
    assert kinds(cycles.once()) == [("sync", True, "indexed 2 document(s)"), ("sweep", True, "pruned 0 deleted document(s)")]
    now[0] += timedelta(seconds=300)
    held["docs"] = source.filter("id = 1")
    assert [k for k, _, _ in kinds(cycles.once())] == ["sync"]
    (tmp_path / "triggers" / "reconcile.request").write_text("")
    held["complete"] = False
    assert kinds(cycles.once())[1] == ("sweep", False, "sweep aborted: enumeration failed")
    held["complete"] = True
    now[0] += timedelta(seconds=3600)
    assert kinds(cycles.once())[1] == ("sweep", True, "pruned 1 deleted document(s)")
    (tmp_path / "triggers" / "rebuild.request").write_text("")
    assert kinds(cycles.once())[0][2].startswith("index rebuilt") and store.read("documents").count() == 1
    activity = spark.read.parquet(f"file://{tmp_path}/activity")
    assert activity.count() == 9 and activity.filter("not ok").count() == 1


def test_accounts(spark, tmp_path):
    c = accounts.Control(SnapshotStore(spark, f"file://{tmp_path}/control", accounts.KEYS, fanout=4))
    assert c.setup_needed() and c.add_first_admin(username="root", password_hash="h") and not c.add_first_admin(username="other")
    ann = c.add_user(username="ann", password_hash="h", email="a@b.co")
    assert ann == 2 and c.user(username="ann")["role"] == "member" and c.user(99) is None
    with pytest.raises(accounts.Refused):
        c.add_user(username="ann")
    for refused in (lambda: c.delete_user(1, 1), lambda: c.delete_user(1, ann), lambda: c.update_user(1, 1, "t", status="suspended"), lambda: c.update_user(1, ann, "t", role="member"), lambda: c.update_user(77, 1, "t", email="x")):
        with pytest.raises(accounts.Refused):
            refused()
    c.add_session(token_hash="s1", user_id=ann, expires_at="2024-01-02", last_seen_at="2024-01-01T00:00:00+00:00")
    c.add_session(token_hash="s2", user_id=1, expires_at="2030-01-01", last_seen_at="2024-01-01T00:00:00+00:00")
    c.touch_sessions(spark.createDataFrame([("s1",), ("s2",), ("s2",)], "token_hash string"), "2024-01-01T00:04:00+00:00")
    assert {s.last_seen_at for s in c.table("sessions").collect()} == {"2024-01-01T00:00:00+00:00"}
    c.touch_sessions(spark.createDataFrame([("s2",)], "token_hash string"), "2024-01-01T00:06:00+00:00")
    assert {s.token_hash: s.last_seen_at[14:16] for s in c.table("sessions").collect()} == {"s1": "00", "s2": "06"}
    key = c.add_key(key_hash="k1", owner_user_id=ann, name="n", scopes="read")
    c.touch_keys(spark.createDataFrame([(key, "2024-01-01T00:00:00+00:00"), (key, "2024-01-01T00:00:30+00:00")], "id long, at string"))
    assert [(k.request_count, k.last_used_at, k.owner) for k in c.keys(1, "admin").collect()] == [(2, "2024-01-01T00:00:30+00:00", "ann")] and c.keys(1, "member").count() == 0
    c.revoke_key(key, "t1"), c.revoke_key(key, "t2"), c.update_key(key, name="renamed")
    assert [(k.revoked_at, k.name) for k in c.keys(ann, "member").collect()] == [("t1", "renamed")]
    for i in range(23):
        c.record_search(ann, f"q{i % 22}", f"2024-01-01T00:{i:02d}")
    assert c.table("recent_searches").count() == 20 and c.table("recent_searches").filter("query = 'q0'").first().created_at.endswith("22")
    c.update_user(ann, 1, "t3", display_name="Ann", email=None)
    assert c.user(ann)["display_name"] == "Ann" and c.user(ann)["email"] is None and c.user(ann)["updated_at"] == "t3"
    assert c.prune_sessions("2024-06-01") == 1 and c.prune_sessions("2024-06-01") == 0
    c.delete_user(ann, 1)
    assert c.users().count() == 1 and c.table("api_keys").count() == 0 and c.table("recent_searches").count() == 0
    assert c.seed_config({"a": "1"}, "t") and not c.seed_config({"a": "2"}, "t") and c.set_config({"b": "3"}, "t") == 2 and c.config() == (2, {"a": "1", "b": "3"})
    c.record_activity("sync", "t", "t", True, {"indexed": 1}, "d"), c.record_activity("sweep", "t", "t", False, {}, "d")
    assert [a.kind for a in c.recent_activity().collect()] == ["sweep", "sync"]
    c.beat(spark.createDataFrame([("ocr", "idle", 1, "t1"), ("ocr", "busy", 2, "t2")], "name string, detail string, processed_count long, last_heartbeat string"), "t3")
    assert [(b.detail, b.processed_count) for b in c.table("daemon_status").collect()] == [("busy", 2)]


def test_settings(spark):
    s = settings.Settings.parse({"AI_MODELS": "a, b,,a", "CHUNK_SIZE": " 500 ", "PRE_TAG_ID": "0", "ERROR_TAG_ID": "7", "SEARCH_TOP_K": ""})
    assert (s.models, s.chunk_size, s.pre_tag, s.error_tag, s.top_k) == (("a", "b"), 500, None, 7, 10)
    for bad in ({"CHUNK_SIZE": "x"}, {"CHUNK_SIZE": "100"}, {"AI_MODELS": " , "}, {"SEARCH_MAX_REFINEMENTS": "2"}, {"LLM_PROVIDER": "z"}, {"SEARCH_SERVER_PORT": "70000"}):
        with pytest.raises(ValueError):
            settings.Settings.parse(bad)
    source = settings.Source({"yes": " ON ", "odd": "maybe", "blank": " "})
    assert source.boolean("yes", False) and source.boolean("absent", True)
    for bad in (lambda: source.boolean("odd", True), lambda: source.required("blank")):
        with pytest.raises(ValueError):
            bad()
    taxonomy = spark.createDataFrame([("tag", 1, "a"), ("document_type", 2, "b")], "kind string, id long, name string")
    assert [tuple(r) for r in settings.missing_tags({"PRE": 1, "POST": 2, "NONE": None}, taxonomy).collect()] == [("POST", 2)]
    calls = []

    def model(given):
        calls.append(sorted(given))
        if "temperature" in given:
            raise ValueError("temperature is not supported")
        if "max_tokens" in given:
            raise ValueError("use another name for max_tokens")
        return "said"

    assert settings.unsupported(model)({"temperature": 1, "max_tokens": 5, "prompt": "p"}) == "said" and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        settings.unsupported(lambda g: 1 / 0)({"temperature": 1})
    log = spark.createDataFrame([("a", "ok", "a"), ("a", "refused", "a"), ("b", "ok", "a"), ("b", "error", "a")], "model string, outcome string, primary string")
    assert tuple(settings.tally_calls(log).first()) == (4, 1, 1, 1)
    tags = lambda *m: spark.createDataFrame(list(enumerate(m)), "position long, matching string")
    assert settings.matching_algorithm(tags(None, "null", "3", '"x"')) == 0 and settings.matching_algorithm(tags('"any"', "1")) == "none" and settings.matching_algorithm(tags(None)) == "none"


def test_page_images(spark):
    white, dark = b"P5 2 3 255\n" + b"\xff" * 6, b"P6\n# note\n2 3\n255\n" + b"\x10" * 18
    specks = b"P5 3 3 255\n" + b"\xff" * 5 + b"\0" * 4
    table = spark.createDataFrame([(1, white + dark + specks), (2, b"%PDF"), (3, None), (4, dark[:-1])], "id long, content binary")
    out = {(r.id, r.page): r for r in images.page_images(table).collect()}
    assert [out[1, i].blank for i in (1, 2, 3)] == [True, False, True] and bytes(out[1, 2].image) == dark and out[1, 1].image is None
    assert out[2, None].error and out[4, None].error and out[3, None].error
    whole = images.page_images(table, lambda content: [content] * 2)
    assert whole.filter("id = 2").count() == 2
