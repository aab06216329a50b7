"""Near copies of the pipeline's stage against brute force over five-word shingles."""

import random

import pytest

from parchmill.llm import near_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def copy_of(rng, words, changes):
    out = list(words)
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"new{rng.random()}"
    return out


def expected(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similarity(sets[i], sets[j]) >= 0.8:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return sorted(rows[g][0] for g in set(group))


def test_stage_finds_near_copies(spark):
    rng = random.Random(3)
    rows = []
    for size, changes in [(300, 3), (300, 6), (100, 1), (1000, 10), (200, 12), (300, 9)] * 6:
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy_of(rng, words, changes)))]
    words = [f"c{rng.randrange(5000)}" for _ in range(400)]
    for _ in range(30):  # a chain whose ends are not alike
        rows.append((len(rows), " ".join(words)))
        words = copy_of(rng, words, 3)
    base = [f"d{rng.randrange(5000)}" for _ in range(300)]
    for _ in range(40):  # one dense group, some pairs of which are below the similarity
        rows.append((len(rows), " ".join(copy_of(rng, base, rng.randint(1, 12)))))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one two", "ONE  two", "a b c d e", "a b c d f"])]
    table = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_dedup(spark, table, "")
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == expected(rows)
    assert near_copies.first_of_each(table.limit(0)).count() == 0


def test_recall_of_candidates():
    rng = random.Random(5)
    pairs = found = 0
    while pairs < 300:
        words = [f"w{rng.randrange(9000)}" for _ in range(200)]
        a, b = (near_copies.shingles(" ".join(w).encode()) for w in (words, copy_of(rng, words, 4)))
        shared = len(set(a.tolist()) & set(b.tolist()))
        if 0.8 <= shared / (len(a) + len(b) - shared) < 0.85:
            assert near_copies.alike(a.tobytes(), b.tobytes())
            pairs, found = pairs + 1, found + bool((near_copies.bands(a) == near_copies.bands(b)).any())
    assert found >= 299


def test_links_join_what_pairs_join():
    import numpy as np

    for seed in range(12):
        rng = random.Random(seed)
        texts = []
        for _ in range(4):
            words = [f"d{rng.randrange(5000)}" for _ in range(120)]
            texts += [" ".join(copy_of(rng, words, rng.randint(0, 6))) for _ in range(25)]
        sets = [near_copies.shingles(t.encode()) for t in texts]
        fp = np.arange(len(sets))

        def labels(links):
            label = fp.tolist()
            for a, b in links:
                label = [label[a] if x == label[b] else x for x in label]
            return [[i for i in fp if label[i] == x] for x in label]

        pairs = [(i, j) for i in fp for j in range(i) if near_copies.alike(sets[i].tobytes(), sets[j].tobytes())]
        assert labels(near_copies.joining_links(fp, fp, sets)) == labels(pairs)


@pytest.mark.parametrize("most", [0, 99])
def test_groups_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(near_copies, "MOST_BLOCKS", most)
    rng = random.Random(8)
    words = [f"d{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(copy_of(rng, words, rng.randint(1, 14)))) for i in range(60)]
    kept = near_copies.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert sorted(r.doc_id for r in kept.collect()) == expected(rows)


def test_texts_of_the_largest_component_travel_once(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 1000)
    rows = [(0, 1, i, 10, 0) for i in range(5000)] + [(0, 1, 9000 + i, 10, 9000 + i % 3) for i in range(30)] + [(0, 2, 7, 10, 7), (0, 2, 8, 10, 8)]
    out = near_copies.dealt_blocks(spark.createDataFrame(rows, "__pm_kind int, __pm_key long, __pm_fp long, __pm_n long, __pm_root long")).collect()
    by = {}
    for r in out:
        by.setdefault((r["__pm_key"], r["__pm_fp"]), set()).add((r["__pm_i"], r["__pm_j"]))
    assert len(out) == sum(map(len, by.values())) and all(len(by[1, i]) == 1 for i in range(5000)) and all(len(by[1, 9000 + i]) == 51 for i in range(30))
    assert all(by[1, 9000 + i] & by[1, j] for i in range(30) for j in [*range(0, 5000, 97), *range(9000, 9030)]) and by[2, 7] & by[2, 8]


def test_tree_finds_close_fingerprints(spark):
    """SimHash and its vantage-point tree are a step of the stage: they pair texts by fingerprint alone, without bands."""
    rng = random.Random(4)
    words = [[f"t{rng.randrange(9000)}" for _ in range(1200)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, " ".join(copy_of(rng, w, 1))) for i, w in enumerate(words)]
    points = near_copies.points(spark.createDataFrame(rows, "doc_id long, text string")).drop("__pm_bands").localCheckpoint()
    of = {r["__pm_fp"]: (r.doc_id, r["__pm_sim"] & (1 << 64) - 1) for r in points.collect()}
    pairs = {tuple(sorted((of[r["__pm_a"]][0], of[r["__pm_b"]][0]))) for r in near_copies.tree_pairs(points).collect()}
    sims = {i: s for i, s in of.values()}
    close = {(i, j) for i in sims for j in sims if i < j and (sims[i] ^ sims[j]).bit_count() <= near_copies.RADIUS}
    assert pairs == close and len(pairs) > 10 and all(j == i + 100 for i, j in pairs)
