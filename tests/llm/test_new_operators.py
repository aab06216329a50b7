"""Spelling variants, whitening and chat formatting against brute force; nulls, empty tables, ties, repeated rows, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchmill.llm import chat, spelling, whitening

DOCS = "doc_id long, text string, n long, word string, __pm_next string"


def brute_variants(rows):
    """The contract of the spelling query, word by word."""
    total = Counter()
    for doc, text in rows:
        word = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                word += c.lower() if c < "[" else c
            elif word:
                h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
                total[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
                word = ""
    known = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    letters = sorted({c for w in known for c in w})

    def near(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        found = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
        return sorted((found & known.keys()) - {w}, key=lambda x: (-known[x], x))

    nears = {w: near(w) for w in known}
    form = {w: x[0] if x and known[x[0]] >= 2 * known[w] else None for w, x in nears.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(nears[w]), known.get(form[w])) for w, n in known.items()}


def test_spelling_variants(spark, monkeypatch):
    rng = random.Random(5)
    stems = ["aaaaa", "aaaab", "ababab", "ababa", "Straße", "naïveté", "ÿÿÿÿÿÿ", "letter", "letters", "lettter"] + ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(stems) if rng.random() < 0.5 else "".join(rng.choice("ab") for _ in range(rng.randint(4, 7))) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    long = "ab" * 4000
    rows += [(None, None), (None, "aaaaa 1aaaaa,aaaaa"), (1, ""), (1, " \t\n"), (2, "aaaaa\x85aaaaa中aaaaa😀"), (3, f"{long} {long} {long} {long}c {long}c {long}c"), (4, rows[0][1]), (4, rows[0][1])]
    table = spark.createDataFrame([(i, t, 7, "clash", "clash") for i, t in rows], DOCS)
    want = brute_variants(rows)
    assert len(want) > 100
    assert {tuple(r) for r in spelling.variants(table).collect()} == want
    monkeypatch.setattr(spelling, "SHARD", 7)
    monkeypatch.setattr(spelling, "HELD", 5)
    words = spelling.vocabulary(table)
    tries = spelling.shards(words)
    assert tries.count() >= len(want) / 7 and sum(len(g) for g in spelling.rounds(tries, 4000)) == tries.count() and len(list(spelling.rounds(tries, 4000))) > 2
    monkeypatch.setattr(spelling, "rounds", lambda t, rounds=spelling.rounds: rounds(t, 4000))
    assert {tuple(r) for r in spelling.variants(table).collect()} == want
    assert spelling.variants(table.limit(0)).count() == 0


def test_roots_follow_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"x{i}", "w0") for i in range(50)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w37"} and spelling.roots(forms).count() == 87
    assert spelling.roots(forms.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, n long, deviation string"


def checked_whitening(spark, rows, width):
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, 0, "clash") for i, v in rows], VECTORS)).collect()
    valid = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v is not None and len(v) == width and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in valid]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    assert sorted(((r.vec_id, r.deviation) for r in got), key=repr) == sorted(((i, d if d < 1 << 63 else None) for (i, _), d in zip(valid, deviation)), key=repr)
    z = np.array([[(n * c - t) / n for c, t in zip(r, s)] for r in x])
    e, v = np.linalg.eigh(z.T @ z / n)
    return got, valid, z, e[::-1], v[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + rng.normal(size=12) * 50
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)] + [(5, [float(c) for c in mixed[5]])]
    rows += [(None, [1.0] * 12), (900, None), (901, []), (902, [None] + [0.0] * 11), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0, 2.0]), (906, [0.0] * 11 + [3.0e38])]
    got, valid, z, e, v = checked_whitening(spark, rows[:-1], 12)
    assert len(got) == 302 and {r.n for r in got} == {302} and {r.identity_error < 1e-9 for r in got} == {True}
    white = {}
    for r in got:
        white.setdefault(r.vec_id, r.whitened)
    mine, own = np.array([white[i] for i, _ in valid]), z @ v[:, :8] / np.sqrt(e[:8])
    assert np.allclose(mine * np.sign((mine * own).sum(axis=0)), own, rtol=1e-8, atol=1e-8)
    assert np.allclose(got[0].explained, e[:8] / e.sum(), rtol=1e-9)
    assert whitening.whiten(spark.createDataFrame([(i, x, 1, 0, "") for i, x in rows], VECTORS)).count() == 302  # 3e38 has no long
    assert whitening.whiten(spark.createDataFrame(rows[-6:-2], "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_large_and_flat_vectors(spark):
    got, *_ = checked_whitening(spark, [(i, [2.0e14 * (i % 7), 1.0, -3.0e9 * i]) for i in range(40)], 3)  # deviations beyond a long are null
    assert got[0].whitened[2] is None and got[0].explained[2] == 0 and got[0].identity_error < 1e-4
    got, *_ = checked_whitening(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], 2)
    assert [r.whitened for r in got] == [[None, None]] * 2 and got[0].identity_error == 0
    got, *_ = checked_whitening(spark, [(1, [1.0, 2.0])], 2)
    assert len(got) == 1


def test_residues_and_deviations_are_exact():
    rng = np.random.default_rng(9)
    w = rng.integers(-(1 << 40), 1 << 40, (50, 4))
    exact = w.T.astype(object) @ w.astype(object)
    moduli = whitening.primes(2 * 50 * (1 << 80))
    assert np.prod([int(p) for p in moduli], dtype=object) > 2 * 50 * (1 << 80) and all(p < whitening.PRIME for p in moduli)
    assert (whitening.remaindered({p: (exact % p).astype(np.int64) for p in moduli}) == exact).all()
    x = np.array([[3037000499, 0], [3037000500, 0], [1 << 40, 5], [-7, 2]])
    assert whitening.deviations(x, 1, np.array([0, 0], dtype=object)) == [3037000499**2, None, None, 53]  # 2^63 lies between the first two


def part(kind=None, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


TURNS = f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string, at string, out string"


def test_chat_parts(spark):
    t = chat.Template()
    rows = [
        (1, 1, "assistant", [part("text", "a chart: "), part("image", None, "x.png", 57, 28), part(None, " and <|image|> \\<|image|>"), None]),
        (1, 0, "user", [part("audio", None, "a.wav", seconds=2.01), part("document", None, "d.pdf", pages=3), part("text", "€ 😀 what?")]),
        (1, 2, "assistant", [part("video", None, "v"), part("image"), part("audio", seconds=float("nan")), part("document", pages=-1)]),
        (2, None, None, None), (2, 5, "us<|im_sep|>er", []), (None, 0, "user", [part("text", "no id")]),
        (3, 0, "assistant", [part("text", "twice")]), (3, 0, "assistant", [part("text", "twice")]), (4, 0, "user", [part("text", "x" * 300_000 + "</s>" * 1000)]),
    ]
    table = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], TURNS)
    out = chat.format_conversations(table)
    got = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("trained")).collect()}
    assert len(got) == 5 and got[None].formatted == "<|im_start|>user<|im_sep|>no id<|im_end|>"
    one = got[1]
    assert one.trained == "a chart:  and <|image|> \\<|image|>"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "audio", "a.wav", 51), (0, "document", "d.pdf", 3072), (1, "image", "x.png", 3), (2, "video", "v", 1), (2, "image", None, 1), (2, "audio", None, 1), (2, "document", None, 1024)]
    assert one.placeholder_tokens == sum(a.tokens for a in one.attachments)
    for a in one.attachments:
        assert one.formatted[a.start :].startswith(t.placeholders.get(a.kind, t.other))
    for s in one.loss:
        cut = one.formatted[s.start : s.start + s.chars]
        assert cut.encode() == one.formatted.encode()[s.start_byte : s.start_byte + s.bytes]
    assert [x.text for x in one.turns] == ["<|audio|><|document|>€ 😀 what?", "a chart: <|image|> and <|image|> \\<|image|>", "<|attachment|><|image|><|audio|><|document|>"]
    assert [(x.role, x.text) for x in got[2].turns] == [("us<|im_sep|>er", ""), ("", "")]
    assert got[3].trained == "twicetwice" and [(x.role, x.text) for x in got[4].turns] == [("user", rows[-1][3][0][1])]
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    t, rng = chat.Template(), random.Random(11)
    atoms = [*t.controls, *(c[1:] for c in t.controls), *t.leads, "\\", "\\\\", " ", "é", "\n", "$1"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    out = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.escape(F.col("x")).alias("e")).select("x", "e", t.unescape(F.col("e")).alias("u")).collect()
    assert all(r.x == r.u for r in out) and not any(c in r.e for r in out for c in t.controls)
    with pytest.raises(ValueError):
        chat.Template(head="<<SYS>>")


def test_chat_query_reads_back(spark, tmp_path):
    rows = [(9, 1, "assistant", "b"), (9, 0, "user", None), (9, 2, "assistant", "[INST]é"), (None, 0, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (got[9].n_turns, got[9].turns_sha256, got[9].loss_chars, got[9].loss_sha256) == (3, sha("user\n\nassistant\nb\nassistant\n[INST]é\n"), 8, sha("b[INST]é"))
    assert (got[-1].n_turns, got[-1].turns_sha256, got[-1].loss_sha256) == (2, sha(f"user\n{chat.CONTROL}\nassistant\n{chat.CONTROL}\n"), sha(chat.CONTROL))
    assert got[None].loss_chars == 0 and len(got) == 3
    plan = chat.query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_integers_of_a_sliced_column():
    column = pa.array([[1.0], None, [None], [0.5, -0.5], [float("nan")], []], pa.list_(pa.float64())).slice(1)
    valid, size, x = whitening.integers(column)
    assert valid.tolist() == [False, False, True, False, False] and size.tolist() == [0, 1, 2, 1, 0] and x.tolist() == [100512, 99488]
