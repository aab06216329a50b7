"""Spelling variants: near words by Levenshtein automata over broadcast trie shards.

Words are counted in the tasks that read them and once more by word. Shards of the sorted vocabulary become compact
tries (edge arrays) in the tasks that hold them. Rounds of shards, ``ROUND`` bytes at most each, are broadcast; every
word's distance-one automaton is intersected with every shard of the round, a branch at a time: the exact path down the
trie, and at each of its nodes the states after one edit, which are followed to their ends before the path goes on. A
task reduces what it accepts to a row for each word and round (near words, largest count, its smallest word); rounds
are reduced by word. Roots are found by pointer doubling over the forms.

The alphabet is that of ``RUN``, so a word is Latin-1 bytes inside a task, whose order is that of code points.

Defined cases: null, empty and white texts have no words; a null doc_id is written as nothing before the colon when
occurrences are picked for a deletion; repeated rows count each; words of any length are kept whole; equal counts are
decided by the smaller word; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm.common import as_bytes, bounded_batches, documents, materialise, scratch_dir

#: Fixed by the query's contract: letters of a word, one occurrence in so many is misspelt, least length and count, how many times commoner a form is.
RUN = r"[A-Za-zÀ-ÿ]+"
ONE_IN, LENGTH, COUNT, TIMES = 97, 5, 3, 2
#: By Latin-1 byte: A-Z lowered, the letters of RUN kept, everything else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

#: Words and bytes of a shard, bytes of the shards that are broadcast at once, distinct words that a task counts before it passes them on.
SHARD, SHARD_BYTES, ROUND, HELD = 1 << 16, 4 << 20, 48 << 20, 1 << 18
#: Words and bytes of a block of queries, words of a task.
BLOCK, BLOCK_BYTES, TASK = 1024, 1 << 18, 1 << 13


def runs(text: bytes) -> list[bytes]:
    """The runs of letters, A-Z lowered, as Latin-1 bytes."""
    return text.decode("utf-8", "replace").encode("latin-1", "replace").translate(FOLD).split()


def misspelt(doc_id: int | None, word: bytes) -> bytes:
    """The word as this document has it: one code point is deleted where ONE_IN divides the checksum."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode() + word.decode("latin-1").encode())
    k = h % len(word)
    return word if h % ONE_IN else word[:k] + word[k + 1 :]


def vocabulary(docs: DataFrame, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """word, n: distinct words of at least so many code points and occurrences."""
    bounded_batches(docs.sparkSession)

    def rows(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                for word, n in Counter(runs(text)).items():
                    if len(word) >= length and len(word := misspelt(doc, word)) >= length:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield rows(held)
                    held = {}
        yield rows(held)

    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters with a zero after each word, where each word starts, and its length."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8), np.cumsum(size + 1) - size - 1, size


class Trie:
    """Sorted distinct words as edges (node << 8 | letter) to the nodes 1, 2, ...; a node may end a word."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.letters, self.start, self.size = _flat(words)
        self.counts = np.array(counts, dtype=np.int64)
        node, row, nodes = np.zeros(len(words), dtype=np.int64), np.arange(len(words)), 1
        edges, ends = [], []
        for depth in range(int(self.size.max(initial=0))):
            row = row[self.size[row] > depth]
            key = node[row] << 8 | self.letters[self.start[row] + depth]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            node[row] = nodes - 1 + np.cumsum(new)
            edges.append(key[new])
            nodes += len(edges[-1])
            done = row[self.size[row] == depth + 1]
            ends.append((node[done], done))
        self.edges = np.concatenate([np.zeros(0, dtype=np.int64), *edges])
        self.first = np.searchsorted(self.edges >> 8, np.arange(nodes + 1)).astype(np.int32)
        self.word = np.full(nodes, -1, dtype=np.int32)
        for at, done in ends:
            self.word[at] = done

    def spelling(self, i: int) -> bytes:
        return self.letters[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have an edge with the letter, and where it leads."""
        key = node << 8 | letter
        at = np.searchsorted(self.edges, key)
        there = at < len(self.edges)
        there[there] = self.edges[at[there]] == key[there]
        return there, at[there] + 1

    def near(self, letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all words at distance one of the queries, each pair once.

        Each edit is taken at one place only: an inserted letter differs from the one it stands before, a deleted one
        from the one after it. The zero after a query's end is no letter, so it stops each of these walks.
        """
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        query, node, at = np.arange(len(size)), np.zeros(len(size), dtype=np.int64), start.copy()
        while len(query):
            ends = at == start[query] + size[query]
            low, n = self.first[node], self.first[node + 1] - self.first[node]
            who = np.repeat(np.arange(len(query)), n)
            edge = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            other = (self.edges[edge] & 255) != letters[at[who]]
            who, child = who[other], edge[other] + 1
            replaced = ~ends[who]
            deleted = np.nonzero(~ends)[0]
            deleted = deleted[letters[at[deleted]] != letters[at[deleted] + 1]]
            out += self._follow(
                np.concatenate([query[who], query[who[replaced]], query[deleted]]),
                np.concatenate([child, child[replaced], node[deleted]]),
                np.concatenate([at[who], at[who[replaced]] + 1, at[deleted] + 1]),
                letters, start + size,
            )
            there, to = self.step(node, letters[at])
            query, node, at = query[there], to, at[there] + 1
        return np.concatenate([q for q, _ in out]), np.concatenate([w for _, w in out])

    def _follow(self, query, node, at, letters, stop) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        while len(query):
            done = (at == stop[query]) & (self.word[node] >= 0)
            if done.any():
                out.append((query[done], self.word[node[done]].astype(np.int64)))
            there, to = self.step(node, letters[at])
            query, node, at = query[there], to, at[there] + 1
        return out


SHARDS = "shard binary"


def shards(words: DataFrame) -> DataFrame:
    """Compact tries of the sorted words, bounded in words and bytes (one word may be longer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(held, counts):
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Trie(held, counts))], pa.binary())], names=["shard"])

        held, counts, size = [], [], 0
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(w.encode("latin-1"))
                counts.append(n)
                size += len(held[-1])
                if len(held) >= SHARD or size >= SHARD_BYTES:
                    yield cut(held, counts)
                    held, counts, size = [], [], 0
        if held:
            yield cut(held, counts)

    return words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, SHARDS)


def rounds(tries: DataFrame, most: int = ROUND) -> Iterator[list[bytes]]:
    """The shards in groups of so many bytes at most; no more than one group is in the driver at a time."""
    held, size = [], 0
    for row in tries.toLocalIterator():
        if held and size + len(row.shard) > most:
            yield held
            held, size = [], 0
        held.append(bytes(row.shard))
        size += len(row.shard)
    if held:
        yield held


NEAR = "word string, n_near long, best_n long, best string"


def near_words(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """For each word with near words in these tries: how many there are, the largest count, and the smallest word that has it."""
    sent = words.sparkSession.sparkContext.broadcast(tries)

    def reduced(held: list[bytes], loaded: list[Trie]) -> pa.RecordBatch:
        letters, start, size = _flat(held)
        n, best = np.zeros(len(held), dtype=np.int64), [(0, b"")] * len(held)
        for trie in loaded:
            query, word = trie.near(letters, start, size)
            if not len(query):
                continue
            n += np.bincount(query, minlength=len(held))
            order = np.lexsort((word, -trie.counts[word], query))  # words of a trie are numbered in their order
            lead = order[np.unique(query[order], return_index=True)[1]]
            for q, w in zip(query[lead].tolist(), word[lead].tolist()):
                most, spelt = int(trie.counts[w]), trie.spelling(w)
                if most > best[q][0] or most == best[q][0] and spelt < best[q][1]:
                    best[q] = most, spelt
        hit = np.nonzero(n)[0].tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([held[i].decode("latin-1") for i in hit], pa.string()), pa.array(n[hit]), pa.array([best[i][0] for i in hit], pa.int64()), pa.array([best[i][1].decode("latin-1") for i in hit], pa.string())],
            names=["word", "n_near", "best_n", "best"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, held, size = [pickle.loads(x) for x in sent.value], [], 0
        for b in batches:
            for w in b.column(0).to_pylist():
                held.append(w.encode("latin-1"))
                size += len(held[-1])
                if len(held) >= BLOCK or size >= BLOCK_BYTES:
                    yield reduced(held, loaded)
                    held, size = [], 0
        if held:
            yield reduced(held, loaded)

    return words.select("word").mapInArrow(run, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms from word on; forms has word and form (not null), and each step at least doubles n, so there are no rings."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("__pm_next"))
        new = now.join(ahead, "root", "left").select("word", F.coalesce("__pm_next", "root").alias("root"), F.col("__pm_next").isNotNull().alias("__pm_moved"))
        new = materialise(new, "roots")
        if new.filter("__pm_moved").isEmpty():
            return new.drop("__pm_moved")
        now = new.drop("__pm_moved")


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    spark = docs.sparkSession
    words = materialise(vocabulary(docs), "vocabulary")
    tries = materialise(shards(words), "trie-shards")
    path = scratch_dir(spark, "near-words")
    spark.createDataFrame([], NEAR).write.parquet(path)
    asked = words.repartition(-(-words.count() // TASK) or 1)
    for group in rounds(tries):
        near_words(asked, group).write.mode("append").parquet(path)
    near = spark.read.schema(NEAR).parquet(path).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("best"))
    best_n = -F.col("best.less")
    formed = words.join(near, "word", "left").withColumn("__pm_formed", best_n >= times * F.col("n"))
    formed = formed.select("word", F.expr("CASE WHEN __pm_formed THEN best.best END").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("__pm_formed"), best_n).alias("form_n"))
    formed = materialise(formed, "forms")
    out = formed.join(roots(formed.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
