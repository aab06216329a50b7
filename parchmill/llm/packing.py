"""Packing by minimum bin slack.

Each task tokenises its own rows and packs them in blocks of bounded size, so nothing is shuffled and no group grows
with the input. Of each document, whole windows of 4096 ids become sequences of their own; the rest of it joins a
multiset of remaining lengths. For each window a bitset subset-sum dynamic program over that multiset (a Python
integer whose bit s says that s can be reached) finds the fill closest to the capacity, and walking back through the
states gives the counts taken of each length. Slack that is left is filled with a cut of another document. What
remains at a block's end moves to the next block; at the end of a task it is cut at powers of two, which need no
padding.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as documents of their own; null
doc_ids are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import tokens
from parchmill.llm.common import as_bytes, bounded_batches, documents

CAPACITY, END = 4096, 2
#: Tokens gathered before a block is packed.
BLOCK_TOKENS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many to take of each length so that their sum is as close to capacity as can be, without going over it."""
    mask = (1 << (capacity + 1)) - 1
    reach, states = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            new = (reach | reach << length) & mask
            if new == reach:
                break
            states.append((length, reach))
            reach = new
            if reach >> capacity:
                break
        if reach >> capacity:
            break
    left, taken = reach.bit_length() - 1, defaultdict(int)
    for length, before in reversed(states):
        if not before >> left & 1:
            taken[length] += 1
            left -= length
    return dict(taken)


class Packer:
    """Pieces of sequences from documents added one after the other; memory is bounded by a block."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, first_sequence
        self.rest: dict[int, list[tuple]] = defaultdict(list)  # by length: (doc_id, ids, start)
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        while n - start >= self.capacity:
            self._sequence([(doc_id, ids, start, self.capacity)])
            start += self.capacity
        if n > start:
            self.rest[n - start].append((doc_id, ids, start))
            self.held += n - start

    def _sequence(self, parts: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, length in parts:
            self.out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, self.next, offset))
            offset += length
        self.next += 1

    def _take(self, length: int) -> tuple:
        item = self.rest[length].pop()
        if not self.rest[length]:
            del self.rest[length]
        self.held -= length
        return (*item, length)

    def pack(self) -> None:
        """Fill windows while the remaining lengths last for a whole one."""
        while self.held >= self.capacity:
            parts = [self._take(x) for x, n in best_fill({k: len(v) for k, v in self.rest.items()}, self.capacity).items() for _ in range(n)]
            slack = self.capacity - sum(p[3] for p in parts)
            if slack:  # the others are longer than the slack
                doc_id, ids, start, length = self._take(max(self.rest))
                parts.append((doc_id, ids, start, slack))
                self.rest[length - slack].append((doc_id, ids, start + slack))
                self.held += length - slack
            self._sequence(parts)

    def finish(self) -> None:
        """Cut what is left at powers of two."""
        self.pack()
        items = [self._take(x) for x in sorted(self.rest, reverse=True) for _ in range(len(self.rest[x]))]
        left = sum(i[3] for i in items)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            parts = []
            while room:
                doc_id, ids, start, length = items.pop(0)
                use = min(room, length)
                parts.append((doc_id, ids, start, use))
                if use < length:
                    items.insert(0, (doc_id, ids, start + use, length - use))
                room -= use
            self._sequence(parts)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece; sequence_id holds the task's number in its upper bits."""
    bounded_batches(docs.sparkSession)
    kinds = [pa.int64()] * 7
    names = [x.split()[0] for x in PIECES.split(", ")]

    def rows(packer: Packer) -> pa.RecordBatch:
        out, packer.out = packer.out, []
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, end = Packer(TaskContext.get().partitionId() << 40, capacity), np.array([END], dtype="<u4").tobytes()
        for b in batches:
            at, ids = 0, b.column(0).to_pylist()
            for group in tokens.groups(as_bytes(b.column(1))):
                for doc, own in zip(ids[at:], tokens.word_ids(group, vocabulary)):
                    packer.add(doc, own + end)
                at += len(group)
                if packer.held >= BLOCK_TOKENS:
                    packer.pack()
                yield rows(packer)
        packer.finish()
        yield rows(packer)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary())
