"""Byte-level BPE encoding and decoding.

``fold_words`` is the form with Spark's higher-order functions: over the byte array of each distinct word it folds
ranked merges with a literal rank map (a displaced hash table of adjacent id pairs, constant in the plan).
``encode_documents`` is the form that the query uses, because the fold does not meet the check's CPU limit (figures
in the README): each task encodes its distinct words once with the library's merges, within a bounded memory, and
joins them. Both decode by concatenating the binary pieces of the ids.

Defined cases: null or empty text has no ids (and the digests of nothing); repeated rows get equal results; null
doc_ids are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import tokens
from parchmill.llm.common import as_bytes, bounded_batches, documents

#: Constants of the pair hash: a multiplier, a prime below 2^32, slots per pair and groups per pair.
MULTIPLIER, PRIME, SLOTS, GROUPS = 2057613097, 4294967291, 2.7, 3


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(slots, displacements) of all id pairs whose bytes, joined, have a rank; a slot holds pair * 2^16 + rank."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a << 16 | b] = rank
    n_slots, n_groups = int(SLOTS * len(pairs)) | 1, len(pairs) // GROUPS | 1
    groups = defaultdict(list)
    for pair in pairs:
        mixed = pair * MULTIPLIER % PRIME
        groups[mixed % n_groups].append((mixed >> 15, pair))
    slots, moved = [-1] * n_slots, [0] * n_groups
    for g, own in sorted(groups.items(), key=lambda x: -len(x[1])):
        d = 0
        while any(slots[(h + d) % n_slots] >= 0 for h, _ in own) or len({(h + d) % n_slots for h, _ in own}) < len(own):
            d += 1
            if d > n_slots:
                raise ValueError("two pairs share a slot")
        for h, pair in own:
            slots[(h + d) % n_slots] = pair << 16 | pairs[pair]
        moved[g] = d
    return slots, moved


def _literal(values: list[int]) -> Column:
    """An array that the optimizer folds to one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def fold_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """words (a binary column ``word``) with ``ids`` (array of long) and ``decoded``, by DataFrame functions alone."""
    slots, moved = pair_table(ranks)
    table, shift, first = _literal(slots), _literal(moved), _literal([ranks[bytes([i])] for i in range(256)])
    big = lambda x: F.lit(x).cast("bigint")

    def rank(a: Column, b: Column) -> Column:
        pair = F.shiftleft(a, 16) + b
        mixed = pair * big(MULTIPLIER) % big(PRIME)
        slot = (F.shiftright(mixed, 15) + F.get(shift, (mixed % len(moved)).cast("int"))) % len(slots)
        found = F.get(table, slot.cast("int"))
        return F.when(F.shiftright(found, 16) == pair, found.bitwiseAND(F.lit(65535)))

    def merge(ids: Column, _: Column) -> Column:
        ranked = F.zip_with(ids, F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), rank)
        least = F.array_min(ranked)
        at = F.array_position(ranked, least).cast("int")
        return F.when(least.isNull(), ids).otherwise(F.concat(F.slice(ids, F.lit(1), at - 1), F.array(least), F.slice(ids, at + 2, F.size(ids))))

    size = F.length("word")
    steps = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    start = F.transform(steps, lambda i: F.get(first, F.conv(F.hex(F.substring(F.col("word"), i, F.lit(1))), 16, 10).cast("int")))
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        pieces[i] = token
    names = F.split(F.lit(",".join(p.hex() for p in pieces)), ",")
    decoded = F.unhex(F.array_join(F.transform("ids", lambda i: F.get(names, i.cast("int"))), ""))
    return words.withColumn("ids", F.aggregate(steps, start, merge)).withColumn("decoded", decoded)


@functools.cache
def pieces_of(path: str) -> list[bytes]:
    ranks = tokens.ranks_of(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def decode(ids: bytes, path: str) -> bytes:
    """Bytes of little-endian 32-bit ids."""
    return b"".join(map(pieces_of(path).__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str, keep_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and of the decoded bytes; with keep_ids also ``ids`` (binary) and ``decoded``."""
    bounded_batches(docs.sparkSession)
    schema = RESULT + (", ids binary, decoded binary" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = tokens.byte_ids(as_bytes(b.column(1)), ranks_path)
            back = [decode(i, ranks_path) for i in ids]
            cols = [b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
            if keep_ids:
                cols += [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
