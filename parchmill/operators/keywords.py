"""Keyword search: segments of block postings, BM25 phrases, upkeep with the chunks.

A segment is written once. A task cuts its chunks into blocks of ``BLOCK`` and writes one row for each term and block
(``POSTINGS``: the chunks' slots, how often and where they hold the term, the largest count and the least length) and one for each block
(``BLOCKS``: chunk ids, owners, lengths). So nothing is shuffled; each task writes its posting rows sorted by term, once, and a
search reads the pages of its terms in each file. Chunks that go are marked dead by block and slot; corpus statistics follow.
``Keywords`` keeps segments and dead slots in a snapshot store, in the same commit as the chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.functions.text import tokens
from parchmill.session import bounded_batches, materialise, scratch_dir
from parchmill.sources.snapshots import SnapshotStore

K1, B = 1.2, 0.75

#: Chunks of a block; below so many blocks all are decoded at once; blocks decoded first to find how good a result must be, for each result asked for.
BLOCK, FEW, SEEDS = 512, 64, 2
#: slots (2 bytes each), counts and at (4 bytes each) are little-endian integers; at is a position, or how far it lies from the one before it in its chunk
POSTINGS = "term string, block long, n int, most int, least int, slots binary, counts binary, at binary"
BLOCKS = "block long, chunk_ids array<long>, document_ids array<long>, lengths array<int>"
#: Rows of a segment's files: postings, and blocks where the term is null.
ROWS = f"{POSTINGS}, {BLOCKS.removeprefix('block long, ')}"
_RAW = pa.schema(
    [("term", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("most", pa.int32()), ("least", pa.int32()), *((c, pa.binary()) for c in ("slots", "counts", "at"))]
    + [(c, pa.list_(pa.int64())) for c in ("chunk_ids", "document_ids")] + [("lengths", pa.list_(pa.int32()))]
)
#: Bits of a block's number for the task and the block within it.
TASK_BITS, COUNT_BITS = 24, 20


def _packed(values: np.ndarray, starts: np.ndarray, kind: str) -> pa.Array:
    """The integers from each start to the next one as a binary value."""
    values = values.astype(kind)
    offsets = np.append(starts, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def _only(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _RAW], schema=_RAW)


def block_rows(block: int, chunk_ids: pa.Array, document_ids: pa.Array, words: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """The row of a block, and one for each of its terms: positions as differences within a chunk."""
    size = np.asarray(words.value_lengths(), dtype=np.int64)
    one = pa.array([0, len(size)], pa.int32())
    yield _only(1, block=pa.array([block]), chunk_ids=pa.ListArray.from_arrays(one, chunk_ids), document_ids=pa.ListArray.from_arrays(one, document_ids), lengths=pa.ListArray.from_arrays(one, pa.array(size, pa.int32())))
    coded = words.flatten().dictionary_encode()
    if not len(coded):
        return
    code, slot = coded.indices.to_numpy(), np.repeat(np.arange(len(size)), size)
    at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(code, kind="stable")  # so chunks and positions ascend within a term
    code, slot, at = code[order], slot[order], at[order]
    new_term = np.append(True, code[1:] != code[:-1])
    new = new_term | np.append(True, slot[1:] != slot[:-1])
    place = np.where(new, at, np.diff(at, prepend=0))
    pair = np.nonzero(new)[0]
    count, held = np.diff(np.append(pair, len(code))), slot[pair]
    term = np.nonzero(new_term)[0]
    first = np.searchsorted(pair, term)
    yield _only(
        len(term), term=coded.dictionary.take(pa.array(code[term])), block=pa.array(np.full(len(term), block)), n=pa.array(np.diff(np.append(first, len(pair)))),
        most=pa.array(np.maximum.reduceat(count, first)), least=pa.array(np.minimum.reduceat(size[held], first)),
        slots=_packed(held, first, "<u2"), counts=_packed(count, first, "<u4"), at=_packed(place, term, "<u4"),
    )


def _rows(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    rows = spark.read.schema(ROWS).parquet(*paths) if paths else spark.createDataFrame([], ROWS)
    return rows.filter(F.col("term").isNull() if schema == BLOCKS else F.col("term").isNotNull()).select(*[x.split()[0] for x in schema.split(", ")])


def _blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _rows(spark, paths, BLOCKS)


@dataclass(frozen=True)
class Segment:
    """A folder of postings and blocks, and what they hold; dead chunks are counted apart."""

    segment: int
    path: str
    chunks: int
    tokens: int
    dead_chunks: int = 0
    dead_tokens: int = 0

    @classmethod
    def write(cls, chunks: DataFrame, path: str, number: int = 0) -> Segment:
        """Tokenise chunks (chunk_id, document_id, text) once; a null text has no tokens."""
        spark = chunks.sparkSession
        bounded_batches(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            block = ((number << TASK_BITS) + TaskContext.get().partitionId()) << COUNT_BITS
            for b in batches:
                for i in range(0, b.num_rows, BLOCK):
                    part = b.slice(i, BLOCK)
                    yield from block_rows(block, *part.columns)
                    block += 1

        cut = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), tokens(F.coalesce("text", F.lit(""))).alias("words"))
        cut.mapInArrow(run, ROWS).sortWithinPartitions("term", "block").write.parquet(path)
        blocks = _blocks(spark, [path])
        total = blocks.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        return cls(number, path, total[0] or 0, total[1] or 0)


DEAD = "block long, slots array<int>"


@dataclass(frozen=True)
class KeywordIndex:
    """Segments, and dead slots by block (null: none are dead)."""

    spark: SparkSession
    segments: tuple[Segment, ...] = ()
    dead: DataFrame | None = None

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None) -> KeywordIndex:
        """An index of one segment."""
        return cls(chunks.sparkSession, (Segment.write(chunks, path or scratch_dir(chunks.sparkSession, "keyword-index")),))

    @property
    def postings(self) -> DataFrame:
        return _rows(self.spark, [s.path for s in self.segments], POSTINGS)

    @property
    def blocks(self) -> DataFrame:
        return _blocks(self.spark, [s.path for s in self.segments])

    @property
    def size(self) -> tuple[int, float]:
        """Live chunks and their mean length."""
        n = sum(s.chunks - s.dead_chunks for s in self.segments)
        return n, sum(s.tokens - s.dead_tokens for s in self.segments) / max(1, n)

    def slots(self, live: bool = True) -> DataFrame:
        """(block, slot, chunk_id, document_id, length) of the live or of all chunks."""
        every = self.blocks.select("block", F.posexplode(F.arrays_zip("chunk_ids", "document_ids", "lengths")).alias("slot", "c")).select("block", "slot", "c.*")
        every = every.toDF("block", "slot", "chunk_id", "document_id", "length")
        return every if self.dead is None or not live else every.join(self.dead.select("block", F.explode("slots").alias("slot")), ["block", "slot"], "left_anti")


MATCHES = "holders array<long>, hits array<struct<chunk_id long, document_id long, length int, f array<long>>>"


def _places(row: dict) -> np.ndarray:
    """slot << 32 | position of a posting row."""
    slots, counts, at = (np.frombuffer(row[c], dtype=t).astype(np.int64) for c, t in (("slots", "<u2"), ("counts", "<u4"), ("at", "<u4")))
    ends = np.cumsum(counts)
    place = np.cumsum(at)
    before = np.concatenate([[0], place[ends[:-1] - 1]])
    return (np.repeat(slots, counts) << 32) | (place - np.repeat(before, counts))


def matches(index: KeywordIndex, phrases: list[list[str]], postings: DataFrame) -> DataFrame:
    """For each block of the postings: how many live chunks hold each phrase, and those that hold all of them, with counts by phrase.

    A phrase of m tokens stands where m postings agree on its start.
    """
    of = postings.groupBy("block").agg(F.collect_list(F.struct("term", "slots", "counts", "at")).alias("rows"))
    of = of.join(index.blocks, "block")
    of = of.withColumn("dead", F.lit(None).cast("array<int>")) if index.dead is None else of.join(index.dead.select("block", F.col("slots").alias("dead")), "block", "left")

    def one(row: dict) -> dict:
        by_term = {r["term"]: _places(r) for r in row["rows"]}
        alive = np.ones(len(row["lengths"]), dtype=bool)
        alive[row["dead"] or []] = False
        found = []
        for p in phrases:
            starts = by_term.get(p[0], np.zeros(0, np.int64))
            for shift, t in enumerate(p[1:], 1):
                starts = np.intersect1d(starts, by_term.get(t, np.zeros(0, np.int64)) - shift, assume_unique=True)
            found.append(np.bincount(starts >> 32, minlength=len(alive)) * alive)
        f = np.stack(found)
        hits = [{"chunk_id": row["chunk_ids"][i], "document_id": row["document_ids"][i], "length": row["lengths"][i], "f": f[:, i].tolist()} for i in np.nonzero(f.all(axis=0))[0].tolist()]
        return {"holders": (f > 0).sum(axis=1).tolist(), "hits": hits}

    hit = pa.struct([("chunk_id", pa.int64()), ("document_id", pa.int64()), ("length", pa.int32()), ("f", pa.list_(pa.int64()))])
    schema = pa.schema([("holders", pa.list_(pa.int64())), ("hits", pa.list_(hit))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 16):
                yield pa.RecordBatch.from_pylist([one(r) for r in b.slice(i, 16).to_pylist()], schema=schema)

    return of.select("block", "rows", "chunk_ids", "document_ids", "lengths", "dead").mapInArrow(run, MATCHES)


def _part(f: Column, length: Column, idf: float, mean: float) -> Column:
    return F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(mean or 1.0)))


def _idf(n: int, holders: int) -> float:
    idf = float(np.log((n - holders + 0.5) / (holders + 0.5)))
    return idf if idf > 0 else 1e-6


def keyword_search(index: KeywordIndex, phrases: list[list[str]], k: int, inside: DataFrame | None = None, report: dict | None = None) -> DataFrame:
    """(chunk_id, document_id, score): the k best chunks that hold all phrases; lower scores are better (minus BM25).

    Corpus statistics cover all live chunks; ``inside`` (document_id) only takes rows away. Where every phrase is one
    token, the posting rows' heads (counts and bounds, no places) give the statistics and each block's best possible
    score; some blocks of the best bounds are decoded, and then those whose bound reaches the k-th score found. A phrase
    of several tokens has to be decoded wherever it may stand, for its statistics. ``report`` gets how many blocks there were and were decoded.
    """
    spark, schema = index.spark, "chunk_id long, document_id long, score double"
    phrases = [p for p in phrases if p]
    if k <= 0 or not phrases or not index.segments:
        return spark.createDataFrame([], schema)
    terms = sorted({t for p in phrases for t in p})
    postings, (n, mean) = index.postings.filter(F.col("term").isin(terms)), index.size

    def scored(found: DataFrame, idf: list[float]) -> DataFrame:
        hits = found.select(F.explode("hits").alias("h")).select("h.*")
        score = F.lit(0.0)
        for i, x in enumerate(idf):
            score = score + _part(F.col("f")[i].cast("double"), F.col("length"), x, mean)
        hits = hits.select("chunk_id", "document_id", (-score).alias("score"))
        hits = hits if inside is None else hits.join(inside.select("document_id").distinct(), "document_id", "left_semi").select("chunk_id", "document_id", "score")
        return hits.orderBy("score", "chunk_id").limit(k)

    def told(blocks: int, decoded: int) -> None:
        if report is not None:
            report.update(blocks=blocks, decoded=decoded)

    if any(len(p) > 1 for p in phrases):
        found = materialise(matches(index, phrases, postings), "matches")
        held = found.agg(F.count("*"), *(F.sum(F.col("holders")[i]) for i in range(len(phrases)))).first()
        told(held[0], held[0])
        return scored(found, [_idf(n, h or 0) for h in held[1:]])
    heads = postings if index.dead is None else postings.join(index.dead, "block", "left_anti")
    holders = dict.fromkeys(terms, 0) | {r.term: r.n for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row for a term
    if index.dead is not None:  # blocks with dead chunks are decoded to count the live ones
        live = matches(index, [[t] for t in terms], postings.join(index.dead, "block", "left_semi"))
        for t, h in zip(terms, live.agg(*(F.sum(F.col("holders")[i]) for i in range(len(terms)))).first()):
            holders[t] += h or 0
    idf = [_idf(n, holders[p[0]]) for p in phrases]
    weight = F.create_map(*[F.lit(x) for t in terms for x in (t, float(sum(w for p, w in zip(phrases, idf) if p[0] == t)))])
    bound = F.sum(weight[F.col("term")] * _part(F.col("most").cast("double"), F.col("least"), 1.0, mean))
    bounds = postings.groupBy("block").agg(bound.alias("bound"), F.count("*").alias("m")).filter(F.col("m") == len(terms))  # a row for a term and block
    bounds = materialise(bounds.select("block", "bound"), "block-bounds")
    blocks = bounds.count()
    if blocks <= FEW:
        told(blocks, blocks)
        return scored(matches(index, phrases, postings.join(bounds, "block", "left_semi")), idf)
    seeds = materialise(bounds.orderBy(F.desc("bound"), "block").limit(max(SEEDS * k, FEW)), "seed-blocks")
    first = materialise(scored(matches(index, phrases, postings.join(seeds, "block", "left_semi")), idf), "first-hits")
    enough = first.agg(F.count("*"), F.max("score")).first()
    rest = bounds.join(seeds, "block", "left_anti")
    if enough[0] >= k:
        rest = rest.filter(F.col("bound") >= -enough[1] * (1 - 1e-9))  # the bound is summed in another order
    rest = materialise(rest, "rest-blocks")
    told(blocks, seeds.count() + rest.count())
    more = scored(matches(index, phrases, postings.join(rest, "block", "left_semi")), idf)
    return first.unionByName(more).orderBy("score", "chunk_id").limit(k)


SEGMENTS = "segment long, path string, chunks long, tokens long, dead_chunks long, dead_tokens long"
#: Bits of a chunk's id for its place in the document.
CHUNK_BITS = 20


def chunk_id() -> Column:
    """An id of a stored chunk from its document and place; documents have less than 2^20 chunks."""
    return F.shiftleft("document_id", CHUNK_BITS) + F.col("chunk_index")


class Keywords:
    """The keyword index of a snapshot store's ``chunks``, kept by the commits that change them.

    ``segments`` has a row for each segment, ``dead`` for each block with dead slots. Each commit with new chunks adds a
    segment; when there are ``fanout``, the newest are merged as far back as those after a segment hold as many chunks
    as it does, so a chunk is tokenised again only each time its segment has about doubled. Segments lie beside the store.
    """

    KEYS = {"segments": "segment", "dead": "block"}

    def __init__(self, store: SnapshotStore, fanout: int = 8):
        self.store, self.spark, self.fanout, self.root = store, store.spark, fanout, f"{store.root}-keywords"

    def empty(self) -> dict[str, DataFrame]:
        """The tables without rows: to make them, or to drop the whole index."""
        return {"segments": self.spark.createDataFrame([], SEGMENTS), "dead": self.spark.createDataFrame([], DEAD)}

    def index(self, at: dict | None = None) -> KeywordIndex:
        at = at or self.store.head()[1]
        rows = self.store.read("segments", at).orderBy("segment").collect()  # segments are merged, so they are few
        dead = self.store.read("dead", at).select("block", "slots")
        return KeywordIndex(self.spark, tuple(Segment(**r.asDict()) for r in rows), dead if any(r.dead_chunks for r in rows) else None)

    def _new(self, chunks: DataFrame, number: int) -> Segment:
        return Segment.write(chunks.select(chunk_id().alias("chunk_id"), "document_id", "text"), f"{self.root}/{number}-{uuid.uuid4().hex}", number)

    def change(self, fresh: DataFrame | None, gone: DataFrame, at: dict) -> dict[str, DataFrame]:
        """Rows to upsert with the commit that adds the chunks ``fresh`` and takes those of ``gone`` (document_id) away."""
        index = self.index(at)
        live = index.slots().join(gone.select("document_id").distinct(), "document_id", "left_semi")
        dying = materialise(live.select("block", "slot", "length", F.shiftright("block", TASK_BITS + COUNT_BITS).alias("segment")), "dying-slots")
        lost = {r.segment: r for r in dying.groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect()}
        rows = {s.segment: s for s in index.segments}
        changed = [Segment(s.segment, s.path, s.chunks, s.tokens, s.dead_chunks + lost[i].n, s.dead_tokens + lost[i].t) for i, s in rows.items() if i in lost]
        if fresh is not None:
            new = self._new(fresh, max(rows, default=0) + 1)
            changed += [new] if new.chunks else []
        out = {}
        if lost:
            slots = dying.groupBy("block").agg(F.array_sort(F.collect_list("slot")).alias("new"))
            held = self.store.read("dead", at).select("block", F.col("slots").alias("old"))
            out["dead"] = slots.join(held, "block", "left").select("block", F.concat("new", F.coalesce("old", F.array().cast("array<int>"))).alias("slots"))
        if changed:
            out["segments"] = self.spark.createDataFrame([tuple(vars(s).values()) for s in changed], SEGMENTS)
        return out

    def merge(self) -> bool:
        """Merge small segments if there are ``fanout``: one commit. Whether it did."""
        at = self.store.head()[1]
        index = self.index(at)
        sizes = [s.chunks - s.dead_chunks for s in index.segments]
        if len(sizes) < self.fanout:
            return False
        start = next((i for i in range(len(sizes) - 1) if sizes[i] <= sum(sizes[i + 1 :])), len(sizes) - 2)
        old = index.segments[start:]
        texts = self.store.read("chunks", at).select("document_id", "chunk_index", "text")
        if start:  # all segments together hold all chunks
            ids = KeywordIndex(self.spark, old, index.dead).slots().select("chunk_id")
            texts = texts.join(ids, chunk_id() == ids.chunk_id, "left_semi")
        new = self._new(texts, old[-1].segment + 1)
        gone = self.spark.createDataFrame([(s.segment,) for s in old], "segment long")
        dead = self.store.read("dead", at).filter(F.shiftright("block", TASK_BITS + COUNT_BITS).isin([s.segment for s in old])).select("block")
        rows = self.spark.createDataFrame([tuple(vars(new).values())] if new.chunks else [], SEGMENTS)
        self.store.commit(upsert={"segments": rows}, delete={"segments": gone, "dead": dead})
        return True

    def collect_garbage(self) -> int:
        """Remove folders that the newest version does not use; reads of older versions end."""
        used = {s.path.rsplit("/", 1)[1] for s in self.index().segments}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sum(fs.delete(p, True) for p in found if p.getName() not in used)
