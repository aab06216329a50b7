"""SimHash near-dedup with vantage-point trees over Hamming distance.

A vantage-point tree built from a sample of the distinct fingerprints (``LEAF`` of each shard's ``SHARD``, ``SAMPLE`` at
most) cuts the space into shards: at a node
with vantage v and radius m a fingerprint x goes inside if d(v, x) <= m and outside otherwise. Triangle bounds say
which shards a ball of the link radius can reach, so a fingerprint outside also travels as a query to the inside
when d(v, x) <= m + radius, and as a query it follows both sides of a boundary that its ball overlaps. Every linked
pair then meets in the home shard of one of its two fingerprints. A shard is split by a tree of its own in the task
until blocks are small, and each block gives links to the smallest member of a group only, never all pairs.
Links between shards are joined to components by rounds of large and small stars.

Only distinct fingerprints are joined, so copies, however many, are one point. Defined cases: no words (null, empty
or white space) gives fingerprint zero, linked like any other; component_id is the smallest non-null doc_id of the
component (null if it has none); repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchmill.llm.common import as_bytes, bounded_batches, documents, materialise

LAST = (1 << 63) - 1

#: Bound of the fingerprint sample from which the shared tree is built, fingerprints aimed at for each shard, and how many of these
#: are sampled; so the number of shards follows the input up to 2^28 fingerprints, and their size beyond.
SAMPLE, SHARD, LEAF = 1 << 20, 4096, 16
LEAST_SAMPLE = 4096
#: Points up to which a shard's own tree splits it, and beyond which a block that no radius splits is joined by enumeration.
BLOCK, DENSE = 1024, 8192


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        bits += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the word shingles: bit set if set in over half of the shingles' XXH64 (seed 42)."""
    parts = text.lower().split()
    if not parts:
        return 0
    norm = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(norm, 42)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(norm[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())], dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, __pm_text (a hash of the text), __pm_fp (the fingerprint's bits as a signed long)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in as_bytes(b.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "__pm_text", "__pm_fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__pm_text"), "text").mapInArrow(run, "doc_id long, __pm_text long, __pm_fp long")


def distance(a, b):
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree as arrays; leaves are numbered."""

    def __init__(self, points: np.ndarray, leaf: int, radius: int, seed: int = 7):
        self.radius, self.nodes, self.leaves = radius, [], 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(points, leaf, rng, 0)

    def _grow(self, points: np.ndarray, leaf: int, rng, depth: int) -> int:
        if len(points) <= leaf or depth > 48:
            return self._leaf()
        best = None
        sample = points if len(points) <= 2048 else points[rng.choice(len(points), 2048, replace=False)]
        for v in points[rng.choice(len(points), min(6, len(points)), replace=False)]:
            count = np.bincount(distance(v, sample), minlength=65)
            inside = np.cumsum(count) / len(sample)
            for m in np.nonzero((inside >= 0.3) & (inside <= 0.7))[0].tolist():
                shell = count[max(0, m - self.radius + 1) : m + self.radius + 1].sum() / len(sample)
                cost = shell + abs(inside[m] - 0.5)
                if best is None or cost < best[0]:
                    best = cost, v, m, shell
        if best is None or best[3] > 0.9:
            return self._leaf()
        _, v, m, _ = best
        inside = distance(v, points) <= m
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (v, m, self._grow(points[inside], leaf, rng, depth + 1), self._grow(points[~inside], leaf, rng, depth + 1))
        return at

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, its own points, points of other leaves whose balls reach it)."""
        yield from self._route(self.root, points, points[:0])

    def _route(self, at: int, own: np.ndarray, queries: np.ndarray):
        if not len(own) and not len(queries):
            return
        if at < 0:
            yield -at - 1, own, queries
            return
        v, m, inside, outside = self.nodes[at]
        d, q = distance(v, own).astype(np.int16), distance(v, queries).astype(np.int16)
        yield from self._route(inside, own[d <= m], np.concatenate([queries[q - self.radius <= m], own[(d > m) & (d - self.radius <= m)]]))
        yield from self._route(outside, own[d > m], queries[q + self.radius > m])


def _block_links(own: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) within own and between own and queries, by comparing all, or by enumeration in a dense block."""
    nodes = np.concatenate([own, queries])
    label = np.arange(len(nodes))
    n, pairs = len(own), []
    if n > DENSE and radius <= 2:
        nodes = np.unique(nodes)
        label, n = _enumerated(nodes, radius), 0
    for i in range(0, n, 256):
        for j in range(i, len(nodes), 4096):
            a, b = np.nonzero(distance(own[i : i + 256, None], nodes[None, j : j + 4096]) <= radius)
            a, b = a + i, b + j
            pairs.append((a[a < b], b[a < b]))
            if sum(len(x) for x, _ in pairs) > 1 << 20:
                label = _spread(label, pairs)
                pairs = []
    label = _spread(label, pairs)
    _, where, size = np.unique(label, return_inverse=True, return_counts=True)
    rows = np.nonzero(size[where] > 1)[0]
    least = np.full(len(size), (1 << 64) - 1, dtype=np.uint64)
    np.minimum.at(least, where[rows], nodes[rows])
    root = least[where[rows]]
    keep = nodes[rows] != root
    return nodes[rows][keep], root[keep]


def _enumerated(nodes: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the groups of sorted points, from the neighbours that each may have: linear in points, however dense they lie.

    Neighbours at one bit are looked up for all points, those at two bits for points outside the largest group only:
    of a pair that joins two groups, one point is such.
    """
    label, bits = np.arange(len(nodes)), [np.uint64(1 << i) for i in range(64)]

    def look(active: np.ndarray, masks: list) -> np.ndarray:
        pairs = []
        for m in masks:
            want = nodes[active] ^ m
            at = np.minimum(np.searchsorted(nodes, want), len(nodes) - 1)
            hit = nodes[at] == want
            pairs.append((active[hit], at[hit]))
        return _spread(label, pairs)

    if radius:
        for i in range(0, 64, 8):
            label = look(np.arange(len(nodes)), bits[i : i + 8])
    for i in range(64 if radius > 1 else 0):
        outside = np.nonzero(label != np.bincount(label).argmax())[0]
        label = look(outside, [bits[i] ^ b for b in bits[i + 1 :]])
    return label


def _spread(label: np.ndarray, pairs: list) -> np.ndarray:
    if not pairs:
        return label
    a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def shard_links(own: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one shard: its points are split by a tree of their own, then blocks are compared."""
    out = [(own[:0], own[:0])]
    tree = Tree(own, BLOCK, radius)
    for _, mine, others in tree._route(tree.root, own, queries):
        if len(mine):
            out.append(_block_links(mine, others, radius))
    a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
    return a, b


def links(points: DataFrame, radius: int = 2) -> DataFrame:
    """Links (__pm_a, __pm_b) that join all distinct fingerprints within the radius; points has __pm_fp, distinct."""
    spark = points.sparkSession
    total = points.count()
    share = min(1.0, min(SAMPLE, max(LEAST_SAMPLE, total * LEAF // SHARD)) / max(1, total))
    sample = points.filter(F.pmod(F.xxhash64("__pm_fp"), F.lit(1 << 30)) < int((1 << 30) * share)).limit(2 * SAMPLE).toArrow()
    sample = np.sort(sample.column("__pm_fp").to_numpy()).view(np.uint64)
    leaf = max(LEAF, int(SHARD * len(sample) / max(1, total)))
    tree = spark.sparkContext.broadcast(Tree(sample, leaf, radius))

    def deal(batches):
        for b in batches:
            for leaf_no, own, queries in tree.value.route(b.column(0).to_numpy().view(np.uint64)):
                fp = np.concatenate([own, queries]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), leaf_no, dtype=np.int64)), pa.array(fp), pa.array(np.arange(len(fp)) >= len(own))], names=["__pm_shard", "__pm_fp", "__pm_query"])

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fp = table.column("__pm_fp").to_numpy().view(np.uint64)
        query = table.column("__pm_query").to_numpy(zero_copy_only=False)
        a, b = shard_links(fp[~query], fp[query], radius)
        return pa.table({"__pm_a": a.view(np.int64), "__pm_b": b.view(np.int64)})

    dealt = points.select("__pm_fp").mapInArrow(deal, "__pm_shard long, __pm_fp long, __pm_query boolean")
    return dealt.groupBy("__pm_shard").applyInArrow(join, "__pm_a long, __pm_b long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(__pm_fp, __pm_root) for every node of the links but the roots, root being the smallest of its component as a signed long.

    Large stars and small stars in turn until nothing changes; each round is written, so lineage stays short.
    """
    a, b = F.col("__pm_a"), F.col("__pm_b")
    edges = materialise(edges.select(F.greatest(a, b).alias("__pm_a"), F.least(a, b).alias("__pm_b")).filter(a != b).distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(b.alias("__pm_a"), a.alias("__pm_b")))
        low = both.groupBy("__pm_a").agg(F.least(F.min("__pm_b"), F.col("__pm_a")).alias("__pm_m"))
        large = both.filter(b > a).join(low, "__pm_a").select(b.alias("__pm_a"), F.col("__pm_m").alias("__pm_b")).distinct()
        low = large.groupBy("__pm_a").agg(F.min("__pm_b").alias("__pm_m"))
        small = large.join(low, "__pm_a").select(b.alias("__pm_a"), F.col("__pm_m").alias("__pm_b")).filter(a != b).unionByName(low.select("__pm_a", F.col("__pm_m").alias("__pm_b"))).distinct()
        edges = materialise(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("__pm_a", "__pm_b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(a.alias("__pm_fp")).agg(F.min("__pm_b").alias("__pm_root"))


def classes(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, __pm_text, __pm_fp, __pm_root (smallest fingerprint of the component), component_id for every row of docs."""
    fps = materialise(fingerprints(docs, words), "fingerprints")
    points = fps.groupBy("__pm_fp").agg(F.min("doc_id").alias("__pm_doc"))
    roots = components(links(points, radius))
    rooted = points.join(roots, "__pm_fp", "left").withColumn("__pm_root", F.coalesce("__pm_root", "__pm_fp"))
    least = rooted.groupBy("__pm_root").agg(F.min("__pm_doc").alias("component_id"))
    of = materialise(rooted.join(least, "__pm_root").select("__pm_fp", "__pm_root", "component_id"), "components")
    return fps.join(of, "__pm_fp")


def first_of_each(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component of fingerprints stays, as by ``first_of``."""
    return first_of(docs, classes(docs.select("doc_id", "text"), words, radius))


def first_of(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """One row of each component stays: that of its smallest doc_id (null comes last; of texts that share it, the one of smaller hash).

    Columns stay as they are. Rows that share a doc_id but not a component each stay.
    """
    names = docs.columns
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("text")
    first = F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("__pm_doc"), "__pm_text")).alias("f")
    keep = classed.groupBy("__pm_root").agg(first).select("f.*")
    rows = docs.select(F.struct("*").alias("__pm_row"), doc.alias("__pm_doc"), text.alias("__pm_text"))  # so no name of a column can clash
    hit = rows.join(keep.hint("shuffle_hash"), ["__pm_doc", "__pm_text"], "left_semi")
    one = W.partitionBy("__pm_doc", "__pm_text").orderBy("__pm_doc")  # rows left here are repeats of one row
    return hit.withColumn("__pm_n", F.row_number().over(one)).filter("__pm_n = 1").select(*[F.col("__pm_row")[n].alias(n) for n in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("__pm_fp"), 16, "0")).alias("fingerprint"), "component_id")
