"""Near copies: SimHash with vantage-point trees, min-hash bands beyond its radius, exact similarity of word shingles.

Texts are near copies where the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Every candidate is
checked by its exact similarity, and the links are joined to components as those of SimHash are.

First the SimHash fingerprints of the shingles go through the vantage-point tree of ``simhash`` (shards, triangle bounds,
star components), and each text is checked against the smallest one of its component. At a similarity of 0.8
fingerprints differ in about ten bits of 64, where triangle bounds leave nothing out, so the tree cannot find all. What it
leaves apart comes from min-hash bands: ``BANDS`` keys of ``ROWS`` minima each, so a pair of similarity s shares a key with
probability 1 - (1 - s**ROWS)**BANDS, 0.99997 at 0.8.

Each key's texts are checked against its smallest one, a row for each, unless the tree has joined the two. Where a key's
texts then still belong to several components, all of them that share no component are compared, in blocks of bounded size inside tasks, which
give only the links that join components: no pairs are emitted, none is left out. Keys that meet in the same
components are compared as one group, so a text travels once, unless the group is large (``MOST_BLOCKS``).

Defined cases: words as in ``simhash.fingerprint``; fewer words than a shingle are one shingle, no words (null, empty or
white space) the empty one, so such texts are equal; texts of equal words are one point; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.llm import simhash
from parchmill.llm.common import as_bytes, bounded_batches, materialise

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Bits in which fingerprints that the tree links differ at most.
RADIUS = 2
#: Odd factors that order the shingles' hashes anew for each minimum.
FACTORS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def shingles(norm: bytes, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of the distinct word shingles, ascending."""
    parts = norm.split(b" ")
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(norm, 42)], dtype=np.uint64)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(norm[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())], dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of minima."""
    least = np.full(len(FACTORS), (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[i : i + 4096] * FACTORS[:, None]).min(axis=1), out=least)
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) for i in range(BANDS)], dtype=np.uint64)


def alike(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether two sets of shingles, as ascending hashes, have this Jaccard similarity."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(both) - shared)


def points(docs: DataFrame) -> DataFrame:
    """doc_id, __pm_text (a hash of the text), __pm_fp (a hash of its words), __pm_n (distinct shingles), __pm_sim (their SimHash), __pm_bands."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, n, sims, keys = [], [], [], []
            for text in as_bytes(b.column(2)):
                norm = normal(text)
                own = shingles(norm)
                fps.append(xxhash.xxh3_64_intdigest(norm))
                n.append(len(own))
                sims.append(simhash.majority(own))
                keys.append(bands(own).tobytes())
            fp, sim = (np.array(x, dtype=np.uint64).view(np.int64) for x in (fps, sims))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp), pa.array(n, pa.int64()), pa.array(sim), pa.array(keys, pa.binary())], names=["doc_id", "__pm_text", "__pm_fp", "__pm_n", "__pm_sim", "__pm_bands"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__pm_text"), "text")
    return docs.mapInArrow(run, "doc_id long, __pm_text long, __pm_fp long, __pm_n long, __pm_sim long, __pm_bands binary")


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.int64)
        fp, n = (np.repeat(b.column(i).to_numpy(), BANDS) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp), pa.array(n)], names=["__pm_band", "__pm_fp", "__pm_n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(normal(t)).tobytes() for t in as_bytes(b.column(1))], pa.binary())], names=["__pm_fp", "__pm_set"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = pa.array([alike(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["__pm_a", "__pm_b"])


def shingle_sets(nodes: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(__pm_fp, __pm_set) of the points in nodes, from one row of each: distinct names its text's hash and doc_id."""
    key = ["__pm_text", "__pm_doc"]
    of = materialise(distinct.select("__pm_fp", *key).join(nodes.select("__pm_fp").distinct(), "__pm_fp", "left_semi"), "near-nodes")
    texts = docs.select(F.xxhash64("text").alias("__pm_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(simhash.LAST)).alias("__pm_doc"), "text")
    texts = texts.join(of.hint("shuffle_hash"), key).groupBy("__pm_fp").agg(F.first("text").alias("text"))  # repeats of one row
    return materialise(texts.mapInArrow(_sets, "__pm_fp long, __pm_set binary"), "shingle-sets")


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (__pm_a, __pm_b) whose similarity is enough."""
    left, right = (sets.select(F.col("__pm_fp").alias(f"__pm_{x}"), F.col("__pm_set").alias(f"__pm_set_{x}")) for x in "ab")
    both = pairs.join(left, "__pm_a").join(right, "__pm_b").select("__pm_a", "__pm_b", "__pm_set_a", "__pm_set_b")
    return materialise(both.mapInArrow(_checked, "__pm_a long, __pm_b long"), "near-links")


#: Shingles of a block that is compared with another one in a task; blocks of a group beyond which it is taken key by key.
BLOCK_SHINGLES, MOST_BLOCKS = 1 << 19, 16


def joining_links(fp: np.ndarray, root: np.ndarray, sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between texts of different components that join all components that any link joins.

    Of two texts in different components one lies outside the largest, so only such texts are looked up among all.
    """
    size = np.array([len(x) for x in sets])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    label = np.unique(root, return_inverse=True)[1]
    count = np.bincount(label)
    out, asked = [], np.zeros(len(sets), dtype=bool)
    while len(todo := np.nonzero(~asked & (label != count.argmax()))[0]):
        for i in todo[np.argsort(count[label[todo]], kind="stable")].tolist():
            if label[i] == count.argmax():
                continue
            asked[i] = True
            start, stop = np.searchsorted(hashes, sets[i], "left"), np.searchsorted(hashes, sets[i], "right")
            n = stop - start
            at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            for j in np.nonzero((shared >= least * (size + size[i] - shared)) & (label != label[i]))[0].tolist():
                if label[j] != label[i]:
                    out.append((int(fp[i]), int(fp[j])))
                    old, new = label[j], label[i]
                    count[new] += count[old]
                    count[old] = 0
                    label[label == old] = new
    return out


def _block_links(table: pa.Table) -> pa.Table:
    fp, root = table.column("__pm_fp").to_numpy(), table.column("__pm_root").to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("__pm_set").to_pylist()]
    found = joining_links(fp, root, sets) if len(fp) else []
    return pa.table({"__pm_a": pa.array([a for a, _ in found], pa.int64()), "__pm_b": pa.array([b for _, b in found], pa.int64())})


def rest_links(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that still meet in a key; members has __pm_band, __pm_fp and __pm_n."""
    rows = members.join(roots, "__pm_fp", "left").withColumn("__pm_root", F.coalesce("__pm_root", "__pm_fp"))
    rows = materialise(rows.select("__pm_band", "__pm_fp", "__pm_n", "__pm_root"), "rooted-members")
    ends = rows.groupBy("__pm_band").agg(F.min("__pm_root").alias("x"), F.max("__pm_root").alias("y"))
    open_bands = materialise(ends.filter("x <> y").select("__pm_band", F.col("x").alias("__pm_to")), "apart-bands")
    rows = materialise(rows.join(open_bands, "__pm_band"), "apart-members")
    meet = simhash.components(rows.select(F.col("__pm_root").alias("__pm_a"), F.col("__pm_to").alias("__pm_b")))
    rows = rows.join(meet.select(F.col("__pm_fp").alias("__pm_root"), F.col("__pm_root").alias("__pm_group")), "__pm_root", "left")
    rows = materialise(rows.withColumn("__pm_group", F.coalesce("__pm_group", "__pm_root")), "grouped-members")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_SHINGLES)).cast("int")
    once = rows.select("__pm_group", "__pm_fp", "__pm_n").distinct().groupBy("__pm_group").agg(blocks(F.sum("__pm_n")).alias("__pm_blocks"))
    small = materialise(once.filter(F.col("__pm_blocks") <= MOST_BLOCKS).select("__pm_group"), "small-groups")
    point = ["__pm_fp", "__pm_n", "__pm_root"]
    whole = rows.join(small, "__pm_group").select(F.lit(0).alias("__pm_kind"), F.col("__pm_group").alias("__pm_key"), *point).distinct()
    large = rows.join(small, "__pm_group", "left_anti").select(F.lit(1).alias("__pm_kind"), F.col("__pm_band").alias("__pm_key"), *point)
    dealt = materialise(dealt_blocks(materialise(whole.unionByName(large), "meeting-points")), "dealt-points")
    held = dealt.select("__pm_kind", "__pm_key", "__pm_i", "__pm_j", "__pm_fp", "__pm_root").join(sets, "__pm_fp")
    return materialise(held.groupBy("__pm_kind", "__pm_key", "__pm_i", "__pm_j").applyInArrow(_block_links, "__pm_a long, __pm_b long"), "rest-links")


def dealt_blocks(rows: DataFrame) -> DataFrame:
    """rows (__pm_kind, __pm_key, __pm_fp, __pm_n, __pm_root) with the pairs of blocks (__pm_i <= __pm_j) in which each is compared.

    Of two texts that a link joins one lies outside the key's largest component. So blocks of texts outside (numbered from
    0) meet all blocks, and blocks of the largest component, which come after them, meet only those: where few texts lie
    outside, each text of the largest component travels once, however many there are.
    """
    key = ["__pm_kind", "__pm_key"]
    sizes = rows.groupBy(*key, "__pm_root").agg(F.sum("__pm_n").alias("s"))
    of = sizes.groupBy(*key).agg(F.max_by("__pm_root", F.struct("s", "__pm_root")).alias("__pm_most"), F.max("s").alias("m"), F.sum("s").alias("t"))
    number = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    of = materialise(of.select(*key, "__pm_most", number(F.col("t") - F.col("m")).alias("__pm_out"), number(F.col("m")).alias("__pm_in")), "key-blocks")
    inside, every = F.col("__pm_root") == F.col("__pm_most"), F.col("__pm_out") + F.col("__pm_in")
    hashed = lambda n: F.pmod(F.xxhash64("__pm_fp"), n).cast("int")
    own = F.when(inside, F.col("__pm_out") + hashed(F.col("__pm_in"))).otherwise(hashed(F.col("__pm_out")))
    rows = rows.join(of, key).withColumn("__pm_own", own)
    rows = rows.withColumn("__pm_other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("__pm_out")).otherwise(every) - 1)))
    pair = {"__pm_i": F.least("__pm_own", "__pm_other"), "__pm_j": F.greatest("__pm_own", "__pm_other")}
    return rows.withColumns(pair).drop("__pm_own", "__pm_other", "__pm_most", "__pm_out", "__pm_in")


def _large_enough(n: str, m: str) -> Column:
    """A similarity is at most the smaller set's share of the larger one."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9


def tree_pairs(distinct: DataFrame) -> DataFrame:
    """(__pm_a, __pm_b): each text with the smallest one of its component of SimHash fingerprints, where sizes allow a link."""
    sims = materialise(distinct.select(F.col("__pm_sim").alias("__pm_fp")).distinct(), "sim-points")
    roots = simhash.components(simhash.links(sims, RADIUS)).select(F.col("__pm_fp").alias("__pm_sim"), "__pm_root")
    rows = distinct.select("__pm_fp", "__pm_n", "__pm_sim").join(roots, "__pm_sim", "left")
    rows = materialise(rows.select("__pm_fp", "__pm_n", F.coalesce("__pm_root", "__pm_sim").alias("__pm_root")), "sim-roots")
    least = rows.groupBy("__pm_root").agg(F.min("__pm_fp").alias("__pm_least"), F.max("__pm_fp").alias("__pm_most"), F.min_by("__pm_n", "__pm_fp").alias("__pm_least_n"))
    pairs = rows.join(least.filter("__pm_least <> __pm_most"), "__pm_root").filter(F.col("__pm_fp") != F.col("__pm_least"))
    return materialise(pairs.filter(_large_enough("__pm_n", "__pm_least_n")).select(F.col("__pm_fp").alias("__pm_a"), F.col("__pm_least").alias("__pm_b")), "tree-pairs")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that these roots do not join."""
    for x in "ab":
        pairs = pairs.join(roots.select(F.col("__pm_fp").alias(f"__pm_{x}"), F.col("__pm_root").alias(f"__pm_root_{x}")), f"__pm_{x}", "left")
    return pairs.filter(F.coalesce("__pm_root_a", "__pm_a") != F.coalesce("__pm_root_b", "__pm_b")).select("__pm_a", "__pm_b")


def links(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (__pm_a, __pm_b) that join all near copies among the candidates; distinct is one row for each point."""
    rows = materialise(distinct.select("__pm_fp", "__pm_n", "__pm_bands").mapInArrow(_band_rows, "__pm_band long, __pm_fp long, __pm_n long"), "bands")
    shared = rows.groupBy("__pm_band").agg(F.min("__pm_fp").alias("__pm_least"), F.max("__pm_fp").alias("__pm_most"), F.min_by("__pm_n", "__pm_fp").alias("__pm_least_n"))
    shared = materialise(shared.filter("__pm_least <> __pm_most").drop("__pm_most"), "shared-bands")
    members = materialise(rows.join(shared, "__pm_band"), "band-members")
    tree = tree_pairs(distinct)
    nodes = [members.select("__pm_fp"), *(tree.select(F.col(f"__pm_{x}").alias("__pm_fp")) for x in "ab")]
    sets = shingle_sets(nodes[0].unionByName(nodes[1]).unionByName(nodes[2]), distinct, docs)
    by_tree = checked(tree, sets)
    first = members.filter(F.col("__pm_fp") != F.col("__pm_least")).filter(_large_enough("__pm_n", "__pm_least_n"))
    first = first.select(F.col("__pm_fp").alias("__pm_a"), F.col("__pm_least").alias("__pm_b")).distinct()
    stars = by_tree.select(F.col("__pm_a").alias("__pm_fp"), F.col("__pm_b").alias("__pm_root"))  # each text has one pair at most, with its component's smallest
    first = materialise(apart(first, stars), "first-pairs")
    found = by_tree.unionByName(checked(first, sets))
    return found.unionByName(rest_links(members, simhash.components(found), sets))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, __pm_text, __pm_fp and __pm_root (smallest __pm_fp of the component) for every row of docs."""
    every = materialise(points(docs), "near-points")
    doc = F.coalesce("doc_id", F.lit(simhash.LAST))
    texts = every.groupBy("__pm_fp", "__pm_text").agg(F.min(doc).alias("__pm_doc"))
    texts = texts.groupBy("__pm_fp").agg(F.min_by("__pm_doc", "__pm_text").alias("__pm_doc"), F.min("__pm_text").alias("__pm_text"))
    keys = every.groupBy("__pm_fp").agg(F.first("__pm_n").alias("__pm_n"), F.first("__pm_sim").alias("__pm_sim"), F.first("__pm_bands").alias("__pm_bands"))
    distinct = materialise(keys.join(texts, "__pm_fp"), "near-distinct")
    roots = simhash.components(links(distinct, docs))
    every = every.select("doc_id", "__pm_text", "__pm_fp")
    return every.join(roots, "__pm_fp", "left").withColumn("__pm_root", F.coalesce("__pm_root", "__pm_fp"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component stays, as by ``simhash.first_of``."""
    return simhash.first_of(docs, classes(docs.select("doc_id", "text")))
