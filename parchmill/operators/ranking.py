"""Retrieval: pre-filtered exact nearest neighbours, rank fusion, top documents, sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchmill.functions.text import snippet, tokens
from parchmill.operators.documents import json_object
from parchmill.operators.keywords import KeywordIndex, keyword_search
from parchmill.operators.library import with_names
from parchmill.session import bounded_batches, materialise

RRF_K = 60


@dataclass(frozen=True)
class SearchFilters:
    """Conjunction; dates compare as text, so a bare date_to excludes that day's rows."""

    date_from: str | None = None
    date_to: str | None = None
    correspondent_id: int | None = None
    document_type_id: int | None = None
    tag_ids: tuple[int, ...] = ()

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.date_from:
            out = out & (F.col("created") >= self.date_from)
        if self.date_to:
            out = out & (F.col("created") <= self.date_to)
        if self.correspondent_id is not None:
            out = out & (F.col("correspondent_id") == self.correspondent_id)
        if self.document_type_id is not None:
            out = out & (F.col("document_type_id") == self.document_type_id)
        for t in self.tag_ids:
            out = out & F.array_contains("tag_ids", F.lit(t).cast("bigint"))
        return out


def nearest(chunks: DataFrame, vectors: list[list[float]], k: int) -> DataFrame:
    """(list_no, chunk_id, document_id, distance, rank): the k nearest chunks of each query vector by cosine distance.

    The query matrix goes with the plan (its size is the caller's k x d). Each task keeps its own k nearest for each
    query while it reads, so what is shuffled is tasks x queries x k rows. Zero and ragged vectors have no distance;
    chunks without an id or a document are not ranked. Filter ``chunks`` before: ranking comes last.
    """
    schema = "list_no int, chunk_id long, document_id long, distance double"
    names = [x.split()[0] for x in schema.split(", ")]
    if k <= 0 or not vectors:
        return chunks.sparkSession.createDataFrame([], schema + ", rank int")
    bounded_batches(chunks.sparkSession)
    q = np.array(vectors, dtype=np.float64)
    norm = np.linalg.norm(q, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in vectors]
        for b in batches:
            b = b.filter(pc.equal(pc.list_value_length(b.column(2)), q.shape[1]))
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            ids, owners = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = 1 - (q @ x.T) / (norm * np.linalg.norm(x, axis=1))
            for i, d in enumerate(distance):
                good = np.nonzero(np.isfinite(d))[0]
                if len(good) > k:
                    good = good[d[good] <= np.partition(d[good], k - 1)[k - 1]]
                d, c, o = (np.concatenate(p) for p in zip(best[i], (d[good], ids[good], owners[good])))
                order = np.lexsort((c, d))[:k]
                best[i] = d[order], c[order], o[order]
        number = np.repeat(np.arange(len(best), dtype=np.int32), [len(d) for d, _, _ in best])
        d, c, o = (np.concatenate(p) for p in zip(*best))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(c), pa.array(o), pa.array(d)], names=names)

    top = chunks.select("chunk_id", "document_id", "embedding").dropna(subset=["chunk_id", "document_id"]).mapInArrow(run, schema)
    order = W.partitionBy("list_no").orderBy("distance", "chunk_id")
    return top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Vectors of a block of chunks at least and at most, and blocks aimed at between; queries of a row and of a matrix product; pivots at most, and of how many vectors each stands for one.
LEAST_BLOCK, CHUNK_BLOCK, BLOCKS = 256, 8192, 64
QUERY_ROW, QUERY_BLOCK = 512, 128
PIVOTS, PER_PIVOT = 1024, 64
#: By how much a bound or a distance may be off: arc cosines of nearly equal vectors, and sums in another order.
LOOSE, ROUNDING = 1e-7, 1e-9
#: Products of squared lengths below it lose digits.
TINY = 1e-290


def _pivots(chunks: DataFrame, width: int) -> np.ndarray:
    """Unit vectors: chunks with a direction by the hash of their id, one of ``PER_PIVOT`` and ``PIVOTS`` at most; none where no chunk has one."""
    most = min(PIVOTS, max(1, chunks.count() // PER_PIVOT))
    directed = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"), lambda a: (a > 0) & (a < float("inf")))
    rows = chunks.filter(directed).select("embedding", F.xxhash64("chunk_id").alias("h"), "chunk_id").orderBy("h", "chunk_id").limit(most).collect()  # bounded by PIVOTS
    x = np.array([r.embedding for r in rows], dtype=np.float64).reshape(-1, width)
    size = np.linalg.norm(x, axis=1)
    good = np.isfinite(size) & (size > 0)
    x = x[good] / size[good, None]
    alike, order = x @ x.T, [0] if len(x) else []
    for _ in range(1, len(x)):  # each after the one most like it, so that cells of a block lie close
        alike[:, order[-1]] = -np.inf
        order.append(int(alike[order[-1]].argmax()))
    return x[order]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between rows and pivots; not a number for rows without a direction."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.arccos(np.clip((x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T, -1, 1))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, width)


def _dealt(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First block and number of blocks of each cell of n vectors, and each block's cells: small cells share one, large ones have several."""
    start, parts, of = np.zeros(len(n), dtype=np.int64), np.ones(len(n), dtype=np.int64), [[]]
    held = 0
    for cell, m in enumerate(n.tolist()):
        if held and held + m > size:
            of.append([])
            held = 0
        start[cell], parts[cell] = len(of) - 1, max(1, -(-m // size))
        if m:
            of[-1].append(cell)
            of += [[cell] for _ in range(parts[cell] - 1)]
        held += m
    return start, parts, [np.array(cells, dtype=np.int64) for cells in of]


def _chunk_blocks(rows: DataFrame, k: int) -> DataFrame:
    """(block, c_cells, c_ids, c_owners, c_x) of (block, cell, id, owner, x): rows of a block side by side, ``CHUNK_BLOCK`` at most.

    Equal vectors are equally far from any query and share a cell, so of those in a row only the k of least ids can be among the k nearest; others are left out.
    """
    most = CHUNK_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            t, seen, first = pa.Table.from_batches(held), Counter(), []
            for i, x in enumerate(t.column(4).to_pylist()):  # by id within a cell
                seen[x] += 1
                if seen[x] <= k:
                    first.append(i)
            t = t.take(first)
            raw = [t.column(i).to_numpy().astype(kind).tobytes() for i, kind in ((1, np.int32), (2, np.int64), (3, np.int64))]
            raw.append(b"".join(t.column(4).to_pylist()))
            return pa.RecordBatch.from_arrays([t.column(0).slice(0, 1).combine_chunks(), *(pa.array([v], pa.binary()) for v in raw)], names=["block", "c_cells", "c_ids", "c_owners", "c_x"])

        for b in batches:
            block = b.column(0).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), len(block)]
            for at, end in zip(cuts, cuts[1:]):
                while at < end:
                    if held and (held[-1].column(0)[0].as_py() != block[at] or size >= most):
                        yield row()
                        held, size = [], 0
                    held.append(b.slice(at, min(end - at, most - size)))
                    size += held[-1].num_rows
                    at += held[-1].num_rows
        if held:
            yield row()

    dealt = rows.repartitionByRange("block", "cell", "id").sortWithinPartitions("block", "cell", "id")
    return materialise(dealt.mapInArrow(run, "block int, c_cells binary, c_ids binary, c_owners binary, c_x binary"), "chunk-blocks")


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scalar products of the rows, each summed from its first entry to its last, as SQL sums them."""
    return np.ascontiguousarray((x * y).T).sum(axis=0)


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k least finite values of each row, and of those that equal them but for rounding."""
    held = np.isfinite(d)
    full = held.sum(axis=1) > k
    if full.any():
        held[full] &= d[full] <= np.partition(d[full], k - 1, axis=1)[:, k - 1 : k] + ROUNDING
    return np.nonzero(held)


def _block_best(row: dict, cells: np.ndarray, k: int, width: int) -> list[np.ndarray]:
    """(query ids, chunk ids, owners, distances): the k nearest chunks of a block for each query, of the cells that it wants and within its reach.

    Candidates come from matrix products of ``QUERY_BLOCK`` queries; their distances are then summed row by row,
    in the order and form of SQL's cosine, so equal vectors are equally far and multiples of a vector rank as SQL ranks them.
    """
    asked, ids, owners = (np.frombuffer(row[n], dtype=np.int64) for n in ("q_ids", "c_ids", "c_owners"))
    x, y, reach = np.frombuffer(row["q_x"]).reshape(-1, width), np.frombuffer(row["c_x"]).reshape(-1, width), np.frombuffer(row["q_reach"])
    wanted = np.frombuffer(row["q_wanted"], dtype=bool).reshape(len(asked), len(cells))
    cell = np.searchsorted(cells, np.frombuffer(row["c_cells"], dtype=np.int32))
    x_square, y_square = _dots(x, x), _dots(y, y)
    x_size, y_size = np.sqrt(x_square), np.sqrt(y_square)
    out = []
    for i in range(0, len(asked), QUERY_BLOCK):
        part = slice(i, i + QUERY_BLOCK)
        d = x[part] @ y.T
        d /= x_size[part, None]
        d /= y_size
        np.subtract(1, d, out=d)
        d[~(wanted[part][:, cell] & (d <= reach[part, None] + ROUNDING))] = np.inf
        q, c = _least(d, k)
        q += i
        exact = np.empty(len(q))
        for j in range(0, len(q), 1 << 10):
            a, b = q[j : j + (1 << 10)], c[j : j + (1 << 10)]
            with np.errstate(over="ignore", under="ignore"):
                both = x_square[a] * y_square[b]
            size = np.where((both > TINY) & np.isfinite(both), np.sqrt(both), x_size[a] * y_size[b])
            exact[j : j + (1 << 10)] = 1 - np.clip(_dots(x[a], y[b]) / size, -1, 1)
        order = np.lexsort((ids[c], exact, q))
        q, c, exact = q[order], c[order], exact[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((asked[q[keep]], ids[c[keep]], owners[c[keep]], exact[keep]))
    return [np.concatenate(v) for v in zip(*out)]


def nearest_of_all(queries: DataFrame, chunks: DataFrame, k: int, width: int, report: dict | None = None) -> DataFrame:
    """(query_id, chunk_id, document_id, distance, rank): the k nearest chunks of every row of queries (query_id, embedding).

    Chunks lie in cells, that of their nearest pivot by angle, and each cell knows the least and the greatest angle from its pivot.
    A query first meets the cells of its nearest pivots that hold k chunks; then those whose triangle bound reaches the k-th
    distance found; others are not compared with it. Cells lie in blocks, and a query travels once to each block that
    holds a cell it wants, with the mask of these cells; there queries and chunks meet as matrix products of bounded size, and only chunks within the
    k-th distance leave the task. Driver and broadcasts hold pivots and a row for each cell. Rows without an
    id or, of chunks, without a document are left out. ``report`` gets the number of comparisons, made and of all with all.
    """
    spark = chunks.sparkSession
    bounded_batches(spark)
    fits = F.size("embedding") == width
    q = queries.filter(fits).dropna(subset=["query_id"]).select(F.col("query_id").cast("long").alias("id"), "embedding")
    c = chunks.filter(fits).dropna(subset=["chunk_id", "document_id"]).select("chunk_id", "document_id", "embedding")
    pivots = _pivots(c, width)
    schema = "query_id long, chunk_id long, document_id long, distance double"
    if not len(pivots) or k <= 0:
        return spark.createDataFrame([], schema + ", rank int")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from (b.slice(i, QUERY_ROW) for i in range(0, b.num_rows, QUERY_ROW))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            x = _matrix(b.column(2), width)
            angle = _angles(x, pivots)
            good = np.nonzero(np.isfinite(angle).all(axis=1))[0]  # rows without a direction have no distance
            cell = angle[good].argmin(axis=1) if len(good) else good
            ids, owners = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)[good] for i in (0, 1))
            raw = [pa.array(cell.astype(np.int32)), pa.array(ids), pa.array(owners), pa.array([v.tobytes() for v in x[good]], pa.binary()), pa.array(angle[good, cell])]
            yield pa.RecordBatch.from_arrays(raw, names=["cell", "id", "owner", "x", "angle"])

    assigned = materialise(c.mapInArrow(assign, "cell int, id long, owner long, x binary, angle double"), "assigned-chunks")
    held = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()  # a row for each pivot
    n, low, high = np.zeros(len(pivots), dtype=np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in held:
        n[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    start, several, cells = _dealt(n, int(np.clip(n.sum() // BLOCKS, LEAST_BLOCK, CHUNK_BLOCK)))
    block = F.get(F.lit(start.tolist()), F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(F.lit(several.tolist()), F.col("cell")))
    blocks = _chunk_blocks(assigned.select(block.cast("int").alias("block"), "cell", "id", "owner", "x"), k)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the mask of its first cells: those of the nearest pivots until they hold k chunks."""
        for b in parts(batches):
            x = _matrix(b.column(1), width)
            angle = _angles(x, pivots)
            good = np.isfinite(angle).all(axis=1)
            x, angle = x[good], angle[good]
            order = np.argsort(angle, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            mask = np.zeros(angle.shape, dtype=bool)
            np.put_along_axis(mask, order, before < k, axis=1)
            raw = [b.column(0).filter(pa.array(good)), *(pa.array([v.tobytes() for v in rows], pa.binary()) for rows in (x, np.packbits(mask & (n > 0), axis=1)))]
            yield pa.RecordBatch.from_arrays(raw, names=["id", "x", "first"])

    def meet(rest: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches):
                x, ids = _vectors(b.column(1), width), b.column(0).to_numpy()
                wanted = np.unpackbits(np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(len(x), -1), axis=1, count=len(n)).astype(bool)
                reach = np.full(len(x), np.inf)
                if rest:
                    angle, d = _angles(x, pivots), b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = np.where(np.isnan(d), np.inf, d)  # a query with less than k so far reaches all
                    bound = 1 - np.cos(np.clip(np.maximum(angle - high, low - angle), 0, np.pi))
                    wanted = ~wanted & (n > 0) & (bound <= reach[:, None] + LOOSE)
                for i, of in enumerate(cells):
                    some = np.nonzero(wanted[:, of].any(axis=1))[0]
                    if not len(some):
                        continue
                    mask = wanted[np.ix_(some, of)]
                    made = int((mask * n[of]).sum()) if i == start[of[0]] else 0  # a cell of several blocks counts at its first
                    raw = [pa.array([v], pa.binary()) for v in (ids[some].tobytes(), x[some].tobytes(), reach[some].tobytes(), mask.tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *raw, pa.array([made], pa.int64())], names=["block", "q_ids", "q_x", "q_reach", "q_wanted", "made"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in _block_best(row, cells[row["block"]], k, width)], names=[v.split()[0] for v in schema.split(", ")])

    def ranked(top: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy("distance", "chunk_id")
        return top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def round_of(rows: DataFrame, rest: bool) -> DataFrame:
        met = materialise(rows.mapInArrow(meet(rest), "block int, q_ids binary, q_x binary, q_reach binary, q_wanted binary, made long"), "query-rows")
        if report is not None:
            report["made"] = report.get("made", 0) + int(met.agg(F.sum("made")).first()[0] or 0)
        return met.drop("made").join(blocks, "block").mapInArrow(compare, schema)

    asked = materialise(q.mapInArrow(first, "id long, x binary, first binary"), "asked")
    found = materialise(ranked(round_of(asked, False)), "first-cells")
    reach = found.groupBy("query_id").agg(F.max("distance").alias("d"), F.count("*").alias("m")).filter(F.col("m") >= k)
    again = asked.join(reach.select(F.col("query_id").alias("id"), "d"), "id", "left").select("id", "x", "first", "d")
    out = ranked(found.drop("rank").unionByName(round_of(again, True)))
    if report is not None:
        report["all"] = int(n.sum()) * q.count()
    return out


def fuse(ranked: DataFrame) -> DataFrame:
    """(chunk_id, document_id, rrf_score, first_list, first_rank) of (list_no, rank, chunk_id, document_id).

    Reciprocal rank fusion; the sum runs in list order, so equal input gives equal bits.
    """
    lists = F.array_sort(F.collect_list(F.struct("list_no", "rank")))
    return ranked.groupBy("chunk_id").agg(
        F.first("document_id").alias("document_id"),
        F.aggregate(lists, F.lit(0.0), lambda a, x: a + 1.0 / (RRF_K + x["rank"])).alias("rrf_score"),
        lists[0]["list_no"].alias("first_list"), lists[0]["rank"].alias("first_rank"),
    )


def top_documents(fused: DataFrame, k: int) -> DataFrame:
    """All fused chunks of the k documents with the best chunk; ties go to the document seen first.

    Scores that differ only by the order of their sum are ties, so documents compare by 12 decimals.
    """
    best = fused.groupBy("document_id").agg(F.max("rrf_score").alias("best"), F.min(F.struct("first_list", "first_rank", "chunk_id")).alias("seen"))
    return fused.join(best.orderBy(F.desc(F.round("best", 12)), "seen").limit(k).select("document_id"), "document_id", "left_semi")


def merge_rounds(first: DataFrame, second: DataFrame) -> DataFrame:
    """Chunks of two rounds, the first occurrence of each."""
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return both.withColumn("n", F.row_number().over(W.partitionBy("chunk_id").orderBy("round"))).filter("n = 1").drop("n", "round")


def sources(fused: DataFrame, chunks: DataFrame, documents: DataFrame, base_url: str = "", taxonomy: DataFrame | None = None) -> DataFrame:
    """One row for each document: best chunk's snippet and score, title and link; unknown documents stay.

    With a taxonomy also the names of correspondent and document type.
    """
    best = fused.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("document_id").agg(F.max("rrf_score").alias("score"), F.max_by("text", F.struct(F.col("rrf_score"), -F.col("first_list"), -F.col("first_rank"), -F.col("chunk_id"))).alias("text"))
    known = documents if taxonomy is None else with_names(documents, taxonomy)
    names = [] if taxonomy is None else ["correspondent", "document_type"]
    named = best.join(known.select(F.col("id").alias("document_id"), "title", "created", *names), "document_id", "left")
    return named.select("document_id", "title", *names, "created", snippet("text").alias("snippet"), "score", F.format_string(f"{base_url}/documents/%d/", "document_id").alias("url")).orderBy(F.desc("score"), "document_id")


@dataclass(frozen=True)
class QueryPlan:
    """What a planner made of a question."""

    semantic_queries: tuple[str, ...] = ()
    keyword_terms: tuple[str, ...] = ()
    sub_questions: tuple[str, ...] = ()
    filters: SearchFilters = SearchFilters()

    def broaden(self) -> QueryPlan:
        return replace(self, filters=SearchFilters())

    def adjust(self, hint: str) -> QueryPlan:
        """The hint as one more semantic query."""
        return replace(self, semantic_queries=(*self.semantic_queries, hint))


#: Fixed texts of answers.
NO_MATCH = "No matching documents were found in the archive for this query."
NOT_FOUND = "No relevant information was found in the document archive to answer this question."
UNREADABLE = "No answer could be produced: the retrieved context did not yield a parseable response."
BROADEN = "LLM response was unparseable; broadening the query may help."


@dataclass(frozen=True)
class Answered:
    answer: str
    citations: tuple[int, ...] = ()


@dataclass(frozen=True)
class NeedsMore:
    adjustment: str


def parse_outcome(said: str | None, final: bool) -> Answered | NeedsMore:
    """A model's outcome; what cannot be read asks for more, or in the final round says so. A final round may not ask for more."""
    got = json_object(said)
    kind = got.get("outcome") if got else None
    text = lambda key: str(got.get(key) or "").strip()
    if kind == "answered":
        try:
            return Answered(text("answer"), tuple(int(c) for c in got.get("citations") or []))
        except (TypeError, ValueError):
            kind = None
    if kind == "needs_more":
        return Answered(NOT_FOUND) if final else NeedsMore(text("adjustment"))
    return Answered(UNREADABLE) if final else NeedsMore(BROADEN)


@dataclass
class SearchEngine:
    """Retrieval over chunks (chunk_id, document_id, text, embedding), their keyword index and documents; models are callables."""

    chunks: DataFrame
    index: KeywordIndex
    documents: DataFrame
    embed: object
    top_k: int = 10
    per_list: int | None = None
    max_refinements: int = 1
    taxonomy: DataFrame | None = None
    base_url: str = ""

    def fused(self, plan: QueryPlan) -> DataFrame:
        """One plan for all ranked lists, their fusion and the top documents. A model that cannot embed leaves the keyword list."""
        most = self.per_list or self.top_k
        every = plan.filters == SearchFilters()
        ids = self.documents.filter(plan.filters.predicate()).select(F.col("id").alias("document_id"))
        inside = self.chunks if every else self.chunks.join(ids, "document_id", "left_semi")
        queries = [*plan.semantic_queries, *plan.sub_questions]
        try:
            vectors = [self.embed(q) for q in queries]
        except Exception:  # noqa: BLE001  the model is foreign code
            vectors = []
        lists = nearest(inside, vectors, most).select("list_no", "rank", "chunk_id", "document_id")
        if plan.keyword_terms:
            spark = self.chunks.sparkSession
            cut = spark.createDataFrame([(i, t) for i, t in enumerate(plan.keyword_terms)], "i int, t string").select("i", tokens("t").alias("w")).orderBy("i").collect()
            words = keyword_search(self.index, [r["w"] for r in cut], most, None if every else ids)
            ranked = words.withColumn("rank", F.row_number().over(W.orderBy("score", "chunk_id")))  # at most ``most`` rows
            lists = lists.unionByName(ranked.select(F.lit(len(queries)).alias("list_no"), "rank", "chunk_id", "document_id"))
        return top_documents(fuse(lists), self.top_k)

    def found(self, plan: QueryPlan) -> DataFrame:
        """The fused chunks; if the filters leave none, once more without filters."""
        found = materialise(self.fused(plan), "found")
        if plan.filters != SearchFilters() and found.isEmpty():
            found = materialise(self.fused(plan.broaden()), "found")
        return found

    def sources(self, found: DataFrame) -> DataFrame:
        return sources(found, self.chunks, self.documents, self.base_url, self.taxonomy)

    def retrieve(self, plan: QueryPlan) -> DataFrame:
        return self.sources(self.found(plan))

    def context(self, found: DataFrame) -> DataFrame:
        """(chunk_id, document_id, text, rrf_score), best first: what a model is given to answer from."""
        return found.join(self.chunks.select("chunk_id", "text"), "chunk_id").select("chunk_id", "document_id", "text", "rrf_score").orderBy(F.desc("rrf_score"), "first_list", "first_rank")

    def answer(self, question: str, planner, synthesise) -> tuple[str, DataFrame, int]:
        """(answer, sources, model calls): plan, retrieve, synthesise, and refine once if asked to; never more than three calls.

        ``synthesise`` gets the question, the chunks found and whether it must answer now, and gives an outcome
        (``Answered``, ``NeedsMore`` or a model's text, see ``parse_outcome``).
        """
        plan, calls = planner(question) or QueryPlan((question,)), 1
        found = self.found(plan)
        if found.isEmpty():
            return NO_MATCH, self.sources(found), calls

        def ask(final: bool) -> Answered | NeedsMore:
            said = synthesise(question, self.context(found), final=final)
            return said if isinstance(said, Answered | NeedsMore) else parse_outcome(said, final)

        outcome, calls = ask(False), calls + 1
        if isinstance(outcome, NeedsMore) and self.max_refinements > 0:
            found = materialise(merge_rounds(found, self.found(plan.adjust(outcome.adjustment))), "found")
            outcome, calls = ask(True), calls + 1
        return (outcome.answer if isinstance(outcome, Answered) else ""), self.sources(found), calls
