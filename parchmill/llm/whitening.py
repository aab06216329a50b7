"""Embedding whitening by an exact scatter in residues.

Entries become integers x = floor(1024 c) + 100000. A first pass gives the number of rows and each dimension's exact sum
and range, a second one the scatter of w = x - m, where m is the floor of the mean: in each task blocks of rows are
multiplied modulo several primes (double-precision products of centred residues, exact below 2^53), the residues are
summed by prime and block of rows of the matrix, and the driver joins them by Chinese remaindering. What the driver holds grows with
the width alone. So the covariance (n * sum w w' - sum w * sum w') / n^2 is exact until its one rounding, and a double
eigh gives the components.

Defined cases: rows whose vector is null, empty, holds null or non-finite entries, or entries whose x is beyond 2^61, are
dropped; so are rows of another width than the commonest (ties: the smaller width); repeated rows count each and each
get their results; a component without variance (eigenvalue at most 1e-12 of the trace) has null for whitened and takes no
part in the identity error; a deviation beyond a long is null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm.common import bounded_batches, materialise

#: Fixed by the query's contract: scale, shift, components returned.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Largest |x| plus one; rows of a block that is multiplied at once; primes lie below this bound, so products of centred residues sum below 2^53.
MOST, BLOCK, PRIME = 1 << 61, 8192, 1 << 20
#: Rows of the matrix in one group of residues, and groups over which the tasks' residues of it are summed first.
STRIPE, SALTS = 64, 16
#: Share of the trace below which an eigenvalue counts as none.
NO_VARIANCE = 1e-12


def primes(product: int) -> list[int]:
    """Primes below PRIME, the largest first, until their product exceeds the one given."""
    sieve = np.ones(PRIME, dtype=bool)
    sieve[:2] = False
    for i in range(2, math.isqrt(PRIME) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    out, have = [], 1
    for p in np.nonzero(sieve)[0][::-1].tolist():
        if have > product:
            break
        out.append(p)
        have *= p
    return out


def remaindered(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The integers (as objects) of least magnitude that leave these residues by prime."""
    out, have = None, 1
    for p, r in residues.items():
        r = r.astype(object)
        if out is None:
            out = r
        else:
            out = out + have * ((r - out) * pow(have, -1, p) % p)
        have *= p
    return np.where(out > have // 2, out - have, out)


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: which rows are valid, the widths of all rows, and x of the valid rows, one after another."""
    size = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    there = np.asarray(flat.is_valid())
    scaled = np.floor(SCALE * np.asarray(flat.fill_null(0.0), dtype=np.float64))
    bad = ~there | ~(np.abs(scaled) < MOST)  # NaN is no less
    row = np.repeat(np.arange(len(size)), size)
    valid = size > 0
    valid[row[bad]] = False
    return valid, size, scaled[valid[row]].astype(np.int64) + SHIFT


STATISTICS = "width int, dimension int, n long, high long, low long, least long, most long"


def statistics(rows: DataFrame) -> tuple[int, int, np.ndarray, int, int]:
    """Width, n, sums by dimension (as objects), least and largest x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            valid, size, x = integers(b.column(1))
            at = np.cumsum(size * valid) - size * valid
            for width in np.unique(size[valid]).tolist():
                own = x[(at[valid & (size == width)][:, None] + np.arange(width))]
                new = np.stack([np.full(width, len(own)), (own >> 31).sum(axis=0), (own & (1 << 31) - 1).sum(axis=0), own.min(axis=0), own.max(axis=0)])
                old = held.get(width)
                held[width] = new if old is None else np.concatenate([old[:3] + new[:3], np.minimum(old[3:4], new[3:4]), np.maximum(old[4:], new[4:])])
        for width, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, width, dtype=np.int32)), pa.array(np.arange(width, dtype=np.int32)), *map(pa.array, s)], schema=pa.schema([("width", pa.int32()), ("dimension", pa.int32()), *((c, pa.int64()) for c in ("n", "high", "low", "least", "most"))]))

    total = rows.mapInArrow(run, STATISTICS).groupBy("width", "dimension").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")), F.min("least").alias("least"), F.max("most").alias("most"))
    total = materialise(total, "dimension-sums")
    lead = total.filter("dimension = 0").orderBy(F.desc("n"), "width").select("width", "n").first()
    if lead is None:
        return 0, 0, np.zeros(0, dtype=object), 0, 0
    own = total.filter(F.col("width") == lead.width).orderBy("dimension").collect()
    return lead.width, lead.n, np.array([(int(r.high) << 31) + int(r.low) for r in own], dtype=object), min(r.least for r in own), max(r.most for r in own)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_ids and x (rows by dimensions) of the valid rows of this width."""
    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            valid, size, x = integers(part.column(1))
            keep = valid & (size == width)
            if keep.any():
                yield part.column(0).filter(pa.array(keep)), x[np.repeat(keep[valid], size[valid])].reshape(-1, width)


RESIDUES = "prime int, stripe int, salt int, residues binary"


def scatter(rows: DataFrame, width: int, middle: np.ndarray, bound: int) -> np.ndarray:
    """Exact sum of w w' (as objects), w = x - middle; bound is at least the magnitude of its entries."""
    moduli = primes(2 * bound)
    edges = list(range(0, width, STRIPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros((len(moduli), width, width), dtype=np.int64)
        for _, x in blocks(batches, width):
            w = x - middle
            for k, p in enumerate(moduli):
                r = w % p
                r = (r - p * (r > p // 2)).astype(np.float64)
                sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
        salt = TaskContext.get().partitionId() % SALTS
        for k, p in enumerate(moduli):
            for s, i in enumerate(edges):
                yield pa.RecordBatch.from_pylist([{"prime": p, "stripe": s, "salt": salt, "residues": sums[k, i : i + STRIPE].tobytes()}], schema=kind)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s = key[0].as_py(), key[1].as_py()
        total = np.int64(0)
        for b in batches:
            for x in b.column(b.schema.get_field_index("residues")).to_pylist():
                total = (total + np.frombuffer(x, dtype=np.int64)) % p
        yield pa.RecordBatch.from_pylist([{"prime": p, "stripe": s, "salt": 0, "residues": total.tobytes()}], schema=kind)

    kind = pa.schema([("prime", pa.int32()), ("stripe", pa.int32()), ("salt", pa.int32()), ("residues", pa.binary())])
    some = rows.mapInArrow(run, RESIDUES).groupBy("prime", "stripe", "salt").applyInArrow(add, RESIDUES)
    every = some.groupBy("prime", "stripe").applyInArrow(add, RESIDUES).collect()
    every = sorted(every, key=lambda r: (r.prime, r.stripe))
    return remaindered({p: np.concatenate([np.frombuffer(r.residues, dtype=np.int64).reshape(-1, width) for r in every if r.prime == p]) for p in moduli})


def components(n: int, scattered: np.ndarray, sums: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors as columns (largest entry positive) and trace of the covariance; sums are those of w."""
    exact = n * scattered - np.outer(sums, sums)
    covariance = np.array([[int(c) / (n * n) for c in row] for row in exact])  # the quotient of two integers is rounded once
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return e, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1), float(np.trace(covariance))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n x - S)^2 by row, exact; null beyond a long.

    Products and sums of longs are right modulo 2^64, so where the true result is below 2^63 they give it; a double tells where it is.
    """
    near = ((n * x.astype(np.float64) - sums.astype(np.float64)) ** 2).sum(axis=1)
    wrap = np.array([s % (1 << 64) for s in sums.tolist()], dtype=np.uint64)
    y = np.uint64(n % (1 << 64)) * x.view(np.uint64) - wrap
    out: list = (y * y).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()
    for i in np.nonzero(near >= 9.2e18)[0].tolist():
        exact = sum((n * a - s) ** 2 for a, s in zip(x[i].tolist(), sums.tolist())) if near[i] < 9.3e18 else 1 << 63
        out[i] = exact if exact < 1 << 63 else None
    return out


WHITE = "vec_id long, deviation long, whitened array<double>"


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened (an array over the components), explained (too), identity_error; rows has vec_id and embedding."""
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    width, n, total, least, largest = statistics(rows)
    if not n:
        return spark.createDataFrame([], "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    middle = np.array([s // n for s in total], dtype=np.int64)
    reach = max(largest - int(middle.min()), int(middle.max()) - least)
    rest = np.array([s - n * m for s, m in zip(total, middle.tolist())], dtype=object)  # sums of w, from 0 to n - 1
    e, v, trace = components(n, scatter(rows, width, middle, n * reach * reach), rest, most)
    lives = (e > NO_VARIANCE * trace) & (e > 0)
    to = v / np.sqrt(np.where(lives, e, 1.0))
    offset = np.array([int(r) / n for r in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches, width):
            z = ((x - middle).astype(np.float64) - offset) @ to
            flat = pa.array(z.reshape(-1), mask=np.tile(~lives, len(z)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * len(e)), flat)
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(x, n, total), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    white = materialise(rows.mapInArrow(run, WHITE), "whitened")
    own = np.nonzero(lives)[0].tolist()
    pairs = [(i, j) for i in own for j in own if i <= j]
    moments = white.select(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs)).first() if pairs else []
    error = max((abs(c - (i == j)) for (i, j), c in zip(pairs, moments)), default=0.0)
    explained = F.array(*(F.lit(float(x)) for x in (e / trace if trace else np.zeros(len(e)))))
    return white.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    out = out.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def deviation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whitening: vec_id, n and the exact deviation."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).select("vec_id", "n", "deviation")


DEVIATION_ORACLE = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
x AS (SELECT vec_id, r, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding)::DOUBLE AS c FROM v),
good AS (SELECT r FROM x GROUP BY r HAVING bool_and(c IS NOT NULL AND isfinite(c))),
i AS (SELECT vec_id, r, d, floor({SCALE} * c)::HUGEINT + {SHIFT} AS x FROM x SEMI JOIN good USING (r)),
s AS (SELECT d, sum(x) AS s, count(*) AS n FROM i GROUP BY d)
SELECT vec_id, any_value(n) AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM i JOIN s USING (d) GROUP BY vec_id, r"""
