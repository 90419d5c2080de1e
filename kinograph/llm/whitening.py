"""Whitening of embeddings: components of their covariance, in compensated arithmetic.

Entries become integers floor(scale * c) + shift, so that counts and sums are exact and a large shift would
ruin a covariance from uncentred moments. Three passes over the vectors:

1. exact sums and extremes per dimension, one row a task;
2. the covariance. Each row is centred first, x - S / n as an exact fraction in two doubles, then split
   without error into three slices of few bits (their sum is the centred value to 2^-60 of the largest
   one). The products of the two upper slices over a block of rows are sums of integers below 2^53,
   so a matrix product returns the block's sum of outer products exactly: an error-free transformation of the product,
   as two-sum is of the addition that adds it to a pair (high, low). Tasks hand on their pairs; they are merged, high and low parts alike, in two rounds;
3. the rows projected, and the same accumulation over the whitened rows, which gives how far they are from white.

The eigen-solve is of one dimension x dimension matrix on the driver: reduced to tridiagonal form and solved by
divide and conquer (LAPACK's syevd, behind ``numpy.linalg.eigh``), then refined in extended precision with the low parts,
so that vectors are right to double precision. What a task sends on has dimension^2 numbers, whatever it read.

Cases: vectors that are null or hold null or non-finite entries take no part, nor do those with an entry of
2^40 or more (no exact integer) or of another length than most (ties: than the shortest of the frequent lengths); vectors of length
0, or no vector at all, give no rows. Repeated rows count as often as they occur and come back as often; null ids stay. Components
whose variance is zero to rounding cannot be scaled and are left out. ``deviation`` is null where the exact sum exceeds 64 bits.
Only the id and the vector are read, so other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import give_back

#: Rows of a block; bits of a slice, so that a block's products sum up below 2^53 in steps of the slices' last bits.
BLOCK, SLICE_BITS = 2048, 20
#: Largest absolute entry that becomes an integer.
LARGEST = 2.0**40
SUMS = "n long, sums array<decimal(38,0)>, low array<long>, high array<long>"
PAIRS = "n long, high array<double>, low array<double>"


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and the error: their sum is a + b exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(total: tuple[np.ndarray, np.ndarray], high: np.ndarray, low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A pair plus a pair, as a pair."""
    s, e = two_sum(total[0], high)
    return two_sum(s, e + (total[1] + low))


def slices(high: np.ndarray, low: np.ndarray, top: int) -> list[np.ndarray]:
    """Three arrays that add up to high + low, of absolute value 2^top at most; the first two have SLICE_BITS bits each."""
    out, rest = [], high
    for k in (1, 2):
        big = math.ldexp(0.75, top - SLICE_BITS * k + 53)
        part = (rest + big) - big
        out.append(part)
        rest = rest - part
    return [*out, rest + low]


def outer_sum(total: tuple[np.ndarray, np.ndarray], high: np.ndarray, low: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """A pair of matrices plus the sum of the outer products of rows (high + low)."""
    a, b, c = slices(high, low, top)
    ab, ac = a.T @ b, a.T @ c
    for exact in (a.T @ a, ab, ab.T, b.T @ b):
        total = add(total, exact)
    bc = b.T @ c
    return add(total, ac + ac.T + bc + bc.T)  # below 2^-40 of the first product: rounding them doesn't show


@dataclass(frozen=True)
class Fit:
    """What the fit list says: exact counts and sums, and the components with their variances, largest first."""

    n: int
    sums: np.ndarray
    top: int
    components: np.ndarray
    variances: np.ndarray
    trace: float
    scale: int
    shift: int

    def __post_init__(self):
        floors = [int(s) // self.n for s in self.sums]
        object.__setattr__(self, "floor", np.array(floors, np.int64))
        object.__setattr__(self, "rest", np.array([int(s) - self.n * f for s, f in zip(self.sums, floors)], np.int64))

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S / n as the nearest doubles and what they leave out."""
        return two_sum((x - self.floor).astype(np.float64), -self.rest / self.n)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - S)^2 per row, exactly; null if 64 bits can't hold it."""
        near = np.square(self.n * self.centred(x)[0]).sum(axis=1)
        fits = near < 2.0**63 - 2.0**20
        exact = self.n * np.where(fits[:, None], x - self.floor, 0) - np.where(fits[:, None], self.rest, 0)
        return pa.array(np.square(exact).sum(axis=1), mask=~fits)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centred(x)
        return (high @ self.components.T + low @ self.components.T) / np.sqrt(self.variances)


def blocks(batches: Iterator[pa.RecordBatch], scale: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as integers, a row each."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            vectors = part.column("vector")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield part, np.floor(scale * flat).astype(np.int64).reshape(len(vectors), -1) + shift


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, but for their length."""
    vector = F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), vector.cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < LARGEST)))


def exact_sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, np.ndarray, int]:
    """Number of rows, sums per dimension, and the power of two that no centred entry exceeds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, None, None, None
        for _, x in blocks(batches, scale, shift):
            if n == 0:
                sums, low, high = np.zeros(x.shape[1], object), x[0], x[0]
            n += len(x)
            sums = sums + x.sum(axis=0)
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[f"{s}" for s in sums]]), pa.array([low.tolist()]), pa.array([high.tolist()])], ["n", "sums", "low", "high"])
        give_back()

    found = rows.mapInArrow(count, SUMS.replace("decimal(38,0)", "string"))
    places = found.select("n", F.posexplode(F.arrays_zip(F.col("sums").cast("array<decimal(38,0)>").alias("s"), F.col("low").alias("l"), F.col("high").alias("h"))).alias("i", "v"))
    merged = places.groupBy("i").agg(F.sum("n").alias("n"), F.sum("v.s").alias("s"), F.min("v.l").alias("l"), F.max("v.h").alias("h")).orderBy("i").collect()  # a row per dimension
    if not merged:
        return 0, np.zeros(0, object), 0
    return merged[0]["n"], np.array([int(r["s"]) for r in merged], object), max(1, max(r["h"] - r["l"] for r in merged)).bit_length()


def pairs_of(batches: Iterator[pa.RecordBatch], dims: int, rows_of) -> Iterator[pa.RecordBatch]:
    """One row: the number of rows and the pair of sums of their outer products; ``rows_of`` gives (high, low, top) of a block of integers."""
    n, total = 0, (np.zeros((dims, dims)), np.zeros((dims, dims)))
    for x in batches:
        high, low, top = rows_of(x)
        n, total = n + len(x), outer_sum(total, high, low, top)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([m.ravel()]) for m in total]], ["n", "high", "low"])
    give_back()


def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for size, high, low in zip(batch.column("n").to_pylist(), batch.column("high"), batch.column("low")):
            high, low = high.values.to_numpy(), low.values.to_numpy()
            n, total = n + size, (high, low) if total is None else add(total, high, low)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([m]) for m in total]], ["n", "high", "low"])


def summed(pairs: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The tasks' pairs merged in two rounds; dims x dims numbers come to the driver."""
    few = pairs.repartition(16).mapInArrow(merge_pairs, PAIRS)
    (row,) = few.coalesce(1).mapInArrow(merge_pairs, PAIRS).collect()
    return np.array(row["high"]).reshape(dims, dims), np.array(row["low"]).reshape(dims, dims)


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix given in two parts, largest first, and unit eigenvectors as rows, largest entry positive."""
    values, vectors = np.linalg.eigh(high)
    whole = high.astype(np.longdouble) + low
    x = vectors.astype(np.longdouble)
    for _ in range(2):  # refine in extended precision; each round squares the error
        r, s = np.eye(len(x), dtype=np.longdouble) - x.T @ x, x.T @ whole @ x
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > 1e-9 * np.abs(e).max()  # within a cluster any basis is as good
        x = x + x @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = (x / np.sqrt((x * x).sum(axis=0))).T[::-1]
    top = x[np.arange(len(x)), np.abs(x).argmax(axis=1)]
    return e[::-1].astype(np.float64), (x * np.sign(top)[:, None]).astype(np.float64)


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, Fit | None]:
    """The rows that take part, and their fit; None if there are none."""
    rows = usable(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None or lengths["dims"] == 0:
        return rows, None
    dims = lengths["dims"]
    rows = rows.where(F.size("vector") == dims)
    n, sums, top = exact_sums(rows, scale, shift)
    plain = Fit(n, sums, top, np.zeros((0, dims)), np.zeros(0), 0.0, scale, shift)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pairs_of((x for _, x in blocks(batches, scale, shift)), dims, lambda x: (*plain.centred(x), top))

    high, low = summed(rows.mapInArrow(outer, PAIRS), dims)
    cov = high.astype(np.longdouble) + low
    cov = (cov + cov.T) / (2 * n)
    values, vectors = eigen(cov.astype(np.float64), (cov - cov.astype(np.float64)).astype(np.float64))
    trace = float(np.trace(cov))
    kept = [i for i in range(min(components, dims)) if values[i] > dims * np.finfo(float).eps * trace]
    return rows, Fit(n, sums, top, vectors[kept], values[kept], trace, scale, shift)


def identity_error(rows: DataFrame, fitted: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; rows are centred before they are projected."""
    k = len(fitted.variances)
    top = (fitted.top + 1 + math.ceil(math.log2(math.sqrt(len(fitted.sums)) / math.sqrt(fitted.variances[-1])))) if k else 0

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whitened = lambda x: (fitted.whitened(x), np.zeros((len(x), k)), top)
        yield from pairs_of((x for _, x in blocks(batches, fitted.scale, fitted.shift)), k, whitened)

    high, low = summed(rows.mapInArrow(outer, PAIRS), k)
    return float(np.abs((high + low) / fitted.n - np.eye(k)).max())


OUT = "id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row per vector that takes part and component: (``id_col``, component, n, deviation, whitened, explained, identity_error)."""
    rows, fitted = fit(df, id_col, vector_col, components, scale, shift)
    schema = OUT.format(id=rows.schema["id"].dataType.simpleString())
    k = len(fitted.variances) if fitted else 0
    if k == 0:
        return rows.where("false").select(F.col("id").alias(id_col), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")[1:]])
    error = identity_error(rows, fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, fitted.scale, fitted.shift):
            at = np.repeat(np.arange(len(x)), k)
            each = lambda values: pa.array(np.tile(values, len(x)))
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(at)), each(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(at), fitted.n)), fitted.deviation(x).take(pa.array(at)), pa.array(fitted.whitened(x).ravel()), each(fitted.variances / fitted.trace), pa.array(np.full(len(at), error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )
        give_back()

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)
