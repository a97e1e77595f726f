"""Embedding whitening (13): covariances by polarisation, then eigenvectors.

Entries become integers ``x = floor(scale * c) + offset``. With ``S`` the sums of ``x``
over the ``n`` vectors, ``y = n * x - S`` is centred and still an integer, and

    2 cov(i, j) = var(i + j) - var(i) - var(j)

so the squares of ``y`` for each dimension and of ``y_i + y_j`` for each pair of
dimensions give every covariance. All of them are integers and are summed exactly:
tasks add up their rows, split at ``2**60`` so that sums fit decimals, and Spark adds up
the tasks. What reaches the driver is one row a pair of dimensions, however many vectors
there are; the matrix is divided once, in fractions, and given to ``eigh``. Rows meet
the components in a second pass over the vectors, and the whitened columns are measured
for their covariance from what that pass wrote.

Squares are taken in 64 bits while they are known to fit, by halves of 24 bits beyond,
and by Python integers beyond ``2**47``.

Defined results: vectors that are null or hold null or non-finite entries give no row;
an empty vector and one shorter than the longest go on with zeros; entries beyond
``2**52 / scale`` are taken as that bound; rows that repeat an id are vectors each; a
component without variance whitens to null and explains 0; with fewer dimensions than
components all of them are returned; an empty table gives no rows; other columns are
not used.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomline.session import stage

SPLIT = 60  # sums of squares are kept as high * 2**SPLIT + low
PLAIN, HALVES = 1 << 26, 1 << 47  # largest values squared in 64 bits as they are, and by halves
ROWS = 512  # rows of a block; its sums of squares fit 64 bits
BOUND = 1 << 52


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``n`` vectors with sums ``sums``; a column of ``vectors`` is a
    component of variance ``variances``; ``trace`` is the sum of all variances."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    scale: int
    offset: int


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(vectors: pa.Array, width: int, scale: int, offset: int) -> np.ndarray:
    """Rows of ``floor(scale * c) + offset``, with zeros for entries that a row lacks."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        c = flat.reshape(len(lengths), width)
    else:
        c = np.zeros((len(lengths), width))
        c[np.arange(width) < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * scale), -BOUND, BOUND).astype(np.int64) + offset


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - S`` exactly; Python integers where 64 bits might not hold it."""
    largest = int(np.abs(x).max(initial=0))
    if n * largest + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def square_sums(values: np.ndarray) -> list[int]:
    """Exact sums of squares by column, of at most ``ROWS`` rows."""
    if values.dtype == object:
        return (values * values).sum(axis=0).tolist()
    largest = int(np.abs(values).max(initial=0))
    if largest <= PLAIN:
        return np.einsum("ij,ij->j", values, values).tolist()
    if largest > HALVES:
        return square_sums(values.astype(object))
    high, low = values >> 24, values & 0xFFFFFF
    parts = [np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(a << 48) + (b << 25) + c for a, b, c in zip(*parts)]


def pair_squares(y: np.ndarray) -> list[int]:
    """Sums of squares of each column, then of each sum of two columns ``i < j``."""
    total = square_sums(y)
    for i in range(y.shape[1] - 1):
        total += square_sums(y[:, i:i + 1] + y[:, i + 1:])
    return total


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([decimal.Decimal(v) for v in values], pa.decimal128(38, 0))


def _added(rows: DataFrame, key: str, columns: list[str]) -> list:
    added = rows.groupBy(key).agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in columns])
    return sorted(added.collect())  # one row a dimension or pair of dimensions


def fit(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000) -> Whitening | None:
    """Components of ``vectors(vec_id, vector)``, usable ones only; None without rows."""
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = facts["n"], facts["width"]
    if not n or not width:
        return None

    def sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # 256 sums of 2**53 fit 64 bits
                x = integers(batch.column(0).slice(at, 256), width, scale, offset)
                total = [t + s for t, s in zip(total, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), _decimals(total)], ["i", "s"])

    sums = tuple(int(r["s"]) for r in _added(
        vectors.select("vector").mapInArrow(sum_rows, "i int, s decimal(38,0)"), "i", ["s"]))

    def square_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width * (width + 1) // 2)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = centred(integers(batch.column(0).slice(at, ROWS), width, scale, offset), n, sums)
                total = [t + s for t, s in zip(total, pair_squares(y))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), _decimals([t >> SPLIT for t in total]),
             _decimals([t & ((1 << SPLIT) - 1) for t in total])], ["i", "high", "low"])

    squares = [(int(r["high"]) << SPLIT) + int(r["low"]) for r in _added(
        vectors.select("vector").mapInArrow(square_rows, "i int, high decimal(38,0), low decimal(38,0)"),
        "i", ["high", "low"])]
    cov = covariances(squares, width, n)
    values, found = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    kept = found[:, order]
    largest = np.abs(kept).argmax(axis=0)
    kept = kept * np.where(kept[largest, np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(Fraction(sum(squares[:width]), n ** 3))
    none = trace * width * np.finfo(float).eps
    return Whitening(n, sums, kept, np.where(values[order] > none, values[order], 0.0), trace, scale, offset)


def covariances(squares: list[int], width: int, n: int) -> np.ndarray:
    """The matrix from the sums of squares of dimensions and of pairs, each entry divided once."""
    cov = np.empty((width, width))
    own, pairs = squares[:width], iter(squares[width:])
    for i in range(width):
        cov[i, i] = Fraction(own[i], n ** 3)
        for j in range(i + 1, width):
            cov[i, j] = cov[j, i] = Fraction(next(pairs) - own[i] - own[j], 2 * n ** 3)
    return cov


def apply(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened``: the exact sum of squares of the centred entries,
    and an array of the components."""
    width, n = len(fitted.sums), fitted.n
    with np.errstate(divide="ignore"):
        weights = np.where(fitted.variances > 0, 1 / np.sqrt(fitted.variances), np.nan)
    projection = fitted.vectors * weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                y = centred(integers(some.column(1), width, fitted.scale, fitted.offset), n, fitted.sums)
                z = (y / n).astype(np.float64) @ projection
                deviation = square_sums(np.ascontiguousarray(y.T))
                flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
                offsets = pa.array(np.arange(0, z.size + 1, max(z.shape[1], 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), _decimals(deviation), pa.ListArray.from_arrays(offsets, flat)],
                    ["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "vector").mapInArrow(
        run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the covariance of the whitened columns less the identity."""
    live = np.nonzero(fitted.variances > 0)[0].tolist()
    pairs = [(i, j) for i in live for j in live if i <= j]
    if not pairs:
        return 0.0
    at = lambda k: F.get("whitened", F.lit(k))
    means = whitened.agg(*[F.avg(at(k)).alias(f"m{k}") for k in live]).first()
    products = whitened.agg(*[F.avg((at(i) - means[f"m{i}"]) * (at(j) - means[f"m{j}"])).alias(f"p{i}_{j}")
                              for i, j in pairs]).first()
    return max(abs(products[f"p{i}_{j}"] - (i == j)) for i, j in pairs)


WHITENED = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
            "explained double, identity_error double")


def whiten(rows: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000,
           vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row a vector and component."""
    spark = rows.sparkSession
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    fitted = fit(vectors, components, scale, offset)
    if fitted is None:
        return spark.createDataFrame([], WHITENED)
    written = stage(apply(vectors, fitted), "whitened")
    error = identity_error(written, fitted)
    share = [float(v / fitted.trace) if fitted.trace else 0.0 for v in fitted.variances]
    shares = F.array(*[F.lit(s) for s in share])
    return written.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"),
        "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
