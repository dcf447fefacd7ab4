"""Whitening of embeddings by matrix-free block Lanczos.

The covariance is never formed. A pass over the vectors takes a block of directions to each partition, multiplies the
centred vectors by it and by their transpose, and sums what the partitions give, a row a dimension. The driver holds the
basis and its images, which are as long as a vector and bounded in number; it orthogonalises each new block against all of
the basis, twice, replaces directions that break down by random ones, restarts with the best Ritz vectors where the basis
is full, and ends when the residuals say so. The trace is that of the exact deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructField, StructType

from plinth.llm.common import settle

#: x = floor(SCALE c) + OFFSET; entries of which SCALE c is beyond LARGEST have no exact x.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**52
#: Entries of vectors that a task works on at a time.
ENTRIES = 1 << 19
#: Entries of the basis that the driver holds, and as many of its images, unless a few blocks need more.
BASIS = 1 << 22
#: Residual, as a share of the largest eigenvalue, at which a pair has converged; eigenvalues of a smaller share of the trace
#: than LEAST are rounding, not variance.
CLOSE, LEAST = 1e-14, 1e-11


def quantised(vectors: pa.ListArray) -> tuple[np.ndarray, pa.ListArray]:
    """Which rows remain, and their x as lists: without null and empty vectors and those with null or non-finite entries."""
    length = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    keep = length > 0
    flat, parent = vectors.flatten(), pc.list_parent_indices(vectors).to_numpy()
    values = pc.multiply(flat.cast(pa.float64()), float(SCALE)).to_numpy(zero_copy_only=False)
    good = np.isfinite(values)
    keep[parent[~good]] = False
    values, parent = values[keep[parent]], None
    if np.abs(values, out=np.empty_like(values)).max(initial=0) > LARGEST:
        raise ValueError(f"an entry of a vector is too large: {SCALE} times it must be within 2^52")
    x = np.floor(values).astype(np.int64) + OFFSET
    ends = np.concatenate([[0], np.cumsum(length[keep])])
    return keep, pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(x)).cast(pa.list_(pa.int64()))


@dataclass(frozen=True)
class Fit:
    """n vectors with sums S of x; centred vectors are (n x - S) / n, of which the numerator is a whole number."""

    n: int
    sums: tuple[int, ...]

    def gaps(self, vectors: pa.ListArray) -> np.ndarray:
        """n x - S, exactly."""
        x = vectors.flatten().to_numpy().reshape(-1, len(self.sums)) - OFFSET
        shifted = [s - self.n * OFFSET for s in self.sums]
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, shifted), default=0) >= 1 << 63:
            return x.astype(object) * self.n - np.array(shifted, object)
        return x * self.n - np.array(shifted, np.int64)

    def centred(self, gaps: np.ndarray) -> np.ndarray:
        return (gaps / self.n).astype(np.float64)


def deviations(gaps: np.ndarray) -> pa.Array:
    """Sums of squares of the rows, exactly, as decimals."""
    most = int(np.abs(gaps).max(initial=0))
    if gaps.dtype != object and most * most * max(1, gaps.shape[1]) >= 1 << 63:
        gaps = gaps.astype(object)
    total = (gaps * gaps).sum(axis=1)
    return pa.array([int(t) for t in total], pa.decimal128(38, 0)) if gaps.dtype == object else pa.array(total).cast(pa.decimal128(38, 0))


def _slices(column: pa.Array, d: int) -> Iterator[pa.Array]:
    rows = max(1, ENTRIES // max(1, d))
    for at in range(0, len(column), rows):
        yield column.slice(at, rows)


def _summed(vectors: DataFrame, columns: int, rows_of: Callable[[Iterator[pa.Array]], np.ndarray]) -> np.ndarray:
    """The sum over partitions of the matrix, of a bounded size, that ``rows_of`` makes of a partition's vectors."""
    schema = pa.schema([("row", pa.int32())] + [(f"c{i}", pa.float64()) for i in range(columns)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = rows_of(batch.column(0) for batch in batches if batch.num_rows)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made), dtype=np.int32)), *map(pa.array, np.ascontiguousarray(made.T))], schema=schema)

    sql = ", ".join(["row int", *(f"c{i} double" for i in range(columns))])
    found = vectors.select("x").mapInArrow(partial, sql).groupBy("row").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(columns))).orderBy("row").collect()
    return np.array([r[1:] for r in found], np.float64).reshape(-1, columns)


def orthonormal(candidates: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """The candidates orthogonalised against the basis and each other, twice, and how many broke down.

    One of which nothing is left but rounding is replaced by a random direction.
    """
    d, out, broken = len(candidates), basis, 0
    for v in candidates.T[: d - basis.shape[1]]:
        least = 1e-10 * scale
        while True:
            for _ in range(2):
                v = v - out @ (out.T @ v)
            if (norm := np.linalg.norm(v)) > least:
                break
            v, least, broken = rng.standard_normal(d), 1e-8, broken + 1
        v = v / norm
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :], broken


def leading_pairs(apply: Callable[[np.ndarray], np.ndarray], d: int, want: int, *, block: int = 16, most: int | None = None, close: float = CLOSE, most_passes: int = 500, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues, falling, and unit eigenvectors of the symmetric matrix that ``apply`` multiplies blocks by.

    The basis has at most ``most`` directions, by default those of BASIS entries, then it restarts with the best Ritz vectors. Pairs have converged when their
    residuals are within ``close`` of the largest eigenvalue and, unless the basis spans all, a random block added then has
    found no larger eigenvalue that the space had missed. To run out of ``most_passes`` is an error.
    """
    rng, want = np.random.default_rng(seed), min(want, d)
    most = min(d, max(most or max(BASIS // d, 4 * (want + block)), want + 3 * block))
    basis, image, confirmed = np.zeros((d, 0)), np.zeros((d, 0)), None
    new, _ = orthonormal(rng.standard_normal((d, min(block, d))), basis, 1.0, rng)
    for _ in range(most_passes):
        last = apply(new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, last])
        projected = basis.T @ image
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        top = max(abs(values[0]), np.finfo(float).tiny)
        residual = np.linalg.norm(image @ turn[:, :want] - basis @ turn[:, :want] * values[:want], axis=0)
        if basis.shape[1] == d:
            break
        # A residual can't fall under the rounding of the pass itself.
        done = basis.shape[1] >= want and residual.max() <= max(close, 8 * np.finfo(float).eps * np.sqrt(d)) * top
        if done and confirmed is not None and np.abs(confirmed - values[:want]).max() <= 1e-10 * top:
            break
        confirmed = values[:want] if done else None
        fresh = rng.standard_normal((d, block)) * top if done else last
        new, _ = orthonormal(fresh, basis, top, rng)
        if basis.shape[1] + block > most:
            keep = turn[:, : want + block]
            basis, image = basis @ keep, image @ keep
    else:
        raise RuntimeError(f"{want} pairs have not converged after {most_passes} passes: residuals up to {residual.max() / top:.1e}")
    vectors = basis @ turn[:, :want]
    vectors /= np.linalg.norm(vectors, axis=0)
    return values[:want], vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def whiten_embeddings(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, block: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each remaining vector and component.

    x = floor(64 c) + 1000000 of each entry; components are unit eigenvectors of the covariance of x over all remaining
    vectors (divisor n), numbered from 1 by falling eigenvalue e, the sign such that the entry largest in size is positive.
    ``deviation`` is the sum of (n x - S)^2, exact, as decimal(38,0); ``whitened`` the centred x projected on the component
    over sqrt(e); ``explained`` e over the trace, which is the sum of deviations over n^3; ``identity_error`` the largest
    entry, in size, of the covariance of ``whitened`` minus the identity, measured over all vectors.

    Vectors that are null, empty, or hold a null or non-finite entry are dropped; none left gives an empty result. Vectors of
    different lengths, and entries beyond 2^46, which have no exact x, are an error. Components without variance, of less
    than 10^-11 of the trace, cannot be whitened and are absent, so equal vectors alone give no row. Null and repeated ids
    pass; repeated rows count each; equal eigenvalues share a space in which any basis is right; other columns are ignored.
    A task holds ENTRIES entries and a block of directions; the driver BASIS entries of directions and as many of their
    images, or ``4 * (components + block)`` of each where those are more.
    """
    id_type = embeddings.schema[id_col].dataType
    kept_type = StructType([StructField("_pl_id", id_type), StructField("x", ArrayType(LongType()))])
    out_type = StructType([StructField("_pl_id", id_type), StructField("deviation", DecimalType(38, 0)), StructField("w", ArrayType(DoubleType()))])

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = quantised(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), x], ["_pl_id", "x"])

    vectors = settle(embeddings.select(F.col(id_col).alias("_pl_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(quantise, kept_type), "whitening-x")
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if seen["n"] and seen["low"] != seen["high"]:
        raise ValueError(f"vectors have from {seen['low']} to {seen['high']} entries")
    n, d = seen["n"], seen["high"] or 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, np.int64)
        for batch in batches:
            for x in _slices(batch.column(0), d):
                total = total + x.flatten().to_numpy().reshape(-1, d).sum(axis=0, dtype=np.int64)
                if np.abs(total).max(initial=0) > 1 << 61:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], ["dim", "s"])
                    total = np.zeros(d, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], ["dim", "s"])

    by_dim = vectors.select("x").mapInArrow(sums, "dim int, s long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    fit = Fit(n, tuple(int(r["s"]) for r in by_dim) if n else ())

    def covariance_times(q: np.ndarray) -> np.ndarray:
        def product(columns: Iterator[pa.Array]) -> np.ndarray:
            out = np.zeros(q.shape)
            for column in columns:
                for x in _slices(column, d):
                    centred = fit.centred(fit.gaps(x))
                    out += centred.T @ (centred @ q)
            return out

        return _summed(vectors, q.shape[1], product) / n

    def total_deviation() -> int:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(int(pc.sum(deviations(fit.gaps(x))).as_py() or 0) for batch in batches for x in _slices(batch.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.decimal128(38, 0))], ["total"])

        return int(vectors.select("x").mapInArrow(partial, "total decimal(38,0)").agg(F.sum("total")).first()[0])

    values, axes, trace = np.zeros(0), np.zeros((d, 0)), 0.0
    if n and (whole := total_deviation()):
        trace = whole / n**3
        values, axes = leading_pairs(covariance_times, d, components, block=block)
        real = values > LEAST * trace
        values, axes = values[real], axes[:, real]
    over = axes / np.sqrt(values) if len(values) else axes

    def second_moments(columns: Iterator[pa.Array]) -> np.ndarray:
        out = np.zeros((len(values), len(values) + 1))
        for column in columns:
            for x in _slices(column, d):
                w = fit.centred(fit.gaps(x)) @ over
                out[:, :-1] += w.T @ w
                out[:, -1] += w.sum(axis=0)
        return out

    error = 0.0
    if len(values):
        moments = _summed(vectors, len(values) + 1, second_moments) / n
        error = float(np.abs(moments[:, :-1] - np.outer(moments[:, -1], moments[:, -1]) - np.eye(len(values))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _slices(batch.column(1), d):
                gaps = fit.gaps(x)
                w = fit.centred(gaps) @ over
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(w)), deviations(gaps), rows], ["_pl_id", "deviation", "w"])
                at += len(w)

    explained = F.lit([float(v / trace) for v in values]) if len(values) else F.array().cast("array<double>")
    rows = vectors.mapInArrow(project, out_type) if len(values) else vectors.sparkSession.createDataFrame([], out_type)
    return rows.select("_pl_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        F.col("_pl_id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
