"""Whitening of embeddings by the leading components of their covariance.

The eigenvectors come from subspace iteration with a Chebyshev filter. A block of directions is multiplied by the covariance
again and again, each time in one distributed pass that sends (x - mean) times its products with the block; the three-term
recurrence of the Chebyshev polynomials damps the part of the spectrum below the smallest value of the block and lets the
rest grow. Then QR and a Rayleigh-Ritz step in the block give eigenvalues and vectors, until their residuals are at rounding
(``TOLERANCE`` times the largest eigenvalue): that is the certificate. Between two passes only a matrix of dimensions
times block is on the driver; the covariance itself is never formed.

The fit list (every distinct vector once) is stored in packed blocks of whole numbers of the smallest fitting width, so a
pass reads little; a lost executor costs a re-read. Sums, trace and deviations are exact.

Defined cases: rows whose vector is NULL, or holds NULL, a component that is not finite or one beyond the range of a
whole number, go, as do empty vectors and vectors of another length than the most frequent one (of equally frequent
lengths the longest counts). NULL ids and repeated rows stay. A component whose eigenvalue is zero (fewer distinct vectors
than components, constant dimensions) has whitened NULL and explained 0 (NULL if the trace is zero); a deviation beyond a
long is NULL. Ties between eigenvalues give any basis of their space. Texts and other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import ship
from threadlens.sources.sinks import store

#: Largest residual of a certified component, relative to the largest eigenvalue.
TOLERANCE = 2e-14
#: An eigenvalue below this share of the largest is zero.
ZERO = 1e-12
#: Vectors of a packed block.
PACKED = 4096


def whole_vectors(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``x``, the vector times ``scale`` rounded down to whole numbers, of the rows that stay."""
    doubles = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), doubles.alias("vector")).where("vector IS NOT NULL AND size(vector) > 0")
    fits = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) * scale < float(1 << 62)), F.lit(False)))
    rows = rows.where(fits).select("id", F.transform("vector", lambda v: F.floor(v * scale).cast("long")).alias("x"))
    length = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("x") == (length["length"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_list(rows: DataFrame) -> DataFrame:
    """Every distinct x once, packed: ``n`` vectors, ``width`` bytes a number, ``numbers``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                part = _matrix(batch.column(0).slice(at, PACKED))
                width = next(w for w in (2, 4, 8) if w == 8 or np.abs(part).max() < 1 << (8 * w - 1))
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([width], pa.int32()), pa.array([part.astype(f"<i{width}").tobytes()], pa.binary())], ["n", "width", "numbers"])

    return store(rows.select("x").distinct().mapInArrow(pack, "n long, width int, numbers binary"), "fit-list")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, width, numbers in zip(*[c.to_pylist() for c in batch.columns]):
            yield np.frombuffer(numbers, f"<i{width}").reshape(n, -1)


def summed(packed: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part(x)`` (a matrix) over all packed blocks.

    Each task adds up its blocks; the sums of tasks are added up in about as many tasks as the root of the number of
    files, and what these send (a matrix each) meets here.
    """

    def added(matrices: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for more in matrices:
            total = more if total is None else total + more
        if total is not None:
            shape = [pa.array([k], pa.int32()) for k in total.shape]
            yield pa.RecordBatch.from_arrays([*shape, pa.array([total.tobytes()], pa.binary())], ["rows", "columns", "numbers"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(part(x) for x in _unpacked(batches))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(np.frombuffer(n).reshape(r, c) for b in batches for r, c, n in zip(*[c.to_pylist() for c in b.columns]))

    schema = "rows int, columns int, numbers binary"
    groups = max(1, isqrt(len(packed.inputFiles())))
    sums = packed.mapInArrow(first, schema).repartition(groups).mapInArrow(second, schema)
    return np.sum([np.frombuffer(r.numbers).reshape(r.rows, r.columns) for r in sums.collect()], axis=0)


def exact_sums(packed: DataFrame) -> tuple[int, list[int], list[int]]:
    """Number of vectors, and per dimension the sum and the sum of squares, as exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _unpacked(batches):
            wide = x.astype(np.int64)
            exact = float(np.abs(wide).max()) ** 2 * len(wide) < 2.0**62
            squares = (wide**2).sum(axis=0).tolist() if exact else (wide.astype(object) ** 2).sum(axis=0).tolist()
            sums = wide.sum(axis=0).tolist() if exact else wide.astype(object).sum(axis=0).tolist()
            values = [pa.array([str(v) for v in c]) for c in (sums, squares)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(np.full(len(sums), len(wide))), *values], ["row", "n", "s", "q"])

    found = packed.mapInArrow(run, "row long, n long, s string, q string").groupBy("row").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("q").cast("decimal(38,0)")).alias("q"))
    rows = found.orderBy("row").collect()
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows], [int(r["q"]) for r in rows]


def chebyshev(multiply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """``block`` filtered by the Chebyshev polynomial that is small on [0, cut], scaled to stay near one at ``top``."""
    half = cut / 2
    first = sigma = half / (top - half)
    now = (multiply(block) - half * block) * (sigma / half)
    before = block
    for _ in range(degree - 1):
        grown = 1 / (2 / first - sigma)
        now, before = (multiply(now) - half * now) * (2 * grown / half) - sigma * grown * before, now
        sigma = grown
    return now


@dataclass
class Whitening:
    """Mean, unit eigenvectors (columns), eigenvalues and trace of the fit list's covariance, and the certificate."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float = 0.0
    passes: int = 0
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; a component of no variance gives NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = np.where(self.values > 0, self.vectors / np.sqrt(np.where(self.values > 0, self.values, 1)), np.nan)
        return (x - self.mean) @ scaled


def fit_whitening(packed: DataFrame, components: int = 4, block: int | None = None, degree: int = 12, cycles: int = 30) -> Whitening | None:
    """Leading components of the packed fit list; None if it is empty. Raises if the residuals do not come down."""
    n, sums, squares = exact_sums(packed)
    if not n:
        return None
    size = len(sums)
    trace = sum((n * q - s * s) / (n * n) for s, q in zip(sums, squares))
    kept = min(components, size)
    width = min(size, block or 4 * kept + 16)
    fit = Whitening(n, sums, np.eye(size)[:, :kept], np.zeros(kept), trace)
    if trace == 0:
        return fit
    mean = fit.mean

    def multiply(block: np.ndarray) -> np.ndarray:
        fit.passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return summed(packed, part) / n

    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((size, width)))[0]
    for _ in range(cycles):
        image = multiply(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = basis @ turn, image @ turn
        fit.residual = float(np.linalg.norm(image[:, :kept] - vectors[:, :kept] * values[:kept], axis=0).max() / values[0])
        if fit.residual <= TOLERANCE:
            break
        if values[-1] <= ZERO * values[0]:
            # The block holds the whole range of the covariance: its image spans it.
            live = values > ZERO * values[0]
            basis = np.linalg.qr(np.concatenate([image[:, live], vectors[:, ~live]], axis=1))[0]
        else:
            basis = np.linalg.qr(chebyshev(multiply, vectors, float(values[-1]), float(values[0]), degree))[0]
    else:
        raise ArithmeticError(f"residual {fit.residual:.1e} after {cycles} cycles")
    leading = vectors[:, :kept]
    signs = np.sign(leading[np.abs(leading).argmax(axis=0), np.arange(kept)])
    fit.vectors = leading * signs
    fit.values = np.where(values[:kept] > ZERO * values[0], values[:kept], 0.0)
    return fit


def identity_error(packed: DataFrame, fit: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity, over components with variance."""
    live = np.flatnonzero(fit.values > 0)
    if not len(live):
        return None
    sums = summed(packed, lambda x: np.concatenate([(z := fit.project(x)[:, live]).T @ z, z.sum(axis=0)[None, :]])) / fit.n
    return float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(live))).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S) squared, exact; None beyond a long."""
    reach = n * float(np.abs(x).max(initial=0)) + max(abs(s) for s in sums)
    if reach**2 * len(sums) < 2.0**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` of every remaining row and component.

    ``residual`` and ``passes`` tell the certificate: the largest relative residual, and the passes over the fit list.
    """
    ship(df.sparkSession)
    rows = whole_vectors(df, scale, id_col, vector_col)
    packed = fit_list(rows)
    fit = fit_whitening(packed, components)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double, passes int"
    if fit is None:
        return df.sparkSession.createDataFrame([], schema)
    fit.identity_error = identity_error(packed, fit)
    explained = [float(v) / fit.trace if fit.trace else None for v in fit.values]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, kept = _matrix(batch.column(1)), len(fit.values)
            white = fit.project(x).ravel()
            each = pa.array(np.repeat(np.arange(len(x)), kept))
            same = [pa.array([v] * len(white), t) for v, t in ((fit.identity_error, pa.float64()), (fit.residual, pa.float64()), (fit.passes, pa.int32()))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(len(white), fit.n)),
                pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(each), pa.array(white, mask=np.isnan(white)),
                pa.array(explained * len(x), pa.float64()), *same], names)

    return rows.mapInArrow(run, schema)
