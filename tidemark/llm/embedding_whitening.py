"""Whitening of embeddings by principal components, without ever forming their covariance matrix.

Vectors become integers (floor(SCALE * entry) + SHIFT), and each distinct integer vector is fitted once. The
leading eigenvectors of the covariance V come from block subspace iteration: one Spark pass over the fit list
computes V Q = X'(X Q) / n for a block Q of OVERSAMPLING columns a component, on rows that are centred first, and sends only that
product (as many numbers as Q has, for each partition, summed by Spark before the driver sees them). The driver
orthonormalizes by QR and takes the Ritz vectors of the blocks so far, whose products it has; when RESTART blocks are
held, it goes on from the best of them. A pass with the Ritz vectors themselves gives their residuals
|V q - e q|; iteration ends when these certify all components, or have stopped falling below what double precision allows.

Sums and deviations are exact integers. Vectors that occur often weigh like others: once. The dimension is that of most rows (the
larger one of several); other rows are dropped, like those with null or non-finite entries, or entries whose
integer would not fit 32 bits. Components whose eigenvalue is null (within 1e-12 of the largest) can't be scaled to
one and are left out, so there may be fewer than asked for: none of one distinct vector. Null vec_ids and repeated rows are kept, row
by row; extra columns are ignored; an empty table gives no rows. A deviation over 2**63 - 1 is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Columns of a block, as a multiple of the components, and blocks held before a restart.
OVERSAMPLING, RESTART = 2, 6
#: Residuals, as a share of the largest eigenvalue, that certify a component; and the rounds after which there is an error.
TOLERANCE, MOST_PASSES = 1e-13, 400
#: Residuals that no longer fall are those of double precision if they are below this.
ROUNDING = 1e-11
SEED = 20250607
#: Vectors of a partition of the fit list are taken in batches of so many numbers.
BATCH_NUMBERS = 1 << 21


def integer_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """rows (vec_id, embedding) -> vec_id, x: the usable rows, with x as little-endian 32-bit integers less SHIFT."""

    def run(batches):
        for batch in batches:
            part = batch.column(column)
            sizes = part.value_lengths().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(part.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE)
            fits = np.abs(x) < 2**31 - SHIFT  # false for null (NaN), NaN and infinite entries
            edges = np.concatenate([[0], np.cumsum(np.nan_to_num(sizes).astype(np.int64))])
            bad = np.concatenate([[0], np.cumsum(~fits)])
            usable = np.flatnonzero((bad[edges[1:]] == bad[edges[:-1]]) & part.is_valid().to_numpy(zero_copy_only=False))
            ints = np.where(fits, x, 0).astype("<i4")
            values = pa.array([ints[edges[i] : edges[i + 1]].tobytes() for i in usable], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(usable)), values], names=["vec_id", "x"])

    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias(column)).where(F.col(column).isNotNull())
    return given.mapInArrow(run, "vec_id long, x binary")


def _matrices(batches, dimension: int):
    """The vectors of some rows at a time, as rows of int64, SHIFT included, and the rows' batch."""
    for batch in batches:
        step = max(1, BATCH_NUMBERS // max(dimension, 1))
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            data = b"".join(part.column("x").to_pylist())
            yield part, np.frombuffer(data, "<i4").reshape(part.num_rows, dimension).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Centre:
    """Number and sums of the fit list's vectors."""

    dimension: int
    n: int
    sums: tuple[int, ...]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if self.n * int(np.abs(x).max(initial=0)) >= 2**62:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, from the exact difference."""
        return self.scaled(x).astype(np.float64) / self.n


@dataclass(frozen=True)
class Fit:
    """The fit list: a written table of distinct vectors x, their centre, and the trace of their covariance."""

    table: DataFrame
    centre: Centre
    trace: float


def _summed(table: DataFrame, per_batch, width: int, kind: str) -> list:
    """Sums over the table of per_batch(batch, matrix), an array of `width` numbers: added up within tasks, then by place."""

    def run(batches):
        total = None
        for value in per_batch(batches):
            total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["v"])

    parts = table.mapInArrow(run, f"v array<{'bigint' if kind == 'long' else 'double'}>")
    summed = parts.select(F.posexplode("v").alias("place", "part")).groupBy("place").agg(F.sum("part").alias("total")).collect()
    out = [0] * width
    for r in summed:
        out[r["place"]] = r["total"]
    return out


def fit_list(vectors: DataFrame) -> Fit:
    """vectors (x), best a written table -> the distinct ones of the dimension that most have."""
    sizes = vectors.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    table = materialize(vectors.where(F.octet_length("x") == size).select("x").distinct())
    n, d = table.count(), size // 4
    if not d:
        return Fit(table, Centre(0, n, ()), 0.0)
    centre = Centre(d, n, tuple(_summed(table, lambda batches: (x.sum(axis=0) for _, x in _matrices(batches, d)), d, "long")))
    (squares,) = _summed(table, lambda batches: (np.array([np.square(centre.centred(x)).sum()]) for _, x in _matrices(batches, d)), 1, "double")
    return Fit(table, centre, squares / n)


def product(fit: Fit, q: np.ndarray) -> np.ndarray:
    """V q, in one pass over the fit list."""
    centre = fit.centre

    def run(batches):
        for _, x in _matrices(batches, centre.dimension):
            c = centre.centred(x)
            yield (c.T @ (c @ q)).ravel()

    return np.array(_summed(fit.table, run, q.size, "double")).reshape(q.shape) / centre.n


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of the block's span that is new to the basis, as orthonormal columns."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(s.max(initial=0), 1e-300)]
    return np.linalg.qr(block)[0]


def components(fit: Fit, k: int = COMPONENTS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, residuals as shares of the largest eigenvalue), k or fewer."""
    d = fit.centre.dimension
    wanted = min(k, d, max(fit.centre.n - 1, 0))
    if not wanted or fit.trace <= 0:
        return np.zeros(0), np.zeros((d, 0)), np.zeros(0)
    width, none = min(d, OVERSAMPLING * k), np.zeros((d, 0))
    q = np.linalg.qr(np.random.RandomState(SEED).standard_normal((d, width)))[0]
    basis, images, best = none, none, np.inf
    for _ in range(MOST_PASSES):
        certifies = not basis.shape[1]  # this pass is made with the Ritz vectors themselves (or, at first, with any)
        basis, images = np.hstack([basis, q]), np.hstack([images, product(fit, q)])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, ritz_images = basis @ turns[:, :width], images @ turns[:, :width]
        rest = ritz_images - ritz * values[:width]
        residuals = np.linalg.norm(rest, axis=0)[:wanted] / max(values[0], 1e-300)
        worst = residuals.max()
        if certifies:
            if worst <= tolerance or best / 2 < worst <= ROUNDING:
                real = values[:wanted] > 1e-12 * values[0]
                return values[:wanted][real], ritz[:, :wanted][:, real], residuals[real]
            best = min(best, worst)
        fresh = _orthonormal(rest, basis)
        if not fresh.shape[1] or worst <= (tolerance if certifies else ROUNDING):
            basis, images, q = none, none, np.linalg.qr(ritz)[0]
        elif basis.shape[1] < RESTART * width:
            q = fresh
        else:  # go on from the best directions so far, with their products
            basis, images = basis @ turns[:, : 2 * width], images @ turns[:, : 2 * width]
            q = _orthonormal(rest, basis)
    raise ArithmeticError(f"residuals stay at {best} of the largest eigenvalue")


def whiten(rows: DataFrame, k: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """rows (vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error, residual."""
    vectors = materialize(integer_vectors(rows, column))
    fit = fit_list(vectors)
    centre = fit.centre
    values, axes, residuals = components(fit, k)
    count = len(values)
    project = axes / np.sqrt(values) if count else axes
    explained = values / fit.trace if count else values

    def moments(batches):
        for _, x in _matrices(batches, centre.dimension):
            w = centre.centred(x) @ project
            yield np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    error = 0.0
    if count:
        sums = np.array(_summed(fit.table, moments, count + count * count, "double")) / centre.n
        error = float(np.abs(sums[count:].reshape(count, count) - np.outer(sums[:count], sums[:count]) - np.eye(count)).max())

    def run(batches):
        for batch, x in _matrices(batches, centre.dimension):
            m = batch.num_rows
            scaled = centre.scaled(x)
            if scaled.dtype == object or int(np.abs(scaled).max(initial=0)) ** 2 * centre.dimension >= 2**63:
                exact = [sum(v * v for v in map(int, row)) for row in scaled]
                deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            else:
                deviation = pa.array(np.square(scaled).sum(axis=1), pa.int64())
            whitened = centre.centred(x) @ project
            place = np.repeat(np.arange(m), count)
            columns = [batch.column("vec_id").take(pa.array(place)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, centre.n)), deviation.take(pa.array(place)), pa.array(whitened.ravel())]
            columns += [pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error)), pa.array(np.tile(residuals, m))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    usable = vectors.where(F.octet_length("x") == 4 * centre.dimension) if count else vectors.where(F.lit(False))
    return usable.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double")


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
