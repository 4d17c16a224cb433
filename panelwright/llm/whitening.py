"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a matrix-free block Lanczos.

The covariance V is never formed. A pass over the fit list multiplies it with a block: every task sums
Xᵀ(X Q) of its centred rows, Spark adds the sums of all tasks, and the driver, which only ever holds a few
hundred vectors of the embedding's dimension, orthogonalises the result against the whole basis (twice), solves the
small problem and looks at the residuals. A block that loses rank (a breakdown) is filled up with fresh directions; a
basis that gets too large is cut down to its best vectors and goes on from there. It ends when the residuals of all
wanted pairs are at rounding level, or the basis spans the whole space, where the small problem is V itself.

Rows are centred exactly before anything is multiplied: n * x - S is a whole number. The trace is the sum of
the rows' deviations, so shares need no other eigenvalues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import stored, table
from panelwright.llm.vectors import matrix, usable

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
BLOCK = 16
#: Vectors of a basis before it is cut down, passes at most, and residuals as a share of the largest eigenvalue.
BASIS = 256
PASSES = 500
RESIDUAL = 5e-14
#: Eigenvalues below this share of the largest are rounding errors of zero.
RANK = 1e-11
#: Entries beyond this stay at it.
LIMIT = 1 << 52


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """x of each row; a missing component has c = 0."""
    return (np.clip(np.floor(SCALE * matrix(column, dims)), -LIMIT, LIMIT) + SHIFT).astype(np.int64)


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in longs where they hold it and its row's squares, else in Python's numbers."""
    if not x.size:
        return x
    largest = max(n * int(np.abs(x).max()), max(map(abs, sums)))
    if largest < 1 << 62:
        found = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(found).max()) ** 2 < 1 << 63:
            return found
    return n * x.astype(object) - np.array(sums, object)


class Fit:
    """The fit list (a stored table with the column ``x``), its size and sums, and sums over it by distributed passes."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.n, self.dims = (v or 0 for v in rows.agg(F.count("*"), F.max(F.size("x"))).first())
        totals = self._added(lambda x: x.astype(object).sum(0) if len(x) else [0] * x.shape[1], exact=True) if self.dims else {}
        self.sums = [int(totals.get(i, 0)) for i in range(self.dims)]
        self.variance = 0.0

    def _added(self, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> dict[int, float | int]:
        """What ``part`` makes of the rows, a flat list each time, summed place by place: first in tasks, then by Spark."""
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                if len(x):
                    got = np.asarray(part(x))
                    total = got if total is None else total + got
            if total is not None:
                kind = pa.decimal128(38, 0) if exact else pa.float64()
                values = pa.array([Decimal(int(v)) for v in total] if exact else total.astype(np.float64), kind)
                yield pa.record_batch([pa.array(np.arange(len(total))), values], ["i", "v"])

        kind = "decimal(38,0)" if exact else "double"
        parts = self.rows.select("x").mapInArrow(run, f"i long, v {kind}")
        return {r.i: r.v for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect()}

    def centred(self, x: np.ndarray) -> np.ndarray:
        return differences(x, self.n, self.sums).astype(np.float64) / self.n

    def times(self, block: np.ndarray) -> np.ndarray:
        """V times the block, by one pass; notes the trace of V on the way."""
        n, sums, (dims, width) = self.n, self.sums, block.shape

        def part(x: np.ndarray) -> np.ndarray:
            whole = differences(x, n, sums)
            c = whole.astype(np.float64) / n
            return np.append((c.T @ (c @ block)).ravel(), (whole * whole).sum(1).astype(np.float64).sum())

        got = self._added(part)
        self.variance = got[dims * width] / n / n / n
        return np.array([got[i] for i in range(dims * width)]).reshape(dims, width) / n

    def identity_error(self, axes: np.ndarray) -> float:
        """Largest entry, without its sign, of the covariance of ``centred(x) @ axes`` less the identity."""
        n, sums, width = self.n, self.sums, axes.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            w = differences(x, n, sums).astype(np.float64) / n @ axes
            return np.append((w.T @ w).ravel(), w.sum(0))

        got = self._added(part)
        flat = np.array([got[i] for i in range(width * width + width)]) / n
        mean = flat[width * width :]
        return float(np.abs(flat[: width * width].reshape(width, width) - np.outer(mean, mean) - np.eye(width)).max())


def _fresh(candidates: np.ndarray, basis: np.ndarray, width: int, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Up to ``width`` unit vectors at right angles to the basis and each other, out of ``candidates``; where these
    are used up (a breakdown), random ones restart the block."""
    found = np.zeros((len(basis), 0))
    width = min(width, len(basis) - basis.shape[1])
    queue = [candidates[:, i] for i in range(candidates.shape[1])]
    while found.shape[1] < width:
        given = bool(queue)
        v = queue.pop(0) if given else rng.standard_normal(len(basis))
        least = 1e-10 * (scale if given else np.linalg.norm(v))
        all_ = np.hstack([basis, found])
        for _ in range(2):
            v = v - all_ @ (all_.T @ v)
        size = np.linalg.norm(v)
        if size > least:
            v = v / size
            v = v - all_ @ (all_.T @ v)
            found = np.hstack([found, (v / np.linalg.norm(v))[:, None]])
    return found


def leading_pairs(
    times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, block: int = BLOCK, basis_size: int = BASIS, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric map ``times``."""
    rng = np.random.default_rng(seed)
    wanted, block = min(wanted, dims), min(block, dims)
    basis_size = max(basis_size, wanted + 2 * block)
    q, vq = np.zeros((dims, 0)), np.zeros((dims, 0))
    fresh = _fresh(np.zeros((dims, 0)), q, block, 0.0, rng)
    confirmed = None
    for _ in range(PASSES):
        image = times(fresh)
        q, vq = np.hstack([q, fresh]), np.hstack([vq, image])
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn[:, order]
        ritz, applied = q @ turn, vq @ turn
        scale = max(abs(values[0]), abs(values[-1]))
        residual = np.linalg.norm(applied[:, :wanted] - ritz[:, :wanted] * values[:wanted], axis=0)
        settled = len(values) >= wanted and (residual <= RESIDUAL * scale).all()
        if q.shape[1] == dims or (settled and confirmed is not None and np.abs(values[:wanted] - confirmed).max() <= RESIDUAL * scale):
            return values[:wanted], ritz[:, :wanted]
        # a space that is closed under the map may lack copies of an eigenvalue: only a block of fresh directions shows them
        confirmed = values[:wanted] if settled else None
        fresh = _fresh(image[:, :0] if settled else image, q, block, scale, rng)
        if q.shape[1] + block > basis_size:
            q, vq = ritz[:, : wanted + block], applied[:, : wanted + block]
    raise RuntimeError("eigenvectors have not converged")


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null or has a null or non-finite entry go. Entries become x = floor(64 * c) + 1000000 (beyond
    2**52 they stay there); of vectors of different length the missing entries count as c = 0. The fit list has each
    distinct x once, ids don't matter for it, so copies weigh nothing; every row comes out, with null and repeated ids
    as well. There are as many components as asked for, or the rank of the covariance if that is less (eigenvalues below
    1e-11 of the largest count as zero): equal eigenvalues have no order of their own, and one distinct vector, or none,
    has no component, which gives an empty result. ``deviation`` is exact, and null where it is beyond a long. Other
    columns don't matter.
    """
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")).where(usable(F.col("vec")))
    longest = kept.agg(F.max(F.size("vec"))).first()[0] or 0

    def to_x(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(0), longest)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * longest)
            yield pa.record_batch([pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["x"])

    fit = Fit(stored(kept.select("vec").mapInArrow(to_x, "x array<long>").distinct(), "whitening-fit"))
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    values = np.zeros(0)
    if fit.n > 1 and fit.dims:
        values, axes = leading_pairs(fit.times, fit.dims, components)
        good = values > RANK * max(values[0], 0.0)
        values, axes = values[good], axes[:, good]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    axes = axes / np.sqrt(values)
    n, sums, dims = fit.n, fit.sums, fit.dims
    error = fit.identity_error(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = differences(_whole(batch.column(1), dims), n, sums)
            squares = [d if d < 1 << 63 else None for d in (whole * whole).sum(1).tolist()]
            w = whole.astype(np.float64) / n @ axes
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.record_batch([batch.column(0), pa.array(squares, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["vec_id", "deviation", "w"])

    shares = F.array(*[F.lit(float(v / fit.variance)) for v in values])
    return (
        kept.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")
        .select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
