"""Embedding whitening with components found by FEAST contour integration.

Spark makes the covariance; the components of that one matrix are found on the
driver, whose work is bounded by the dimension and not by the rows.

An interval of eigenvalues is enclosed by a circle. At the points of a Gauss
quadrature on it the shifted matrix z - V is solved for a block of vectors; the
weighted sum of the solutions is the block's projection onto the eigenvectors inside.
Rayleigh-Ritz on the projected block extracts the pairs, and the two steps repeat
until the residuals are at rounding. Intervals come from inertia: the negative pivots
of V - s count the eigenvalues below s. The lower border is moved by bisection until
enough eigenvalues lie above it and none close to it, and the inertia of both
borders tells how many pairs must come out; fewer make the block larger.

The fit list holds each distinct vector of integers x = floor(256 c) once. Sums are
exact integers; products are centred first. Vectors are shuffled once, packed in the
least width that holds them, to find the distinct ones; moments are summed in each
task and leave it as one row per matrix entry.

Defined cases: rows whose vector is null, empty or holds null, NaN or infinite entries
are dropped, as are those of another length than the commonest (of equally common ones
the longest); repeated rows and ids each get their rows; x is limited to the range of
long; components whose eigenvalue is not above rounding are left out, so equal vectors
alone give no rows, nor does an empty table; a deviation beyond long is null.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from witspark.llm.common import id_type, prepare
from witspark.plans.lineage import cut

#: The covariance is square in the dimension and lies on the driver.
MAX_DIMENSION = 2048
#: Points of the quadrature on the upper half circle; the lower half is its mirror image.
POINTS = 8
_LONG = 2.0**63


class LostComponents(RuntimeError):
    """Inertia counts more eigenvalues than the contour gave."""


def pivots_below(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix below `shift`: negative pivots of its LDL' factors.

    A pivot too small to divide by means that `shift` is an eigenvalue of a leading
    block; the shift then moves by a rounding of the matrix.
    """

    size = float(np.abs(matrix).max(initial=0.0)) or 1.0
    while True:
        rest, below = matrix - shift * np.eye(len(matrix)), 0
        for k in range(len(rest)):
            pivot = rest[k, k]
            if abs(pivot) < 1e-14 * size:
                break
            below += pivot < 0
            column = rest[k + 1 :, k]
            rest[k + 1 :, k + 1 :] -= np.outer(column, column / pivot)
        else:
            return int(below)
        shift += 4e-14 * size


class Interval(NamedTuple):
    low: float
    high: float
    inside: int


def top_interval(matrix: np.ndarray, wanted: int) -> Interval:
    """An interval with the `wanted` largest eigenvalues and all that lie near the last of them."""

    d = len(matrix)
    radius = np.abs(matrix).sum(1) - np.abs(np.diag(matrix))
    high = float((np.diag(matrix) + radius).max()) * (1 + 1e-9) + 1e-300
    low, top = 0.0, high
    if d - pivots_below(matrix, low) <= wanted:
        low = float((np.diag(matrix) - radius).min()) - high * 1e-3
        return Interval(low, high, d - pivots_below(matrix, low))
    # Bisect for a border with at least `wanted` eigenvalues above, near the last of them.
    for _ in range(60):
        middle = (low + top) / 2
        above = d - pivots_below(matrix, middle)
        low, top = (middle, top) if above >= wanted else (low, middle)
        if top - low <= 1e-3 * top:
            break
    # Move down until no eigenvalue lies just below the border, or half of them are inside.
    step = max(top - low, 1e-3 * top)
    inside = d - pivots_below(matrix, low)
    while low > step and inside < max(wanted, d // 2):
        nearer = d - pivots_below(matrix, low - step)
        if nearer == inside:
            break
        low, inside = low - step, nearer
    return Interval(low - step / 2, high, d - pivots_below(matrix, low - step / 2))


def contour(low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Points on the circle over (low, high) and their weights, by Gauss-Legendre in the angle."""

    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    radius, centre = (high - low) / 2, (high + low) / 2
    angle = np.pi / 2 * (nodes + 1)
    turn = np.exp(1j * angle)
    return centre + radius * turn, weights / 2 * radius * turn / 2


def eigenpairs(matrix: np.ndarray, interval: Interval, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (values falling, vectors as columns) of the interval, which inertia has counted."""

    d, expected = len(matrix), interval.inside
    size = float(np.abs(matrix).max())
    points, weights = contour(interval.low, interval.high)
    block = min(d, expected + max(4, expected // 2))
    random = np.random.default_rng(seed)
    while True:
        basis = np.linalg.qr(random.standard_normal((d, block)))[0]
        best = np.inf
        for _ in range(60):
            projected = np.zeros_like(basis)
            for z, w in zip(points, weights):
                # The point below the axis adds the conjugate: twice the real part.
                projected += 2 * (w * np.linalg.solve(z * np.eye(d) - matrix, basis.astype(complex))).real
            basis = np.linalg.qr(projected)[0]
            small = basis.T @ matrix @ basis
            values, turn = np.linalg.eigh((small + small.T) / 2)
            basis = basis @ turn
            inside = np.flatnonzero((values > interval.low) & (values < interval.high))[::-1]
            own = basis[:, inside]
            residual = np.abs(matrix @ own - own * values[inside]).max(initial=0.0) / size
            # The pairs are right when another round no longer makes them better.
            if len(inside) == expected and residual >= best * 0.5 and residual < 1e-11:
                return values[inside], own / np.linalg.norm(own, axis=0)
            best = min(best, residual)
        if block == d:
            raise LostComponents(f"{expected} eigenvalues by inertia, {len(inside)} by the contour")
        block = min(d, 2 * block)


def components(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues above rounding, and their unit vectors as rows."""

    d = len(covariance)
    trace = float(np.trace(covariance))
    if not trace > 0:
        return np.zeros(0), np.zeros((0, d))
    values, vectors = eigenpairs(covariance, top_interval(covariance, min(wanted, d)))
    keep = np.flatnonzero(values > d * 1e-15 * trace)[:wanted]
    return values[keep], vectors[:, keep].T


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of `d` finite entries as rows of doubles."""

    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def quantised(vectors: np.ndarray, scale: int = 256) -> np.ndarray:
    return np.clip(np.floor(vectors * scale), -_LONG, np.nextafter(_LONG, 0)).astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the least of 1, 2, 4 or 8 bytes an entry that holds it; equal rows give equal bytes."""

    widths = np.full(len(x), 8)
    for width in (4, 2, 1):
        info = np.iinfo(f"i{width}")
        widths[((x >= info.min) & (x <= info.max)).all(1)] = width
    return [row.astype(f"<i{w}").tobytes() for row, w in zip(x, widths.tolist())]


def _opened(packed: list[bytes], d: int) -> np.ndarray:
    return np.array([np.frombuffer(p, f"<i{len(p) // d}") for p in packed], np.int64).reshape(-1, d)


class Whitening(NamedTuple):
    """What the fit list gives: n, its sums, the components and their shares."""

    dimension: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def usable(df: DataFrame, vector_col: str) -> F.Column:
    """Whether a vector has entries and all are finite numbers."""

    bad = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector_col) > 0) & ~bad, F.lit(False))


#: Partial sums that one task adds up; there are two such steps.
FAN_IN = 64


def _added(parts: DataFrame, of, width: int, whole: bool = False) -> list[int] | np.ndarray:
    """Sum of the vectors that `of(packed rows)` gives over all rows.

    Each task leaves one packed row, whatever its rows; `FAN_IN` tasks add those up,
    then one adds up theirs, and the driver gets a single row. Whole numbers are added
    exactly, in 16 bytes each.
    """

    def read(data: bytes):
        if not whole:
            return np.frombuffer(data)
        return [int.from_bytes(data[k : k + 16], "little", signed=True) for k in range(0, 16 * width, 16)]

    def summed(vectors):
        total = [0] * width if whole else np.zeros(width)
        for v in vectors:
            total = [t + x for t, x in zip(total, v)] if whole else total + v
        data = b"".join(t.to_bytes(16, "little", signed=True) for t in total) if whole else total.tobytes()
        yield pa.RecordBatch.from_pydict({"total": pa.array([data], pa.binary())})

    def first(batches):
        return summed(of([v.as_py() for v in batch.column(0)]) for batch in batches)

    def further(batches):
        return summed(read(v.as_py()) for batch in batches for v in batch.column(0))

    rows = parts.mapInArrow(first, "total binary")
    for tasks in (FAN_IN, 1):
        rows = rows.repartition(tasks).mapInArrow(further, "total binary")
    return read(bytes(rows.first()["total"]))


def fit(df: DataFrame, wanted: int = 4, vector_col: str = "embedding") -> Whitening | None:
    """Covariance of the distinct vectors and its largest components; None without usable rows."""

    prepare(df.sparkSession)
    vectors = df.filter(usable(df, vector_col)).select(F.col(vector_col).alias("v"))
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    if (commonest := lengths.first()) is None:
        return None
    d = commonest["d"]
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of {d} entries; the covariance is limited to {MAX_DIMENSION}")

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": _packed(quantised(_matrix(batch.column(0), d)))})

    def sums_of(packed):
        x = _opened(packed, d)
        small = len(x) == 0 or max(abs(int(x.max())), abs(int(x.min()))) < 2**40
        return [int(v) for v in (x if small else x.astype(object)).sum(0)]

    fitted = cut(vectors.filter(F.size("v") == d).mapInArrow(pack, "x binary").distinct())
    n = fitted.count()
    sums = _added(fitted, sums_of, d, whole=True)
    mean = np.array([s / n for s in sums])

    def products(packed):
        centred = _opened(packed, d) - mean
        return (centred.T @ centred)[np.triu_indices(d)]

    covariance = np.zeros((d, d))
    covariance[np.triu_indices(d)] = _added(fitted, products, d * (d + 1) // 2) / n
    covariance = covariance + np.triu(covariance, 1).T
    values, directions = components(covariance, wanted)
    k = len(values)

    def whitened(packed):
        y = (_opened(packed, d) - mean) @ (directions / np.sqrt(values)[:, None]).T
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    error = 0.0
    if k:
        moments = _added(fitted, whitened, k + k * k) / n
        spread = moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k])
        error = float(np.abs(spread - np.eye(k)).max())
    return Whitening(d, n, sums, values, directions, float(np.trace(covariance)), error)


def whiten(
    df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """`id`, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error` per row and component."""

    schema = (
        f"id {id_type(df, id_col)}, component int, n bigint, deviation bigint, whitened double,"
        " explained double, identity_error double"
    )
    spark = df.sparkSession
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    prepare(spark)
    d, n, k = model.dimension, model.n, len(model.values)
    sums = np.array(model.sums, object)
    mean = np.array([s / n for s in model.sums])
    turn = (model.vectors / np.sqrt(model.values)[:, None]).T
    shares = (model.values / model.trace).tolist()
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    error = model.identity_error

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact: in long where the largest term leaves room, else in Python's integers."""

        most = max(int(np.abs(x.astype(object)).max(initial=0)) * n + max(map(abs, model.sums)), 1)
        if most * most * d < 2**63:
            away = x * n - sums.astype(np.int64)
            return (away * away).sum(1).tolist()
        found = ((x.astype(object) * n - sums) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in found]

    def work(batches):
        for batch in batches:
            x = quantised(_matrix(batch.column(1), d))
            y = (x - mean) @ turn
            rows = len(x)
            far = pa.array(deviations(x), pa.int64())
            at = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    far.take(pa.array(at)),
                    pa.array(y.ravel()),
                    pa.array(np.tile(shares, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                schema=arrow,
            )

    rows = df.filter(usable(df, vector_col) & (F.size(vector_col) == d))
    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(work, kind)
