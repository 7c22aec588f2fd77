"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X (n by d) are never gathered. Each step is one pass: a task multiplies its
rows by the new direction (X v), and the products by its rows (X' u), and returns sums of d
numbers. The left vectors u are as long as the table, so they are kept as the directions w
with u = X w, from which every task makes its own part again. Both sides are reorthogonalised
in full at each step: the left side by the products with all earlier left vectors, which the
same pass returns, the right side on the driver. After d steps (fewer if the rank is reached)
X = U B V' with a small upper bidiagonal B, whose singular values and vectors give the
deviations along the components and the components themselves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.session import stage

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Whole numbers up to here keep all sums of n rows and their differences exact in 64 bits for
#: tables of a thousand million rows; larger entries are cut to it.
LARGEST = 1 << 31
_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """components (k, d): unit rows; variances (k); total: trace of the covariance; n and sums
    (Python ints) of the fit list."""

    components: np.ndarray
    variances: np.ndarray
    total: float
    n: int
    sums: list[int]


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): floor(1024 * c) + 100000 of each entry. Rows with a null vector or with null
    or non-finite entries are dropped. If lengths differ, the commonest takes part (ties: the
    longer), as a covariance needs one."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & finite)
    cut = lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(SCALE)) * c.cast("double")))
    rows = stage(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(cut(c)) + SHIFT).alias("x")), "whole-vectors")
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("x") == (common["dim"] if common else 0))


def matrix_of(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """(rows, d) of a list column without nulls."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else values.reshape(0, 0)


def task_sums(rows: DataFrame, partial) -> list[np.ndarray]:
    """Sums over all rows of the float or integer arrays that ``partial(matrix)`` returns for a
    batch: one record a task comes to the driver, added in the order of the tasks, so reruns
    agree."""

    def run(parts):
        from pyspark import TaskContext

        total = None
        for batch in parts:
            if batch.num_rows:
                found = partial(matrix_of(batch, 0))
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            kinds = ["".join(a.dtype.char for a in total)]
            cells = [[TaskContext.get().partitionId()], kinds, [[a.tobytes() for a in total]]]
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1]), pa.array(cells[2], pa.list_(pa.binary()))], ["part", "kinds", "sums"])

    found = sorted(rows.select("x").mapInArrow(run, "part int, kinds string, sums array<binary>").collect(), key=lambda r: r["part"])
    parts = [[np.frombuffer(s, kind) for s, kind in zip(r["sums"], r["kinds"], strict=True)] for r in found]
    exact = [[p.astype(object) if p.dtype.kind == "i" else p for p in part] for part in parts]
    return [sum(column[1:], column[0]) for column in zip(*exact, strict=True)]


def sizes(x: np.ndarray) -> list[np.ndarray]:
    """(rows, sums of the high and of the low 16 bits): exact whatever the number of rows."""
    return [np.array([len(x)]), (x >> 16).sum(0), (x & 0xFFFF).sum(0)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding: n * x - S is exact."""
    if n * (LARGEST + SHIFT) * 2 < _LONG:
        return (n * x - np.array(sums, np.int64)).astype(float) / n
    return ((x.astype(object) * n - np.array(sums, object)) / n).astype(float)


def bidiagonalise(product, d: int, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): right vectors (d, k) as columns and the upper bidiagonal matrix (k, k).

    ``product(w, W)`` returns, for the rows X: the sums |X w|^2, (X W)' (X w) and X' (X w).
    If a direction is used up (rank below d, or equal singular values), a new one orthogonal to
    all found is begun, so that equal values are found as often as they occur."""
    random = np.random.default_rng(seed)
    right = np.zeros((d, 0))
    left, images = np.zeros((d, 0)), np.zeros((d, 0))  # w and X'u of the left vectors
    upper = np.zeros((d, d))
    largest = 0.0
    new = _orthogonal(random.standard_normal(d), right)
    beta = 0.0
    for k in range(d):
        right = np.column_stack([right, new])
        if k:
            upper[k - 1, k] = beta
        direction = new - (beta * left[:, -1] if k else 0)
        square, shared, image = product(direction, left)
        # full reorthogonalisation of the left side: u loses its part in all earlier ones
        direction = direction - left @ shared
        image = image - images @ shared
        square = float(square) - float(shared @ shared)
        alpha = np.sqrt(max(square, 0.0))
        largest = max(largest, alpha, beta)
        if alpha > 1e-12 * max(largest, 1e-300) and alpha > 0:
            left, images = np.column_stack([left, direction / alpha]), np.column_stack([images, image / alpha])
            upper[k, k] = alpha
            rest = image / alpha - alpha * new
        else:  # X v lies in what is known
            left, images, rest = np.column_stack([left, np.zeros(d)]), np.column_stack([images, np.zeros(d)]), np.zeros(d)
        if k + 1 == d:
            break
        rest = rest - right @ (right.T @ rest)
        rest = rest - right @ (right.T @ rest)
        beta = float(np.linalg.norm(rest))
        if beta > 1e-12 * max(largest, 1e-300) and beta > 0:
            new = _orthogonal(rest, right)
        else:
            new, beta = _orthogonal(random.standard_normal(d), right), 0.0
    return right, upper


def _orthogonal(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    for _ in range(3):
        v = v - to @ (to.T @ v)
        v = v / np.linalg.norm(v)
    return v


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components with a variance above rounding, at most ``components``, largest first; signs
    are set so that the largest entry is positive. ``rows`` is a written table of
    ``whole_vectors``; it is read once for the sums and once for each of d steps."""
    found = task_sums(rows, sizes)
    if not found or not len(found[1]):
        return Whitening(np.zeros((0, 0)), np.zeros(0), 0.0, int(found[0][0]) if found else 0, [])
    n, d = int(found[0][0]), len(found[1])
    sums = [int(a) * 65536 + int(b) for a, b in zip(found[1], found[2], strict=True)]

    def product(w: np.ndarray, before: np.ndarray):
        def partial(x: np.ndarray) -> list[np.ndarray]:
            own = centred(x, n, sums)
            p = own @ w
            return [np.array([p @ p]), (own @ before).T @ p, own.T @ p]

        square, shared, image = task_sums(rows, partial)
        return square[0], shared, image

    right, upper = bidiagonalise(product, d, n)
    _, values, turned = np.linalg.svd(upper)
    variances = values**2 / n
    axes = turned @ right.T
    total = float(variances.sum())
    kept = [i for i in range(min(components, d)) if values[i] > 1e-10 * values[0] and values[0] > 0]
    axes = axes[kept]
    axes = axes * np.sign(axes[np.arange(len(kept)), np.abs(axes).argmax(1)])[:, None] if kept else axes
    return Whitening(axes, variances[kept], total, n, sums)


def whitened_rows(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ (model.components / np.sqrt(model.variances)[:, None]).T


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(model.variances)
    if not k:
        return 0.0
    mean = task_sums(rows, lambda x: [whitened_rows(x, model).sum(0)])[0] / model.n

    def partial(x: np.ndarray) -> list[np.ndarray]:
        own = whitened_rows(x, model) - mean
        return [(own.T @ own).ravel()]

    return float(np.abs(task_sums(rows, partial)[0].reshape(k, k) / model.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the entries of (n * x - S) ** 2, exact; beyond the long range it is cut to it."""
    reach = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if reach * reach * max(len(sums), 1) < _LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    if reach < _LONG:  # differences fit, their squares may not
        off = n * x - np.array(sums, np.int64)
        if float(np.abs(off).max(initial=0)) ** 2 * len(sums) < _LONG / 2:
            return (off**2).sum(1).tolist()
        return [min(int(v), _LONG) for v in (off.astype(object) ** 2).sum(1)]
    return [min(int(v), _LONG) for v in ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each
    remaining vector and component.

    Null, non-finite and odd-length vectors are dropped (``whole_vectors``); null ids and
    repeated rows stay and count each. Directions without variance (constant entries, fewer
    rows than entries) are no components, so a table of one row or of equal rows gives no rows."""
    rows = whole_vectors(vectors)
    model = fit_whitening(rows, components)
    error, k = identity_error(rows, model), len(model.variances)
    explained = model.variances / model.total if k else model.variances

    def run(parts):
        for batch in parts:
            if not k or not batch.num_rows:
                continue
            x = matrix_of(batch, 1)
            m = len(x)
            far = np.array(deviations(x, model.n, model.sums), np.int64)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(np.repeat(far, k)), pa.array(whitened_rows(x, model).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
