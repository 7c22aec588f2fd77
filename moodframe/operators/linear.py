"""Linear classifiers without intercept: full-batch proximal gradient of the objectives the
stochastic trainer minimises, plus Spark's own logistic regression and SVM.

The rows stay on the executors. Each round is one scan of the staged feature table and a
small shuffle of partial gradients; only the weights (one number per vocabulary term) pass
through the driver.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.operators.features import sparse_arrays
from moodframe.session import stage

L1_RATIO = 0.15  # fixed value: elastic-net mix
# Curvature bound of each loss for rows of unit length; the step is its inverse.
_CURVATURE = {"log": 0.25, "modified_huber": 2.0, "squared_hinge": 2.0, "hinge": None}


def loss_and_slope(loss: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative by the signed margin z = y * f."""
    if loss == "log":
        return np.logaddexp(0.0, -z), -1.0 / (1.0 + np.exp(np.clip(z, -500, 500)))
    if loss == "hinge":
        return np.maximum(0.0, 1.0 - z), np.where(z < 1.0, -1.0, 0.0)
    gap = np.maximum(0.0, 1.0 - z)
    if loss == "squared_hinge":
        return gap**2, -2.0 * gap
    if loss == "modified_huber":
        return np.where(z < -1.0, -4.0 * z, gap**2), np.where(z < -1.0, -4.0, -2.0 * gap)
    raise ValueError(f"unknown loss {loss}")


#: Rows of one block.
BLOCK_ROWS = 1024
_BLOCK = "rows int, label binary, row_weight binary, bounds binary, idx binary, val binary"


def row_blocks(rows: DataFrame) -> DataFrame:
    """(label, row_weight, idx, val) as blocks of at most ``BLOCK_ROWS`` rows, their arrays as bytes:
    each round reads them as they are instead of value by value."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                column = lambda name, kind: part.column(name).to_numpy(zero_copy_only=False).astype(kind)
                flat = lambda name, kind: part.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind)
                lengths = pc.fill_null(pc.list_value_length(part.column("idx")), 0).to_numpy(zero_copy_only=False)
                label = pc.fill_null(part.column("label"), -1).to_numpy(zero_copy_only=False).astype(np.int8)
                arrays = [label, column("row_weight", float), np.append(0, np.cumsum(lengths)).astype(np.int64), flat("idx", np.int32), flat("val", float)]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in arrays]], _NAMES)

    return rows.select("label", "row_weight", "idx", "val").mapInArrow(run, _BLOCK)


_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_KINDS = {"label": np.int8, "row_weight": float, "bounds": np.int64, "idx": np.int32, "val": float}


def block_arrays(batches):
    """(labels, -1 for none, row weights, bounds, idx, val) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            label, weight, bounds, idx, val = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in _KINDS.items())
            yield label, weight, bounds, idx.astype(np.int64), val


def _blocks(batches):
    """(y as -1 or 1, row weights, bounds, idx, val) of each block."""
    for label, *rest in block_arrays(batches):
        yield np.where(label == 1, 1.0, -1.0), *rest


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the entries of each row, 0 for rows without any."""
    out = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some])
    return out


def _few_tasks(blocks: DataFrame) -> DataFrame:
    """No more tasks than cores, without a shuffle: each sends one gradient."""
    return blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)


def _partial_gradient(loss: str, weights):
    """Task body: sums loss and gradient over its blocks, yields one row per term it
    saw and one row (idx -1) with the loss sum and the row count."""

    def run(batches):
        w = weights.value
        grad = np.zeros(len(w))
        total, rows, tp, fp, fn = 0.0, 0.0, 0, 0, 0
        for y, c, bounds, idx, val in _blocks(batches):
            f = _row_sums(val * w[idx], bounds)
            value, slope = loss_and_slope(loss, y * f)
            total += float((c * value).sum())
            rows += float(c.sum())
            grad += np.bincount(idx, val * np.repeat(c * slope * y, np.diff(bounds)), minlength=len(w))
            tp += int(((f > 0) & (y > 0)).sum())
            fp += int(((f > 0) & (y < 0)).sum())
            fn += int(((f <= 0) & (y > 0)).sum())
        seen = np.flatnonzero(grad)
        yield pa.RecordBatch.from_pydict(
            {
                "idx": pa.array(np.concatenate([[-1, -2, -3, -4, -5], seen]), pa.int32()),
                "g": pa.array(np.concatenate([[total, rows, tp, fp, fn], grad[seen]]), pa.float64()),
            }
        )

    return run


@dataclass
class LinearModel:
    """Weights by vocabulary index and the round-by-round history."""

    weights: np.ndarray
    loss: str
    history: list[dict] = field(default_factory=list)
    best_round: int = 0

    def table(self, spark: SparkSession) -> DataFrame:
        return weight_table(spark, [self])

    def history_table(self, spark: SparkSession) -> DataFrame:
        schema = "round int, train_loss double, valid_loss double, valid_f1 double, seconds double"
        return spark.createDataFrame([tuple(h.values()) for h in self.history], schema)


def weight_table(spark: SparkSession, models: list[LinearModel]) -> DataFrame:
    """idx, w0, w1, ...: one weight column per model."""
    columns = {"idx": pa.array(range(len(models[0].weights)), pa.int32())}
    columns |= {f"w{i}": pa.array(m.weights, pa.float64()) for i, m in enumerate(models)}
    return spark.createDataFrame(pa.table(columns))


def training_rows(df: DataFrame, label_col: str = "label", weight_col: str | None = None) -> DataFrame:
    """Staged blocks of (label, row_weight, idx, val): written once, read each round."""
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    rows = sparse_arrays(df.select(F.col(label_col).cast("int").alias("label"),
                                   weight.cast("double").alias("row_weight"), "features"))
    return stage(row_blocks(rows), "training")


def full_gradient(rows: DataFrame, loss: str, weights: np.ndarray) -> tuple[np.ndarray, dict]:
    """Mean gradient and mean loss at ``weights`` over staged rows: one job."""
    shipped = rows.sparkSession.sparkContext.broadcast(weights)
    parts = _few_tasks(rows).mapInArrow(_partial_gradient(loss, shipped), "idx int, g double")
    sums = parts.groupBy("idx").agg(F.sum("g").alias("g")).toArrow()
    shipped.unpersist()
    idx, g = sums["idx"].to_numpy(), sums["g"].to_numpy()
    marks = dict(zip(idx[idx < 0].tolist(), g[idx < 0].tolist()))
    n = marks.get(-2, 0.0)
    grad = np.zeros(len(weights))
    grad[idx[idx >= 0]] = g[idx >= 0]
    tp, fp, fn = (marks.get(i, 0.0) for i in (-3, -4, -5))
    f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    return (grad / n if n else grad), {"loss": marks.get(-1, 0.0) / n if n else math.nan, "f1": f1, "n": n}


def fit_linear(
    train: DataFrame,
    n_features: int,
    loss: str = "modified_huber",
    penalty: str = "l2",
    alpha: float = 1e-4,
    rounds: int = 60,
    label_col: str = "label",
    weight_col: str | None = None,
    valid: DataFrame | None = None,
    monitor: str = "loss",
    patience: int | None = None,
    checkpoint: str | None = None,
    staged: bool = False,
) -> LinearModel:
    """Accelerated proximal gradient on mean loss + alpha * penalty.

    With ``valid`` the loss (or F1) on it is watched: training stops after ``patience``
    rounds without improvement and the best weights are returned; with ``checkpoint`` they
    are also written there each time they improve.
    """
    if penalty not in ("l2", "elasticnet"):
        raise ValueError(f"unknown penalty {penalty}")
    rows = train if staged else training_rows(train, label_col, weight_col)
    held = None if valid is None else training_rows(valid, label_col)
    l1 = alpha * L1_RATIO if penalty == "elasticnet" else 0.0
    l2 = alpha * (1 - L1_RATIO) if penalty == "elasticnet" else alpha
    w = np.zeros(n_features)
    look, momentum = w.copy(), 1.0
    model = LinearModel(w, loss)
    best, waited = None, 0
    for number in range(1, rounds + 1):
        start = time.time()
        grad, facts = full_gradient(rows, loss, look)
        curve = _CURVATURE[loss]
        step = 1.0 / (curve + l2) if curve else 1.0 / math.sqrt(number)
        moved = look - step * (grad + l2 * look)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0.0) if l1 else moved
        faster = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        look = new + ((momentum - 1) / faster) * (new - w) if curve else new
        w, momentum = new, faster
        row = {"round": number, "train_loss": facts["loss"], "valid_loss": None, "valid_f1": None}
        if held is not None:
            _, seen = full_gradient(held, loss, w)
            row["valid_loss"], row["valid_f1"] = seen["loss"], seen["f1"]
            score = -seen["loss"] if monitor == "loss" else seen["f1"]
            if best is None or score > best:
                best, waited = score, 0
                model.weights, model.best_round = w.copy(), number
                if checkpoint:
                    save_weights(model, rows.sparkSession, checkpoint)
            else:
                waited += 1
        row["seconds"] = time.time() - start
        model.history.append(row)
        if patience is not None and waited >= patience:
            break
    if held is None:
        model.weights, model.best_round = w, len(model.history)
    return model


def _partial_gradients(losses: list[str], weights):
    """Task body: one gradient per loss and weight row, summed over the task's blocks."""

    def run(batches):
        w = weights.value
        grads = np.zeros(w.shape)
        for y, _, bounds, idx, val in _blocks(batches):
            if not len(idx):
                continue
            lengths = np.diff(bounds)
            # a block is of one fold but at borders: its terms are near each other
            first, size = int(idx.min()), int(idx.max() - idx.min()) + 1
            near = idx - first
            for k, loss in enumerate(losses):
                slope = loss_and_slope(loss, y * _row_sums(val * w[k].take(idx), bounds))[1] * y
                grads[k, first : first + size] += np.bincount(near, val * np.repeat(slope, lengths), size)
        seen = np.flatnonzero(grads.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *[pa.array(g[seen]) for g in grads]], ["idx", *[f"g{k}" for k in range(len(grads))]])

    return run


def fit_linear_grid(rows: DataFrame, borders: list[int], counts: list[int], settings: list[tuple[str, str]], stops: list[int], alpha: float = 1e-4) -> dict[int, np.ndarray]:
    """Weights of all (loss, penalty) settings and all folds after each number of rounds in
    ``stops``: one scan of the staged rows a round for the whole grid.

    ``rows`` are blocks of label, idx and val (``row_blocks``), the terms of fold i being numbered from borders[i] to
    borders[i + 1]; ``counts`` are the folds' training rows. The steps are those of
    ``fit_linear``; fewer rounds are the start of the same path."""
    losses = [loss for loss, _ in settings]
    per_row = np.repeat(1.0 / np.maximum(counts, 1), np.diff(borders))
    w = np.zeros((len(settings), borders[-1]))
    look, momentum, kept = w.copy(), 1.0, {}
    names = [f"g{k}" for k in range(len(settings))]
    for number in range(1, max(stops) + 1):
        shipped = rows.sparkSession.sparkContext.broadcast(look)
        parts = _few_tasks(rows).mapInArrow(_partial_gradients(losses, shipped), "idx int, " + ", ".join(f"{n} double" for n in names))
        sums = parts.groupBy("idx").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        shipped.unpersist()
        grads = np.zeros_like(w)
        for k, name in enumerate(names):
            grads[k, sums["idx"].to_numpy()] = sums[name].to_numpy()
        faster = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        before, w = w, np.empty_like(w)
        for k, (loss, penalty) in enumerate(settings):
            l1 = alpha * L1_RATIO if penalty == "elasticnet" else 0.0
            l2 = alpha * (1 - L1_RATIO) if penalty == "elasticnet" else alpha
            curve = _CURVATURE[loss]
            step = 1.0 / (curve + l2) if curve else 1.0 / math.sqrt(number)
            moved = look[k] - step * (grads[k] * per_row + l2 * look[k])
            w[k] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0.0)
            look[k] = w[k] + ((momentum - 1) / faster) * (w[k] - before[k]) if curve else w[k]
        momentum = faster
        if number in stops:
            kept[number] = w.copy()
    return kept


def early_stop_round(scores: list[float], patience: int, larger_is_better: bool = False) -> tuple[int, int]:
    """(best round, last round run) for a sequence of watched values, counted from 1."""
    best, best_at, waited = None, 0, 0
    for at, value in enumerate(scores, 1):
        good = value if larger_is_better else -value
        if best is None or good > best:
            best, best_at, waited = good, at, 0
        else:
            waited += 1
            if waited >= patience:
                return best_at, at
    return best_at, len(scores)


def fit_squared_hinge_svm(train: DataFrame, n_features: int, c: float = 1.0, rounds: int = 60, **kw) -> LinearModel:
    """Linear SVM with squared hinge loss and no intercept: alpha = 1 / (C n)."""
    rows = training_rows(train, kw.pop("label_col", "label"))
    return fit_linear(rows, n_features, "squared_hinge", alpha=1.0 / (c * rows.agg(F.sum("rows")).first()[0]), rounds=rounds, staged=True, **kw)


def save_weights(model: LinearModel, spark: SparkSession, path: str) -> None:
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("idx int, w0 double").parquet(path)


def huber_probability(margin):
    """Class-1 probability of a modified-Huber model."""
    return (F.least(F.greatest(margin, F.lit(-1.0)), F.lit(1.0)) + 1) / 2


def logistic_regression(n_rows: int, c: float = 1.0, intercept: bool = False, max_iter: int = 300, **kw):
    """Estimator for C * sum(loss) + |w|^2 / 2, in Spark's scaling."""
    return LogisticRegression(
        regParam=1.0 / (c * n_rows),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=intercept,
        maxIter=max_iter,
        **kw,
    )


def hinge_svm(n_rows: int, c: float = 1.0, max_iter: int = 100, **kw) -> LinearSVC:
    """Plain-hinge variant of the SVM."""
    return LinearSVC(regParam=1.0 / (c * n_rows), standardization=False, fitIntercept=False, maxIter=max_iter, **kw)
