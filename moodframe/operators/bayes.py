"""Multinomial naive Bayes with a uniform prior on TF-IDF (or count) vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from moodframe.operators.features import MAX_FEATURES_LIMIT, long_rows, sparse_arrays
from moodframe.operators.linear import block_arrays

ALPHA = 0.1  # fixed value: smoothing of the chosen model
ALPHA_GRID = [0.00001, 0.0001, 0.001, 0.1, 1, 10, 100, 1000]  # fixed values


def class_sums(train: DataFrame, label_col: str = "label") -> DataFrame:
    """Feature mass per term and class: idx, s0, s1. Partial sums per term are made in each
    task, so the shuffle carries at most one row per term and task."""
    known = long_rows(train.select(label_col, "features")).filter(F.col("idx").isNotNull())
    y, v = F.col(label_col), F.col("val")
    return known.groupBy("idx").agg(
        F.sum(F.when(y == 0, v).otherwise(0.0)).alias("s0"),
        F.sum(F.when(y == 1, v).otherwise(0.0)).alias("s1"),
    )


def block_class_sums(blocks: DataFrame) -> DataFrame:
    """``class_sums`` of training rows that are blocks already (``linear.training_rows``): their texts
    are not turned into vectors once more."""

    def run(batches):
        sums, seen = np.zeros((2, 0)), np.zeros(0, bool)
        for label, _, bounds, idx, val in block_arrays(batches):
            size = max(len(seen), int(idx.max(initial=-1)) + 1)
            sums, seen = np.pad(sums, [(0, 0), (0, size - len(seen))]), np.pad(seen, (0, size - len(seen)))
            seen[idx] = True
            owner = np.repeat(label, np.diff(bounds))
            for y in (0, 1):
                own = owner == y
                sums[y] += np.bincount(idx[own], val[own], size)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *[pa.array(v[found]) for v in sums]], ["idx", "s0", "s1"])

    parts = blocks.mapInArrow(run, "idx int, s0 double, s1 double")
    return parts.groupBy("idx").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))


def log_odds(s0: Column, s1: Column, n0: Column, n1: Column, size, alpha: float) -> Column:
    """ln P(term | 1) - ln P(term | 0), smoothed."""
    one = F.log((s1 + alpha) / (n1 + alpha * size))
    zero = F.log((s0 + alpha) / (n0 + alpha * size))
    return one - zero


def fit_bayes(sums: DataFrame, alphas=(ALPHA,), n_terms: int | None = None) -> DataFrame:
    """Weight table idx, w0, w1, ... with one weight column per alpha: all smoothing values
    of a grid come from the same sums. At most one row per vocabulary term."""
    totals = [sums.agg(F.sum(s)).scalar() for s in ("s0", "s1")]
    size = F.lit(n_terms) if n_terms else sums.agg(F.count("*")).scalar()
    return sums.select(
        "idx",
        *[
            log_odds(F.col("s0"), F.col("s1"), totals[0], totals[1], size, a).alias(f"w{i}")
            for i, a in enumerate(alphas)
        ],
    )


def margins(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of value * weight per row, for each weight column, as m0, m1, ...

    The weight table has a row per vocabulary term, at most ``MAX_FEATURES_LIMIT``, which is
    checked; it goes to every task, where each row's vector is multiplied in place: no shuffle."""
    names = [c for c in weights.columns if c.startswith("w")]
    table = weights.select("idx", *names).limit(MAX_FEATURES_LIMIT + 1).toArrow()
    if table.num_rows > MAX_FEATURES_LIMIT:
        raise ValueError(f"more than {MAX_FEATURES_LIMIT} weights")
    places = table["idx"].to_numpy()
    dense = np.zeros((int(places.max(initial=-1)) + 1, len(names)))
    for k, name in enumerate(names):
        dense[places, k] = table[name].to_numpy()
    shipped = rows.sparkSession.sparkContext.broadcast(dense)
    found = rows if "idx" in rows.columns else sparse_arrays(rows.select(*keys, "features"))
    schema = StructType(found.select(*keys).schema.fields)
    for name in names:
        schema = schema.add("m" + name[1:], DoubleType())

    def run(batches):
        w = shipped.value
        for batch in batches:
            lists = batch.column("idx")
            idx = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            val = batch.column("val").flatten().to_numpy(zero_copy_only=False).astype(float)
            known = idx < len(w)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))[known]
            idx, val = idx[known], val[known]
            sums = [pa.array(np.bincount(owner, val * w[idx, k], batch.num_rows).astype(float)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *sums], schema.names)

    return found.select(*keys, "idx", "val").mapInArrow(run, schema)


def with_probability(scored: DataFrame, margin: str = "m0") -> DataFrame:
    """p1, p0 and class from the log odds; no evidence gives 0.5 and class 0."""
    m = F.col(margin)
    return scored.select(
        *[c for c in scored.columns if not (c.startswith("m") and c[1:].isdigit())],
        (1 / (1 + F.exp(-m))).alias("p1"),
        (1 / (1 + F.exp(m))).alias("p0"),
        (m > 0).cast("int").alias("prediction"),
    )


def score_bayes(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    return with_probability(margins(rows, weights, keys))
