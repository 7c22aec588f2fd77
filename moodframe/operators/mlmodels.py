"""Spark ML estimators with the settings of the original models."""

from __future__ import annotations

import math

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes that the rows of one task may take in Spark's trees, which keep them as one int a feature.
TREE_BYTES = 512 << 20


def bounded_parts(rows: DataFrame, n_features: int, most: int | None = None) -> DataFrame:
    """``rows`` in so many parts that none holds more than ``most`` bytes as rows of Spark's trees.
    Sparse rows are small as files, so their splits may hold far more. No shuffle if they do not."""
    parts = math.ceil(rows.count() * 4 * n_features / (most or TREE_BYTES))
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def pixel_vectors(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def decision_tree(max_depth: int = 20, min_split: int = 100, impurity: str = "gini", **kw):
    """The minimum split size becomes half of it per child."""
    kw.setdefault("seed", 42)
    return DecisionTreeClassifier(
        maxDepth=max_depth, impurity=impurity, minInstancesPerNode=max(1, min_split // 2), **kw
    )


def random_forest(
    trees: int = 100, max_depth: int = 30, min_split: int = 50, impurity: str = "entropy",
    subset: str = "sqrt", **kw,
):
    """The node of each row in each tree is kept, so that a level does not run all rows down all
    trees from their roots; the trees are the same."""
    kw.setdefault("seed", 42)
    kw.setdefault("cacheNodeIds", True)
    return RandomForestClassifier(
        numTrees=trees, maxDepth=min(max_depth, 30), impurity=impurity, featureSubsetStrategy=subset,
        minInstancesPerNode=max(1, min_split // 2), **kw,
    )


def feed_forward(n_features: int, n_classes: int = 2, hidden=(64, 32, 16), max_iter: int = 100, **kw):
    """Sigmoid hidden layers and a softmax output, trained by L-BFGS."""
    kw.setdefault("seed", 42)
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=max_iter, **kw)


def scored_classes(fitted, df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, class, both probabilities."""
    out = fitted.transform(df)
    p: Column = vector_to_array("probability")
    return out.select(
        *keys, F.col("prediction").cast("int").alias("prediction"), p[1].alias("p1"), p[0].alias("p0")
    )
