"""Friedman and Nemenyi tests over a long metrics table (measure, model, value).

Measures may be many (one per day, fold or data set); models are few. Ranks are made inside
each measure, everything else is a grouped sum.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = [0.001, 0.01, 0.05]  # fixed values: significance levels of the sign matrix
_SELF = -1.0  # fixed value: the diagonal


def measure_ranks(metrics: DataFrame, *by: str) -> DataFrame:
    """Mean rank of each model inside its measure."""
    own = W.partitionBy(*by, "measure")
    ties = F.count("*").over(W.partitionBy(*by, "measure", "value"))
    rank = F.rank().over(own.orderBy("value"))
    return metrics.select(
        *by, "measure", "model", "value", (rank + (ties - 1) / 2).alias("rank"), ties.alias("ties")
    )


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail for whole degrees of freedom, in closed form."""
    if not df or math.isnan(x):
        return math.nan
    h = x / 2
    if df % 2 == 0:
        return math.exp(-h) * sum(h**i / math.factorial(i) for i in range(df // 2))
    return math.erfc(math.sqrt(h)) + math.exp(-h) * sum(
        h ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (df + 1) // 2)
    )


@F.pandas_udf(T.DoubleType())
def _chi_square_column(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi_square_tail(a, int(b)) for a, b in zip(x, df)])


def studentized_range_tail(q: float, k: int) -> float:
    """Upper tail of the studentised range with infinite degrees of freedom, by Simpson's
    rule on a fixed grid."""
    z = np.linspace(-8.0, 8.0, 4001)
    step = z[1] - z[0]
    cdf = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
    low = 0.5 * (1 + np.array([math.erf((v - q) / math.sqrt(2)) for v in z]))
    y = k * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * np.clip(cdf - low, 0, 1) ** (k - 1)
    weights = np.ones_like(z)
    weights[1:-1:2], weights[2:-1:2] = 4, 2
    return float(min(1.0, max(0.0, 1 - (weights * y).sum() * step / 3)))


@F.pandas_udf(T.DoubleType())
def _studentized_column(q: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([studentized_range_tail(a, int(b)) for a, b in zip(q, k)])


def mean_ranks(metrics: DataFrame, *by: str) -> DataFrame:
    return measure_ranks(metrics, *by).groupBy(*by, "model").agg(
        F.avg("rank").alias("mean_rank"), F.count("*").alias("measures")
    )


def friedman(metrics: DataFrame, *by: str) -> DataFrame:
    """Tie-corrected statistic, degrees of freedom and p-value: one row per test."""
    ranked = measure_ranks(metrics, *by)
    # Sum over rows of t^2 - 1 equals the sum over tie groups of t^3 - t.
    per_model = ranked.groupBy(*by, "model").agg(
        F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t")
    )
    facts = per_model.groupBy(*by).agg(
        F.sum(F.col("r") * F.col("r")).alias("ss"),
        F.max("n").cast("double").alias("n"),
        F.count("*").cast("double").alias("k"),
        F.sum("t").cast("double").alias("t"),
    )
    n, k = F.col("n"), F.col("k")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    correction = 1 - F.col("t") / (n * k * (k * k - 1))
    out = facts.select(
        *by, n.cast("bigint").alias("measures"), k.cast("bigint").alias("models"),
        F.when(correction > 0, raw / correction).alias("statistic"), (k - 1).cast("int").alias("df"),
    )
    return out.withColumn("p_value", _chi_square_column("statistic", "df"))


def nemenyi(metrics: DataFrame, *by: str) -> DataFrame:
    """Pairwise p from the distance of mean ranks: model_a < model_b. The pairs are of
    models, of which there are few; measures are summed before."""
    ranks = mean_ranks(metrics, *by)
    listed = ranks.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("model", "mean_rank"))).alias("_m"),
        F.max("measures").cast("double").alias("_n"), F.count("*").alias("_k"),
    )
    pairs = listed.select(
        *by, "_n", "_k",
        F.explode(
            F.flatten(
                F.transform(
                    "_m",
                    lambda a: F.transform(
                        F.filter("_m", lambda b: b["model"] > a["model"]),
                        lambda b: F.struct(
                            a["model"].alias("model_a"), b["model"].alias("model_b"),
                            F.abs(a["mean_rank"] - b["mean_rank"]).alias("distance"),
                        ),
                    ),
                )
            )
        ).alias("p"),
    )
    k = F.col("_k").cast("double")
    q = F.col("p.distance") / F.sqrt(k * (k + 1) / (6 * F.col("_n"))) * F.sqrt(F.lit(2.0))
    return pairs.select(
        *by, "p.model_a", "p.model_b", "p.distance", q.alias("q"), F.col("_k").alias("models")
    ).withColumn("p_value", _studentized_column("q", "models"))


def significance_long(pairs: DataFrame, *by: str) -> DataFrame:
    """Both triangles and the diagonal of the matrix, with a level mark: -1 for self, 0 not
    significant, 1 to 3 for p under 0.05, 0.01, 0.001."""
    p = F.col("p_value")
    flip = F.explode(
        F.array(F.struct(F.col("model_a").alias("a"), F.col("model_b").alias("b")),
                F.struct(F.col("model_b").alias("a"), F.col("model_a").alias("b")))
    ).alias("c")
    both = pairs.select(*by, flip, "p_value").select(*by, "c.a", "c.b", "p_value")
    own = both.select(*by, F.col("a")).distinct().select(*by, "a", F.col("a").alias("b"), F.lit(_SELF).alias("p_value"))
    level = F.lit(0)
    for limit in sorted(LEVELS, reverse=True):
        level = level + F.when(p < limit, 1).otherwise(0)
    return both.unionByName(own).withColumn("level", F.when(F.col("a") == F.col("b"), -1).otherwise(level))


def significance_matrix(pairs: DataFrame, models: list[str]) -> DataFrame:
    """The symmetric matrix, one row per model, columns in the order given."""
    return significance_long(pairs).groupBy(F.col("a").alias("model")).pivot("b", models).agg(F.first("p_value"))
