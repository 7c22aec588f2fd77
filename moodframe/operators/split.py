"""Seeded splits and folds from a hash of the row id: stable under any partitioning."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodframe.functions.text import hash_number
from moodframe.session import stage

_BUCKETS = 4096


def split_name(key: Column, shares: dict[str, float], seed: int = 42) -> Column:
    """Split of a row from its hash modulo 100. Narrow: no shuffle, shares approximate."""
    spot = hash_number(key, seed) % 100
    names = list(shares)
    edges = [round(100 * x) for x in accumulate(shares.values())]
    column = F.when(spot < edges[0], names[0])
    for name, edge in zip(names[1:-1], edges[1:-1]):
        column = column.when(spot < edge, name)
    return column.otherwise(names[-1])


def fold_number(key: Column, k: int = 5, seed: int = 42) -> Column:
    return (hash_number(key, seed) % k).cast("int")


def exact_split(
    df: DataFrame,
    key: str,
    shares: dict[str, float],
    seed: int = 42,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Exact shares, per class with ``by``. Rows are ranked by hash inside hash buckets and
    the sizes of the buckets before are added, so no class is ever sorted in one task.
    The first names get floor(share * n) rows, the last one the rest."""
    placed = ranked_by_hash(df, key, seed, by)
    spot, total = F.col("_place"), F.col("_total")
    names = list(shares)
    edges = list(accumulate(shares.values()))
    column = F.lit(names[-1])
    for name, edge in reversed(list(zip(names[:-1], edges[:-1]))):
        column = F.when(spot < F.floor(total * F.lit(edge) + 1e-9), name).otherwise(column)
    return placed.withColumn("split", column).drop("_place", "_total")


def exact_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """Fold numbers with sizes that differ by one at most, per class with ``by``."""
    placed = ranked_by_hash(df, key, seed, by)
    return placed.withColumn("fold", (F.col("_place") % k).cast("int")).drop("_place", "_total")


def ranked_by_hash(df: DataFrame, key: str, seed: int, by: tuple[str, ...]) -> DataFrame:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    width = len(f"{_BUCKETS - 1:x}")
    hashed = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, width))
    keys = [*by, "_b"]
    before = W.partitionBy(*by, F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*by, F.lit(0))
    # At most 4096 rows per class, whatever the data size.
    sizes = hashed.groupBy(*keys).agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        F.sum("_n").over(every).alias("_total"),
    )
    inside = W.partitionBy(*keys).orderBy("_h", key)
    ranked = hashed.withColumn("_r", F.row_number().over(inside) - 1)
    return (
        ranked.join(stage(offsets, "buckets"), keys)
        .withColumn("_place", F.col("_r") + F.col("_o"))
        .select(*df.columns, "_place", "_total")
    )
