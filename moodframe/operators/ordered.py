"""Running totals and exact quantiles over a global order, without a one-task window.

Rows are first grouped to distinct values, then ranked inside value ranges; the totals of
the ranges before are added as offsets. A value held by a third of all rows is one row
after the grouping, so it cannot make a hot range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodframe.session import stage


def _cut_points(df: DataFrame, value: str, ranges: int) -> list[float]:
    marks = [i / ranges for i in range(1, ranges)]
    if not marks:
        return []
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), marks, 10_000).alias("c")).first()
    return sorted(set(row["c"] or []))


def running_totals(
    grouped: DataFrame, value: str, counts: list[str], by: tuple[str, ...] = ()
) -> DataFrame:
    """Adds ``<count>_upto`` (inclusive running sum in ascending ``value`` order) for each
    count column. ``grouped`` holds one row per (by, value) and is staged by the caller."""
    spark = grouped.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cut_points(grouped, value, ranges)
    keyed = grouped.withColumn("_v", F.col(value).cast("double"))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        keyed = Bucketizer(splits=splits, inputCol="_v", outputCol="_range").transform(keyed)
        keyed = keyed.withColumn("_range", F.col("_range").cast("int"))
    else:
        keyed = keyed.withColumn("_range", F.lit(0))
    keys = [*by, "_range"]
    before = W.partitionBy(*by, F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # One row per (by, range): as many as there are ranges, whatever the data size.
    offsets = (
        keyed.groupBy(*keys)
        .agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
        .select(*keys, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in counts])
    )
    inside = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = keyed.select("*", *[F.sum(c).over(inside).alias(f"_i_{c}") for c in counts])
    joined = ranked.join(offsets, keys)
    return joined.select(
        *[c for c in grouped.columns],
        *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).cast("bigint").alias(f"{c}_upto") for c in counts],
    )


def quantile_columns(probs) -> list[str]:
    return [f"q{round(p * 1000):04d}" for p in probs]


def exact_quantiles(df: DataFrame, value: str, probs, by: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles with linear interpolation, one row per group, columns q0250 and so on.
    Nulls are left out."""
    grouped = stage(
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), "values"
    )
    run = running_totals(grouped, value, ["n"], by)
    if by:
        run = run.join(grouped.groupBy(*by).agg(F.sum("n").alias("_all")), list(by))
    else:
        run = run.withColumn("_all", grouped.agg(F.sum("n")).scalar())
    picks, outs = [], []
    v = F.col(value).cast("double")
    for p, name in zip(probs, quantile_columns(probs)):
        spot = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1
        picks += [
            F.max(F.when(low.between(first, last), v)).alias(f"_l{name}"),
            F.max(F.when(high.between(first, last), v)).alias(f"_h{name}"),
            F.max(spot - low).alias(f"_w{name}"),
        ]
        outs.append(
            (F.col(f"_l{name}") + (F.col(f"_h{name}") - F.col(f"_l{name}")) * F.col(f"_w{name}")).alias(name)
        )
    return run.groupBy(*by).agg(*picks).select(*by, *outs)
