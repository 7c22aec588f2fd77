"""Row clean-up, request checks and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodframe.functions.text import not_blank
from moodframe.operators.ordered import exact_quantiles

# Request limits.
MAX_TEXT = 5000
MAX_NAME = 100
MAX_BATCH = 100
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def clean_labelled(
    df: DataFrame, text_col: str, label_col: str, subset: list[str] | None = None, order: str | None = None
) -> DataFrame:
    """Duplicates out, blank text out, null text or label out, only labels 0 and 1 stay.

    The row filters are deterministic on the compared columns, so they run before the
    de-duplication shuffle when whole rows are compared. With a subset, which copy stays
    decides the later checks: the first by ``order``, which is needed then.
    """

    def valid(frame: DataFrame) -> DataFrame:
        return frame.filter(
            not_blank(F.col(text_col)) & F.col(label_col).isNotNull() & F.col(label_col).isin(0, 1)
        )

    if subset is None or {text_col, label_col} <= set(subset):
        return valid(df).dropDuplicates(subset)
    if order is None:
        raise ValueError("copies that differ beside the compared columns need an order")
    row = F.struct(*df.columns)
    return valid(df.groupBy(*subset).agg(F.min_by(row, F.struct(order, row)).alias("_row")).select("_row.*"))


def class_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def class_shares(df: DataFrame, label_col: str) -> DataFrame:
    """Count and share per class; null labels are left out, as in the original."""
    known = df.filter(F.col(label_col).isNotNull())
    counts = class_counts(known, label_col)
    total = known.agg(F.count("*").alias("n")).scalar()
    return counts.select(label_col, "n", (F.col("n") / total).alias("share"))


def non_null_counts(df: DataFrame, key: str) -> DataFrame:
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(*[F.count(c).alias(c) for c in others])


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: nulls found. One pass over the data."""
    one_row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one_row.unpivot([], df.columns, "column_name", "nulls")


def table_info(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, non-null rows."""
    types = dict(df.dtypes)
    type_of = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    one_row = df.agg(
        F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    )
    long = one_row.unpivot(["_rows"], df.columns, "column_name", "non_null")
    return long.select(
        "column_name",
        type_of[F.col("column_name")].alias("column_type"),
        F.col("_rows").alias("row_count"),
        "non_null",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
    )


def describe_number(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles, max, per group if asked."""
    v = F.col(value).cast("double")
    base = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    quarts = exact_quantiles(df, value, [0.25, 0.5, 0.75], by).withColumnsRenamed(
        {"q0250": "p25", "q0500": "p50", "q0750": "p75"}
    )
    if by:
        return base.join(quarts, list(by))
    picked = quarts.select(F.struct("p25", "p50", "p75")).scalar()
    return base.withColumn("_q", picked).select("*", "_q.*").drop("_q")


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers at the last points inside 1.5 IQR, and outlier count per class."""
    quarts = exact_quantiles(df, value, [0.25, 0.5, 0.75], (by,))
    iqr = F.col("q0750") - F.col("q0250")
    fences = quarts.select(
        by,
        F.col("q0250").alias("q1"),
        F.col("q0500").alias("median"),
        F.col("q0750").alias("q3"),
        (F.col("q0250") - 1.5 * iqr).alias("_lo"),
        (F.col("q0750") + 1.5 * iqr).alias("_hi"),
    )
    v = F.col(value).cast("double")
    inside = v.between(F.col("_lo"), F.col("_hi"))
    # Grouped before the join: one row per distinct (class, value) carries its count.
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    return (
        counts.join(fences, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers"),
        )
    )


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """n / (number of classes * class count)."""
    counts = class_counts(df, label_col)
    facts = counts.agg((F.sum("n") / F.count("*")).alias("w")).scalar()
    return counts.select(label_col, "n", (facts / F.col("n")).alias("weight"))


def fold_band(scores: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and 95 percent band of fold scores: 2 * population std / sqrt(n)."""
    v = F.col(value)
    return scores.groupBy(*by).agg(
        F.count(v).alias("folds"),
        F.avg(v).alias("mean"),
        (2 * F.stddev_pop(v) / F.sqrt(F.count(v))).alias("band"),
    )


def array_range(df: DataFrame, array_col: str) -> DataFrame:
    """Smallest and largest element and the shape, reduced inside each row first."""
    a = F.col(array_col)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.max(F.size(a)).cast("bigint").alias("n_features"),
        F.min(F.array_min(a)).cast("double").alias("min_value"),
        F.max(F.array_max(a)).cast("double").alias("max_value"),
    )


def split_facts(df: DataFrame, split_col: str, array_col: str, label_col: str) -> DataFrame:
    return df.groupBy(split_col).agg(
        F.count("*").alias("samples"),
        F.max(F.size(array_col)).cast("bigint").alias("features"),
        F.countDistinct(label_col).alias("classes"),
    )


def request_errors(text: Column) -> Column:
    """Reason a request text is refused, null if it is accepted."""
    return (
        F.when(text.isNull(), "missing")
        .when(F.length(text) < 1, "too_short")
        .when(F.length(text) > MAX_TEXT, "too_long")
        .when(~not_blank(text), "blank")
    )


def user_errors(name: Column, email: Column) -> Column:
    """Reason a user row is refused: name of 1 to 100 characters, email form if given."""
    return (
        F.when(name.isNull(), "name_missing")
        .when(~F.length(name).between(1, MAX_NAME), "name_length")
        .when(email.isNotNull() & ~email.rlike(EMAIL), "email_form")
    )


def split_requests(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with a ``reason`` column)."""
    marked = df.withColumn("reason", request_errors(F.col(text_col)))
    return (
        marked.filter(F.col("reason").isNull()).drop("reason"),
        marked.filter(F.col("reason").isNotNull()),
    )


def batch_sizes(df: DataFrame, batch_col: str, max_size: int = MAX_BATCH) -> DataFrame:
    """One row per batch with its size and whether it is admitted."""
    sizes = df.groupBy(batch_col).agg(F.count("*").alias("n"))
    return sizes.withColumn("admitted", F.col("n") <= max_size)


def admitted_rows(df: DataFrame, batch_col: str, max_size: int = MAX_BATCH) -> DataFrame:
    """Rows of the batches within the limit. Only the too large batch ids are joined."""
    refused = batch_sizes(df, batch_col, max_size).filter(~F.col("admitted")).select(batch_col)
    return df.join(refused, batch_col, "left_anti")


def map_values(value: Column, table: dict) -> Column:
    """Replaces listed values, leaves the others."""
    return reduce(lambda c, kv: c.when(value == F.lit(kv[0]), F.lit(kv[1])), list(table.items())[1:],
                  F.when(value == F.lit(next(iter(table))), F.lit(next(iter(table.values()))))).otherwise(value)
