"""Prediction log: users, relations, analytics.

A log row has at least: id column, user_id, created_at (timestamp without zone), prediction,
confidence, inference_time. "Now" is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = 50  # fixed value: default page length
POSITIVE = "Depressed"  # fixed value


def anonymous_id(request_id: Column) -> Column:
    """A new user id per request, derived from the request so that reruns agree."""
    return F.concat(F.lit("anon-"), F.substring(F.md5(request_id.cast("string")), 1, 16))


def resolve_users(requests: DataFrame, users: DataFrame, request_id: str, user_id: str = "user_id") -> DataFrame:
    """Adds ``resolved_user`` and ``is_anonymous``: known ids stay, the rest become new
    anonymous users. Requests without an id skip the join, so they make no hot key."""
    anon = anonymous_id(F.col(request_id))
    known = users.select(F.col(user_id).alias("_u")).where(F.col("_u").isNotNull()).distinct()
    named = requests.filter(F.col(user_id).isNotNull()).join(known, F.col(user_id) == F.col("_u"), "left")
    hit = F.col("_u").isNotNull()
    with_id = named.select(
        *requests.columns, F.when(hit, F.col(user_id).cast("string")).otherwise(anon).alias("resolved_user"),
        (~hit).alias("is_anonymous"),
    )
    without = requests.filter(F.col(user_id).isNull()).withColumns(
        {"resolved_user": anon, "is_anonymous": F.lit(True)}
    )
    return with_id.unionByName(without)


def log_with_users(log: DataFrame, users: DataFrame, user_id: str = "user_id") -> DataFrame:
    return log.join(users, user_id)


def delete_users(log: DataFrame, removed: DataFrame, user_id: str = "user_id") -> DataFrame:
    """Log without the rows of removed users."""
    return log.join(removed.select(user_id).distinct(), user_id, "left_anti")


def find_users(users: DataFrame, wanted: DataFrame, user_id: str = "user_id") -> DataFrame:
    return users.join(wanted.select(user_id).distinct(), user_id, "left_semi")


def find_user(users: DataFrame, value, user_id: str = "user_id") -> DataFrame:
    return users.filter(F.col(user_id) == F.lit(value))


def with_feedback(log: DataFrame, feedback: DataFrame, key: str = "prediction_id") -> DataFrame:
    return log.join(feedback, key, "left")


def feedback_confusion(log: DataFrame, feedback: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Predicted against corrected label: how often each pair occurs."""
    return log.join(feedback, key).groupBy("prediction", "correct_label").agg(F.count("*").alias("n"))


def in_period(log: DataFrame, now: str, days: int, time_col: str = "created_at") -> DataFrame:
    """Rows at or after now - days: a plain comparison that reaches the scan."""
    start = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return log.filter(F.col(time_col) >= start)


def analytics(log: DataFrame, now: str, days: int = 7, positive: str = POSITIVE, time_col: str = "created_at") -> DataFrame:
    """One pass, one row: total, distinct users, positive share, mean confidence and time."""
    rows = in_period(log, now, days, time_col)
    share = F.avg((F.col("prediction") == positive).cast("double"))
    zero = F.lit(0.0)
    return rows.agg(
        F.count("*").alias("total_predictions"),
        F.countDistinct("user_id").alias("unique_users"),
        F.coalesce(share, zero).alias("depression_rate"),
        F.coalesce(F.avg("confidence"), zero).alias("avg_confidence"),
        F.coalesce(F.avg("inference_time"), zero).alias("avg_inference_time"),
    )


def predictions_by_date(log: DataFrame, time_col: str = "created_at") -> DataFrame:
    day = F.to_date(F.col(time_col))
    return log.groupBy(day.alias("date")).agg(F.count("*").alias("count"))


def analytics_report(log: DataFrame, now: str, days: int = 7, positive: str = POSITIVE, time_col: str = "created_at") -> DataFrame:
    """Analytics with the daily counts as a sorted array and the period; one row. The array
    has one entry per day of the period."""
    daily = predictions_by_date(in_period(log, now, days, time_col), time_col)
    listed = daily.agg(F.sort_array(F.collect_list(F.struct("date", "count"))).alias("d"))
    return analytics(log, now, days, positive, time_col).withColumns(
        {
            "predictions_by_date": listed.scalar(),
            "period_days": F.lit(days),
            "timestamp": F.lit(now).cast("timestamp_ntz"),
        }
    )


def user_history(
    log: DataFrame, user, limit: int = PAGE, skip: int = 0, user_id: str = "user_id",
    time_col: str = "created_at", id_col: str = "id",
) -> DataFrame:
    """One user's page, newest first."""
    mine = log.filter(F.col(user_id) == F.lit(user))
    return mine.orderBy(F.desc(time_col), id_col).offset(skip).limit(limit)


def all_histories(
    log: DataFrame, limit: int = PAGE, skip: int = 0, user_id: str = "user_id",
    time_col: str = "created_at", id_col: str = "id",
) -> DataFrame:
    """The same page for every user; each task cuts its users to the page end before the
    shuffle, so a very active user costs ``skip + limit`` rows per task."""
    order = W.partitionBy(user_id).orderBy(F.desc(time_col), id_col)
    placed = log.withColumn("place", F.row_number().over(order))
    return placed.filter((F.col("place") > skip) & (F.col("place") <= skip + limit))


def user_activity(log: DataFrame, user_id: str = "user_id", time_col: str = "created_at") -> DataFrame:
    return log.groupBy(user_id).agg(
        F.count("*").alias("new_predictions"),
        F.min(time_col).alias("first_interaction"),
        F.max(time_col).alias("last_interaction"),
    )


def update_counters(users: DataFrame, log: DataFrame, user_id: str = "user_id", time_col: str = "created_at") -> DataFrame:
    """Users with totals raised by the log and the last interaction moved forward. Log rows
    of unknown users change nothing. ``users`` has total_predictions and last_interaction."""
    fresh = user_activity(log, user_id, time_col).select(user_id, "new_predictions", F.col("last_interaction").alias("_last"))
    joined = users.join(fresh, user_id, "left")
    return joined.withColumns(
        {
            "total_predictions": F.col("total_predictions") + F.coalesce("new_predictions", F.lit(0)),
            "last_interaction": F.greatest("last_interaction", "_last"),
        }
    ).drop("new_predictions", "_last")


def model_version(registry: DataFrame, name: str, stage: str | None = None, version: int | None = None) -> DataFrame:
    """Model address from its stage (newest version there), else from the version."""
    mine = registry.filter(F.col("name") == name)
    if stage is not None:
        mine = mine.filter(F.col("stage") == stage)
    else:
        mine = mine.filter(F.col("version") == version)
    newest = mine.groupBy("name").agg(F.max_by(F.struct("version", "uri"), "version").alias("m"))
    return newest.select("name", F.col("m.version").alias("version"), F.col("m.uri").alias("uri"))


def newest_by_stage(registry: DataFrame) -> DataFrame:
    """Newest version and address of every (name, stage)."""
    return registry.groupBy("name", "stage").agg(
        F.max("version").alias("version"), F.max_by("uri", "version").alias("uri")
    )
