"""Append-only tables: prediction log, feedback, users, runs, errors, JSON results, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, kind string, key string, value string"


def append_predictions(
    log: DataFrame, path: str, time_col: str = "created_at"
) -> None:
    """Appends log rows, one folder per day, so that period filters prune folders. Rows are
    rebalanced by day: small days become one file, a heavy day is split over many tasks."""
    dated = log.withColumn("created_date", F.to_date(time_col)).hint("rebalance", "created_date")
    dated.write.mode("append").partitionBy("created_date").parquet(path)


def read_predictions(spark: SparkSession, path: str, since=None) -> DataFrame:
    log = spark.read.parquet(path)
    return log if since is None else log.filter(F.col("created_date") >= F.lit(since).cast("date"))


def append_rows(rows: DataFrame, path: str) -> None:
    """Feedback, error and run rows."""
    rows.write.mode("append").parquet(path)


def new_users(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates (name, email, ...) whose e-mail is not taken, one per e-mail (first by
    name), with an id from a hash. A missing e-mail is always free; such rows skip both
    shuffles."""
    id_of = lambda *cols: F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16))
    taken = users.select("email").where(F.col("email").isNotNull())
    others = [c for c in candidates.columns if c != "email"]
    fresh = candidates.filter(F.col("email").isNotNull()).join(taken, "email", "left_anti")
    one = fresh.groupBy("email").agg(F.min(F.struct("name", *[c for c in others if c != "name"])).alias("_c"))
    named = one.select(*[F.col(f"_c.{c}").alias(c) for c in others], "email").withColumn("user_id", id_of("email"))
    blank = candidates.filter(F.col("email").isNull()).withColumn("user_id", id_of("name"))
    return named.unionByName(blank)


def flatten_settings(settings: dict, prefix: str = "") -> list[tuple[str, str]]:
    """Nested settings as (key.path, value) pairs."""
    flat = []
    for key, value in settings.items():
        path = f"{prefix}.{key}" if prefix else str(key)
        flat += flatten_settings(value, path) if isinstance(value, dict) else [(path, str(value))]
    return flat


def run_rows(spark: SparkSession, run_id: str, settings: dict | None = None, metrics: dict | None = None) -> DataFrame:
    """Parameters and metrics of one run as long rows."""
    rows = [(run_id, "param", k, v) for k, v in flatten_settings(settings or {})]
    rows += [(run_id, "metric", k, repr(float(v))) for k, v in (metrics or {}).items()]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def metric_rows(metrics: DataFrame, run_id, columns: list[str]) -> DataFrame:
    """Columns of a metrics frame as long run rows; ``run_id`` is a column."""
    wide = metrics.select(run_id.cast("string").alias("run_id"), *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot("run_id", columns, "key", "value")
    return long.select("run_id", F.lit("metric").alias("kind"), "key", F.col("value").cast("string").alias("value"))


def error_rows(refused: DataFrame, time_col, message_col: str = "reason", kind: str = "ValidationError") -> DataFrame:
    """Error-log rows (error_type, message, at) of refused requests."""
    return refused.select(F.lit(kind).alias("error_type"), F.col(message_col).alias("message"), time_col.alias("at"))


def write_json_results(results: DataFrame, path: str) -> None:
    """One JSON document per line and image."""
    results.select(F.to_json(F.struct(*results.columns)).alias("value")).write.mode("overwrite").text(path)


def save_model(spark: SparkSession, path: str, vocabulary, weights: DataFrame) -> None:
    """A relational model: the vocabulary table joined to its weights, and the row count."""
    table = vocabulary.table(spark).join(F.broadcast(weights), "idx").withColumn("n_docs", F.lit(vocabulary.n_docs))
    table.coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str):
    """(vocabulary, weight table) of a saved model."""
    from moodframe.operators.features import Vocabulary

    table = spark.read.parquet(path)
    rows = table.orderBy("idx").select("term", "n", "df", "n_docs").collect()
    vocabulary = Vocabulary(
        [r["term"] for r in rows], [r["n"] for r in rows], [r["df"] for r in rows], rows[0]["n_docs"] if rows else 0
    )
    return vocabulary, table.select("idx", *[c for c in table.columns if c[0] == "w" and c[1:].isdigit()])


def save_ml_model(fitted, path: str) -> None:
    PipelineModel([fitted]).write().overwrite().save(path)


def load_ml_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
