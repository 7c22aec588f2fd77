"""Streams over the prediction log and the posts: daily counts, counters, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moodframe.operators.collect import label_posts, post_digest


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def daily_counts(log: DataFrame, time_col: str = "created_at", lateness: str = "1 day") -> DataFrame:
    """Count per day on an unbounded log. Rows later than the watermark are dropped; state is
    one row per open day. ``count_days`` counts all rows."""
    timed = log.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", lateness)
    return timed.groupBy(F.window("_t", "1 day").alias("w")).agg(F.count("*").alias("count")).select(
        F.to_date("w.start").alias("date"), "count"
    )


def write_updates(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes every batch of changed rows to its own folder. A batch that is run again after
    a failure overwrites the same folder, so nothing counts twice."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        changes.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_values(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Newest value per key of a folder written by ``write_updates``."""
    return spark.read.parquet(path).groupBy(key).agg(F.max_by(value, "batch_id").alias(value))


def append_stream(log: DataFrame, path: str, checkpoint: str, time_col: str = "created_at") -> StreamingQuery:
    """Log append, one folder per day, exactly once by the file sink's own log."""
    return (
        log.withColumn("created_date", F.to_date(time_col)).writeStream.format("parquet").outputMode("append")
        .partitionBy("created_date").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def count_users(log: DataFrame, path: str, checkpoint: str, user_id: str = "user_id", time_col: str = "created_at") -> StreamingQuery:
    """Per-user counts of each batch, written to the batch's own folder; reading sums them."""

    def save(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(user_id).agg(F.count("*").alias("n"), F.max(time_col).alias("last"))
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        log.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def count_days(log: DataFrame, path: str, checkpoint: str, time_col: str = "created_at") -> StreamingQuery:
    """Per-day counts of each batch, written to the batch's own folder; reading sums them, so no
    row is too late to count."""

    def save(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.to_date(time_col).alias("date")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        log.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def day_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("date").agg(F.sum("n").alias("count"))


def user_counts(spark: SparkSession, path: str, user_id: str = "user_id") -> DataFrame:
    return spark.read.parquet(path).groupBy(user_id).agg(
        F.sum("n").alias("new_predictions"), F.max("last").alias("last_interaction")
    )


def labelled_posts_stream(posts: DataFrame, text_col: str, lexicon: dict[str, float]) -> DataFrame:
    """The collection rule on a stream: clean and label. ``write_unique_posts`` drops repeats."""
    return label_posts(posts, text_col, lexicon)


def earliest_posts(posts: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Per digest of (text, sentiment) the post that came first. On a stream the state is one row a
    digest; a post that turns out to be earlier replaces the one given before, whatever order
    files come in. Minima are combined before the shuffle, so a common text is no hot key."""
    rest = [F.col(c) for c in posts.columns if c != arrival]
    return posts.groupBy(post_digest().alias("digest")).agg(F.min(F.struct(F.col(arrival).alias("first"), *rest)).alias("post"))


def write_unique_posts(posts: DataFrame, path: str, checkpoint: str, arrival: str = "arrival", retweets: str = "retweet_count") -> list[StreamingQuery]:
    """The retweet rule on an endless stream of labelled posts: a post without retweets stays, one
    with retweets only if no equal post came earlier. Two streams of one source: posts without
    retweets go on as they are; of all posts the first of each digest is kept as state, and each
    batch writes the digests whose first post changed. ``unique_posts`` reads both."""
    plain = posts.filter(F.col(retweets) <= 0).writeStream.format("parquet").outputMode("append")
    plain = plain.option("path", f"{path}/plain").option("checkpointLocation", f"{checkpoint}-plain").trigger(availableNow=True).start()
    return [plain, write_updates(earliest_posts(posts, arrival), f"{path}/first", f"{checkpoint}-first")]


def unique_posts(spark: SparkSession, path: str, schema, arrival: str = "arrival", retweets: str = "retweet_count") -> DataFrame:
    """The posts that stay by all batches so far. A later batch can only name an earlier post, so
    the smallest of a digest takes the place of all that were given before it."""
    plain = spark.read.schema(schema).parquet(f"{path}/plain")
    names = [f.name for f in schema.fields]
    first = spark.read.parquet(f"{path}/first").groupBy("digest").agg(F.min("post").alias("post")).select("post.*").withColumnRenamed("first", arrival)
    return plain.unionByName(first.filter(F.col(retweets) > 0).select(names))
