"""Image folders and their label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_images(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """Decoded images (blue first); files that do not decode are left out. ``tasks`` spreads
    a small folder over the cluster."""
    raw = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    rows = raw.select(
        F.url_decode(F.element_at(F.split("origin", "/"), -1)).alias("name"),
        "height", "width", F.col("nChannels").alias("n_channels"), F.col("data").alias("pixels"),
    )
    return rows.repartition(tasks) if tasks else rows


def image_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of all files of a folder, decodable or not; no file content is read."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """(name, label): the first column names the file, the second is the label."""
    raw = spark.read.option("header", True).csv(path)
    first, second = raw.columns[:2]
    return raw.select(F.col(f"`{first}`").alias("name"), F.col(f"`{second}`").cast("int").alias("label"))
