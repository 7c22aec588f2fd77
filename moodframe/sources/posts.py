"""Labelled post sources: CSV readers, column maps, union."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.functions.text import clean_post, tweet_preclean
from moodframe.operators.quality import map_values

TEXT, LABEL = "filtered_tweet", "is_depression"  # fixed values: names of the joint table


@dataclass(frozen=True)
class PostSource:
    """How one raw file maps to the joint table."""

    name: str
    text_col: str
    label_col: str
    encoding: str = "UTF-8"
    label_map: dict = field(default_factory=dict)
    null_text: str | None = None  # text put in place of a missing one


# The six sources.
POST_SOURCES = [
    PostSource("v1", "post_text", "label"),
    PostSource("v2", "filtered_tweet", "is_depression"),
    PostSource("v3", "text", "class", "ISO-8859-1", {"suicide": 1, "non-suicide": 0}, "nan"),
    PostSource("v4", "text", "label"),
    PostSource("v5", "message to examine", "label (depression result)"),
    PostSource("v6", "clean_text", "is_depression"),
]

# Fields of the headerless sentiment file.
SENTIMENT_SCHEMA = "sentiment int, ids long, date string, flag string, user string, text string"

#: What a reader takes for null besides a cell without anything. Spark's default, the empty text,
#: turns quoted empty texts into nulls.
NO_NULL = "\0"


def read_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None,
    header: bool = True, encoding: str = "UTF-8", multi_line: bool = True, keep_empty: bool = False,
) -> DataFrame:
    """CSV with quoted line breaks, one task a file; files without any split into tasks with
    ``multi_line`` off. Only the wanted columns are parsed. Without a schema
    every column is a string, so no pass is spent on guessing types. Quoted empty texts are nulls,
    as in the original's reader, unless ``keep_empty`` is set."""
    reader = spark.read.option("header", header).option("encoding", encoding)
    reader = reader.option("multiLine", multi_line).option("escape", '"')
    if keep_empty:
        reader = reader.option("nullValue", NO_NULL)
    if schema:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def read_sentiment140(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ISO-8859-1 file reduced to (sentiment 0/1, text); one line per row, so the
    file splits. Empty texts stay empty, missing ones are null."""
    raw = (
        spark.read.schema(SENTIMENT_SCHEMA).option("header", False).option("encoding", "ISO-8859-1")
        .option("escape", '"').option("nullValue", NO_NULL).csv(path)
    )
    return sentiment_columns(raw)


def sentiment_columns(raw: DataFrame) -> DataFrame:
    return raw.select(map_values(F.col("sentiment"), {4: 1}).alias("sentiment"), "text")


def read_posts(spark: SparkSession, path: str, source: PostSource) -> DataFrame:
    raw = read_csv(spark, path, [source.text_col, source.label_col], encoding=source.encoding)
    return map_posts(raw, source)


def map_posts(raw: DataFrame, source: PostSource) -> DataFrame:
    """Raw columns to the joint names, label to a whole number."""
    text = F.col(f"`{source.text_col}`").cast("string")
    if source.null_text is not None:
        text = F.coalesce(text, F.lit(source.null_text))
    label = F.col(f"`{source.label_col}`")
    if source.label_map:
        label = map_values(label.cast("string"), {k: str(v) for k, v in source.label_map.items()})
    return raw.select(text.alias(TEXT), label.cast("int").alias(LABEL), F.lit(source.name).alias("source"))


def clean_posts(posts: DataFrame, stop_words=None, lemmas=None) -> DataFrame:
    """Tweet pre-clean, then the post cleaner, as one projection."""
    return posts.withColumn(TEXT, clean_post(tweet_preclean(F.col(TEXT)), stop_words, lemmas))


def union_posts(parts: list[DataFrame]) -> DataFrame:
    """Bag union by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet or CSV; no index column is added."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
