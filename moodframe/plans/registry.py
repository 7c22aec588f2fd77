"""Registered queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.session import spread_small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return add


TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Text tables get one task per core if they come in a few small files."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(df) if name in TEXT_TABLES else df


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label, as (doc_id, text, lang, source, n_chars, label)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id")


LABELLED = """labelled AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality AS label
  FROM documents d JOIN labels l USING (doc_id))"""


def quoted(words) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def hash_sql(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT)"
