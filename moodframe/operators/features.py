"""Count vectoriser and TF-IDF.

The vocabulary is capped (as every run of the original caps it), so it is small enough to
hold once on the driver and ship to the tasks. Turning texts into vectors is then a narrow
step: no shuffle of the corpus, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from moodframe.functions.text import vector_words
from moodframe.session import stage

MAX_FEATURES = 30_000
MAX_FEATURES_LIMIT = 1_000_000


@dataclass
class Vocabulary:
    """Terms by falling count, with the numbers the TF-IDF formula needs."""

    terms: list[str]
    counts: list[int]
    doc_counts: list[int]
    n_docs: int

    @property
    def idf(self) -> list[float]:
        return [math.log((1 + self.n_docs) / (1 + d)) + 1 for d in self.doc_counts]

    def table(self, spark: SparkSession) -> DataFrame:
        columns = {
            "idx": pa.array(range(len(self.terms)), pa.int32()),
            "term": pa.array(self.terms, pa.string()),
            "n": pa.array(self.counts, pa.int64()),
            "df": pa.array(self.doc_counts, pa.int64()),
            "idf": pa.array(self.idf, pa.float64()),
        }
        return spark.createDataFrame(pa.table(columns))

    @cached_property
    def counter(self) -> CountVectorizerModel:
        """Spark's count vectoriser over these terms, built once: the terms cross to the JVM
        in one piece, as one by one takes seconds for a full vocabulary."""
        jvm = SparkContext.getOrCreate()._jvm
        array = jvm.org.apache.commons.lang3.StringUtils.split("\n".join(self.terms), "\n")
        model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", array)
        return model.setInputCol("_words").setOutputCol("_counts")


def _count_batch(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """Counts of the terms (last column, lists) of one batch by the values of the columns before."""
    lists = batch.column(batch.num_columns - 1)
    coded = lists.flatten().dictionary_encode()
    size = max(len(coded.dictionary), 1)
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    places, n = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    key = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[:-1]:
        own = column.dictionary_encode(null_encoding="encode")
        key = np.unique(key * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = pa.array(np.unique(key, return_index=True)[1])  # a row of each key
    pairs, spot = np.unique(key[places // size] * size + places % size, return_inverse=True)
    arrays = [c.take(first).take(pa.array(pairs // size)) for c in batch.columns[:-1]]
    counts = [np.bincount(spot, n, len(pairs)).astype(np.int64), np.bincount(spot, minlength=len(pairs))]
    return pa.RecordBatch.from_arrays([*arrays, coded.dictionary.take(pa.array(pairs % size)), *map(pa.array, counts)], names)


def term_counts(df: DataFrame, words: Column, *keys: str) -> DataFrame:
    """Term count ``n`` and document count ``df`` per term (and key). Tasks count whole batches of
    texts, so a term is a row a batch and not a row a token."""
    rows = df.select(*keys, F.array_compact(words).alias("_w"))
    schema = StructType([*rows.schema.fields[:-1], StructField("term", StringType()), StructField("n", LongType()), StructField("df", LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _count_batch(batch, names)

    counted = rows.mapInArrow(run, schema)
    return counted.groupBy(*keys, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _take(counts: DataFrame, n_docs: int, max_features: int) -> Vocabulary:
    if not 0 < max_features <= MAX_FEATURES_LIMIT:
        raise ValueError(f"max_features must be 1..{MAX_FEATURES_LIMIT}")
    rows = _frequent(stage(counts, "counts"), max_features).orderBy(F.desc("n"), "term").limit(max_features).collect()
    return Vocabulary([r["term"] for r in rows], [r["n"] for r in rows], [r["df"] for r in rows], n_docs)


def _frequent(counts: DataFrame, max_features: int) -> DataFrame:
    """Terms at least as frequent as the last one kept: a histogram of the counts, which has few
    distinct values, gives the threshold, so rare terms never leave their tasks."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("terms"))
    above = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    kept = sizes.withColumn("_above", F.coalesce(F.sum("terms").over(above), F.lit(0))).filter(F.col("_above") < max_features)
    least = kept.agg(F.min("n")).first()[0]
    return counts if least is None else counts.filter(F.col("n") >= least)


def words_of(df: DataFrame, text_col: str = "text") -> Column:
    """Token column of a frame: ``words`` if it is there already, else made from the text; a
    null has no words."""
    words = F.col("words") if "words" in df.columns else vector_words(F.col(text_col))
    return F.coalesce(words, F.array().cast("array<string>"))


def fit_vocabulary(df: DataFrame, text_col: str = "text", max_features: int = MAX_FEATURES) -> Vocabulary:
    """The most frequent terms; ties go by term."""
    return _take(term_counts(df, words_of(df, text_col)), df.count(), max_features)


def frequent_terms(df: DataFrame, text_col: str = "text", max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, idx) of the same terms as ``fit_vocabulary``, which also counts their texts."""
    if not 0 < max_features <= MAX_FEATURES_LIMIT:
        raise ValueError(f"max_features must be 1..{MAX_FEATURES_LIMIT}")
    counts = df.select(F.explode(words_of(df, text_col)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    top = _frequent(stage(counts, "counts"), max_features).orderBy(F.desc("n"), "term").limit(max_features).select("term").toArrow()
    return df.sparkSession.createDataFrame(top.append_column("idx", pa.array(range(top.num_rows), pa.int32())))


def fold_vocabularies(
    df: DataFrame, fold_col: str, k: int, text_col: str = "text", max_features: int = MAX_FEATURES
) -> list[Vocabulary]:
    """One vocabulary per fold, fitted on the rows outside it. The corpus is read once:
    counts per (fold, term) are summed over the other folds, and each task cuts its folds to
    ``max_features`` terms before the final ranking."""
    if not 0 < max_features <= MAX_FEATURES_LIMIT:
        raise ValueError(f"max_features must be 1..{MAX_FEATURES_LIMIT}")
    counts = term_counts(df, words_of(df, text_col), fold_col)
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold_col))
    rest = counts.select(F.explode(others).alias("_f"), "term", "n", "df")
    totals = rest.groupBy("_f", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    order = W.partitionBy("_f").orderBy(F.desc("n"), "term")
    top = totals.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max_features).toPandas()
    sizes = {r[fold_col]: r["n"] for r in df.groupBy(fold_col).agg(F.count("*").alias("n")).collect()}
    found = []
    for fold in range(k):
        rows = top[top["_f"] == fold].sort_values("_r")
        n_docs = sum(n for f, n in sizes.items() if f != fold)
        found.append(Vocabulary(rows["term"].tolist(), rows["n"].tolist(), rows["df"].tolist(), n_docs))
    return found


def count_vectors(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "counts") -> DataFrame:
    """Adds the sparse count vector; unseen terms drop out."""
    words = df.withColumn("_words", words_of(df, text_col))
    counted = vocabulary.counter.transform(words).drop("_words")
    return counted if out == "_counts" else counted.withColumnRenamed("_counts", out)


def tfidf_vectors(
    df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "features"
) -> DataFrame:
    """Adds the TF-IDF vector: count * idf, scaled to unit length. Narrow."""
    counted = count_vectors(df, vocabulary, text_col, "_counts")
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense(vocabulary.idf), inputCol="_counts", outputCol="_weighted"
    )
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=out)
    return unit.transform(weigh.transform(counted)).drop("_counts", "_weighted")


def sparse_arrays(df: DataFrame, vector_col: str = "features") -> DataFrame:
    """Replaces a sparse vector by plain array columns ``idx`` and ``val``."""
    return (
        df.withColumn("_u", F.unwrap_udt(vector_col))
        .withColumns({"idx": F.col("_u.indices"), "val": F.col("_u.values")})
        .drop("_u", vector_col)
    )


def long_rows(df: DataFrame, vector_col: str = "features") -> DataFrame:
    """One row per non-zero entry. A row with no known term stays, with null entry."""
    arrays = sparse_arrays(df, vector_col)
    keep = [c for c in arrays.columns if c not in ("idx", "val")]
    zipped = arrays.select(*keep, F.explode_outer(F.arrays_zip("idx", "val")).alias("_e"))
    return zipped.select(*keep, F.col("_e.idx").alias("idx"), F.col("_e.val").alias("val"))
