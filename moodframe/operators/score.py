"""Scoring: ensembles, soft maximum, fixed-length encoding, bulk models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from moodframe.functions.text import vector_words
from moodframe.operators.features import MAX_FEATURES_LIMIT
from moodframe.operators.ordered import exact_quantiles

ENSEMBLE_THRESHOLD = 0.7  # fixed value
MAX_LENGTH = 128  # fixed value
PAD, UNKNOWN, START, END = 0, 1, 2, 3
FIRST_WORD_ID = 4


def ensemble(first: DataFrame, second: DataFrame, key: str, threshold: float = ENSEMBLE_THRESHOLD) -> DataFrame:
    """Mean of two class-1 probabilities; positive from the threshold on."""
    joined = first.select(key, F.col("p1").alias("_a")).join(second.select(key, F.col("p1").alias("_b")), key)
    p1 = (F.col("_a") + F.col("_b")) / 2
    return joined.select(
        key, p1.alias("p1"), (1 - p1).alias("p0"), ensemble_class(p1, threshold).alias("prediction")
    )


def ensemble_class(p1: Column, threshold: float = ENSEMBLE_THRESHOLD) -> Column:
    return F.when(p1 >= threshold, "Depressed").otherwise("Not depressed")


def softmax(logits: Column) -> Column:
    """Probabilities of a logit array, shifted by its maximum."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def with_softmax(df: DataFrame, logits_col: str) -> DataFrame:
    """Adds probabilities, the first largest class and its probability."""
    shifted = df.withColumn("_top", F.array_max(logits_col))
    raised = shifted.withColumn(
        "_e", F.transform(F.col(logits_col).cast("array<double>"), lambda x: F.exp(x - F.col("_top")))
    ).withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda s, x: s + x))
    return raised.withColumns(
        {
            "probabilities": F.transform("_e", lambda x: x / F.col("_sum")),
            "prediction": (F.array_position(logits_col, F.col("_top")) - 1).cast("int"),
            "confidence": 1 / F.col("_sum"),
        }
    ).drop("_top", "_e", "_sum")


def length_cap(df: DataFrame, length_col: str, limit: int = MAX_LENGTH, prob: float = 0.99) -> DataFrame:
    """One row: min(limit, whole part of the 99th percentile)."""
    q = exact_quantiles(df, length_col, [prob])
    return q.select(F.least(F.lit(limit), F.floor(F.col(q.columns[0]))).cast("bigint").alias("max_length"))


def encode_fixed(
    df: DataFrame, key: str, text_col: str, vocabulary: DataFrame, max_length: int = MAX_LENGTH
) -> DataFrame:
    """Token ids with start and end marks, cut or padded to ``max_length``, with attention
    mask and a flag for cut texts. ``vocabulary`` has term and idx, at most ``MAX_FEATURES_LIMIT``
    rows, which is checked; it goes to every task, and texts stay where they are."""
    room = max_length - 2
    words = F.coalesce(vector_words(F.col(text_col)), F.array().cast("array<string>"))
    cut = df.select(key, words.alias("_w")).select(key, F.slice("_w", 1, room).alias("_t"), (F.size("_w") > room).alias("truncated"))
    terms = vocabulary.select("term", F.col("idx").cast("int").alias("idx")).limit(MAX_FEATURES_LIMIT + 1).toArrow()
    if terms.num_rows > MAX_FEATURES_LIMIT:
        raise ValueError(f"more than {MAX_FEATURES_LIMIT} terms")
    shipped = df.sparkSession.sparkContext.broadcast(terms.combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = shipped.value["term"].combine_chunks(), np.append(shipped.value["idx"].to_numpy() + FIRST_WORD_ID, UNKNOWN).astype(np.int32)
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            spot = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), len(known)).to_numpy(zero_copy_only=False)
            ids = np.full((batch.num_rows, max_length), PAD, np.int32)
            place = np.arange(max_length)
            ids[(place > 0) & (place <= sizes[:, None])] = numbers[spot]
            ids[:, 0], ids[np.arange(len(sizes)), sizes + 1] = START, END
            mask = (place <= sizes[:, None] + 1).astype(np.int32)
            bounds = pa.array(np.arange(batch.num_rows + 1) * max_length, pa.int32())
            arrays = [pa.ListArray.from_arrays(bounds, pa.array(v.ravel())) for v in (ids, mask)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(sizes + 2, pa.int64()), batch.column(2)], names)

    schema = StructType(cut.select(key).schema.fields).add("input_ids", ArrayType(IntegerType())).add("attention_mask", ArrayType(IntegerType())).add("used", "long").add("truncated", "boolean")
    names = schema.names
    return cut.mapInArrow(run, schema)


def bulk_score(
    df: DataFrame,
    keys: list[str],
    feature_col: str,
    load_model: Callable[[], Callable],
    key_schema: str,
) -> DataFrame:
    """Runs a user's model over Arrow batches: ``load_model`` is called once per task and
    returns a function from a 2-D array to logits, or to one sigmoid value per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            if batch.empty:
                continue
            out = np.asarray(model(np.stack(batch[feature_col].to_numpy())), dtype=float)
            if out.ndim == 1:
                out = out[:, None]
            yield batch[keys].assign(logits=list(out))

    return df.select(*keys, feature_col).mapInPandas(run, f"{key_schema}, logits array<double>")


def sigmoid_class(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class of one-output models: above the threshold is class 1."""
    p = F.col("logits")[0]
    return scored.withColumns({"p1": p, "prediction": (p > threshold).cast("int")}).drop("logits")
