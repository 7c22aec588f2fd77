"""Adding columns computed from texts, whatever other columns a table has."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def add_from_text(docs: DataFrame, compute, added: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """All columns of ``docs`` except those named in ``added``, then the added ones.

    ``compute`` takes the text column of an Arrow batch and returns one Arrow array for each
    added column. No shuffle. Other columns travel under neutral names, so that names which
    clash with anything here do no harm."""
    new = [name for name, _ in added]
    kept = [c for c in docs.columns if c not in new]
    plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    source = docs.select(*plain, F.col(text).cast("string").alias("text_in"))
    result = source.drop("text_in").schema
    for name, kind in added:
        result = StructType([*result.fields, *StructType.fromDDL(f"`n_{name}` {kind}").fields])
    names = result.names

    def run(parts):
        for batch in parts:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *compute(batch.column(batch.num_columns - 1))], names)

    return source.mapInArrow(run, result).toDF(*kept, *new)


def under_neutral_names(docs: DataFrame, work, known: tuple[str, ...] = ("doc_id", "text", "source", "n_chars")) -> DataFrame:
    """The columns of ``docs`` after ``work`` on it, all but the ``known`` ones under neutral
    names meanwhile, so that none of them can clash with a column that ``work`` adds."""
    names = [c if c in known else f"carried_{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*names)).select(names).toDF(*docs.columns)
