"""A training-data pipeline over ``documents``: five stages, each on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns
of documents. Null or empty texts pass the filters (they are neither toxic nor copies), take no
words in the mix and so leave there. Rows that repeat an id are kept or dropped together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.llm import exact_substrings, near_duplicates, packing, source_mix, toxicity
from moodframe.llm.queries import table, vocabulary
from moodframe.session import stage

#: No SQL: trained scores, sketches and suffix sorting are beyond it. tests/llm compares the
#: stages with brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the whole table's
    labelled documents outside the held-out fifth, whatever ``docs`` holds."""
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    plain = docs.toDF(*[f"column_{i}" for i in range(len(docs.columns))]).withColumnRenamed(f"column_{docs.columns.index('text')}", "text")
    return toxicity.score_toxicity(plain, model).where("predicted = 0").select(plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles: the smallest id."""
    groups = near_duplicates.near_duplicate_groups(docs.select("doc_id", "text"), words=5, percent=80)
    lost = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(lost.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def under_neutral_names(docs: DataFrame, work) -> DataFrame:
    """``work`` on documents whose other columns travel under neutral names, so that no column of
    theirs can clash with one of an operator; then the old names."""
    known = ("doc_id", "text", "source", "n_chars")
    names = [c if c in known else f"other_column_{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*names)).select(names).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur again anywhere. Null texts stay null,
    repeated rows are cut alike, other columns keep their values whatever their names."""
    return under_neutral_names(docs, exact_substrings.without_repeats)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weighted mix of the sources takes them. Null and empty texts have
    no words and leave; other columns keep their values whatever their names."""
    return under_neutral_names(docs, source_mix.mixed_documents)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 token ids; repeats of a document are packed each."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mix", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
