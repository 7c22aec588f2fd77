"""Word frequencies per class, collocations, cloud weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodframe.functions.text import cloud_words
from moodframe.session import LOOKUP_ROWS, stage

COLLOCATION_SCORE = 30  # fixed value: threshold of the likelihood-ratio score
BATCH_WORDS = 1 << 21  # words that a task counts at once


def _is_plural(term: Column) -> Column:
    return term.endswith("s") & ~term.endswith("ss")


def _stem(term: str) -> Column:
    return F.when(_is_plural(F.col(term)), F.expr(f"left({term}, length({term}) - 1)"))


def merge_plurals(counts: DataFrame, term: str = "term", n: str = "n", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of a plural move to its singular where that occurs in the same class. Both meet
    under the singular, which no third term shares: one shuffle, two rows a group at most."""
    key = F.coalesce(_stem(term), F.col(term))
    is_key = F.col(term) == F.col("_key")
    both = counts.withColumn("_key", key).groupBy(*by, "_key").agg(
        F.sum(F.when(is_key, F.col(n))).alias("_own"), F.sum(F.when(~is_key, F.col(n))).alias("_plural")
    )
    name = F.when(F.col("_own").isNull(), F.concat("_key", F.lit("s"))).otherwise(F.col("_key"))
    return both.select(*by, name.alias(term), (F.coalesce("_own", F.lit(0)) + F.coalesce("_plural", F.lit(0))).alias(n))


def word_counts(
    df: DataFrame,
    text_col: str,
    by: tuple[str, ...] = (),
    stop_words=(),
    plurals: bool = True,
) -> DataFrame:
    """Unigram counts per class. Each text is exploded where it lies; only partial counts
    per term are shuffled, so frequent words cost one row per task."""
    words = df.select(*by, F.explode(cloud_words(F.col(text_col), stop_words)).alias("term"))
    counts = words.groupBy(*by, "term").agg(F.count("*").alias("n"))
    return merge_plurals(stage(counts, "words"), by=by) if plurals else counts


def top_words(counts: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k most frequent words, per class if asked; ties go by term."""
    if not by:
        return counts.orderBy(F.desc("n"), "term").limit(k)
    order = W.partitionBy(*by).orderBy(F.desc("n"), "term")
    ranked = counts.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    return ranked.withColumn("rn", F.col("rn").cast("bigint"))


def cloud_weights(counts: DataFrame, max_words: int = 200, by: tuple[str, ...] = ()) -> DataFrame:
    """Frequency against the most frequent word of the class."""
    top = top_words(counts, max_words, by).drop("rn")
    peak = F.max("n").over(W.partitionBy(*by, F.lit(0)))
    return top.withColumn("weight", F.col("n") / peak)


def _log_part(k: Column, n: Column, x: Column) -> Column:
    tiny = F.lit(1e-10)
    return F.log(F.greatest(x, tiny)) * k + F.log(F.greatest(1 - x, tiny)) * (n - k)


def likelihood_ratio(c12: Column, c1: Column, c2: Column, n: Column) -> Column:
    """Dunning's (1993) score of a word pair; 0 where a word is every word."""
    p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / (n - c1)
    score = (
        _log_part(c12, c1, p)
        + _log_part(c2 - c12, n - c1, p)
        - _log_part(c12, c1, p1)
        - _log_part(c2 - c12, n - c1, p2)
    )
    return F.when((n <= c1) | (n <= c2), F.lit(0.0)).otherwise(-2 * score)


def _pair_batch(lists: pa.Array, drops: list[str]) -> pa.RecordBatch:
    """Counts of the words (``k`` null) and of the pairs of neighbours of a batch of texts. A pair is
    known by its first word and the key of its second: the stem of a plural, else the word."""
    coded = lists.flatten().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept = ~pc.is_in(terms, value_set=pa.array(drops, pa.string())).to_numpy(zero_copy_only=False)
    plural = pc.and_not(pc.ends_with(terms, "s"), pc.ends_with(terms, "ss")).to_numpy(zero_copy_only=False)
    keys = pc.if_else(pa.array(plural), pc.utf8_slice_codeunits(terms, 0, -1), terms).dictionary_encode()
    key_of, size = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(keys.dictionary), 1)
    inside = np.ones(len(code), bool)  # not the last word of its text
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    inside[ends[ends > 0] - 1] = False
    at = np.flatnonzero(inside)
    at = at[kept[code[at]] & kept[code[at + 1]]]
    second = code[at + 1]
    pairs, n = np.unique((code[at] * size + key_of[second]) * 2 + plural[second], return_counts=True)
    own = np.bincount(code, minlength=len(terms))
    words = np.flatnonzero(kept)
    first = pa.concat_arrays([terms.take(pa.array(words)), terms.take(pa.array(pairs // 2 // size))])
    key = pa.concat_arrays([pa.nulls(len(words), pa.string()), keys.dictionary.take(pa.array(pairs // 2 % size))])
    is_plural = np.append(np.zeros(len(words), bool), pairs % 2 == 1)
    return pa.RecordBatch.from_arrays([first, key, pa.array(is_plural), pa.array(np.append(own[words], n))], ["a", "k", "plural", "n"])


def _pair_parts(df: DataFrame, text_col: str, drops: list[str]) -> DataFrame:
    """(a, k, plural, n): counts of ``_pair_batch``, one row a batch of texts."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                begun = ends[first - 1] if first else 0
                last = max(int(np.searchsorted(ends, begun + BATCH_WORDS, "right")), first + 1)
                yield _pair_batch(lists.slice(first, last - first), drops)
                first = last

    return df.select(cloud_words(F.col(text_col)).alias("w")).mapInArrow(run, "a string, k string, plural boolean, n long")


def common_words(words: DataFrame, most: int | None = None) -> DataFrame:
    """The words whose count ``c`` is so large that at most ``most`` words have it: a histogram of
    the counts, which has few distinct values, gives the threshold."""
    above = W.orderBy(F.desc("c")).rowsBetween(W.unboundedPreceding, 0)
    sizes = words.groupBy("c").agg(F.count("*").alias("n")).withColumn("_above", F.sum("n").over(above))
    least = sizes.filter(F.col("_above") <= (most or LOOKUP_ROWS)).agg(F.min("c")).first()[0]
    return words.limit(0) if least is None else words.filter(F.col("c") >= least)


def _with_rare(pairs: DataFrame, rare: DataFrame, on: str) -> DataFrame:
    """Pairs that did not meet their word of column ``on`` among the common ones meet it by shuffle:
    a rare word stands in few pairs."""
    names = [on, f"f{on}", f"c{on}"]
    missed = pairs.filter(F.col(f"c{on}").isNull()).drop(*names[1:]).join(rare.toDF(*names), on)
    return pairs.filter(F.col(f"c{on}").isNotNull()).unionByName(missed)


def word_and_pair_counts(
    df: DataFrame, text_col: str, stop_words=(), threshold: float = COLLOCATION_SCORE, plurals: bool = True
) -> DataFrame:
    """Counts of words and of the pairs that pass the score; a passing pair takes its
    count off both its words, and words left with nothing drop out. Pairs are built inside
    each text, so no pair crosses two texts. Tasks count batches of texts; pairs are shuffled
    once, a plural meeting its singular there, and again only if they hold a rare word."""
    parts = _pair_parts(df, text_col, sorted({w.lower() for w in stop_words}))
    name = lambda key, plural: F.when(plural, F.concat(key, F.lit("s"))).otherwise(key)
    if plurals:
        met = parts.groupBy("a", "k").agg(F.sum(F.when(~F.col("plural"), F.col("n"))).alias("_own"), F.sum(F.when(F.col("plural"), F.col("n"))).alias("_plural"))
        n = F.coalesce("_own", F.lit(0)) + F.coalesce("_plural", F.lit(0))
        counts = met.select("a", name(F.col("k"), F.col("_own").isNull()).alias("b"), n.alias("n"))
    else:
        counts = parts.groupBy("a", name(F.col("k"), F.col("plural")).alias("b")).agg(F.sum("n").alias("n"))
    counts = stage(counts, "pairs")
    unigrams = counts.filter(F.col("b").isNull()).select(F.col("a").alias("term"), "n")
    pairs = counts.filter(F.col("b").isNotNull())

    # One row per word: the form it counts under and the count of that form. A plural and its
    # singular are the only terms that share a key, and no stem is a plural itself.
    if plurals:
        key, plural = F.coalesce(_stem("term"), F.col("term")), _is_plural(F.col("term"))
        both = unigrams.groupBy(key.alias("_key")).agg(
            F.sum(F.when(~plural, F.col("n"))).alias("_own"), F.sum(F.when(plural, F.col("n"))).alias("_plural")
        )
        own, more = F.when(F.col("_own").isNotNull(), F.col("_key")), F.when(F.col("_plural").isNotNull(), F.concat("_key", F.lit("s")))
        c = F.coalesce("_own", F.lit(0)) + F.coalesce("_plural", F.lit(0))
        words = both.select(F.coalesce(own, more).alias("form"), c.alias("c"), F.explode(F.array_compact(F.array(own, more))).alias("term"))
    else:
        words = unigrams.select(F.col("term").alias("form"), F.col("n").alias("c"), "term")
    words = stage(words, "words")
    unigram_totals = words.filter(F.col("term") == F.col("form")).select("term", F.col("c").alias("n"))

    total = unigrams.agg(F.sum("n").cast("double").alias("n")).scalar()
    sides = words.select("term", "form", F.col("c").cast("double").alias("c"))
    common = stage(common_words(sides), "common-words")
    rare = sides.join(F.broadcast(common.select("term")), "term", "left_anti")
    score = likelihood_ratio(F.col("n").cast("double"), F.col("ca"), F.col("cb"), total)
    # Common words come by broadcast. What meets both its words so is scored in place.
    met = pairs.join(F.broadcast(common.toDF("a", "fa", "ca")), "a", "left").join(F.broadcast(common.toDF("b", "fb", "cb")), "b", "left")
    missed = F.col("ca").isNull() | F.col("cb").isNull()
    met = stage(met.filter(missed | (score > threshold)), "met")
    late = _with_rare(_with_rare(met.filter(missed), rare, "a"), rare, "b").filter(score > threshold)
    passing = met.filter(~missed).unionByName(late)
    passing = stage(passing.select(F.concat_ws(" ", "a", "b").alias("term"), "fa", "fb", "n"), "collocations")
    taken = passing.select(F.explode(F.array("fa", "fb")).alias("term"), "n")
    taken = taken.groupBy("term").agg(F.sum("n").alias("used"))
    left = (
        unigram_totals.join(taken, "term", "left")
        .select("term", (F.col("n") - F.coalesce("used", F.lit(0))).alias("n"))
        .filter(F.col("n") > 0)
    )
    return left.unionByName(passing.select("term", "n"))
