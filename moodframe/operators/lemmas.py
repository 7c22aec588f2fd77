"""Dictionary lemmas: WordNet's noun rules over tables given by the caller.

``vocabulary`` has one column ``lemma`` (known nouns); ``exceptions`` has ``word`` and
``lemma``. Neither is shipped here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodframe.functions.lexicon import NOUN_SUFFIXES
from moodframe.session import LOOKUP_ROWS, lookup_join


def _stripped(word: Column) -> Column:
    """Candidates of one word after one round of the suffix rules, in rule order."""
    made = [
        F.when(word.endswith(old), F.concat(F.substring(word, F.lit(1), F.length(word) - len(old)), F.lit(new)))
        for old, new in NOUN_SUFFIXES
    ]
    return F.filter(F.array(*made), lambda c: c.isNotNull())


def _form(number: int, place: int, form: Column) -> Column:
    return F.struct(F.lit(number).alias("round"), F.lit(place).alias("place"), form.alias("form"))


def _candidates(word: Column) -> Column:
    """(round, place, form) for the word itself and every round of the rules. A round works
    on all forms of the one before, until no rule applies."""
    start = F.struct(
        F.array(_form(0, 0, word)).alias("seen"),
        F.array(word).alias("front"),
    )

    def turn(state, number):
        made = F.flatten(F.transform(state["front"], _stripped))
        rows = F.transform(
            made, lambda f, i: F.struct(number.alias("round"), (i + 1).cast("int").alias("place"), f.alias("form"))
        )
        return F.struct(F.concat(state["seen"], rows).alias("seen"), made.alias("front"))

    rounds = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.aggregate(rounds, start, turn, lambda s: s["seen"])


def lemma_table(words: DataFrame, vocabulary: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(word, lemma) for the distinct ``word`` values whose lemma differs.

    An exception word takes the shortest of itself (if known) and its listed lemmas. Else
    the first round that gives a known form decides, the word itself belonging to round 1;
    the shortest form wins, the earlier one on a tie."""
    word = F.col("word")
    endings = reduce(lambda a, b: a | b, [word.endswith(old) for old, _ in NOUN_SUFFIXES])
    listed = lookup_join(words.select("word"), exceptions.select("word"), "word", "left_semi").distinct()
    irregular = listed.join(exceptions.select("word", F.col("lemma").alias("_x")), "word").select(
        "word", F.explode(F.array(_form(0, 0, word), _form(0, 1, F.col("_x")))).alias("c")
    )
    # Without an ending of the rules a word is its own lemma: it never enters the shuffle.
    plain = lookup_join(words.select("word").filter(endings), exceptions.select("word"), "word", "left_anti").distinct()
    regular = plain.select("word", F.explode(_candidates(word)).alias("c"))
    with_rule = irregular.unionByName(regular).select("word", "c.round", "c.place", "c.form")
    known = lookup_join(with_rule, vocabulary.select(F.col("lemma").alias("form")).distinct(), "form", "left_semi")
    tier = F.greatest("round", F.lit(1))
    best = known.groupBy("word").agg(
        F.min(F.struct(tier.alias("t"), F.length("form").alias("l"), "round", "place", "form")).alias("b")
    )
    return best.select("word", F.col("b.form").alias("lemma")).filter(F.col("word") != F.col("lemma"))


def lemmatize(df: DataFrame, key: str, words_col: str, lemmas: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Token arrays with each token replaced by its lemma where there is one. A dictionary of at
    most ``max_rows`` words goes to every task and texts stay where they are; a larger one is
    joined, for which tokens are shuffled twice."""
    table = lemmas.select("word", "lemma").limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return _lemmatize_joined(df, key, words_col, lemmas)
    shipped = df.sparkSession.sparkContext.broadcast(table.combine_chunks())
    tokens = F.coalesce(F.array_compact(words_col), F.array().cast("array<string>")).alias(words_col)
    texts = df.select(key, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, forms = (shipped.value[c].combine_chunks() for c in ("word", "lemma"))
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            found = pc.coalesce(forms.take(pc.index_in(flat, value_set=words)), flat) if len(forms) else flat
            bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)], [key, words_col])

    return texts.mapInArrow(run, texts.schema)


def _lemmatize_joined(df: DataFrame, key: str, words_col: str, lemmas: DataFrame) -> DataFrame:
    """Texts keep their order; a text bounds the rows collected per key."""
    tokens = df.select(key, F.posexplode_outer(words_col).alias("pos", "word"))
    joined = lookup_join(tokens, lemmas, "word", "left")
    spot = F.when(F.col("word").isNotNull(), F.struct("pos", F.coalesce("lemma", "word").alias("w")))
    grouped = joined.groupBy(key).agg(F.sort_array(F.collect_list(spot)).alias("_s"))
    return grouped.select(key, F.transform("_s", lambda s: s["w"]).alias(words_col))
