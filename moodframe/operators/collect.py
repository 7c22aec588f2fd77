"""Labelling and de-duplication of collected posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodframe.functions.text import clean_collected_post, vector_words
from moodframe.session import lookup_join, stage

CUT = 0.3  # fixed value: polarity threshold


def polarity_class(polarity: Column) -> Column:
    """Above 0.3 positive, above -0.3 neutral, else negative. Null counts as 0."""
    p = F.coalesce(polarity, F.lit(0.0))
    return F.when(p > CUT, "positive").when(p > -CUT, "neutral").otherwise("negative")


def known_polarities(text: Column, lexicon: dict[str, float]) -> Column:
    """Polarities of the known words of a text, with a small fixed lexicon, inside the row."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in (kv[0], float(kv[1]))])
    known = F.filter(vector_words(text), lambda w: w.isin(list(lexicon)))
    return F.transform(known, lambda w: F.element_at(table, w))


def table_polarity(df: DataFrame, key: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """Mean polarity of the known words against a lexicon table (word, polarity): words are
    counted inside each text, then meet the lexicon, so a common word is one row a text. One
    formula, whether the lexicon is small enough to be broadcast or not."""
    counted = df.select(key, F.explode(vector_words(F.col(text_col))).alias("word")).groupBy(key, "word")
    hits = lookup_join(counted.agg(F.count("*").alias("_n")), lexicon, "word")
    return hits.groupBy(key).agg((F.sum(F.col("polarity") * F.col("_n")) / F.sum("_n")).alias("polarity"))


def label_posts(df: DataFrame, text_col: str, lexicon: dict[str, float]) -> DataFrame:
    """Cleaned text with its sentiment: the mean polarity of its known words, in class. Each
    step is its own column, so the patterns run once per post."""
    cleaned = df.withColumn(text_col, clean_collected_post(F.col(text_col)))
    values = cleaned.withColumn("_v", known_polarities(F.col(text_col), lexicon))
    mean = F.when(F.size("_v") > 0, F.aggregate("_v", F.lit(0.0), lambda s, v: s + v) / F.size("_v"))
    return values.withColumn("sentiment", polarity_class(mean)).drop("_v")


def post_digest() -> Column:
    """Digest of (text, sentiment), nulls included."""
    parts = F.coalesce("sentiment", F.lit("\x00")), F.lit("\x1f"), F.coalesce("text", F.lit("\x00"))
    return F.sha2(F.concat(*parts), 256)


def keep_unique_retweets(
    posts: DataFrame, arrival: str = "arrival", retweets: str = "retweet_count"
) -> DataFrame:
    """A post with retweets stays only if no equal (text, sentiment) came earlier; one
    without always stays.

    Equal posts meet by digest: the earliest arrival per digest is a minimum, combined before
    the shuffle, of narrow rows. Retweeted posts are then matched on (digest, arrival), which
    no two posts share, so a text that makes up a third of all posts is no hot key. Posts
    without retweets are not shuffled for their own sake."""
    # Written once: posts are read three times below, and cleaning them is the costly part.
    posts = stage(posts, "posts")
    keyed = posts.withColumn("_d", post_digest())
    first = keyed.groupBy("_d").agg(F.min(arrival).alias(arrival))
    kept = keyed.filter(F.col(retweets) > 0).join(first, ["_d", arrival], "left_semi").drop("_d")
    return posts.filter(F.col(retweets) <= 0).unionByName(kept)


def sentiment_shares(posts: DataFrame) -> DataFrame:
    """Share of each sentiment in percent; null for no posts."""
    part = lambda s: (100 * F.avg((F.col("sentiment") == s).cast("double"))).alias(s)
    return posts.agg(part("positive"), part("negative"), part("neutral"))
