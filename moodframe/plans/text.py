"""Text queries: cleaning, tokens, lemmas, fixed-length encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodframe.functions import text as tx
from moodframe.functions.lexicon import EMOTICON_WORDS, NOUN_SUFFIXES, post_cleaner_drops
from moodframe.operators.features import MAX_FEATURES_LIMIT, frequent_terms
from moodframe.operators.lemmas import lemma_table, lemmatize
from moodframe.operators.score import encode_fixed, length_cap
from moodframe.plans.registry import query, quoted, table
from moodframe.session import stage

_SP = tx.SPACES
_NSP = tx.NOT_SPACE


def _bare_sql(source: str = "text") -> str:
    bare = rf"regexp_replace(lower({source}), '[^\x00-\x7F]+|[0-9{tx.PUNCTUATION}]+', '', 'g')"
    for word in ("can|not", "gim|me", "gon|na", "got|ta", "lem|me"):
        a, b = word.split("|")
        bare = rf"regexp_replace({bare}, '\b({a})({b})\b', '\1 \2', 'g')"
    bare = rf"regexp_replace({bare}, '\b(wan)(na)(\s|$)', '\1 \2\3', 'g')"
    return f"trim(regexp_replace({bare}, '{_SP}+', ' ', 'g'))"


_POST_WORDS = (
    f"list_filter(string_split({_bare_sql()}, ' '), "
    f"lambda w: length(w) > 1 AND w NOT IN ({quoted(post_cleaner_drops())}))"
)


def _emoticon_sql(inner: str) -> str:
    for sign, word in EMOTICON_WORDS.items():
        inner = "replace({}, '{}', '{}')".format(inner, sign.replace("'", "''"), word)
    return inner


def squeeze_sql(text: str) -> str:
    """Drops a character equal to the two before it."""
    return (
        f"list_aggregate(list_filter(string_split({text}, ''), lambda c, i: NOT (i > 2 AND c <> chr(10) "
        f"AND c = string_split({text}, '')[i - 1] AND c = string_split({text}, '')[i - 2])), 'string_agg', '')"
    )


@query("t1_clean_post", f"SELECT doc_id, array_to_string({_POST_WORDS}, ' ') AS cleaned FROM documents")
def clean_post(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_post(F.col("text")).alias("cleaned"))


@query(
    "t2_clean_collected_post",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(text,
      '@[A-Za-z0-9]+|[^0-9A-Za-z \t]|[0-9A-Za-z][\p{{L}}\p{{N}}_]*://{_NSP}+', ' ', 'g'), '{_SP}+', ' ', 'g')) AS cleaned
    FROM documents""",
)
def clean_collected(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_collected_post(F.col("text")).alias("cleaned"))


def _preclean_sql() -> str:
    out = "text"
    for pattern in (tx.TWEET_URL, tx.TWEET_HASHTAG, tx.TWEET_MENTION, r"\b(?:RT|FAV)\b", tx.TWEET_EMOJI, tx.TWEET_SMILEY, tx.TWEET_NUMBER):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return f"SELECT doc_id, trim(regexp_replace({out}, '{_SP}+', ' ', 'g')) AS cleaned FROM documents"


@query("t3_tweet_preclean", _preclean_sql())
def tweet_preclean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.tweet_preclean(F.col("text")).alias("cleaned"))


@query(
    "t4_sentiment_clean",
    f"""WITH a AS (SELECT doc_id, regexp_replace(lower(text), '{tx.URL_LOWER}', '', 'g') AS t FROM documents),
    b AS (SELECT doc_id, {_emoticon_sql('t')} AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '@{_NSP}+', '', 'g'), '[^a-zA-Z0-9]', ' ', 'g') AS t FROM b),
    d AS (SELECT doc_id, string_split(t, '') AS ch FROM c),
    e AS (SELECT doc_id, list_aggregate(list_filter(ch, lambda x, i: NOT (i > 2 AND x = ch[i - 1] AND x = ch[i - 2])),
          'string_agg', '') AS t FROM d)
    SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(string_split(t, ' '), lambda w: length(w) > 1),
      lambda w: w || ' '), ''), '') AS cleaned FROM e""",
)
def sentiment_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.sentiment_clean(F.col("text")).alias("cleaned"))


@query("t5_lower", "SELECT doc_id, lower(text) AS lowered FROM documents")
def lower(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower("text").alias("lowered"))


@query(
    "t6_squeeze_repeats",
    """WITH d AS (SELECT doc_id, string_split(text, '') AS ch FROM documents)
    SELECT doc_id, coalesce(list_aggregate(list_filter(ch, lambda x, i: NOT (i > 2 AND x <> chr(10)
      AND x = ch[i - 1] AND x = ch[i - 2])), 'string_agg', ''), '') AS squeezed FROM d""",
)
def squeeze(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.squeeze_repeats(F.col("text")).alias("squeezed"))


@query("t7_replace_emoticons", f"SELECT doc_id, {_emoticon_sql('text')} AS replaced FROM documents")
def emoticons(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.replace_emoticons(F.col("text")).alias("replaced"))


@query(
    "t8_treebank_words",
    f"""WITH w AS (SELECT doc_id, list_filter(string_split({_bare_sql()}, ' '), lambda x: x <> '') AS words FROM documents)
    SELECT doc_id, len(words)::BIGINT AS n_words, array_to_string(words, ' ') AS words FROM w""",
)
def treebank(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", tx.treebank_words(tx.bare_text(F.col("text"))).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.array_join("w", " ").alias("words"))


# Exceptions for the lemma queries: a sample of irregular nouns.
_IRREGULAR = {"men": "man", "women": "woman", "children": "child", "feet": "foot", "mice": "mouse"}


def _nouns(spark, sf):
    """Stand-in vocabulary: the words of the benchmark passages."""
    words = tx.vector_words(F.col("text"))
    return table(spark, sf, "benchmark").select(F.explode(words).alias("lemma")).distinct()


def _lemmas(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(tx.vector_words(F.col("text"))).alias("word"))
    irregular = spark.createDataFrame(list(_IRREGULAR.items()), "word string, lemma string")
    return lemma_table(words, _nouns(spark, sf), irregular)


def _rule_sql() -> str:
    cases = " UNION ALL ".join(
        f"SELECT word, round + 1, substr(form, 1, length(form) - {len(old)}) || '{new}' FROM front WHERE suffix(form, '{old}')"
        for old, new in NOUN_SUFFIXES
    )
    return cases


_LEMMA_SQL = f"""words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS word FROM documents),
    nouns AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS lemma FROM benchmark),
    irregular AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _IRREGULAR.items())}) t(word, lemma)),
    front(word, round, form) AS (
      SELECT word, 0, word FROM words WHERE word NOT IN (SELECT word FROM irregular)
      UNION ALL
      SELECT * FROM ({_rule_sql()})),
    options AS (
      SELECT word, greatest(round, 1) AS tier, round, form FROM front
      UNION ALL SELECT word, 1, 0, word FROM words JOIN irregular USING (word)
      UNION ALL SELECT word, 1, 1, lemma FROM words JOIN irregular USING (word)),
    best AS (
      SELECT word, arg_min(form, (tier * 1000000 + length(form)) * 100 + round) AS lemma
      FROM options WHERE form IN (SELECT lemma FROM nouns) GROUP BY word)"""


@query("t9_lemma_table", f"WITH RECURSIVE {_LEMMA_SQL} SELECT word, lemma FROM best WHERE word <> lemma")
def lemmas(spark, sf):
    return _lemmas(spark, sf)


@query(
    "t9_lemmatized_text",
    f"""WITH RECURSIVE {_LEMMA_SQL},
    tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS word,
      generate_subscripts(regexp_extract_all(lower(text), '{tx.WORD}'), 1) AS pos FROM documents),
    mapped AS (SELECT t.doc_id, string_agg(coalesce(b.lemma, t.word), ' ' ORDER BY pos) AS words
      FROM tokens t LEFT JOIN best b USING (word) GROUP BY t.doc_id)
    SELECT d.doc_id, coalesce(m.words, '') AS words FROM documents d LEFT JOIN mapped m USING (doc_id)""",
)
def lemmatized(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tx.vector_words(F.col("text")).alias("words"))
    done = lemmatize(docs, "doc_id", "words", stage(_lemmas(spark, sf), "lemmas"))
    return done.select("doc_id", F.array_join("words", " ").alias("words"))


@query("t10_text_length", "SELECT doc_id, length(text)::BIGINT AS text_length FROM documents")
def text_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.text_length(F.col("text")).cast("bigint").alias("text_length"))


@query(
    "t11_vector_words",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{tx.WORD}') AS words FROM documents)
    SELECT doc_id, len(words)::BIGINT AS n_words, md5(array_to_string(words, ' ')) AS words_md5 FROM w""",
)
def vector_words(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", tx.vector_words(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


_ENCODE_TERMS = MAX_FEATURES_LIMIT


@query(
    "t12_fixed_length_encoding",
    f"""WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS term,
      generate_subscripts(regexp_extract_all(lower(text), '{tx.WORD}'), 1) AS pos FROM documents),
    vocab AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS idx FROM tokens GROUP BY term
      ORDER BY count(*) DESC, term LIMIT {_ENCODE_TERMS}),
    ids AS (SELECT t.doc_id, list(coalesce(v.idx + 4, 1) ORDER BY pos) FILTER (WHERE pos <= 126) AS body, max(pos) > 126 AS truncated
      FROM tokens t LEFT JOIN vocab v USING (term) GROUP BY t.doc_id),
    whole AS (SELECT d.doc_id, [2] || coalesce(i.body, []) || [3] AS seq, coalesce(i.truncated, false) AS truncated
      FROM documents d LEFT JOIN ids i USING (doc_id))
    SELECT doc_id, array_to_string(list_resize(seq, 128, 0), ' ') AS input_ids,
      array_to_string(list_transform(range(128), lambda i: CASE WHEN i < len(seq) THEN 1 ELSE 0 END), ' ') AS attention_mask,
      len(seq)::BIGINT AS used, truncated FROM whole""",
)
def encoding(spark, sf):
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", "text")
    vocabulary = frequent_terms(words, "text", _ENCODE_TERMS)
    coded = encode_fixed(docs, "doc_id", "text", vocabulary)
    as_text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return coded.select("doc_id", as_text("input_ids"), as_text("attention_mask"), "used", "truncated")


@query(
    "t13_length_cap",
    "SELECT least(128, floor(quantile_cont(length(text), 0.99)))::BIGINT AS max_length FROM documents",
)
def cap(spark, sf):
    docs = table(spark, sf, "documents").select(F.length("text").alias("text_length"))
    return length_cap(docs, "text_length")
