"""Word frequency, collocation, cloud and collection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodframe.functions import text as tx
from moodframe.functions.lexicon import SAMPLE_POLARITY, SENTIMENT_STOP_WORDS
from moodframe.operators import collect as cl
from moodframe.operators import words as wd
from moodframe.plans.registry import LABELLED, labelled, query, quoted, table

_STOPS = quoted(sorted(SENTIMENT_STOP_WORDS))
_CLOUD_PATTERN = tx.CLOUD_WORD.replace("'", "''")
_CLOUD_TOKENS = (
    f"list_filter(list_transform(regexp_extract_all(lower(text), '{_CLOUD_PATTERN}'), "
    rf"lambda w: regexp_replace(w, '''s$', '')), lambda w: NOT regexp_full_match(w, '\p{{Nd}}+'))"
)
_WORDS = f"""{LABELLED},
    raw AS (SELECT label, unnest({_CLOUD_TOKENS}) AS term FROM labelled),
    counted AS (SELECT label, term, count(*) AS n FROM raw WHERE term NOT IN ({_STOPS}) GROUP BY ALL),
    words AS (SELECT c.label, CASE WHEN s.term IS NULL THEN c.term ELSE s.term END AS term, sum(c.n)::BIGINT AS n
      FROM counted c LEFT JOIN counted s ON s.label = c.label AND suffix(c.term, 's') AND NOT suffix(c.term, 'ss')
        AND s.term = left(c.term, length(c.term) - 1) GROUP BY ALL)"""


def _counts(spark, sf):
    return wd.word_counts(labelled(spark, sf), "text", ("label",), SENTIMENT_STOP_WORDS)


@query("a9_word_counts_by_class", f"WITH {_WORDS} SELECT label, term, n FROM words")
def word_counts(spark, sf):
    return _counts(spark, sf)


@query(
    "a11_top_words_by_class",
    f"""WITH {_WORDS} SELECT label, term, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS rn
      FROM words) WHERE rn <= 15""",
)
def top_by_class(spark, sf):
    return wd.top_words(_counts(spark, sf), 15, ("label",))


@query(
    "a11_top_words",
    f"""WITH raw AS (SELECT unnest({_CLOUD_TOKENS}) AS term FROM documents)
    SELECT term, count(*) AS n FROM raw WHERE term NOT IN ({_STOPS}) GROUP BY term ORDER BY n DESC, term LIMIT 1000""",
)
def top_words(spark, sf):
    counts = wd.word_counts(table(spark, sf, "documents"), "text", (), SENTIMENT_STOP_WORDS, plurals=False)
    return wd.top_words(counts, 1000)


@query(
    "a12_cloud_weights",
    f"""WITH {_WORDS}, top AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS rn FROM words)
    SELECT label, term, n, round(n / max(n) OVER (PARTITION BY label), 9) AS weight FROM top WHERE rn <= 200""",
)
def cloud_weights(spark, sf):
    return wd.cloud_weights(_counts(spark, sf), 200, ("label",)).withColumn("weight", F.round("weight", 9))


_L = lambda k, n, x: f"(ln(greatest({x}, 1e-10)) * ({k}) + ln(greatest(1 - ({x}), 1e-10)) * (({n}) - ({k})))"
_SCORE = (
    f"-2 * ({_L('n', 'c1', '(c2 / t)')} + {_L('c2 - n', 't - c1', '(c2 / t)')} - {_L('n', 'c1', '(n / c1)')} "
    f"- {_L('c2 - n', 't - c1', '((c2 - n) / (t - c1))')})"
)
_PLURAL = lambda c: f"suffix({c}, 's') AND NOT suffix({c}, 'ss')"


@query(
    "a10_word_and_pair_counts",
    f"""WITH lists AS MATERIALIZED (SELECT {_CLOUD_TOKENS} AS w FROM documents),
    singles AS (SELECT unnest(w) AS term FROM lists),
    uni AS MATERIALIZED (SELECT term, count(*) AS n, CASE WHEN {_PLURAL('term')} THEN left(term, length(term) - 1) ELSE term END AS key
      FROM singles WHERE term NOT IN ({_STOPS}) GROUP BY term),
    form AS MATERIALIZED (SELECT u.term, coalesce(s.term, u.term) AS form, u.n FROM uni u LEFT JOIN uni s ON s.term = u.key),
    utot AS MATERIALIZED (SELECT form AS term, sum(n)::BIGINT AS n FROM form GROUP BY form),
    side AS MATERIALIZED (SELECT f.term, f.form, u.n::DOUBLE AS c FROM form f JOIN utot u ON u.term = f.form),
    total AS MATERIALIZED (SELECT sum(n)::DOUBLE AS t FROM uni),
    pairs AS (SELECT unnest(list_zip(w[1:len(w) - 1], w[2:len(w)])) AS p FROM lists WHERE len(w) > 1),
    bi AS MATERIALIZED (SELECT term, n, CASE WHEN {_PLURAL('term')} THEN left(term, length(term) - 1) ELSE term END AS key FROM (
      SELECT p[1] || ' ' || p[2] AS term, count(*) AS n FROM pairs WHERE p[1] NOT IN ({_STOPS}) AND p[2] NOT IN ({_STOPS}) GROUP BY 1)),
    bform AS MATERIALIZED (SELECT term, n, split_part(term, ' ', 1) AS a, split_part(term, ' ', 2) AS b FROM (
      SELECT coalesce(s.term, b.term) AS term, sum(b.n)::BIGINT AS n FROM bi b LEFT JOIN bi s ON s.term = b.key GROUP BY 1)),
    scored AS (SELECT m.term, m.n, fa.form AS fa, fb.form AS fb, fa.c AS c1, fb.c AS c2, t FROM bform m
      JOIN side fa ON fa.term = m.a JOIN side fb ON fb.term = m.b CROSS JOIN total),
    passing AS MATERIALIZED (SELECT term, n, fa, fb FROM scored WHERE t > c1 AND t > c2 AND {_SCORE} > 30),
    used AS (SELECT term, sum(n) AS used FROM (SELECT fa AS term, n FROM passing UNION ALL SELECT fb, n FROM passing) GROUP BY term)
    SELECT term, n - coalesce(used, 0)::BIGINT AS n FROM utot LEFT JOIN used USING (term) WHERE n - coalesce(used, 0) > 0
    UNION ALL SELECT term, n FROM passing""",
)
def collocations(spark, sf):
    return wd.word_and_pair_counts(table(spark, sf, "documents"), "text", SENTIMENT_STOP_WORDS)


_POLARITY_CASE = "CASE w " + " ".join(f"WHEN '{w}' THEN {p}::DOUBLE" for w, p in SAMPLE_POLARITY.items()) + " END"
_CLASS = lambda p: f"CASE WHEN {p} > 0.3 THEN 'positive' WHEN {p} > -0.3 THEN 'neutral' ELSE 'negative' END"
_POSTS = rf"""cleaned AS (SELECT doc_id AS arrival, (n_chars % 2)::INT AS retweet_count,
      trim(regexp_replace(regexp_replace(text, '@[A-Za-z0-9]+|[^0-9A-Za-z \t]|[0-9A-Za-z][\p{{L}}\p{{N}}_]*://{tx.NOT_SPACE}+', ' ', 'g'),
        '{tx.SPACES}+', ' ', 'g')) AS text FROM documents),
    posts AS (SELECT arrival, retweet_count, text, {_CLASS('pol')} AS sentiment FROM (SELECT *,
      coalesce(round(list_avg(list_transform(list_filter(regexp_extract_all(lower(text), '{tx.WORD}'),
        lambda w: w IN ({quoted(SAMPLE_POLARITY)})), lambda w: {_POLARITY_CASE})), 9), 0) AS pol FROM cleaned))"""


def _posts(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("arrival"), "text", (F.col("n_chars") % 2).cast("int").alias("retweet_count")
    )
    return cl.label_posts(docs, "text", SAMPLE_POLARITY)


@query("s6_collected_posts", f"WITH {_POSTS} SELECT arrival, retweet_count, text, sentiment FROM posts")
def collected(spark, sf):
    return _posts(spark, sf)


@query(
    "l1_sentiment_of_text",
    f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS w FROM documents),
    scored AS (SELECT doc_id, round(avg({_POLARITY_CASE}), 9) AS polarity FROM words GROUP BY doc_id)
    SELECT d.doc_id, {_CLASS('coalesce(polarity, 0)')} AS sentiment FROM documents d LEFT JOIN scored USING (doc_id)""",
)
def sentiment(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lexicon = spark.createDataFrame(list(SAMPLE_POLARITY.items()), "word string, polarity double")
    scored = cl.table_polarity(docs, "doc_id", "text", lexicon)
    joined = docs.select("doc_id").join(scored, "doc_id", "left")
    return joined.select("doc_id", cl.polarity_class(F.round("polarity", 9)).alias("sentiment"))


_KEPT = """kept AS (SELECT arrival, retweet_count, text, sentiment FROM (SELECT *,
      row_number() OVER (PARTITION BY text, sentiment ORDER BY arrival) AS rn FROM posts) WHERE rn = 1 OR retweet_count <= 0)"""


@query("l2_unique_retweets", f"WITH {_POSTS}, {_KEPT} SELECT arrival, retweet_count, text, sentiment FROM kept")
def unique_retweets(spark, sf):
    return cl.keep_unique_retweets(_posts(spark, sf))


_PART = lambda s: f"round(100 * avg((sentiment = '{s}')::INT), 6) AS {s}"


@query("l3_sentiment_shares", f"WITH {_POSTS}, {_KEPT} SELECT {_PART('positive')}, {_PART('negative')}, {_PART('neutral')} FROM kept")
def shares(spark, sf):
    out = cl.sentiment_shares(cl.keep_unique_retweets(_posts(spark, sf)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "j7_stop_word_filter",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS term FROM documents)
    SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE term NOT IN ({_STOPS})) AS kept FROM w GROUP BY doc_id""",
)
def stop_words(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", tx.vector_words(F.col("text")).alias("w"))
    kept = F.filter("w", lambda t: ~t.isin(SENTIMENT_STOP_WORDS))
    sizes = words.select("doc_id", F.size("w").cast("bigint").alias("words"), F.size(kept).cast("bigint").alias("kept"))
    return sizes.filter(F.col("words") > 0)
