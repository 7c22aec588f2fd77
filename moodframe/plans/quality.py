"""Row clean-up, profile and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodframe.functions.text import text_length
from moodframe.operators import quality as q
from moodframe.operators.ordered import exact_quantiles
from moodframe.operators.split import fold_number, split_name
from moodframe.plans.registry import LABELLED, hash_sql, labelled, query, table
from moodframe.sources import posts as ps

_BLANK = r"regexp_matches(text, '[^\s]')"


@query("r1_select_rename", "SELECT text AS filtered_tweet, lang AS language, doc_id AS post_id FROM documents")
def select_rename(spark, sf):
    docs = table(spark, sf, "documents").select("text", "lang", "doc_id")
    return docs.withColumnsRenamed({"text": "filtered_tweet", "lang": "language", "doc_id": "post_id"})


@query(
    "r2_value_map",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'Depressed' WHEN 'click' THEN 'Not depressed'
      ELSE event_type END AS mapped FROM events""",
)
def value_map(spark, sf):
    mapped = q.map_values(F.col("event_type"), {"error": "Depressed", "click": "Not depressed"})
    return table(spark, sf, "events").select("event_id", mapped.alias("mapped"))


@query(
    "r3_cast_missing_text",
    """SELECT doc_id, coalesce(CASE WHEN n_chars % 7 = 0 THEN NULL ELSE text END, 'nan') AS filtered_tweet,
      CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS is_depression FROM documents""",
)
def cast_missing(spark, sf):
    raw = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("n_chars") % 7 == 0, None).otherwise(F.col("text")).alias("text"),
        F.when(F.col("lang") == "en", "suicide").otherwise("non-suicide").alias("class"),
    )
    source = ps.POST_SOURCES[2]
    text = F.coalesce(F.col("text").cast("string"), F.lit(source.null_text)).alias(ps.TEXT)
    label = q.map_values(F.col("class"), {k: str(v) for k, v in source.label_map.items()})
    return raw.select("doc_id", text, label.cast("int").alias(ps.LABEL))


@query("r4_class_filter", f"WITH {LABELLED} SELECT doc_id, text FROM labelled WHERE label = 1")
def class_filter(spark, sf):
    return labelled(spark, sf).filter(F.col("label") == 1).select("doc_id", "text")


def _with_gaps(spark, sf):
    """Labelled texts with duplicates, gaps and a third class, from the given columns."""
    rows = labelled(spark, sf)
    text = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 13 == 0, "  ").otherwise(F.col("text"))
    label = F.when(F.col("n_chars") % 9 == 0, None).when(F.col("n_chars") % 10 == 0, 2).otherwise(F.col("label"))
    return rows.select(text.alias("text"), label.alias("label"))


_GAPS = f"""{LABELLED}, gaps AS (SELECT
      CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '  ' ELSE text END AS text,
      CASE WHEN n_chars % 9 = 0 THEN NULL WHEN n_chars % 10 = 0 THEN 2 ELSE label END AS label FROM labelled)"""
_VALID = f"{_GAPS}, valid AS (SELECT DISTINCT text, label FROM gaps WHERE {_BLANK} AND label IN (0, 1))"


@query("r5_clean_and_validate", f"WITH {_VALID} SELECT text, label FROM valid")
def clean_and_validate(spark, sf):
    return q.clean_labelled(_with_gaps(spark, sf), "text", "label")


@query("r5_validated_class_counts", f"WITH {_VALID} SELECT label, count(*) AS n FROM valid GROUP BY label")
def validated_counts(spark, sf):
    return q.class_counts(q.clean_labelled(_with_gaps(spark, sf), "text", "label"), "label")


@query("r6_drop_nulls", f"WITH {_GAPS} SELECT text, label FROM gaps WHERE text IS NOT NULL AND label IS NOT NULL")
def drop_nulls(spark, sf):
    return _with_gaps(spark, sf).dropna()


@query("r7_drop_duplicates", "SELECT DISTINCT text, lang FROM documents")
def drop_duplicates(spark, sf):
    return table(spark, sf, "documents").select("text", "lang").dropDuplicates()


_REASON = r"""CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 1 THEN 'too_short'
      WHEN length(text) > 5000 THEN 'too_long' WHEN NOT regexp_matches(text, '[^\s]') THEN 'blank' END"""


@query("r8_request_validation", f"SELECT doc_id, {_REASON} AS reason FROM documents")
def request_validation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", q.request_errors(F.col("text")).alias("reason"))


@query("r8_accepted_requests", f"SELECT doc_id, text FROM documents WHERE {_REASON} IS NULL")
def accepted_requests(spark, sf):
    return q.split_requests(table(spark, sf, "documents").select("doc_id", "text"))[0]


@query(
    "r8_user_validation",
    r"""WITH u AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_name
      ELSE lower(c_name) || '@example.org' END AS email FROM customer)
    SELECT c_custkey, CASE WHEN c_name IS NULL THEN 'name_missing' WHEN NOT length(c_name) BETWEEN 1 AND 100 THEN 'name_length'
      WHEN email IS NOT NULL AND NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email_form' END AS reason FROM u""",
)
def user_validation(spark, sf):
    name = F.col("c_name")
    email = (
        F.when(F.col("c_custkey") % 3 == 0, None).when(F.col("c_custkey") % 5 == 0, name)
        .otherwise(F.concat(F.lower(name), F.lit("@example.org")))
    )
    return table(spark, sf, "customer").select("c_custkey", q.user_errors(name, email).alias("reason"))


@query(
    "r9_batch_sizes",
    "SELECT conv_id, count(*) AS n, count(*) <= 6 AS admitted FROM conversations GROUP BY conv_id",
)
def batch_sizes(spark, sf):
    return q.batch_sizes(table(spark, sf, "conversations"), "conv_id", 6)


@query(
    "r9_admitted_rows",
    """SELECT conv_id, turn, role, text FROM conversations
    WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) <= 6)""",
)
def admitted_rows(spark, sf):
    return q.admitted_rows(table(spark, sf, "conversations"), "conv_id", 6)


@query(
    "j1_union_sources",
    """SELECT doc_id, text, NULL::VARCHAR AS n_chars, 'de' AS part FROM documents WHERE lang = 'de'
    UNION ALL BY NAME SELECT doc_id, text, n_chars::VARCHAR AS n_chars, 'en' AS part FROM documents WHERE lang = 'en'
    UNION ALL BY NAME SELECT n_chars::VARCHAR AS n_chars, doc_id, 'fr' AS part FROM documents WHERE lang = 'fr'
    UNION ALL BY NAME SELECT doc_id, 'other' AS part, text FROM documents WHERE lang IS NULL OR lang NOT IN ('de', 'en', 'fr')""",
)
def union_sources(spark, sf):
    docs = table(spark, sf, "documents").withColumn("n_chars", F.col("n_chars").cast("string"))
    part = lambda lang, *cols: docs.filter(F.col("lang") == lang).select(*cols, F.lit(lang).alias("part"))
    other = docs.filter(F.col("lang").isNull() | ~F.col("lang").isin("de", "en", "fr")).select("doc_id", F.lit("other").alias("part"), "text")
    return ps.union_posts([part("de", "doc_id", "text"), part("en", "doc_id", "text", "n_chars"), part("fr", "n_chars", "doc_id"), other])


@query(
    "j2_concat_splits",
    f"""WITH s AS (SELECT vec_id, label, {hash_sql('vec_id')} % 100 < 80 AS train FROM embeddings)
    SELECT vec_id, label FROM s WHERE train UNION ALL SELECT vec_id, label FROM s WHERE NOT train""",
)
def concat_splits(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    rows = rows.withColumn("split", split_name(F.col("vec_id"), {"train": 0.8, "test": 0.2}))
    part = lambda name: rows.filter(F.col("split") == name).select("vec_id", "label")
    return part("train").union(part("test"))


@query("a1_class_counts", f"WITH {LABELLED} SELECT lang, label, count(*) AS n FROM labelled GROUP BY ALL")
def class_counts(spark, sf):
    return q.class_counts(labelled(spark, sf), "lang", "label")


@query(
    "a2_class_shares",
    f"WITH {LABELLED} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM labelled GROUP BY label",
)
def class_shares(spark, sf):
    return q.class_shares(labelled(spark, sf), "label").withColumn("share", F.round("share", 9))


@query(
    "a3_non_null_counts",
    """SELECT event_type, count(event_id) AS event_id, count(ts) AS ts, count(user_id) AS user_id, count(value) AS value,
      count(props) AS props FROM events GROUP BY event_type""",
)
def non_null_counts(spark, sf):
    return q.non_null_counts(table(spark, sf, "events"), "event_type")


@query(
    "a4_null_counts",
    f"""WITH {_GAPS} SELECT 'text' AS column_name, count(*) - count(text) AS nulls FROM gaps
    UNION ALL SELECT 'label', count(*) - count(label) FROM gaps""",
)
def null_counts(spark, sf):
    return q.null_counts(_with_gaps(spark, sf))


@query(
    "a5_describe_text_length",
    """SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 4) AS std,
      min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, round(quantile_cont(n_chars, 0.25), 6) AS p25,
      round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75 FROM documents""",
)
def describe(spark, sf):
    lengths = table(spark, sf, "documents").select(text_length(F.col("text")).alias("n_chars"))
    out = q.describe_number(lengths, "n_chars")
    six = ["mean", "p25", "p50", "p75"]
    return out.withColumns({**{c: F.round(c, 6) for c in six}, "std": F.round("std", 4)})


@query(
    "a6_exact_quantiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 9) AS q0500, round(quantile_cont(value, 0.9), 9) AS q0900,
      round(quantile_cont(value, 0.99), 9) AS q0990 FROM events GROUP BY event_type""",
)
def quantiles(spark, sf):
    out = exact_quantiles(table(spark, sf, "events"), "value", [0.5, 0.9, 0.99], ("event_type",))
    return out.select("event_type", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query(
    "a7_box_stats",
    f"""WITH {LABELLED}, f AS (SELECT label, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median,
      quantile_cont(n_chars, 0.75) AS q3 FROM labelled GROUP BY label)
    SELECT l.label, q1, median, q3, min(n_chars) FILTER (WHERE ok)::DOUBLE AS whisker_low,
      max(n_chars) FILTER (WHERE ok)::DOUBLE AS whisker_high, count(*) FILTER (WHERE NOT ok) AS outliers
    FROM (SELECT l.*, f.q1, f.median, f.q3, n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok
      FROM labelled l JOIN f ON l.label = f.label) l GROUP BY l.label, q1, median, q3""",
)
def box_stats(spark, sf):
    return q.box_stats(labelled(spark, sf), "n_chars", "label")


@query(
    "a8_table_info",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS column_type, count(*) AS row_count, count({c}) AS non_null, 5::BIGINT AS column_count FROM documents"
        for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
    ),
)
def table_info(spark, sf):
    return q.table_info(table(spark, sf, "documents"))


@query(
    "a13_class_weights",
    f"""WITH {LABELLED}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)
    SELECT label, n, round((SELECT sum(n) / count(*) FROM c) / n, 9) AS weight FROM c""",
)
def class_weights(spark, sf):
    return q.class_weights(labelled(spark, sf), "label").withColumn("weight", F.round("weight", 9))


@query(
    "a14_fold_band",
    f"""WITH f AS (SELECT {hash_sql('vec_id')} % 5 AS fold, avg((label % 2 = 0)::INT) AS score FROM embeddings GROUP BY 1)
    SELECT count(score) AS folds, round(avg(score), 9) AS mean, round(2 * stddev_pop(score) / sqrt(count(*)), 9) AS band FROM f""",
)
def fold_band(spark, sf):
    rows = table(spark, sf, "embeddings").select(fold_number(F.col("vec_id")).alias("fold"), (F.col("label") % 2 == 0).cast("int").alias("hit"))
    scores = rows.groupBy("fold").agg(F.avg("hit").alias("score"))
    out = q.fold_band(scores, "score")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "band")})


@query(
    "a15_pixel_range",
    """SELECT count(*) AS n_rows, max(len(embedding))::BIGINT AS n_features, round(min(list_min(embedding))::DOUBLE, 6) AS min_value,
      round(max(list_max(embedding))::DOUBLE, 6) AS max_value FROM embeddings""",
)
def pixel_range(spark, sf):
    out = q.array_range(table(spark, sf, "embeddings"), "embedding")
    return out.withColumns({c: F.round(c, 6) for c in ("min_value", "max_value")})


@query(
    "a16_split_facts",
    f"""SELECT CASE WHEN {hash_sql('vec_id')} % 100 < 80 THEN 'train' ELSE 'test' END AS split, count(*) AS samples,
      max(len(embedding))::BIGINT AS features, count(DISTINCT label) AS classes FROM embeddings GROUP BY 1""",
)
def split_facts(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("split", split_name(F.col("vec_id"), {"train": 0.8, "test": 0.2}))
    return q.split_facts(rows, "split", "embedding", "label")
