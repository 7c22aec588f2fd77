"""Metric, model comparison and rank-test queries.

Labelled documents are scored by a stand-in with ties: whole hundredths from the hash of the
id and the label, so both engines see the same numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from moodframe.functions.text import hash_number
from moodframe.operators import evaluate as ev
from moodframe.operators import ranktests as rt
from moodframe.operators.split import fold_number, split_name
from moodframe.plans.registry import LABELLED, hash_sql, labelled, query, table
from moodframe.session import new_folder
from moodframe.sources import tables as tb

_SCORED = f"""{LABELLED},
    scored AS (SELECT doc_id, label, split, fold, p1, 1 - p1 AS p0, (p1 >= 0.5)::INT AS prediction FROM (
      SELECT doc_id, label, CASE WHEN {hash_sql('doc_id')} % 100 < 70 THEN 'train' ELSE 'test' END AS split,
        ({hash_sql('doc_id')} % 5)::INT AS fold,
        (({hash_sql('doc_id', 7)} % 1000 + 500 * label) // 15) / 100.0 AS p1 FROM labelled))"""

_CELLS = """count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
      count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp"""


def _scored(spark, sf):
    key = F.col("doc_id")
    points = F.floor((hash_number(key, 7) % 1000 + 500 * F.col("label")) / 15)
    rows = labelled(spark, sf).select(
        "doc_id", "label", split_name(key, {"train": 0.7, "test": 0.3}).alias("split"), fold_number(key).alias("fold"),
        (points / F.lit(100.0)).alias("p1"),
    )
    return rows.withColumns({"p0": 1 - F.col("p1"), "prediction": (F.col("p1") >= 0.5).cast("int")})


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(
    "e1_accuracy",
    f"WITH {_SCORED} SELECT split, count(*) AS n, round(avg((label = prediction)::INT), 9) AS accuracy FROM scored GROUP BY split",
)
def accuracy(spark, sf):
    return _rounded(ev.accuracy(_scored(spark, sf), "split"), "accuracy")


@query("e2_confusion_cells", f"WITH {_SCORED} SELECT split, {_CELLS} FROM scored GROUP BY split")
def cells(spark, sf):
    return ev.cells(_scored(spark, sf), "split")


@query(
    "e2_confusion_shares",
    f"""WITH {_SCORED}, c AS (SELECT {_CELLS}, count(*) AS t FROM scored)
    SELECT label, prediction, n, round(n / t, 9) AS share FROM (SELECT 0 AS label, 0 AS prediction, tn AS n, t FROM c
      UNION ALL SELECT 0, 1, fp, t FROM c UNION ALL SELECT 1, 0, fn, t FROM c UNION ALL SELECT 1, 1, tp, t FROM c)""",
)
def confusion(spark, sf):
    return _rounded(ev.confusion_long(_scored(spark, sf)), "share")


@query(
    "e3_sensitivity_specificity",
    f"""WITH {_SCORED}, c AS (SELECT fold, {_CELLS} FROM scored GROUP BY fold)
    SELECT fold, round(tp / nullif(tp + fn, 0), 9) AS sensitivity, round(tn / nullif(tn + fp, 0), 9) AS specificity FROM c""",
)
def rates(spark, sf):
    return _rounded(ev.rates(_scored(spark, sf), "fold"), "sensitivity", "specificity")


_REPORT = f"""{_SCORED}, c AS (SELECT {_CELLS} FROM scored),
    r AS (SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS precision, coalesce(tn / nullif(tn + fp, 0), 0) AS recall,
        coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1, tn + fp AS support FROM c
      UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM c)"""


@query(
    "e4_class_report",
    f"""WITH {_REPORT}, u AS (SELECT * FROM r
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM r)
    SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM u""",
)
def class_report(spark, sf):
    return _rounded(ev.class_report(_scored(spark, sf)), "precision", "recall", "f1")


_AUC = """(SELECT (sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2)
      / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) FROM (SELECT label,
        rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2 AS r FROM scored))"""


@query(
    "e5_binary_report",
    f"""WITH {_SCORED}, c AS (SELECT {_CELLS} FROM scored)
    SELECT round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
      round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round({_AUC}, 9) AS auc_roc FROM c""",
)
def binary_report(spark, sf):
    return _rounded(ev.binary_report(_scored(spark, sf)), "accuracy", "f1", "precision", "recall", "auc_roc")


_LOSS = """avg(-ln(CASE WHEN label = 1 THEN least(greatest(p1, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
      ELSE 1 - least(greatest(p1, 2.220446049250313e-16), 1 - 2.220446049250313e-16) END))"""
_MACRO = f"""c AS (SELECT split, {_CELLS}, avg((label = prediction)::INT) AS accuracy, {_LOSS} AS logloss FROM scored GROUP BY split),
    macro AS (SELECT split, accuracy, (coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2 AS f1,
      (coalesce(tn / nullif(tn + fn, 0), 0) + coalesce(tp / nullif(tp + fp, 0), 0)) / 2 AS precision,
      (coalesce(tn / nullif(tn + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0)) / 2 AS recall, logloss FROM c)"""


@query(
    "e6_macro_metrics",
    f"""WITH {_SCORED}, {_MACRO} SELECT split, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(precision, 6) AS precision,
      round(recall, 6) AS recall, round(logloss, 6) AS logloss FROM macro""",
)
def macro_metrics(spark, sf):
    out = ev.macro_metrics(_scored(spark, sf), "split")
    return out.withColumns({c: F.round(c, 6) for c in ev.METRICS})


@query(
    "e7_roc_auc",
    f"""WITH {_SCORED}, r AS (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY p1)
      + (count(*) OVER (PARTITION BY fold, p1) - 1) / 2 AS r FROM scored),
    s AS (SELECT fold, sum(r) FILTER (WHERE label = 1) AS r, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n
      FROM r GROUP BY fold)
    SELECT fold, round((r - p * (p + 1) / 2) / nullif(p * n, 0), 9) AS auc FROM s""",
)
def roc_auc(spark, sf):
    return _rounded(ev.roc_auc(_scored(spark, sf), "fold"), "auc")


_CURVE = lambda score, cls: f"""SELECT {cls} AS class, {score} AS threshold,
      sum(sum((label = {cls})::INT)) OVER (ORDER BY {score} DESC) / (SELECT count(*) FROM scored WHERE label = {cls}) AS tpr,
      sum(sum((label <> {cls})::INT)) OVER (ORDER BY {score} DESC) / (SELECT count(*) FROM scored WHERE label <> {cls}) AS fpr
      FROM scored GROUP BY {score}"""


@query(
    "e8_roc_curves",
    f"""WITH {_SCORED}, u AS ({_CURVE('p0', 0)} UNION ALL {_CURVE('p1', 1)})
    SELECT class, round(threshold, 9) AS threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM u""",
)
def roc_curves(spark, sf):
    return _rounded(ev.roc_both_classes(_scored(spark, sf)), "threshold", "tpr", "fpr")


@query(
    "e9_train_test_report",
    f"""WITH {_SCORED}, {_MACRO} SELECT split, metric, round(value, 6) AS value FROM (
      UNPIVOT macro ON accuracy, f1, precision, recall, logloss INTO NAME metric VALUE value)""",
)
def train_test(spark, sf):
    return ev.train_test_report(_scored(spark, sf)).withColumn("value", F.round("value", 6))


@query("e10_fit_time")
def fit_time(spark, sf):
    from moodframe.plans.models import timed_bayes_fit

    path = new_folder(spark, "runs")
    tb.append_rows(timed_bayes_fit(spark, sf), path)
    return spark.read.schema(tb.RUN_SCHEMA).parquet(path)


@query(
    "e11_fold_report",
    f"""WITH {_SCORED}, f AS (SELECT fold, count(*) AS n, avg((label = prediction)::INT) AS accuracy FROM scored GROUP BY fold)
    SELECT fold::VARCHAR AS fold, n, round(accuracy, 9) AS accuracy, NULL::DOUBLE AS band FROM f
    UNION ALL SELECT 'mean', sum(n)::BIGINT, round(avg(accuracy), 9), round(2 * stddev_pop(accuracy) / sqrt(count(*)), 9) FROM f""",
)
def fold_report(spark, sf):
    return _rounded(ev.fold_report(_scored(spark, sf)), "accuracy", "band")


_MODEL_ORDER = "CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END"


@query(
    "e12_best_model",
    f"""WITH {_SCORED}, m AS (SELECT lang AS model, {_MODEL_ORDER} AS o, round(avg((s.label = prediction)::INT), 9) AS accuracy
      FROM scored s JOIN documents USING (doc_id) GROUP BY ALL)
    SELECT model, accuracy FROM m ORDER BY accuracy DESC, o LIMIT 1""",
)
def best_model(spark, sf):
    """Each language plays one model: the metrics table is derived from the scored rows."""
    lang = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("model"))
    metrics = ev.accuracy(_scored(spark, sf).join(lang, "doc_id"), "model")
    order = F.when(F.col("model") == "en", 0).when(F.col("model") == "de", 1).when(F.col("model") == "fr", 2).otherwise(3)
    return ev.best_model(_rounded(metrics, "accuracy").withColumn("model_order", order))


_MODELS = ["click", "error", "purchase", "signup", "view"]

# Days are the measures and event types the models; the value is a count, so ties occur.
_METRICS = "metrics AS (SELECT strftime(ts, '%Y-%m-%d') AS measure, event_type AS model, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"
_RANKS = f"""{_METRICS}, ranked AS (SELECT measure, model, value, rank() OVER (PARTITION BY measure ORDER BY value)
      + (count(*) OVER (PARTITION BY measure, value) - 1) / 2 AS rank, count(*) OVER (PARTITION BY measure, value) AS ties FROM metrics)"""


def _metrics(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf, "events").groupBy(day.alias("measure"), F.col("event_type").alias("model")).agg(
        F.count("*").cast("double").alias("value")
    )


@query("e13_measure_ranks", f"WITH {_RANKS} SELECT measure, model, value, rank FROM ranked")
def measure_ranks(spark, sf):
    return rt.measure_ranks(_metrics(spark, sf)).drop("ties")


@query(
    "e13_friedman",
    f"""WITH {_RANKS}, r AS (SELECT model, sum(rank) AS r, count(*) AS n FROM ranked GROUP BY model),
    s AS (SELECT sum(r * r) AS ss, max(n) AS n, count(*) AS k, (SELECT sum(ties * ties - 1) FROM ranked) AS t FROM r),
    q AS (SELECT *, (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))) AS statistic FROM s)
    SELECT n AS measures, k AS models, round(statistic, 6) AS statistic, (k - 1)::INT AS df,
      round(exp(-statistic / 2) * (1 + statistic / 2), 6) AS p_value FROM q""",
)
def friedman(spark, sf):
    out = rt.friedman(_metrics(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("statistic", "p_value")})


@query(
    "e14_nemenyi_distances",
    f"""WITH {_RANKS}, m AS (SELECT model, avg(rank) AS r, count(*) AS n FROM ranked GROUP BY model)
    SELECT a.model AS model_a, b.model AS model_b, round(abs(a.r - b.r), 9) AS distance,
      round(abs(a.r - b.r) / sqrt(5 * 6 / (6 * a.n)) * sqrt(2), 6) AS q FROM m a JOIN m b ON a.model < b.model""",
)
def nemenyi_distances(spark, sf):
    out = rt.nemenyi(_metrics(spark, sf))
    return out.select("model_a", "model_b", F.round("distance", 9).alias("distance"), F.round("q", 6).alias("q"))


def _normal_cdf(x: str) -> str:
    """Normal distribution function by a rational formula (Abramowitz and Stegun 7.1.26)."""
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    poly = f"(((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(0.5 * (1 + sign({x}) * (1 - {poly} * exp(-({x}) * ({x}) / 2))))"


_NEMENYI = f"""{_RANKS}, m AS (SELECT model, avg(rank) AS r, count(*) AS n FROM ranked GROUP BY model),
    pairs AS (SELECT a.model AS model_a, b.model AS model_b, abs(a.r - b.r) / sqrt(5 * 6 / (6 * a.n)) * sqrt(2) AS q FROM m a JOIN m b ON a.model < b.model),
    grid AS (SELECT -8 + i * 0.004::DOUBLE AS z, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(4001) t(i)),
    tails AS (SELECT model_a, model_b, greatest(0, 1 - sum(w * 5 * exp(-z * z / 2) / sqrt(2 * pi()) * pow(greatest({_normal_cdf('z')} - {_normal_cdf('(z - q)')}, 0), 4))
      * 0.004 / 3) AS p FROM pairs, grid GROUP BY model_a, model_b)"""


@query("e14_nemenyi", f"WITH {_NEMENYI} SELECT model_a, model_b, round(p, 4) AS p_value FROM tails")
def nemenyi(spark, sf):
    return rt.nemenyi(_metrics(spark, sf)).select("model_a", "model_b", F.round("p_value", 4).alias("p_value"))


@query(
    "e15_significance_levels",
    f"""WITH {_NEMENYI}, cells AS (SELECT model_a AS a, model_b AS b, p FROM tails UNION ALL SELECT model_b, model_a, p FROM tails)
    SELECT a, b, round(p, 4) AS p_value, (p < 0.05)::INT + (p < 0.01)::INT + (p < 0.001)::INT AS level FROM cells
    UNION ALL SELECT DISTINCT a, a, -1.0, -1 FROM cells""",
)
def significance_levels(spark, sf):
    return rt.significance_long(rt.nemenyi(_metrics(spark, sf))).withColumn("p_value", F.round("p_value", 4))


# The distances stand in for the p-values, which SQL cannot compute: the shape is checked.
@query(
    "e15_significance_matrix",
    f"""WITH {_RANKS}, m AS (SELECT model, avg(rank) AS r FROM ranked GROUP BY model),
    p AS (SELECT a.model, b.model AS other, CASE WHEN a.model = b.model THEN -1 ELSE round(abs(a.r - b.r), 9) END AS v FROM m a CROSS JOIN m b)
    SELECT model, {", ".join(f"max(v) FILTER (WHERE other = '{m}')::DOUBLE AS {m}" for m in _MODELS)} FROM p GROUP BY model""",
)
def significance_matrix(spark, sf):
    pairs = rt.nemenyi(_metrics(spark, sf)).withColumn("p_value", F.round("distance", 9))
    return rt.significance_matrix(pairs, _MODELS)
