import numpy as np
import pytest
from pyspark.sql import functions as F

from moodframe.operators import collect as cl
from moodframe.operators import evaluate as ev
from moodframe.operators import quality as q
from moodframe.operators import ranktests as rt
from moodframe.operators.ordered import exact_quantiles

# Published metric tables (rows are measures, columns models).
DEPRESSION = (
    ["MNB", "KNN", "DT", "RF", "SGD"],
    [[86.10, 74.12, 82.67, 81.89, 88.73], [82.6, 31.52, 89.8, 90.4, 87.4], [93.2, 80, 86.87, 88.65, 94.4],
     [0.83, 0.79, 0.88, 0.88, 0.87], [0.90, 0.65, 0.75, 0.73, 0.87], [0.86, 0.71, 0.81, 0.80, 0.87]],
)
SENTIMENT = (
    ["MNB", "LSVM", "LR"],
    [[0.78, 0.8, 0.8], [0.78, 0.79, 0.8], [0.77, 0.8, 0.8], [0.77, 0.8, 0.8], [0.77, 0.8, 0.8], [0.78, 0.79, 0.8], [0.78, 0.8, 0.8]],
)
EMOTION = (
    ["LR", "MLP", "CNN"],
    [[70.14, 70, 84.38], [0.72, 0.67, 0.85], [0.77, 0.89, 0.89], [0.74, 0.76, 0.87], [0.67, 0.75, 0.85], [0.62, 0.43, 0.8], [0.64, 0.54, 0.82]],
)


def metrics_frame(spark, table):
    models, rows = table
    long = [(f"m{i}", m, float(v)) for i, row in enumerate(rows) for m, v in zip(models, row)]
    return spark.createDataFrame(long, "measure string, model string, value double")


@pytest.mark.parametrize(
    "table, statistic, p", [(DEPRESSION, 13.7479, 0.00814), (SENTIMENT, 13.1304, 0.00141), (EMOTION, 9.4074, 0.00906)]
)
def test_friedman_published(spark, table, statistic, p):
    row = rt.friedman(metrics_frame(spark, table)).first()
    assert row["statistic"] == pytest.approx(statistic, abs=5e-5)
    assert row["p_value"] == pytest.approx(p, abs=5e-6)


def test_nemenyi_published(spark):
    rows = {(r["model_a"], r["model_b"]): r["p_value"] for r in rt.nemenyi(metrics_frame(spark, SENTIMENT)).collect()}
    assert rows[("LR", "MNB")] == pytest.approx(0.0060, abs=5e-5)
    assert rows[("LSVM", "MNB")] == pytest.approx(0.0299, abs=5e-5)
    assert rows[("LR", "LSVM")] == pytest.approx(0.838, abs=0.02)
    matrix = rt.significance_matrix(rt.nemenyi(metrics_frame(spark, SENTIMENT)), ["LR", "LSVM", "MNB"]).orderBy("model").collect()
    assert [r[r["model"]] for r in matrix] == [-1.0] * 3
    assert matrix[0]["MNB"] == matrix[2]["LR"]
    levels = {(r["a"], r["b"]): r["level"] for r in rt.significance_long(rt.nemenyi(metrics_frame(spark, SENTIMENT))).collect()}
    assert (levels[("LR", "MNB")], levels[("LSVM", "MNB")], levels[("LR", "LSVM")], levels[("LR", "LR")]) == (2, 1, 0, -1)


def test_chi_square_odd_degrees():
    assert rt.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert rt.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, p1 double").withColumn("p0", 1 - F.col("p1"))


def test_one_class_gives_nulls_and_zeros(spark):
    df = scored(spark, [(1, 1, 0.9), (1, 0, 0.2)])
    r = ev.rates(df).first()
    assert (r["sensitivity"], r["specificity"]) == (0.5, None)
    assert ev.roc_auc(df).first()["auc"] is None
    report = {x["class"]: x for x in ev.class_report(df).collect()}
    assert report["0"]["recall"] == 0.0 and report["0"]["support"] == 0


@pytest.mark.parametrize("flip, expected", [(1, 1.0), (-1, 0.0), (0, 0.5)])
def test_auc_extremes(spark, flip, expected):
    df = scored(spark, [(y, 0, 0.5 + flip * 0.01 * (10 * y + i)) for y in (0, 1) for i in range(5)] if flip else [(y, 0, 0.5) for y in (0, 1, 0, 1)])
    assert ev.roc_auc(df).first()["auc"] == expected


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("partitions", ["1", "8", "50"])
def test_auc_and_quantiles_with_a_hot_value(spark, partitions):
    rng = np.random.default_rng(3)
    n = 3000
    s = np.where(rng.random(n) < 0.34, 0.25, np.round(rng.random(n), 3))
    y = (rng.random(n) < s).astype(int)
    df = scored(spark, [(int(a), 0, float(b)) for a, b in zip(y, s)])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert ev.roc_auc(df).first()["auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)
        # Unchanged by a monotone map.
        assert ev.roc_auc(df.withColumn("p1", F.exp("p1"))).first()["auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)
        found = exact_quantiles(df, "p1", [0.0, 0.25, 0.333, 0.99, 1.0]).first()
        assert list(found) == pytest.approx(list(np.quantile(s, [0.0, 0.25, 0.333, 0.99, 1.0])))
        curve = ev.roc_curve(df).orderBy(F.desc("threshold")).collect()
        assert curve[-1]["tpr"] == curve[-1]["fpr"] == 1.0
        assert all(a["tpr"] <= b["tpr"] for a, b in zip(curve, curve[1:]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_best_model_ties_and_empty(spark):
    make = lambda rows: spark.createDataFrame(rows, "model string, accuracy double, model_order int")
    assert tuple(ev.best_model(make([("b", 0.8, 1), ("a", 0.8, 0), ("c", 0.7, 2)])).first()) == ("a", 0.8)
    assert tuple(ev.best_model(make([("a", 0.0, 0)])).first()) == ("None", 0.0)


def test_retweet_rule(spark):
    rows = [(1, "t", "s", 0), (2, "t", "s", 1), (3, "t", "s", 1), (4, "t", "s", 0), (5, "u", "s", 2), (6, "u", "s", 2), (7, "u", "x", 1)]
    df = spark.createDataFrame(rows, "arrival long, text string, sentiment string, retweet_count int")
    assert sorted(r["arrival"] for r in cl.keep_unique_retweets(df).collect()) == [1, 4, 5, 7]


def test_polarity_edges(spark):
    df = spark.createDataFrame([(-0.3,), (0.3,), (0.30001,), (None,), (-0.29,)], "p double")
    found = [r["c"] for r in df.select(cl.polarity_class(F.col("p")).alias("c")).collect()]
    assert found == ["negative", "neutral", "positive", "neutral", "neutral"]


def test_shares_of_no_posts_are_null(spark):
    empty = spark.createDataFrame([], "sentiment string")
    assert list(cl.sentiment_shares(empty).first()) == [None, None, None]


def test_class_weights_and_band(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert {r["y"]: r["weight"] for r in q.class_weights(df, "y").collect()} == {0: 4 / 6, 1: 2.0}
    scores = spark.createDataFrame([(0.8,), (0.9,), (1.0,)], "s double")
    row = q.fold_band(scores, "s").first()
    assert row["band"] == pytest.approx(2 * np.std([0.8, 0.9, 1.0]) / np.sqrt(3))
