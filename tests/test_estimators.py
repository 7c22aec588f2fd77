"""Own estimators: persistence, pipelines with Spark's stages, and the refitting grid search."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from moodframe.operators import bayes as nb
from moodframe.operators import estimators as es
from moodframe.operators import features as ft
from moodframe.operators import linear as ln
from moodframe.session import stage


@pytest.fixture(scope="module")
def corpus(spark):
    draw = np.random.default_rng(4)
    bright, dark, both = ["sun", "good", "warm", "play"], ["rain", "bad", "cold", "dark"], ["day", "night", "walk"]
    rows = []
    for i in range(120):
        words = draw.choice((bright if i % 3 else dark) + both, draw.integers(2, 9)).tolist()
        if i % 10 == 0:
            words += draw.choice(bright + dark, 4).tolist()
        rows.append((i, " ".join(words), int(i % 3 > 0), i % 4))
    rows += [(120, "", 1, 0), (121, None, 0, 1), (122, "unknownword", 1, 2)]
    return stage(spark.createDataFrame(rows, "doc_id long, text string, label int, fold int"), "corpus")


def scored(model, df):
    rows = es.with_chances(model.transform(df)).orderBy("doc_id").collect()
    return [(r["doc_id"], round(r["p1"], 9), r["prediction"]) for r in rows]


@pytest.mark.parametrize("final", [lambda: es.BayesClassifier(alpha=0.5), lambda: es.LinearClassifier(rounds=15), lambda: es.LinearClassifier(loss="log", penalty="elasticnet", rounds=5), lambda: DecisionTreeClassifier(maxDepth=3, seed=1)])
def test_saved_pipelines_score_alike(spark, corpus, tmp_path, final):
    final = final()
    pipeline = es.text_pipeline(final, max_features=8)
    pipeline.write().overwrite().save(f"{tmp_path}/unfitted")
    again = Pipeline.load(f"{tmp_path}/unfitted")
    assert [type(s) for s in again.getStages()] == [type(s) for s in pipeline.getStages()] and again.getStages()[0].getOrDefault("maxFeatures") == 8
    model = pipeline.fit(corpus)
    model.write().overwrite().save(f"{tmp_path}/fitted")
    loaded = PipelineModel.load(f"{tmp_path}/fitted")
    assert scored(loaded, corpus) == scored(model, corpus) == scored(again.fit(corpus), corpus)
    assert np.mean([r["prediction"] == r["label"] for r in model.transform(corpus).collect()]) > 0.8


def test_stages_equal_the_functions(spark, corpus):
    """The pipeline gives the vectors, weights and chances of the plain operators."""
    found = ft.fit_vocabulary(corpus, "text", 9)
    plain = ft.tfidf_vectors(corpus, found)
    model = es.text_pipeline(es.BayesClassifier(), max_features=9).fit(corpus)
    assert model.stages[0].vocabulary.terms == found.terms
    assert np.allclose(model.stages[1].values, found.idf)
    vectors = lambda df: [(r["doc_id"], r["features"]) for r in df.orderBy("doc_id").collect()]
    for (i, a), (j, b) in zip(vectors(plain), vectors(model.transform(corpus)), strict=True):
        assert i == j and np.allclose(a.toArray(), b.toArray())
    weights = nb.fit_bayes(nb.class_sums(plain), n_terms=9)
    want = {r["doc_id"]: r for r in nb.score_bayes(plain, weights, ["doc_id"]).collect()}
    assert all(abs(want[i]["p1"] - p) < 1e-8 and want[i]["prediction"] == c for i, p, c in scored(model, corpus))
    linear = es.text_pipeline(es.LinearClassifier(rounds=7), max_features=9).fit(corpus)
    assert np.allclose(linear.stages[2].values, ln.fit_linear(plain, 9, rounds=7).weights)


def test_words_may_come_as_arrays_and_columns_may_clash(spark, corpus):
    named = corpus.withColumn("words", F.split(F.coalesce("text", F.lit("")), " ")).withColumn("idx", F.lit(1))
    model = es.text_pipeline(es.BayesClassifier(), "words", 8).fit(named)
    out = model.transform(named)
    assert {*named.columns, "counts", "features", "probability", "prediction"} == set(out.columns) and out.count() == corpus.count()


def test_all_smoothings_share_the_sums(corpus):
    vectors = stage(ft.tfidf_vectors(corpus, ft.fit_vocabulary(corpus, "text", 8)).select("label", "features"), "vectors")
    final = es.BayesClassifier()
    maps = [{final.alpha: a} for a in (0.01, 1.0, 50.0)]
    for order, model in final.fitMultiple(vectors, maps):
        assert np.array_equal(model.values, final.copy(maps[order]).fit(vectors).values)
        assert model.getPredictionCol() == "prediction"


@pytest.mark.parametrize("final", [lambda: es.BayesClassifier(), lambda: DecisionTreeClassifier(seed=1)])
def test_grid_search_fits_features_inside_each_fold(spark, corpus, final):
    final = final()
    settings = [{"alpha": a} for a in (100.0, 0.1, 0.1)] if isinstance(final, es.BayesClassifier) else [{"maxDepth": d} for d in (0, 3, 3)]
    grid = es.grid_search(es.text_pipeline(final, max_features=7), corpus, settings, "fold", 4)
    rows = {(r["setting_order"], r["fold"]): r for r in grid.scores.collect()}
    assert len(rows) == 12
    for (order, fold), r in rows.items():
        train, held = corpus.filter(F.col("fold") != fold), corpus.filter(F.col("fold") == fold)
        if order == 1:
            own = es.text_pipeline(final.copy({final.getParam(k): v for k, v in settings[order].items()}), max_features=7).fit(train)
            hits = [x["prediction"] == x["label"] for x in own.transform(held).collect()]
            assert (r["accuracy"], r["rows"], r["terms"]) == (sum(hits) / len(hits), len(hits), len(own.stages[0].vocabulary.terms))
    means = [round(np.mean([rows[i, f]["accuracy"] for f in range(4)]), 9) for i in range(3)]
    assert grid.best == means.index(max(means)) and grid.best != 2  # of equals the first
    chosen = final.copy({final.getParam(k): v for k, v in settings[grid.best].items()})
    assert scored(grid.model, corpus) == scored(es.text_pipeline(chosen, max_features=7).fit(corpus), corpus)


def test_scoring_stays_in_the_jvm_without_a_shuffle(spark, corpus):
    plan = es.text_pipeline(es.BayesClassifier(), max_features=8).fit(corpus).transform(corpus)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Arrow" not in plan and "Python" not in plan
