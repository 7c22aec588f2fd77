import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from moodframe.operators import bayes as nb
from moodframe.operators import features as ft
from moodframe.operators import linear as ln
from moodframe.operators import mlmodels as ml
from moodframe.operators import neighbors as kn
from moodframe.operators import tune as tn
from moodframe.operators.score import encode_fixed, ensemble_class, with_softmax
from moodframe.operators.split import exact_folds, exact_split
from moodframe.plans import all_queries
from moodframe.plans.models import _pixels
from moodframe.sources import tables as tb


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "good day sun sun" if i % 3 else "bad night rain day", int(i % 3 > 0)) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_vectors_have_unit_length_or_none(spark, corpus):
    vocabulary = ft.fit_vocabulary(corpus, "text", 3)
    assert vocabulary.terms == ["sun", "day", "good"]
    extra = corpus.unionByName(spark.createDataFrame([(99, "unseen words", 0)], corpus.schema))
    norms = ft.sparse_arrays(ft.tfidf_vectors(extra, vocabulary)).select(
        "doc_id", F.aggregate("val", F.lit(0.0), lambda s, x: s + x * x).alias("n")
    )
    found = {r["doc_id"]: r["n"] for r in norms.collect()}
    assert found.pop(99) == 0.0 and all(n == pytest.approx(1.0) for n in found.values())


def test_fold_vocabulary_equals_a_fresh_fit(corpus):
    folded = exact_folds(corpus, "doc_id", 3)
    fitted = ft.fold_vocabularies(folded, "fold", 3)
    for fold, v in enumerate(fitted):
        fresh = ft.fit_vocabulary(folded.filter(F.col("fold") != fold))
        assert (v.terms, v.doc_counts, v.n_docs) == (fresh.terms, fresh.doc_counts, fresh.n_docs)


def test_no_known_term_gives_the_prior(spark, corpus):
    vocabulary = ft.fit_vocabulary(corpus)
    weights = nb.fit_bayes(nb.class_sums(ft.tfidf_vectors(corpus, vocabulary)))
    fresh = spark.createDataFrame([(1, "zzz"), (2, "sun"), (3, "rain")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in nb.score_bayes(ft.tfidf_vectors(fresh, vocabulary), weights, ["doc_id"]).collect()}
    assert (out[1]["p1"], out[1]["prediction"]) == (0.5, 0)
    assert out[2]["prediction"] == 1 and out[3]["prediction"] == 0
    assert all(r["p1"] + r["p0"] == pytest.approx(1.0) for r in out.values())


def test_saved_model_scores_equal(spark, corpus, tmp_path):
    vocabulary = ft.fit_vocabulary(corpus)
    weights = nb.fit_bayes(nb.class_sums(ft.tfidf_vectors(corpus, vocabulary)))
    tb.save_model(spark, str(tmp_path / "m"), vocabulary, weights)
    again, table = tb.load_model(spark, str(tmp_path / "m"))
    score = lambda v, w: sorted(map(tuple, nb.score_bayes(ft.tfidf_vectors(corpus, v), w, ["doc_id"]).collect()))
    assert [r[:1] + r[3:] for r in score(vocabulary, weights)] == [r[:1] + r[3:] for r in score(again, table)]
    assert np.allclose([r[1] for r in score(vocabulary, weights)], [r[1] for r in score(again, table)])


@pytest.mark.parametrize("loss", ["log", "hinge", "squared_hinge", "modified_huber"])
def test_gradient_matches_finite_differences(spark, loss):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    y = rng.integers(0, 2, 40)
    df = spark.createDataFrame([(int(a), Vectors.sparse(5, list(range(5)), list(map(float, b)))) for a, b in zip(y, x)], ["label", "features"])
    rows = ln.training_rows(df)
    w = rng.normal(size=5) * 0.3
    grad, facts = ln.full_gradient(rows, loss, w)

    def mean_loss(w):
        return ln.loss_and_slope(loss, np.where(y == 1, 1, -1) * (x @ w))[0].mean()

    steps = np.eye(5) * 1e-6
    numeric = [(mean_loss(w + s) - mean_loss(w - s)) / 2e-6 for s in steps]
    assert np.allclose(grad, numeric, atol=1e-5)
    assert facts["loss"] == pytest.approx(mean_loss(w)) and facts["n"] == 40


@pytest.mark.parametrize("penalty", ["l2", "elasticnet"])
def test_loss_falls_and_model_separates(corpus, penalty):
    vocabulary = ft.fit_vocabulary(corpus)
    train = ft.tfidf_vectors(corpus, vocabulary)
    model = ln.fit_linear(train, len(vocabulary.terms), "modified_huber", penalty, rounds=12)
    losses = [h["train_loss"] for h in model.history]
    assert len(losses) == 12 and losses[-1] < 0.2 * losses[0]
    scored = nb.margins(train, model.table(corpus.sparkSession), ["doc_id", "label"])
    assert scored.filter((F.col("m0") > 0).cast("int") != F.col("label")).count() == 0


def test_logistic_regression_meets_the_first_order_condition(corpus):
    noisy = corpus.withColumn("label", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    vocabulary = ft.fit_vocabulary(noisy)
    train = ft.tfidf_vectors(noisy, vocabulary)
    fitted = ln.logistic_regression(60).fit(train.select("label", "features"))
    w = fitted.coefficients.toArray()
    grad, _ = ln.full_gradient(ln.training_rows(train), "log", w)
    assert fitted.intercept == 0.0 and np.abs(grad + w / 60).max() < 1e-4


def test_squared_hinge_svm_approaches_its_optimum(corpus):
    vocabulary = ft.fit_vocabulary(corpus)
    train = ft.tfidf_vectors(corpus, vocabulary)
    model = ln.fit_squared_hinge_svm(train, len(vocabulary.terms), rounds=40)
    grad, _ = ln.full_gradient(ln.training_rows(train), "squared_hinge", model.weights)
    assert np.abs(grad + model.weights / 60).max() < 1e-3


def test_early_stop_sequence():
    assert ln.early_stop_round([1.0, 0.8, 0.9, 0.95, 0.99, 0.1], 3) == (2, 5)
    assert ln.early_stop_round([1.0, 0.8, 0.9, 0.95, 0.7], 3) == (5, 5)
    assert ln.early_stop_round([0.1, 0.5, 0.4, 0.3], 2, larger_is_better=True) == (2, 4)


def test_best_weights_are_kept(spark, corpus, tmp_path):
    vocabulary = ft.fit_vocabulary(corpus)
    train = ft.tfidf_vectors(corpus, vocabulary)
    path = str(tmp_path / "best")
    model = ln.fit_linear(train, len(vocabulary.terms), "log", rounds=6, valid=train, monitor="f1", patience=2, checkpoint=path)
    saved = [r["w0"] for r in ln.load_weights(spark, path).orderBy("idx").collect()]
    assert np.allclose(saved, model.weights)
    assert len(model.history) <= model.best_round + 2


@pytest.mark.parametrize("blocks", [(1000, 1000), (7, 5)])
def test_neighbors_match_brute_force(spark, blocks):
    rng = np.random.default_rng(5)
    train, queries = np.round(rng.random((40, 6)), 1), np.round(rng.random((12, 6)), 1)
    train[::3] = train[0]  # a third of all rows are copies
    train[5] = 0.0
    labels = rng.integers(0, 2, 40)
    t = spark.createDataFrame([(i, int(labels[i]), list(map(float, v))) for i, v in enumerate(train)], "id long, label int, v array<double>")
    q = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(queries)], "id long, v array<double>")
    near = kn.nearest_neighbors(kn.dense_arrays(t, "v"), kn.dense_arrays(q, "v"), 5, 6, *blocks)
    got = {}
    for r in near.orderBy("query_id", "rn").collect():
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    for i, v in enumerate(queries):
        d2 = np.round(((train - v) ** 2).sum(1), 9)
        assert got[i] == sorted(range(40), key=lambda j: (d2[j], j))[:5]
    votes = {r["query_id"]: r["prediction"] for r in kn.vote(near, 5).collect()}
    assert all(votes[i] == int(labels[got[i]].sum() >= 3) for i in votes)


def test_neighbors_copy_rows_a_fixed_number_of_times(spark, monkeypatch):
    """Ten times the rows make about ten times the copies, not a hundred times, until the groups are as
    large as allowed."""
    copies = lambda t, q: (lambda g: t * g[1] + q * g[0])(kn.grid_shape((t, t * 100), (q, q * 100), 2000, 1000))
    assert copies(140_000, 60_000) <= 12 * copies(14_000, 6_000) and copies(840_000, 360_000) <= 6.1 * copies(140_000, 60_000)
    t, q = kn.grid_shape((8_000_000, 800_000_000), (10, 1000), 2000, 1000)
    assert t * kn.GROUP_ENTRIES >= 800_000_000 and q == 1 and kn.grid_shape((0, 0), (0, 0), 7, 5) == (1, 1)
    rows = spark.createDataFrame([(i, i % 2, [0], [i / 64.0]) for i in range(300)], "id long, label int, idx array<int>, val array<double>")
    monkeypatch.setattr(kn, "GROUP_ENTRIES", 40)
    near = kn.nearest_neighbors(rows, rows, 3, 1, 7, 5).orderBy("query_id", "rn").collect()
    want = {i: sorted(range(300), key=lambda j: (abs(i - j), j))[:3] for i in range(300)}
    assert [r["neighbor_id"] for r in near] == [j for i in range(300) for j in want[i]]


@pytest.mark.parametrize(("head", "tail", "few"), [(256, 512, 100), (3, 4, 100), (3, 4, 1), (3, 4, 1 << 30)])
def test_pruned_neighbors_match_brute_force(spark, monkeypatch, head, tail, few):
    """Sparse rows of two kinds, many copies and ties, negative and large values, an empty row: few
    pairs are compared in full, however many stay after the short rows."""
    rng = np.random.default_rng(8)
    rows = np.where(rng.random((300, 30)) < 0.2, np.round(rng.normal(size=(300, 30)), 1), 0.0)
    rows[::2, 15:] = rows[1::2, :15] = 0.0
    rows[20:40], rows[7], rows[8, 3] = rows[5], 0.0, 1e6 if few == 1 else 2.0
    train, queries = [(i, i % 3 % 2, v) for i, v in enumerate(rows)], [(i, v) for i, v in enumerate(rows[::3])]
    sparse = lambda v: (np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist())
    make = lambda r: [(*x[:-1], *sparse(x[-1])) for x in r]
    monkeypatch.setattr(kn, "HEAD", head)
    monkeypatch.setattr(kn, "TAIL", tail)
    monkeypatch.setattr(kn, "FEW", few)
    monkeypatch.setattr(kn, "STRIP", 16)
    full, compare = [0], kn._distances

    def counted(*args):
        full[0] += len(args[4])
        return compare(*args)

    monkeypatch.setattr(kn, "_distances", counted)
    known, asked = (pa.table({c: list(v) for c, v in zip(names, zip(*make(r), strict=True), strict=True)}) for names, r in ((("id", "label", "idx", "val"), train), (("id", "idx", "val"), queries)))
    asked = asked.set_column(1, "idx", asked.column("idx").cast(pa.list_(pa.int64()))).set_column(2, "val", asked.column("val").cast(pa.list_(pa.float64())))
    found = kn._nearest(4, 30, 64, 50)(known.take(rng.permutation(300)), asked).to_pandas()
    for i, v in queries:
        d2 = np.round(np.maximum((rows**2).sum(1) + (v**2).sum() - 2 * rows @ v, 0), 9)
        want = sorted(range(300), key=lambda j: (d2[j], j))[:4]
        got = found[found.query_id == i].sort_values(["d2", "neighbor_id"])
        if i == 7 or abs(v).max() < 1e5:
            assert got.neighbor_id.tolist() == want and got.label.tolist() == [j % 3 % 2 for j in want]
    if few == 100 and head == 256:
        assert full[0] < 0.3 * 300 * 100


def test_vote_tie_goes_to_the_smaller_label(spark):
    near = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 0, 2)], "query_id long, neighbor_id long, label int, rn long")
    assert kn.vote(near, 2).first()["prediction"] == 0


@pytest.mark.parametrize("partitions", [1, 13])
def test_exact_split_shares_and_stability(spark, partitions):
    df = spark.range(1000).withColumn("y", (F.col("id") % 3 == 0).cast("int")).repartition(partitions)
    out = exact_split(df, "id", {"train": 0.7, "valid": 0.15, "test": 0.15}, by=("y",)).toPandas()
    assert len(out) == 1000 and out["id"].is_unique
    for y, n in ((0, 666), (1, 334)):
        sizes = out[out["y"] == y]["split"].value_counts()
        assert sizes["train"] == int(n * 0.7) and abs(sizes["valid"] - n * 0.15) <= 1
    again = exact_split(df.repartition(5), "id", {"train": 0.7, "valid": 0.15, "test": 0.15}, by=("y",)).toPandas()
    assert out.sort_values("id")["split"].tolist() == again.sort_values("id")["split"].tolist()


def test_folds_differ_by_one(spark):
    sizes = exact_folds(spark.range(103), "id", 5).groupBy("fold").count().toPandas()["count"]
    assert sizes.max() - sizes.min() <= 1


def test_encoding_cuts_and_pads(spark):
    vocabulary = spark.createDataFrame([("aa", 0), ("bb", 1)], "term string, idx int")
    df = spark.createDataFrame([(1, "aa bb cc"), (2, ""), (3, "aa " * 9)], "id long, text string")
    out = {r["id"]: r for r in encode_fixed(df, "id", "text", vocabulary, 6).collect()}
    assert out[1]["input_ids"] == [2, 4, 5, 1, 3, 0] and out[1]["attention_mask"] == [1, 1, 1, 1, 1, 0]
    assert out[2]["input_ids"] == [2, 3, 0, 0, 0, 0] and not out[2]["truncated"]
    assert out[3]["input_ids"] == [2, 4, 4, 4, 4, 3] and out[3]["truncated"]


def test_softmax_and_threshold(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],), ([2.0, 2.0],)], "logits array<double>")
    a, b = with_softmax(df, "logits").collect()
    assert sum(a["probabilities"]) == pytest.approx(1.0) and a["prediction"] == 1
    assert b["prediction"] == 0 and b["confidence"] == 0.5
    line = spark.createDataFrame([(0.7,), (0.699,)], "p double").select(ensemble_class(F.col("p")).alias("c")).collect()
    assert [r["c"] for r in line] == ["Depressed", "Not depressed"]


def test_ml_fold_scores_equal_single_fits(corpus):
    folded = corpus.withColumn("fold", (F.col("doc_id") % 2).cast("int"))
    grid = {"impurity": ["gini", "entropy"], "maxDepth": [1, 2]}
    found = {(r["setting_order"], r["fold"]): r for r in tn.ml_fold_scores(folded, "fold", 2, ml.decision_tree(min_split=4), grid, 3).collect()}
    assert set(found) == {(i, f) for i in range(4) for f in range(2)}
    assert found[1, 0]["setting"] == "{'impurity': 'gini', 'maxDepth': 2}"
    for fold in (0, 1):
        train, held = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        vectors = lambda df, v=ft.fit_vocabulary(train, "text", 3): ft.tfidf_vectors(df, v).withColumn("label", F.col("label").cast("double"))
        model = ml.decision_tree(2, 4, "entropy").fit(vectors(train))
        hits = [r["prediction"] == r["label"] for r in model.transform(vectors(held)).collect()]
        assert (found[3, fold]["accuracy"], found[3, fold]["rows"]) == (sum(hits) / len(hits), len(hits))


def test_text_trees_get_parts_of_bounded_size(spark, sf, monkeypatch):
    """Small limits make more parts of the training rows and the same tree."""
    seen, fit = [], ml.DecisionTreeClassifier.fit
    monkeypatch.setattr(ml.DecisionTreeClassifier, "fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), rows.count(), rows.first()["features"].size)) or fit(self, rows))
    scored = lambda: sorted(map(tuple, all_queries()["m14_text_decision_tree"](spark, sf).collect()))
    whole = scored()
    monkeypatch.setattr(ml, "TREE_BYTES", seen[0][1] * 4 * seen[0][2] // 30, raising=False)
    assert scored() == whole and seen[1][0] >= 30 > seen[0][0] and seen[0][1:] == seen[1][1:]


def test_encoding_does_not_move_texts(spark):
    """Null texts are empty; the terms are those of the counted vocabulary."""
    df = spark.createDataFrame([(1, "bb aa bb cc"), (2, None), (3, "cc bb")], "id long, text string")
    terms = ft.frequent_terms(df, "text", 2)
    assert [tuple(r) for r in terms.sort("idx").collect()] == [(t, i) for i, t in enumerate(ft.fit_vocabulary(df, "text", 2).terms)]
    coded = encode_fixed(df, "id", "text", terms, 5)
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in coded.sort("id").collect()] == [
        (1, [2, 4, 1, 4, 3], [1] * 5, 5, True), (2, [2, 3, 0, 0, 0], [1, 1, 0, 0, 0], 2, False), (3, [2, 5, 4, 3, 0], [1, 1, 1, 1, 0], 4, False)]


def test_rounds_read_blocks_of_rows(spark, monkeypatch):
    """Rows are read as blocks, by no more tasks than cores; rows without terms count too."""
    monkeypatch.setattr(ln, "BLOCK_ROWS", 4)
    x = [([0, 2], [0.5, -1.0]), ([], []), ([1], [2.0])] * 7
    df = spark.createDataFrame([(i % 2, Vectors.sparse(3, *v)) for i, v in enumerate(x)], ["label", "features"]).repartition(40)
    rows = ln.training_rows(df)
    assert tuple(rows.agg(F.sum("rows"), F.max("rows") <= 4).first()) == (21, True)
    assert ln._few_tasks(rows.union(rows).repartition(40)).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    w = np.array([0.3, -0.2, 0.1])
    dense = np.array([Vectors.sparse(3, *v).toArray() for v in x])
    y = np.where(np.arange(21) % 2 == 1, 1.0, -1.0)
    grad, facts = ln.full_gradient(rows, "log", w)
    assert np.allclose(grad, dense.T @ (ln.loss_and_slope("log", y * (dense @ w))[1] * y) / 21) and facts["n"] == 21


def test_terms_are_counted_in_tasks(spark):
    """Counts by key, with a null key, empty and null texts; tokens are not rows of any stage."""
    rows = [(0, ["b", "a", "b"]), (None, ["a", None]), (1, []), (1, None), (0, ["b"]), (1, ["c", "a", "c"])]
    df = spark.createDataFrame(rows, "f int, words array<string>").repartition(3)
    counted = ft.term_counts(df, ft.words_of(df), "f")
    found = {(r["f"], r["term"]): (r["n"], r["df"]) for r in counted.collect()}
    assert found == {(0, "a"): (1, 1), (0, "b"): (3, 2), (None, "a"): (1, 1), (1, "a"): (1, 1), (1, "c"): (2, 1)}
    assert {r["term"]: (r["n"], r["df"]) for r in ft.term_counts(df, ft.words_of(df)).collect()} == {"a": (3, 3), "b": (3, 2), "c": (2, 1)}
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()


def test_forest_keeps_the_nodes_of_its_rows_and_stays_the_same(spark, tmp_path):
    values = np.random.default_rng(3).normal(size=(600, 64))
    rows = [(i, v.tolist(), int(v[0] + v[1] > 0)) for i, v in enumerate(values)]
    folder = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(folder)
    train, test = _pixels(spark, str(tmp_path))
    sizes = [r["n"] for r in train.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) <= 2 * min(sizes)
    assert ml.random_forest().getCacheNodeIds()
    scores = [
        ml.scored_classes(ml.random_forest(trees=10, min_split=10, **kw).fit(train), test, ["vec_id"]).orderBy("vec_id").collect()
        for kw in ({}, {"cacheNodeIds": False})
    ]
    assert scores[0] == scores[1]


def test_class_sums_of_blocks_equal_those_of_vectors(spark):
    """Labels of neither class, rows without words and terms of such rows alone count as before."""
    texts = ["sun sun day", "rain night", "day rain rain", "", "fog", None, "snow snow"]
    rows = [(i, texts[i % 7], [0, 1, 1, 0, None, 1, 2][i % 7]) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").coalesce(3)
    vectors = ft.tfidf_vectors(docs, ft.fit_vocabulary(docs, "text", 10))
    want = sorted(tuple(r) for r in nb.class_sums(vectors).collect())
    got = sorted(tuple(r) for r in nb.block_class_sums(ln.training_rows(vectors)).collect())
    assert len(got) == 6 and np.allclose(got, want, atol=1e-12)
    none = ln.training_rows(vectors.limit(0))
    assert nb.block_class_sums(none).count() == 0


def test_text_ensemble_makes_each_vector_once(spark, sf, monkeypatch):
    made, real = [], ft.tfidf_vectors
    monkeypatch.setattr(ft, "tfidf_vectors", lambda *a, **k: made.append(1) or real(*a, **k))
    sums = []
    monkeypatch.setattr(nb, "class_sums", lambda *a: sums.append(1))
    scored = all_queries()["m19_text_ensemble"](spark, sf)
    assert made == [1, 1] and not sums
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
    assert scored.count() > 0
