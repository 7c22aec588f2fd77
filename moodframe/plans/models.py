"""Split, vectoriser and model queries on the labelled documents."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from moodframe.functions import text as tx
from moodframe.operators import bayes as nb
from moodframe.operators import estimators as es
from moodframe.operators import evaluate as ev
from moodframe.operators import features as ft
from moodframe.operators import forest as fo
from moodframe.operators import linear as ln
from moodframe.operators import mlmodels as ml
from moodframe.operators import neighbors as kn
from moodframe.operators import score as sc
from moodframe.operators import tune as tn
from moodframe.operators.split import exact_folds, exact_split, fold_number, split_name
from moodframe.plans.registry import LABELLED, hash_sql, labelled, query, table
from moodframe.session import new_folder, stage
from moodframe.sources import tables as tb

TRAIN_TEST = {"train": 0.7, "test": 0.3}
TERMS = ft.MAX_FEATURES  # vocabulary size of these queries


# --- splits and folds -------------------------------------------------------------------


def _split_query(name, shares, edges):
    cases = " ".join(f"WHEN {hash_sql('doc_id')} % 100 < {e} THEN '{n}'" for n, e in edges[:-1])

    @query(name, f"SELECT doc_id, CASE {cases} ELSE '{edges[-1][0]}' END AS split FROM documents")
    def run(spark, sf):
        return table(spark, sf, "documents").select("doc_id", split_name(F.col("doc_id"), shares).alias("split"))


_split_query("m1_random_split", {"train": 0.95, "test": 0.05}, [("train", 95), ("test", 100)])
_split_query("m1_random_split_images", {"train": 0.8, "test": 0.2}, [("train", 80), ("test", 100)])
_split_query("m2_random_split", {"train": 0.9, "test": 0.1}, [("train", 90), ("test", 100)])

_RANK = "row_number() OVER ({} ORDER BY md5('42|' || doc_id), doc_id) - 1"


@query(
    "m1_exact_split",
    f"""WITH r AS (SELECT doc_id, {_RANK.format('')} AS place, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN place < floor(n * 0.95 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def exact(spark, sf):
    return exact_split(table(spark, sf, "documents").select("doc_id"), "doc_id", {"train": 0.95, "test": 0.05})


@query(
    "m3_stratified_split",
    f"""WITH {LABELLED}, r AS (SELECT doc_id, label, {_RANK.format('PARTITION BY label')} AS place,
      count(*) OVER (PARTITION BY label) AS n FROM labelled)
    SELECT doc_id, label, CASE WHEN place < floor(n * 0.7 + 1e-9) THEN 'train' WHEN place < floor(n * 0.85 + 1e-9) THEN 'valid'
      ELSE 'test' END AS split FROM r""",
)
def stratified(spark, sf):
    rows = labelled(spark, sf).select("doc_id", "label")
    return exact_split(rows, "doc_id", {"train": 0.7, "valid": 0.15, "test": 0.15}, by=("label",))


@query("m4_shuffled_folds", f"SELECT vec_id, ({hash_sql('vec_id')} % 5)::INT AS fold FROM embeddings")
def folds(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", fold_number(F.col("vec_id")).alias("fold"))


# --- vectoriser and naive Bayes ---------------------------------------------------------

_BASE = f"""{LABELLED},
    base AS (SELECT *, CASE WHEN {hash_sql('doc_id')} % 100 < 70 THEN 'train' ELSE 'test' END AS split FROM labelled),
    tokens AS (SELECT doc_id, label, split, term, count(*) AS tf FROM (
      SELECT doc_id, label, split, unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS term FROM base) GROUP BY ALL)"""


def _tfidf_sql(terms: int = TERMS) -> str:
    return f"""{_BASE},
    vocab AS (SELECT term, sum(tf)::BIGINT AS n, count(*) AS df FROM tokens WHERE split = 'train' GROUP BY term
      ORDER BY n DESC, term LIMIT {terms}),
    size AS (SELECT count(*) AS n FROM base WHERE split = 'train'),
    raw AS (SELECT t.doc_id, t.label, t.split, t.term, t.tf, t.tf * (ln((1 + size.n) / (1 + df)) + 1) AS x
      FROM tokens t JOIN vocab USING (term), size),
    tfidf AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS v FROM raw)"""


def _bayes_sql(alpha: float | str = 0.1, name: str = "scored", parts: str = "('test')") -> str:
    return f"""weights_{name} AS (
      WITH sums AS (SELECT vocab.term, coalesce(sum(v) FILTER (WHERE label = 0), 0) AS s0, coalesce(sum(v) FILTER (WHERE label = 1), 0) AS s1
        FROM vocab LEFT JOIN (SELECT * FROM tfidf WHERE split = 'train') t ON t.term = vocab.term GROUP BY vocab.term),
      tot AS (SELECT sum(s0) AS n0, sum(s1) AS n1, count(*) AS v FROM sums)
      SELECT term, ln((s1 + {alpha}) / (n1 + {alpha} * v)) - ln((s0 + {alpha}) / (n0 + {alpha} * v)) AS w FROM sums, tot),
    {name} AS (SELECT b.doc_id, b.label, coalesce(sum(t.v * w.w), 0) AS m FROM base b LEFT JOIN tfidf t ON t.doc_id = b.doc_id
      LEFT JOIN weights_{name} w ON w.term = t.term WHERE b.split IN {parts} GROUP BY ALL)"""


def _base(spark, sf):
    """(doc_id, words, label, split): tokens instead of texts, so each text is read once."""
    words = tx.vector_words(F.col("text")).alias("words")
    return labelled(spark, sf).select("doc_id", words, "label", split_name(F.col("doc_id"), TRAIN_TEST).alias("split"))


def _parts(spark, sf, terms: int = TERMS):
    """(vocabulary, training vectors, test vectors). The labelled rows are staged once."""
    rows = stage(_base(spark, sf), "labelled")
    train, test = (rows.filter(F.col("split") == s) for s in ("train", "test"))
    vocabulary = ft.fit_vocabulary(train, "text", terms)
    return vocabulary, ft.tfidf_vectors(train, vocabulary), ft.tfidf_vectors(test, vocabulary)


def _bayes_scores(spark, sf, alphas=(nb.ALPHA,)):
    vocabulary, train, test = _parts(spark, sf)
    sums = stage(nb.class_sums(train), "class-sums")
    weights = nb.fit_bayes(sums, alphas, len(vocabulary.terms))
    return vocabulary, weights, nb.margins(test, weights, ["doc_id", "label"])


@query(
    "m6_count_vocabulary",
    f"WITH {_tfidf_sql()} SELECT term, vocab.n, df, round(ln((1 + size.n) / (1 + df)) + 1, 9) AS idf FROM vocab, size",
)
def vocabulary(spark, sf):
    train = _base(spark, sf).filter(F.col("split") == "train")
    found = ft.fit_vocabulary(train, "text", TERMS).table(spark)
    return found.select("term", "n", "df", F.round("idf", 9).alias("idf"))


@query("m6_count_vectors", f"WITH {_tfidf_sql()} SELECT doc_id, term, tf::DOUBLE AS tf FROM raw")
def count_rows(spark, sf):
    rows = stage(_base(spark, sf), "labelled")
    found = ft.fit_vocabulary(rows.filter(F.col("split") == "train"), "text", TERMS)
    counted = ft.count_vectors(rows.select("doc_id", "words"), found).drop("words")
    long = ft.long_rows(counted, "counts").filter(F.col("idx").isNotNull())
    return long.join(F.broadcast(found.table(spark)), "idx").select("doc_id", "term", F.col("val").alias("tf"))


def _named(spark, vectors, vocabulary):
    long = ft.long_rows(vectors.select("doc_id", "features")).filter(F.col("idx").isNotNull())
    named = long.join(F.broadcast(vocabulary.table(spark)), "idx")
    return named.select("doc_id", "term", F.round("val", 9).alias("tfidf"))


@query("m7_tfidf", f"WITH {_tfidf_sql()} SELECT doc_id, term, round(v, 9) AS tfidf FROM tfidf WHERE split = 'train'")
def tfidf(spark, sf):
    found, train, _ = _parts(spark, sf)
    return _named(spark, train, found)


@query("m8_transform_new_rows", f"WITH {_tfidf_sql()} SELECT doc_id, term, round(v, 9) AS tfidf FROM tfidf WHERE split = 'test'")
def transform(spark, sf):
    found, _, test = _parts(spark, sf)
    return _named(spark, test, found)


@query(
    "m9_bayes_scores",
    f"""WITH {_tfidf_sql()}, {_bayes_sql()} SELECT doc_id, label, round(1 / (1 + exp(-m)), 6) AS p1,
      round(1 / (1 + exp(m)), 6) AS p0, (m > 0)::INT AS prediction FROM scored""",
)
def bayes_scores(spark, sf):
    out = nb.with_probability(_bayes_scores(spark, sf)[2])
    return out.withColumns({c: F.round(c, 6) for c in ("p1", "p0")})


@query(
    "flagship_bayes_confusion",
    f"""WITH {_tfidf_sql()}, {_bayes_sql()}, cells AS (SELECT label, (m > 0)::INT AS prediction, count(*) AS n FROM scored GROUP BY ALL)
    SELECT a.label, b.prediction, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM cells), 9) AS share
    FROM (VALUES (0), (1)) a(label) CROSS JOIN (VALUES (0), (1)) b(prediction)
    LEFT JOIN cells c ON c.label = a.label AND c.prediction = b.prediction""",
)
def flagship(spark, sf):
    scored = nb.with_probability(_bayes_scores(spark, sf)[2])
    return ev.confusion_long(scored).withColumn("share", F.round("share", 9))


@query(
    "s10_saved_model_scores",
    f"WITH {_tfidf_sql()}, {_bayes_sql()} SELECT doc_id, label, round(1 / (1 + exp(-m)), 6) AS p1, (m > 0)::INT AS prediction FROM scored",
)
def saved_model(spark, sf):
    found, weights, _ = _bayes_scores(spark, sf)
    path = new_folder(spark, "model")
    tb.save_model(spark, path, found, weights)
    again, weights = tb.load_model(spark, path)
    test = ft.tfidf_vectors(_base(spark, sf).filter(F.col("split") == "test"), again)
    out = nb.score_bayes(test, weights, ["doc_id", "label"])
    return out.select("doc_id", "label", F.round("p1", 6).alias("p1"), "prediction")


def timed_bayes_fit(spark, sf):
    """Run rows with the wall time of one naive Bayes fit and its settings."""
    start = time.time()
    vocabulary, train, _ = _parts(spark, sf)
    stage(nb.fit_bayes(nb.class_sums(train), n_terms=len(vocabulary.terms)), "weights")
    seconds = time.time() - start
    return tb.run_rows(spark, "bayes", {"model": {"alpha": nb.ALPHA, "terms": len(vocabulary.terms)}}, {"fit_seconds": seconds})


# --- cross-validation and grids ---------------------------------------------------------

_CV_TERMS = ft.MAX_FEATURES
_ALPHAS = ", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(nb.ALPHA_GRID))


def _fold_sql(terms: int, where: str = "") -> str:
    return f"""{LABELLED},
    base AS (SELECT doc_id, label, text, ({_RANK.format('PARTITION BY label')}) % 5 AS fold FROM labelled {where}),
    tokens AS (SELECT doc_id, label, fold, term, count(*) AS tf FROM (
      SELECT doc_id, label, fold, unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS term FROM base) GROUP BY ALL),
    f AS (SELECT unnest(range(5)) AS f),
    vocab AS (SELECT f, term, df FROM (SELECT f, term, count(*) AS df,
        row_number() OVER (PARTITION BY f ORDER BY sum(tf) DESC, term) AS rn FROM f JOIN tokens t ON t.fold <> f.f GROUP BY f, term)
      WHERE rn <= {terms}),
    size AS (SELECT f, count(*) AS n FROM f JOIN base b ON b.fold <> f.f GROUP BY f),
    raw AS (SELECT v.f, t.doc_id, t.label, t.fold, t.term, tf * (ln((1 + size.n) / (1 + df)) + 1) AS x
      FROM tokens t JOIN vocab v USING (term) JOIN size ON size.f = v.f),
    tfidf AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY f, doc_id)) AS v FROM raw)"""


def _fold_accuracy(where: str = "") -> str:
    return f"""{_fold_sql(_CV_TERMS, where)},
    sums AS (SELECT o.f, o.term, coalesce(sum(v) FILTER (WHERE label = 0 AND fold <> o.f), 0) AS s0,
      coalesce(sum(v) FILTER (WHERE label = 1 AND fold <> o.f), 0) AS s1
      FROM vocab o LEFT JOIN tfidf t ON t.f = o.f AND t.term = o.term GROUP BY ALL),
    tot AS (SELECT f, sum(s0) AS n0, sum(s1) AS n1, count(*) AS v FROM sums GROUP BY f),
    alphas(alpha_order, a) AS (VALUES {_ALPHAS}),
    weights AS (SELECT f, term, alpha_order, ln((s1 + a) / (n1 + a * v)) - ln((s0 + a) / (n0 + a * v)) AS w
      FROM sums JOIN tot USING (f), alphas),
    margin AS (SELECT b.fold, a.alpha_order, a.a AS alpha, b.doc_id, b.label, coalesce(sum(t.v * w.w), 0) AS m
      FROM base b CROSS JOIN alphas a LEFT JOIN tfidf t ON t.doc_id = b.doc_id AND t.f = b.fold
      LEFT JOIN weights w ON w.f = t.f AND w.term = t.term AND w.alpha_order = a.alpha_order GROUP BY ALL),
    accuracy AS (SELECT alpha_order, alpha, fold, avg(((m > 0)::INT = label)::INT) AS accuracy FROM margin GROUP BY ALL)"""


_FOLD_ACCURACY = _fold_accuracy()


def _folded(spark, sf):
    rows = labelled(spark, sf).select("doc_id", tx.vector_words(F.col("text")).alias("words"), "label")
    return stage(exact_folds(rows, "doc_id", 5, by=("label",)), "folded")


@query(
    "m5_cross_validated_bayes",
    f"WITH {_FOLD_ACCURACY} SELECT fold::INT AS fold, round(accuracy, 9) AS accuracy FROM accuracy WHERE alpha_order = 3",
)
def cross_validated(spark, sf):
    scores = tn.bayes_fold_scores(_folded(spark, sf), "fold", 5, (nb.ALPHA,), _CV_TERMS)
    return scores.select("fold", F.round("accuracy", 9).alias("accuracy"))


@query(
    "m18_bayes_grid",
    f"""WITH {_FOLD_ACCURACY}, means AS (SELECT alpha_order, alpha, round(avg(accuracy), 9) AS mean_accuracy, count(*) AS folds
      FROM accuracy GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY mean_accuracy DESC, alpha_order) AS place FROM means""",
)
def bayes_grid(spark, sf):
    scores = tn.bayes_fold_scores(_folded(spark, sf), "fold", 5, max_features=_CV_TERMS)
    means = tn.grid_means(scores, "alpha_order", "alpha").withColumn("mean_accuracy", F.round("mean_accuracy", 9))
    return tn.rank_settings(means, "alpha_order")


# --- pipelines: folds inside the training split, best setting refitted ---------------------

_TRAIN_ONLY = f"WHERE {hash_sql('doc_id')} % 100 < 70"
_BEST_ALPHA = f"""best AS (WITH {_fold_accuracy(_TRAIN_ONLY)}
      SELECT alpha_order, alpha FROM accuracy GROUP BY ALL ORDER BY round(avg(accuracy), 9) DESC, alpha_order LIMIT 1)"""
_REFITTED = f"""{_tfidf_sql(_CV_TERMS)}, {_BEST_ALPHA}, {_bayes_sql('(SELECT alpha FROM best)', parts="('train', 'test')")}"""


def _grid_fit(spark, sf):
    """(naive Bayes pipeline of the best smoothing, all labelled rows with their split)."""
    rows = stage(_base(spark, sf), "labelled")
    train = exact_folds(rows.filter(F.col("split") == "train").drop("split"), "doc_id", 5, by=("label",))
    settings = [{"alpha": float(a)} for a in nb.ALPHA_GRID]
    return es.grid_search(es.text_pipeline(es.BayesClassifier(), "words", _CV_TERMS), stage(train, "folded"), settings, "fold", 5), rows


@query(
    "m18_pipeline_folds",
    f"""WITH {_fold_accuracy(_TRAIN_ONLY)}, terms AS (SELECT f, count(*) AS terms FROM vocab GROUP BY f),
    held AS (SELECT fold, count(*) AS rows FROM base GROUP BY fold)
    SELECT alpha_order AS setting_order, alpha, a.fold::INT AS fold, round(accuracy, 9) AS accuracy, rows, terms FROM accuracy a
      JOIN terms ON f = a.fold JOIN held USING (fold)""",
)
def pipeline_folds(spark, sf):
    grid = _grid_fit(spark, sf)[0]
    alphas = F.array(*[F.lit(s["alpha"]) for s in grid.settings])
    return grid.scores.select("setting_order", alphas[F.col("setting_order")].alias("alpha"), "fold", F.round("accuracy", 9).alias("accuracy"), "rows", "terms")


@query(
    "m18_pipeline_grid",
    f"""WITH {_REFITTED} SELECT doc_id, label, alpha, round(1 / (1 + exp(-m)), 6) AS p1, (m > 0)::INT AS prediction
      FROM scored JOIN base USING (doc_id, label), best WHERE split = 'test'""",
)
def pipeline_grid(spark, sf):
    """The refitted best pipeline, saved, loaded and applied to the test texts."""
    grid, rows = _grid_fit(spark, sf)
    path = new_folder(spark, "pipeline")
    grid.model.write().overwrite().save(path)
    scored = es.with_chances(es.load_pipeline(spark, path).transform(rows.filter(F.col("split") == "test")))
    return scored.select("doc_id", "label", F.lit(grid.settings[grid.best]["alpha"]).alias("alpha"), F.round("p1", 6).alias("p1"), "prediction")


@query(
    "e12_fitted_model_report",
    f"""WITH {_REFITTED}, s AS (SELECT split, label, (m > 0)::INT AS prediction, 1 / (1 + exp(-m)) AS p1 FROM scored JOIN base USING (doc_id, label)),
    c AS (SELECT split, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
      count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM s GROUP BY split),
    ranked AS (SELECT split, label, rank() OVER w + (count(*) OVER (PARTITION BY split, round(p1, 9)) - 1) / 2 AS r FROM s WINDOW w AS (PARTITION BY split ORDER BY round(p1, 9))),
    area AS (SELECT split, (sum(r) FILTER (WHERE label = 1) - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0) AS auc FROM ranked
      JOIN (SELECT split, tp + fn AS n1, tn + fp AS n0 FROM c) USING (split) GROUP BY split, n1, n0)
    SELECT split, tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp), 9) AS accuracy, round(tp / nullif(tp + fn, 0), 9) AS sensitivity,
      round(tn / nullif(tn + fp, 0), 9) AS specificity, round(auc, 9) AS auc FROM c JOIN area USING (split)""",
)
def fitted_report(spark, sf):
    """Metrics of the refitted best model on the training and the test texts."""
    grid, rows = _grid_fit(spark, sf)
    scored = stage(es.with_chances(grid.model.transform(rows)).select("split", "label", "prediction", F.round("p1", 9).alias("p1")), "scored")
    out = ev.cells(scored, "split").join(ev.accuracy(scored, "split").drop("n"), "split").join(ev.rates(scored, "split"), "split").join(ev.roc_auc(scored, "split"), "split")
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "sensitivity", "specificity", "auc")})


_KNN_TERMS = 5000  # fixed value


@query(
    "m18_neighbor_grid",
    f"""WITH {_fold_sql(_KNN_TERMS)},
    norms AS (SELECT f, doc_id, sum(v * v) AS n FROM tfidf GROUP BY ALL),
    dots AS (SELECT a.f, a.doc_id AS query_id, b.doc_id AS train_id, sum(a.v * b.v) AS dot FROM tfidf a JOIN tfidf b
      ON a.f = b.f AND a.term = b.term WHERE a.fold = a.f AND b.fold <> b.f GROUP BY ALL),
    near AS (SELECT q.fold AS f, q.doc_id AS query_id, q.label AS truth, t.label, row_number() OVER (PARTITION BY q.doc_id ORDER BY
        round(greatest(coalesce(nq.n, 0) + coalesce(nt.n, 0) - 2 * coalesce(dot, 0), 0), 9), t.doc_id) AS rn
      FROM base q JOIN base t ON t.fold <> q.fold LEFT JOIN norms nq ON nq.f = q.fold AND nq.doc_id = q.doc_id
      LEFT JOIN norms nt ON nt.f = q.fold AND nt.doc_id = t.doc_id
      LEFT JOIN dots d ON d.f = q.fold AND d.query_id = q.doc_id AND d.train_id = t.doc_id),
    ks(k_order, k) AS (VALUES (0, 3), (1, 5), (2, 9), (3, 13), (4, 15)),
    votes AS (SELECT k_order, k, f, query_id, truth, (2 * sum(label) > count(*))::INT AS pred FROM near JOIN ks ON rn <= k GROUP BY ALL)
    SELECT k_order, k, f::INT AS fold, round(avg((pred = truth)::INT), 9) AS accuracy FROM votes GROUP BY ALL""",
)
def neighbor_grid(spark, sf):
    scores = tn.neighbor_fold_scores(_folded(spark, sf), "fold", 5, max_features=_KNN_TERMS)
    return scores.withColumn("accuracy", F.round("accuracy", 9))


@query("m18_linear_grid")
def linear_grid(spark, sf):
    scores = tn.linear_fold_scores(_folded(spark, sf), "fold", 5, max_features=_CV_TERMS)
    return tn.grid_means(scores, "setting_order", "setting")


def _text_grid(name, grid):
    """All settings in five folds on TF-IDF of the 5,000 most frequent training terms."""

    @query(name)
    def run(spark, sf):
        scores = tn.tree_fold_scores(_folded(spark, sf), "fold", 5, grid, _KNN_TERMS)
        return tn.grid_means(scores, "setting_order", "setting")


_text_grid("m18_tree_grid", tn.TREE_GRID)
_text_grid("m18_forest_grid", tn.FOREST_GRID)


@query(
    "m14_first_split",
    f"""WITH {_tfidf_sql(_KNN_TERMS)},
    ranked AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS place FROM vocab),
    edges AS (SELECT unnest(list_prepend(0.0, list_transform(range(1, {fo.BINS}), lambda i: power(2, (i - {fo.BINS - 1}) / 3.0)))) AS e),
    cells AS (SELECT term, (SELECT count(*) FROM edges WHERE e < t.v) AS bin, count(*) FILTER (WHERE label = 0) AS c0, count(*) FILTER (WHERE label = 1) AS c1
      FROM tfidf t WHERE split = 'train' GROUP BY ALL),
    total AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM base WHERE split = 'train'),
    cuts AS (SELECT r.term, r.place, b.border, coalesce(sum(c0) FILTER (WHERE c.bin > b.border), 0)::BIGINT AS r0, coalesce(sum(c1) FILTER (WHERE c.bin > b.border), 0)::BIGINT AS r1
      FROM ranked r CROSS JOIN (SELECT unnest(range({fo.BINS - 1})) AS border) b LEFT JOIN cells c ON c.term = r.term GROUP BY ALL),
    sided AS (SELECT term, place, border, n0 - r0 AS l0, n1 - r1 AS l1, r0, r1 FROM cuts, total),
    scored AS (SELECT *, (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1) AS gini,
      l0 * ln(greatest(l0, 1) / (l0 + l1)) + l1 * ln(greatest(l1, 1) / (l0 + l1)) + r0 * ln(greatest(r0, 1) / (r0 + r1)) + r1 * ln(greatest(r1, 1) / (r0 + r1)) AS entropy
      FROM sided WHERE l0 + l1 > 0 AND r0 + r1 > 0),
    best AS (SELECT impurity, term, border, l0, l1, r0, r1, row_number() OVER (PARTITION BY impurity ORDER BY round(score, 7) DESC, place, border) AS rn
      FROM (SELECT *, 'gini' AS impurity, gini AS score FROM scored UNION ALL SELECT *, 'entropy', entropy FROM scored))
    SELECT impurity, term, border::BIGINT AS border, l0, l1, r0, r1 FROM best WHERE rn = 1""",
)
def first_split(spark, sf):
    """The split at the root of the tree of each impurity on all training rows."""
    found, train, _ = _parts(spark, sf, _KNN_TERMS)
    ids = F.lit(0).alias("data"), F.col("doc_id").alias("id"), F.col("label").cast("int").alias("label"), F.lit(-1).alias("fold")
    rows = stage(ft.sparse_arrays(train.select(*ids, "features")), "tree-rows")
    grown = fo.grow_forests(rows, [fo.Shape(0, "all", i, 1, 1, 2) for i in ("gini", "entropy")], [len(found.terms)])
    split = [i for i in range(len(grown.shapes)) if grown.feature[i] >= 0]
    counts = [[int(v) for side in (0, 1) for v in grown.counts[grown.left[i] + side]] for i in split]
    out = [(grown.shapes[i].impurity, found.terms[grown.feature[i]], int(grown.bin[i]), *c) for i, c in zip(split, counts)]
    return spark.createDataFrame(out, "impurity string, term string, border long, l0 long, l1 long, r0 long, r1 long")


# --- neighbours -------------------------------------------------------------------------


@query(
    "m16_text_neighbors",
    f"""WITH {_tfidf_sql(_KNN_TERMS)},
    norms AS (SELECT doc_id, sum(v * v) AS n FROM tfidf GROUP BY doc_id),
    dots AS (SELECT a.doc_id AS query_id, b.doc_id AS train_id, sum(a.v * b.v) AS dot FROM tfidf a JOIN tfidf b USING (term)
      WHERE a.split = 'test' AND b.split = 'train' GROUP BY ALL),
    near AS (SELECT q.doc_id AS query_id, t.label, row_number() OVER (PARTITION BY q.doc_id ORDER BY
        round(greatest(coalesce(nq.n, 0) + coalesce(nt.n, 0) - 2 * coalesce(dot, 0), 0), 9), t.doc_id) AS rn
      FROM base q JOIN base t ON q.split = 'test' AND t.split = 'train' LEFT JOIN norms nq ON nq.doc_id = q.doc_id
      LEFT JOIN norms nt ON nt.doc_id = t.doc_id LEFT JOIN dots d ON d.query_id = q.doc_id AND d.train_id = t.doc_id)
    SELECT query_id, (2 * sum(label) > count(*))::INT AS prediction, round(avg(label), 6) AS p1 FROM near WHERE rn <= 5 GROUP BY query_id""",
)
def text_neighbors(spark, sf):
    found, train, test = _parts(spark, sf, _KNN_TERMS)
    rows = lambda v: ft.sparse_arrays(v.select(F.col("doc_id").alias("id"), "label", "features"))
    near = kn.nearest_neighbors(stage(rows(train)), stage(rows(test)), 5, len(found.terms))
    return kn.vote(near, 5).withColumn("p1", F.round("p1", 6))


@query(
    "m16_vector_neighbors",
    f"""WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, {hash_sql('vec_id')} % 100 < 80 AS train FROM embeddings),
    near AS (SELECT q.vec_id AS query_id, t.vec_id AS neighbor_id, t.label, round(greatest(list_dot_product(q.e, q.e) + list_dot_product(t.e, t.e)
      - 2 * list_dot_product(q.e, t.e), 0), 9) AS d2 FROM s q JOIN s t ON NOT q.train AND t.train),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id) AS rn FROM near)
    SELECT query_id, neighbor_id, label, round(d2, 6) AS d2, rn FROM ranked WHERE rn <= 5""",
)
def vector_neighbors(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("split", split_name(F.col("vec_id"), {"train": 0.8, "test": 0.2}))
    rows = kn.dense_arrays(rows.withColumnRenamed("vec_id", "id"), "embedding").select("id", "label", "idx", "val", "split")
    part = lambda s: rows.filter(F.col("split") == s).drop("split")
    return kn.nearest_neighbors(part("train"), part("test"), 5, 64).withColumn("d2", F.round("d2", 6))


# --- linear models ----------------------------------------------------------------------


def _first_step_sql(step: float) -> str:
    """Weights after one round from zero: slope -2 at margin 0, mean over the rows."""
    return f"""WITH {_tfidf_sql()} SELECT vocab.term, round({step!r} * 2 * coalesce(sum(v * (2 * label - 1)), 0) / max(size.n), 9) AS weight
      FROM vocab LEFT JOIN (SELECT * FROM tfidf WHERE split = 'train') t ON t.term = vocab.term, size GROUP BY vocab.term"""


def _first_step(spark, sf, loss, alpha):
    found, train, _ = _parts(spark, sf)
    model = ln.fit_linear(train, len(found.terms), loss, "l2", alpha, rounds=1)
    weights = model.table(spark).join(found.table(spark), "idx")
    return weights.select("term", F.round("w0", 9).alias("weight"))


@query("m10_linear_first_step", _first_step_sql(1 / (2 + 1e-4)))
def linear_first_step(spark, sf):
    return _first_step(spark, sf, "modified_huber", 1e-4)


@query("m13_svm_first_step", _first_step_sql(1 / (2 + 1e-2)))
def svm_first_step(spark, sf):
    return _first_step(spark, sf, "squared_hinge", 1e-2)


@query("m10_linear_scores")
def linear_scores(spark, sf):
    found, train, test = _parts(spark, sf)
    model = ln.fit_linear(train, len(found.terms), "modified_huber", rounds=60)
    out = nb.margins(test, model.table(spark), ["doc_id", "label"])
    p1 = ln.huber_probability(F.col("m0"))
    return out.select("doc_id", "label", p1.alias("p1"), (1 - p1).alias("p0"), (F.col("m0") > 0).cast("int").alias("prediction"))


@query("m13_squared_hinge_svm")
def svm_scores(spark, sf):
    found, train, test = _parts(spark, sf)
    model = ln.fit_squared_hinge_svm(train, len(found.terms), rounds=60)
    out = nb.margins(test, model.table(spark), ["doc_id", "label"])
    return out.select("doc_id", "label", (F.col("m0") > 0).cast("int").alias("prediction"))


@query("m13_hinge_svm_variant")
def hinge_variant(spark, sf):
    _, train, test = _parts(spark, sf)
    rows = stage(train.select("label", "features"), "vectors")
    fitted = ln.hinge_svm(rows.count(), max_iter=100).fit(rows)
    return fitted.transform(test).select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query("m11_text_logistic_regression")
def text_regression(spark, sf):
    _, train, test = _parts(spark, sf)
    rows = stage(train.select("label", "features"), "vectors")
    fitted = ln.logistic_regression(rows.count()).fit(rows)
    return ml.scored_classes(fitted, test, ["doc_id", "label"])


def _early_stopped(spark, sf, path=None):
    rows = stage(_base(spark, sf), "labelled")
    train = rows.filter(F.col("split") == "train")
    held = F.col("doc_id") % 5 == 0
    found = ft.fit_vocabulary(train.filter(~held), "text", TERMS)
    vectors = lambda d: ft.tfidf_vectors(d, found)
    return found, ln.fit_linear(
        vectors(train.filter(~held)), len(found.terms), "log", rounds=60, valid=vectors(train.filter(held)),
        monitor="f1", patience=3, checkpoint=path,
    )


@query("m23_early_stop_history")
def early_stop_history(spark, sf):
    model = _early_stopped(spark, sf)[1]
    history = model.history_table(spark).drop("seconds")
    return history.withColumn("is_best", F.col("round") == model.best_round)


@query("m24_best_weights_checkpoint")
def best_weights(spark, sf):
    path = new_folder(spark, "best")
    found, _ = _early_stopped(spark, sf, path)
    return ln.load_weights(spark, path).join(found.table(spark), "idx").select("term", F.col("w0").alias("weight"))


@query("m25_training_history")
def training_history(spark, sf):
    found, train, _ = _parts(spark, sf)
    model = ln.fit_linear(train, len(found.terms), "modified_huber", rounds=60)
    path = new_folder(spark, "runs")
    wide = model.history_table(spark).select(F.concat(F.lit("round-"), "round").alias("run_id"), "train_loss")
    tb.append_rows(tb.metric_rows(wide, F.col("run_id"), ["train_loss"]), path)
    return spark.read.schema(tb.RUN_SCHEMA).parquet(path)


# --- vector models ----------------------------------------------------------------------


def _pixels(spark, sf):
    """Train and test rows, dealt evenly over all cores and sorted, whatever files they come in."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).cast("int").alias("label"))
    rows = ml.pixel_vectors(rows, "embedding").drop("embedding")
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "vec_id").sortWithinPartitions("vec_id")
    rows = stage(rows.withColumn("split", split_name(F.col("vec_id"), {"train": 0.8, "test": 0.2})), "pixels")
    return (rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))


def _vector_model(name, make):
    @query(name)
    def run(spark, sf):
        train, test = _pixels(spark, sf)
        return ml.scored_classes(make(train).fit(train), test, ["vec_id", "label"])


_vector_model("m12_pixel_logistic_regression", lambda t: ln.logistic_regression(t.count(), c=100.0, intercept=True, max_iter=500))
_vector_model("m14_decision_tree", lambda t: ml.decision_tree())
_vector_model("m15_random_forest", lambda t: ml.random_forest())
_vector_model("m17_feed_forward", lambda t: ml.feed_forward(64))


def _text_model(name, make):
    """The same trees on TF-IDF of the 5,000 most frequent training terms."""

    @query(name)
    def run(spark, sf):
        found, train, test = _parts(spark, sf, _KNN_TERMS)
        rows = stage(train.select(F.col("label").cast("double").alias("label"), "features"), "vectors")
        return ml.scored_classes(make().fit(ml.bounded_parts(rows, len(found.terms))), test, ["doc_id", "label"])


_text_model("m14_text_decision_tree", ml.decision_tree)
_text_model("m15_text_random_forest", ml.random_forest)


# --- scoring ----------------------------------------------------------------------------


@query(
    "m19_ensemble_scores",
    f"""WITH {_tfidf_sql()}, {_bayes_sql(0.1, 'first')}, {_bayes_sql(1, 'second')},
    mean AS (SELECT a.doc_id, (1 / (1 + exp(-a.m)) + 1 / (1 + exp(-b.m))) / 2 AS p1 FROM first a JOIN second b USING (doc_id))
    SELECT doc_id, round(p1, 6) AS p1, round(1 - p1, 6) AS p0, CASE WHEN p1 >= 0.7 THEN 'Depressed' ELSE 'Not depressed' END AS prediction FROM mean""",
)
def ensemble(spark, sf):
    margins = stage(_bayes_scores(spark, sf, (0.1, 1.0))[2], "margins")
    first, second = (nb.with_probability(margins, m) for m in ("m0", "m1"))
    out = sc.ensemble(first, second, "doc_id")
    return out.withColumns({c: F.round(c, 6) for c in ("p1", "p0")})


@query("m19_text_ensemble")
def text_ensemble(spark, sf):
    """Mean of the linear and the Bayes model on cleaned texts, both fitted on one vocabulary."""
    cleaned = labelled(spark, sf).withColumn("text", tx.clean_post(F.col("text")))
    rows = cleaned.select("doc_id", tx.vector_words(F.col("text")).alias("words"), "label", split_name(F.col("doc_id"), TRAIN_TEST).alias("split"))
    rows = stage(rows, "labelled")
    train, test = (rows.filter(F.col("split") == s) for s in ("train", "test"))
    found = ft.fit_vocabulary(train, "text", TERMS)
    rows = ln.training_rows(ft.tfidf_vectors(train, found))
    bayes = nb.fit_bayes(stage(nb.block_class_sums(rows), "class-sums"), n_terms=len(found.terms))
    linear = ln.fit_linear(rows, len(found.terms), "modified_huber", rounds=60, staged=True).table(spark).withColumnRenamed("w0", "w1")
    weights = linear.join(bayes, "idx", "left").fillna(0.0, "w0")
    scored = stage(nb.margins(ft.tfidf_vectors(test, found), weights, ["doc_id"]), "margins")
    linear = scored.select("doc_id", ln.huber_probability(F.col("m1")).alias("p1"))
    return sc.ensemble(linear, nb.with_probability(scored, "m0"), "doc_id")


@query(
    "m20_single_model_scores",
    f"""WITH {_tfidf_sql()}, s AS (SELECT b.doc_id, coalesce(sum(v * (({hash_sql('t.term')} % 2001) - 1000) / 100.0), 0) AS m FROM base b
      LEFT JOIN tfidf t ON t.doc_id = b.doc_id WHERE b.split = 'test' GROUP BY b.doc_id)
    SELECT doc_id, (m > 0)::INT AS prediction, round(1 / (1 + exp(-m)), 6) AS p1, round(1 / (1 + exp(m)), 6) AS p0 FROM s""",
)
def single_model(spark, sf):
    found, _, test = _parts(spark, sf)
    weights = found.table(spark).select("idx", ((tx.hash_number(F.col("term")) % 2001 - 1000) / F.lit(100.0)).alias("w0"))
    out = nb.score_bayes(test, weights, ["doc_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("p1", "p0")})


@query(
    "m21_softmax_classes",
    """WITH s AS (SELECT vec_id, list_transform(embedding[1:4]::DOUBLE[], lambda x: exp(x - list_max(embedding[1:4])::DOUBLE)) AS e, embedding[1:4] AS l FROM embeddings)
    SELECT vec_id, (list_position(l, list_max(l)) - 1)::INT AS prediction, round(1 / list_sum(e), 9) AS confidence,
      round(e[2] / list_sum(e), 9) AS p1 FROM s""",
)
def softmax(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("logits"))
    out = sc.with_softmax(rows, "logits")
    return out.select("vec_id", "prediction", F.round("confidence", 9).alias("confidence"), F.round(F.col("probabilities")[1], 9).alias("p1"))


def _half_sums():
    """A model loader for the bulk query: logits are the sums of both halves."""
    weights = np.zeros((64, 2))
    weights[:32, 0] = 1.0
    weights[32:, 1] = 1.0
    return lambda x: x.astype(float) @ weights


@query(
    "m22_bulk_scores",
    """WITH s AS (SELECT vec_id, list_sum(embedding[1:32]::DOUBLE[]) AS a, list_sum(embedding[33:64]::DOUBLE[]) AS b FROM embeddings)
    SELECT vec_id, (b > a)::INT AS prediction, round(1 / (1 + exp(a - b)), 6) AS p1 FROM s""",
)
def bulk(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = sc.with_softmax(sc.bulk_score(rows, ["vec_id"], "embedding", _half_sums, "vec_id long"), "logits")
    return scored.select("vec_id", "prediction", F.round(F.col("probabilities")[1], 6).alias("p1"))


@query(
    "m22_bulk_sigmoid_scores",
    """WITH s AS (SELECT vec_id, 1 / (1 + exp(-list_sum(embedding::DOUBLE[]))) AS p FROM embeddings)
    SELECT vec_id, round(p, 6) AS p1, (p > 0.5)::INT AS prediction FROM s""",
)
def bulk_sigmoid(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    model = lambda: lambda x: 1 / (1 + np.exp(-x.astype(float).sum(axis=1)))
    out = sc.sigmoid_class(sc.bulk_score(rows, ["vec_id"], "embedding", model, "vec_id long"))
    return out.withColumn("p1", F.round("p1", 6))
