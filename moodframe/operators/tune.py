"""Cross-validation and grid search."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from itertools import accumulate, product

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodframe.operators.bayes import ALPHA_GRID, class_sums, fit_bayes, margins
from moodframe.operators.features import (
    MAX_FEATURES,
    fold_vocabularies,
    sparse_arrays,
    tfidf_vectors,
)
from moodframe.operators.forest import forest_fold_scores
from moodframe.operators.linear import LinearModel, fit_linear_grid, row_blocks, weight_table
from moodframe.operators.neighbors import nearest_neighbors
from moodframe.session import stage

# The grids of the original runs.
LINEAR_GRID = {"loss": ["log", "modified_huber", "hinge"], "penalty": ["elasticnet", "l2"], "rounds": [25, 50, 75]}
TREE_GRID = {"impurity": ["gini", "entropy"], "maxDepth": [20, 30, 40], "minSplit": [50, 75, 100]}
FOREST_GRID = {
    "numTrees": [200, 500],
    "featureSubsetStrategy": ["sqrt", "log2"],
    "maxDepth": [20, 30],
    "impurity": ["gini", "entropy"],
    "minSplit": [50, 75],
}
NEIGHBOR_GRID = [3, 5, 9, 13, 15]


def bayes_fold_scores(
    df: DataFrame, fold_col: str, k: int, alphas=tuple(ALPHA_GRID), max_features: int = MAX_FEATURES
) -> DataFrame:
    """Accuracy per (alpha_order, alpha, fold): vocabulary, weights and scores are fitted
    afresh per fold; all smoothing values share one pass, and so do the sums of all folds.
    ``df`` has doc_id, label and text or words."""
    vocabularies = fold_vocabularies(df, fold_col, k, "text", max_features)
    fitted = reduce(
        DataFrame.unionByName,
        [
            class_sums(tfidf_vectors(df.filter(F.col(fold_col) != f), v)).withColumn("fold", F.lit(f))
            for f, v in enumerate(vocabularies)
        ],
    )
    sums = stage(fitted, "class-sums")
    parts = []
    for fold, vocabulary in enumerate(vocabularies):
        held = tfidf_vectors(df.filter(F.col(fold_col) == fold), vocabulary)
        weights = fit_bayes(sums.filter(F.col("fold") == fold), alphas, len(vocabulary.terms))
        scored = margins(held, weights, ["doc_id", "label"])
        hits = [
            F.avg(((F.col(f"m{i}") > 0).cast("int") == F.col("label")).cast("double")).alias(f"m{i}")
            for i in range(len(alphas))
        ]
        parts.append(scored.agg(*hits).withColumn("fold", F.lit(fold)))
    wide = reduce(DataFrame.unionByName, parts)
    long = wide.unpivot("fold", [f"m{i}" for i in range(len(alphas))], "_m", "accuracy")
    order = F.expr("cast(substr(_m, 2) as int)")
    values = F.array(*[F.lit(float(a)) for a in alphas])
    return long.select(order.alias("alpha_order"), values[order].alias("alpha"), "fold", "accuracy")


def grid_means(fold_scores: DataFrame, order: str, setting: str) -> DataFrame:
    return fold_scores.groupBy(order, setting).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.count("*").alias("folds")
    )


def best_setting(means: DataFrame, order: str) -> DataFrame:
    """Highest mean accuracy; the first in grid order wins a tie."""
    return means.orderBy(F.desc("mean_accuracy"), order).limit(1)


def side_by_side(tasks, parallelism: int) -> list:
    """Runs a few driver functions at once, so that the jobs of small fits overlap."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(lambda task: task()), tasks))


def neighbor_fold_scores(
    df: DataFrame, fold_col: str, k_folds: int, ks=tuple(NEIGHBOR_GRID), max_features: int = 5000, parallelism: int = 3
) -> DataFrame:
    """Accuracy per (k_order, k, fold). The largest k is searched once and voted on at each k."""

    def one_fold(fold, vocabulary):
        rows = stage(
            sparse_arrays(
                tfidf_vectors(df, vocabulary).select(F.col("doc_id").alias("id"), "label", fold_col, "features")
            ),
            "knn-rows",
        )
        held = rows.filter(F.col(fold_col) == fold)
        near = nearest_neighbors(rows.filter(F.col(fold_col) != fold), held, max(ks), len(vocabulary.terms))
        return stage(near.join(held.select(F.col("id").alias("query_id"), F.col("label").alias("truth")), "query_id"), "near")

    def scored(fold, near):
        """Every neighbour casts a ballot for each k it is near enough for."""
        grid = F.array(*[F.struct(F.lit(i).alias("k_order"), F.lit(k).alias("k")) for i, k in enumerate(ks)])
        ballots = near.select("query_id", "truth", "label", F.explode(F.filter(grid, lambda g: F.col("rn") <= g["k"])).alias("g"))
        votes = ballots.groupBy("query_id", "truth", "g", "label").agg(F.count("*").alias("votes"))
        picked = votes.groupBy("query_id", "truth", "g").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("p"))
        hit = F.avg((F.col("p") == F.col("truth")).cast("double"))
        return picked.groupBy("g").agg(hit.alias("accuracy")).select("g.k_order", "g.k", F.lit(fold).alias("fold"), "accuracy")

    vocabularies = fold_vocabularies(df, fold_col, k_folds, "text", max_features)
    found = side_by_side([partial(one_fold, f, v) for f, v in enumerate(vocabularies)], parallelism)
    return reduce(DataFrame.unionByName, [scored(f, near) for f, near in enumerate(found)])


def linear_fold_scores(
    df: DataFrame, fold_col: str, k: int, grid=None, alpha: float = 1e-4, max_features: int = MAX_FEATURES
) -> DataFrame:
    """Accuracy per setting and fold of the linear trainer; each row is scored once, in the fold
    that holds it out. All folds and settings train side by side, and settings that differ only
    in the number of rounds share one path."""
    grid = LINEAR_GRID if grid is None else grid
    chosen = [dict(zip(grid, values)) for values in product(*grid.values())]
    pairs = list(dict.fromkeys((c["loss"], c["penalty"]) for c in chosen))
    vocabularies = fold_vocabularies(df, fold_col, k, "text", max_features)
    borders = list(accumulate((len(v.terms) for v in vocabularies), initial=0))

    def rows(fold, held):
        own = df.filter((F.col(fold_col) == fold) if held else (F.col(fold_col) != fold))
        arrays = sparse_arrays(tfidf_vectors(own, vocabularies[fold]).select("label", "features"))
        return arrays.select(F.lit(fold).alias("fold"), "label", F.transform("idx", lambda i: i + F.lit(borders[fold])).alias("idx"), "val")

    train, test = (reduce(DataFrame.unionByName, [rows(f, held) for f in range(k)]) for held in (False, True))
    train, test = stage(row_blocks(train.withColumn("row_weight", F.lit(1.0))), "grid-blocks"), stage(test, "grid-rows")
    sizes = {r[fold_col]: r["count"] for r in df.groupBy(fold_col).count().collect()}
    stops = fit_linear_grid(train, borders, [sum(n for g, n in sizes.items() if g != f) for f in range(k)], pairs, sorted(set(grid["rounds"])), alpha)
    models = [LinearModel(stops[c["rounds"]][pairs.index((c["loss"], c["penalty"]))], c["loss"]) for c in chosen]
    scored = margins(test, weight_table(df.sparkSession, models), ["fold", "label"])
    hits = [
        F.struct(
            F.lit(i).alias("setting_order"), F.lit(str(c)).alias("setting"),
            F.avg(((F.col(f"m{i}") > 0).cast("int") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("rows"),
        )
        for i, c in enumerate(chosen)
    ]
    line = scored.groupBy("fold").agg(F.array(*hits).alias("h")).select("fold", F.explode("h").alias("h"))
    return line.select("h.setting_order", "h.setting", "fold", "h.accuracy", "h.rows")


def ml_grid_search(estimator, df: DataFrame, grid: dict, folds: int = 5, seed: int = 42, parallelism: int = 2):
    """Grid search of a Spark ML estimator by cross-validated accuracy."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    judge = MulticlassClassificationEvaluator(labelCol=estimator.getLabelCol(), metricName="accuracy")
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=builder.build(), evaluator=judge,
        numFolds=folds, seed=seed, parallelism=parallelism,
    )
    return search.fit(df)


def ml_fold_scores(
    df: DataFrame, fold_col: str, k: int, estimator, grid: dict, max_features: int = 5000, parallelism: int = 2
) -> DataFrame:
    """Accuracy per setting and fold of a Spark ML classifier on TF-IDF vectors; each row is scored
    once, in the fold that holds it out, and vocabularies are fitted afresh per fold. A model is
    scored as soon as it is fitted and not kept."""
    chosen = [dict(zip(grid, values)) for values in product(*grid.values())]
    vocabularies = fold_vocabularies(df, fold_col, k, "text", max_features)
    label = F.col("label").cast("double").alias("label")
    vectors = [stage(tfidf_vectors(df, v).select(fold_col, label, "features"), "grid-vectors") for v in vocabularies]

    def score(i, setting, fold):
        train, held = vectors[fold].filter(F.col(fold_col) != fold), vectors[fold].filter(F.col(fold_col) == fold)
        model = estimator.fit(train, {estimator.getParam(name): value for name, value in setting.items()})
        hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
        found = model.transform(held).agg(hit.alias("accuracy"), F.count("*").alias("rows")).first()
        return i, str(setting), fold, found["accuracy"], found["rows"]

    tasks = [partial(score, i, c, fold) for i, c in enumerate(chosen) for fold in range(k)]
    schema = "setting_order int, setting string, fold int, accuracy double, rows long"
    return df.sparkSession.createDataFrame(side_by_side(tasks, parallelism), schema)


def tree_fold_scores(df: DataFrame, fold_col: str, k: int, grid: dict, max_features: int = 5000) -> DataFrame:
    """Accuracy per setting and fold of a grid of trees or forests on TF-IDF vectors, vocabularies
    fitted afresh per fold. All trees of all folds and settings grow together, one scan a level."""
    vocabularies = fold_vocabularies(df, fold_col, k, "text", max_features)
    ids = F.col("doc_id").alias("id"), F.col(fold_col).cast("int").alias("fold"), F.col("label").cast("int").alias("label")
    rows = [sparse_arrays(tfidf_vectors(df, v).select(F.lit(f).alias("data"), *ids, "features")) for f, v in enumerate(vocabularies)]
    return forest_fold_scores(reduce(DataFrame.unionByName, rows), grid, k, [len(v.terms) for v in vocabularies])


def grid_report(search, spark) -> DataFrame:
    """Mean accuracy per setting of a finished ML grid search."""
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(a))
        for i, (m, a) in enumerate(zip(search.getEstimatorParamMaps(), search.avgMetrics))
    ]
    return spark.createDataFrame(rows, "setting_order int, setting string, mean_accuracy double")


def rank_settings(means: DataFrame, order: str) -> DataFrame:
    """All settings with their place; the grid bounds the rows of the window."""
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("mean_accuracy"), order))
    return means.withColumn("place", place.cast("bigint"))
