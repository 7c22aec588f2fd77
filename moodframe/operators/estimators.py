"""The vectoriser, TF-IDF, naive Bayes and linear models as Spark ML estimators, and a grid search
that fits the features inside each fold and refits the best setting.

They take part in a ``Pipeline`` next to Spark's own stages, are saved and loaded with it, and
transform rows where they lie: no shuffle and no Python when scoring."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.functions.text import vector_words
from moodframe.operators.bayes import ALPHA, class_sums
from moodframe.operators.features import MAX_FEATURES, Vocabulary, fit_vocabulary
from moodframe.operators.linear import fit_linear, huber_probability
from moodframe.session import stage


class _TableWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.sparkSession.createDataFrame(self.model._table()).coalesce(1).write.parquet(f"{path}/data")


class _TableReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        facts = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind._of(self.sparkSession.read.parquet(f"{path}/data").toArrow())
        model._resetUid(facts["uid"])
        DefaultParamsReader.getAndSetParams(model, facts)
        return model


class _TableModel(Model, MLReadable, MLWritable):
    """A fitted stage that is a small table, one row per vocabulary term, next to its params."""

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _Texts(HasInputCol, HasOutputCol):
    """A text column, or an array column of its words; null has no words."""

    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms to keep, the most frequent first", TypeConverters.toInt)

    def _words(self, df: DataFrame) -> Column:
        column = F.col(self.getInputCol())
        words = column if df.schema[self.getInputCol()].dataType.typeName() == "array" else vector_words(column)
        return F.coalesce(words, F.array().cast("array<string>"))


class CountTerms(Estimator, _Texts, DefaultParamsReadable, DefaultParamsWritable):
    """Count vectoriser: the most frequent terms of the training rows, ties by term."""

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="counts", maxFeatures=MAX_FEATURES):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="counts", maxFeatures=MAX_FEATURES)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CountTermsModel:
        words = df.select(self._words(df).alias("words"))
        return self._copyValues(CountTermsModel(fit_vocabulary(words, max_features=self.getOrDefault(self.maxFeatures))))


class CountTermsModel(_TableModel, _Texts):
    def __init__(self, vocabulary: Vocabulary | None = None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="counts", maxFeatures=MAX_FEATURES)
        self.vocabulary = vocabulary

    def _table(self) -> pa.Table:
        own = self.vocabulary
        n = pa.array([own.n_docs] * len(own.terms), pa.int64())
        return pa.table({"idx": pa.array(range(len(own.terms)), pa.int32()), "term": pa.array(own.terms, pa.string()), "n": pa.array(own.counts, pa.int64()), "df": pa.array(own.doc_counts, pa.int64()), "n_docs": n})

    @classmethod
    def _of(cls, table: pa.Table) -> CountTermsModel:
        rows = table.sort_by("idx").to_pydict()
        return cls(Vocabulary(rows["term"], rows["n"], rows["df"], rows["n_docs"][0] if rows["term"] else 0))

    def _transform(self, df: DataFrame) -> DataFrame:
        counted = self.vocabulary.counter.transform(df.withColumn("_words", self._words(df))).drop("_words")
        return counted.withColumnRenamed("_counts", self.getOutputCol())


class TfidfWeights(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Smoothed inverse document frequencies of count vectors; rows are scaled to unit length."""

    @keyword_only
    def __init__(self, *, inputCol="counts", outputCol="features"):
        super().__init__()
        self._setDefault(inputCol="counts", outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> TfidfWeightsModel:
        vector = F.unwrap_udt(self.getInputCol())
        facts = df.agg(F.count("*").alias("n"), F.max(vector["size"]).alias("size")).first()
        seen = df.select(F.explode(vector["indices"]).alias("idx")).groupBy("idx").count().toArrow()
        documents = np.zeros(facts["size"] or 0)
        documents[seen["idx"].to_numpy()] = seen["count"].to_numpy()
        return self._copyValues(TfidfWeightsModel(np.log((1 + facts["n"]) / (1 + documents)) + 1))


class _VectorModel(_TableModel):
    """A model that is one number per term."""

    def __init__(self, values: np.ndarray | None = None):
        super().__init__()
        self.values = values

    def _table(self) -> pa.Table:
        return pa.table({"idx": pa.array(range(len(self.values)), pa.int32()), "value": pa.array(self.values, pa.float64())})

    @classmethod
    def _of(cls, table: pa.Table):
        return cls(table.sort_by("idx")["value"].to_numpy())

    def _weighted(self, df: DataFrame, column: str, out: str) -> DataFrame:
        if not len(self.values):
            return df.withColumn(out, F.col(column))
        return ElementwiseProduct(scalingVec=Vectors.dense(self.values), inputCol=column, outputCol=out).transform(df)


class TfidfWeightsModel(_VectorModel, HasInputCol, HasOutputCol):
    def __init__(self, values: np.ndarray | None = None):
        super().__init__(values)
        self._setDefault(inputCol="counts", outputCol="features")

    def _transform(self, df: DataFrame) -> DataFrame:
        weighted = self._weighted(df, self.getInputCol(), "_weighted")
        return Normalizer(p=2.0, inputCol="_weighted", outputCol=self.getOutputCol()).transform(weighted).drop("_weighted")


class _Classifier(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    def _rows(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.getLabelCol()).cast("int").alias("label"), F.col(self.getFeaturesCol()).alias("features"))

    def _size(self, df: DataFrame) -> int:
        first = df.select(F.unwrap_udt(self.getFeaturesCol())["size"].alias("n")).first()
        return first["n"] if first else 0


class _MarginModel(_VectorModel, _Classifier):
    """Class 1 where the sum of value * weight is above 0; the same columns as Spark's models."""

    def _chance(self, margin: Column) -> Column:
        return 1 / (1 + F.exp(-margin))

    def _transform(self, df: DataFrame) -> DataFrame:
        weighted = self._weighted(df, self.getFeaturesCol(), "_weighted")
        margin = F.aggregate(F.unwrap_udt("_weighted")["values"], F.lit(0.0), lambda a, b: a + b)
        found = weighted.withColumn("_margin", margin).withColumn("_p1", self._chance(F.col("_margin")))
        out = {self.getProbabilityCol(): array_to_vector(F.array(1 - F.col("_p1"), F.col("_p1"))), self.getPredictionCol(): (F.col("_margin") > 0).cast("double")}
        return found.withColumns(out).drop("_weighted", "_margin", "_p1")


class BayesModel(_MarginModel):
    pass


class BayesClassifier(Estimator, _Classifier, DefaultParamsReadable, DefaultParamsWritable):
    """Multinomial naive Bayes with a uniform prior. All smoothing values of a grid come from one
    pass over the rows (``fitMultiple``)."""

    alpha = Param(Params._dummy(), "alpha", "smoothing", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", alpha=ALPHA):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", alpha=ALPHA)
        self._set(**self._input_kwargs)

    def _sums(self, df: DataFrame) -> np.ndarray:
        found = class_sums(self._rows(df)).toArrow()
        sums = np.zeros((2, self._size(df)))
        for side, name in enumerate(("s0", "s1")):
            sums[side, found["idx"].to_numpy()] = found[name].to_numpy()
        return sums

    def _model(self, sums: np.ndarray) -> BayesModel:
        alpha = self.getOrDefault(self.alpha)
        with np.errstate(divide="ignore", invalid="ignore"):
            zero, one = (np.log((s + alpha) / (s.sum() + alpha * len(s))) for s in sums)
        return self._copyValues(BayesModel(np.nan_to_num(one - zero)))

    def _fit(self, df: DataFrame) -> BayesModel:
        return self._model(self._sums(df))

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        if any(p.name != "alpha" for m in paramMaps for p in m):
            return super().fitMultiple(dataset, paramMaps)
        sums = self._sums(dataset)
        return ((i, self.copy(m)._model(sums)) for i, m in enumerate(paramMaps))


class LinearClassifierModel(_MarginModel):
    loss = Param(Params._dummy(), "loss", "loss that was trained", TypeConverters.toString)

    def __init__(self, values: np.ndarray | None = None):
        super().__init__(values)
        self._setDefault(loss="modified_huber")

    def _chance(self, margin: Column) -> Column:
        return huber_probability(margin) if self.getOrDefault(self.loss) == "modified_huber" else super()._chance(margin)


class LinearClassifier(Estimator, _Classifier, DefaultParamsReadable, DefaultParamsWritable):
    """Linear model without intercept by accelerated proximal gradient."""

    loss = Param(Params._dummy(), "loss", "log, modified_huber, squared_hinge or hinge", TypeConverters.toString)
    penalty = Param(Params._dummy(), "penalty", "l2 or elasticnet", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "weight of the penalty", TypeConverters.toFloat)
    rounds = Param(Params._dummy(), "rounds", "scans of the rows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", loss="modified_huber", penalty="l2", alpha=1e-4, rounds=60):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", loss="modified_huber", penalty="l2", alpha=1e-4, rounds=60)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LinearClassifierModel:
        value = lambda p: self.getOrDefault(p)
        fitted = fit_linear(self._rows(df), self._size(df), value(self.loss), value(self.penalty), value(self.alpha), value(self.rounds))
        return self._copyValues(LinearClassifierModel(fitted.weights))


def text_pipeline(final, input_col: str = "text", max_features: int = MAX_FEATURES) -> Pipeline:
    """Counts, TF-IDF, then any classifier of ``features`` and ``label``."""
    return Pipeline(stages=[CountTerms(inputCol=input_col, maxFeatures=max_features), TfidfWeights(), final])


def with_chances(scored: DataFrame) -> DataFrame:
    """``probability`` and ``prediction`` of any Spark model as p1, p0 and a whole number."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    return scored.withColumns({"p1": p[1], "p0": p[0], "prediction": F.col("prediction").cast("int")}).drop("probability")


@dataclass
class GridFit:
    """The refitted best pipeline, its place in the grid, and (setting_order, setting, fold,
    accuracy, rows, terms) of all settings and folds."""

    model: PipelineModel
    best: int
    settings: list[dict]
    scores: DataFrame


def grid_search(pipeline: Pipeline, df: DataFrame, settings: list[dict], fold_col: str, k: int, parallelism: int = 3) -> GridFit:
    """Cross-validated accuracy of all settings of the last stage; the features are fitted on the
    rows outside each fold, once for all settings, and written. The first setting with the best
    mean is fitted again on all rows. ``df`` should be staged: it is read once per fold."""
    from moodframe.operators.tune import side_by_side

    *features, final = pipeline.getStages()
    maps = [{final.getParam(name): value for name, value in s.items()} for s in settings]

    def one_fold(fold: int) -> list[tuple]:
        train, held = df.filter(F.col(fold_col) != fold), df.filter(F.col(fold_col) == fold)
        fitted = Pipeline(stages=features).fit(train)
        vectors = [stage(fitted.transform(part).select(final.getLabelCol(), final.getFeaturesCol()), "fold-vectors") for part in (train, held)]
        terms = next((len(s.vocabulary.terms) for s in fitted.stages if isinstance(s, CountTermsModel)), None)
        out = []
        for order, model in final.fitMultiple(vectors[0], maps):
            hit = F.avg((F.col(model.getPredictionCol()) == F.col(final.getLabelCol())).cast("double"))
            found = model.transform(vectors[1]).agg(hit.alias("accuracy"), F.count("*").alias("rows")).first()
            out.append((order, str(settings[order]), fold, found["accuracy"], found["rows"], terms))
        return out

    rows = [r for part in side_by_side([partial(one_fold, f) for f in range(k)], parallelism) for r in part]
    means = {i: [r[3] for r in rows if r[0] == i and r[3] is not None] for i in range(len(settings))}
    best = max(means, key=lambda i: (round(sum(means[i]) / len(means[i]), 9) if means[i] else -1.0, -i))
    model = Pipeline(stages=[*features, final.copy(maps[best])]).fit(df)
    schema = "setting_order int, setting string, fold int, accuracy double, rows long, terms long"
    return GridFit(model, best, settings, df.sparkSession.createDataFrame(rows, schema))


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.read().session(spark).load(path)
