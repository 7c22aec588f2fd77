"""Classification metrics as grouped aggregates. Scored frames have label, prediction and,
where needed, p1; ``by`` adds grouping columns such as split, fold or model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodframe.operators.ordered import running_totals
from moodframe.session import stage

LOG_CLIP = 2.220446049250313e-16  # fixed value: double precision epsilon


def _hit() -> Column:
    return (F.col("label") == F.col("prediction")).cast("double")


def ratio(top: Column, bottom: Column, empty=None) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def accuracy(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg(_hit()).alias("accuracy"))


def cells(scored: DataFrame, *by: str) -> DataFrame:
    """tn, fp, fn, tp in one pass."""
    y, p = F.col("label"), F.col("prediction")
    return scored.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def confusion_long(scored: DataFrame) -> DataFrame:
    """One row per cell with count and share; missing cells are 0."""
    wide = cells(scored)
    cell = lambda y, p, c: F.struct(F.lit(y).alias("label"), F.lit(p).alias("prediction"), F.col(c).alias("n"))
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    long = wide.select(
        total.alias("_t"), F.explode(F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))).alias("c")
    )
    return long.select("c.label", "c.prediction", "c.n", ratio(F.col("c.n"), F.col("_t")).alias("share"))


def rates(scored: DataFrame, *by: str) -> DataFrame:
    """Sensitivity and specificity; null where a class is absent."""
    return cells(scored, *by).select(
        *by,
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
    )


def class_report(scored: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted mean. 0/0 is 0."""
    base = cells(scored, *by)

    def line(name, hit, wrong, missed):
        hit, wrong, missed = F.col(hit), F.col(wrong), F.col(missed)
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, hit + wrong, 0.0).alias("precision"),
            ratio(hit, hit + missed, 0.0).alias("recall"),
            ratio(2 * hit, 2 * hit + wrong + missed, 0.0).alias("f1"),
            (hit + missed).alias("support"),
        )

    two = base.select(*by, line("0", "tn", "fn", "fp").alias("a"), line("1", "tp", "fp", "fn").alias("b"))
    n = F.col("a.support") + F.col("b.support")

    def mean(name, wa, wb):
        part = lambda m: (F.col(f"a.{m}") * wa + F.col(f"b.{m}") * wb).alias(m)
        return F.struct(F.lit(name).alias("class"), part("precision"), part("recall"), part("f1"), n.alias("support"))

    wa, wb = ratio(F.col("a.support"), n, 0.0), ratio(F.col("b.support"), n, 0.0)
    rows = F.array(F.col("a"), F.col("b"), mean("macro avg", F.lit(0.5), F.lit(0.5)), mean("weighted avg", wa, wb))
    return two.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def log_loss_value(p1: str = "p1") -> Column:
    p = F.least(F.greatest(F.col(p1), F.lit(LOG_CLIP)), F.lit(1 - LOG_CLIP))
    return F.avg(-F.log(F.when(F.col("label") == 1, p).otherwise(1 - p)))


def macro_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Accuracy, macro F1, precision, recall, log loss: one pass, one row per group."""
    y, p = F.col("label"), F.col("prediction")
    base = scored.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.avg(_hit()).alias("accuracy"),
        log_loss_value().alias("logloss"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return base.select(
        *by,
        "accuracy",
        ((ratio(2 * tn, 2 * tn + fn + fp, 0.0) + ratio(2 * tp, 2 * tp + fp + fn, 0.0)) / 2).alias("f1"),
        ((ratio(tn, tn + fn, 0.0) + ratio(tp, tp + fp, 0.0)) / 2).alias("precision"),
        ((ratio(tn, tn + fp, 0.0) + ratio(tp, tp + fn, 0.0)) / 2).alias("recall"),
        "logloss",
    )


METRICS = ["accuracy", "f1", "precision", "recall", "logloss"]


def train_test_report(scored: DataFrame, split_col: str = "split") -> DataFrame:
    """The five metrics on every split, in long form."""
    return macro_metrics(scored, split_col).unpivot(split_col, METRICS, "metric", "value")


def _score_counts(scored: DataFrame, score: str, positive: int, by: tuple[str, ...]) -> DataFrame:
    is_pos = F.col("label") == positive
    grouped = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg")
    )
    return stage(grouped, "scores")


def roc_auc(scored: DataFrame, *by: str, score: str = "p1", positive: int = 1) -> DataFrame:
    """Rank statistic with mean ranks on ties; null where a class is absent."""
    counts = _score_counts(scored, score, positive, by)
    both = counts.withColumn("n", F.col("pos") + F.col("neg"))
    run = running_totals(both, "score", ["n"], by)
    mean_rank = F.col("n_upto") - (F.col("n") - 1) / 2
    sums = run.groupBy(*by).agg(
        F.sum(F.col("pos") * mean_rank).alias("_r"),
        F.sum("pos").cast("double").alias("_p"),
        F.sum("neg").cast("double").alias("_n"),
    )
    p, n = F.col("_p"), F.col("_n")
    return sums.select(*by, ratio(F.col("_r") - p * (p + 1) / 2, p * n).alias("auc"))


def roc_curve(scored: DataFrame, *by: str, score: str = "p1", positive: int = 1) -> DataFrame:
    """One point per distinct threshold: share of positives and negatives at or above it."""
    counts = _score_counts(scored, score, positive, by)
    run = running_totals(counts, "score", ["pos", "neg"], by)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if by:
        joined = run.join(totals, list(by))
    else:
        joined = run.withColumns(
            {"_p": counts.agg(F.sum("pos")).scalar(), "_n": counts.agg(F.sum("neg")).scalar()}
        )
    tp = F.col("_p") - F.col("pos_upto") + F.col("pos")
    fp = F.col("_n") - F.col("neg_upto") + F.col("neg")
    return joined.select(
        *by, F.col("score").alias("threshold"), ratio(tp, F.col("_p")).alias("tpr"), ratio(fp, F.col("_n")).alias("fpr")
    )


def roc_both_classes(scored: DataFrame, *by: str) -> DataFrame:
    """Both curves: class 0 is positive on p0, class 1 on p1."""
    curves = [
        roc_curve(scored, *by, score=s, positive=c).withColumn("class", F.lit(c)) for c, s in ((0, "p0"), (1, "p1"))
    ]
    return reduce(DataFrame.unionByName, curves)


def binary_report(scored: DataFrame) -> DataFrame:
    """accuracy, f1, precision, recall and AUC of the positive class, one row."""
    c = cells(scored)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    line = c.select(
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        ratio(tp, tp + fp, 0.0).alias("precision"),
        ratio(tp, tp + fn, 0.0).alias("recall"),
    )
    return line.withColumn("auc_roc", roc_auc(scored).scalar())


def fold_report(scored: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Accuracy per fold, then the mean and its band."""
    folds = stage(accuracy(scored, fold_col), "folds")
    mean = folds.agg(
        F.sum("n").alias("n"), F.avg("accuracy").alias("accuracy"),
        (2 * F.stddev_pop("accuracy") / F.sqrt(F.count("*"))).alias("band"),
    )
    each = folds.select(F.col(fold_col).cast("string").alias("fold"), "n", "accuracy", F.lit(None).cast("double").alias("band"))
    return each.unionByName(mean.select(F.lit("mean").alias("fold"), "n", "accuracy", "band"))


def best_model(metrics: DataFrame, accuracy_col: str = "accuracy", order_col: str = "model_order") -> DataFrame:
    """Highest accuracy, first in order on a tie; without a positive one, ("None", 0)."""
    top = metrics.filter(F.col(accuracy_col) > 0).agg(
        F.max_by("model", F.struct(accuracy_col, -F.col(order_col))).alias("model"),
        F.max(accuracy_col).alias("accuracy"),
    )
    return top.select(F.coalesce("model", F.lit("None")).alias("model"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
