"""Model metrics as aggregates (E1-E4, X4, X5): one pass each, SQL-checkable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CATEGORIES
from .common import literal_rows
from .growth import histogram


def _div0(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 of a 0/1 prediction; zero division -> 0."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    c = pred.agg(F.count(F.lit(1)).alias("test_rows"),
                 F.count_if((y == 1) & (p == 1)).alias("tp"),
                 F.count_if((y != 1) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p != 1)).alias("fn"),
                 F.count_if(y == p).alias("hits"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("test_rows",
                    _div0(F.col("hits"), F.col("test_rows")).alias("accuracy"),
                    _div0(tp, tp + fp).alias("precision"),
                    _div0(tp, tp + fn).alias("recall"),
                    _div0(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(pred: DataFrame, labels: list[str] = CATEGORIES, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Counts for every (actual, predicted) pair in fixed label order; zeros kept."""
    pairs = [(a, i, p, j) for i, a in enumerate(labels) for j, p in enumerate(labels)]
    grid = literal_rows(pred.sparkSession, [(name, [t[k] for t in pairs]) for k, name in
                                            enumerate(["actual", "actual_order", "predicted", "predicted_order"])])
    known = F.col(label).isin(labels) & F.col(prediction).isin(labels)  # so at most labels^2 rows are left
    counts = (pred.where(known).groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted"))
              .agg(F.count(F.lit(1)).alias("videos")))
    return (grid.join(F.broadcast(counts), ["actual", "predicted"], "left")
            .select("actual", "actual_order", "predicted", "predicted_order",
                     F.coalesce(F.col("videos"), F.lit(0)).cast("bigint").alias("videos")))


def multiclass_metrics(pred: DataFrame, train_rows: DataFrame, classes: int = len(CATEGORIES),
                       label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, number of classes, training rows."""
    acc = pred.agg(_div0(F.count_if(F.col(label) == F.col(prediction)), F.count(F.lit(1))).alias("accuracy"))
    return acc.crossJoin(train_rows).select("accuracy", F.lit(classes).alias("classes"), "training_rows")


def regression_metrics(pred: DataFrame, train_rows: DataFrame, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """R^2 = 1 - SS_res / SS_tot and mean absolute error, plus training rows."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    s = pred.agg(F.sum((y - p) * (y - p)).alias("ss_res"),
                 (F.count(y) * F.var_pop(y)).alias("ss_tot"),  # one pass
                 F.avg(F.abs(y - p)).alias("mae"))
    return s.crossJoin(train_rows).select(
        (1 - F.try_divide(F.col("ss_res"), F.col("ss_tot"))).alias("r2"), "mae", "training_rows")


def rmse_residuals(pred: DataFrame, bins: int = 30, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """Residual histogram (actual - predicted) with the RMSE on every row."""
    res = pred.select((F.col(label).cast("double") - F.col(prediction).cast("double")).alias("residual"))
    rmse = res.agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))
    return histogram(res, "residual", bins).crossJoin(F.broadcast(rmse))


def per_class_metrics(pred: DataFrame, labels: list[str] = CATEGORIES, label: str = "label",
                      prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    cm = confusion_matrix(pred, labels, label, prediction)
    per = cm.groupBy("actual", "actual_order").agg(
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("videos")).otherwise(0)).alias("tp"),
        F.sum("videos").alias("support"))
    predicted = cm.groupBy(F.col("predicted").alias("actual")).agg(F.sum("videos").alias("predicted"))
    j = per.join(predicted, "actual")
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    return j.select(F.col("actual").alias("class"), F.col("actual_order").alias("class_order"),
                    _div0(tp, prd).alias("precision"), _div0(tp, sup).alias("recall"),
                    _div0(2 * tp, sup + prd).alias("f1"), sup.cast("bigint").alias("support"))
