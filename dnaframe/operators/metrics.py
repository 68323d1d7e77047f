"""Evaluation: regression and thresholded classification metrics for all models in one pass
(A5-A13, J3, U1, W10).

Input is a predictions table ``(model, row_id, actual, prediction[, classification_threshold])``.
Every metric is a sum or count, so one ``groupBy(model)`` with map-side partial aggregation
computes all of them for all models; metric formulas are projections over those sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
TASK_REGRESSION = "regression"
TASK_BINARY = "binary_label_regression_baseline"
DEFAULT_THRESHOLD = 0.5


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (zero_division=0, M19)."""
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0)).cast("double")


def union_predictions(frames: list[DataFrame]) -> DataFrame:
    """Per-model prediction tables as one; missing columns (predicted_label) become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_actuals(predictions: DataFrame, labels: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Predictions joined to the true targets by row id (both sides shuffle on row_id once)."""
    return predictions.join(labels, row_id, "inner")


def missing_predictions(labels: DataFrame, predictions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """J3 check: test rows without a prediction (left anti join)."""
    return labels.join(predictions.select(row_id).distinct(), row_id, "left_anti")


def predicted_label(prediction: Column, threshold: Column) -> Column:
    """T1 rule: predicted class = prediction >= threshold (inclusive, M17)."""
    return (prediction >= threshold).cast("int")


def regression_aggs(actual: str = "actual", prediction: str = "prediction") -> list[Column]:
    a, p = F.col(actual), F.col(prediction)
    err = a - p
    return [
        F.count(F.lit(1)).alias("test_rows"),
        F.avg(F.abs(err)).alias("_mae"),
        F.avg(err * err).alias("_mse"),
        F.sum(err * err).alias("_ss_res"),
        (F.var_pop(a) * F.count(a)).alias("_ss_tot"),
    ]


def regression_projection(digits: int | None = 6) -> list[Column]:
    """Mae, mse, rmse, r2. R2 is null for fewer than 2 rows; for constant actuals it is
    1 when every prediction hits and 0 otherwise."""
    r2 = (F.when(F.col("test_rows") < 2, F.lit(None).cast("double"))
          .when(F.col("_ss_tot") == 0, F.when(F.col("_ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("_ss_res") / F.col("_ss_tot")))
    cols = {"mae": F.col("_mae"), "mse": F.col("_mse"), "rmse": F.sqrt("_mse"), "r2": r2}
    return [(F.round(c, digits) if digits is not None else c).alias(n) for n, c in cols.items()]


def confusion_aggs(actual: str = "actual", label: str = "predicted_label") -> list[Column]:
    """Tn, fp, fn, tp, always all four."""
    a, l = F.col(actual).cast("int"), F.col(label)
    return [
        F.count_if((a == 0) & (l == 0)).alias("true_negative"),
        F.count_if((a == 0) & (l == 1)).alias("false_positive"),
        F.count_if((a == 1) & (l == 0)).alias("false_negative"),
        F.count_if((a == 1) & (l == 1)).alias("true_positive"),
    ]


def classification_projection(digits: int | None = 6) -> list[Column]:
    """A9-A10 from the four counts (in DOUBLE, no long overflow); zero denominators give 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("true_negative", "false_positive", "false_negative", "true_positive"))
    n = tn + fp + fn + tp
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    cols = {
        "accuracy": _ratio(tp + tn, n),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": _ratio(tp * tn - fp * fn, den),
    }
    return [(F.round(c, digits) if digits is not None else c).alias(n_) for n_, c in cols.items()]


def regression_metrics(predictions: DataFrame, by=("model",), digits: int | None = 6) -> DataFrame:
    """A5-A7 per group."""
    agg = predictions.groupBy(*by).agg(*regression_aggs())
    return agg.select(*by, "test_rows", *regression_projection(digits))


def confusion_counts(predictions: DataFrame, by=("model",)) -> DataFrame:
    """A8 per group; needs a ``predicted_label`` column."""
    return predictions.groupBy(*by).agg(*confusion_aggs())


def classification_metrics(predictions: DataFrame, by=("model",), digits: int | None = 6) -> DataFrame:
    """A8-A10 per group."""
    agg = confusion_counts(predictions, by)
    return agg.select(*by, *classification_projection(digits),
                      "true_negative", "false_positive", "false_negative", "true_positive")


def all_metrics(predictions: DataFrame, binary_target: bool, train_rows: int | None = None,
                by=("model",), digits: int | None = 6) -> DataFrame:
    """Every metric of every model in one aggregation.

    With a binary target, ``predictions`` carries ``predicted_label`` and
    ``classification_threshold`` (from ``thresholds.apply_threshold``).
    """
    aggs = regression_aggs()
    if binary_target:
        aggs += confusion_aggs() + [F.first("classification_threshold").alias("classification_threshold")]
    agg = predictions.groupBy(*by).agg(*aggs)
    cols = [*by, F.lit(TASK_BINARY if binary_target else TASK_REGRESSION).alias("task_type"),
            *regression_projection(digits)]
    if train_rows is not None:
        cols.append(F.lit(int(train_rows)).cast("bigint").alias("train_rows"))
    cols.append("test_rows")
    if binary_target:
        cols += ["classification_threshold", *classification_projection(digits),
                 "true_negative", "false_positive", "false_negative", "true_positive"]
    return agg.select(*cols)


METRIC_NAMES = ("mae", "mse", "rmse", "r2", "accuracy", "precision", "recall", "f1", "mcc")


def multi_seed_summary(per_seed_metrics: DataFrame, metrics=METRIC_NAMES, by=("model",),
                       digits: int | None = 6) -> DataFrame:
    """Mean / sample std / min / max of each metric across seeds, per model."""
    present = [m for m in metrics if m in per_seed_metrics.columns]
    aggs = [F.count(F.lit(1)).alias("seeds")]
    for m in present:
        for fn, name in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max")):
            c = fn(m)
            aggs.append((F.round(c, digits) if digits is not None else c).alias(f"{m}_{name}"))
    return per_seed_metrics.groupBy(*by).agg(*aggs)
