"""Classification thresholds.

* ``user_or_literature`` (T1): a fixed value, 0.5 by default.
* ``median`` (T2): the exact median of each model's predictions (scale-safe order statistics).
* ``validation_mcc`` / ``validation_f1`` / ``high_sensitivity`` (T3-T5): a sweep over every
  distinct score. Cumulative true/false positive counts at each score come from a distributed
  prefix sum: scores are cut into quantile buckets whose number grows with the data (bounds from
  one sketch pass, ~2M scores per bucket; beyond ``MAX_BUCKETS`` every bucket is cut again by a
  sketch of its own, as often as needed), a running sum runs inside each bucket, and bucket
  offsets come from a table of one row per bucket. No single task ever sorts all scores.
* Scope (T6) ``per_model`` sweeps each model apart, ``shared`` pools all models.
* Goal (T7) breaks ties among equally good thresholds: ``limit_false_positives`` takes the
  highest threshold, ``high_sensitivity`` the lowest, ``balanced_screening`` the best F1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnaframe.operators.metrics import DEFAULT_THRESHOLD, _ratio, predicted_label
from dnaframe.operators.quantiles import exact_quantiles

# Strategy, scope and goal names offered to users.
STRATEGIES = ("user_or_literature", "median", "validation_mcc", "validation_f1", "high_sensitivity")
SCOPES = ("shared", "per_model")
GOALS = ("limit_false_positives", "high_sensitivity", "balanced_screening")
DEFAULT_TARGET_RECALL = 0.9
SWEEP_BUCKETS = 64  # minimum buckets per group
ROWS_PER_BUCKET = 2_000_000  # target distinct-score rows per window task
MAX_BUCKETS = 4096  # buckets that one level cuts a group or a bucket into; only the first level's bounds reach the driver


def _by_model(model_col: str, values: dict) -> Column:
    """A CASE over the (few) models returning each model's literal."""
    expr = None
    for m, v in values.items():
        lit = F.lit(v).cast("double")
        expr = F.when(F.col(model_col) == F.lit(m), lit) if expr is None else expr.when(F.col(model_col) == F.lit(m), lit)
    return expr if expr is not None else F.lit(None).cast("double")


def median_thresholds(predictions: DataFrame, model_col: str = "model", score_col: str = "prediction",
                      scope: str = "per_model") -> dict:
    """Exact median of the predictions per model (or pooled for ``shared``)."""
    if scope == "shared":
        med = exact_quantiles(predictions, score_col, [0.5])[(None, 0.5)]
        models = [r[0] for r in predictions.select(model_col).distinct().collect()]
        return {m: med for m in models}
    q = exact_quantiles(predictions, score_col, [0.5], group_col=model_col)
    return {g: v for (g, _), v in q.items()}


def _refined(x: DataFrame, parts: int) -> DataFrame:
    """Cut every bucket of ``x`` into ``parts`` by its own quantiles, highest scores first.

    The bounds are a table of one row per bucket that is joined, so their number has no limit; a
    score's place among them is a binary search.
    """
    cuts = x.groupBy("grp", "b").agg(
        F.percentile_approx("s", [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("cuts"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(parts.bit_length()))])
    lower = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("cuts", at + step - 1) < F.col("s"), at + step).otherwise(at))
    rest = [c for c in x.columns if c not in ("grp", "b")]
    return x.join(cuts, ["grp", "b"]).select("grp", (F.col("b") * parts + (parts - 1) - lower).alias("b"), *rest)


def _bucketed(base: DataFrame, min_buckets: int) -> DataFrame:
    """Add ``b``: the score's quantile bucket in its group, 0 = highest scores.

    Buckets grow with the data (about ``ROWS_PER_BUCKET`` scores each, at least ``min_buckets``),
    so no window task holds an unbounded share. The first ``MAX_BUCKETS`` of a group come from one
    sketch pass and ``Bucketizer``'s binary search in the JVM; groups that need more have their
    buckets cut again (``_refined``). Equal scores always share a bucket.
    """
    from pyspark.ml.feature import Bucketizer

    sizes = {r["grp"]: r["n"] for r in base.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = sorted(sizes)
    wanted = {g: max(min_buckets, math.ceil(sizes[g] / ROWS_PER_BUCKET)) for g in groups}
    nb = {g: min(MAX_BUCKETS, wanted[g]) for g in groups}
    sk = base.agg(*[
        F.percentile_approx(F.when(F.col("grp") == F.lit(g), F.col("s")), [i / nb[g] for i in range(1, nb[g])],
                            max(10_000, 10 * nb[g])).alias(f"q{i}")
        for i, g in enumerate(groups)]).first() if groups else None
    splits, cols_in, cols_out = [], [], []
    x = base
    for i, g in enumerate(groups):
        bounds = sorted(set(v for v in (sk[f"q{i}"] or []) if v is not None and not math.isnan(v)))
        splits.append([float("-inf")] + bounds + [float("inf")])
        x = x.withColumn(f"_sv{i}", F.when(F.col("grp") == F.lit(g), F.col("s")).otherwise(F.lit(float("nan"))))
        cols_in.append(f"_sv{i}")
        cols_out.append(f"_b{i}")
    if not groups:
        return x.withColumn("b", F.lit(0))
    x = Bucketizer(splitsArray=splits, inputCols=cols_in, outputCols=cols_out, handleInvalid="keep").transform(x)
    b = None
    for i, g in enumerate(groups):
        desc = F.lit(len(splits[i]) - 2) - F.col(f"_b{i}").cast("int")  # ascending bucket -> descending
        b = F.when(F.col("grp") == F.lit(g), desc) if b is None else b.when(F.col("grp") == F.lit(g), desc)
    x = x.withColumn("b", b.otherwise(F.lit(0)).cast("long")).drop(*cols_in, *cols_out)
    missing = math.ceil(max(wanted.values()) / MAX_BUCKETS)  # parts that each bucket still has to fall into
    while missing > 1:
        x = _refined(x, min(MAX_BUCKETS, missing))
        missing = math.ceil(missing / MAX_BUCKETS)
    return x


def sweep(predictions: DataFrame, scope: str = "per_model", model_col: str = "model",
          actual_col: str = "actual", score_col: str = "prediction", buckets: int = SWEEP_BUCKETS) -> DataFrame:
    """Metrics at every candidate threshold: ``(grp, threshold, tp, fp, fn, tn, precision,
    recall, f1, mcc)`` where a row predicts positive when score >= threshold."""
    grp = F.col(model_col).cast("string") if scope == "per_model" else F.lit("shared")
    base = predictions.select(grp.alias("grp"), F.col(score_col).cast("double").alias("s"),
                              F.col(actual_col).cast("int").alias("a")).filter(F.col("s").isNotNull())
    # distinct scores with their class counts, combined map-side first (a score shared by a
    # third of all rows collapses to one row before any exchange), then running sums per bucket
    per_score = (_bucketed(base, buckets)
                 .groupBy("grp", "b", "s")
                 .agg(F.count_if(F.col("a") == 1).alias("pos"), F.count_if(F.col("a") == 0).alias("neg")))
    w = Window.partitionBy("grp", "b").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = per_score.select("grp", "b", "s", F.sum("pos").over(w).alias("rp"), F.sum("neg").over(w).alias("rn"))
    # offsets: positives / negatives in all higher buckets, one row per bucket; broadcast only if it
    # turns out small when the query runs (the running sums are dealt by the same key already)
    tot = per_score.groupBy("grp", "b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    wo = Window.partitionBy("grp").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy("grp")
    offs = tot.select("grp", "b",
                      F.coalesce(F.sum("bp").over(wo), F.lit(0)).alias("op"),
                      F.coalesce(F.sum("bn").over(wo), F.lit(0)).alias("on"),
                      F.sum("bp").over(wall).alias("P"), F.sum("bn").over(wall).alias("N"))
    j = running.join(offs, ["grp", "b"])
    tp, fp = (F.col("op") + F.col("rp")).cast("double"), (F.col("on") + F.col("rn")).cast("double")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return j.select(
        "grp", F.col("s").alias("threshold"),
        tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
        fn.cast("bigint").alias("fn"), tn.cast("bigint").alias("tn"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp * tn - fp * fn, den).alias("mcc"),
    )


def best_thresholds(sweep_df: DataFrame, strategy: str, goal: str = "limit_false_positives",
                    target_recall: float = DEFAULT_TARGET_RECALL) -> DataFrame:
    """T3-T5 + T7: ``(grp, threshold, metric)`` chosen per group with ``max_by``."""
    t = F.col("threshold")
    tie = t if goal != "high_sensitivity" else -t
    if strategy == "validation_mcc":
        key = F.struct(F.col("mcc"), F.col("f1") if goal == "balanced_screening" else F.lit(0.0), tie)
        metric = F.col("mcc")
        x = sweep_df
    elif strategy == "validation_f1":
        key = F.struct(F.col("f1"), F.col("mcc") if goal == "balanced_screening" else F.lit(0.0), tie)
        metric = F.col("f1")
        x = sweep_df
    elif strategy == "high_sensitivity":
        x = sweep_df.filter(F.col("recall") >= F.lit(float(target_recall)))
        key, metric = t, F.col("recall")
    else:
        raise ValueError(f"not a sweep strategy: {strategy}")
    return x.groupBy("grp").agg(F.max_by(F.struct(t.alias("threshold"), metric.alias("metric")), key).alias("best")) \
            .select("grp", "best.threshold", "best.metric")


def resolve_thresholds(predictions: DataFrame, strategy: str = "user_or_literature", value: float | None = None,
                       scope: str = "per_model", goal: str = "limit_false_positives",
                       model_col: str = "model", validation: DataFrame | None = None) -> dict:
    """Threshold per model as a small dict (one value per model)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown threshold strategy {strategy!r}; known are {list(STRATEGIES)}")
    if strategy == "user_or_literature":
        t = float(value) if value is not None else DEFAULT_THRESHOLD
        models = [r[0] for r in predictions.select(model_col).distinct().collect()]
        return {m: t for m in models}
    if strategy == "median":
        return median_thresholds(predictions, model_col)  # each model's own median, whatever the scope
    source = validation if validation is not None else predictions
    best = best_thresholds(sweep(source, scope, model_col), strategy, goal).collect()
    chosen = {r["grp"]: r["threshold"] for r in best}
    models = [r[0] for r in predictions.select(model_col).distinct().collect()]
    fallback = float(value) if value is not None else DEFAULT_THRESHOLD
    if scope == "shared":
        return {m: chosen.get("shared", fallback) for m in models}
    return {m: chosen.get(str(m), fallback) for m in models}


def apply_threshold(predictions: DataFrame, thresholds: dict, model_col: str = "model",
                    score_col: str = "prediction") -> DataFrame:
    """Add ``classification_threshold`` and ``predicted_label`` (T1 rule, M17)."""
    th = _by_model(model_col, thresholds)
    return (predictions.withColumn("classification_threshold", th)
            .withColumn("predicted_label", predicted_label(F.col(score_col), F.col("classification_threshold"))))
