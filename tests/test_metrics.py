"""Metrics, thresholds and quantiles."""

import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dnaframe.operators import metrics as met
from dnaframe.operators import thresholds as thr
from dnaframe.operators.quantiles import exact_quantiles, order_statistics


def test_one_class_confusion_is_zero(spark):
    df = spark.createDataFrame([("m", i, 0.0, 0.1) for i in range(5)], "model string, row_id int, actual double, prediction double")
    lab = thr.apply_threshold(df, {"m": 0.5})
    r = met.classification_metrics(lab).first()
    assert (r.precision, r.recall, r.f1, r.mcc) == (0.0, 0.0, 0.0, 0.0) and r.accuracy == 1.0


def test_inclusive_threshold(spark):
    df = spark.createDataFrame([("m", 1, 1.0, 0.5)], "model string, row_id int, actual double, prediction double")
    assert thr.apply_threshold(df, {"m": 0.5}).first().predicted_label == 1


def test_r2_edges(spark):
    const = spark.createDataFrame([("m", i, 1.0, 1.0) for i in range(3)], "model string, row_id int, actual double, prediction double")
    assert met.regression_metrics(const).first().r2 == 1.0
    one = spark.createDataFrame([("m", 1, 1.0, 2.0)], "model string, row_id int, actual double, prediction double")
    assert met.regression_metrics(one).first().r2 is None


def test_exact_quantiles_small_and_narrowing(spark):
    vals = [float((i * 7919) % 10007) / 3.0 for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, "x", [0.25, 0.5, 0.75], max_candidates=100)  # forces the sketch narrowing path
    srt = sorted(vals)
    assert q[(None, 0.5)] == pytest.approx(statistics.median(vals))
    pos = 0.25 * (len(vals) - 1)
    lo = int(pos)
    assert q[(None, 0.25)] == pytest.approx(srt[lo] + (srt[lo + 1] - srt[lo]) * (pos - lo))
    k = order_statistics(df, "x", {None: [1, 2500, 5000]}, max_candidates=50)
    assert [k[(None, 1)], k[(None, 2500)], k[(None, 5000)]] == [srt[0], srt[2499], srt[4999]]


def test_sweep_matches_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows = [("a" if i % 2 else "b", i, float(rnd.random() < 0.4), round(rnd.random(), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "model string, row_id int, actual double, prediction double")
    best = {r.grp: (r.threshold, r.metric) for r in thr.best_thresholds(thr.sweep(df, "per_model", buckets=8), "validation_mcc").collect()}
    for m in ("a", "b"):
        sub = [(a, p) for mm, _, a, p in rows if mm == m]
        cands = []
        for t in sorted({p for _, p in sub}):
            tp = sum(1 for a, p in sub if a == 1 and p >= t)
            fp = sum(1 for a, p in sub if a == 0 and p >= t)
            fn = sum(1 for a, p in sub if a == 1 and p < t)
            tn = sum(1 for a, p in sub if a == 0 and p < t)
            den = ((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5
            cands.append(((tp * tn - fp * fn) / den if den else 0.0, t))
        mcc, t = max(cands)
        assert best[m][0] == pytest.approx(t) and best[m][1] == pytest.approx(mcc)


def test_multi_seed_summary(spark):
    df = spark.createDataFrame([(1, "m", 0.5), (2, "m", 0.7)], "seed int, model string, mae double")
    r = met.multi_seed_summary(df, metrics=("mae",)).first()
    assert r.seeds == 2 and r.mae_mean == 0.6 and r.mae_min == 0.5 and r.mae_max == 0.7


def test_sweep_many_small_buckets(spark, monkeypatch):
    import random

    rnd = random.Random(11)
    rows = [("m", i, float(rnd.random() < 0.3), round(rnd.random(), 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "model string, row_id int, actual double, prediction double")
    ref = {(r.threshold, r.tp, r.fp) for r in thr.sweep(df, "per_model").collect()}
    monkeypatch.setattr(thr, "ROWS_PER_BUCKET", 5)  # about 60 buckets of ~5 scores
    got = {(r.threshold, r.tp, r.fp) for r in thr.sweep(df, "per_model", buckets=2).collect()}
    assert got == ref
    for t, tp, fp in got:
        assert tp == sum(1 for _, _, a, p in rows if a == 1 and p >= t)
        assert fp == sum(1 for _, _, a, p in rows if a == 0 and p >= t)


def test_sweep_cuts_buckets_again(spark, monkeypatch):
    """Buckets of at most three parts a level: four levels, with ties, a hot score and two models."""
    import random

    rnd = random.Random(12)
    score = lambda i: 0.5 if i % 3 == 0 else round(rnd.random(), 2) if i % 3 == 1 else rnd.random() * 1e-9
    rows = [("m" if i % 5 else "n", i, float(rnd.random() < 0.3), score(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "model string, row_id int, actual double, prediction double")
    ref = {tuple(r) for r in thr.sweep(df, "per_model").collect()}
    monkeypatch.setattr(thr, "ROWS_PER_BUCKET", 4)
    monkeypatch.setattr(thr, "MAX_BUCKETS", 3)
    base = df.select(F.col("model").alias("grp"), F.col("prediction").alias("s"))
    found = thr._bucketed(base, 2).distinct().orderBy("grp", F.desc("s")).collect()
    assert max(Counter((r.grp, r.b) for r in found).values()) <= 12 and len({r.b for r in found}) > 27
    for m in "mn":  # higher scores lie in buckets of smaller numbers
        numbers = [r.b for r in found if r.grp == m]
        assert numbers == sorted(numbers)
    assert {tuple(r) for r in thr.sweep(df, "per_model", buckets=2).collect()} == ref
    assert len(ref) == len({(m, s) for m, _, _, s in rows})


def test_missing_predictions_anti_join(spark):
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(6)], "row_id int, actual double")
    preds = spark.createDataFrame([("m", i, 0.4) for i in (0, 2, 3)], "model string, row_id int, prediction double")
    assert sorted(r.row_id for r in met.missing_predictions(labels, preds).collect()) == [1, 4, 5]
    joined = met.with_actuals(preds, labels)
    assert joined.count() == 3 and set(joined.columns) == {"row_id", "model", "prediction", "actual"}
