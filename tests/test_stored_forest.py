"""A forest above the driver's share of nodes is grown, stored and read in groups of trees."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from dnaframe.operators import features as feat
from dnaframe.operators import models as mdl
from dnaframe.plans import jobs
from dnaframe.sources import store


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.range(120).select((F.col("id") % 100).alias("row_id"),  # some ids come twice
                                   F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGT" * 4).alias("sequence"),
                                   (F.col("id") % 5).cast("double").alias("y"))
    x = feat.build_features(rows, "sequence", {"use_gc": True, "kmer_size": 1}, keep=("row_id", "y")).repartition(3).persist()
    x.count()
    yield x
    x.unpersist()


def test_driver_holds_a_group_of_trees(spark, frame, monkeypatch):
    monkeypatch.setattr(mdl, "DRIVER_NODES", 500)
    fit = lambda: mdl.fit_and_predict(frame, frame, ["random_forest"], 42, overrides={"random_forest": {"numTrees": 8}})
    fitted, preds = fit()
    forest = fitted["random_forest"]
    assert isinstance(forest, mdl.StoredForest) and forest.trees == 8 and len(forest.groups) > 1
    models = list(forest.models())
    assert all(m.totalNumNodes <= 600 or n == 1 for m, (_, n) in zip(models, forest.groups))  # trees differ a little in size
    assert len({t.toDebugString.split("\n", 1)[1] for m in models for t in m.trees}) == 8  # no tree comes twice
    # the mean over all trees, for every row, with its own actual value
    local = [(r.row_id, r.y, sum(m.predict(r.features) * n for m, (_, n) in zip(models, forest.groups)) / 8) for r in frame.collect()]
    got = [(r.row_id, r.actual, round(r.prediction, 9)) for r in preds.collect()]
    assert sorted(got) == sorted((i, y, round(p, 9)) for i, y, p in local) and len(got) == 120
    assert sorted(fit()[1].collect()) == sorted(preds.collect())
    path = store.save_model(forest, tempfile.mkdtemp(prefix="dnaframe-test-", dir="/tmp"), "run", "random_forest")
    assert len([n for n in os.listdir(path) if n.startswith("group=")]) == len(forest.groups)


def test_small_and_shallow_forests_stay_one_model(frame, monkeypatch):
    fit = lambda **o: mdl.fit_and_predict(frame, frame, ["random_forest"], 42, overrides={"random_forest": {"numTrees": 4} | o})[0]["random_forest"]
    assert fit().totalNumNodes > 0
    monkeypatch.setattr(mdl, "DRIVER_NODES", 64)
    assert fit(maxDepth=3).totalNumNodes <= 4 * 15
    assert isinstance(fit(), mdl.StoredForest)


def test_a_run_with_a_stored_forest(spark, monkeypatch):
    rows = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "GGGC").otherwise("ATTA").alias("sequence"),
                                   (F.col("id") % 2 == 0).cast("int").alias("label"))
    req = jobs.BenchmarkRequest(models=["random_forest"], target_col="label", preprocessing={"use_gc": True, "use_kmers": False},
                                threshold_strategy="validation_mcc", validation_size=0.2, model_overrides={"random_forest": {"numTrees": 4}})
    monkeypatch.setattr(mdl, "DRIVER_NODES", 2)
    out = jobs.run_benchmark(spark, tempfile.mkdtemp(prefix="dnaframe-test-", dir="/tmp"), req, df=rows)
    assert out["metrics"].first().r2 == 1.0 and out["run"]["test_rows"] == 20
