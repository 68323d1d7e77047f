"""Tree models learn a step of GC content within a tolerance, and give the same again for the same seed."""

import random

import pytest

from dnaframe.operators import features as feat
from dnaframe.operators import models as mdl
from dnaframe.plans import jobs


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(200):
        gc = rng.random()
        seq = "".join(rng.choice("GC") if rng.random() < gc else rng.choice("AT") for _ in range(40))
        share = sum(c in "GC" for c in seq) / 40
        out.append((i, seq, 10.0 if share > 0.5 else 1.0))
    return spark.createDataFrame(out, "row_id long, sequence string, target double")


@pytest.mark.parametrize("name, options", [("random_forest", {"numTrees": 8, "maxDepth": 4}), ("gradient_boosting", {"maxIter": 8})])
def test_trees_learn_a_step(rows, name, options):
    req = jobs.BenchmarkRequest(models=[name], target_col="target", preprocessing={"use_gc": True, "use_kmers": False},
                                model_overrides={name: options})
    found = [jobs.evaluate(rows, req).first() for _ in range(2)]
    assert found[0].test_rows == 40 and found[0].r2 > 0.8 and found[0].mae < 1.5
    assert found[0].mae == found[1].mae


def test_rows_keep_their_nodes_and_the_forest_is_the_same(spark, rows):
    frame = feat.build_features(rows.selectExpr("row_id", "sequence", "double(row_id % 7) AS y"), "sequence", {"use_gc": True, "kmer_size": 2}, keep=("row_id", "y"))
    frame = frame.repartition(3, "row_id").persist()
    frame.count()
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, options = held(), {"numTrees": 6, "maxDepth": 14}
    kept, preds = mdl.fit_and_predict(frame, frame, ["random_forest"], 42, overrides={"random_forest": options})
    led, same = mdl.fit_and_predict(frame, frame, ["random_forest"], 42, overrides={"random_forest": options | {"cacheNodeIds": False}})
    assert kept["random_forest"].getCacheNodeIds() and not led["random_forest"].getCacheNodeIds()
    assert kept["random_forest"].toDebugString.split("\n")[1:] == led["random_forest"].toDebugString.split("\n")[1:]
    assert kept["random_forest"].totalNumNodes > 100 and sorted(preds.collect()) == sorted(same.collect())
    assert held() == before  # no pass leaves its nodes in memory
    frame.unpersist()
