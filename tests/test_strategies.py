"""Stored runs by split strategy and their replays; quantiles and caps of awkward values."""

import math
import os
import random

import pytest

from dnaframe.operators import profile as prof
from dnaframe.operators import sampling as smp
from dnaframe.operators import thresholds as thr
from dnaframe.operators.quantiles import exact_quantiles
from dnaframe.plans import jobs
from dnaframe.sources import store

GC = {"use_gc": True, "use_kmers": False}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A registry with the data set ``ds``."""
    folder = tmp_path_factory.mktemp("strategies")
    rng = random.Random(4)
    path = str(folder / "d.csv")
    with open(path, "w") as f:
        f.write("sequence,label\n" + "".join(f"{''.join(rng.choice('ACGT') for _ in range(12))},{i % 2}\n" for i in range(45)))
    jobs.ingest(spark, path, str(folder / "store"), "ds")
    return str(folder / "store")


def request(**options):
    return jobs.BenchmarkRequest(**({"dataset_id": "ds", "target_col": "label", "preprocessing": GC, "threshold_strategy": "median"} | options))


def both(spark, root, tmpdir_path, req):
    """(part, rounded metrics) of a stored run and of its replay, its predictions per part, its registry row."""
    run = jobs.run_benchmark(spark, root, req)["run"]
    found = store.get_run(spark, root, run["run_id"], None)
    summary = jobs.replay_run(spark, root, run["run_id"], os.path.join(tmpdir_path, "again"))
    key = lambda rows: sorted(((r["part"], round(r.mae, 9), round(r.mcc, 9), r.test_rows) for r in rows), key=str)
    again = spark.read.schema(found["metrics"].schema).json(summary["metrics_path"])
    parts = {}
    for r in found["predictions"].collect():
        parts[r["part"]] = parts.get(r["part"], 0) + 1
    return key(found["metrics"].collect()), key(again.collect()), parts, run


def test_folds_are_stored_and_replayed(spark, root, tmpdir_path):
    first, again, parts, run = both(spark, root, tmpdir_path, request(split_strategy="kfold_small_dataset", cv_folds=3))
    assert first == again and len(first) == 3 and parts == {0: 15, 1: 15, 2: 15}
    assert (run["rows_used"], run["test_rows"], run["train_rows"]) == (45, 45, None)


def test_seeds_are_stored_and_replayed(spark, root, tmpdir_path):
    first, again, parts, _ = both(spark, root, tmpdir_path, request(split_strategy="repeated_seed_holdout", reruns=2, random_seed=5, max_rows=40))
    assert first == again and parts == {5: 8, 6: 8}


def test_a_provided_split_is_stored_and_replayed(spark, root, tmpdir_path):
    path = os.path.join(tmpdir_path, "split")
    smp.save_split_manifest(smp.split_manifest(store.load_dataset(spark, root, "ds").select("row_id"), 42, 0.4), path)
    req = request(split_strategy="provided_train_validation_test", split_manifest_path=path, model_overrides={"linear_regression": {"regParam": 0.5}})
    first, again, parts, run = both(spark, root, tmpdir_path, req)
    assert first == again and parts == {None: 18}
    cfg = store.read_json(spark, root, "runs", "configs", f"run_id={run['run_id']}")
    assert cfg["split"]["split_manifest_path"] == path and cfg["models"][0]["overrides"] == {"regParam": 0.5}
    plain = jobs.evaluate(store.load_dataset(spark, root, "ds"), request(split_strategy=req.split_strategy, split_manifest_path=path)).first()
    assert round(plain.mae, 9) != first[0][1]  # the options matter, so the replay has used them
    cfg["split"]["split_manifest_path"] = None
    with pytest.raises(ValueError, match="split_manifest_path"):
        jobs.replay(spark, cfg, os.path.join(tmpdir_path, "no"), data=store.load_dataset(spark, root, "ds"))


def test_an_unfinished_run_is_not_seen_and_a_retry_replaces_it(spark, root, monkeypatch):
    before = store.list_runs(spark, root)
    before = before.count() if before is not None else 0
    monkeypatch.setattr(store, "save_model", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        jobs.run_benchmark(spark, root, request(), run_id="r1")
    monkeypatch.undo()
    listed = store.list_runs(spark, root)
    assert (listed.count() if listed is not None else 0) == before
    assert store.get_run(spark, root, "r1") == {"run": None, "metrics": None, "predictions": None}
    for _ in range(2):
        jobs.run_benchmark(spark, root, request(), run_id="r1")
    assert store.list_runs(spark, root).filter("run_id = 'r1'").count() == 1
    found = store.get_run(spark, root, "r1")
    assert found["predictions"].count() == 9 and found["metrics"].count() == 1


def test_folds_one_by_one_or_side_by_side(spark, root):
    df = store.load_dataset(spark, root, "ds")
    found = [sorted((r.fold, round(r.mae, 12)) for r in jobs.cross_validate(df, request(), 4, parallelism=p)["per_fold"].collect()) for p in (1, 4)]
    assert found[0] == found[1] and len(found[0]) == 4


def test_unknown_threshold_strategies_are_refused(spark):
    with pytest.raises(ValueError, match="threshold strategy"):
        request(threshold_strategy="best")
    with pytest.raises(ValueError, match="threshold strategy"):
        thr.resolve_thresholds(spark.createDataFrame([("m", 0.5)], "model string, prediction double"), "best")


@pytest.mark.parametrize("most", [200_000, 3])
def test_quantiles_with_nan_equal_spark_s(spark, most):
    nan = math.nan
    for values in ([nan, 3.0, nan, 1.0, 2.0], [nan], [1.0, nan], [None, 2.0, nan, -1.0], [float("inf"), nan, float("-inf"), 0.0] * 5):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        expect = df.selectExpr("percentile(v, array(0.25, 0.5, 0.75))").first()[0]
        got = exact_quantiles(df, "v", [0.25, 0.5, 0.75], max_candidates=most)
        same = lambda a, b: a == b or (math.isnan(a) and math.isnan(b))
        assert all(same(got[None, q], e) for q, e in zip((0.25, 0.5, 0.75), expect)), (values, got, expect)


def test_cap_by_words_with_nulls(spark):
    rows = [(None if i % 2 else f"id{i:03d}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id string, v int")
    few, flag = prof.cap_rows(df, 20)
    assert sorted(r.row_id for r in few.collect()) == [f"id{i:03d}" for i in range(0, 40, 2)] and flag.first()[0]
    more = prof.cap_rows(df, 40)[0].collect()  # all that have a key, then ten of the others, the same ones every time
    assert len(more) == 40 and sum(r.row_id is None for r in more) == 10
    assert sorted(r.v for r in more) == sorted(r.v for r in prof.cap_rows(df.repartition(7), 40)[0].collect())
    assert prof.cap_rows(df, 60)[0].count() == 60
    equal = spark.createDataFrame([(None, 1)] * 30, "row_id string, v int")
    assert prof.cap_rows(equal, 7)[0].count() == 7


def test_nth_word_walks_down_prefixes(spark):
    rng = random.Random(6)
    words = [f"sample/{'a' * rng.randint(0, 9)}{rng.randint(0, 500):03d}é" for _ in range(400)] + ["", "z", "漢字", "sample/"] + ["hot"] * 50
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    for n in (1, 2, 3, 50, 200, 403, 404, 430, 454):
        assert prof.nth_word(df, df["w"], n, most=4) == sorted(words)[n - 1]
